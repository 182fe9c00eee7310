from __future__ import annotations

import bisect
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm.conftest import odd_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from viewgrain.llm import packing


def sums(fillings, counts):
    left = np.zeros_like(counts)
    for f in fillings:
        for n, k in f.uses.items():
            left[n] += k * f.times
    return left


@pytest.mark.parametrize("seed", range(4))
def test_best_two_fit_packs_everything_tightly(seed):
    rng = random.Random(seed)
    counts = np.zeros(257, dtype=np.int64)
    for _ in range(3000):
        counts[rng.choice([rng.randint(1, 40), rng.randint(1, 256), 97])] += 1
    fillings = packing.best_two_fit(counts, 256)
    assert (sums(fillings, counts) == counts).all()
    assert all(sum(n * k for n, k in f.uses.items()) <= 256 and f.times > 0 for f in fillings)
    gaps: list[int] = []  # best fit decreasing, piece by piece
    for n in sorted((n for n in range(257) for _ in range(counts[n])), reverse=True):
        at = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else 256) - n)
    assert sum(f.times for f in fillings) <= len(gaps)


def test_two_pieces_replace_the_shortest():
    counts = np.zeros(11, dtype=np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # greedy: 6 + 3, gap 1; two 2s fill it
    first = packing.best_two_fit(counts, 10)[0]
    assert first.uses == {6: 1, 2: 2}


def test_round_trip_and_edges(session, odd, none):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(packing.tokenise(odd))
    got = packed.collect()
    want = defaultdict(int)
    for doc, text, *_ in odd_rows():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for i, (start, length) in enumerate(packing.pieces(len(ids), 2048)):
            want[doc, i, start, length, struct.pack(f"<{length}I", *ids[start : start + length])] += 1
    have = defaultdict(int)
    bins = defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, bytes(r.ids)] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for slots in bins.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 2048
    whole = packing.sequences(packed).collect()
    assert len(whole) == len(bins) and all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert packing.pack(packing.tokenise(none)).count() == 0
    crc = packing.tokenise(odd).where("doc_id = 2").select(F.crc32("ids").alias("c")).first().c
    assert crc == zlib.crc32(b"\0\0\0\0")


def test_only_the_first_piece_is_short():
    assert packing.pieces(5, 4) == [(0, 1), (1, 4)]
    assert packing.pieces(8, 4) == [(0, 4), (4, 4)]
    assert packing.pieces(1, 4) == [(0, 1)]
