from __future__ import annotations

import numpy as np
import pytest
import xxhash
from llm.conftest import WORD, odd_rows
from pyspark.sql import functions as F

from viewgrain.llm import simhash
from viewgrain.llm.components import components


def brute_print(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if shingles and 2 * counts[b] > len(shingles))


def brute_components(prints, budget=2):
    label = list(range(len(prints)))
    values = np.array(prints, dtype=np.uint64)
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            close = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= budget)
            least = min(label[j] for j in close)
            for j in close:
                if label[j] != least:
                    label[j], changed = least, True
    return label


def test_fingerprints_match_the_native_hash(session, odd):
    got = {(r.doc_id, r.fp) for r in simhash.fingerprints(odd).collect()}
    want = {(r[0], int(np.uint64(brute_print(r[1])).view(np.int64))) for r in odd_rows()}
    assert got == want
    assert session.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == np.uint64(
        xxhash.xxh64_intdigest(b"a b c", 42)
    ).view(np.int64)


@pytest.mark.parametrize("small_tasks", [False, True])
def test_links_connect_what_brute_force_connects(session, small_tasks, monkeypatch):
    if small_tasks:
        monkeypatch.setattr(simhash, "LEAST_IN_TASK", 6)
        monkeypatch.setattr(simhash, "MOST_IN_TASK", 6)
        monkeypatch.setattr(simhash, "FRONTIER", 16)
    rng = np.random.default_rng(5)
    hubs = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = set(hubs.tolist()) | {0, (1 << 64) - 1}
    for hub in hubs.tolist():
        for _ in range(12):
            bits = rng.choice(64, rng.integers(1, 5), replace=False)
            prints.add(hub ^ sum(1 << int(b) for b in bits))
    prints = sorted(prints)
    frame = session.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    found = {r.node: r.component for r in components(simhash.links(frame)).collect()}
    own = [found.get(int(np.uint64(p).view(np.int64)), int(np.uint64(p).view(np.int64))) for p in prints]
    want = brute_components(prints)
    assert len(set(zip(own, want))) == len(set(own)) == len(set(want))


def test_documents(odd, none):
    rows = odd_rows()
    prints = [brute_print(r[1]) for r in rows]
    label = brute_components(prints)
    least = {c: min((r[0] for r, k in zip(rows, label) if k == c and r[0] is not None), default=None) for c in set(label)}
    want = sorted(((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, label)), key=repr)
    got = simhash.near_duplicates(odd).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert simhash.near_duplicates(none).count() == 0
    left = simhash.one_of_each(odd)
    assert left.columns == odd.columns
    assert {r.doc_id for r in left.collect()} == {v for v in least.values()}


def test_components_of_a_chain_a_star_and_a_loop(session):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.node: r.component for r in components(session.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {500: 500, 501: 500}


def test_one_row_of_each_with_repeated_and_missing_ids(session):
    same, other, third = ("many words of one text " * 9, "quite different content stands here " * 9, "nothing of either is in this one " * 9)
    rows = [(1, same), (2, same), (2, other), (None, same), (None, third), (None, third), (7, third + "\n"), (8, "no copy of this"), (8, "no copy of this")]
    rows += [(None, "only without ids"), (None, "only without ids"), (None, "alone without an id")]
    left = simhash.one_of_each(session.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(1, same), (2, other), (7, third + "\n"), (8, "no copy of this"), (None, "only without ids"), (None, "alone without an id")]
    assert sorted(map(repr, map(tuple, left))) == sorted(map(repr, want))
