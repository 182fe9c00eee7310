from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from llm.conftest import WORD, odd_rows

from viewgrain.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


def test_odd_rows(odd, none):
    rows = odd_rows()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    mixed = mixing.mix(odd)
    got = mixing.per_row(mixed).collect()
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=repr) == sorted(
        ((r[0], r[3], size(r[1])) for r in rows), key=repr
    )
    taken, longest = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        longest[r.source] = max(longest[r.source], r["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in want)
    copies = mixing.copied(odd, mixed)
    assert copies.columns == odd.columns
    words = Counter()
    for r in copies.collect():
        words[r.source] += size(r.text)
    assert words == Counter({s: n for s, n in taken.items() if n})
    assert mixing.mix(none).count() == 0


def test_same_rows_same_mix(session, odd):
    one = sorted(map(tuple, mixing.mix(odd).collect()), key=repr)
    assert sorted(map(tuple, mixing.mix(odd.repartition(3, "text")).collect()), key=repr) == one


def test_buckets_meet_in_a_tree(session, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, " ".join(["w"] * (i % 23 + 1)), f"s{i % 2}") for i in range(600)]
    docs = session.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.per_row(mixing.mix(docs)).collect()
    for source in ("s0", "s1"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r["size"] for r in own) - own[0].target) <= 23


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(1)
    part, size = rng.uniform(0, 1, 50), rng.integers(1, 200, 50).astype(float)
    mean = np.zeros(50)
    for turn in range(4000):
        out = mixing.rounded_by_size(part, size, rng.integers(-(1 << 62), 1 << 62, 50), turn)
        open_ = (out > 0) & (out < 1)
        assert open_.sum() <= 1 and (out * size).sum() == pytest.approx((part * size).sum())
        mean += out / 4000
    assert np.abs(mean - part).max() < 0.05
