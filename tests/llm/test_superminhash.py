"""SuperMinHash near-duplicates against all pairs of full sets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from llm.conftest import TEXTS, WORD

from viewgrain.llm import superminhash
from viewgrain.llm.superminhash import near_duplicates, shingle_set, signatures


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if 0 < len(words) < 3:
        return frozenset([" ".join(words)])
    return frozenset(" ".join(words[i : i + 3]) for i in range(len(words) - 2))


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = [x for x in (least.get(find(i)), doc) if x is not None]
        least[find(i)] = min(known) if known else None
    return sorted(
        ((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr
    )


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def altered(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"z{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    """A group of near copies around the limit, chains, a shared passage, short texts and clean ones."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    base, passage = text(150), " ".join(text(60))
    rows = [altered(base, rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 12]), rng) for _ in range(130)]
    chain = text(120)
    for _ in range(12):
        chain = altered(chain, 2, rng).split()
        rows.append(" ".join(chain))
    rows += [passage + " " + " ".join(text(rng.randrange(5, 60))) for _ in range(60)]
    rows += [" ".join(text(rng.randrange(3, 12))) for _ in range(40)] + [" ".join(text(80)) for _ in range(40)]
    rows += ["One", "one", "Two words", "two  WORDS", "", None, " \n"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_all_pairs(session, corpus):
    df = session.createDataFrame(corpus, "doc_id long, text string").repartition(7)
    assert result(near_duplicates(df)) == brute(corpus)


def test_rare_shingles_lose_no_link(session, corpus):
    """Every link between components, for components that are single nodes."""
    sets = [(i, shingle_set((t or "").encode())) for i, t in corpus]
    frame = [(i, len(s), i, s.tobytes()) for i, s in sets if len(s)]
    pairs = superminhash.rare_shingle_pairs(session.createDataFrame(frame, "node long, size long, component long, shingles binary"))
    named = {(r.a, r.b) for r in pairs.collect()}
    held = [(i, set(s.tolist())) for i, s in sets if len(s)]
    links = {(a, b) for a, x in held for b, y in held if a < b and 100 * len(x & y) >= 85 * len(x | y)}
    # Equal sets are one class in use; here they may be paired either way.
    assert links <= named and len(named) < len(held) ** 2 / 4


def test_odd_rows(session, odd):
    data = [(r.doc_id, r.text) for r in odd.collect()]
    got, want = result(near_duplicates(odd)), brute(data)
    # A NULL doc_id is kept only where its component has no other.
    assert got == want and (None, 2, 4, False) in got


def test_null_ids_alone_and_empty_table(session, none):
    alone = session.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert result(near_duplicates(alone)) == [(None, 0, None, True), (None, 2, None, True), (None, 2, None, True)]
    assert result(near_duplicates(none)) == []


def plain_signature(elements, places):
    """One element at a time, with its whole permutation."""
    out = [1 << 64] * places
    for e in elements:
        order = list(range(places))
        for rank in range(places):
            drawn = int(superminhash._random(np.array([e], np.uint64), rank)[0])
            swap = rank + drawn % (places - rank)
            order[rank], order[swap] = order[swap], order[rank]
            out[order[rank]] = min(out[order[rank]], (rank << 40) | (drawn >> 24))
    return out


def test_early_stop_changes_nothing():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 7, 40, 400)]
    got = signatures(np.concatenate(sets), np.array([len(s) for s in sets]), 24)
    assert got.tolist() == [plain_signature(s, 24) for s in sets]


def test_signatures_estimate_with_less_variance():
    """The share of equal places is the similarity, closer to it than independent hashes are."""
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        a, b = both[:50], both[10:]  # 40 of 60
        x, y = signatures(np.concatenate([a, b]), np.array([50, 50]))
        errors.append((x == y).mean() - 40 / 60)
    independent = (2 / 3 * 1 / 3 / superminhash.PLACES) ** 0.5
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.85 * independent


def test_long_text_in_parts_is_the_same_set(monkeypatch):
    text = TEXTS[9].encode()
    whole = shingle_set(text)
    monkeypatch.setattr(superminhash, "WORDS_AT_ONCE", 1000)
    assert np.array_equal(shingle_set(text), whole) and len(whole) == len(shingles(TEXTS[9]))


def test_columns_of_other_names(session):
    df = session.createDataFrame([(3, "a b c", 1, 2), (2, "A b  c", 1, 2)], "`my id` int, body string, node int, token int")
    assert result(near_duplicates(df, "my id", "body")) == [(2, 1, 2, True), (3, 1, 2, False)]
