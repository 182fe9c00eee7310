"""Ranked lexical search against a plain scoring of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from viewgrain.llm import lexical
from viewgrain.llm.lexical import search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=20):
    """(item_id, rank, doc_id, score) of (doc_id, text) and (item_id, text)."""
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n_docs, length = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in bags:
            m = 75 + (25 * sum(c.values()) * n_docs) // length
            score = 0
            for t in words(text):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(found)[:best], 1):
            out.append((item, rank, d, -score))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    names = [f"w{i}" for i in range(60)] + ["été", "日本", "x9"]
    docs = [(i, rng.choice(" -.\n").join(rng.choices(names, weights=range(63, 0, -1), k=rng.randrange(1, 30)))) for i in range(300)]
    docs += [(1000 + i, "W1, w2! the same bag " + "other" * (i % 3)) for i in range(80)]
    docs += [(5, "w1 repeated id"), (None, "w1 w1 w1"), (2000, None), (2001, ""), (2002, "?!"), (2003, "w0 " * 5000)]
    items = [(i, " ".join(rng.choices(names, k=rng.randrange(1, 12)))) for i in range(15)]
    items += [(100, None), (101, "..."), (102, "nowhere"), (103, "w1 w1 W1 w2"), (3, "w1"), (None, "ÉTÉ été x9")]
    rng.shuffle(docs)
    return docs, items


def frames(session, corpus):
    docs, items = corpus
    return (
        session.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, terms string").repartition(6),
        session.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, block int"),
    )


def test_equals_brute_force(session, corpus):
    assert result(search(*frames(session, corpus))) == brute(*corpus)


def test_small_blocks_and_steps_change_nothing(session, corpus, monkeypatch):
    for name, value in (("BLOCK_TERMS", 9), ("BLOCK_ITEMS", 4), ("SCORES_AT_ONCE", 40), ("PRODUCTS_AT_ONCE", 3)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus
    some = (docs, items[:6] + items[-4:])
    assert result(search(*frames(session, some), best=3)) == brute(*some, best=3)


def test_a_class_is_scored_once_and_expanded_by_doc_id(session):
    docs = [(i, f"red fish other{i}") for i in range(200, 100, -1)] + [(1, "blue fish here")]
    got = result(search(*frames(session, (docs, [(1, "red")]))))
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(101, 121))


def test_empty_tables(session, corpus, none):
    docs, items = frames(session, corpus)
    assert result(search(docs, items.limit(0))) == []
    assert result(search(none, items)) == []
    assert result(search(docs, items.where("text is null"))) == []


def test_terms():
    for text in ("A-b_C9é日 本\x00z", "", "''", "ÀB", "Ünï\x7fcode x"):
        assert [t.decode() for t in terms(text.encode())] == words(text)
