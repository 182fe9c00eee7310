from __future__ import annotations

import random
from collections import defaultdict

from llm.conftest import WORD, odd_rows

from viewgrain.llm import lines


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute(rows):
    places, own = [], {}
    for doc, text, *_ in rows:
        for n, line in enumerate((text or "").split("\n")):
            words = tuple(WORD.findall(line))
            if words:
                places.append((doc, n, words))
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    for doc, n, words in sorted(places, key=order):
        own.setdefault(words, (doc, n))
    keep = dict(own)
    for a in own:
        for b in own:
            if min(len(a), len(b)) >= lines.LEAST_WORDS and order(own[b]) < order(keep[a]) and near(a, b):
                keep[a] = own[b]
    return sorted(((d, n, *keep[w], keep[w] == (d, n)) for d, n, w in places), key=repr)


def decided(df):
    return sorted((tuple(r) for r in lines.line_decisions(df).collect()), key=repr)


def test_against_brute_force(session, odd, none):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 9)}" for _ in range(rng.randint(3, 9))] for _ in range(25)]
    rows = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(words) + 1)
            match rng.choice("ird"):
                case "i":
                    words.insert(at, f"n{rng.randint(0, 9)}")
                case "r" if at < len(words):
                    words[at] = f"r{rng.randint(0, 9)}"
                case "d" if at < len(words):
                    del words[at]
        rows.append((i, "  ".join(words) + "\n\n" + " ".join(rng.choice(base))))
    docs = session.createDataFrame(rows, "doc_id long, text string")
    assert decided(docs) == brute(rows)
    small = [r for r in odd_rows() if r[0] not in (9, 10)]
    assert decided(odd.where("doc_id IS NULL OR doc_id NOT IN (9, 10)")) == brute(small)
    assert decided(none) == []


def test_text_without_dropped_lines(session):
    rows = [(1, "a b c d e f\nsolo"), (2, "x y\na b c d e g\n\nsolo"), (3, None)]
    docs = session.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.deduplicated(docs).collect()}
    assert got == {1: "a b c d e f\nsolo", 2: "x y\n", 3: None}
    hub = defaultdict(int)
    many = session.createDataFrame([(i, f"one two three four w{i}") for i in range(300)], "doc_id long, text string")
    for r in lines.line_decisions(many).collect():
        hub[r.keep_doc_id] += 1
    assert hub == {0: 300}
