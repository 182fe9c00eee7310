from __future__ import annotations

import itertools
import random
import re
import time

import numpy as np
from llm.conftest import odd_rows
from pyspark.sql import functions as F

from viewgrain.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")

LINES = [
    f"call me at +1 ({200 + i}) 555-{1000 + i} or write to ab{i}.c@mail.example.com from 10.{i}.3.{i + 4} today" for i in range(30)
] + [f"pay with 4111111111111111 before {i} June" for i in range(15)] + [f"chapter {i} has {i * 3} pages, version 2.0." for i in range(20)]


def spans_of(text):
    return [(text[a:b], k) for a, b, k in pii.base_spans(text)]


def test_base_spans():
    text = "x a.b+c@d-e.co.uk, 1.2.3.4.5 999.1.1.1 or 4111 1111 1111 1111 +49 (30) 1234-5678 +12 @x.y a@b"
    assert spans_of(text) == [
        ("a.b+c@d-e.co.uk", "email"), ("1.2.3.4", "ip"), ("4111 1111 1111 1111", "card"), ("+49 (30) 1234-5678", "phone"),
    ]
    assert pii.base_spans("") == [] and spans_of("000.0001.2.0255") == [("000.0001.2.0255", "ip")]


def test_linear_searches_match_the_patterns():
    for parts in itertools.product(["a", "1", ".", "@", "@a.b", "12.3", "-"], repeat=5):
        text = "".join(parts)
        assert list(pii.emails(text)) == [m.span() for m in EMAIL.finditer(text)], text
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in IP.finditer(text)], text
    long = "a" * 200_000 + "@" + "1" * 200_000
    assert pii.base_spans(long) == []


def model():
    table = []
    for line in LINES:
        for other, spans in pii.variants(line, pii.base_spans(line)):
            table += pii._windows(*pii.label_words(other, spans))
    return pii.train(table), table


def test_viterbi_is_the_best_path_and_the_shortcut_loses_none():
    rng = np.random.default_rng(0)
    k = len(pii.LABELS)
    moves = pii._moves_allowed(rng.normal(size=(k, k)))
    emit = rng.normal(size=(3, 4, k))
    lengths = np.array([4, 2, 3])
    got = pii.viterbi(emit, lengths, moves)
    for i, n in enumerate(lengths):
        def score(path, i=i):
            return sum(emit[i, t, a] for t, a in enumerate(path)) + pii._START_FORBIDDEN[path[0]] + sum(
                moves[a, b] for a, b in zip(path, path[1:])
            )
        assert tuple(got[i, :n]) == max(itertools.product(range(k), repeat=int(n)), key=score)


def test_held_out_lines_are_labelled_right():
    field, table = model()
    decoder = pii.Decoder(field)
    assert all(list(g) == w for g, (_, w) in zip(decoder.labels([words for words, _ in table]), table))
    held = ["or +1 (777) 555-9999 4111111111111111 then", "just plain words and 12 of them", "ring 626-555-1234 now please"]
    base, added = zip(*pii.all_spans(held, decoder))
    assert base[1] == [] and added[1] == [] and base[2] == []
    assert {(held[0][a:b], k) for a, b, k in added[0]} == {("+1 (777) 555-9999", "phone"), ("4111111111111111", "card")}
    # The whole-line bound that skips decoding changes nothing.
    many = [pii.WORD.findall(line) for line in LINES + held]
    plain = pii.Decoder(field)
    flat = plain.ids([w for m in many for w in m])
    at = 0
    for words, got in zip(many, decoder.labels(many)):
        score = plain.table[flat[at : at + len(words)]]
        at += len(words)
        emit = score[:, 1].copy()
        emit[:-1] += score[1:, 0]
        emit[1:] += score[:-1, 2]
        assert list(pii.viterbi(emit[None], np.array([len(words)]), plain.moves)[0]) == list(got)


def test_documents(session, odd, none):
    field, _ = model()
    rows = pii.personal_data(odd, field).collect()
    assert len(rows) == len(odd_rows())
    assert all([(s["start"], s["end"], s["kind"]) for s in r.base] == [] for r in rows if r.doc_id == 1)
    assert pii.personal_data(none, field).count() == 0
    docs = session.createDataFrame([(1, "ä +1 (222) 555-1000\nmail a@b.co")], "doc_id long, text string")
    got = pii.personal_data(docs, field).select(pii.joined(F.concat("base", "added")).alias("s")).first().s
    assert got == "phone:2:19,email:25:31"
    learned = pii.train(pii.labelled(session.createDataFrame([(i, x) for i, x in enumerate(LINES)], "doc_id long, text string")))
    assert len(learned.index) > 10
    assert pii.train(pii.labelled(none)).weights.shape[0] == 1


def test_long_lines_are_decoded_as_one_chain():
    field, _ = model()
    decoder = pii.Decoder(field)
    rng = random.Random(9)
    pool = ["call", "me", "at", "+1", "(777)", "555-9999", "4111111111111111", "626-555-1234", "from", "10.1.2.3", "a@b.co", "12", "x" * 70 + "9@b.co"]
    lines = [rng.choices(pool, [rng.random() ** 3 for _ in pool], k=rng.choice([1, 3, 40, 700])) for _ in range(60)] + [[]]
    for words, got in zip(lines, decoder.labels(lines)):
        if not words:
            assert len(got) == 0
            continue
        score = decoder.table[decoder.ids(words)]
        emit = score[:, 1].copy()
        emit[:-1] += score[1:, 0]
        emit[1:] += score[:-1, 2]
        assert list(pii.viterbi(emit[None], np.array([len(words)]), decoder.moves)[0]) == list(got)


def test_added_spans_meet_no_other():
    rng = random.Random(4)
    for _ in range(300):
        base = sorted((a, a + rng.randint(1, 30), "ip") for a in (rng.randint(0, 80) for _ in range(rng.randint(0, 6))))
        taken = pii._Taken(base)
        for start in range(90):
            end = start + rng.randint(1, 9)
            assert taken.meets(start, end) == any(a < end and start < b for a, b, _ in base)


def test_very_many_spans_in_one_text_take_linear_time():
    decoder = pii.Decoder(model()[0])
    text = "\n".join(["or +1 (222) 555-1000 then", "or 4111111111111111 then"] * 50_000) + "\n" + "10.1.2.3 a@b.co so " * 50_000
    began = time.monotonic()
    ((base, added),) = pii.all_spans([text], decoder)
    assert len(base) >= 200_000 and time.monotonic() - began < 120


def test_long_lines_train_too(session):
    words = "plain words all the way "
    rows = [(i, words * 60 + line + " " + words * 60) for i, line in enumerate(LINES)]
    table = pii.labelled(session.createDataFrame(rows, "doc_id long, text string"))
    assert sum(any(labels) for _, labels in table) >= 30
