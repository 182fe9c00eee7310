from __future__ import annotations

import random
import time

from viewgrain.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, position int, depth string"


def run(session, rows):
    frame = session.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)
    out = chat.conversations(frame)
    return {(r.conv_id, r.position): r for r in out.collect()}


def test_quotes_are_linked_and_removed(session):
    rows = [
        (1, 0, "user", "First question here.\nWith a second line."),
        (1, 1, "user", "Another topic altogether."),
        (1, 2, "assistant", "> first   QUESTION here.\n> With a second line.\n\nAn answer."),
        (1, 3, "user", "> > First question here.\n>> With a second line.\n> An answer.\nThanks!"),
        (1, 4, "user", "On Monday someone wrote:\n> Another topic altogether.\nAgreed."),
        (2, 0, "user", "> Never said anywhere.\nHello."),
        (2, 1, "user", "> Another topic altogether.\nFrom elsewhere."),
    ]
    got = run(session, rows)
    one = [got[1, i] for i in range(5)]
    assert [r.turn for r in one] == [0, 2, 3, 1, 4]
    assert [r.text for r in one][1:] == ["An answer.", "Thanks!", "Another topic altogether.", "Agreed."]
    assert [(r.reply_turn, r.depth) for r in one] == [(None, 0), (0, 1), (2, 2), (None, 0), (1, 1)]
    assert one[2].n_quotes == 2 and one[1].message == "<|assistant|>\nAn answer."
    assert [(got[2, i].text, got[2, i].reply_conv_id, got[2, i].depth) for i in (0, 1)] == [
        ("Hello.", None, 0),
        ("From elsewhere.", 1, 0),
    ]


def test_long_chains_shared_passages_and_odd_rows(session):
    chain = [(3, i, "user", (f"> line {i - 1} of the chain\n" if i else "") + f"line {i} of the chain") for i in range(20)]
    shared = [(4, i, "user", ("> the same words\n" if i else "") + "the same words") for i in range(200)]
    odd = [(None, None, None, None), (None, None, None, None), (5, None, "user", ""), (5, 0, "user", "x" * 5000)]
    got = run(session, chain + shared + odd)
    assert [got[3, i].depth for i in range(20)] == list(range(20))
    assert all(got[4, i].reply_turn == 0 and got[4, i].turn == i for i in range(1, 200))
    assert [got[None, i].role for i in (0, 1)] == ["user", "user"] and got[5, 0].turn is None
    assert len(got) == 224
    assert chat.conversations(session.createDataFrame([], SCHEMA)).count() == 0


def test_parts_of_a_message_are_linked(session):
    five = "One apple here.\nTwo pears there.\nThree plums.\nFour figs.\nFive nuts."
    rows = [
        (6, 0, "user", "Hello,\nunrelated words."),
        (6, 1, "user", "Hello,\n" + five),
        (6, 2, "user", "First paragraph line a.\nFirst paragraph line b.\n\nSecond paragraph line a,\nwrapped in two."),
        (6, 3, "user", "> Two pears there.\n> Three plums.\nTwo of five lines."),
        (6, 4, "user", "> Hello,\n> One apple here.\nMost lines, not the first."),
        (6, 5, "user", "> Second paragraph line a, wrapped\n> in two.\nA paragraph."),
        (6, 6, "user", "> First paragraph line b.\n> [...]\n> Second paragraph line a,\nWith a cut."),
        (6, 7, "user", "> Never heard.\n>\n> Second paragraph line a, wrapped\n> in two.\nOne of two."),
    ]
    got = {r.turn: r.reply_turn for (conv, _), r in run(session, rows).items()}
    assert got == {0: None, 1: None, 2: None, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2}


def test_another_conversation_is_found_past_the_own(session):
    rows = [
        (1, 0, "user", "> Said by both.\nQuoted before it was said here."),
        (1, 1, "user", "Said by both."),
        (2, 4, "user", "Said by both."),
        (3, 7, "user", "Said by both."),
    ]
    got = run(session, rows)
    assert {(r.turn, r.reply_conv_id, r.reply_turn) for (conv, _), r in got.items() if conv == 1} == {(0, 2, 4), (1, None, None)}


def even(lines):
    return " ".join(" ".join(lines).lower().split())


def brute(messages):
    """{(conv, turn): (conv, turn) of its original} of messages (conv, turn, quoted lines, own lines)."""

    def paragraphs(lines):
        out = [[]]
        for line in lines:
            out = out + [[]] if not line else out[:-1] + [[*out[-1], line]]
        return [p for p in out if p]

    def pieces(lines):
        said = [line for line in lines if line]
        covers = frozenset(even([line]) for line in said)
        yield even(said), covers
        for p in paragraphs(lines):
            yield even(p), frozenset(even([line]) for line in p)
        for pair in zip(said, said[1:]):
            yield even(pair), frozenset()
        for line in said:
            yield even([line]), frozenset()

    keys = {(conv, turn): {key for key, _ in pieces(own)} for conv, turn, _, own in messages}
    own_lines = {(conv, turn): {even([line]) for line in own if line} for conv, turn, _, own in messages}
    found = {}
    for conv, turn, quoted, _ in messages:
        covered = {}
        for key, covers in pieces(quoted) if quoted else ():
            near = min((m for m in keys if m[0] == conv and key in keys[m]), default=None)
            away = min((m for m in keys if m[0] != conv and key in keys[m]), default=None)
            for m in [m for m in (near if near and near[1] < turn else None, away) if m]:
                covered.setdefault(m, set()).update(covers)
        lines = {even([line]) for line in quoted if line}
        rank = lambda m: (-len(covered[m] | (lines & own_lines[m])), m[0] != conv, m)
        found[conv, turn] = min(covered, key=rank, default=None)
    return found


def test_originals_against_brute_force(session):
    rng = random.Random(5)
    pool = [f"Line {i} of the pool" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]  # said by one message up to nearly all
    messages = []
    for conv in range(12):
        for turn in range(20):
            own = rng.choices(pool, weights, k=rng.randint(1, 6))
            if len(own) > 3 and rng.random() < 0.5:
                own.insert(2, "")
            quoted = []
            if messages and rng.random() < 0.6:
                source = rng.choice(messages)[3]
                at = rng.randrange(len(source))
                quoted = source[at : at + rng.randint(1, 4)]
                quoted = quoted[1:] if not quoted[0] else quoted
                quoted = quoted[:-1] if quoted and not quoted[-1] else quoted
                if rng.random() < 0.3:
                    quoted = [*quoted, rng.choice(pool)]
            messages.append((conv, turn, quoted, own))
    rows = [(c, t, "user", "\n".join([*("> " + line.upper() for line in q), *o])) for c, t, q, o in messages]
    want = brute(messages)
    got = {(c, r.turn): (r.reply_conv_id, r.reply_turn) for (c, _), r in run(session, rows).items()}
    assert {m: (None, None) if o is None else o for m, o in want.items()} == got
    assert sum(o is not None for o in want.values()) > 60


def test_a_piece_that_many_say_hides_no_original(session):
    rows = [(1, i, "user", ("One line.", "Another line.")[i % 2]) for i in range(20)]
    rows += [(1, 20, "user", "One line.\nAnother line."), (1, 21, "user", "> One line.\n> Another line.\nYes.")]
    assert run(session, rows)[1, 21].reply_turn == 20


def test_very_long_messages_end(session):
    long = "\n".join(f"line {i} of a long message" for i in range(100_000))
    quote = "\n".join(f"> {line}" for line in long.split("\n"))
    began = time.monotonic()
    got = run(session, [(1, 0, "user", long), (1, 1, "user", quote + "\nAnswer."), (1, 2, "user", "\n".join(["> a", "b"] * 20_000))])
    assert got[1, 1].reply_turn == 0 and got[1, 1].text == "Answer." and got[1, 2].n_quotes == 20_000
    assert time.monotonic() - began < 120
