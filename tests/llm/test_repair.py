"""Conversation repair: the search against cheapest-first search, the whole against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import time
import zlib

import pytest

from viewgrain.llm import repair as module
from viewgrain.llm.repair import ACCEPTING, START, Search, repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit) over role initials, by order of (cost, audit): rows are (role, fault)."""

    def legal_start(roles):
        return re.match(r"(s?(ua)*u?)?\Z", roles) is not None

    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(rows) and LEGAL.match(roles):
            return cost, audit
        key = (at, roles[-1:])
        if key in seen:
            continue
        seen.add(key)
        for role in "ua":
            if legal_start(roles + role):
                heapq.heappush(heap, (cost + 5, audit + "I", at, roles + role))
        if at == len(rows):
            continue
        role, fault = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles))
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            if role[:1] in ("s", "u", "a") and legal_start(roles + role[0]):
                heapq.heappush(heap, (cost + extra, audit + "K", at + 1, roles + role[0]))
            for new in "ua":
                if legal_start(roles + new):
                    heapq.heappush(heap, (cost + 1 + extra, audit + "R", at + 1, roles + new))


def plain(data):
    """Expected rows of (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in data:
        rows = convs.setdefault(conv, [])
        said = lambda v: " " if v is None else str(v)
        hit = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        rows += [(turn is not None, turn or 0, role, text, turn)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: r[:4])
        turns = [r[4] for r in rows if r[4] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, _, role, text, _ in rows:
            end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
            seen.add((role, text))
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
        cost, audit = cheapest([(r[2], f) for r, f in zip(rows, faults)])
        lines, at, last = [], 0, ""
        for edit in audit:
            turn_of = "a" if last == "u" else "u"
            if edit == "I":
                lines.append({"u": "user", "a": "assistant"}[turn_of] + ":")
                last = turn_of
                continue
            _, _, role, text, _ = rows[at]
            at += 1
            if edit == "K":
                lines.append(f"{role}:{text}")
                last = role[0]
            if edit == "R":
                lines.append({"u": "user", "a": "assistant"}[turn_of] + ":" + text)
                last = turn_of
        out.append(
            (conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
             sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        )
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def talk(rng, conv, n, odd=True):
    rows, role = [], "user"
    if rng.random() < 0.4:
        rows.append((conv, 0, "system", "Be kind."))
    for turn in range(1, n):
        text = f"Line {rng.randrange(40)}." + rng.choice(["", "", "", " \n", " more", "\nNext!"])
        if odd and rng.random() < 0.15:
            text = rng.choice([None, "", " \t", "no end", "é", "?"])
        given = rng.choice([None, "system", "tool", "", "User", "assistant", "user"]) if odd and rng.random() < 0.1 else role
        rows.append((conv, None if odd and rng.random() < 0.05 else turn, given, text))
        role = "assistant" if role == "user" else "user"
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, place int, block string, said int"


def frame(session, data):
    return session.createDataFrame([(*r, 1, "x", 2) for r in data], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    rows = [r for conv in range(60) for r in talk(rng, conv, rng.randrange(1, 12))]
    rows += [r for r in talk(rng, None, 9)] + rows[:7]
    return rows


def test_equals_plain_python(session, data):
    assert result(repair(frame(session, data))) == plain(data)


def test_blocks_change_nothing(session, data, monkeypatch):
    more = data[:60] + talk(random.Random(3), 999, 150)
    monkeypatch.setattr(module, "BLOCK", 3)
    assert result(repair(frame(session, more))) == plain(more)


def test_empty_table_and_conversations_without_a_row_left(session):
    assert result(repair(frame(session, []))) == []
    turns = [t for t in range(400) if zlib.crc32(f"7:{t}".encode()) % 20 == 0][:3]
    gone = [(7, t, "user", "Hello.") for t in turns]
    assert result(repair(frame(session, gone))) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_very_long_text(session):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "long text. " * 200_000) for t in range(4)]
    assert result(repair(frame(session, rows))) == plain(rows)


def test_search_finds_the_first_of_the_cheapest():
    rng = random.Random(4)
    signs = {"s": ("system", None), "u": ("user", None), "a": ("assistant", None), "x": ("tool", None), "#": ("user", "blank")}
    signs |= {k.upper(): (v[0], "truncated") for k, v in signs.items() if k != "#"}
    for _ in range(2000):
        rows = "".join(rng.choice("suauauaxSUAX#") for _ in range(rng.randrange(0, 11)))
        assert Search(rows, ACCEPTING).run(START) == cheapest([signs[r] for r in rows]), rows


def test_a_block_of_the_worst_kind_ends():
    rng, start = random.Random(1), time.time()
    for signs in ("ua", "u", "uaUA#sx"):
        module.block_paths("".join(rng.choice(signs) for _ in range(module.BLOCK)), False, False)
    assert time.time() - start < 20
