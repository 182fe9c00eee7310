"""Repair of the structure of conversations, the cheapest way, by iterative-deepening A*.

A conversation is well formed if it is empty or a system message at most, then user and
assistant in turn, the assistant last. Rows may be kept, given another role or deleted, and
empty messages inserted; every edit has a cost, and blank or repeated rows have to go. The
answer is the cheapest sequence of edits, of those the first in ASCII order.

It is found by depth-first search in ASCII order of the edits, under a bound on the cost that
rises to the least cost seen beyond it. A table keeps, for every place and state, how much it
takes at least from there on, as shown by failed searches; it outlives a rise of the bound and
serves all ways into a state. So the first accepting path is the answer.

A conversation may hold any number of rows, so it is searched in blocks of ``BLOCK`` rows: a
block gives the cheapest edits from each state before it to each state after it, and these
are chained. Equally cheap paths between the same two states never begin with one another, as
an extra insertion costs, so the first of each block make up the first of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from viewgrain.llm.common import running_totals
from viewgrain.plans.settle import settle

#: Rows searched at a time.
BLOCK = 128
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system message, after the user, after the assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ACCEPTING = (START, ASSISTANT)
#: By state, the one role other than system that may follow, and the state then.
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLES = {"u": "user", "a": "assistant"}
#: One character a row: the initial of its role (or ``x``), upper case where it is truncated;
#: ``#`` where it has to be deleted.
MUST_GO = "#"


def lower_bounds(rows: str) -> list[int]:
    """For each place, a cost that the rows from there on take at least.

    Rows that must go and truncated ones take a deletion, or more. Of the others, two in a
    row that may not follow each other need an edit, and one edit serves two such pairs.
    """
    bounds, wrong, faulty, after = [0] * (len(rows) + 1), 0, 0, None
    for i in range(len(rows) - 1, -1, -1):
        row = rows[i]
        if row == MUST_GO or row.isupper():
            faulty += 1
        else:
            wrong += after is not None and row + after not in ("su", "ua", "au")
            after = row
        bounds[i] = DELETE * faulty + (wrong + 1) // 2 * REROLE
    return bounds


class Search:
    """Searches over one block that end in the same states; they share the table of failures."""

    def __init__(self, rows: str, ends: tuple[int, ...]):
        self.rows, self.ends = rows, ends
        self.needed = [list(bounds) for bounds in zip(*[lower_bounds(rows)] * len(STATES))]

    def steps(self, at: int, state: int) -> list[tuple[str, int, int, int]]:
        """(edit, cost, place, state) from here, in ASCII order of the edits."""
        role, then = NEXT[state]
        insertion = ("I", INSERT, at, then)
        if at == len(self.rows):
            return [insertion]
        row = self.rows[at]
        out = [("D", DELETE, at + 1, state), insertion]
        if row != MUST_GO:
            extra = TRUNCATED if row.isupper() else 0
            initial = row.lower()
            if initial == role:
                out.append(("K", extra, at + 1, then))
            elif initial == "s" and state == START:
                out.append(("K", extra, at + 1, SYSTEM))
            out.append(("R", REROLE + extra, at + 1, then))
        return out

    def reachable(self, begin: int) -> bool:
        """Whether any of the ends can be reached at all; the search would not end otherwise."""
        for end in self.ends:
            if end in (USER, ASSISTANT) or end == begin:
                return True
            if end == SYSTEM and begin == START and ("s" in self.rows or "S" in self.rows):
                return True
        return False

    def run(self, begin: int) -> tuple[int, str] | None:
        """(cost, edits) of the first of the cheapest paths from ``begin``, None if there is none."""
        if not self.reachable(begin):
            return None
        while True:
            bound = self.needed[0][begin]
            edits = self._within(begin, bound)
            if edits is not None:
                return bound, edits

    def _within(self, begin: int, bound: int) -> str | None:
        """The first path that costs no more than the bound; None raises ``needed`` at the start."""
        n, needed = len(self.rows), self.needed
        if n == 0 and begin in self.ends:
            return ""
        # A frame: place, state, what is left to spend, steps to try, least need seen beyond it.
        stack = [[0, begin, bound, iter(self.steps(0, begin)), None]]
        path: list[str] = []
        while stack:
            frame = stack[-1]
            at, state, left, steps, least = frame
            for edit, cost, to, then in steps:
                done = to == n and then in self.ends
                need = cost if done else cost + needed[to][then]
                if need > left:
                    if least is None or need < least:
                        frame[4] = least = need
                    continue
                path.append(edit)
                if done:
                    return "".join(path)
                stack.append([to, then, left - cost, iter(self.steps(to, then)), None])
                break
            else:
                # All failed: from here it takes at least the least need seen.
                stack.pop()
                needed[at][state] = max(needed[at][state], frame[4])
                if stack:
                    edit = path.pop()
                    above = stack[-1]
                    spent = above[2] - left
                    need = spent + needed[at][state]
                    if above[4] is None or need < above[4]:
                        above[4] = need
        return None


def block_paths(rows: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of a block; one accepting path where it is all."""
    begins = (START,) if first else STATES
    found = []
    # The last block needs only the best end of each state before it.
    for ends in [ACCEPTING] if last else [(s,) for s in STATES]:
        search = Search(rows, ends)
        for begin in begins:
            best = search.run(begin)
            if best is not None:
                found.append((begin, -1 if last else ends[0], *best))
    return found


def repaired(lines: list[tuple[str, str]], state: int, edits: str) -> tuple[list[str], int]:
    """The messages (``role:text``) after the edits, and the state they lead to."""
    out, rows = [], iter(lines)
    for edit in edits:
        if edit == "D":
            next(rows)
            continue
        role, then = NEXT[state]
        if edit == "I":
            out.append(f"{ROLES[role]}:")
        elif edit == "R":
            out.append(f"{ROLES[role]}:{next(rows)[1]}")
        else:
            kept, text = next(rows)
            if kept[:1] == "s":
                then = SYSTEM
            out.append(f"{kept}:{text}")
        state = then
    return out, state


# --- on Spark -----------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(``conv_id:turn``) % 20 decides.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes the user
    its author. A NULL id, turn, role or text reads as one space; id and turn stay NULL.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", said("role").alias("role"), said("text").alias("text"),
        F.pmod(F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "UTF-8")), F.lit(20)).alias("hit"),
    ).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """The rows with their place in the conversation, block and fault, settled.

    They come by turn, NULL first; rows of one turn by role, text and copy. Blank rows hold
    white space only, duplicates repeat an earlier row's role and text, truncated ones do not
    end in ``.!?``.
    """
    numbered = running_totals(rows, ["conv_id"], ["turn", "role", "text", "copy"], {"place": F.lit(1)})
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    # Equal role and text by a digest, so that long texts are not keys of a join.
    said = F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"), 256)
    marked = settle(numbered.drop("copy").withColumns({"said": said, "end": end}))
    earliest = settle(
        marked.groupBy(F.col("conv_id").alias("__conv"), F.col("said").alias("__said")).agg(F.min("place").alias("__first"))
    )
    joined = marked.join(earliest, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("said") == F.col("__said")))
    fault = (
        F.when(F.col("end") == "", "blank")
        .when(F.col("place") > F.col("__first"), "duplicate")
        .when(~F.col("end").isin(".", "!", "?"), "truncated")
    )
    block = F.floor(F.col("place") / BLOCK)
    return settle(joined.select("conv_id", "turn", "place", block.alias("block"), "role", "text", fault.alias("fault")))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of equal leading ``keys`` columns, which the batches hold side by side."""
    current, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != current:
                if rows:
                    yield current, rows
                current, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield current, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _side_by_side(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of a key in one partition, one after another, in order."""
    return frame.repartition(*keys).sortWithinPartitions(*keys, *order)


def _key_type(frame: DataFrame) -> tuple[str, pa.DataType]:
    kind = frame.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, block, paths: the cheapest edits of every block, between states before and after it."""
    kind, arrow = _key_type(rows)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    sign = (
        F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO)
        .when(F.col("fault") == "truncated", F.upper(letter))
        .otherwise(letter)
    )
    ends = settle(rows.groupBy(F.col("conv_id").alias("__conv")).agg(F.max("block").alias("last")))
    signed = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("__conv")))
    path = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    schema = pa.schema([("conv_id", arrow), ("block", pa.int64()), ("paths", pa.list_(path))])

    def run(batches):
        def found():
            for (conv, block), group in _groups(batches, 2):
                signs = "".join(sign for _, sign, _ in group)
                held = block_paths(signs, block == 0, block == group[0][2])
                yield conv, block, [dict(zip(("before", "after", "cost", "edits"), p)) for p in held]

        yield from _batches(found(), schema)

    ready = _side_by_side(signed.select("conv_id", "block", "place", sign.alias("sign"), "last"), ["conv_id", "block"], ["place"])
    return ready.mapInArrow(run, f"conv_id {kind}, block long, paths array<struct<before:int,after:int,cost:long,edits:string>>")


def chained(found: DataFrame) -> DataFrame:
    """conv_id, block, before, edits, cost: the path of each block in the answer, and its cost.

    The blocks of a conversation meet here, a row each with their edits, which make up the
    answer anyway. From the last block back, each state is given what is left to pay.
    """
    kind, arrow = _key_type(found)
    schema = pa.schema([("conv_id", arrow), ("block", pa.int64()), ("before", pa.int32()), ("edits", pa.string()), ("cost", pa.int64())])

    def choose(blocks: list[tuple[int, list[dict]]]) -> list[tuple[int, int, str, int]]:
        rest: dict[int, tuple] = {-1: (0, "", None)}  # state -> cost, edits from here on, (path, next state)
        chain: list[dict[int, tuple]] = []
        for _, held in reversed(blocks):
            best: dict[int, tuple] = {}
            for p in held:
                if p["after"] in rest:
                    cost, edits, _ = rest[p["after"]]
                    new = (p["cost"] + cost, p["edits"] + edits)
                    if p["before"] not in best or new < best[p["before"]][:2]:
                        best[p["before"]] = (*new, p)
            chain.append(best)
            rest = best
        state, out = START, []
        for (block, _), best in zip(blocks, reversed(chain)):
            p = best[state][2]
            out.append((block, state, p["edits"], p["cost"]))
            state = p["after"]
        return out

    def run(batches):
        rows = ((conv, *row) for (conv,), group in _groups(batches, 1) for row in choose(group))
        yield from _batches(rows, schema)

    ready = _side_by_side(found, ["conv_id"], ["block"])
    return ready.mapInArrow(run, f"conv_id {kind}, block long, before int, edits string, cost long")


def repaired_blocks(rows: DataFrame, answer: DataFrame) -> DataFrame:
    """conv_id, block, messages, lines: the repaired messages of each block, newline-joined, and how many."""
    kind, arrow = _key_type(rows)
    renamed = answer.select(F.col("conv_id").alias("__conv"), F.col("block").alias("__block"), "before", "edits")
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("block") == F.col("__block"))
    # The rows of a block share a key with one row of the answer only: no row is multiplied.
    joined = rows.join(renamed, same).select("conv_id", "block", "place", "role", "text", "before", "edits")
    schema = pa.schema([("conv_id", arrow), ("block", pa.int64()), ("messages", pa.string()), ("lines", pa.int64())])

    def run(batches):
        def found():
            for (conv, block), group in _groups(batches, 2):
                _, _, _, before, edits = group[0]
                out, _ = repaired([(role, text) for _, role, text, _, _ in group], before, edits)
                yield conv, block, "\n".join(out), len(out)

        yield from _batches(found(), schema, 100)

    ready = _side_by_side(joined, ["conv_id", "block"], ["place"])
    return ready.mapInArrow(run, f"conv_id {kind}, block long, messages string, lines long")


def hashed(blocks: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the messages of all blocks, newline-joined, read as a stream."""
    kind, arrow = _key_type(blocks)
    schema = pa.schema([("conv_id", arrow), ("repaired_sha256", pa.string())])

    def run(batches):
        def found():
            current, digest, empty = None, None, True
            for batch in batches:
                for conv, messages, lines in zip(*(batch.column(c) for c in ("conv_id", "messages", "lines"))):
                    conv = conv.as_py()
                    if digest is None or conv != current:
                        if digest is not None:
                            yield current, digest.hexdigest()
                        current, digest, empty = conv, hashlib.sha256(), True
                    if lines.as_py():
                        if not empty:
                            digest.update(b"\n")
                        digest.update(messages.as_buffer())
                        empty = False
            if digest is not None:
                yield current, digest.hexdigest()

        yield from _batches(found(), schema)

    ready = _side_by_side(blocks, ["conv_id"], ["block"])
    return ready.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def _illegal(rows: DataFrame) -> tuple[Column, DataFrame]:
    """Whether a row's role may not follow the one before it, and the rows with that one's initial."""
    before = rows.select(F.col("conv_id").alias("__conv"), (F.col("place") + 1).alias("__place"), F.substring("role", 1, 1).alias("__before"))
    joined = rows.join(before, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("place") == F.col("__place")), "left")
    pair = F.concat("__before", F.substring("role", 1, 1))
    return F.col("__before").isNotNull() & ~pair.isin("su", "ua", "au"), joined


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per conv_id: its faults, and the cheapest repair.

    ``rows`` (conv_id, turn, role, text, copy) are the damaged rows, by default ``damaged`` of
    the conversations. gaps counts the turns missing between the first and the last one,
    illegal the neighbours whose roles may not follow each other; blank, duplicate and
    truncated count rows by their first fault; audit has the initial of every edit (Delete,
    Insert, Keep, Rerole), cost their sum, repaired_sha256 the messages that result. All rows
    with a NULL conv_id are one conversation; a conversation of which no row is left counts
    zero and is empty. Rows that repeat are duplicates of the first. An empty table gives an
    empty one; other columns are not read.
    """
    ready = placed(damaged(conversations) if rows is None else rows)
    answer = settle(chained(settle(paths(ready))))
    hashes = hashed(settle(repaired_blocks(ready, answer)))
    wrong, beside = _illegal(ready)
    turns = ready.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    faults = beside.groupBy("conv_id").agg(
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], F.count_if(wrong).alias("illegal")
    )
    edits = F.array_sort(F.collect_list(F.struct("block", "edits")))  # a letter per row: the audit itself
    audits = answer.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(edits, lambda b: b["edits"]), "").alias("audit"))
    result = conversations.select("conv_id").distinct()
    for part in (turns, faults, audits, hashes):
        other = settle(part.withColumnRenamed("conv_id", "__conv"))
        result = result.join(other, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return result.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
