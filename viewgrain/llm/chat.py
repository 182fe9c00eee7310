"""Conversations without quotations, ordered by what replies to what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewgrain.llm.common import SPACE, running_totals, text_of, with_row_key
from viewgrain.llm.quality import let
from viewgrain.plans.settle import settle

#: Quote marks at the start of a line: each ``>`` is one level, with spaces between or not.
QUOTE = r"^[ \t]*((?:>[ \t]?)+)"
#: A line that announces a quotation, dropped together with it.
ANNOUNCES = r"(?i)^[ \t]*(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,80}|le\b.{0,200}a écrit|el\b.{0,200}escribió)[ \t]*:[ \t]*$"
#: Rounds of pointer doubling that cover any chain of replies (2 to this power).
MOST_ROUNDS = 40


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 1), "[^>]", ""))


def unquoted(line: Column) -> Column:
    return F.regexp_replace(line, QUOTE, "")


def _even(lines: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.array_join(lines, " "), f"{SPACE}+", " ")))


def passage_hash(lines: Column) -> Column:
    """A passage's key: lower case, white space and line breaks evened out.

    Written as hex digits, as an array of strings is made distinct by hash, one of bytes by
    comparing all of it.
    """
    return F.md5(_even(lines))


def _said(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.regexp_like(x, F.lit(f"[^{SPACE[1:-1]}]")))


def line_hashes(lines: Column) -> Column:
    """Numbers of the different lines with a word."""
    return F.array_distinct(F.transform(_said(lines), lambda x: F.xxhash64(_even(F.array(x)))))


def paragraphs(lines: Column) -> Column:
    """The lines of each paragraph of a run, of those a run has where a line without a word stood."""
    return F.transform(F.split(F.array_join(lines, "\n"), "\n\n"), lambda p: F.split(p, "\n"))


def pairs(lines: Column) -> Column:
    """Two lines in a row, past lines without a word."""
    said = _said(lines)
    return F.zip_with(said, F.slice(said, 2, F.greatest(F.size(said), F.lit(1))), lambda a, b: F.array(a, b))


def pieces(lines: Column) -> Column:
    """(key, covers) of what of a quoted run may be said elsewhere: all of it, its paragraphs,
    two lines in a row and single lines. ``covers`` are the lines a wrapped text stands for,
    where they cannot be compared one by one."""
    none = F.array().cast("array<bigint>")
    whole = lambda x: F.struct(passage_hash(x).alias("key"), line_hashes(x).alias("covers"))
    part = lambda x: F.struct(passage_hash(x).alias("key"), none.alias("covers"))
    joined = F.filter(pairs(lines), lambda x: x[1].isNotNull())
    return F.concat(
        F.array(whole(lines)),
        F.transform(paragraphs(lines), whole),
        F.transform(joined, part),
        F.transform(_said(lines), lambda x: part(F.array(x))),
    )


def _passages(lines: Column) -> Column:
    """Runs of lines of one level: (level, from, lines); lines without a word end none.

    Between two lines of a run, lines without a word are left as one empty line.
    """

    def placed(line: Column, i: Column) -> Column:
        blank = F.trim(F.regexp_replace(line, "[>\\s]", "")) == ""
        return F.struct(i.alias("i"), level(line).alias("level"), unquoted(line).alias("text"), blank.alias("blank"))

    def runs(said: Column) -> Column:
        """Where the level changes a run begins; its lines are a slice, so no list grows line by line."""
        begins = F.filter(F.transform(said, lambda x, k: k), lambda k: (k == 0) | (said[k]["level"] != F.get(said, k - 1)["level"]))
        return let(begins, lambda b: F.transform(b, lambda k, n: run(said, k, n, F.coalesce(F.get(b, n + 1), F.size(said)))))

    def run(said: Column, k: Column, n: Column, end: Column) -> Column:
        def line(x: Column, j: Column) -> Column:
            gap = (j > 0) & (x["i"] > F.get(said, k + j - 1)["i"] + 1)
            return F.when(gap, F.array(F.lit(""), x["text"])).otherwise(F.array(x["text"]))

        lines = F.flatten(F.transform(F.slice(said, k + 1, end - k), line))
        return F.struct(said[k]["level"].alias("level"), (n + 1).alias("at"), lines.alias("lines"))

    return let(F.filter(F.transform(lines, placed), lambda x: ~x["blank"]), runs)


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Settled rows: row, conv_id, turn, role, text (without quotes), passages, paragraphs, lines.

    ``passages`` are the quoted runs as (level, at, lines, pieces); ``paragraphs`` the keys by
    which this message can be quoted: its own text as a whole, each run of its own lines, each
    paragraph, two of these lines in a row and each of them; ``lines`` the numbers of its own
    lines.
    """
    lines = F.split(text_of(text), "\n")
    own = F.filter(lines, lambda x: (level(x) == 0) & ~F.regexp_like(x, F.lit(ANNOUNCES)))
    split = messages.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.when(F.exists(lines, lambda x: level(x) > 0), own).otherwise(lines).alias("own"),
        _passages(F.filter(lines, lambda x: ~F.regexp_like(x, F.lit(ANNOUNCES)))).alias("runs"),
    )
    said = _said(F.col("own"))
    quoted = F.filter("runs", lambda r: r["level"] > 0)
    told = F.filter("runs", lambda r: r["level"] == 0)
    return with_row_key(
        split.select(
            *["conv_id", "turn", "role"],
            F.regexp_replace(F.array_join("own", "\n"), rf"^(?:{SPACE}*\n)+|{SPACE}+$", "").alias("text"),
            F.transform(
                quoted,
                lambda r: F.struct(
                    r["level"].alias("level"), r["at"].alias("at"), line_hashes(r["lines"]).alias("lines"), pieces(r["lines"]).alias("pieces")
                ),
            ).alias("passages"),
            F.array_distinct(
                F.concat(
                    F.array(passage_hash(said)),
                    F.transform(told, lambda r: passage_hash(r["lines"])),
                    F.transform(F.flatten(F.transform(told, lambda r: paragraphs(r["lines"]))), passage_hash),
                    F.transform(F.filter(pairs(F.col("own")), lambda x: x[1].isNotNull()), passage_hash),
                    F.transform(said, lambda x: passage_hash(F.array(x))),
                )
            ).alias("paragraphs"),
            line_hashes(F.col("own")).alias("lines"),
        )
    )


def replies(rows: DataFrame) -> DataFrame:
    """row, parent: the message each quoting message replies to.

    Of the shallowest quotations that have an original, the last one decides. A piece of a
    quotation (all of it, a paragraph, two lines in a row, a line) names at most two messages:
    the first to say it in the own conversation, if that is an earlier turn, and the first of
    another conversation to say it. The original is, of the messages its pieces name, the one
    that shares most lines with the quotation, then one of the own conversation, then the first
    by conversation, turn and row. A quotation so meets no more messages than twice its pieces,
    however many say them, and no message is left out but by this rule.
    """
    runs = settle(
        rows.select("row", "conv_id", "turn", F.explode("passages").alias("p")).select(
            "row", "conv_id", "turn", "p.level", "p.at", "p.lines", "p.pieces"
        )
    )
    if runs.isEmpty():
        return runs.select("row", F.col("row").alias("parent"))
    wanted = settle(
        runs.select("row", "conv_id", "turn", "at", F.explode("pieces").alias("p")).select("row", "conv_id", "turn", "at", "p.key", "p.covers")
    )
    keys = wanted.select("key").distinct()
    said = settle(
        rows.select("row", "conv_id", "turn", F.explode("paragraphs").alias("key")).join(keys, "key", "left_semi")
    )
    message = F.struct("turn", "row")
    per_conv = settle(
        said.groupBy("conv_id", "key").agg(
            F.min(F.when(F.col("turn").isNotNull(), message)).alias("near"), F.min(message).alias("one")
        )
    )
    first = settle(
        per_conv.groupBy("key").agg(
            F.min(F.struct("conv_id", "one.turn", "one.row")).alias("far"), F.count(F.lit(1)).alias("convs")
        )
    )
    others = per_conv.join(first.where("convs > 1").select("key", F.col("far.conv_id").alias("__first")), "key")
    second = others.where(~F.col("conv_id").eqNullSafe(F.col("__first"))).groupBy("key").agg(
        F.min(F.struct("conv_id", "one.turn", "one.row")).alias("far")
    )
    far = settle(first.select("key", "far").unionByName(second))

    def found(frame: DataFrame, conv: str, turn: str, row: str) -> DataFrame:
        return frame.select(
            "key", F.col(conv).alias("__conv"), F.col(turn).alias("__turn"), F.col(row).alias("parent")
        )

    near = found(per_conv.where("near IS NOT NULL"), "conv_id", "near.turn", "near.row")
    away = found(far, "far.conv_id", "far.turn", "far.row")
    near = near.withColumnRenamed("key", "__key")
    own = F.col("__conv").eqNullSafe(F.col("conv_id"))
    inside = wanted.join(near, own & (F.col("key") == F.col("__key"))).where(F.col("__turn") < F.col("turn")).withColumn("other", F.lit(False))
    # Of the two conversations an outside piece knows, the first that is not the own one.
    elsewhere = F.struct("__conv", "__turn", "parent")
    outside = (
        wanted.join(away, "key").where(~own)
        .groupBy("row", "at", "key").agg(F.min(elsewhere).alias("one"), F.max("covers").alias("covers"))
        .select("row", "at", "key", "covers", "one.*", F.lit(True).alias("other"))
    )
    named = ["row", "at", "parent", "other", "__conv", "__turn"]
    met = settle(
        inside.select(*named, "covers").unionByName(outside.select(*named, "covers"))
        .groupBy(*named).agg(F.array_distinct(F.flatten(F.collect_set("covers"))).alias("covers"))
    )
    theirs = rows.select(F.col("row").alias("parent"), F.col("lines").alias("__lines"))
    shared = F.size(F.array_union("covers", F.array_intersect("lines", "__lines")))
    linked = (
        met.join(runs.select("row", "at", "level", "lines"), ["row", "at"])
        .join(theirs, "parent")
        .groupBy("row", "level", "at")
        .agg(F.min(F.struct((-shared).alias("shared"), "other", "__conv", "__turn", "parent"))["parent"].alias("parent"))
    )
    order = F.col("level").cast("long") * (1 << 31) - F.col("at")
    return linked.groupBy("row").agg(F.min_by("parent", order).alias("parent"))


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, position, turn, role, text, reply_conv_id, reply_turn, depth, n_quotes, message.

    One row per message, in the order of replies: within a conversation, threads by their
    first turn, and in a thread by turn, so a reply always follows what it replies to.
    ``position`` counts from 0 in the conversation. A message that quotes nothing known starts
    a thread of its own, so conversations without quotations keep the order of their turns.
    ``message`` is the chat form, ``<|role|>`` and the text. NULL texts are empty, a NULL
    conversation is one, NULL turns come first, a NULL role is ``user``. Rows that repeat one
    turn are ordered by role and text. An empty table gives an empty one.
    """
    rows = parsed(messages, conv, turn, role, text)
    parents = settle(replies(rows))
    where = rows.select(F.col("row").alias("__r"), F.col("conv_id").alias("parent_conv"), F.col("turn").alias("parent_turn"))
    inside = (
        parents.join(where, F.col("parent") == F.col("__r"))
        .join(rows.select("row", "conv_id"), "row")
        .select("row", "parent", "parent_conv", "parent_turn", F.col("parent_conv").eqNullSafe(F.col("conv_id")).alias("own"))
    )
    links = settle(inside)
    jumps = settle(links.where("own").select("row", F.col("parent").alias("to"), F.lit(1).alias("steps")))
    for _ in range(MOST_ROUNDS):
        onward = jumps.select(F.col("row").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        if jumps.join(onward, "to", "left_semi").isEmpty():
            break
        jumps = settle(
            jumps.join(onward, "to", "left").select(
                "row", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
            )
        )
    roots = jumps.join(where, F.col("to") == F.col("__r")).select("row", F.col("parent_turn").alias("root_turn"), F.col("steps").alias("depth"))
    joined = (
        rows.join(roots, "row", "left")
        .join(links.select("row", F.col("parent_conv").alias("reply_conv_id"), F.col("parent_turn").alias("reply_turn")), "row", "left")
        .select(
            *["conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), "text"],
            *["reply_conv_id", "reply_turn", F.coalesce("depth", F.lit(0)).alias("depth")],
            F.size("passages").alias("n_quotes"),
            F.when(F.col("depth").isNull(), F.col("turn")).otherwise(F.col("root_turn")).alias("__root"),
            F.col("row").alias("__row"),
            F.md5("text").alias("__text"),
        )
    )
    kept = settle(joined)
    slim = kept.select("conv_id", "__root", "turn", "role", "__text", "__row")
    placed = running_totals(slim, ["conv_id"], ["__root", "turn", "role", "__text", "__row"], {"position": F.lit(1)})
    ordered = kept.join(placed.select("__row", "position"), "__row")
    message = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"))
    return ordered.withColumn("message", message).select(
        *["conv_id", "position", "turn", "role", "text", "reply_conv_id", "reply_turn", "depth", "n_quotes", "message"]
    )
