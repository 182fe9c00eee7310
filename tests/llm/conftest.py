from __future__ import annotations

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from viewgrain.llm.common import prepare  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, `row` long, H int"


@pytest.fixture(scope="session")
def session(spark):
    return prepare(spark)


def long_text(n: int = 30_000) -> str:
    return " ".join(f"w{i * 7919 % 10007}" for i in range(n)) + "."


#: Odd texts by doc_id; columns that operators use inside clash on purpose.
TEXTS = {
    1: None,
    2: "",
    3: " \t\n ",
    4: "One line. And more.",
    5: "one  line.\tAnd more.",
    6: "one line. And more.",
    7: "ÄÖ 日本語 text with wide marks <|endoftext|> end.",
    8: "a b c a b c a b c",
    9: long_text(),
    10: long_text() + " tail",
    11: "x" * 20_000,
}


def odd_rows() -> list[tuple]:
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", None, "k", i, 1) for i, t in TEXTS.items()]
    rows += [rows[3], rows[3], (None, "One line. And more.", "en", "s0", 1, None, None, None)]
    rows += [(100 + i, "many words in this copy of a text " * 12, "en", "hot", 3, "k", 0, 0) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd(session):
    return session.createDataFrame(odd_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(session):
    return session.createDataFrame([], SCHEMA)
