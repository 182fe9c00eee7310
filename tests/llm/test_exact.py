from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from llm.conftest import odd_rows
from pyspark.sql import functions as F

from viewgrain.llm import exact


def brute(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc)
    out = []
    for text, docs in groups.items():
        least = min((d for d in docs if d is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(d, least, len(docs), digest) for d in docs]
    return sorted(out, key=repr), len(groups)


def test_against_brute_force(odd, none):
    want, groups = brute(odd_rows())
    got = exact.duplicates(odd).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)
    assert exact.duplicates(none).count() == 0


def test_kept_documents_keep_their_columns(odd, none):
    left = exact.deduplicated(odd)
    assert left.columns == odd.columns
    rows = left.collect()
    assert len(rows) == brute(odd_rows())[1]
    assert exact.deduplicated(none).count() == 0


def test_clashing_identifiers_are_found_and_replaced(session, odd):
    weak = lambda c: (F.length(c) % 3, F.lit(0))
    strong = exact._identifiers()[0]
    texts = odd.select(exact.normalised(F.coalesce("text", F.lit(""))).alias("normal"))
    assert not exact.clashes(texts, weak).isEmpty()
    assert exact.verified(texts, [weak, strong]) is strong
    got = exact.duplicates(odd, ways=[weak, strong]).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(odd_rows())[0]


def test_no_python_in_the_plan(odd, capsys):
    exact.duplicates(odd).explain()
    assert "Python" not in capsys.readouterr().out


def test_rows_that_stay_are_the_same_on_a_rerun(session):
    rows = [(1, "a b", "x"), (1, "a  b", "y"), (1, "a b", "x"), (None, "a b", "z"), (None, "c", "p"), (None, "c", "q"), (0, None, "r"), (2, "", "s")]
    docs = session.createDataFrame(rows, "doc_id long, text string, `Row` string").repartition(3).cache()
    got = [sorted(tuple(r) for r in exact.deduplicated(docs).collect() if r.doc_id is not None) for _ in range(2)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [0, 1] and exact.deduplicated(docs).count() == 3
    names = session.createDataFrame([(str(i % 3), f"t{i % 5}") for i in range(40)], "doc_id string, text string")
    assert exact.deduplicated(names).count() == 5


def test_no_text_is_joined(odd, capsys):
    exact.deduplicated(odd).explain()
    plan = capsys.readouterr().out
    assert "LeftAnti" in plan and "sha2" not in plan
