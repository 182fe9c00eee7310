from __future__ import annotations

from collections import Counter

import corpus_pipeline
from llm.conftest import SCHEMA, WORD
from llm.test_exact import brute as brute_exact
from llm.test_mixing import brute_targets
from llm.test_simhash import brute_components, brute_print

from viewgrain.llm import quality
from viewgrain.plans.settle import settled_path, settled_paths


def documents():
    prose = lambda seed, n: ". ".join(" ".join(f"v{(seed * 31 + i * j) % 997}" for j in range(1, 9)) for i in range(n)) + "."
    rows = [(i, prose(i, 8 + i % 30), "en", f"s{i % 4}", 1, "k", 0, 0) for i in range(60)]
    rows += [(100 + i, prose(3, 40).replace(" ", "  "), "en", "s0", 1, "k", 0, 0) for i in range(20)]
    rows += [(200 + i, prose(4, 400) + f" end{i}.", "en", "s1", 1, "k", 0, 0) for i in range(10)]
    rows += [(300, None, "en", None, None, None, None, None), (301, "", "en", "s2", 0, "", 1, 1)]
    return rows


def test_stages_on_their_own_input(session):
    docs = session.createDataFrame(documents(), SCHEMA)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(session, docs, "unused")
        if name != "packed":
            assert out.columns == docs.columns
        docs = session.createDataFrame(out.collect(), out.schema)
        seen[name] = before, [tuple(r) for r in docs.collect()], docs
    before, after, _ = seen["quality_rules"]
    assert {r[0] for r in after} == {r[0] for r in before} - {300, 301}
    before, after, _ = seen["exact_dedup"]
    assert Counter(r[0] for r in after) == Counter({keep for _, keep, _, _ in brute_exact(before)[0]})
    before, after, _ = seen["simhash_dedup"]
    label = brute_components([brute_print(r[1]) for r in before])
    assert {r[0] for r in after} == {min(r[0] for r, k in zip(before, label) if k == c) for c in set(label)}
    before, after, _ = seen["source_mix"]
    size = lambda r: len(WORD.findall(r[1]))
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r[3]] += size(r)
    for r in after:
        taken[r[3]] += size(r)
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= max(size(r) for r in before if r[3] == source)
    assert max(Counter(r[0] for r in after).values()) <= 3
    before, _, packed = seen["packed"]
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter(r[0] for r in before)


def test_run_reads_and_writes(session, tmp_path):
    session.createDataFrame(documents(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    before = settled_paths(session)
    out = corpus_pipeline.run(session, str(tmp_path))
    assert out.count() > 0 and settled_paths(session) == [*before, settled_path(out)]
    empty = tmp_path / "empty"
    session.createDataFrame([], SCHEMA).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(session, str(empty)).count() == 0


def test_rejected_documents_are_those_the_rules_reject(session):
    docs = session.createDataFrame(documents(), SCHEMA)
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert kept == {r.doc_id for r in corpus_pipeline.quality_rules(session, docs, "").collect()}


def test_odd_names_repeated_rows_and_empty_tables(session):
    odd = ["__row", "__size", "__id", "__sha", "__text", "__gone", "key", "size", "doc", "row", "fp", "c0"]
    text = " ".join(f"w{i}" for i in range(80)) + "."
    rows = [(1, text, "s"), (1, text, "s"), (None, text, None), (2, text + " And more.", None), (None, None, "s"), (3, "", "t")]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in odd)
    named = [(*r, *(f"{c}{i}" for c in odd)) for i, r in enumerate(rows)]
    kept = {"quality_rules": 4, "exact_dedup": 3, "packed": 6}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(session, session.createDataFrame(named, schema).coalesce(1), "")
        assert name == "packed" or out.columns == ["doc_id", "text", "source", *odd]
        got = out.collect()
        assert len(got) == kept.get(name, len(got)), name
        assert name == "packed" or set(map(tuple, got)) <= set(named) and got
        assert stage(session, session.createDataFrame([], schema), "").count() == 0
