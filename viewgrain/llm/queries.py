"""One registered query per operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewgrain.llm import chat, exact, html, lexical, lines, mixing, packing, pii, quality, repair, sharding, simhash, superminhash
from viewgrain.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)


@query()
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.tokenise(table(spark, folder, "documents"))
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest)


@query(
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
         g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256
    FROM n JOIN g ON n.t = g.t
    """
)
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.duplicates(table(spark, folder, "documents"))


@query()
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_decisions(table(spark, folder, "documents"))


@query()
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).drop("fp")


@query()
def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.conversations(table(spark, folder, "conversations"))


@query()
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.per_row(mixing.mix(table(spark, folder, "documents")))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


@query()
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    sharded = sharding.shard(table(spark, folder, "documents"))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query()
def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    extracted = html.main_text(table(spark, folder, "pages"))
    return extracted.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = pii.personal_data(docs, pii.train(pii.labelled(docs)))
    counts = [F.size(pii.of_kind("base", kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.encode(pii.joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        pii.joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


@query()
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents")).drop("doc", "clean_text", "lost_chars")


@query(
    r"""
    WITH RECURSIVE
         w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
         s AS (SELECT DISTINCT r, CASE WHEN len(t) < 3 THEN array_to_string(t, ' ') ELSE t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] END AS s
               FROM (SELECT r, t, unnest(range(1, greatest(len(t) - 1, 2))) AS i FROM w WHERE len(t) > 0)),
         n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
         p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
         l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
         c AS (SELECT r AS a, r AS b FROM w UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
         k AS (SELECT c.a AS r, min(w.doc_id) AS component_id FROM c JOIN w ON w.r = c.b GROUP BY c.a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
    FROM w JOIN k USING (r) LEFT JOIN n USING (r)
    """
)
def op11_superminhash(spark: SparkSession, folder: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, folder, "documents"))


@query()
def op12_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(table(spark, folder, "conversations"))


@query(
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
         i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
         q AS (SELECT i, item_id, term, count(*) AS qtf FROM (SELECT i, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
         a AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0),
         tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
         w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, a GROUP BY term, n_docs),
         m AS (SELECT r, doc_id, CAST(75 + (25 * len(t) * n_docs) // n_terms AS BIGINT) AS m FROM d, a WHERE len(t) > 0),
         s AS (SELECT i, item_id, r, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
               FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
         k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS k FROM s WHERE score > 0)
    SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM k WHERE k <= 20
    """
)
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
