"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.llm import decontam, langid, line_dedup, mixing, passage_dedup, periodic_runs, search, secrets, simhash, token_counts, toxicity, warc, whitening
from tillweave.llm.common import map_batches, small_batches

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL twin where there is one."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; texts come in small Arrow batches from here on."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A line's key in SQL: white space off both ends, A-Z lower-cased.
_SQL_KEY = (
    "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

LINE_DEDUP_SQL = f"""
WITH split_lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, {_SQL_KEY} AS key FROM split_lines
), shared AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, s.keep IS NOT NULL AND s.keep <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op9_line_dedup", LINE_DEDUP_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents, digest per document."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: three-word shingles, at most three differing bits."""
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def _mixing_sql(rounds: int = 40) -> str:
    """Raking as unrolled common table expressions."""
    steps = []
    dims = mixing.DIMENSIONS
    goals = ", ".join(
        f"g_{d} AS (SELECT {d}, power(sum(base), {mixing.TEMPERATURE}) AS raw FROM cells WHERE base > 0 GROUP BY {d})" for d in dims
    )
    for k in range(rounds * len(dims)):
        d = dims[k % len(dims)]
        steps.append(
            f"w{k + 1} AS MATERIALIZED (SELECT w.* REPLACE (CASE WHEN s.now > 0 THEN w.weight * w.{d}_goal / s.now ELSE 0 END AS weight) "
            f"FROM w{k} w JOIN (SELECT {d}, sum(weight) AS now FROM w{k} GROUP BY {d}) s USING ({d}))"
        )
    joins = " ".join(
        f"LEFT JOIN (SELECT {d}, raw / (SELECT sum(raw) FROM g_{d}) * (SELECT sum(base) FROM cells) AS {d}_goal FROM g_{d}) USING ({d})"
        for d in dims
    )
    return f"""
WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN contains(text, 'License') THEN 'notice' WHEN contains(text, ' | ') THEN 'table' ELSE 'prose' END AS topic,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens
  FROM documents
), cells AS MATERIALIZED (
  SELECT source, lang, topic, sum(tokens) AS base FROM rows GROUP BY ALL
), {goals},
w0 AS MATERIALIZED (SELECT *, CAST(base AS DOUBLE) AS weight FROM cells {joins}),
{", ".join(steps)},
chances AS (
  SELECT source, lang, topic, coalesce(CASE WHEN base > 0 THEN weight / base END
    / (SELECT max(weight / base) FROM w{len(steps)} WHERE base > 0), 1.0) AS p FROM w{len(steps)}
)
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability,
  CAST('0x' || substr(md5('7:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 < p AS kept
FROM rows JOIN chances USING (source, lang, topic)
"""


@query("op2_source_mixing", _mixing_sql())
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked sampling of all documents; targets are the observed shares flattened by the temperature.

    The columns are those of the SQL twin, so a sample that misses its targets is told by a warning.
    """
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    state = plan.select("converged", "marginal_error").first()
    if state is not None and not state["converged"]:
        warnings.warn(f"op2_source_mixing: targets are not met, a share is off by {state['marginal_error']:.3g}", RuntimeWarning)
    return plan.withColumn("probability", F.round("probability", 6)).drop("marginal_error", "converged")


WARC_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), h AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p
), f AS (
  SELECT hex, min(page_id) AS first_page,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST((3 - i % 4) * 5 AS INT)) & 31) + 1 AS INT), 1)), '') AS digest
  FROM h GROUP BY hex
)
SELECT page_id, payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_page THEN NULL ELSE first_page END AS refers_to
FROM h JOIN f USING (hex)
"""


@query("op4_arc_to_warc", WARC_SQL)
def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC and WARC files and back."""
    out = warc.pages_through_archives(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items held by each of all documents."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by the pieces of a public vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.load_pieces())


@query("op3_top_k_search")
def op3_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 20, asked with its whole text."""
    docs = table(spark, sf_dir, "documents")
    found = search.top_k(docs, docs.where(F.col("doc_id") % 20 == 0))
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def _with_period(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Give one text in ten a period from some word on, by the checksum of its id; others stay as they are."""
    made = []
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        body = text.as_py()
        mark = zlib.crc32(str(doc_id).encode())
        words = body.split() if body and doc_id is not None and mark % 10 == 0 else []
        if words:
            n, g = len(words), mark // 10
            a = g % n
            period = 1 + (n - a) // (3 + g % 8)
            times = -(-(n - a) // period)
            body = b" ".join(words[:a] + (words[a : a + period] * times)[: n - a])
        made.append(body)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "body"])


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, one text in ten rewritten with a period."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("body"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = map_batches(docs, lambda: _with_period, f"doc_id {kind}, body binary").select("doc_id", F.col("body").cast("string").alias("text"))
    found = periodic_runs.periodic_runs(docs).withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("best.length * 1000 div best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of all usable embeddings, scaled to whole numbers."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(whitening.usable(F.col("embedding")))
    return whitening.whiten(vectors.withColumn("embedding", whitening.whole_numbers(F.col("embedding"), 1024, 100000)))


@query("op13_passage_dedup")
def op13_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that occur again, removed from all documents."""
    out = passage_dedup.drop_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
