"""The operators of this folder over the provided tables, one registered query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import html_extract, importance_resampling, license_scan, line_dedup, mixing, near_dedup, order_minhash, packing, quality_model, quality_rules, spelling_variants, substring_dedup, suffix_dedup
from .common import ID, NO_ID

VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def own_id() -> Column:
    return F.when(F.col(ID) != NO_ID, F.col(ID)).alias("doc_id")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


@register("op1_quality_rules")
def op1(spark, sf_dir):
    out = quality_rules.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.drop("class_distance", "word_distance")


@register("op2_order_minhash")
def op2(spark, sf_dir):
    out = order_minhash.edited_prints(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(own_id(), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@register("op3_best_fit_packing")
def op3(spark, sf_dir):
    packed = packing.pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return packed.select(own_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op4_license_scan")
def op4(spark, sf_dir):
    found = license_scan.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(own_id(), "template", "coverage", "n_matched", "start_char", "end_char")


@register("op5_html_extraction")
def op5(spark, sf_dir):
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeats AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (r.key IS NULL OR k.doc_id = r.keeper), '')) AS kept_sha256
FROM keyed k LEFT JOIN repeats r ON k.key = r.key
GROUP BY k.doc_id
"""


@register("op6_line_dedup", OP6_SQL)
def op6(spark, sf_dir):
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", digest(F.col("text")).alias("kept_sha256"))


@register("op7_source_mixing")
def op7(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mix = mixing.mixed(mixing.held_rows(docs).withColumn("source", F.col("_row.source")))
    return mix.select(own_id(), "size", "source_size", "target", "taken", "rate")


@register("op8_quality_classifier")
def op8(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.classify(docs, read(spark, sf_dir, "labels")).drop("text")


@register("op9_near_dedup")
def op9(spark, sf_dir):
    classes = near_dedup.near_classes(near_dedup.held_rows(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return classes.select(own_id(), F.when(F.col("class_id") != NO_ID, F.col("class_id")).alias("class_id"))


OP10_SQL = r"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
starts AS (
  SELECT doc_id, s, list_aggregate(ws[s:s + 49], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM texts WHERE len(ws) >= 50)),
hits AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY win) AS first FROM starts) WHERE first < doc_id),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS k FROM hits),
gone AS (SELECT doc_id, list(k) AS gone FROM covered GROUP BY doc_id)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1),
         lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: ws[i]), ' '), '')) AS kept_sha256
FROM texts t LEFT JOIN gone g ON t.doc_id = g.doc_id
"""


@register("op10_substring_dedup", OP10_SQL)
def op10(spark, sf_dir):
    out = substring_dedup.substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", digest(F.col("text")).alias("kept_sha256"))


@register("op11_spelling_variants")
def op11(spark, sf_dir):
    return spelling_variants.spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op12_importance_resampling")
def op12(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_resampling.resample(docs, read(spark, sf_dir, "benchmark"), texts=False)


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 400)) AS w
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS s FROM texts WHERE length(h) >= 400)),
hits AS (
  SELECT doc_id, s FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
marked AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM hits),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT doc_id, run, min(s) AS a, max(s) + 200 AS z FROM numbered GROUP BY doc_id, run),
edges AS (
  SELECT doc_id, lag(z, 1, 0) OVER w AS a, a AS z, 0 AS gone, 0 AS n FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY run)
  UNION ALL SELECT doc_id, max(z), NULL, sum(z - a), count(*) FROM runs GROUP BY doc_id),
kept AS (
  SELECT t.doc_id, any_value(length(h) // 2) AS n_bytes, coalesce(sum(gone), 0) AS n_removed, coalesce(sum(n), 0) AS n_spans,
         string_agg(substr(h, 2 * coalesce(a, 0) + 1, 2 * (coalesce(z, length(h) // 2) - coalesce(a, 0))), '' ORDER BY a) AS k
  FROM texts t LEFT JOIN edges e ON t.doc_id = e.doc_id GROUP BY t.doc_id)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM kept
"""


@register("op13_suffix_array_dedup", OP13_SQL)
def op13(spark, sf_dir):
    out = suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
