"""The registered queries of the corpus operators: one opN_ query for each, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from asofkit.llm import ann, fingerprints, langid, linededup, mixing, ngramjoin, packing, sitetree, token_store, warc
from asofkit.llm.common import remove, work_path

Query = Callable[[SparkSession, str], DataFrame]

#: Production parameters.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
SEQUENCE_TOKENS = 2048
#: A line of so many words goes if it is one word's insertion, deletion or substitution from an earlier one.
LINE_DEDUP = {"max_edits": 1, "min_size": 8, "unit": "word"}


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_weights(spark.read.parquet(f"{sf_dir}/documents.parquet"), MIX_WEIGHTS, seed=1)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), **LINE_DEDUP)
    return docs.select("doc_id", "text", "lines_removed")


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, archives = work_path(spark, "arc"), work_path(spark, "warc")
    warc.write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arc)
    warc.arc_to_warc(spark, arc, archives, least_bytes=0)
    remove(spark, arc)
    return warc.read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "date")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=75)


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10, every=100)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op8_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "planes")
    token_store.write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer())
    return token_store.token_index(spark, path)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer(), capacity=SEQUENCE_TOKENS)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_poisson_mix, op2_line_dedup, op3_arc_to_warc, op4_ngram_jaccard, op5_multi_index_hashing, op6_language_id, op7_site_style_tree, op8_prefix_fingerprints, op9_plane_tokens, op10_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_poisson_mix": OP1_SQL}


OP1_SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*)::DOUBLE AS m FROM documents GROUP BY source),
weighted AS (SELECT *, CASE source WHEN 'src0' THEN 4.0::DOUBLE WHEN 'src1' THEN 2.0::DOUBLE WHEN 'src2' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sizes),
rates AS (SELECT source, w / (SELECT sum(w) FROM weighted) * (SELECT sum(m) FROM weighted) / m AS repetition_rate FROM weighted),
parts AS (SELECT *, greatest(ceil(repetition_rate / 16.0), 1)::INTEGER AS parts FROM rates),
terms AS (
  SELECT source, 0 AS k, exp(-(repetition_rate / parts)) AS p, exp(-(repetition_rate / parts)) AS c, repetition_rate / parts AS mean FROM parts
  UNION ALL
  SELECT source, k + 1, p * mean / (k + 1), c + p * mean / (k + 1), mean FROM terms WHERE k < 63),
draws AS (
  SELECT d.doc_id, r.source, r.repetition_rate, i.i, ('0x' || substr(md5('1|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || i.i::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parts r ON d.source IS NOT DISTINCT FROM r.source, generate_series(0, r.parts - 1) AS i(i)),
counts AS (
  SELECT d.doc_id, d.repetition_rate, count(t.k)::INTEGER AS copies
  FROM draws d LEFT JOIN terms t ON t.source IS NOT DISTINCT FROM d.source AND t.c <= d.u GROUP BY ALL)
SELECT d.*, c.repetition_rate, g.copy::INTEGER AS copy, md5('order1|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || g.copy::VARCHAR) AS shuffle_key
FROM documents d JOIN counts c ON d.doc_id = c.doc_id, generate_series(0, c.copies - 1) AS g(copy)
"""
