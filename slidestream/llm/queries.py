"""The operators of this subpackage as queries over ``documents`` and ``pages``, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidestream.llm import bpe, decontaminate, line_dedup, pii, quality, simhash, token_counts, token_store, toxicity, warc
from slidestream.llm.common import documents
from slidestream.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.drop("distance")


ORACLE_SQL["op1_decontaminate"] = decontaminate.SQL


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


@query
def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_tokens(documents(spark, sf_dir), new_folder(spark, "tokens"))
    return token_store.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL["op4_line_dedup"] = line_dedup.SQL.format(documents="documents")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), new_folder(spark, "trees"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "lang_threshold", "rejected")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


@query
def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


@query
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.captures_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.withColumn("headers", warc.header_text(F.col("headers")))


ORACLE_SQL["op10_warc_revisits"] = warc.SQL
