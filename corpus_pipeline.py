"""A corpus pipeline of five stages over ``documents``: what each keeps is written as Parquet and is all the next one sees.

toxicity -> line dedup -> SimHash near-dedup -> benchmark decontamination -> byte-level BPE. All but the last return the columns of
documents; the last returns a digest of each remaining document's ids and of the bytes they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidestream.llm import bpe, common, decontaminate, line_dedup, simhash, toxicity
from slidestream.shared import new_folder, remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is trained on the labels of this table outside the held-out third.

    Null and empty texts are judged as texts without words; repeated rows share their verdict; other columns stay; an empty table, or one
    without labels, gives a model with one score for all, and no row goes.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the last of them only; ``n_chars`` is counted anew. No document goes.

    A null or empty text becomes one empty line; a null doc_id counts as one document, smaller than all; repeated rows lose the same lines;
    other columns stay, whatever their names; an empty table gives no rows.
    """
    out = line_dedup.line_dedup(docs)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(common.quoted(c)) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays.

    Texts without words are one group; of rows that share a doc_id one stays; rows without one stay; other columns stay; an empty table
    gives no rows.
    """
    return simhash.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts stay, repeated rows share their verdict, other columns stay; with an
    empty benchmark nothing goes."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A digest of each document's ids and of the bytes they decode to; of no bytes for a null or empty text. Repeated rows give repeated
    results, an empty table none; other columns go."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The classifier, the fingerprints and the encoding aren't SQL; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again. What a stage read is deleted once its result
    is written; the last one's result stays for the caller, who may delete its folder."""
    folder = new_folder(spark, "pipeline")
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(path)
    return docs
