"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns a DataFrame that is written as Parquet and read back as the
next stage's docs. All but the last return the columns of documents.

Defined results, besides those of the operators: null and empty texts are
rejected by the first stage (no language); of repeated rows one stays; rows
with a null doc_id pass every stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipi.llm import exact_dedup, langid, packing, pii, superminhash
from lipi.llm.common import read, sha256_text, shuffled, staged

NO_ID = -(1 << 63)       # stands for a null doc_id in joins


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents out of the struct ``r``."""
    return rows.select(*[F.col("r").getField(c).alias(c) for c in docs.columns])


def _held(docs: DataFrame) -> DataFrame:
    """docs as one struct, so that no column name can clash with a key."""
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("r"),
                       F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("k"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not found, or only by a narrow margin, go."""
    model = langid.learn(docs.where(~langid.held_out()))
    seen = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("r"), F.col("text").alias("text"))
    return _columns(langid.predict(seen, model).where("accepted"), docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, once."""
    keep = (exact_dedup.exact_groups(docs).where("kept")
            .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.col("text_sha256").alias("s")))
    rows = _held(docs).withColumn("s", sha256_text(F.col("r.text")))
    return _columns(rows.join(shuffled(keep), ["k", "s"], "left_semi").dropDuplicates(["k", "s"]), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    keep = superminhash.near_groups(docs).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"))
    return _columns(_held(docs).join(shuffled(keep), "k", "left_semi"), docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates in every text."""
    return pii.replace_entities(docs, pii.session_key(spark)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage),
          ("pii", pii_stage), ("packing", packing_stage)]

# Compression margins, permutation ranks and byte-pair ids have no SQL form:
# the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
