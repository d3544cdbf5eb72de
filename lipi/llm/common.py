"""Shared plumbing of the training-data operators: tables, staged results."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as its files lie; no reshuffle."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared checkpoint folder and read it
    back: cuts the lineage, survives lost executors, and a later stage reads
    only the columns it needs."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lipi_path = path
    # the stages before are done: let Spark's cleaner drop their shuffle files
    gc.collect()
    spark._jvm.System.gc()
    return out


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_of(spark: SparkSession, size: int):
    """What is written inside passes rows to Python in Arrow batches of about
    ``size`` bytes. Spark bounds a batch by rows first: 10,000 whole texts are
    held by the executor and again by its Python worker."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_lipi_path", None)
    if path is None:
        return
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def parts(spark: SparkSession) -> int:
    """Partitions of an explicit repartition: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha256_text(col) -> "F.Column":
    return F.sha2(F.coalesce(col, F.lit("")).cast("binary"), 256)


def shuffled(df: DataFrame) -> DataFrame:
    """The small side of a join whose size follows the corpus: always a
    sort-merge join (which adaptive execution can split, if both sides come
    straight from a shuffle), never a broadcast that a small test would choose
    and a large run could not."""
    return df.hint("merge")


def apart(aggregate: DataFrame) -> DataFrame:
    """The side of a join that is an aggregate on the join key. Left alone, its
    last step stays in the join's own stage, which adaptive execution then
    cannot split at a hot key; dealt out anew, it is a stage of its own."""
    return shuffled(aggregate.repartition(parts(aggregate.sparkSession)))
