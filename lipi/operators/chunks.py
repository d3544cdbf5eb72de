"""Global line numbers and fixed-size line chunks without a global sort.

Offsets are a prefix sum over documents in key order, computed in two
levels: documents are range-partitioned into buckets (even by sampled key
ranges), a window inside each bucket gives the running sum, and the bucket
totals (one row per bucket) give each bucket's offset. Nothing ever holds
all documents in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_CHUNK_LINES


def doc_offsets(counts: DataFrame, buckets: int | None = None) -> DataFrame:
    """counts (doc_id, n) -> (doc_id, n, offset): lines before the document."""
    # one bucket per input partition: they grow with the data
    p = buckets or max(counts.sparkSession.sparkContext.defaultParallelism, counts.rdd.getNumPartitions())
    b = (counts.repartitionByRange(p, "doc_id")
         .withColumn("bucket", F.spark_partition_id())
         .checkpoint(eager=True))  # fixes the bucket of every row
    inb = F.coalesce(F.sum("n").over(
        Window.partitionBy("bucket").orderBy("doc_id")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = b.withColumn("inb", inb)
    tot = b.groupBy("bucket").agg(F.sum("n").alias("t"))
    boff = F.coalesce(F.sum("t").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tot = tot.select("bucket", boff.alias("boff"))
    # One row per bucket: a bounded broadcast.
    return (b.join(F.broadcast(tot), "bucket")
            .select("doc_id", "n", (F.col("boff") + F.col("inb")).cast("long").alias("offset")))


def line_chunks(lines: DataFrame, counts: DataFrame,
                chunk: int = DEFAULT_CHUNK_LINES) -> DataFrame:
    """(doc_id, line_no, line_idx, chunk_id) for every line."""
    off = doc_offsets(counts)
    idx = F.col("offset") + F.col("line_no")
    return (lines.join(off.select("doc_id", "offset"), "doc_id")
            .select("doc_id", "line_no", idx.alias("line_idx"),
                    F.floor(idx / chunk).cast("long").alias("chunk_id")))


def chunk_counts(counts: DataFrame, chunk: int = DEFAULT_CHUNK_LINES) -> DataFrame:
    """(chunk_id, lines): per document, the chunks its lines fall in and how
    many of its lines each gets; summed per chunk."""
    off = doc_offsets(counts.filter(F.col("n") > 0))
    first, last = F.col("offset"), F.col("offset") + F.col("n") - 1
    per = off.select("offset", "n", F.explode(F.sequence(
        F.floor(first / chunk), F.floor(last / chunk))).alias("chunk_id"))
    lo = F.greatest(F.col("offset"), F.col("chunk_id") * chunk)
    hi = F.least(F.col("offset") + F.col("n"), (F.col("chunk_id") + 1) * chunk)
    return (per.groupBy("chunk_id").agg(F.sum(hi - lo).cast("long").alias("lines"))
            .select(F.col("chunk_id").cast("long"), "lines"))
