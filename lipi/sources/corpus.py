"""Corpus sources: tables, text files, compressed XML dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import keep_rows

# Universal newlines as in Python text-mode files.
NEWLINE_RE = r"\r\n|\r|\n"


def _file_lines(text: Column) -> Column:
    """Split like iterating a text file: a trailing newline ends the last
    line instead of starting an empty one; an empty text has no lines."""
    parts = F.split(text, NEWLINE_RE)
    return F.when(F.element_at(parts, -1) == "",
                  F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def document_lines(docs: DataFrame, key: str = "doc_id",
                   text: str = "text", carry=()) -> DataFrame:
    """(doc_id, line_no, line, *carry): every line of every document, in
    order, with `carry` columns of the document copied onto its lines.
    Narrow: no shuffle, lines stay in the partition of their document."""
    carry = list(carry)
    return docs.select(
        F.col(key).alias("doc_id"), *carry,
        F.posexplode(_file_lines(F.col(text))).alias("line_no", "line"),
    ).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line", *carry)


def drop_bad_utf8(c: Column) -> Column:
    """Decode with errors='ignore': invalid bytes vanish."""
    return F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit(""))


MAX_BLOCK_ROWS = 200_000      # splits whose offsets are broadcast; beyond, they are joined by a shuffle


def _block_rows(spark: SparkSession, path: str, line_sep: str | None = None, holding: str = "") -> DataFrame:
    """(file_path, block_start, pos, value): the records of text files that hold
    a text, as Spark splits them. ``pos`` counts them up within a split."""
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    return reader.text(path).where(F.col("value").contains(holding)).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("pos"), "value")


def dense_numbers(rows: DataFrame, name: str) -> DataFrame:
    """rows (file_path, block_start, pos, ...) with the number of each row
    within its file, from 0.

    Two levels: the rows of each split (its first ``pos`` and their number, one
    row per split) give its offset in the file, and pos - first pos + offset is
    the number. The rows themselves are not shuffled."""
    blocks = rows.groupBy("file_path", "block_start").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    # one row per split, fixed before it is used twice
    offsets = blocks.select("file_path", "block_start",
                            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_add")).checkpoint()
    offsets = F.broadcast(offsets) if offsets.count() <= MAX_BLOCK_ROWS else offsets.hint("merge")
    return (rows.join(offsets, ["file_path", "block_start"])
            .withColumn(name, F.col("pos") + F.col("_add")).drop("_add", "pos"))


def text_file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain or compressed (by suffix) text files -> (file_path, line_no, line)
    with a dense line number per file, however the files are split."""
    return dense_numbers(_block_rows(spark, path), "line_no").select(
        "file_path", "line_no", drop_bad_utf8(F.col("value").cast("binary").cast("string")).alias("line"))


PAGE_BLOCK = 1024             # lines of a block in page assembly


def page_intervals(markers: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, page_start, page_end) from marker lines (doc_id, line_no,
    is_open): a closing marker right behind an opening one ends a page.

    The marker before each marker is found in two levels, so that a dump of any
    size is many tasks' work: markers are range-partitioned, a window inside
    each (bucket, dump) looks one back, and the last marker of every earlier
    bucket, one row each, serves the first marker of the next."""
    # one bucket per input partition: they grow with the data
    p = buckets or max(markers.sparkSession.sparkContext.defaultParallelism, markers.rdd.getNumPartitions())
    ranged = (markers.repartitionByRange(p, "doc_id", "line_no").withColumn("bucket", F.spark_partition_id())
              .checkpoint(eager=True))  # marker lines only, without their text; fixes each one's bucket
    here = F.struct("line_no", "is_open")
    w = Window.partitionBy("doc_id", "bucket").orderBy("line_no")
    local = ranged.select("doc_id", "bucket", "line_no", "is_open", F.lag(here).over(w).alias("prev"))
    last = ranged.groupBy("doc_id", "bucket").agg(F.max(here).alias("last")).select(
        "doc_id", "bucket", F.lag("last").over(Window.partitionBy("doc_id").orderBy("bucket")).alias("carried"))
    prev = F.coalesce("prev", "carried")
    return (local.join(last, ["doc_id", "bucket"]).select("doc_id", "line_no", "is_open", prev.alias("prev"))
            .where(~F.col("is_open") & F.col("prev.is_open"))
            .select("doc_id", F.col("prev.line_no").alias("page_start"), F.col("line_no").alias("page_end")))


def page_bodies_from_lines(lines: DataFrame, buckets: int | None = None, block: int = PAGE_BLOCK) -> DataFrame:
    """Page assembly over an ordered, line-split dump (doc_id, line_no, line).

    A line holding "<page>" opens a page (and drops whatever was being
    collected); a line holding "</page>" closes it and emits the lines in
    between joined by "\\n"; marker lines themselves are not kept; lines
    outside pages and an unterminated page are dropped.

    Only marker lines, without their text, are ordered over the whole dump; they
    give the pages' intervals. The text is shuffled once, by blocks of ``block``
    lines: each interval is dealt to the blocks it touches, and inside a block a
    running window hands every line the interval it stands in. Pages within one
    block are finished there; only those that cross blocks meet once more. Only
    a page (bounded) is ever collected into one group.
    """
    is_open = F.col("line").contains("<page>")
    is_close = F.col("line").contains("</page>") & ~is_open
    markers = keep_rows(lines.select("doc_id", "line_no", is_open.alias("is_open"), is_close.alias("is_close")),
                        F.col("is_open") | F.col("is_close")).drop("is_close")
    # used for three things below: fixed once, it holds three numbers a page
    pages = page_intervals(markers, buckets).checkpoint(eager=True)
    of = lambda no: F.floor(F.col(no) / block).cast("long")
    touched = pages.select("doc_id", "page_start", "page_end", F.explode(F.sequence(of("page_start"), of("page_end"))).alias("block"))
    starts = touched.select("doc_id", "block", F.greatest(F.col("page_start"), F.col("block") * block - 1).cast("long").alias("line_no"),
                            F.lit(None).cast("string").alias("line"), "page_start", "page_end")
    text = lines.where(~is_open & ~is_close).select(
        "doc_id", of("line_no").alias("block"), F.col("line_no").cast("long").alias("line_no"), "line",
        F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"))
    running = Window.partitionBy("doc_id", "block").orderBy("line_no", F.col("line").isNotNull())
    held = (text.unionByName(starts)
            .withColumn("page_start", F.last("page_start", True).over(running))
            .withColumn("page_end", F.last("page_end", True).over(running))
            .where(F.col("page_end").isNotNull() & (F.col("line").isNull() | (F.col("line_no") < F.col("page_end")))))
    # grouped within the blocks: no further shuffle
    parts = held.groupBy("doc_id", "block", "page_start", "page_end").agg(F.array_sort(F.collect_list(
        F.when(F.col("line").isNotNull(), F.struct("line_no", "line")))).alias("ls"))
    parts = parts.withColumn("ls", F.transform("ls", lambda x: x["line"]))
    whole = of("page_start") == of("page_end")
    crossing = (parts.where(~whole).groupBy("doc_id", "page_start", "page_end")
                .agg(F.array_sort(F.collect_list(F.struct("block", "ls"))).alias("bs"))
                .select("doc_id", "page_start", "page_end", F.flatten(F.transform("bs", lambda b: b["ls"])).alias("ls")))
    return (parts.where(whole).select("doc_id", "page_start", "page_end", "ls").unionByName(crossing)
            .select("doc_id", "page_start", "page_end", F.array_join("ls", "\n").alias("body")))


def dump_pages(spark: SparkSession, path: str) -> DataFrame:
    """Compressed XML dump (codec chosen by file suffix, e.g. .bz2) -> raw page
    bodies (file_path, page_no, body), page_no dense within the file.

    Records are cut at "<page>" so each record holds one page; bz2 is
    splittable, so a large dump is read by many tasks, and each split's pages
    get their place from two-level prefix sums. The dump is decompressed twice
    (once to count), which is cheaper than writing its text out in between."""
    closed = _block_rows(spark, path, "<page>", "</page>")
    # Linear in the page: cut at the first closing marker, then drop the line
    # of the opening marker and what stands before the closing one.
    head = F.substring_index("rec", "</page>", 1)
    first = F.locate("\n", F.col("h"))
    rest = F.substr("h", first + 1, F.length("h"))
    last = F.substring_index("r", "\n", -1)
    return (dense_numbers(closed, "page_no")
            .select("file_path", "page_no", drop_bad_utf8(F.col("value").cast("binary").cast("string")).alias("rec"))
            .select("file_path", "page_no", head.alias("h"))
            .select("file_path", "page_no", F.when(first > 0, rest).otherwise(F.lit("")).alias("r"))
            .select("file_path", "page_no", F.when(F.col("r").contains("\n"), F.substr(
                "r", F.lit(1), F.length("r") - F.length(last) - 1)).otherwise(F.lit("")).alias("body")))


def strip_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", py_strip(F.col("line")))
