"""Scans of files: text files and compressed dumps written from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, read_table
from ..sources import corpus as src
from . import sqltext as S
from .corpus_queries import corpus_lines
from .registry import query

FILES = 3                # files a corpus or dump is written as


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lipi-{name}-{uuid.uuid4().hex}"


def _over_files(rows, number):
    """Files in name order, rows in number order: a place in the whole corpus."""
    per_file = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))      # one row per file
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    start = per_file.select("file_path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(start), "file_path").withColumn(number, F.col("start") + F.col(number)).drop("start", "file_path")


@query("file_lines", f"""
SELECT (row_number() OVER (ORDER BY doc_id, pos) - 1)::BIGINT AS line_no, line FROM (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
  FROM (SELECT doc_id, {S.file_lines('text')} AS l FROM documents))""")
def file_lines(spark, sf):
    """The documents' lines as text files, scanned back with dense numbers."""
    out = _folder(spark, "lines")
    (corpus_lines(spark, sf).repartitionByRange(FILES, "doc_id", "line_no").sortWithinPartitions("doc_id", "line_no")
     .select("line").write.text(out))
    return _over_files(src.text_file_lines(spark, out), "line_no").select("line_no", "line")


@query("dump_scan", """
SELECT (row_number() OVER (ORDER BY page_id) - 1)::BIGINT AS page_no,
  '    <title>' || url || '</title>' || chr(10) || html AS body FROM pages""")
def dump_scan(spark, sf):
    """The pages as a bz2 dump of several files, scanned back page by page."""
    out = _folder(spark, "dump")
    record = F.concat(F.lit("  <page>\n    <title>"), "url", F.lit("</title>\n"), "html", F.lit("\n  </page>\nbetween"))
    (read_table(spark, sf, "pages").repartitionByRange(FILES, "page_id").sortWithinPartitions("page_id")
     .select(record.alias("value")).write.option("compression", "bzip2").text(out))
    return _over_files(src.dump_pages(spark, out), "page_no").select("page_no", "body")
