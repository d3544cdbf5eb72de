"""Streaming and chunking queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunks as ch
from ..session import ensure_checkpoint_dir, read_table
from ..sources import corpus as src
from ..streaming import feed
from . import sqltext as S
from .encode_queries import CONV, _enc, _summary_sql
from .model_queries import model_of, train_prefix
from .registry import query


@query("stream_word_counts", f"WITH {S.corpus_clean_cte()}, {S.word_counts_cte()} SELECT word, cnt FROM wc")
def stream_word_counts(spark, sf):
    """The table as a file stream; final state equals word_counts."""
    docs = feed.table_stream(spark, f"{sf}/documents.parquet", spread=spark.sparkContext.defaultParallelism)
    final, _ = feed.stream_word_counts(spark, docs)
    return final


FEED_CHUNKS = 20         # micro-batches of the feed written from documents
MARK = 25                # lines between two progress marks


def _feed(spark, sf):
    """The documents as a feed of FEED_CHUNKS chunks, one micro-batch each."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lipi-feed-{uuid.uuid4().hex}"
    feed.write_feed(read_table(spark, sf, "documents"), path, F.pmod("doc_id", F.lit(FEED_CHUNKS)))
    # a chunk is one file: without dealing it out, one task would clean it
    cores = spark.sparkContext.defaultParallelism
    docs = feed.file_stream(spark, path, "*.parquet", spread=cores)
    return feed.stream_word_counts(spark, docs, partitions=max(4, cores))


@query("stream_running_counts", f"WITH {S.corpus_clean_cte()}, {S.word_counts_cte()} SELECT word, cnt FROM wc")
def stream_running_counts(spark, sf):
    """Running counts kept in a state store over many micro-batches."""
    return _feed(spark, sf)[0]


@query("stream_progress", f"""WITH {S.corpus_clean_cte()},
b AS (SELECT doc_id % {FEED_CHUNKS} AS batch, count(*) AS lines FROM corpus GROUP BY 1),
t AS (SELECT batch, lines, sum(lines) OVER (ORDER BY batch) AS total FROM b)
SELECT batch::BIGINT AS batch, (unnest(range((total - lines)::BIGINT // {MARK} + 1, total::BIGINT // {MARK} + 1)) * {MARK})::BIGINT AS mark FROM t""")
def stream_progress(spark, sf):
    """A mark for every MARK lines fed, with the micro-batch that reached it,
    from the metrics observed in the running query."""
    return feed.log_marks(_feed(spark, sf)[1], MARK)


@query("stream_encode", f"WITH {train_prefix()},\n{_enc('', 'conversations', CONV, 'text')}\n{_summary_sql(CONV)}")
def stream_encode(spark, sf):
    convs = feed.table_stream(spark, f"{sf}/conversations.parquet", spread=spark.sparkContext.defaultParallelism)
    out = feed.stream_encode(spark, convs, model_of(spark, sf), CONV, "text")
    return out.select(*CONV, "ids_csv", "token_count", "compression_ratio")


QUERY_CHUNK = 97         # small chunks, so that documents cross many of them


def _doc_lines(spark, sf):
    docs = read_table(spark, sf, "documents")
    lines = src.document_lines(docs)
    counts = docs.select("doc_id", F.size(src._file_lines(F.col("text"))).cast("long").alias("n"))
    return lines, counts


_LINES_SQL = f"""
WITH l AS (SELECT doc_id, (pos - 1)::INT AS line_no FROM (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, {S.file_lines('text')} AS l FROM documents))),
n AS (SELECT doc_id, line_no, (row_number() OVER (ORDER BY doc_id, line_no) - 1)::BIGINT AS line_idx FROM l)
"""


@query("line_chunks", _LINES_SQL + f"SELECT doc_id, line_no, line_idx, (line_idx // {QUERY_CHUNK})::BIGINT AS chunk_id FROM n")
def line_chunks(spark, sf):
    lines, counts = _doc_lines(spark, sf)
    return ch.line_chunks(lines, counts, QUERY_CHUNK)


@query("chunk_counts", _LINES_SQL + f"SELECT (line_idx // {QUERY_CHUNK})::BIGINT AS chunk_id, count(*)::BIGINT AS lines FROM n GROUP BY 1")
def chunk_counts(spark, sf):
    _, counts = _doc_lines(spark, sf)
    return ch.chunk_counts(counts, QUERY_CHUNK)
