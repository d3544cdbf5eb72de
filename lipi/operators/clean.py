"""Corpus build: clean pages/documents into one line each, filter, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FILTER_MIN_CHARS, PAGE_MIN_CHARS_EXCLUSIVE
from ..functions.text import DEFAULT_ALLOWED, clean_line, py_strip
from ..session import keep_rows


def clean_texts(df: DataFrame, key: str, text: str,
                allowed: str = DEFAULT_ALLOWED) -> DataFrame:
    """(key, clean, n_chars) for every row, before the length filter."""
    cleaned = clean_line(F.col(text), allowed)
    return (df.select(F.col(key).alias("doc_id"), cleaned.alias("clean"))
            .withColumn("n_chars", F.length("clean").cast("int")))


def clean_corpus(df: DataFrame, key: str = "doc_id", text: str = "text",
                 allowed: str = DEFAULT_ALLOWED,
                 min_exclusive: int = PAGE_MIN_CHARS_EXCLUSIVE) -> DataFrame:
    """Cleaned page lines kept when longer than `min_exclusive` characters.
    One narrow stage: scan -> regex -> filter, no shuffle."""
    return keep_rows(clean_texts(df, key, text, allowed), F.col("n_chars") > min_exclusive)


def filter_corpus(lines: DataFrame, line: str = "clean",
                  min_len: int = FILTER_MIN_CHARS) -> DataFrame:
    """Second-pass filter: strip, keep lines of at least `min_len` chars."""
    stripped = py_strip(F.col(line))
    return keep_rows(lines.withColumn(line, stripped), F.length(F.col(line)) >= F.lit(min_len))


def clean_corpus_stats(df: DataFrame, key: str = "doc_id", text: str = "text",
                       allowed: str = DEFAULT_ALLOWED,
                       min_exclusive: int = PAGE_MIN_CHARS_EXCLUSIVE) -> DataFrame:
    c = clean_texts(df, key, text, allowed)
    return c.agg(F.count(F.lit(1)).alias("pages_in"),
                 F.count(F.when(F.col("n_chars") > min_exclusive, 1)).alias("pages_kept"),
                 F.coalesce(F.sum(F.when(F.col("n_chars") > min_exclusive, F.col("n_chars"))),
                            F.lit(0)).cast("long").alias("chars_kept"))


def filter_corpus_stats(lines: DataFrame, line: str = "clean",
                        min_len: int = FILTER_MIN_CHARS) -> DataFrame:
    n = F.length(py_strip(F.col(line)))
    return lines.agg(F.count(F.lit(1)).alias("lines_in"),
                     F.count(F.when(n >= F.lit(min_len), 1)).alias("lines_kept"))


def write_corpus(df: DataFrame, path: str, line: str = "clean",
                 mode: str = "errorifexists") -> dict:
    """Write one cleaned line per row as text and count the rows in the same
    pass (observe), instead of a second scan."""
    from pyspark.sql import Observation
    obs = Observation("kept")
    df.select(line).observe(obs, F.count(F.lit(1)).alias("lines")) \
        .write.mode(mode).text(path)
    return obs.get
