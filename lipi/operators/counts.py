"""Word, character and pair counts (the trainer's counting phases)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc, pretokenize, py_strip

# Symbol strings: every symbol between TAB and LF ("\ta\n\tb\n"). Neither
# byte can occur inside a pre-token, so merges are plain replace() calls.
SYM_OPEN, SYM_CLOSE = "\t", "\n"


def training_words(lines: DataFrame, line: str = "line") -> Column:
    """Pre-tokens of a training line: strip, NFKC, pre-tokenise."""
    return pretokenize(nfkc(py_strip(F.col(line))))


def word_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """(word, cnt). Partial aggregation before the shuffle, so a hot word
    costs one row per map task, not one per occurrence."""
    return (lines.select(F.explode(training_words(lines, line)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))


def chars(c: Column) -> Column:
    """Code points of a string, as an array of 1-character strings."""
    return F.regexp_extract_all(c, F.lit("(?s)."), 0)


def alphabet(wc: DataFrame) -> DataFrame:
    """(ch, cnt): distinct characters of the word table, weighted by count."""
    return (wc.select(F.explode(chars(F.col("word"))).alias("ch"), "cnt")
            .groupBy("ch").agg(F.sum("cnt").cast("long").alias("cnt")))


def to_symbols(word: Column) -> Column:
    return F.concat(F.lit(SYM_OPEN),
                    F.array_join(chars(word), SYM_CLOSE + SYM_OPEN),
                    F.lit(SYM_CLOSE))


# Every adjacent symbol pair, overlapping, as its delimited text: a
# zero-width look-ahead match at each symbol start captures the next two
# symbols. Plain regex, so it stays inside whole-stage codegen (a zip_with
# lambda is interpreted row by row and was 2.4x slower here).
PAIR_RE = f"(?=({SYM_OPEN}[^{SYM_CLOSE}]*{SYM_CLOSE}{SYM_OPEN}[^{SYM_CLOSE}]*{SYM_CLOSE}))"


def first_symbol(k: Column) -> Column:
    return F.substring_index(F.substring(k, 2, 1 << 30), SYM_CLOSE, 1)


def last_symbol(k: Column) -> Column:
    return F.substring_index(F.substring_index(k, SYM_CLOSE + SYM_OPEN, -1), SYM_CLOSE, 1)


def pair_counts(words: DataFrame) -> DataFrame:
    """(l, r, n) over a symbol table (sym, cnt): n = sum of count x adjacent
    positions (overlaps count). Words of one symbol have no pairs.
    Aggregated on the pair text, split into l/r after the (small) result."""
    k = F.explode(F.regexp_extract_all("sym", F.lit(PAIR_RE), 1)).alias("k")
    agg = words.select(k, "cnt").groupBy("k").agg(F.sum("cnt").cast("long").alias("n"))
    return agg.select(first_symbol(F.col("k")).alias("l"), last_symbol(F.col("k")).alias("r"), "n")


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """Most frequent pairs; ties broken by (l, r) in binary order.
    orderBy + limit plans as TakeOrderedAndProject (top-k per task)."""
    return pairs.orderBy(F.col("n").desc(), F.col("l"), F.col("r")).limit(k)


def symbol_table(wc: DataFrame) -> DataFrame:
    return wc.select(to_symbols(F.col("word")).alias("sym"), F.col("cnt").cast("long").alias("cnt"))
