"""Tokenizer quality metrics over an encoded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import UNK_ID
from ..functions.text import length_no_space, words_per_line


def metrics(encoded: DataFrame, group=None, words_floor_one: bool = False,
            zero_when_empty: bool = False) -> DataFrame:
    """sentences, chars_no_space, tokens, tokens_per_sentence,
    tokens_per_word, compression_ratio, unk_rate: one global (or per group)
    aggregate with partial aggregation; divisions guarded as the source does
    (max(1, x)); tokens per sentence is NULL for no sentence unless
    `zero_when_empty` (the stats endpoint form, which also counts
    max(1, words) per line)."""
    n = F.size("ids")
    words = words_per_line(F.col("text"))
    if words_floor_one:
        words = F.greatest(F.lit(1), words)
    per_row = encoded.select(
        *(group or []),
        length_no_space(F.col("text")).alias("c"), n.alias("n"), words.alias("w"),
        F.size(F.filter("ids", lambda i: i == UNK_ID)).alias("u"))
    aggs = [F.count(F.lit(1)).cast("long").alias("sentences"),
            F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("chars_no_space"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("tokens"),
            F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("words"),
            F.coalesce(F.sum("u"), F.lit(0)).cast("long").alias("unk")]
    a = per_row.groupBy(*group).agg(*aggs) if group else per_row.agg(*aggs)
    s, t, w, c, u = (F.col(x) for x in ("sentences", "tokens", "words", "chars_no_space", "unk"))
    if zero_when_empty:
        tps = F.when(s > 0, t / s).otherwise(F.lit(0.0))
        tpw = F.when(w > 0, t / w).otherwise(F.lit(0.0))
        cr = F.when(t > 0, c / t).otherwise(F.lit(0.0))
        ur = F.when(t > 0, u / t).otherwise(F.lit(0.0))
    else:
        tps = F.when(s > 0, t / s)
        tpw = t / F.greatest(F.lit(1), w)
        cr = c / F.greatest(F.lit(1), t)
        ur = u / F.greatest(F.lit(1), t)
    return a.select(*(group or []), "sentences", "chars_no_space", "tokens",
                    tps.cast("double").alias("tokens_per_sentence"),
                    tpw.cast("double").alias("tokens_per_word"),
                    cr.cast("double").alias("compression_ratio"),
                    ur.cast("double").alias("unk_rate"))
