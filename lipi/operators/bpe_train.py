"""Exact BPE training as a Spark loop over the word table.

Data flow: lines -> word counts (the one big shuffle) -> symbol table
(sym, cnt) -> rounds. A round

1. counts all pairs (partial sums before the shuffle) and takes the most
   frequent ones, at most MAX_HOT + 1 rows;
2. sets a floor: the hot pairs are all pairs of at least that count;
3. cuts every word where two symbols do not form a hot pair and sums the
   segments over the corpus. Segments repeat far more than words do; their
   number and size are checked before they are collected, and a floor that
   leaves too many is raised;
4. chooses, on the segments, all merges down to the floor, exactly as one merge
   at a time would (bpe_rounds.py says why the segments suffice);
5. applies them in order to the word table, which is written below the
   checkpoint folder; the table before it is deleted.

As the floor falls by a factor a round, a vocabulary takes some tens of rounds
instead of one or more per merge. The word table and the pair counts stay
distributed; the driver sees a bounded table of segments and the merges. Where
even the pairs tied at the top leave too many segments, the round commits its
first merge only, which needs no segments.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SPECIAL_TOKENS, TrainParams
from ..session import ensure_checkpoint_dir
from .bpe_rounds import choose, cut_words, merge_words
from .counts import SYM_CLOSE, SYM_OPEN, alphabet, pair_counts, symbol_table, top_pairs, word_counts

VOCAB_SCHEMA = "id INT, token STRING, kind STRING"
MERGES_SCHEMA = "rank INT, left STRING, right STRING, merged STRING, n LONG"


@dataclass
class TrainResult:
    vocab: DataFrame      # (id, token, kind)
    merges: DataFrame     # (rank, left, right, merged, n)
    rounds: int
    merge_list: list      # [(left, right, merged, n)] in rank order


MAX_HOT = 4096               # most hot pairs of a round
FIRST_HOT = 64               # hot pairs of the first round
FEW_SEGMENTS = 15_000        # below: the next round takes twice as many hot pairs; above twice this, half
MAX_SEGMENTS = 200_000       # segments, and their characters, one round may collect
MAX_SEGMENT_CHARS = 8_000_000


def _floor(top: list, hot: int, min_frequency: int) -> int | None:
    """Least count of a hot pair, so that at most ``hot`` pairs (or those tied
    at the top) have it and all of them are in ``top``; None: not all are."""
    least = max(min_frequency, 1)
    if len(top) <= hot:
        return least
    floor = top[hot][2] + 1
    if top[0][2] < floor:                     # more ties at the top than hot pairs wanted
        if len(top) > MAX_HOT and top[-1][2] == top[0][2]:
            return None
        floor = top[0][2]
    return max(floor, least)


def _few(counts: DataFrame) -> DataFrame:
    """Summed counts over no more partitions than there are cores: they are
    small, and every task of every round costs the driver its metrics."""
    return counts.coalesce(counts.sparkSession.sparkContext.defaultParallelism)


def _top(words: DataFrame, k: int) -> list:
    """The k most frequent pairs. Collecting a top-k would send the driver the
    k best of every task; behind coalesce(1) an executor merges them."""
    return [(r["l"], r["r"], r["n"]) for r in top_pairs(_few(pair_counts(words)), k).coalesce(1).collect()]


def _segments(words: DataFrame, hot: frozenset):
    """The summed segments as rows, or None when there are too many."""
    segs = _few(words.mapInArrow(cut_words(hot), "seg string, cnt long")
                .groupBy("seg").agg(F.sum("cnt").cast("long").alias("cnt"))).persist()
    try:
        n, chars = segs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("seg")), F.lit(0))).first()
        if n > MAX_SEGMENTS or chars > MAX_SEGMENT_CHARS:
            return None, n
        return [(r.seg, r.cnt) for r in segs.collect()], n
    finally:
        segs.unpersist()


def _round(words: DataFrame, top: list, hot: int, texts: set, room: int, params: TrainParams):
    """(merges of one round, hot pairs of the next one)."""
    while True:
        floor = _floor(top, hot, params.min_frequency)
        if floor is None or top[0][2] < floor:
            break
        pairs = frozenset((a, b) for a, b, n in top if n >= floor)
        segments, n = _segments(words, pairs)
        if segments is not None:
            after = min(MAX_HOT, 2 * hot) if n < FEW_SEGMENTS else max(1, hot // 2) if n > 2 * FEW_SEGMENTS else hot
            return choose(segments, floor, texts, room), after
        if len(pairs) <= 1 or hot <= 1:
            break
        hot = max(1, min(hot, len(pairs)) // 4)
    a, b, n = top[0]
    return [(a, b, a + b, n, a + b not in texts)], max(1, hot)


def train_bpe(spark: SparkSession, lines: DataFrame, line: str = "line",
              params: TrainParams = TrainParams(), batch: bool = True,
              word_table: DataFrame | None = None) -> TrainResult:
    """Train a BPE vocabulary on the lines of a corpus table. ``batch=False``
    commits one merge a round.

    The rounds run with adaptive execution off: their shuffles are already
    shrunk by partial sums, and re-planning every stage costs more than it
    saves. The caller's setting is restored afterwards."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        return _train(spark, lines, line, params, batch, word_table)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _written(words: DataFrame, folder: str, number: int) -> DataFrame:
    words.write.parquet(f"{folder}/{number}")
    return words.sparkSession.read.schema("sym string, cnt long").parquet(f"{folder}/{number}")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _train(spark, lines, line, params, batch, word_table) -> TrainResult:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bpe-{uuid.uuid4().hex}"
    wc = (word_counts(lines, line) if word_table is None else word_table).persist()
    alpha = sorted((r["ch"] for r in alphabet(wc).select("ch").collect()), key=ord)
    texts = set(SPECIAL_TOKENS) | set(alpha)
    room = params.vocab_size - len(SPECIAL_TOKENS) - len(alpha)
    merges, rounds, hot = [], 0, FIRST_HOT
    try:
        words = _written(symbol_table(wc).filter(F.col("sym").contains(SYM_CLOSE + SYM_OPEN)), folder, 0)
        if word_table is None:
            wc.unpersist()
        while room > 0:
            rounds += 1
            top = _top(words, MAX_HOT + 1 if batch else 1)
            if not top or top[0][2] < max(params.min_frequency, 1):
                break
            if batch:
                chosen, hot = _round(words, top, hot, texts, room, params)
            else:
                (a, b, n), = top
                chosen = [(a, b, a + b, n, a + b not in texts)]
            for a, b, merged, n, adds in chosen:
                merges.append((a, b, merged, n))
                texts.add(merged)
                room -= adds
            if room > 0:
                merged_words = words.mapInArrow(merge_words([(a, b) for a, b, *_ in chosen]), "sym string, cnt long")
                words = _written(merged_words, folder, rounds)
                _delete(spark, f"{folder}/{rounds - 1}")
    finally:
        _delete(spark, folder)
    return TrainResult(_vocab_df(spark, alpha, merges), _merges_df(spark, merges), rounds, merges)


def vocab_rows(alpha: list, merges: list) -> list:
    rows = [(i, t, "special") for i, t in enumerate(SPECIAL_TOKENS)]
    rows += [(len(rows) + i, ch, "char") for i, ch in enumerate(alpha)]
    have = {t for _, t, _ in rows}
    for _, _, merged, _ in merges:
        if merged not in have:
            have.add(merged)
            rows.append((len(rows), merged, "merge"))
    return rows


def _vocab_df(spark, alpha, merges):
    return spark.createDataFrame(vocab_rows(alpha, merges), VOCAB_SCHEMA)


def _merges_df(spark, merges):
    return spark.createDataFrame(
        [(i + 1, a, b, m, n) for i, (a, b, m, n) in enumerate(merges)], MERGES_SCHEMA)
