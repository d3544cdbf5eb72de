"""Target-distribution importance resampling.

Weights. A document's features are all runs of 1 to max_n consecutive words,
each hashed (crc32 of its UTF-8 bytes) into one of ``buckets`` buckets. One pass
over the texts writes every document's buckets as one array; summing them gives
the two histograms (corpus and target), from which an array of gains follows:
gain[b] = floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))). A
document's weight is the sum of gain[its array], a numpy gather per batch; the
texts are not read again.

Draw. score = weight + floor(Gumbel noise * 1000), the noise keyed by doc_id, so
the highest scores are a draw without replacement in proportion to
exp(weight / 1000). The cutoff is found by a quantile sketch: it names a bracket
of scores around the wanted quantile; exact counts above and inside the bracket
validate it, and it is widened until the cutoff lies inside. Only the bracket's
rows are sorted to find the cutoff, and only the drawn rows to number them, both
by range partitions.

What reaches the driver: the two histograms (``buckets`` numbers each), two
quantiles, counts, and the cutoff.

Defined results: null and empty texts have no features and weight 0; a null
doc_id is counted in the histograms but never drawn (score and rank null) and
not part of N; repeated rows are documents of their own (rows equal in all
columns are numbered in no stated order); an empty table gives no rows, an empty
target an all-smoothed one. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alnum import pieces
from .common import discard, staged
from .ordering import ranked

MAX_N = 1                # words of the longest feature
BUCKETS = 10000
SEED = "2024"
PERCENT = 10             # of the documents with MIN_WORDS words and more
MIN_WORDS = 20
SPREAD = 0.005           # half width of the first bracket, as a share of the documents
ACCURACY = 10000         # of the sketch: a rank is off by N / ACCURACY at most
CACHE, CACHE_BYTES = 1 << 18, 64   # words whose bucket a worker remembers, and their longest
SLICE = 1 << 20          # features gathered at once


class _Buckets(dict):
    """Feature -> bucket, filled on demand; forgets all when it is full."""

    def __init__(self, buckets):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature):
        b = crc32(feature) % self.buckets
        if len(feature) <= CACHE_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[feature] = b
        return b


def _dtype(buckets):
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _features(max_n, buckets):
    """One row per document: its words, features and their buckets."""
    kind = _dtype(buckets)

    def run(batches):
        known = _Buckets(buckets)
        for b in batches:
            n_words, n_features, arrays = [], [], []
            for text in b.column(1):
                words, got, tail = 0, [], []
                for part in pieces(text.as_py()):
                    words += len(part)
                    got.append(np.fromiter(map(known.__getitem__, part), kind, len(part)))
                    run_on = tail + part
                    for n in range(2, max_n + 1):
                        first = max(0, len(tail) - n + 1)        # runs that end in this piece
                        joined = [b" ".join(run_on[i:i + n]) for i in range(first, len(run_on) - n + 1)]
                        got.append(np.fromiter(map(known.__getitem__, joined), kind, len(joined)))
                    tail = run_on[-(max_n - 1):] if max_n > 1 else []
                n_words.append(words)
                n_features.append(sum(map(len, got)))
                arrays.append(b"".join(x.tobytes() for x in got))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                 pa.array(arrays, pa.binary())], names=["doc_id", "n_words", "n_features", "b"])
    return run


def features(docs: DataFrame, id_col: str, text_col: str, max_n: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, b binary: the buckets of all features)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(
        _features(max_n, buckets), "doc_id long, n_words long, n_features long, b binary")


def _slices(batch, kind):
    """(first row, row count, features joined, their number per row)."""
    n, blobs, i = batch.column("n_features").to_numpy(), batch.column("b").to_pylist(), 0
    ends = np.cumsum(n)
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, side="right")))
        yield i, j, np.frombuffer(b"".join(blobs[i:j]), kind), n[i:j]
        i = j


def _histogram(buckets):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, flat, _ in _slices(b, _dtype(buckets)):
                total += np.bincount(flat, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    return run


def histogram(arrays: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows; one partial histogram per task."""
    got = (arrays.select("n_features", "b").mapInArrow(_histogram(buckets), "bucket long, n long")
           .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in got:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weigh(gain):
    def run(batches):
        for b in batches:
            weight = np.zeros(b.num_rows, np.int64)
            for i, j, flat, n in _slices(b, _dtype(len(gain))):
                run_on = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[flat])])
                ends = np.cumsum(n)
                weight[i:j] = run_on[ends] - run_on[ends - n]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), b.column("n_features"), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"])
    return run


def noisy(weight, doc_id, seed: str):
    """weight plus keyed Gumbel noise, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), doc_id.cast("string")), 256), 1, 8), 16, 10)
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def cutoff(pool: DataFrame, k: int, n: int, spread: float = SPREAD):
    """(score, doc_id) of the k-th row of pool by score downwards, then doc_id;
    pool has n rows, 1 <= k <= n. A second value gives the brackets tried."""
    tried = []
    while True:
        q = 1 - k / n
        lo, hi = pool.agg(F.percentile_approx(
            "score", [max(0.0, q - spread), min(1.0, q + spread)], ACCURACY).alias("q")).first().q
        if spread >= 1:                               # the whole range, whatever the sketch said
            lo, hi = pool.agg(F.min("score"), F.max("score")).first()
        inside = F.col("score").between(lo, hi)
        above, within = pool.agg(F.count_if(F.col("score") > hi), F.count_if(inside)).first()
        tried.append((lo, hi, above, within))
        if above < k <= above + within:
            break
        spread *= 4
    place = ranked(pool.where(inside).select("score", "doc_id"), F.col("score").desc(), F.col("doc_id"))
    return place.where(F.col("rank") == k - above).select("score", "doc_id").first(), tried


def resample(docs: DataFrame, target: DataFrame, *, max_n: int = MAX_N, buckets: int = BUCKETS, seed: str = SEED,
             percent: int = PERCENT, min_words: int = MIN_WORDS, spread: float = SPREAD) -> DataFrame:
    """One row per document (doc_id, text) of docs: doc_id, n_words, n_features,
    weight, score and rank (1.. of the drawn, else null). target: (item_id, text)."""
    corpus = staged(features(docs, "doc_id", "text", max_n, buckets), "buckets")
    gain = gains(histogram(corpus, buckets), histogram(features(target, "item_id", "text", max_n, buckets), buckets))
    scored = staged(corpus.mapInArrow(_weigh(gain), "doc_id long, n_words long, n_features long, weight long")
                    .withColumn("score", noisy(F.col("weight"), F.col("doc_id"), seed)), "scored")
    discard(corpus)
    able = F.coalesce((F.col("n_words") >= min_words) & F.col("doc_id").isNotNull(), F.lit(False))
    n = scored.where(able).count()
    k = percent * n // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    last, _ = cutoff(scored.where(able), k, n, spread)
    drawn = able & ((F.col("score") > last.score) | ((F.col("score") == last.score) & (F.col("doc_id") <= last.doc_id)))
    order = ranked(scored.where(drawn), F.col("score").desc(), *[F.col(c) for c in ("doc_id", "weight", "n_features", "n_words")])
    return order.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).unionByName(
        scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, order: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id was drawn, with all their columns."""
    keys = order.where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(keys.hint("merge"), docs["doc_id"] == keys["_drawn"], "left_semi")
