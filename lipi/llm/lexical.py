"""Ranked lexical search, reversed: the items wait, the documents stream by.

1. The items' terms are counted in Spark. Items are dealt into shards by a hash
   of their id so that a shard's inverted index (term -> items and how often)
   has about MAX_POSTINGS entries; only such an index is broadcast.
2. A pass over the documents writes, per document, its number of terms and the
   counts of those terms that some item of the shard has (term numbers and
   counts as two arrays), never its text. It gives N, L and the terms' df.
3. The arrays stream through the index: every term count reaches the items of
   its term, scores add up as 64-bit integers in a documents x items block, and
   per item the best ``top`` are kept: a heap of bounded size, whose worst entry
   is the bar the next block has to pass. A task emits its heaps at its end.
4. Heaps merge in two steps: per item and salt, then per item.

Scores: w(t) = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 100 - B + (B n N) div L
and the sum of w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms,
repeats included, where B = 25. Equal scores go by ascending doc_id.

Defined results: null and empty texts have no terms (such documents count
nowhere, such items return nothing); rows with a null doc_id count in N, L and df
but are not returned; items with a null id are not asked; of rows with one
item_id the smallest text (by its characters) is asked; repeated rows of a
document rank on their own; empty tables give no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alnum import pieces
from .common import discard, staged

TOP = 20
K12, LENGTH = 12, 25     # fixed values of the score: 1000 * k1 / 100, share of the length in percent
MAX_POSTINGS = 500_000   # (item, term) pairs of one broadcast index
BLOCK = 1 << 21          # cells of a documents x items block, and postings met at once
SALTS = 32               # groups whose heaps merge first


def _item_terms(batches):
    for b in batches:
        for item, text in zip(b.column(0).to_pylist(), b.column(1)):
            count = Counter()
            for part in pieces(text.as_py()):
                count.update(part)
            terms, times = list(count), list(count.values())
            for i in range(0, len(terms), 65536):
                n = len(terms[i:i + 65536])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * n, pa.int64()), pa.array(terms[i:i + n], pa.binary()),
                     pa.array(times[i:i + n], pa.int64())], names=["item_id", "term", "qtf"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term binary, qtf): the distinct terms of every item."""
    one = (items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
           .where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text")))
    return one.select("item_id", F.col("text").cast("binary").alias("t")).mapInArrow(
        _item_terms, "item_id long, term binary, qtf long")


class Index:
    """Terms numbered in byte order, items in id order; postings by term."""

    def __init__(self, rows):
        self.items = np.array(sorted({r.item_id for r in rows}), np.int64)
        self.terms = sorted({bytes(r.term) for r in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        t = np.array([number[bytes(r.term)] for r in rows], np.int64)
        i = np.searchsorted(self.items, np.array([r.item_id for r in rows], np.int64))
        q = np.array([r.qtf for r in rows], np.int64)
        order = np.lexsort((i, t))
        self.item, self.qtf = i[order], q[order]
        self.first = np.searchsorted(t[order], np.arange(len(self.terms) + 1))


def _counts(shared):
    """Per document: number of terms, and counts of the index's terms."""
    def run(batches):
        number = {t: i for i, t in enumerate(shared.value)}
        for b in batches:
            n, terms, times = [], [], []
            for text in b.column(1):
                total, got = 0, np.zeros(0, np.int64)
                for part in pieces(text.as_py()):
                    total += len(part)
                    hit = [x for x in map(number.get, part) if x is not None]
                    got = np.concatenate([got, np.array(hit, np.int64)]) if len(got) else np.array(hit, np.int64)
                at, tf = np.unique(got, return_counts=True)
                n.append(total)
                terms.append(at.astype("<u4").tobytes())
                times.append(tf.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())],
                names=["doc_id", "n", "terms", "times"])
    return run


def _holding(n_terms):
    """Documents that hold each term, one partial count per task."""
    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            for blob in b.column(0):
                total[np.frombuffer(blob.as_py(), "<u4")] += 1       # distinct within a document
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])
    return run


class Heaps:
    """Per item the best ``top`` (score downwards, doc_id upwards) met so far."""

    def __init__(self, n_items, top):
        self.top, self.bar = top, np.ones(n_items, np.int64)          # a score below the bar cannot enter
        self.item = np.zeros(0, np.int64)
        self.score, self.doc = self.item, self.item

    def add(self, scores, docs):
        """scores: documents x items."""
        if len(docs) > self.top:
            kth = np.partition(scores, len(docs) - self.top, axis=0)[len(docs) - self.top]
            np.maximum(self.bar, kth, out=self.bar)
        row, item = np.nonzero(scores >= self.bar)
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[row, item[len(self.item):]]])
        doc = np.concatenate([self.doc, docs[row]])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == self.top - 1
        self.bar[item[full]] = np.maximum(self.bar[item[full]], score[full])
        keep = place < self.top
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]


def score_block(first, item, qtf, n_items, weight, row, term, tf, m):
    """documents x items scores from (row, term, tf) triples; m per row."""
    value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + K12 * m[row]))
    out = np.zeros(len(m) * n_items, np.int64)
    size = first[term + 1] - first[term]
    ends, i = np.cumsum(size), 0
    while i < len(term):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, side="right")))
        s = size[i:j]
        where = np.repeat(first[term[i:j]] - (np.cumsum(s) - s), s) + np.arange(s.sum())
        np.add.at(out, np.repeat(row[i:j], s) * n_items + item[where], np.repeat(value[i:j], s) * qtf[where])
        i = j
    return out.reshape(len(m), n_items)


def _search(shared, top, n_docs, all_terms):
    def run(batches):
        index, weight = shared.value
        n_items = len(index.items)
        heaps, step = Heaps(n_items, top), max(1, BLOCK // n_items)
        for b in batches:
            b = b.filter(b.column("doc_id").is_valid())
            docs, n = b.column("doc_id").to_numpy(), b.column("n").to_numpy()
            terms, times = b.column("terms").to_pylist(), b.column("times").to_pylist()
            for i in range(0, b.num_rows, step):
                j = min(b.num_rows, i + step)
                size = np.array([len(x) // 4 for x in terms[i:j]], np.int64)
                m = 100 - LENGTH + (LENGTH * n[i:j] * n_docs) // all_terms
                heaps.add(score_block(
                    index.first, index.item, index.qtf, n_items, weight, np.repeat(np.arange(j - i), size),
                    np.frombuffer(b"".join(terms[i:j]), "<u4").astype(np.int64),
                    np.frombuffer(b"".join(times[i:j]), "<u4").astype(np.int64), m), docs[i:j])
        yield pa.RecordBatch.from_arrays([pa.array(index.items[heaps.item]), pa.array(heaps.doc), pa.array(heaps.score)],
                                         names=["item_id", "doc_id", "score"])
    return run


def merge_heaps(heaps: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the best of all tasks' heaps."""
    best = [F.col("score").desc(), F.col("doc_id")]
    some = heaps.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*best))).where(F.col("rank") <= top)
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best)))
            .where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))


def _one_shard(docs: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    spark = docs.sparkSession
    index = Index(terms.collect())
    vocabulary = spark.sparkContext.broadcast(index.terms)
    counts = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
                    .mapInArrow(_counts(vocabulary), "doc_id long, n long, terms binary, times binary"), "term-counts")
    n_docs, all_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(index.terms), np.int64)
    for r in (counts.select("terms").mapInArrow(_holding(len(df)), "term long, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).collect()):
        df[r.term] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    shared = spark.sparkContext.broadcast((index, weight))
    heaps = counts.where("n > 0").mapInArrow(_search(shared, top, n_docs, max(1, all_terms)),
                                             "item_id long, doc_id long, score long")
    best = staged(merge_heaps(heaps, top), "ranking")
    discard(counts)
    return best


def search(docs: DataFrame, items: DataFrame, top: int = TOP, max_postings: int = MAX_POSTINGS) -> DataFrame:
    """Every item's ``top`` documents: item_id, rank, doc_id, score."""
    terms = staged(item_terms(items), "item-terms")
    n = terms.count()
    if not n:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    shards = -(-n // max_postings)
    out = None
    for s in range(shards):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s)
        if rows.isEmpty():
            continue
        part = _one_shard(docs, rows, top)
        out = part if out is None else out.unionByName(part)
    return out
