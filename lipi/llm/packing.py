"""Harmonic packing of documents into fixed-length training sequences.

A piece of length r belongs to the reciprocal-capacity class k = floor(C / r):
k such pieces fit one sequence, and every sequence of the class holds exactly
k. A document is cut into full sequences (class 1) and a rest; the rest is
cut at powers of two (lengths C / k, no padding) until what is left fills k
times all but SLACK tokens of a sequence. So a sequence is padded by at most
SLACK tokens.

Workers fill their classes independently: each numbers its pieces per class,
and only the counts per (worker, class) meet, so a piece's sequence is its
rank in the class divided by k. The last, incomplete sequence of each class
(fewer than C * (1 + ln C) pieces in all, whatever the corpus) is packed anew
by first-fit decreasing.

Defined results: null text counts as empty (it still has its end id); an
empty table gives no rows; repeated rows and null ids are packed like any
other; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .tokens import text_groups, tokenizer_path, word_tokenizer

CAPACITY = 1024
SLACK = 8
END_ID = 0


def cut(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list:
    """(piece length, pieces per sequence) of a document; capacity is a power
    of two."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack:
            out.append((rest, k))
            break
        p = 1 << (rest.bit_length() - 1)
        out.append((p, capacity // p))
        rest -= p
    return out


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int, pid int, rank long"


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenised documents cut into pieces, numbered per worker and class."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        seen: dict = {}
        tok = word_tokenizer(path)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, group in text_groups(texts):
                rows = []
                for d, enc in zip(ids[first:first + len(group)], tok.encode(group)):
                    enc += end
                    n, start = len(enc) // 4, 0
                    for length, k in cut(n, capacity):
                        part = enc[4 * start:4 * (start + length)]
                        rank = seen.get(k, 0)
                        seen[k] = rank + 1
                        rows.append((d, start, length, zlib.crc32(part), n, k, pid, rank)
                                    + ((part,) if with_ids else ()))
                        start += length
                cols = list(zip(*rows))
                types = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "pid", "rank"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECE + (", ids binary" if with_ids else ""))


def first_fit(tail: pa.Table, capacity: int) -> pa.Table:
    """First-fit decreasing over the bounded tail."""
    tail = tail.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
    fill: list = []
    seq, off = [], []
    for n in tail["length"].to_pylist():
        i = next((i for i, f in enumerate(fill) if f + n <= capacity), len(fill))
        if i == len(fill):
            fill.append(0)
        seq.append(i)
        off.append(fill[i])
        fill[i] += n
    seq = np.array(seq, dtype="i8") + tail["full"].to_numpy()
    return tail.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off, pa.int64()))


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids, if asked for)."""
    cutted = staged(pieces(docs, path or tokenizer_path(), id_col, text_col, capacity, end_id, with_ids), "pieces")
    per = cutted.groupBy("k", "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("k").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("k", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most `capacity` classes: a bounded table
    total = per.groupBy("k").agg(F.sum("n").alias("total"))
    bins = F.floor(F.col("total") / F.col("k"))
    order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("k", "total", F.coalesce(F.sum(bins).over(order), F.lit(0)).alias("first_seq"),
                         F.sum(bins).over(Window.partitionBy(F.lit(0))).alias("full"))
    placed = (cutted.join(base, ["k", "pid"]).join(F.broadcast(total), "k")
              .withColumn("g", F.col("base") + F.col("rank"))
              .withColumn("bin", F.floor(F.col("g") / F.col("k"))))
    whole = (F.col("bin") + 1) * F.col("k") <= F.col("total")
    extra = ["ids"] if with_ids else []
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    seq = (F.col("first_seq") + F.col("bin")).alias("sequence_id")
    full = placed.where(whole)
    single = full.where("k = 1").select(*out, seq, F.lit(0).cast("long").alias("offset"), *extra)
    in_bin = Window.partitionBy("sequence_id").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    several = (full.where("k > 1").select(*out, seq, "g", *extra)
               .select(*out, "sequence_id", F.coalesce(F.sum("length").over(in_bin), F.lit(0)).alias("offset"), *extra))
    tail = placed.where(~whole).select(*out, "full", *extra)
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + (", ids binary" if with_ids else ""))
    packed = (tail.groupBy("full").applyInArrow(
        lambda rows: first_fit(rows, capacity).select(out + ["sequence_id", "offset"] + extra), schema))
    return single.union(several).union(packed)
