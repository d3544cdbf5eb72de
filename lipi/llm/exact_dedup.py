"""Exact duplicates by composable polynomial fingerprints.

A text's bytes b_0..b_{n-1} hash to sum((b_i + 1) * B^(n-1-i)) mod p for four
bases B (p = 2^31 - 1). Hashes compose: H(xy) = H(x) * B^len(y) + H(y), so
chunks hash on their own and combine by length-shifted arithmetic, inside a
task for ordinary texts and across tasks for huge ones (their chunk hashes
are shifted by the known bytes behind them and simply summed).

Equal fingerprints are only candidates: the texts of such groups are dealt
out by (fingerprint, salt), at most ``FAN`` rows a salt, sorted, and streamed
past the leaders of their run with a chunkwise byte comparison. Each salt's
leaders meet in the next, FAN times smaller level, so no task ever holds a
group, whatever its size.

Defined results: null text counts as empty and empty texts are equal to each
other; nothing is normalised; rows are never dropped; repeated rows (same id
and text) count in group_size and each come back; a null doc_id is smaller
than any other (its group keeps a non-null one); rows of one doc_id with
different texts stay apart; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, batches_of, parts, shuffled, staged

P = (1 << 31) - 1
BASES = (1000003, 48271 * 7919 % P, 16777619, 69621 * 104729 % P)
CHUNK = 1 << 16          # bytes hashed or compared at once
HUGE = 1 << 23           # a text of more bytes is hashed by several tasks
BATCH = 1 << 21          # bytes of texts passed to Python at once
FAN = 512                # rows of one fingerprint streamed by one task


def _powers(base: int) -> np.ndarray:
    out = np.ones(CHUNK, dtype=np.uint64)
    done = 1
    while done < CHUNK:
        step = min(done, CHUNK - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, P)) % np.uint64(P)
        done += step
    return out[::-1].copy()


_POW: list = []


def _tables() -> list:
    if not _POW:
        _POW.extend(_powers(b) for b in BASES)
    return _POW


def chunk_hash(chunk) -> list:
    """Four hashes of at most CHUNK bytes. (b + 1) * power < 2^40, so a whole
    chunk sums below 2^56 without a reduction."""
    a = np.frombuffer(chunk, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return [int(np.dot(a, t[CHUNK - len(a):])) % P for t in _tables()]


def combine(left: list, right: list, right_len: int) -> list:
    """Hash of a concatenation from the hashes of its two sides."""
    return [(x * pow(b, right_len, P) + y) % P for x, y, b in zip(left, right, BASES)]


def shifted(h: list, bytes_behind: int) -> list:
    return [x * pow(b, bytes_behind, P) % P for x, b in zip(h, BASES)]


def fingerprint(data) -> list:
    """Hash of a byte string, chunk by chunk."""
    view, h = memoryview(data), [0] * len(BASES)
    for i in range(0, len(view), CHUNK):
        part = view[i:i + CHUNK]
        h = combine(h, chunk_hash(part), len(part))
    return h


def _pack(h: list) -> tuple:
    return (h[0] << 31) | h[1], (h[2] << 31) | h[3]


def _hash_rows(batches):
    for b in batches:
        fps = [_pack(fingerprint(x.as_buffer())) for x in b.column("_bytes")]
        cols = [c for i, c in enumerate(b.columns) if b.schema.names[i] != "_bytes"]
        yield pa.RecordBatch.from_arrays(
            cols + [pa.array([f[0] for f in fps], pa.int64()), pa.array([f[1] for f in fps], pa.int64())],
            names=[n for n in b.schema.names if n != "_bytes"] + ["f1", "f2"])


def _hash_chunks(batches):
    for b in batches:
        hs = [shifted(chunk_hash(x.as_buffer()), y) for x, y in
              zip(b.column("_bytes"), b.column("behind").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("xx"), b.column("n_bytes"), b.column("text_sha256"), b.column("mult")]
            + [pa.array([h[k] for h in hs], pa.int64()) for k in range(len(BASES))],
            names=["doc_id", "xx", "n_bytes", "text_sha256", "mult"] + [f"h{k}" for k in range(len(BASES))])


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 huge: int = HUGE) -> DataFrame:
    """doc_id, xx (64-bit identity of the text, to find a row's text again),
    n_bytes, text_sha256, f1, f2: one row per input row."""
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), _bytes(F.col(text_col)).alias("_bytes"))
    rows = raw.select("doc_id", F.xxhash64("_bytes").alias("xx"),
                      F.octet_length("_bytes").cast("long").alias("n_bytes"),
                      F.sha2("_bytes", 256).alias("text_sha256"), "_bytes")
    schema = "doc_id long, xx long, n_bytes long, text_sha256 string, f1 long, f2 long"
    small = rows.where(F.octet_length("_bytes") <= huge).mapInArrow(_hash_rows, schema)
    # a huge text becomes chunk rows dealt over the cluster; repeats of a row are
    # told apart by mult (how often the same id and text occur)
    big = (rows.where(F.octet_length("_bytes") > huge)
           .groupBy("doc_id", "xx", "n_bytes", "text_sha256")
           .agg(F.count("*").alias("mult"), F.first("_bytes").alias("_bytes")))
    n = F.col("n_bytes")
    chunk = (big.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / CHUNK))))
             .select("doc_id", "xx", "n_bytes", "text_sha256", "mult",
                     F.greatest(n - (F.col("k") + 1) * CHUNK, F.lit(0).cast("long")).alias("behind"),
                     F.substr("_bytes", (F.col("k") * CHUNK + 1).cast("int"), F.lit(CHUNK)).alias("_bytes"))
             .repartition(parts(docs.sparkSession)))
    hashed = chunk.mapInArrow(_hash_chunks, "doc_id long, xx long, n_bytes long, text_sha256 string, mult long, "
                              + ", ".join(f"h{k} long" for k in range(len(BASES))))
    whole = (hashed.groupBy("doc_id", "xx", "n_bytes", "text_sha256", "mult")
             .agg(*[(F.sum(f"h{k}") % P).alias(f"h{k}") for k in range(len(BASES))])
             .select("doc_id", "xx", "n_bytes", "text_sha256",
                     (F.shiftleft("h0", 31) + F.col("h1")).alias("f1"),
                     (F.shiftleft("h2", 31) + F.col("h3")).alias("f2"),
                     F.explode(F.sequence(F.lit(1).cast("long"), F.col("mult"))).alias("_r")).drop("_r"))
    return small.union(whole)


def same_bytes(a, b) -> bool:
    """Chunkwise comparison; stops at the first chunk that differs."""
    if len(a) != len(b):
        return False
    va, vb = memoryview(a).cast("B"), memoryview(b).cast("B")  # compared as unsigned bytes
    return all(va[i:i + CHUNK] == vb[i:i + CHUNK] for i in range(0, len(va), CHUNK))


def _stream_compare(batches):
    """Rows sorted by fingerprint: each is compared with the leaders of its
    run (one, unless fingerprints collide) and names the leader it equals.
    A leader's own row carries its text on to the next level."""
    run, leaders = None, []
    for b in batches:
        f1, f2, n, ids, xx = (b.column(c).to_pylist() for c in ("f1", "f2", "n_bytes", "doc_id", "xx"))
        texts = b.column("_bytes")
        lead_id, lead_xx, keep = [], [], []
        for i in range(len(ids)):
            key = (f1[i], f2[i], n[i])
            if key != run:
                run, leaders = key, []
            t = texts[i].as_buffer()
            hit = next((x for x in leaders if same_bytes(x[2], t)), None)
            if hit is None:
                hit = (ids[i], xx[i], t.to_pybytes())
                leaders.append(hit)
                keep.append(hit[2])
            else:
                keep.append(None)
            lead_id.append(hit[0])
            lead_xx.append(hit[1])
        yield pa.RecordBatch.from_arrays(
            [b.column(c) for c in ("f1", "f2", "n_bytes", "cnt", "doc_id", "xx")]
            + [pa.array(lead_id, pa.int64()), pa.array(lead_xx, pa.int64()), pa.array(keep, pa.binary())],
            names=["f1", "f2", "n_bytes", "cnt", "doc_id", "xx", "lead_id", "lead_xx", "_bytes"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 huge: int = HUGE, fan: int = FAN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    spark = docs.sparkSession
    with batches_of(spark, BATCH):
        fps = staged(fingerprints(docs, id_col, text_col, huge), "fingerprints")
    key = ["f1", "f2", "n_bytes"]
    # identical (id, text) rows compare once; null ids need a value to join on
    nid = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = (fps.select(*key, nid.alias("doc_id"), "xx").distinct())
    many = rows.groupBy(*key).agg(F.count("*").alias("cnt")).where("cnt > 1")
    members = staged(rows.join(apart(many), key), "candidates")
    most = members.agg(F.max("cnt")).first()[0]
    if most is None:
        return fps.select("doc_id", F.col("doc_id").alias("keep_id"),
                          F.count("*").over(_same_row()).alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    text = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
                       _bytes(F.col(text_col)).alias("_bytes")).select("doc_id", F.xxhash64("_bytes").alias("xx"), "_bytes")
    text = text.join(shuffled(members.select("doc_id", "xx", *key, "cnt")), ["doc_id", "xx"]).where(
        F.octet_length("_bytes") == F.col("n_bytes"))
    schema = ("f1 long, f2 long, n_bytes long, cnt long, doc_id long, xx long, "
              "lead_id long, lead_xx long, _bytes binary")
    level, roots, level_no = text, None, 0
    while True:
        salts = F.ceil(F.col("cnt") / float(fan ** (level_no + 1)))
        dealt = (level.select(*key, "cnt", "doc_id", "xx", "_bytes",
                              F.pmod(F.xxhash64("doc_id", "xx", F.lit(level_no)), salts).alias("salt"))
                 .repartition(parts(spark), *key, "salt").sortWithinPartitions(*key, "salt"))
        with batches_of(spark, BATCH):
            seen = staged(dealt.select(*key, "cnt", "doc_id", "xx", "_bytes").mapInArrow(_stream_compare, schema), "compared")
        link = seen.select("doc_id", "xx", "lead_id", "lead_xx")
        if roots is None:
            roots = link
        else:
            up = link.select(F.col("doc_id").alias("lead_id"), F.col("xx").alias("lead_xx"),
                             F.col("lead_id").alias("top_id"), F.col("lead_xx").alias("top_xx"))
            roots = roots.join(up, ["lead_id", "lead_xx"]).select(
                "doc_id", "xx", F.col("top_id").alias("lead_id"), F.col("top_xx").alias("lead_xx"))
        if math.ceil(most / float(fan ** (level_no + 1))) <= 1:
            break
        level, level_no = seen.where("_bytes is not null"), level_no + 1
    flat = (fps.withColumn("nid", nid).join(
        apart(roots.select(F.col("doc_id").alias("nid"), "xx", "lead_id", "lead_xx").distinct()), ["nid", "xx"], "left")
        .select("doc_id", "text_sha256", F.coalesce("lead_id", "nid").alias("lead_id"),
                F.coalesce("lead_xx", "xx").alias("lead_xx"),
                *key))
    group = flat.groupBy("lead_id", "lead_xx", *key).agg(F.max("doc_id").alias("keep_id"),
                                                         F.count("*").alias("group_size"))
    return flat.join(apart(group), ["lead_id", "lead_xx", *key]).select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def _same_row():
    from pyspark.sql import Window
    return Window.partitionBy("doc_id", "xx")
