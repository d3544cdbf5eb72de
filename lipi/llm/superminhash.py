"""Near duplicates by SuperMinHash, banding, verification and union-find.

Signature. Every element of a document's shingle set has a permutation of
the M slots (Fisher-Yates, driven by its hash); in step j it offers the value
j + r_j (r_j uniform in [0, 1)) to the slot its permutation has at rank j, and
a slot keeps its smallest value. The ranks of one element are correlated (it
meets every slot at another rank), which lowers the variance below that of
independent hashes. A document stops early: once every slot holds a value
below j + 1, later steps cannot change it. All elements of many documents take
a step together in numpy.

Groups. Documents with the same shingle set (128-bit fingerprint of the
sorted set, and its size) are one class. Class representatives are banded
(BANDS x ROWS). In a bucket everything is compared with the bucket's smallest
id first; links are confirmed on the full sets of the texts and joined by
union-find. What is still in different components inside one bucket is
compared in blocks of at most BLOCK x BLOCK signatures, so no task holds a
bucket and no pair within a component is made; only the members of candidate
pairs fetch their texts, and a block reports the links that join components
(a spanning forest), never its pairs. Signatures only rule pairs out that are
more than 0.2 below the threshold (over five standard errors).

Defined results: A-Z are lower-cased; null text counts as empty; a document
without words has n_shingles 0 and is linked with nothing; with fewer than
five words the whole sequence is its one shingle; repeated rows of one doc_id
with the same text are one document (each row comes back); a null doc_id is
never linked (component_id null, kept true); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, discard, parts, shuffled, staged
from .components import components
from .textwords import U, _INV, _BASE, _powers, blocks_of, hash_words, mix, window_hash

K = 5                    # words of a shingle
THRESHOLD = (75, 100)    # links: 100 * intersection >= 75 * union
M = 128                  # slots of a signature
BANDS, ROWS = 32, 4      # a pair of similarity 0.75 is missed with probability 6e-6
BLOCK = 256              # signatures a side of a comparison block
SLACK = 0.2              # estimate this far below the threshold rules a pair out


def shingle_sets(buf, offs, lower=True, k=K):
    """For a block of documents: (document index, shingle hash) sorted by both
    and distinct."""
    h, start, _ = hash_words(buf, lower)
    doc = np.searchsorted(offs, start, side="right") - 1
    n_docs = len(offs) - 1
    count = np.bincount(doc, minlength=n_docs)
    win = window_hash(h, k)
    if len(win):
        same = doc[:len(win)] == doc[k - 1:]
        win, wdoc = win[same], doc[:len(same)][same]
    else:
        wdoc = np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(doc, short)
        val = np.array([int(window_hash(h[f:f + c], int(c))[0]) for f, c in zip(first, count[short])], dtype=np.uint64)
        win, wdoc = np.concatenate([win, val]), np.concatenate([wdoc, short])
    order = np.lexsort((win, wdoc))
    win, wdoc = win[order], wdoc[order]
    if len(win):
        new = np.empty(len(win), dtype=bool)
        new[0] = True
        np.not_equal(win[1:], win[:-1], out=new[1:])
        new[1:] |= wdoc[1:] != wdoc[:-1]
        win, wdoc = win[new], wdoc[new]
    return wdoc, win


ELEMENTS = 1 << 16       # elements of one numpy step (their permutations take M bytes each)


def signatures(doc: np.ndarray, elem: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """n_docs x m SuperMinHash values: (rank << 32) | 32 random bits. Documents
    larger than ELEMENTS are taken in slices, whose signatures join by min."""
    out = np.full((n_docs, m), np.iinfo(np.int64).max, dtype=np.int64)
    i = 0
    while i < len(elem):
        j = min(len(elem), i + ELEMENTS)
        if j < len(elem) and doc[j - 1] == doc[j] and doc[i] != doc[j - 1]:
            j = int(np.searchsorted(doc, doc[j - 1]))
        lo, hi = doc[i], doc[j - 1] + 1
        part = _signature_block(doc[i:j] - lo, elem[i:j], hi - lo, m)
        out[lo:hi] = np.minimum(out[lo:hi], part)
        i = j
    return out


def _signature_block(doc, elem, n_docs, m):
    h = np.full((n_docs, m), np.iinfo(np.int64).max, dtype=np.int64)
    flat = h.ravel()
    perm = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(elem), m)).copy()
    x = elem.copy()
    for j in range(m):
        rnd = mix(x + U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        rows = np.arange(len(x))
        k = j + ((rnd >> U(40)) % U(m - j)).astype(np.int64)     # 24 bits for the swap
        slot = perm[rows, k]
        perm[rows, k] = perm[:, j]
        value = (j << 32) | (rnd & U(0xFFFFFFFF)).astype(np.int64)
        np.minimum.at(flat, doc * m + slot, value)
        # early stop: documents whose slots all hold a value below j + 1
        open_docs = (h.max(axis=1) >> 32) > j
        live = open_docs[doc]
        if not live.all():
            if not live.any():
                break
            doc, x, perm = doc[live], x[live], perm[live]
    return h


_LEFT, _RIGHT = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)


def _sign(batches):
    for b in batches:
        ids, xx = b.column("doc_id"), b.column("xx")
        n = np.zeros(b.num_rows, np.int64)
        f1, f2 = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        sigs = [None] * b.num_rows
        for first, buf, offs in blocks_of(b.column("_bytes")):
            n_docs = len(offs) - 1
            doc, elem = shingle_sets(buf, offs)
            cnt = np.bincount(doc, minlength=n_docs)
            sig = signatures(doc, elem, n_docs)
            a, c = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
            np.add.at(a, doc, mix(elem ^ _LEFT))     # order-free sums over the set
            np.add.at(c, doc, mix(elem ^ _RIGHT))
            n[first:first + n_docs] = cnt
            f1[first:first + n_docs] = a.view(np.int64)
            f2[first:first + n_docs] = c.view(np.int64)
            low = mix(sig.view(np.uint64)).astype(np.uint32)
            for i in np.flatnonzero(cnt):
                sigs[first + i] = low[i].tobytes()
        yield pa.RecordBatch.from_arrays(
            [ids, xx, pa.array(n), pa.array(f1), pa.array(f2), pa.array(sigs, pa.binary())],
            names=["doc_id", "xx", "n_shingles", "f1", "f2", "sig"])


def _bands(batches):
    """One row per band: (band, 64-bit bucket key, doc_id)."""
    for b in batches:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, M)
        ids = b.column("doc_id").to_numpy()
        for lo in range(0, len(sig), 2048):
            key = band_keys(sig[lo:lo + 2048])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(ids[lo:lo + 2048], BANDS))],
                names=["bucket", "doc_id"])


LEAST = (THRESHOLD[0] / THRESHOLD[1] - SLACK) * M    # agreeing slots of a candidate pair


def _estimate(batches):
    """Keep candidate pairs whose signatures do not rule them out."""
    for b in batches:
        if not b.num_rows:
            continue
        a = np.frombuffer(b"".join(b.column("sa").to_pylist()), dtype=np.uint32).reshape(-1, M)
        c = np.frombuffer(b"".join(b.column("sb").to_pylist()), dtype=np.uint32).reshape(-1, M)
        ok = np.flatnonzero((a == c).sum(axis=1) >= LEAST)
        yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(ok)), b.column("b").take(pa.array(ok))],
                                         names=["a", "b"])


def text_set(text: bytes) -> np.ndarray:
    buf = np.frombuffer(text + b" ", dtype=np.uint8)
    return shingle_sets(buf, np.array([0, len(buf)]))[1]


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return bool(both > 0 and THRESHOLD[1] * both >= THRESHOLD[0] * union)


def _verify(batches):
    """Pairs with both texts: keep those whose full shingle sets are linked.
    Rows come sorted by the shared side, whose set is made once."""
    last, lset = None, None
    for b in batches:
        ta, tb = b.column("ta").to_pylist(), b.column("tb").to_pylist()
        keep = []
        for i in range(b.num_rows):
            if ta[i] != last:
                last, lset = ta[i], text_set(ta[i])
            if linked(lset, text_set(tb[i])):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(keep, pa.int64())),
                                          b.column("b").take(pa.array(keep, pa.int64()))], names=["a", "b"])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket key of every band of every signature (n x BANDS)."""
    s = sig.astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.zeros(s.shape[:2], np.uint64)
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + s[:, :, r] + U(1))
    return mix(key ^ (np.arange(BANDS, dtype=np.uint64) << U(56)))


def block_pairs(bucket, side, comp, sig):
    """(i, j, agreeing slots) of a block's left and right rows that are in
    different components, that the signatures do not rule out, and that meet
    in no earlier band (so that a pair is looked at once)."""
    keys = band_keys(sig)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    out = []
    for i in left:
        j = right[(comp[right] != comp[i]) & ((side[i] == 0) | (right > i))]
        if not len(j):
            continue
        agree = (sig[j] == sig[i]).sum(axis=1)
        ok = agree >= LEAST
        j, agree = j[ok], agree[ok]
        first = (keys[j] == keys[i]).argmax(axis=1)
        own = keys[i][first] == np.uint64(bucket % (1 << 64))
        out.extend(zip([i] * int(own.sum()), j[own].tolist(), agree[own].tolist()))
    return out


def _blocks(batches, names):
    """Rows of each (bucket, block pair) of a sorted partition."""
    key, rows = None, []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("bucket", "bi", "bj", *names)]
        for bucket, bi, bj, *row in zip(*cols):
            if (bucket, bi, bj) != key:
                if rows:
                    yield key, rows
                key, rows = (bucket, bi, bj), []
            rows.append(row)
    if rows:
        yield key, rows


def _arrays(rows):
    side, comp = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], dtype=np.int64)
    return side, comp, np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint32).reshape(-1, M)


def _open_members(batches):
    """The rows of a block that are in any candidate pair (not the pairs)."""
    for (bucket, bi, bj), rows in _blocks(batches, ("side", "doc_id", "comp", "sig")):
        if len(rows) < 2:
            continue
        side, comp, sig = _arrays(rows)
        used = sorted({x for i, j, _ in block_pairs(bucket, side, comp, sig) for x in (i, j)})
        if used:
            n = len(used)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * n, pa.int64()) for v in (bucket, bi, bj)]
                + [pa.array([rows[x][0] for x in used], pa.int32())]
                + [pa.array([rows[x][c] for x in used], pa.int64()) for c in (1, 2)]
                + [pa.array([rows[x][3] for x in used], pa.binary())],
                names=["bucket", "bi", "bj", "side", "doc_id", "comp", "sig"])


def _confirm(batches):
    """Candidate pairs of a block on their full sets, most alike first; pairs
    that union-find has joined meanwhile are skipped."""
    for (bucket, _, _), rows in _blocks(batches, ("side", "doc_id", "comp", "sig", "_bytes")):
        if len(rows) < 2:
            continue
        side, comp, sig = _arrays(rows)
        up: dict = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x
        sets: dict = {}
        out_a, out_b = [], []
        for i, j, _ in sorted(block_pairs(bucket, side, comp, sig), key=lambda p: -p[2]):
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x == y:
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = text_set(rows[k][4])
            if linked(sets[i], sets[j]):
                up[max(x, y)] = min(x, y)
                out_a.append(rows[i][1])
                out_b.append(rows[j][1])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bytes"))
    signed = staged(raw.select("doc_id", F.xxhash64("_bytes").alias("xx"), "_bytes").mapInArrow(
        _sign, "doc_id long, xx long, n_shingles long, f1 long, f2 long, sig binary"), "signed")
    key = ["n_shingles", "f1", "f2"]
    able = signed.where("n_shingles > 0 and doc_id is not null")
    # one representative of every distinct shingle set
    reps = staged(able.groupBy(*key).agg(F.min(F.struct("doc_id", "xx", "sig")).alias("m"))
                  .select(*key, "m.doc_id", "m.xx", "m.sig"), "representatives")
    band = reps.select("doc_id", "sig").mapInArrow(_bands, "bucket long, doc_id long")
    full = band.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    inside = staged(band.join(apart(full.select("bucket", "pivot")), "bucket"), "buckets")
    sig = reps.select(F.col("doc_id"), "sig")

    def with_sigs(pairs):
        return (shuffled(pairs).join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a")
                .join(shuffled(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))), "b"))

    def texts_of(ids):
        wanted = ids.distinct().join(shuffled(reps.select("doc_id", "xx")), "doc_id")
        return staged(raw.select("doc_id", F.xxhash64("_bytes").alias("xx"), "_bytes")
                      .join(shuffled(wanted), ["doc_id", "xx"], "left_semi")
                      .dropDuplicates(["doc_id", "xx"]).select("doc_id", "_bytes"), "texts")

    def verified(pairs, name):
        texts = texts_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))))
        both = (shuffled(pairs).join(texts.select(F.col("doc_id").alias("b"), F.col("_bytes").alias("tb")), "b")
                .join(shuffled(texts.select(F.col("doc_id").alias("a"), F.col("_bytes").alias("ta"))), "a")
                .sortWithinPartitions("a"))
        out = staged(both.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long"), name)
        discard(texts)
        return out

    first = inside.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    cand1 = staged(with_sigs(first).select("a", "b", "sa", "sb").mapInArrow(_estimate, "a long, b long"), "pivot_pairs")
    links = verified(cand1, "pivot_links")
    comp = staged(components(links), "pivot_components")
    # buckets that still hold several components
    placed = inside.join(shuffled(comp.withColumnRenamed("node", "doc_id")), "doc_id", "left").select(
        "bucket", "doc_id", F.coalesce("component_id", "doc_id").alias("comp"), "pivot")
    mixed = (placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                          F.count("*").alias("n")).where("lo <> hi").select("bucket", "n"))
    main = placed.where("doc_id = pivot").select("bucket", F.col("comp").alias("main"))
    open_rows = staged(placed.drop("pivot").join(apart(mixed.join(shuffled(main), "bucket")), "bucket"), "mixed")
    others = open_rows.groupBy("bucket").agg(F.sum((F.col("comp") != F.col("main")).cast("long")).alias("no"))
    sized = (open_rows.join(apart(others), "bucket").select(
        "bucket", "doc_id", "comp", (F.col("comp") == F.col("main")).alias("is_main"),
        F.ceil((F.col("n") - F.col("no")) / BLOCK).alias("bm"), F.ceil(F.col("no") / BLOCK).alias("bo")))
    mine = F.pmod(F.xxhash64("doc_id"), F.when(F.col("is_main"), F.col("bm")).otherwise(F.col("bo")))
    mine = mine + F.when(F.col("is_main"), F.lit(0)).otherwise(F.col("bm"))
    # a main row meets every other block; an other row meets every block
    meets = F.when(F.col("is_main"), F.sequence(F.col("bm"), F.col("bm") + F.col("bo") - 1)).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("bm") + F.col("bo") - 1))
    spread = (sized.withColumn("mine", mine).withColumn("other", F.explode(meets))
              .select("bucket", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"),
                      F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0)
                      .otherwise(1).alias("side"), "doc_id", "comp"))
    dealt = (spread.join(shuffled(sig), "doc_id").repartition(parts(docs.sparkSession), "bucket", "bi", "bj")
             .sortWithinPartitions("bucket", "bi", "bj"))
    members = staged(dealt.select("bucket", "bi", "bj", "side", "doc_id", "comp", "sig").mapInArrow(
        _open_members, "bucket long, bi long, bj long, side int, doc_id long, comp long, sig binary"), "open_members")
    texts = texts_of(members.select("doc_id"))
    again = (members.join(shuffled(texts), "doc_id").repartition(parts(docs.sparkSession), "bucket", "bi", "bj")
             .sortWithinPartitions("bucket", "bi", "bj"))
    links2 = staged(again.select("bucket", "bi", "bj", "side", "doc_id", "comp", "sig", "_bytes")
                    .mapInArrow(_confirm, "a long, b long"), "cross_links")
    # class members follow their representative
    final = components(comp.select(F.col("node").alias("a"), F.col("component_id").alias("b")).union(links2))
    rep_comp = (reps.select(*key, F.col("doc_id").alias("rep")).join(
        apart(final.withColumnRenamed("node", "rep")), "rep", "left")
        .select(*key, F.coalesce("component_id", "rep").alias("component_id")))
    return (signed.select("doc_id", *key).join(shuffled(rep_comp), key, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.expr("doc_id <=> component_id")))
