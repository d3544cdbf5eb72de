"""Nearest vectors by inner product, along shifted Hilbert curves.

1. Vectors with the same bytes are one node; it carries its smallest ids, as
   many as one answer can hold, so a vector repeated a million times is one row.
2. Largest inner product becomes smallest distance by one more dimension: with M
   the largest length, a candidate x is the point (x / M, sqrt(1 - |x / M|^2)) and
   a query q the point (q / |q|, 0).
3. A sample of at most SAMPLE nodes (those of smallest hash) gives the principal
   directions. Each of CURVES orderings projects the points onto DIMS random
   directions within them, shifts the grid of 2^BITS cells a side by a random
   offset and reads the cell's place on the Hilbert curve.
4. Spark range-partitions and sorts all points by (curve, vector length, place);
   each sorted partition is cut into blocks of BLOCK candidates, numbered along
   the curve. A query belongs to the block it falls in.
5. Windows. A query is sent to the blocks at most ``radius`` blocks away, and
   their candidates are ranked by exact inner products; only those that beat the
   worst of the query's list so far come back. Lists of all curves merge. Then
   the window grows to the next ring of blocks, until the audit is passed.
6. Audit. At most AUDIT queries (those of smallest hash) were compared with all
   nodes before. When TARGET of their nearest were found, the growing ends. A
   window as long as its curve holds all candidates, so the loop also ends there,
   exact: once the windows of all curves together would be dearer than that, the
   first curve alone grows.

Scores are products in double precision, added from the first component to the
last, on the original vectors.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor does a null vec_id; vectors meet only vectors of
their own length; of rows with one vec_id the smallest vector (in byte order)
counts; copies of a query under another id are candidates; an empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, parts, staged

TOP = 20
CURVES, DIMS, BITS = 4, 10, 6      # orderings; directions and bits a direction of a place (60 bits)
BLOCK = 1024                       # candidates of a block
SAMPLE, AUDIT = 8192, 256
TARGET = 0.95                      # share of the audited nearest that must be found
_ROWS = 4096                       # points projected at once
_ASK = 512                         # queries compared with a block at once


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of cells (n x dims, values below
    2^bits; dims * bits <= 62).

    Along the bits from the top, a set bit reflects the lower bits of the first
    axis, a clear one swaps them with the first axis; the Gray code of what is
    left, bits interleaved over the axes, is the place."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for axis in range(dims):
            reflect = (x[axis] & bit) != 0
            swap = np.where(reflect, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(reflect, low, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            place = place << 1 | (x[axis] >> level & 1)
    return place


def _matrix(blobs, width):
    x = np.frombuffer(b"".join(blobs), "<f8" if width == 8 else "<f4").astype(np.float64)
    return x.reshape(len(blobs), -1)


def _lengths(x):
    big = np.abs(x).max(axis=1, keepdims=True)
    return big[:, 0] * np.sqrt(((x / big) ** 2).sum(axis=1))


def points(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Rows lifted by one dimension: nearest point = largest inner product."""
    if query:
        return np.hstack([x / _lengths(x)[:, None], np.zeros((len(x), 1))])
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])


class Curve:
    """One ordering: random directions within the principal ones, and a shift."""

    def __init__(self, seed, sample):
        rng = np.random.default_rng([seed, sample.shape[1]])
        self.mean = sample.mean(axis=0)
        x = sample - self.mean
        spread, axes = np.linalg.eigh(x.T @ x)
        part = np.cumsum(spread[::-1]) / max(spread.sum(), 1e-300)
        n = min(x.shape[1], max(DIMS, int(np.searchsorted(part, 0.9)) + 1))
        axes = axes[:, ::-1][:, :n]
        self.dims = min(DIMS, n)
        self.directions = axes @ np.linalg.qr(rng.standard_normal((n, self.dims)))[0]
        y = np.abs(x @ self.directions)
        self.reach = max(float(np.quantile(y, 0.999)) if y.size else 0.0, 1e-12)
        self.shift = rng.uniform(0, 1, self.dims)

    def places(self, p):
        y = (p - self.mean) @ self.directions / self.reach        # mostly within [-1, 1]
        cells = np.floor(((y + 1) / 3 + self.shift / 3) * (1 << BITS))
        return hilbert_places(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def curves_of(samples: dict) -> dict:
    """length -> the curves fitted on its sampled points."""
    return {d: [Curve(c, s) for c in range(CURVES)] for d, s in samples.items()}


def _pack(width):
    kind = "<f8" if width == 8 else "<f4"

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1):
                a = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    a = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    a = a + a.dtype.type(0)                       # -0.0 and 0.0 are one value
                out.append(a.tobytes() if a is not None and np.isfinite(a).all() and np.any(a) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "bin"])
    return run


def nodes_of(vectors: DataFrame, top: int) -> tuple[DataFrame, int]:
    """(node long, ids array<long>, bin binary): distinct vectors, their smallest
    id and their smallest top + 1 ids; and the bytes of a component."""
    width = 8 if vectors.schema["embedding"].dataType.elementType.typeName() == "double" else 4
    one = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
           .mapInArrow(_pack(width), "vec_id long, bin binary").groupBy("vec_id").agg(F.min("bin").alias("bin"))
           .where("bin is not null"))
    place = F.row_number().over(Window.partitionBy("bin").orderBy("vec_id"))      # cut before the shuffle
    few = one.withColumn("place", place).where(F.col("place") <= top + 1)
    return few.groupBy("bin").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("node"), "ids", "bin"), width


def _place_rows(width, curves, longest):
    """Every point once per curve: its place."""
    def run(batches):
        for b in batches:
            blobs, ids = b.column("bin").to_pylist(), b.column("id").to_numpy()
            asks = b.column("query").to_numpy(zero_copy_only=False)
            sizes = np.array([len(x) for x in blobs], np.int64)
            for size in np.unique(sizes):
                for ask in (False, True):
                    at = np.flatnonzero((sizes == size) & (asks == ask))
                    for lo in range(0, len(at), _ROWS):
                        sel = at[lo:lo + _ROWS]
                        part = [blobs[i] for i in sel]
                        p = points(_matrix(part, width), longest, ask)
                        fitted = curves.get(p.shape[1]) or curves_of({p.shape[1]: np.eye(p.shape[1])})[p.shape[1]]
                        for c, curve in enumerate(fitted):
                            n = len(sel)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([c] * n, pa.int32()), pa.array([int(size)] * n, pa.int32()),
                                 pa.array(curve.places(p)), pa.array(ids[sel]), pa.array([ask] * n), pa.array(part, pa.binary())],
                                names=["curve", "size", "place", "id", "query", "bin"])
    return run


def _cut(batches):
    """Sorted rows of a partition -> local block numbers; a curve starts a new block."""
    block, held, curve = 0, 0, None
    for b in batches:
        c, ask, out = b.column("curve").to_pylist(), b.column("query").to_pylist(), []
        for i in range(b.num_rows):
            if curve is not None and (c[i] != curve or (held == BLOCK and not ask[i])):
                block, held = block + 1, 0
            curve = c[i]
            held += not ask[i]
            out.append(block)
        yield pa.RecordBatch.from_arrays([b.column("curve"), pa.array(out, pa.int64()), b.column("id"),
                                          b.column("query"), b.column("bin")], names=["curve", "block", "id", "query", "bin"])


def _nearest(width, top):
    """Rows sorted by (curve, block, candidates first) -> the best candidates of
    every query of a block, those at least as good as its bar."""
    def best(queries, ids, x):
        q = _matrix([r[2] for r in queries], width)
        s = q @ x.T
        slack = 1e-9 * np.abs(q).sum(axis=1) * np.abs(x).max() + 1e-300
        bar = np.array([r[1] for r in queries]) - slack
        if len(ids) > top:
            bar = np.maximum(bar, np.partition(s, len(ids) - top, axis=1)[:, len(ids) - top] - slack)
        row, col = np.nonzero(s >= bar[:, None])
        score = np.cumsum(q[row] * x[col], axis=1)[:, -1] if len(row) else np.zeros(0)
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < top
        asked = np.array([r[0] for r in queries], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(asked[row[keep]]), pa.array(ids[col[keep]]), pa.array(score[keep])],
                                          names=["query_id", "node", "score"])

    def run(batches):
        here, ids, blobs, waiting, held = None, [], [], {}, {}

        def flush(size):
            got = waiting.pop(size, [])
            if got and size in held:
                yield best(got, *held[size])

        for b in batches:
            for curve, block, ask, i, bar, blob in zip(*(b.column(k).to_pylist() for k in
                                                         ("curve", "block", "query", "id", "bar", "bin"))):
                if (curve, block) != here:
                    for size in list(waiting):
                        yield from flush(size)
                    here, ids, blobs, held = (curve, block), [], [], {}
                if not ask:
                    ids.append(i)
                    blobs.append(blob)
                    continue
                if blobs:                                         # the block is whole: its candidates by length
                    sizes = np.array([len(x) for x in blobs])
                    for size in np.unique(sizes):
                        at = np.flatnonzero(sizes == size)
                        held[int(size)] = np.array(ids, np.int64)[at], _matrix([blobs[j] for j in at], width)
                    ids, blobs = [], []
                got = waiting.setdefault(len(blob), [])
                got.append((i, bar, blob))
                if len(got) == _ASK:
                    yield from flush(len(blob))
        for size in list(waiting):
            yield from flush(size)
    return run


_FOUND = "query_id long, node long, score double"


def _best_lists(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")
    return (found.dropDuplicates(["query_id", "node"]).withColumn("at", F.row_number().over(order))
            .where(F.col("at") <= n).drop("at"))


def _truth(nodes: DataFrame, asked: list, width: int, n: int) -> DataFrame:
    """The nearest of the audited queries among all nodes: the queries go to the
    nodes (AUDIT vectors), every batch returns its best."""
    compare = _nearest(width, n)

    def run(batches):
        for b in batches:
            m, k = b.num_rows, len(asked)
            rows = [(0, 0, False, i, 0.0, x) for i, x in zip(b.column("node").to_pylist(), b.column("bin").to_pylist())]
            rows += [(0, 0, True, i, -np.inf, x) for i, x in asked]
            cols = list(zip(*rows)) if m + k else [[]] * 6
            yield from compare([pa.RecordBatch.from_arrays([pa.array(list(c)) for c in cols],
                                                           names=["curve", "block", "query", "id", "bar", "bin"])])
    return _best_lists(nodes.select("node", "bin").mapInArrow(run, _FOUND), n)


def nearest(vectors: DataFrame, is_query, top: int = TOP, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest of every row of vectors
    (vec_id, embedding) that is_query (a condition over vec_id) names,
    among all rows but itself. ``nearest.recall`` holds the audited recall, and
    ``nearest.radius`` the last window, in blocks a side."""
    spark = vectors.sparkSession
    n = top + 1                                  # a query's own node can be one of them
    packed, width = nodes_of(vectors, top)
    nodes = staged(packed, "nodes")
    own = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null").where(is_query)
           .mapInArrow(_pack(width), "vec_id long, bin binary").groupBy("vec_id").agg(F.min("bin").alias("bin"))
           .where("bin is not null"))
    asks = staged(own.select(F.col("vec_id").alias("query_id"), "bin"), "queries")

    # bounded: SAMPLE vectors, AUDIT queries, one longest length
    sample = nodes.select("bin").orderBy(F.xxhash64("bin"), "bin").limit(SAMPLE).collect()
    audited = [(r.query_id, bytes(r.bin)) for r in
               asks.orderBy(F.xxhash64("query_id"), "query_id").limit(AUDIT).collect()]
    longest = (nodes.select("bin").mapInArrow(_longest(width), "l double").agg(F.max("l")).first()[0])
    nearest.recall, nearest.radius = 1.0, 0
    if not audited:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_size: dict = {}
    for r in sample:
        by_size.setdefault(len(r.bin), []).append(bytes(r.bin))
    fitted = curves_of({len(blobs[0]) // width + 1: points(_matrix(blobs, width), longest, False) for blobs in by_size.values()})

    both = (nodes.select(F.col("node").alias("id"), F.lit(False).alias("query"), "bin")
            .unionByName(asks.select(F.col("query_id").alias("id"), F.lit(True).alias("query"), "bin")))
    placed = both.mapInArrow(_place_rows(width, fitted, longest),
                             "curve int, size int, place long, id long, query boolean, bin binary")
    order = ["curve", "size", "place", F.xxhash64("id"), "query", "id"]
    cut = staged(placed.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
                 .select("curve", "id", "query", "bin")
                 .mapInArrow(_cut, "curve int, block long, id long, query boolean, bin binary")
                 .withColumn("part", F.spark_partition_id()), "blocks")
    # blocks numbered along each curve; one row per partition and curve
    sizes = cut.groupBy("curve", "part").agg(F.min("block").alias("lo"), (F.max("block") - F.min("block") + 1).alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("curve", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lo")).alias("add"))
    sizes = staged(sizes, "block-offsets")
    blocks = cut.join(F.broadcast(sizes), ["curve", "part"]).select(
        "curve", (F.col("block") + F.col("add")).alias("block"), "id", "query", "bin")
    last = staged(blocks.groupBy("curve").agg(F.max("block").alias("last")), "last-blocks")
    n_blocks = last.where("curve = 0").first().last + 1
    true = staged(_truth(nodes, audited, width, n), "truth")

    found, inner, outer = None, -1, 1
    while True:
        wide = n_blocks if CURVES * (2 * outer + 1) > 1.5 * n_blocks else outer
        ring = (blocks.where("query").join(F.broadcast(last), "curve")
                .where(F.lit(wide == outer) | (F.col("curve") == 0))
                .withColumn("to", F.explode(F.sequence(F.greatest(F.lit(0), F.col("block") - wide),
                                                       F.least(F.col("last"), F.col("block") + wide))))
                .where(F.abs(F.col("to") - F.col("block")) > inner)
                .select("curve", F.col("to").alias("block"), "id", "query", "bin"))
        if found is None:
            ring = ring.withColumn("bar", F.lit(float("-inf")))
        else:
            bars = (found.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("low"))
                    .where(F.col("c") >= n).select(F.col("query_id").alias("id"), F.col("low").alias("bar")))
            ring = ring.join(bars.hint("merge"), "id", "left").select(
                "curve", "block", "id", "query", "bin", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
        held = blocks.where(~F.col("query")).where(F.lit(wide == outer) | (F.col("curve") == 0)).withColumn("bar", F.lit(0.0))
        met = (held.unionByName(ring).repartition(parts(spark), "curve", "block")
               .sortWithinPartitions("curve", "block", "query").mapInArrow(_nearest(width, n), _FOUND))
        merged = staged(_best_lists(met if found is None else met.unionByName(found), n), "nearest")
        if found is not None:
            discard(found)
        found = merged
        want, got = (true.select("query_id", F.col("node").alias("t")).join(
            found.withColumnRenamed("node", "t").select("query_id", "t", "score"), ["query_id", "t"], "left")
            .agg(F.count("*"), F.count("score")).first())
        nearest.recall, nearest.radius = got / max(1, want), wide
        if nearest.recall >= target or wide >= n_blocks:
            break
        inner, outer = outer, 2 * outer + 1
    for done in (cut, sizes, last, true):
        discard(done)
    ids = found.join(nodes.select("node", "ids").hint("merge"), "node").select(
        "query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return ids.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _longest(width):
    def run(batches):
        top = 0.0
        for b in batches:
            blobs = b.column(0).to_pylist()
            for size in {len(x) for x in blobs}:
                top = max(top, float(_lengths(_matrix([x for x in blobs if len(x) == size], width)).max()))
        yield pa.RecordBatch.from_arrays([pa.array([top])], names=["l"])
    return run
