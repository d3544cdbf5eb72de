"""Near-duplicate vectors by NN-descent.

1. Vectors with the same bytes are one node (their number is its weight).
2. The neighbour graph starts from random-projection leaves: per tree, nodes
   sorted by the signs of random projections (ties by hash, so equal codes
   split), LEAF neighbours in that order compared with each other.
3. Descent: around every node, its neighbours and the nodes it is a neighbour
   of are compared with each other (a hub's reverse list is salted into
   several such groups); a pair that beats the worst entry of either list
   enters it, and a pair above the threshold whose ends are in different
   components is always kept. Repeated until no link joins two components.
4. Saturated lists: where all K neighbours of a node are above the threshold,
   the list is enlarged to the node's whole component, compared in blocks of
   BLOCK x BLOCK that only report counts (no pair is written).
5. Audit: nodes chosen by hash are compared with all nodes, in further blocks
   until LINKED nodes with 1 to K - 1 linked nodes were met, or all nodes were
   asked. Links count distinct vectors, so copies weigh nothing. If fewer than
   TARGET of the links of those nodes, or of the mean share of the links of the
   nodes with K and more, were found, more trees are grown and the descent goes
   on.
6. If ROUNDS rounds miss the target, all pairs of nodes are compared, in blocks
   of TILE x TILE dealt by a shuffle; a block pair writes counts and a spanning
   forest of its links.

Cosines are computed in double precision from the raw components.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component link with nothing, and so do vectors of different
length; rows of one vec_id count once (the smallest embedding in byte order
stands for it); rows with a null vec_id come back unlinked; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, discard, parts, shuffled, staged
from .components import components

THRESHOLD = 0.95
K = 8                    # neighbours kept
TREES, LEAF, BITS = 5, 64, 24
REVERSE = 24             # reverse neighbours of one local group
BLOCK, TILE = 512, 4096  # rows of a block: in a component, of all nodes
AUDIT, TARGET = 512, 0.99  # nodes of the audit's first block
ASK_MAX, LINKED = 4096, 200  # nodes of its largest block; linked nodes wanted
ROUNDS, ITERATIONS = 4, 6  # before all pairs are compared; passes of a round


def _floats(binary, width):
    return np.frombuffer(binary, dtype="<f8" if width == 8 else "<f4").astype(np.float64)


def unit_rows(blobs: list, width: int) -> np.ndarray:
    """Rows scaled to length one in double precision; all of one length."""
    x = _floats(b"".join(blobs), width).reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _pack(width):
    def run(batches):
        for b in batches:
            ids, col = b.column(0).to_pylist(), b.column(1)
            out = []
            for v in col:
                ok = v.is_valid and len(v.values) and not v.values.null_count
                if ok:
                    a = v.values.to_numpy(zero_copy_only=False).astype("<f8" if width == 8 else "<f4")
                    ok = bool(np.isfinite(a).all() and np.any(a))
                out.append(a.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())],
                                             names=["vec_id", "bin"])
    return run


def _codes(width, seed, trees):
    """One row per tree: (tree and projection signs, node, vector)."""
    planes: dict = {}

    def run(batches):
        for b in batches:
            blobs, ids = b.column("bin").to_pylist(), b.column("node").to_numpy()
            sizes = np.array([len(x) for x in blobs])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for lo in range(0, len(at), 4096):
                    sel = at[lo:lo + 4096]
                    part = [blobs[i] for i in sel]
                    x = unit_rows(part, width)
                    d = x.shape[1]
                    if d not in planes:
                        planes[d] = np.random.default_rng([seed, d]).standard_normal((d, trees * BITS))
                    sign = (x @ planes[d] > 0).reshape(len(part), trees, BITS)
                    code = (sign * (1 << np.arange(BITS - 1, -1, -1))).sum(axis=2)
                    code += (np.arange(trees) << (BITS + 16)) + (d % 65536 << BITS)
                    for t in range(trees):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(code[:, t].astype(np.int64)), pa.array(ids[sel]), pa.array(part, pa.binary())],
                            names=["code", "node", "bin"])
    return run


_EDGE = "src long, dst long, sim double"


def _edges(src, dst, sim):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(src, np.int64)), pa.array(np.asarray(dst, np.int64)),
                                       pa.array(np.asarray(sim, np.float64))], names=["src", "dst", "sim"])


def _leaves(width):
    """Rows in code order: LEAF rows at a time, the K nearest of each."""
    def nearest(ids, blobs):
        x = unit_rows(blobs, width)
        s = x @ x.T
        np.fill_diagonal(s, -2)
        k = min(K, len(ids) - 1)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        rows = np.repeat(np.arange(len(ids)), k)
        return _edges(ids[rows], ids[top.ravel()], s[rows, top.ravel()])

    def run(batches):
        ids, blobs, tag = [], [], None
        for b in batches:
            for code, node, blob in zip(*(b.column(c).to_pylist() for c in ("code", "node", "bin"))):
                if len(ids) == LEAF or (ids and code >> BITS != tag):
                    if len(ids) > 1:
                        yield nearest(np.array(ids), blobs)
                    ids, blobs = [], []
                tag = code >> BITS
                ids.append(node)
                blobs.append(blob)
        if len(ids) > 1:
            yield nearest(np.array(ids), blobs)
    return run


def _local(width, threshold):
    """Rows sorted by local group: compare a group's members pairwise and
    keep pairs that improve a list or join two components."""
    def improve(rows):
        if len(rows) < 2:
            return None
        ids = np.array([r[0] for r in rows])
        size = len(rows[0][1])
        rows = [r for r in rows if len(r[1]) == size]
        ids, first = np.unique([r[0] for r in rows], return_index=True)
        rows = [rows[i] for i in first]
        if len(rows) < 2:
            return None
        bar = np.array([r[2] for r in rows])
        comp = np.array([r[3] for r in rows])
        x = unit_rows([r[1] for r in rows], width)
        s = x @ x.T
        np.fill_diagonal(s, -2)
        a, b = np.nonzero((s > bar[:, None]) | ((s >= threshold) & (comp[:, None] != comp[None, :])))
        return _edges(ids[a], ids[b], s[a, b]) if len(a) else None

    def run(batches):
        key, rows = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("mid", "salt", "node", "bin", "bar", "comp")]
            for mid, salt, *row in zip(*cols):
                if (mid, salt) != key:
                    got = improve(rows)
                    if got is not None:
                        yield got
                    key, rows = (mid, salt), []
                rows.append(row)
        got = improve(rows)
        if got is not None:
            yield got
    return run


def _forest(hit: np.ndarray):
    """(row, column, is the link to a column) stars of the components of a
    block pair: every member with the row its component was found from."""
    todo, cols_left = hit.any(axis=1), np.ones(hit.shape[1], bool)
    for root in np.flatnonzero(todo):
        if not todo[root]:
            continue
        todo[root] = False
        rows = np.array([root])
        while len(rows):
            cols = np.flatnonzero(hit[rows].any(axis=0) & cols_left)
            cols_left[cols] = False
            yield root, cols, True
            rows = np.flatnonzero(hit[:, cols].any(axis=1) & todo)
            todo[rows] = False
            yield root, rows, False


def _count_blocks(width, threshold, forest=False):
    """Rows sorted by (component, block pair): links of each left row to the
    right rows and of each right row to the left ones, weights summed (n) and
    nodes counted (m). With ``forest`` also links (node, root) that connect
    what the block pair connects."""
    def count(rows):
        side = np.array([r[0] for r in rows])
        ids = np.array([r[1] for r in rows])
        weight = np.array([r[2] for r in rows])
        size = len(rows[0][3])
        same = np.array([len(r[3]) == size for r in rows])
        x = unit_rows([r[3] if ok else rows[0][3] for r, ok in zip(rows, same)], width)
        left, right = np.flatnonzero((side != 1) & same), np.flatnonzero((side != 0) & same)
        hit = np.empty((len(left), len(right)), bool)
        for i in range(0, len(left), 512):
            hit[i:i + 512] = x[left[i:i + 512]] @ x[right].T >= threshold
        if not (side == 1).any():        # a block with itself: left is right
            np.fill_diagonal(hit, False)
        out = [(ids[left], hit @ weight[right], hit.sum(axis=1))]
        if (side == 1).any():
            out.append((ids[right], weight[left] @ hit, hit.sum(axis=0)))
        node, n, m = (np.concatenate(c) for c in zip(*out))
        keep = m > 0
        node, n, m, root = node[keep], n[keep], m[keep], np.full(keep.sum(), -1)
        if forest:
            tied = [(ids[right if is_col else left][at], np.full(len(at), ids[left][r])) for r, at, is_col in _forest(hit)]
            if tied:
                ends, roots = (np.concatenate(c) for c in zip(*tied))
                none = np.zeros(len(ends), np.int64)
                node, n, m, root = (np.concatenate(c) for c in ((node, ends), (n, none), (m, none), (root, roots)))
        tie = pa.array(root.astype(np.int64), mask=np.arange(len(root)) < keep.sum())
        return pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(n.astype(np.int64)),
                                           pa.array(m.astype(np.int64)), tie], names=["node", "n", "m", "root"])

    def run(batches):
        key, rows = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("comp", "bi", "bj", "side", "node", "weight", "bin")]
            for comp, bi, bj, *row in zip(*cols):
                if (comp, bi, bj) != key:
                    if rows:
                        yield count(rows)
                    key, rows = (comp, bi, bj), []
                rows.append(row)
        if rows:
            yield count(rows)
    return run


_COUNTS = "node long, n long, m long, root long"


class Descent:
    """State of one search: nodes, neighbour graph, links, components."""

    def __init__(self, nodes: DataFrame, width: int, threshold: float):
        self.nodes, self.width, self.threshold = nodes, width, threshold
        self.graph = self.links = self.comp = None
        self.n_joins = 0         # links of a spanning forest
        self.parts = parts(nodes.sparkSession)

    def grow(self, seed: int, trees: int = TREES):
        """Leaves of new trees into the graph."""
        rows = self.nodes.select("node", "bin").mapInArrow(
            _codes(self.width, seed, trees), "code long, node long, bin binary")
        order = (rows.withColumn("tie", F.xxhash64("node")).repartitionByRange(self.parts, "code", "tie")
                 .sortWithinPartitions("code", "tie"))
        self._merge(order.select("code", "node", "bin").mapInArrow(_leaves(self.width), _EDGE))

    def _merge(self, edges: DataFrame):
        """The K best of old and new neighbours, and the links."""
        edges = staged(edges, "edges")
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
        if self.graph is not None:
            both = both.union(self.graph.select("src", "dst", "sim"))
        best = (both.groupBy("src").agg(F.collect_set(F.struct("sim", "dst")).alias("l"))
                .select("src", F.explode(F.slice(F.sort_array("l", asc=False), 1, K)).alias("e"))
                .select("src", "e.dst", "e.sim"))
        graph = staged(best, "graph")
        near = edges.where(F.col("sim") >= self.threshold).union(graph.where(F.col("sim") >= self.threshold))
        near = near.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        if self.links is not None:
            near = near.union(self.links)
        links = staged(near.distinct(), "links")
        for old in (edges, self.graph, self.links, self.comp):
            if old is not None:
                discard(old)
        self.graph, self.links = graph, links
        self.comp = staged(components(links), "components")
        joins = self.comp.where("node <> component_id").count()
        self.joined, self.n_joins = joins - self.n_joins, joins

    def descend(self):
        """One pass of neighbours-of-neighbours joins."""
        g = self.graph
        state = (g.groupBy("src").agg(F.count("*").alias("k"), F.min("sim").alias("low"))
                 .select(F.col("src").alias("node"), F.when(F.col("k") < K, F.lit(-1.0)).otherwise(F.col("low")).alias("bar")))
        node = (self.nodes.select("node", "bin").join(apart(state), "node")
                .join(shuffled(self.comp), "node", "left")
                .select("node", "bin", "bar", F.coalesce("component_id", "node").alias("comp")))
        back = g.groupBy(F.col("dst").alias("mid")).agg(F.ceil(F.count("*") / REVERSE).alias("salts"))
        hub = F.coalesce("salts", F.lit(1).cast("long"))
        fwd = (g.select(F.col("src").alias("mid"), F.col("dst").alias("node"))
               .union(g.select(F.col("src").alias("mid"), F.col("src").alias("node")).distinct())
               .join(apart(back), "mid", "left")
               .select("mid", F.explode(F.sequence(F.lit(0).cast("long"), hub - 1)).alias("salt"), "node"))
        rev = (g.select(F.col("dst").alias("mid"), F.col("src").alias("node")).join(apart(back), "mid")
               .select("mid", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), "node"))
        groups = (fwd.union(rev).join(shuffled(node), "node")
                  .repartition(self.parts, "mid", "salt").sortWithinPartitions("mid", "salt"))
        self._merge(groups.select("mid", "salt", "node", "bin", "bar", "comp")
                    .mapInArrow(_local(self.width, self.threshold), _EDGE))

    def counts(self) -> DataFrame:
        """node, n_links (weights of linked nodes), n_nodes (distinct ones),
        component_id."""
        full = (self.graph.where(F.col("sim") >= self.threshold).groupBy(F.col("src").alias("node"))
                .agg(F.count("*").alias("k")).where(F.col("k") >= K).select("node"))
        dense = self.comp.join(apart(full), "node", "left_semi").select("component_id").distinct()
        member = self.comp.join(apart(dense), "component_id", "left_semi")
        size = member.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))
        row = member.join(apart(size), "component_id").join(shuffled(self.nodes), "node")
        crowd = (self._block_pairs(row.withColumnRenamed("component_id", "comp"))
                 .mapInArrow(_count_blocks(self.width, self.threshold), _COUNTS)
                 .groupBy("node").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
        ends = (self.links.select(F.col("a").alias("node"), F.col("b").alias("o"))
                .union(self.links.select(F.col("b").alias("node"), F.col("a").alias("o"))))
        loose = (ends.join(shuffled(self.comp.join(apart(dense), "component_id", "left_anti").select("node")), "node", "left_semi")
                 .join(shuffled(self.nodes.select(F.col("node").alias("o"), "weight")), "o")
                 .groupBy("node").agg(F.sum("weight").alias("n"), F.count("*").alias("m")))
        return self._per_node(crowd.union(loose))

    def _block_pairs(self, row: DataFrame) -> DataFrame:
        """Rows (comp, nb, node, weight, bin) dealt to all pairs of the nb
        blocks of their comp."""
        return (row.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("nb")))
                .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
                .select("comp", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"),
                        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0)
                        .otherwise(1).alias("side"), "node", "weight", "bin")
                .repartition(self.parts, "comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj"))

    def exact(self) -> DataFrame:
        """counts() from all pairs of vectors of one length."""
        row = self.nodes.withColumn("comp", F.length("bin").cast("long"))
        size = row.groupBy("comp").agg(F.ceil(F.count("*") / TILE).alias("nb"))
        seen = staged(self._block_pairs(row.join(shuffled(size), "comp"))
                      .mapInArrow(_count_blocks(self.width, self.threshold, True), _COUNTS), "pairs")
        if self.comp is not None:
            discard(self.comp)
        self.comp = staged(components(seen.where("root is not null").select(
            F.col("node").alias("a"), F.col("root").alias("b"))), "components")
        counted = self._per_node(seen.where("root is null").groupBy("node").agg(
            F.sum("n").alias("n"), F.sum("m").alias("m")))
        discard(seen)
        return counted

    def _per_node(self, per: DataFrame) -> DataFrame:
        return staged(self.nodes.select("node", "weight").join(shuffled(per), "node", "left")
                      .join(shuffled(self.comp), "node", "left")
                      .select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                              F.coalesce("m", F.lit(0)).alias("n_nodes"),
                              F.coalesce("component_id", "node").alias("component_id")), "link_counts")

    def audit(self, counted: DataFrame) -> float:
        """Share of the true links of hashed nodes that were found, the lower
        one of nodes with few links and (mean per node) of nodes with K and
        more. 1.0 without links only if all nodes were asked."""
        n, unit = self.nodes.count(), 1 << 40
        lo, block = 0, AUDIT
        few, few_found, linked, crowded = 0, 0, 0, []
        while n and lo < unit and linked < LINKED:
            hi = min(unit, lo + max(1, unit * block // n))
            for true, found in self._ask(counted, unit, lo, hi):
                if true >= K:
                    crowded.append(found / true)
                elif true:
                    few, few_found, linked = few + true, few_found + found, linked + 1
            lo, block = hi, min(2 * block, ASK_MAX)
        return min(few_found / few if few else 1.0, sum(crowded) / len(crowded) if crowded else 1.0)

    def _ask(self, counted: DataFrame, unit: int, lo: int, hi: int) -> list:
        """(true, found) numbers of linked nodes of the nodes with a hash in
        [lo, hi) of ``unit``."""
        h = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(unit))
        sample = self.nodes.where((h >= lo) & (h < hi)).select("node", "bin").collect()
        if not sample:
            return []
        threshold, width = self.threshold, self.width
        shared = self.nodes.sparkSession.sparkContext.broadcast([(r["node"], bytes(r["bin"])) for r in sample])

        def run(batches):
            ask: dict = {}
            for node, blob in shared.value:
                ask.setdefault(len(blob), []).append((node, blob))
            ask = {length: (np.array([node for node, _ in q]), unit_rows([blob for _, blob in q], width),
                            np.zeros(len(q), np.int64)) for length, q in ask.items()}
            for b in batches:
                blobs = b.column("bin").to_pylist()
                sizes = np.array([len(x) for x in blobs])
                for length, (_, y, n) in ask.items():
                    at = np.flatnonzero(sizes == length)
                    for i in range(0, len(at), 2048):
                        x = unit_rows([blobs[j] for j in at[i:i + 2048]], width)
                        n += np.count_nonzero(y @ x.T >= threshold, axis=1)
            for node, _, n in ask.values():
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n)], names=["node", "n"])
        true = self.nodes.select("bin").mapInArrow(run, "node long, n long").groupBy("node").agg(
            (F.sum("n") - 1).alias("n"))
        got = true.where("n > 0").join(shuffled(counted.select("node", "n_nodes")), "node").select(
            "n", F.least("n_nodes", "n").alias("found")).collect()
        shared.destroy()
        return [(r["n"], r["found"]) for r in got]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    width = 4 if kind == "float" else 8
    value = F.col(vector_col) if kind in ("float", "double") else F.col(vector_col).cast("array<double>")
    packed = vectors.select(F.col(id_col).cast("long").alias("vec_id"), value.alias("v")).mapInArrow(
        _pack(width), "vec_id long, bin binary")
    named = packed.where("vec_id is not null").groupBy("vec_id").agg(F.min("bin").alias("bin"))
    every = staged(named, "vectors")
    nodes = staged(every.where("bin is not null").groupBy("bin").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("weight")).select("node", "weight", "bin"), "nodes")
    search = Descent(nodes, width, threshold)
    for round_no in range(ROUNDS):
        search.grow(seed=round_no + 1)
        for _ in range(ITERATIONS):
            search.descend()
            if not search.joined:
                break
        counted = search.counts()
        recall = search.audit(counted)
        if recall >= target:
            break
        discard(counted)
    else:
        counted, recall = search.exact(), 1.0
    near_vectors.recall = recall
    place = nodes.select("bin", "node").join(shuffled(counted), "node").select("bin", "n_links", "component_id")
    none = packed.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                 F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return (every.join(shuffled(place), "bin", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.expr("vec_id = component_id")).union(none))
