"""Connected components of a link table, without a driver-side graph.

Links are first thinned inside each partition by a union-find to a spanning
forest (never more rows than the partition has nodes), then contracted by
alternating large-star and small-star passes until nothing changes. Every
pass is a min-aggregation (partial before the shuffle) and an equi-join with
its result, dealt out anew so that adaptive execution can split the join: a node
with a third of all links is no single task's work. The loop ends when the link table is a set of stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, discard, staged


def _forest(batches):
    """Union-find over one partition's links; emits (node, root) links."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if find(x) != x]
    roots = [find(x) for x in nodes]
    for i in range(0, len(nodes), 65536):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(nodes[i:i + 65536], dtype="i8")),
             pa.array(np.array(roots[i:i + 65536], dtype="i8"))], ["u", "v"])


def _signature(df):
    """Number and order-free hashes of the links; ids of any size."""
    h = F.xxhash64("u", "v")
    return tuple(df.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h)), F.sum(h % 1000000007)).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, component_id long) of every node in a link, component_id
    the smallest node reachable. Null ends and self-links are ignored; an
    empty link table gives no rows."""
    clean = (links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
             .where("u is not null and v is not null and u <> v"))
    e = staged(clean.mapInArrow(_forest, "u long, v long").distinct(), "cc")
    seen = _signature(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(apart(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        step = (down.join(apart(small), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .union(small.select("u", F.col("m").alias("v")))).distinct()
        nxt = staged(step, "cc")
        now = _signature(nxt)
        discard(e)
        e = nxt
        if now == seen:
            break
        seen = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("component_id"))).distinct())
