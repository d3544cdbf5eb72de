import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Row

from lipi.llm import lexical as X

from .helpers import LOWER, sample_docs, table

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [w.translate(LOWER) for w in WORDS.findall(text or "")]


def brute(docs, items, top=20):
    held = [(d[0], Counter(terms(d[1])), len(terms(d[1]))) for d in docs]
    held = [h for h in held if h[2]]
    n_all, l_all = len(held), sum(h[2] for h in held)
    df = Counter(t for h in held for t in h[1])
    asked = {}
    for i, text in items:
        if i is not None and text is not None:
            asked[i] = min(asked.get(i, text), text)
    out = []
    for i, text in asked.items():
        scores = []
        for d, tf, n in held:
            m = 75 + (25 * n * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
                    for t in terms(text) if tf[t])
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def run(spark, docs, items, **kw):
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, score int")
    return sorted(map(tuple, X.search(table(spark, docs), bench, **kw).collect()))


def items_of(docs):
    return [(i, d[1][5:300]) for i, d in enumerate(docs[::7]) if d[1]]


def test_brute_force(spark):
    docs = sample_docs(spark, n=200)
    assert run(spark, docs, items_of(docs)) == brute(docs, items_of(docs))


def test_shards_change_nothing(spark):
    docs = sample_docs(spark, n=90)
    assert run(spark, docs, items_of(docs), max_postings=100, top=3) == brute(docs, items_of(docs), 3)


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, ";"), (4, "Alpha beta"), (4, "Alpha beta"), (5, "alpha BETA"), (None, "alpha gamma"),
            (6, "beta " * 200000), (7, "q" * 300000), (-(1 << 62), "gamma é É"), (1 << 62, "gamma é É")]
    items = [(1, "alpha, Beta alpha"), (2, None), (3, ""), (4, "nowhere"), (None, "alpha"), (5, "É gamma"), (6, "beta"), (6, "zz"),
             (1 << 61, "q" * 300000), (7, "alpha, Beta alpha")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, docs, [(3, "")]) == []


def test_ties_go_by_document_at_the_cut(spark):
    docs = [(i, "same words here") for i in range(300)] + [(1000, "other text")]
    items = [(0, "same other"), (1, "words")]
    assert run(spark, docs, items, top=20) == brute(docs, items)


def test_blocks_of_postings_change_nothing(monkeypatch):
    """Term counts meet the index in slices of any size."""
    rng = np.random.default_rng(5)
    rows = [Row(item_id=i, term=b"%d" % t, qtf=int(rng.integers(1, 4))) for i in range(9) for t in rng.permutation(30)[:12]]
    index = X.Index(rows)
    row, term = np.divmod(np.sort(rng.permutation(7 * len(index.terms))[:80]), len(index.terms))
    tf, m, weight = rng.integers(1, 9, 80), rng.integers(75, 400, 7), rng.integers(1, 9000, len(index.terms))
    got = []
    for block in (1, 17, 1 << 21):
        monkeypatch.setattr(X, "BLOCK", block)
        got.append(X.score_block(index.first, index.item, index.qtf, 9, weight, row, term, tf, m).tolist())
    times = {(r.item_id, index.terms.index(r.term)): r.qtf for r in rows}
    want = [[sum(times.get((i, t), 0) * int(weight[t]) * ((10**9 * f) // (1000 * f + 12 * int(m[d])))
                 for d2, t, f in zip(row.tolist(), term.tolist(), tf.tolist()) if d2 == d) for i in range(9)] for d in range(7)]
    assert got == [want] * 3


def test_heaps_hold_the_best_of_all_blocks():
    rng = np.random.default_rng(3)
    heaps, all_rows = X.Heaps(4, 5), []
    for block in range(12):
        scores = rng.integers(0, 9, (rng.integers(1, 30), 4))
        docs = rng.permutation(10000)[:len(scores)].astype(np.int64)
        heaps.add(scores.astype(np.int64), docs)
        all_rows += [(i, -s, d) for d, row in zip(docs.tolist(), scores.tolist()) for i, s in enumerate(row) if s > 0]
    want = [x for i in range(4) for x in sorted(r for r in all_rows if r[0] == i)[:5]]
    assert list(zip(heaps.item.tolist(), (-heaps.score).tolist(), heaps.doc.tolist())) == want


def test_registered_query(spark):
    from lipi.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_lexical_search"](spark, sf).collect())) == brute(docs, items)
