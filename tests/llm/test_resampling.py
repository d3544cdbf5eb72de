import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lipi.llm import alnum, resampling as R

from .helpers import LOWER, sample_docs, table

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, n):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, items, n=1, size=10000, percent=10, least=20):
    def histogram(texts):
        h = [0] * size
        for t in texts:
            for f in runs(t, n)[1]:
                h[crc32(f.encode()) % size] += 1
        return h
    s, t = histogram(d[1] for d in docs), histogram(items)
    s_all, t_all = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (s_all + size) / ((a + 1) * (t_all + size)))) for a, b in zip(s, t)]
    out, able = [], []
    for d in docs:
        words, feats = runs(d[1], n)
        weight = sum(gain[crc32(f.encode()) % size] for f in feats)
        score = None
        if d[0] is not None:
            h = int(hashlib.sha256(f"2024:{d[0]}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if words >= least:
                able.append((-score, d[0], weight, len(feats), words, len(out)))
        out.append([d[0], len(feats), weight, score, None])
    for rank, x in enumerate(sorted(able)[:percent * len(able) // 100], 1):
        out[x[-1]][-1] = rank
    return sorted(map(tuple, out), key=repr)


def run(spark, docs, items, **kw):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    rows = R.resample(table(spark, docs), bench, **kw).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted(map(tuple, rows.collect()), key=repr)


ITEMS = ["The quick brown fox, Ça va? ÉCOLE 42", "", None, "quick quick_brown"]


def test_brute_force(spark):
    docs = sample_docs(spark, n=200)
    assert run(spark, docs, ITEMS) == brute(docs, ITEMS)


def test_longer_runs_and_other_sizes(spark):
    docs = sample_docs(spark, n=60)
    got = run(spark, docs, ITEMS, max_n=3, buckets=70000, percent=35, min_words=5)
    assert got == brute(docs, ITEMS, 3, 70000, 35, 5)


def test_pieces_change_nothing(monkeypatch):
    """Words and runs of words across the borders of pieces."""
    texts = ["one two  three-four " * 9 + "ä" * 200 + " B c" * 20, "", None, "x" * 500, "; ;" * 100, "a" * 63 + " " + "b" * 64]
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(alnum.pieces, "__defaults__", (size,))
        data = [None if t is None else t.encode() for t in texts]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int64()), pa.array(data, pa.binary())], names=["i", "t"])
        out, = R._features(3, 70000)([batch])
        for t, n_words, b in zip(texts, out.column("n_words").to_pylist(), out.column("b").to_pylist()):
            words, feats = runs(t, 3)
            assert n_words == words
            assert sorted(np.frombuffer(b, "<u4").tolist()) == sorted(crc32(f.encode()) % 70000 for f in feats)


def test_awkward_rows(spark):
    long = "Wort ÀB c9 " * 40000
    docs = [(1, None), (2, ""), (3, "-- ; --"), (4, "a b " * 30), (4, "a b " * 30), (4, "x y " * 40), (None, "a b " * 30),
            (5, long), (6, "z" * 300000 + " a" * 30), (7, "a b " * 30), (-(1 << 62), "q " * 25), (1 << 62, "q " * 25)]
    assert run(spark, docs, ITEMS, percent=50) == brute(docs, ITEMS, percent=50)
    assert run(spark, docs, [], percent=100) == brute(docs, [], percent=100)
    assert run(spark, [], ITEMS) == []
    assert all(r[-1] is None for r in run(spark, docs[:3], ITEMS, percent=100))


def test_bracket_is_widened_until_it_holds_the_cutoff(spark, monkeypatch):
    """A sketch that is far off costs another bracket, never a wrong cutoff."""
    monkeypatch.setattr(R, "ACCURACY", 20)
    rows = spark.range(3000).select((F.col("id") * 7919 % 1000).alias("score"), F.col("id").alias("doc_id"))
    want = sorted(rows.collect(), key=lambda r: (-r.score, r.doc_id))
    brackets = []
    for k in (1, 300, 701, 1333, 2222, 3000):
        got, tried = R.cutoff(rows, k, 3000, 1e-6)
        assert tuple(got) == (want[k - 1].score, want[k - 1].doc_id)
        brackets.append(len(tried))
    assert max(brackets) > 1


def test_one_score_holds_all(spark):
    rows = spark.range(500).select(F.lit(5).cast("long").alias("score"), F.col("id").alias("doc_id"))
    got, _ = R.cutoff(rows, 123, 500)
    assert tuple(got) == (5, 122)


def test_drawn_documents_keep_their_columns(spark):
    docs = table(spark, sample_docs(spark, n=80))
    bench = spark.createDataFrame([(0, "the and of")], "item_id long, text string")
    order = R.resample(docs, bench, percent=30)
    got = R.drawn_documents(docs, order)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in order.where("rank is not null").collect()}


def test_registered_query(spark):
    from lipi.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op12_importance_resampling"](spark, sf).collect()), key=repr)
    assert got == brute(docs, items)
