"""Rows of one group as one value: packs, and the queries that shuffle packs."""

import datetime
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lipi.operators import encode as en
from lipi.operators import packs
from lipi.operators.encode import BpeModel

ABC = BpeModel(("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "a", "b", "c", "ab", "bc", "abc"), (("b", "c"), ("a", "b"), ("a", "bc")))


def shuffled(df):
    """Rows of df and the bytes that its shuffles wrote."""
    rows, total, open_ = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        p = open_.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(p.plan())
        else:
            if p.metrics().contains("shuffleBytesWritten"):
                total += p.metrics().apply("shuffleBytesWritten").value()
            open_ += [p.children().apply(i) for i in range(p.children().size())]
    return rows, total


@pytest.mark.parametrize("column", [
    pa.array([5, 6, 9, -3, 2**31 - 1, -2**31], pa.int32()), pa.array([2**63 - 1, -2**63, 0, 1], pa.int64()), pa.array([-128, 127, 0], pa.int8()),
    pa.array([1, None, 3], pa.int32()), pa.array(["a", "", "éक", "x" * 5000]), pa.array(["a", None]), pa.array([b"\x00", b""]),
    pa.array([[1, 2], [], [2**31 - 1]], pa.list_(pa.int32())), pa.array([[1], None], pa.list_(pa.int32())), pa.array([[1, None]], pa.list_(pa.int32())),
    pa.array([["ab", "c"], []], pa.list_(pa.string())), pa.array([1.5, float("inf")]), pa.array([True, None]), pa.array([datetime.date(2020, 1, 2)]),
    pa.array([{"a": 1, "b": "x"}, None]), *(pa.array([], t) for t in (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.float64())),
], ids=str)
def test_packs_give_columns_back(column):
    for c in (column, column[1:], column[:0]):
        got = packs.unpack(packs.pack([c, pa.array([7, 8])]))
        assert got[0].type == c.type and got[0].to_pylist() == c.to_pylist() and got[1].to_pylist() == [7, 8]


def test_groups_of_a_stretch(spark, monkeypatch):
    rows = [(k, t, i) for i, (k, t) in enumerate([(2, "b"), (1, None), (2, "b"), (None, "b"), (1, None), (2, "c"), (1, ""), (None, "b")])]
    df = spark.createDataFrame(rows, "k int, t string, v int").coalesce(1)
    for size, n in ((1 << 20, 5), (1, 8)):
        monkeypatch.setattr(packs, "STRETCH_BYTES", size)
        table = pa.Table.from_pylist([dict(zip("ktv", r)) for r in rows])
        got = [x for t in packs.stretches(iter(table.to_batches(max_chunksize=1))) for x in zip(*(c.to_pylist() for c in (lambda v, p: [*v, p])(*packs.pack_groups(t, 2))))]
        assert len(got) == n and sorted((str(k), str(t), v) for k, t, p in got for v in packs.unpack(p)[0].to_pylist()) == sorted((str(k), str(t), v) for k, t, v in rows)
    got = packs.packed(df.select("v", F.struct("k", "t").alias("s")), ["s"]).collect()
    assert {tuple(r.s): packs.unpack(bytes(r.pack))[0].to_pylist() for r in got} == {(2, "b"): [0, 2], (1, None): [1, 4], (None, "b"): [3, 7], (2, "c"): [5], (1, ""): [6]}


def brute(left, right):
    """(key, x), (key, y) of rows (key, x, start, end) that share a position."""
    ok = lambda r: None not in (r[0], r[2], r[3]) and r[3] > r[2]
    return sorted(((a[0], a[1], b[1]) for a in left if ok(a) for b in right if ok(b) and a[0] == b[0] and a[2] < b[3] and a[3] > b[2]), key=str)


@pytest.mark.parametrize("kind", ["int", "bigint", "double"])
def test_overlap_of_any_spans(spark, kind):
    """Texts, nulls and equal names ride along; repeated rows and keys, long
    spans, huge positions."""
    rnd, far = random.Random(3), {"int": 0, "bigint": 2**40, "double": 0}[kind]
    to = float if kind == "double" else int

    def make(n):
        rows = []
        for i in range(n):
            a = rnd.randint(-50, 900) + far * rnd.randint(0, 1)
            rows.append((rnd.choice(["x", "y", "", None]), rnd.choice([None, f"t{i}"]), to(a), to(a + rnd.choice([0, 1, 2, 30, 400, -3]))))
        return (rows + [("x", "none", None, to(4)), ("z", "alone", to(0), to(9))]) * 2
    left, right = make(60), make(50)
    schema = f"k string, v string, start {kind}, end {kind}"
    a, b = spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema).repartition(2)
    want = brute(left, right)
    for block in (64, 4096):
        got = en.overlap_join(a, b, ["k"], block)
        assert got.columns == ["k", "v", "start", "end", "v", "r_start", "r_end"]
        assert sorted(((r[0], r[1], r[4]) for r in got.collect()), key=str) == want


def test_pairs_in_pieces(monkeypatch):
    """The worker's function itself, few spans and pairs at once."""
    rnd = random.Random(8)
    make = lambda n: [(rnd.randint(0, 90), rnd.choice([1, 5, 40])) for _ in range(n)]
    left, right, rows = make(40), make(30), []
    side = lambda spans: packs.pack([pa.array([a for a, _ in spans], pa.int32()), pa.array([a + n for a, n in spans], pa.int32()),
                                     pa.array([a >= 0 for a, _ in spans]).cast(pa.int8())])
    batch = pa.RecordBatch.from_arrays([pa.array([4, 5]), pa.array([side(left), side(right)]), pa.array([side(right), side(left)])], names=["k", "a", "b"])
    want = sorted([(k, a, a + n, b, b + m) for k, x, y in ((4, left, right), (5, right, left)) for a, n in x for b, m in y if a < b + m and a + n > b])
    for most in (1, 10, 1 << 16):
        monkeypatch.setattr(en, "_MATCH_ROWS", most)
        out = list(en._match_packs(1, (0, 1), (0, 1), list("ksexy"), iter([batch])))
        rows = sorted(tuple(r.values()) for b in out for r in b.to_pylist())
        assert rows == want and (most > 10 or max(b.num_rows for b in out) <= max(most, 40))


def test_span_tables_are_shuffled_as_packs(spark):
    """A span costs a byte or two of a shuffle, not a row of its own."""
    rnd, spans = random.Random(1), []
    for doc in range(6):
        at = 0
        for i in range(3000):
            n = rnd.randint(1, 6)
            spans.append((doc, i, at, at + n))
            at += n + rnd.choice([0, 1])
    make = lambda name: spark.createDataFrame(spans, f"doc_id long, {name} int, start int, end int").coalesce(2)
    rows, written = shuffled(en.overlap_join(make("token_idx"), make("word_idx"), "doc_id"))
    assert sorted((r.doc_id, r.token_idx) for r in rows) == sorted((r.doc_id, r.word_idx) for r in rows) == [(d, i) for d in range(6) for i in range(3000)]
    assert 0 < written < 3 * 2 * len(spans)


def word_ids(word):
    _, tok2id, ranks = en._entry(ABC)[:3]
    return [2] if word == "[CLS]" else [i for _, i in en.encode_word(word, tok2id, ranks)]


def by_dictionary(rows):
    """What encode_dictionary promises: the ids of all texts of a row's key, place by place."""
    found = {}
    for *key, text in rows:
        pieces = en.re.findall(r"\[CLS\]|\w+|[^\w\s]+|\s+", text or "")
        found.setdefault(tuple(key), []).extend((i, word_ids(p)) for i, p in enumerate(pieces) if not p.isspace())
    return sorted(((*k, [] if None in k else [x for _, ids in sorted(found[tuple(k)]) for x in ids]) for *k, _ in rows), key=str)


@pytest.mark.parametrize("share", [10_000, 3, 0], ids=["all hot", "some hot", "none hot"])
@pytest.mark.parametrize("twice", [False, True], ids=["keys once", "keys repeat"])
def test_dictionary_of_odd_tables(spark, monkeypatch, share, twice):
    """Null and repeated keys, null, blank and wide texts, two columns of keys."""
    monkeypatch.setattr(en, "HOT_SHARE", share)
    rows = [(i, str(i % 3), f"abc w{i % 5} \t ab,{'c' * i}") for i in range(30)]
    rows += [(50, "x", None), (51, "x", " \n "), (52, "", ""), (53, "é", "abcé [CLS]xab"), (None, "x", "ab"), (54, None, "abc"), (None, None, "c c")]
    rows += [(None, "x", "b"), *([(3, "0", "b c ab"), (7, "1", None), (50, "x", "ab abc"), (4, "1", rows[4][2])] if twice else [])]
    df = spark.createDataFrame(rows, "k int, t string, body string").repartition(3)
    got = en.encode_dictionary(spark, df, ABC, ["k", "t"], "body")
    assert got.columns == ["k", "t", "ids"]
    assert sorted(((r.k, r.t, list(r.ids)) for r in got.collect()), key=str) == by_dictionary(rows)
    assert en.encode_dictionary(spark, df.where("k < 0"), ABC, ["k", "t"], "body").collect() == []


class Shared:
    value = ABC


class Task:
    partitionId = staticmethod(lambda: 3)


@pytest.mark.parametrize("share", [1, 7, 0])
@pytest.mark.parametrize("size, words", [(1, 100), (40, 100), (1 << 20, 3), (1 << 20, 100)])
def test_chunks_and_their_words(monkeypatch, share, size, words):
    """The worker's functions themselves, with small chunks, slices and batches."""
    monkeypatch.setattr(en.TaskContext, "get", classmethod(lambda cls: Task))
    monkeypatch.setattr(en, "CHUNK_BYTES", size)
    monkeypatch.setattr(en, "CHUNK_WORDS", words)
    monkeypatch.setattr(en, "SLICE_CHARS", 16)
    texts = [["ab", " ", "c", " ", "ab"], None, [], [" "], ["abc", ",", "ab"], ["c" * 70], ["ab", "c", "b"], ["x", " ", "ab"]]
    table = pa.table({"k": pa.array(range(8), pa.int64()), "pieces": pa.array(texts, pa.list_(pa.string()))})
    want = [[x for p in t or [] if p != " " for x in word_ids(p)] for t in texts]
    for places in (False, True):
        chunks = [b.to_pylist()[0] for b in en._to_chunks(1, places, iter(table.to_batches(max_chunksize=3)))]
        assert [c["chunk"] for c in chunks] == [(3 << 32) + i for i in range(len(chunks))] and (len(chunks) > 2) == (size < 100 or words < 100)
        dealt = pa.Table.from_batches(en._chunk_words(2, iter([pa.RecordBatch.from_pylist([{"chunk": c["chunk"], "words": c["words"]} for c in chunks])])))
        entries = pa.Table.from_batches(en._unpack_words(iter(dealt.select(["chunk", "pack"]).to_batches())))
        assert entries.num_rows == sum(c["n"] for c in chunks)
        seen = []
        real = en.encode_word
        monkeypatch.setattr(en, "encode_word", lambda w, *a: seen.append(w) or real(w, *a))
        en._entry(ABC)[3].clear()
        coded = pa.Table.from_batches(en._code_words(Shared, share, entries.num_rows, iter(entries.sort_by("word").to_batches(max_chunksize=2)))).to_pylist()
        monkeypatch.setattr(en, "encode_word", real)
        assert sorted(seen) == sorted({p for t in texts for p in t or [] if p != " "})           # each once
        hot = [c["pack"] for c in coded if c["chunk"] is None]
        met = entries.column("word").to_pylist()
        assert sorted(packs.unpack(h)[0][0].as_py() for h in hot) == sorted(w for w in {*met} if met.count(w) * share > len(met))
        rows = [{"words": c["words"], "texts": c["texts"], "parts": [x["pack"] for x in coded if x["chunk"] == c["chunk"]] or None, "hot": hot} for c in chunks]
        schema = pa.schema([("words", pa.binary()), ("texts", pa.binary()), ("parts", pa.list_(pa.binary())), ("hot", pa.list_(pa.binary()))])
        out = pa.Table.from_batches(en._text_ids(1, places, ["k", "ids"], iter(pa.Table.from_pylist(rows, schema).to_batches()))).to_pylist()
        assert [r["k"] for r in out] == [*range(8)]
        if not places:
            assert [r["ids"] for r in out] == want
            continue
        for r, t, ids in zip(out, texts, want):
            counts, found = (c[0].as_py() for c in packs.unpack(r["ids"]))
            assert found == ids and counts == [0 if p == " " else len(word_ids(p)) for p in t or []]
        lists = pa.array([[r["ids"]] for r in out] + [None, [out[0]["ids"], out[4]["ids"]]])
        merged = [x for b in en._unpacked_ids_udf.func(iter([lists])) for x in b.to_pylist()]
        both = sorted([(0, word_ids("ab")), (2, word_ids("c")), (4, word_ids("ab")), (0, word_ids("abc")), (1, word_ids(",")), (2, word_ids("ab"))])
        assert merged == [*want, [], [x for _, i in both for x in i]]


def test_a_lost_word_is_an_error():
    texts = packs.pack([pa.array([1]), pa.array([[1]], pa.list_(pa.int32()))])
    row = {"words": packs.pack([pa.array(["ab"])]), "texts": texts, "parts": None, "hot": []}
    schema = pa.schema([("words", pa.binary()), ("texts", pa.binary()), ("parts", pa.list_(pa.binary())), ("hot", pa.list_(pa.binary()))])
    with pytest.raises(RuntimeError, match="dictionary"):
        list(en._text_ids(1, False, ["k", "ids"], iter(pa.Table.from_pylist([row], schema).to_batches())))


def test_dictionary_takes_little_disk(spark):
    """Checkpoints and shuffles of the whole job, against the text."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7)))
    common, rows = [word() for _ in range(3000)], []
    for i in range(60):
        rows.append((i, " ".join(common[int(x)] for x in np.random.default_rng(i).zipf(1.3, 1500) % 3000)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    text = sum(len(t) for _, t in rows)

    def kept():
        folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    before = kept()
    got = en.encode_dictionary(spark, df, ABC)
    found, written = shuffled(got)
    assert sorted(((r.doc_id, list(r.ids)) for r in found), key=str) == by_dictionary(rows)
    assert 0 < kept() - before < text and written < text
