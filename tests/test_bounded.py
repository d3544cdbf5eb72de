"""What keeps memory, the driver and single tasks small: slices of Arrow
batches, top-k on executors, tables and feeds as streams, samples by key."""

import os
import tempfile
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lipi import session
from lipi.llm import common, exact_dedup, langid
from lipi.operators import bpe_train, counts
from lipi.operators import encode as en
from lipi.plans import encode_queries, stream_queries
from lipi.plans.corpus_queries import eval_lines_of
from lipi.sources import artefacts
from lipi.streaming import feed
from test_encode import MODEL


class Shared:
    value = MODEL


def lists(batches):
    return [r for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_lists_come_in_slices(monkeypatch, limit):
    """A batch of rows gives many small batches with the same rows."""
    texts = ["ab cab", None, "", "[UNK] xyz é", "a" * 30, " b\t c ", "cab"] * 5
    pieces = pa.array([None if t is None else en.re.findall(r"\[UNK\]|\w+|[^\w\s]+|\s+", t) for t in texts], pa.list_(pa.string()))
    whole = lists(en._make_encoder(Shared).func(iter([pieces])))
    monkeypatch.setattr(en, "SLICE_CHARS", limit)
    parts = list(en._make_encoder(Shared).func(iter([pieces])))
    assert lists(parts) == whole and len(whole) == len(texts)
    most = max(max(sum(len(t or "") for t in texts[i:i + len(b)]) for b, i in zip(parts, at(parts))), 30)
    assert most <= max(limit, 30) if limit < 100 else len(parts) == 1
    enc = pa.concat_arrays(parts)
    args = (pa.array(texts), enc.field("starts"), enc.field("ends"))
    spans = list(en._spans_udf.func(iter([args])))
    words = list(en._words_udf.func(iter([args[0]])))
    ids = list(en._make_id_encoder(Shared).func(iter([pieces])))
    assert lists(ids) == [r["ids"] for r in whole]
    for t, s, w in zip(texts, lists(spans), lists(words), strict=True):
        assert s["wt"] == (None if t is None else t.split()) == (w and [x["w"] for x in w] if w is not None else None)
        assert w is None or [x["s"] for x in w] == s["ws"]
    if limit == 1:
        assert len(parts) > 10 and len(spans) > 10 and len(words) > 10 and len(ids) > 10


def at(batches):
    n = 0
    for b in batches:
        yield n
        n += len(b)


def test_alignment_of_plain_wide_texts():
    """The short way, character by character, is the long one."""
    for t in ("ａｂｃ ！", "㌀１", "áb", "가ａ", "́ａ", "ﬁﬂ", ""):
        norm, a, b = en.nfkc_with_alignment(t)
        assert norm == unicodedata.normalize("NFKC", t) and len(a) == len(b) == len(norm)
    assert en.nfkc_with_alignment("ａﬁｂ") == ("afib", [0, 1, 1, 2], [1, 2, 2, 3])


def test_top_pairs_are_merged_on_an_executor(spark):
    rows = [("".join(f"\t{c}\n" for c in w), n) for w, n in (("abcab", 3), ("bca", 5), ("ccc", 2))]
    words = spark.createDataFrame(rows, "sym string, cnt long").repartition(4)
    want = [tuple(r) for r in counts.top_pairs(counts.pair_counts(words), 3).collect()]
    assert bpe_train._top(words, 3) == want
    group = "top-pairs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        bpe_train._top(words, 3)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    track = spark.sparkContext.statusTracker()
    # the last stage, whose results the driver gets, is one task
    last = max(s for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds)
    assert track.getStageInfo(last).numTasks == 1


@pytest.mark.parametrize("folder", [True, False])
def test_tables_as_streams(spark, folder):
    d = tempfile.mkdtemp(prefix="lipi-table-")
    rows = spark.createDataFrame([(i, f"word{i} and more words of a longer line") for i in range(9)], "doc_id long, text string")
    path = f"{d}/documents.parquet"
    rows.repartition(3).write.parquet(path if folder else f"{d}/other")
    if not folder:
        rows.toPandas().to_parquet(path)
    got = {r["word"]: r["cnt"] for r in stream_queries.stream_word_counts(spark, d).collect()}
    assert got["and"] == 9 and all(got[f"word{i}"] == 1 for i in range(9))


def test_feed_chunks_are_dealt_out(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="lipi-table-")
    spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    monkeypatch.setattr(feed, "stream_word_counts", lambda spark, docs, partitions=None: (docs, partitions))
    docs, partitions = stream_queries._feed(spark, d)
    assert docs.isStreaming and "Repartition" in docs._jdf.queryExecution().analyzed().toString()
    assert partitions >= spark.sparkContext.defaultParallelism


def test_first_lines_by_key(spark):
    long = " has a line that is longer than thirty characters"
    rows = [(i, f"t{i}{long}" if i % 3 else "short") for i in range(200)] + [(None, "none" + long), (None, "short"), (5, "again" + long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(((r["doc_id"], r["line"]) for r in eval_lines_of(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = [(r["doc_id"], r["line"]) for r in encode_queries._first_lines(docs, 50).collect()]
    assert len(got) == 50 and [k for k, _ in want[:50]] == sorted((k for k, _ in got), key=lambda k: (k is not None, k or 0))
    assert set(got) <= set(want) and encode_queries._first_lines(docs, 1000).count() == len(want)


def test_pointer_has_no_checksum_file(spark):
    d = tempfile.mkdtemp(prefix="lipi-model-")
    for version in ("one", "two"):
        artefacts._point_to(spark, d, version)
        assert artefacts.current_version(spark, d) == f"{d}/versions/{version}"
        assert os.listdir(d) == ["CURRENT"]


def test_exact_dedup_passes_small_batches(spark, monkeypatch):
    seen = []
    write = exact_dedup.staged
    monkeypatch.setattr(exact_dedup, "staged", lambda df, name: seen.append((name, spark.conf.get(common.BATCH_BYTES))) or write(df, name))
    before = spark.conf.get(common.BATCH_BYTES)
    docs = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(8)], "doc_id long, text string")
    assert exact_dedup.exact_groups(docs).where("kept").count() == 5
    sizes = dict(seen)
    assert int(sizes["fingerprints"]) == int(sizes["compared"]) == exact_dedup.BATCH
    assert spark.conf.get(common.BATCH_BYTES) == before

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])
    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("t"))
    with common.batches_of(spark, 50_000):
        assert max(r["n"] for r in texts.mapInArrow(rows, "n long").collect()) < 100


@pytest.mark.parametrize("make", [
    lambda spark, df: en.encode_ids(spark, df, MODEL),
    lambda spark, df: en.encode(spark, df, MODEL),
    lambda spark, df: en.decode(df.select("doc_id", F.array(F.lit(5)).alias("ids")), MODEL),
    lambda spark, df: en.word_positions(df),
    lambda spark, df: langid.predict(df, langid.Model()),
], ids=["ids", "encode", "decode", "words", "langid"])
def test_rows_pass_to_python_in_small_batches(spark, make):
    """Batches are bounded in bytes, not by 10,000 rows; a smaller setting stays."""
    df = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cab "), 700).alias("text"))

    def sizes():
        run = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]}) for b in batches)
        return df.mapInArrow(run, "n long, bytes long").collect()
    before = spark.conf.get(session.BATCH_BYTES)
    try:
        spark.conf.unset(session.BATCH_BYTES)
        make(spark, df)
        got = sizes()
        assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) <= 2 * session.SMALL_BATCH
        spark.conf.set(session.BATCH_BYTES, "65536")
        make(spark, df)
        assert spark.conf.get(session.BATCH_BYTES) == "65536"
    finally:
        spark.conf.set(session.BATCH_BYTES, before)
