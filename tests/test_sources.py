"""Line scans, page assembly, dumps, streaming = batch, chunks, artefacts."""

import bz2
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lipi.sources import corpus as src


# dump lines -> page bodies, written out by hand
DUMPS = [
    (["before", "<page>", "a", "b", "</page>", "between", "  <page>", "c", "  </page>"], ["a\nb", "c"]),
    (["<page>", "x", "<page>", "y", "</page>"], ["y"]),
    (["<page>", "</page>", "<page>", "never closed"], [""]),
    (["</page>", "<page>", "a", "</page>", "b", "</page>"], ["a"]),
]


def bodies_between_markers(lines):
    """From marker positions: a closing marker ends a page if the nearest
    marker before it is an opening one; the body is the slice in between."""
    marks = [(i, "<page>" in line) for i, line in enumerate(lines) if "<page>" in line or "</page>" in line]
    return ["\n".join(lines[a + 1:b]) for (a, opens), (b, again) in zip(marks, marks[1:]) if opens and not again]


def test_page_assembly_expected_bodies(spark):
    df = spark.createDataFrame([(i, "\n".join(d)) for i, (d, _) in enumerate(DUMPS)], "doc_id long, text string")
    got = src.page_bodies_from_lines(src.document_lines(df)).orderBy("doc_id", "page_start").collect()
    for i, (lines, bodies) in enumerate(DUMPS):
        assert [r["body"] for r in got if r["doc_id"] == i] == bodies == bodies_between_markers(lines)


def test_dump_pages_from_bz2(spark):
    d = tempfile.mkdtemp(prefix="lipi-dump-")
    long = "x" * 200_000
    body = ("head\n<page>\n  <title>A</title>\n  text [1] {{t}}\n</page>\n<page>\nB\n</page>\n"
            f"<page>\n</page>\n<page>\n{long}\n\n  </page>\n<page>\nopen\n")
    with bz2.open(os.path.join(d, "dump.xml.bz2"), "wt") as f:
        f.write(body)
    rows = src.dump_pages(spark, d).orderBy("page_no").collect()
    assert [r["body"] for r in rows] == ["  <title>A</title>\n  text [1] {{t}}", "B", "", long + "\n"]
    assert [r["page_no"] for r in rows] == [0, 1, 2, 3]


def test_dump_split_over_many_tasks(spark):
    """Pages keep their places when a bz2 file is read in several splits."""
    import random
    rnd = random.Random(3)
    bodies = ["".join(rnd.choice("abcdefgh \n") for _ in range(rnd.randint(1, 90_000))).strip("\n") for _ in range(90)]
    d = tempfile.mkdtemp(prefix="lipi-dump-")
    for name, part in (("a", bodies[:60]), ("b", bodies[60:])):
        with bz2.open(os.path.join(d, f"{name}.xml.bz2"), "wt", compresslevel=1) as f:
            f.write("head\n" + "".join(f"  <page>\n{b}\n  </page>\n<page>\nleft open\n" for b in part))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("134217728", "150000", "40000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            pages = src.dump_pages(spark, d)
            got = pages.orderBy("file_path", "page_no").collect()
            assert [r["body"] for r in got] == bodies
            assert [r["page_no"] for r in got] == [*range(60), *range(30)]
        assert pages.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_numbers_are_dense_over_splits(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="lipi-txt-")
    lines = [f"line {i} " + "x" * (i % 97) for i in range(5000)]
    for name, part in (("a", lines[:3000]), ("b", lines[3000:])):
        with open(os.path.join(d, name), "w") as f:
            f.write("\n".join(part) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for most in (src.MAX_BLOCK_ROWS, 0):        # offsets broadcast, and joined by a shuffle
            monkeypatch.setattr(src, "MAX_BLOCK_ROWS", most)
            rows = src.text_file_lines(spark, d)
            got = rows.orderBy("file_path", "line_no").collect()
            assert [r["line"] for r in got] == lines
            assert [r["line_no"] for r in got] == [*range(3000), *range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_text_file_lines_drop_bad_bytes(spark):
    d = tempfile.mkdtemp(prefix="lipi-txt-")
    with open(os.path.join(d, "c.txt"), "wb") as f:
        f.write(b"ok \xff\xfe bad\r\nsecond\rthird\n")
    rows = src.text_file_lines(spark, d).orderBy("file_path", "line_no").collect()
    assert [r["line_no"] for r in rows] == [0, 1, 2]
    assert [r["line"] for r in rows] == ["ok  bad", "second", "third"]


def test_stream_equals_batch_two_batches(spark):
    from lipi.operators.clean import clean_corpus
    from lipi.operators.counts import word_counts
    from lipi.streaming import feed
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    d = tempfile.mkdtemp(prefix="lipi-stream-src-")
    docs.filter("doc_id % 2 = 0").coalesce(1).write.parquet(f"{d}/part0")
    docs.filter("doc_id % 2 = 1").coalesce(1).write.parquet(f"{d}/part1")
    flat = tempfile.mkdtemp(prefix="lipi-stream-flat-")
    for i, p in enumerate(("part0", "part1")):
        f = [x for x in os.listdir(f"{d}/{p}") if x.endswith(".parquet")][0]
        os.link(f"{d}/{p}/{f}", f"{flat}/documents-{i}.parquet")
    stream = feed.file_stream(spark, flat, "documents-*.parquet", max_files_per_trigger=1)
    out = tempfile.mkdtemp(prefix="lipi-stream-out-")
    final, progress = feed.stream_word_counts(spark, stream, out_dir=out)
    rows = progress.collect()
    assert [r["batch"] for r in rows] == [0, 1] and sum(r["input_rows"] for r in rows) == docs.count()
    batch = word_counts(clean_corpus(docs), "clean")
    want = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, final.collect())) == want
    # a restart with nothing new changes nothing; with a new file it goes on
    again = feed.file_stream(spark, flat, "documents-*.parquet", max_files_per_trigger=1)
    assert sorted(map(tuple, feed.stream_word_counts(spark, again, out_dir=out)[0].collect())) == want
    more = spark.createDataFrame([(10**6, "restart " * 20, "en", "s", 1)], docs.schema)
    more.coalesce(1).write.parquet(f"{d}/part2")
    f = [x for x in os.listdir(f"{d}/part2") if x.endswith(".parquet")][0]
    os.link(f"{d}/part2/{f}", f"{flat}/documents-2.parquet")
    final, progress = feed.stream_word_counts(
        spark, feed.file_stream(spark, flat, "documents-*.parquet", max_files_per_trigger=1), out_dir=out)
    got = {r["word"]: r["cnt"] for r in final.collect()}
    assert got == {**dict(want), "restart": 20} and progress.count() == 3
    marks = feed.log_marks(progress, 50).collect()
    total = sum(r["lines"] for r in progress.collect())
    assert [r["mark"] for r in marks] == list(range(50, total + 1, 50))


def test_empty_feed_gives_no_words(spark):
    from lipi.streaming import feed
    d = tempfile.mkdtemp(prefix="lipi-empty-")
    stream = spark.readStream.schema("doc_id long, text string").parquet(d)
    final, progress = feed.stream_word_counts(spark, stream)
    assert final.collect() == [] and progress.collect() == [] and feed.log_marks(progress).collect() == []


def test_chunks_match_dense_numbering(spark):
    from lipi.operators import chunks as ch
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    lines = src.document_lines(docs)
    counts = docs.select("doc_id", F.size(src._file_lines(F.col("text"))).cast("long").alias("n"))
    got = {(r["doc_id"], r["line_no"]): r["line_idx"] for r in ch.line_chunks(lines, counts, chunk=97).collect()}
    keys = sorted(got)
    assert [got[k] for k in keys] == list(range(len(keys)))
    cc = {r["chunk_id"]: r["lines"] for r in ch.chunk_counts(counts, chunk=97).collect()}
    exp = {}
    for i in range(len(keys)):
        exp[i // 97] = exp.get(i // 97, 0) + 1
    assert cc == exp


def test_artefacts_round_trip(spark):
    from lipi.config import TrainParams
    from lipi.sources.artefacts import current_version, load_model, train_or_load
    lines = spark.createDataFrame([(0, "abc abd abc")], "doc_id long, line string")
    path = tempfile.mkdtemp(prefix="lipi-model-") + "/m"
    with pytest.raises(FileNotFoundError):
        load_model(spark, path)
    p = TrainParams(vocab_size=20, min_frequency=1)
    v1, m1, model1 = train_or_load(spark, lines, path, params=p)
    first = current_version(spark, path)
    v2, m2, model2 = train_or_load(spark, lines, path, params=p)
    assert model1 == model2 and "abc" in model2.vocab and current_version(spark, path) == first
    other = train_or_load(spark, lines, path, params=TrainParams(vocab_size=9, min_frequency=1))[2]
    assert len(other.vocab) < len(model1.vocab)              # other parameters: trained anew
    assert v1.count() == len(model1.vocab)                   # whoever reads the old version still can
    assert train_or_load(spark, lines, path, params=p, force=True)[2] == model1


def test_a_broken_or_concurrent_save_is_never_read(spark, monkeypatch):
    import threading
    from lipi.config import TrainParams
    from lipi.operators.bpe_train import train_bpe
    from lipi.sources import artefacts as A
    path = tempfile.mkdtemp(prefix="lipi-model-") + "/m"
    models = [train_bpe(spark, spark.createDataFrame([(0, t)], "doc_id long, line string"), params=TrainParams(vocab_size=99, min_frequency=1))
              for t in ("abc abd", "xyz xyw")]
    A.save_model(models[0].vocab, models[0].merges, path)
    # the trainer dies when all is written but the pointer
    with monkeypatch.context() as m:
        m.setattr(A, "_point_to", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            A.save_model(models[1].vocab, models[1].merges, path)
    assert "abc" in A.load_model(spark, path)[2].vocab
    assert A.drop_old_versions(spark, path) == 1
    # two trainers at once: one of them wins, whole
    runs = [threading.Thread(target=A.save_model, args=(m.vocab, m.merges, path)) for m in models]
    for t in runs:
        t.start()
    while any(t.is_alive() for t in runs):
        vocab, merges, model = A.load_model(spark, path)
        assert {a + b for a, b in model.merges} <= set(model.vocab)
    folder = A.current_version(spark, path)
    assert os.path.isdir(folder) and len(os.listdir(f"{path}/versions")) == 3
    assert A.drop_old_versions(spark, path) == 2 and A.load_model(spark, path)[2].vocab
    assert os.listdir(f"{path}/versions") == [os.path.basename(folder)]


def test_feed_killed_and_resumed(spark):
    """Stopped in the middle of a feed: state and counts go on where they were."""
    import time
    from lipi.operators.clean import clean_corpus
    from lipi.operators.counts import word_counts
    from lipi.streaming import feed
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(120)
    path, out = tempfile.mkdtemp(prefix="lipi-feed-") + "/f", tempfile.mkdtemp(prefix="lipi-feed-out-")
    feed.write_feed(docs, path, F.pmod("doc_id", F.lit(8)))
    assert len([d for d in os.listdir(path) if d.startswith("chunk=")]) == 8
    query, listener = feed.start_word_counts(spark, feed.file_stream(spark, path, "*.parquet"), out, partitions=2)
    for _ in range(600):
        if len([d for d in os.listdir(f"{out}/updates")] if os.path.isdir(f"{out}/updates") else []) >= 2:
            break
        time.sleep(0.1)
    query.stop()
    listener.ended.wait(30)
    spark.streams.removeListener(listener)
    half = feed.latest_counts(spark, out).count()
    final, progress = feed.stream_word_counts(spark, feed.file_stream(spark, path, "*.parquet"), out_dir=out, partitions=2)
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, word_counts(clean_corpus(docs), "clean").collect()))
    assert 0 < half < final.count()
    assert len(os.listdir(f"{out}/updates")) >= 8
    # the state is on disk, in RocksDB's own files
    assert any(f.endswith(".zip") for _, _, files in os.walk(f"{out}/_checkpoint/state") for f in files)


def test_progress_of_every_batch(spark):
    from lipi.operators.clean import clean_corpus
    from lipi.streaming import feed
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(90)
    path = tempfile.mkdtemp(prefix="lipi-feed-") + "/f"
    feed.write_feed(docs, path, F.pmod("doc_id", F.lit(5)))
    _, progress = feed.stream_word_counts(spark, feed.file_stream(spark, path, "*.parquet"), partitions=2)
    kept = {r[0]: r[1] for r in clean_corpus(docs).groupBy(F.pmod("doc_id", F.lit(5))).count().collect()}
    read = {r[0]: r[1] for r in docs.groupBy(F.pmod("doc_id", F.lit(5))).count().collect()}
    assert [tuple(r) for r in progress.collect()] == [(i, read[i], kept.get(i, 0)) for i in range(5)]


def test_write_corpus_counts_in_same_pass(spark):
    from lipi.operators.clean import clean_corpus, write_corpus
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    corpus = clean_corpus(docs)
    out = tempfile.mkdtemp(prefix="lipi-corpus-") + "/clean"
    stats = write_corpus(corpus, out)
    back = spark.read.text(out)
    assert stats["lines"] == back.count() == corpus.count()


def test_page_assembly_one_dump_over_many_buckets(spark):
    import random
    rnd = random.Random(7)
    lines = []
    for i in range(400):
        lines.append(rnd.choice(["<page>", "</page>", "text %d" % i, "text", "  <page>", "x </page>"]))
    df = spark.createDataFrame([(0, "\n".join(lines))], "doc_id long, text string")
    for b in (1, 7, 23):
        for block in (3, 64, 4096):
            got = src.page_bodies_from_lines(src.document_lines(df), buckets=b, block=block).orderBy("page_start").collect()
            assert [r["body"] for r in got] == bodies_between_markers(lines)
