import zlib

from pyspark.sql import functions as F

from lipi.llm import langid as L

from .helpers import sample_docs, table


def test_held_out_accuracy(spark):
    rows = sample_docs(spark, sf="/root/testdata/sf0.01", n=1000)
    docs = table(spark, rows)
    model = L.learn(docs.where(~L.held_out()))
    assert sorted(model) == sorted({r[2] for r in rows}) and all(len(v) <= L.DICT_BYTES for v in model.values())
    out = L.predict(docs, model).select("doc_id", L.held_out().alias("h"), "lang", "lang_pred", "score", "h").collect()
    test = [r for r in out if r[1]]
    assert {r.doc_id for r in test} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def restated(model, text):
    """The method in plain words, with the library's compressor only."""
    import zstandard as z

    def size(raw, data):
        d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=6)
        return len(z.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))
    raw, added = text.lower().encode(), {}
    for name, known in [*model.items(), ("", model.noise)]:
        total = 0
        for at in range(0, len(raw), 4096):
            block = raw[at:at + 4096]
            times = min(8, (1024 + len(block) - 1) // len(block))
            behind = [known[len(known) * i // 8:len(known) * i // 8 + 1024] for i in range(times)]
            total += sum(size(known, x + b" " + block) - size(known, x) for x in behind) / times
        added[name] = max(total, 0.5)
    none = added.pop("")
    (best, lang), (second, _) = sorted((v, k) for k, v in added.items())[:2]
    score, support = (second - best) / second, (none - best) / none
    low = model.limits.get(min(12, max(4, len(raw).bit_length())), (0, 0))
    return lang, score, score >= low[0] and support >= low[1]


def test_matches_plain_compression(spark):
    rows = [r for r in sample_docs(spark, n=45) if r[1]] + [(900, "zx qv wkj pfg", None), (901, "Le chat", None)]
    docs = table(spark, rows)
    model = L.learn(docs)
    got = {r.doc_id: (r.lang_pred, r.score, r.accepted) for r in L.predict(docs, model).collect()}
    want = {d: restated(model, t) for d, t, _ in rows if any(c.isalpha() for c in t)}
    assert {d: got[d] for d in want} == want and len(want) > 40


def test_rejection(spark):
    """Random letters go at every length, real documents and short clean texts stay."""
    import random
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang").where("doc_id % 3 = 0").collect()]
    docs = table(spark, rows)
    model = L.learn(docs.where(~L.held_out()))
    assert len(model.limits) == L.LONGEST - L.SHORTEST + 1
    real = L.predict(docs.where(L.held_out() & F.col("text").rlike(r"\p{L}")), model)
    n, kept = real.count(), real.where("accepted").count()
    assert n > 700 and kept / n >= 0.985
    rnd = random.Random(8)
    for words in (5, 30, 100, 300, 1000):
        texts = [(i, " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(words)))
                 for i in range(100)]
        assert L.predict(table(spark, texts), model).where("accepted").count() <= 5, words
    words = [(d, " ".join(t.split()[3:11])) for d, t, _ in rows if t and len(t.split()) > 40][:300]
    short = L.predict(table(spark, words), model)
    assert short.where("accepted").count() / len(words) > 0.9


def test_awkward_rows_and_learning_without_held_out(spark):
    rows = [(1, "der die das und ist nicht " * 20, "de"), (2, "the and of is not with many other words " * 20, "en"), (3, None, "en"),
            (4, "", "de"), (5, "12 34 !!", "de"), (6, "the and of is not with many other words " * 10_000, None), (None, "und die", None),
            (1, "der die das und ist nicht " * 20, "de"), (7, "Der Die UND", None)]
    docs = table(spark, rows)
    model = L.learn(docs)
    assert sorted(model) == ["de", "en"]
    got = L.predict(docs, model)
    assert set(docs.columns) <= set(got.columns)             # the input's score column is replaced
    pred = {r.text: (r.lang_pred, r.score) for r in got.collect()}
    assert pred[None] == pred[""] == pred["12 34 !!"] == ("und", 0.0)
    assert pred["the and of is not with many other words " * 10_000][0] == "en" and pred["Der Die UND"][0] == "de" and pred["und die"][0] == "de"
    assert L.predict(docs, L.Model()).where(F.col("lang_pred") != "und").count() == 0
    assert L.learn(table(spark, [])) == {} and L.predict(table(spark, []), model).count() == 0


def test_many_labels(spark, monkeypatch):
    import pytest
    rows = [(i, f"wort{i} " * 30, f"l{i % 300:03d}") for i in range(600)]
    model = L.learn(table(spark, rows))
    assert len(model) == 300 and L.predict(table(spark, rows[:3]), model).count() == 3
    monkeypatch.setattr(L, "MAX_LANGS", 299)
    with pytest.raises(ValueError):
        L.learn(table(spark, rows))


def test_one_language(spark):
    docs = table(spark, [(1, "the and of", "en"), (2, "of the", "en")])
    assert [(r.lang_pred, r.score) for r in L.predict(docs, L.learn(docs)).collect()] == [("en", 1.0)] * 2
