"""Training: batched rounds equal one merge per round; contract edges."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lipi.config import TrainParams
from lipi.operators.bpe_train import train_bpe, vocab_rows
from lipi.operators.encode import BpeModel, encode_word


def py_train(words, vocab_size, min_freq):
    """Plain one-merge-at-a-time statement of the contract (C15-C19)."""
    seqs = {w: list(w) for w in words}
    alpha = sorted({c for w in words for c in w}, key=ord)
    have = set(alpha)
    size = 5 + len(alpha)
    merges = []
    while size < vocab_size:
        pairs = {}
        for w, s in seqs.items():
            for a, b in zip(s, s[1:]):
                pairs[(a, b)] = pairs.get((a, b), 0) + words[w]
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda kv: (-kv[1], kv[0][0].encode(), kv[0][1].encode()))
        if n < min_freq:
            break
        merges.append((a, b, a + b, n))
        if a + b not in have:
            have.add(a + b)
            size += 1
        for w, s in seqs.items():
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            seqs[w] = out
    return alpha, merges


def lines_df(spark, lines):
    return spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "doc_id long, line string")


def test_overlapping_pairs_and_ties(spark):
    lines = ["aaa aaaa", "ab ab ba", "xy yx", "[CLS] is text"]
    res = train_bpe(spark, lines_df(spark, lines), "line", TrainParams(vocab_size=40, min_frequency=1))
    words = {}
    for w in " ".join(lines).replace("[", " [ ").replace("]", " ] ").split():
        words[w] = words.get(w, 0) + 1
    alpha, merges = py_train(words, 40, 1)
    assert res.merge_list == merges
    assert [t for _, t, _ in vocab_rows(alpha, merges)] == [r["token"] for r in res.vocab.orderBy("id").collect()]


def test_vocab_smaller_than_alphabet_and_min_frequency(spark):
    res = train_bpe(spark, lines_df(spark, ["abc abd"]), "line", TrainParams(vocab_size=3, min_frequency=2))
    assert res.merge_list == []
    assert res.vocab.count() == 5 + 4
    res = train_bpe(spark, lines_df(spark, ["abc abd"]), "line", TrainParams(vocab_size=100, min_frequency=2))
    assert [m[2] for m in res.merge_list] == ["ab"]
    res = train_bpe(spark, lines_df(spark, ["abc abd"]), "line", TrainParams(vocab_size=100, min_frequency=3))
    assert res.merge_list == []


def test_batched_equals_single_on_fixture(spark):
    from lipi.operators.clean import clean_corpus
    from lipi.session import read_table
    corpus = clean_corpus(read_table(spark, SF_SMALL, "documents")).persist()
    p = TrainParams(vocab_size=130, min_frequency=2)
    a = train_bpe(spark, corpus, "clean", p, batch=True)
    b = train_bpe(spark, corpus, "clean", p, batch=False)
    assert a.merge_list == b.merge_list
    assert a.rounds < b.rounds
    words = {r["word"]: r["cnt"] for r in
             __import__("lipi.operators.counts", fromlist=["x"]).word_counts(corpus, "clean").collect()}
    _, merges = py_train(words, 130, 2)
    assert a.merge_list == merges


def test_encode_word_lowest_rank_first():
    model = BpeModel(("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "a", "b", "c", "ab", "bc", "abc"),
                     (("b", "c"), ("a", "b"), ("a", "bc")))
    from lipi.operators.encode import _tables
    tok2id, ranks, _ = _tables(model)
    assert encode_word("abc", tok2id, ranks) == [("abc", 10)]
    assert encode_word("abab", tok2id, ranks) == [("ab", 8), ("ab", 8)]
    assert encode_word("aéb", tok2id, ranks) == [("a", 5), ("é", 1), ("b", 6)]


def test_same_merges_for_any_partitioning(spark):
    lines = ["the then there these", "other brother the", "aaa aaaa aa"] * 3
    out = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = lines_df(spark, lines).repartition(int(parts))
            out.append(train_bpe(spark, df, "line", TrainParams(vocab_size=60, min_frequency=2)).merge_list)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1] and out[0]


def test_full_size_queries(spark, monkeypatch):
    """Every query that needs a model has the whole vocabulary under its name."""
    import __spark_entry__ as E
    from lipi.plans import MODEL_QUERIES
    from lipi.plans import model_queries as M
    assert len(MODEL_QUERIES) > 30 and {"bpe_merges", "encode_documents", "stream_encode"} <= MODEL_QUERIES
    seen = []
    monkeypatch.setattr(M, "train_bpe", lambda s, lines, line, params: (
        seen.append(params), train_bpe(s, lines_df(s, ["ab ab"]), "line", params))[1])
    monkeypatch.setattr(M, "_MODELS", {})
    for name in ("vocab_size", "vocab_size_v160", "vocab_size"):
        E.queries()[name](spark, SF_SMALL)
    assert seen == [TrainParams(), M.CHECKED]


def test_thousands_of_merges_until_min_frequency(spark):
    """Late rounds, checkpoints and the end by min_frequency, against the plain trainer."""
    from lipi.operators.clean import clean_corpus
    from lipi.operators.counts import word_counts
    from lipi.session import read_table
    docs = read_table(spark, SF_SMALL, "documents").orderBy("doc_id").limit(40)
    corpus = clean_corpus(docs).persist()
    words = {r["word"]: r["cnt"] for r in word_counts(corpus, "clean").collect()}
    _, merges = py_train(words, 8000, 2)
    assert 2000 <= len(merges) < 5000
    assert train_bpe(spark, corpus, "clean", TrainParams(min_frequency=2)).merge_list == merges


def _random_words(seed, n=400):
    import random
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6))) for _ in range(30)]
    return {"".join(rnd.choice(stems) for _ in range(rnd.randint(1, 3))): rnd.randint(1, 60) for _ in range(n)}


def test_segment_rounds_equal_one_merge_at_a_time():
    """The bounded step itself, without Spark: any floor gives the plain trainer's merges."""
    from collections import Counter
    from lipi.operators import bpe_rounds as R
    for seed in range(6):
        words = _random_words(seed)
        _, want = py_train(words, 500, 2)
        for hot_pairs in (1, 3, 10, 100, 10_000):
            table, texts, got = {tuple(w): c for w, c in words.items()}, set("abcde"), []
            while True:
                count = Counter()
                for t, c in table.items():
                    for p in zip(t, t[1:]):
                        count[p] += c
                top = sorted(count.items(), key=lambda x: (-x[1], x[0]))
                if not top or top[0][1] < 2 or len(texts) + 5 >= 500:
                    break
                floor = max(2, top[hot_pairs][1] + 1 if len(top) > hot_pairs else 2)
                floor = min(floor, top[0][1])
                hot = frozenset(p for p, n in top if n >= floor)
                batch = R.pa.RecordBatch.from_arrays(
                    [R.pa.array([R.SYM_OPEN + R._JOIN.join(t) + R.SYM_CLOSE for t in table]), R.pa.array(list(table.values()))],
                    names=["sym", "cnt"])
                segments = [(r["seg"], r["cnt"]) for b in R.cut_words(hot)([batch]) for r in b.to_pylist()]
                chosen = R.choose(segments, floor, texts, 495 - len(texts))
                assert chosen
                got += [c[:4] for c in chosen]
                texts |= {c[2] for c in chosen}
                ranks = {(a, b): i for i, (a, b, *_) in enumerate(chosen)}
                merged = Counter()
                for t, c in table.items():
                    merged[tuple(R.apply_in_order(list(t), ranks))] += c
                table = merged
            assert got == want, (seed, hot_pairs)


def test_second_derivation_ends_the_round():
    """abc from (ab, c) and from (a, bc): the counts behind it are taken anew."""
    from lipi.operators import bpe_rounds as R
    segments = [("a\n\tbc", 9), ("abc\n\tx", 8), ("p\n\tq", 7)]
    assert R.choose(segments, 5, {"abc", "bc", "a", "x", "p", "q"}, 99) == [("a", "bc", "abc", 9, False)]


def test_bounds_of_a_round(spark, monkeypatch):
    """Too many segments: fewer hot pairs, in the end one merge a round."""
    from lipi.operators import bpe_train as B
    words = _random_words(11, 300)
    table = spark.createDataFrame(list(words.items()), "word string, cnt long")
    _, want = py_train(words, 60, 2)
    rounds = []
    for segments, hot in ((200_000, 4096), (60, 64), (0, 8)):
        monkeypatch.setattr(B, "MAX_SEGMENTS", segments)
        monkeypatch.setattr(B, "MAX_HOT", hot)
        res = train_bpe(spark, None, params=TrainParams(vocab_size=60, min_frequency=2), word_table=table)
        assert res.merge_list == want
        rounds.append(res.rounds)
    assert rounds[0] < rounds[1] < rounds[2] == len(want)


def test_a_word_of_many_symbols(spark):
    """A word is merged in O(L log L); the word table's folder is gone afterwards."""
    import os
    from lipi.session import ensure_checkpoint_dir
    words = {"ab" * 40_000 + "c": 3, "abc": 5}
    table = spark.createDataFrame(list(words.items()), "word string, cnt long")
    res = train_bpe(spark, None, params=TrainParams(vocab_size=14, min_frequency=2), word_table=table)
    assert [m[2] for m in res.merge_list][:2] == ["ab", "abab"] and len(res.merge_list) == 6
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    assert not [d for d in os.listdir(root) if d.startswith("bpe-")]
