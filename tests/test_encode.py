"""Encode / decode / alignment against plain-Python statements."""

import hashlib
import re
import unicodedata

import regex
from pyspark.sql import functions as F

from lipi.operators import encode as en
from lipi.operators.encode import BpeModel, _tables, encode_word

VOCAB = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", ",", ".", "a", "b", "c", "d", "ि", "क", "न",
         "ab", "abc", "कि")
MODEL = BpeModel(VOCAB, (("a", "b"), ("ab", "c"), ("क", "ि")))

TEXTS = ["abc abd, cab.", "  a  b ", "", "किन abc", "x [CLS] ab[SEP]", "ﬁabc ½", "a b"]


def py_encode(text):
    tok2id, ranks, _ = _tables(MODEL)
    out = []
    specials = r"\[PAD\]|\[UNK\]|\[CLS\]|\[SEP\]|\[MASK\]"
    for m in regex.finditer(rf"{specials}|\w+|(?:(?!{specials})[^\w\s])+", unicodedata.normalize("NFKC", text)):
        if m.group() in VOCAB[:5]:
            out.append((m.group(), VOCAB.index(m.group())))
        else:
            out += [("[UNK]" if i == 1 else t, i) for t, i in encode_word(m.group(), tok2id, ranks)]
    return out


def test_encode_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in en.encode(spark, df, MODEL).collect()}
    for i, t in enumerate(TEXTS):
        exp = py_encode(t)
        assert rows[i]["tokens"] == [x for x, _ in exp], t
        assert rows[i]["ids"] == [x for _, x in exp], t


def test_offsets_slice_back_on_stable_text(spark):
    texts = ["abc abd, cab.", "किन  abc", "x [CLS] ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in en.token_offsets(en.encode(spark, df, MODEL)).collect():
        piece = texts[r["doc_id"]][r["start"]:r["end"]]
        assert piece == r["token"] or r["token"] == "[UNK]" and len(piece) == 1


def test_offsets_under_nfkc_cover_original_span(spark):
    df = spark.createDataFrame([(0, "ﬁabc")], "doc_id long, text string")
    rows = en.token_offsets(en.encode(spark, df, MODEL)).orderBy("token_idx").collect()
    # "ﬁ" -> "fi": both characters are unknown and map to the ligature's span.
    assert [(r["start"], r["end"]) for r in rows] == [(0, 1), (0, 1), (1, 4)]


def test_word_positions_and_overlap_match_brute_force(spark):
    texts = ["abc abd, cab.", "  किन abc x", "ﬁab ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = en.word_positions(df)
    wrows = words.collect()
    for r in wrows:
        assert texts[r["doc_id"]][r["start"]:r["end"]] == r["word"]
    exp_w = {(i, k, m.group(), m.start(), m.end()) for i, t in enumerate(texts)
             for k, m in enumerate(re.finditer(r"\S+", t))}
    assert {(r["doc_id"], r["word_idx"], r["word"], r["start"], r["end"]) for r in wrows} == exp_w


# list as sent -> parsed ids (None: not a list of ids), text, status
ID_LISTS = [
    ("1,2", [1, 2], "[UNK] [CLS]", "ok"), ("1,,2", [1, 2], "[UNK] [CLS]", "ok"), (" 3 ", [3], "[SEP]", "ok"),
    ("", [], "", "ok"), ("x", None, None, "invalid_id_list"), ("1.5", None, None, "invalid_id_list"),
    ("99999999999", None, None, "invalid_id_list"), ("-1", None, None, "invalid_id_list"),
    ("16", [16], "कि", "ok"), ("१२", [12], "क", "ok"), ("+4", [4], "[MASK]", "ok"),
    ("4294967295", [4294967295], "", "unknown_id"), ("17,7", [17, 7], "a", "unknown_id"),
]


def test_parse_ids_edge_rows(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ID_LISTS)], "doc_id long, ids string")
    rows = {r["doc_id"]: r for r in en.decode(df, MODEL, "doc_id", "ids").collect()}
    for i, (sent, ids, text, status) in enumerate(ID_LISTS):
        assert (rows[i]["ids"], rows[i]["text"], rows[i]["status"]) == (ids, text, status), sent


def test_decode_flags_null_and_negative_ids(spark):
    df = spark.createDataFrame([(0, [-1, 7]), (1, [None, 7]), (2, [7]), (3, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: (r["text"], r["status"]) for r in en.decode(df, MODEL).collect()}
    assert got[0] == got[1] == ("a", "unknown_id") and got[2] == ("a", "ok")


def test_large_vocabulary_plans_quickly(spark):
    import time
    model = BpeModel(tuple(f"t{i}" for i in range(50_000)), ())
    df = spark.createDataFrame([(0, [5, 49_999, 50_000])], "doc_id long, ids array<int>")
    t = time.time()
    row = en.decode(df, model).collect()[0]
    assert (row["text"], row["status"]) == ("t5 t49999", "unknown_id") and time.time() - t < 15


def slow_bpe(word, ranks):
    """Pair by pair, as the definition says."""
    syms = list(word)
    while True:
        found = [(ranks[p][0], i) for i, p in enumerate(zip(syms, syms[1:])) if p in ranks]
        if not found:
            return syms
        _, i = min(found)
        syms[i:i + 2] = [syms[i] + syms[i + 1]]


def test_word_merge_equals_definition_and_is_fast():
    import random
    import time
    rng = random.Random(4)
    for _ in range(200):
        merges, texts = [], ["a", "b", "c"]
        for _ in range(rng.randrange(1, 9)):
            pair = (rng.choice(texts), rng.choice(texts))
            if pair not in merges:
                merges.append(pair)
                texts.append(pair[0] + pair[1])
        tok2id, ranks, _ = _tables(BpeModel(VOCAB[:5] + tuple(dict.fromkeys(texts)), tuple(merges)))
        for _ in range(10):
            w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            assert [t for t, _ in encode_word(w, tok2id, ranks)] == slow_bpe(w, ranks), (w, merges)
    tok2id, ranks, _ = _tables(MODEL)
    t = time.time()
    assert len(encode_word("abc" * 33_334, tok2id, ranks)) == 33_334 and time.time() - t < 5


def test_alignment_is_exact_around_composing_characters(spark):
    """Hangul jamo, two-part Bengali and Tamil vowels: only the composed span
    is shared, every other offset is exact."""
    cases = {"\u1112\u1161\u11ab abc": [(0, 3), (4, 7)], "কো abc abd": None,
             "\u0b95\u0bc6\u0bbe abc": None, "\uff41\uff42 abc": [(0, 2), (3, 6)]}
    for text, spans in cases.items():
        norm, a, b = en.nfkc_with_alignment(text)
        assert norm == unicodedata.normalize("NFKC", text)
        at = norm.index("abc")
        assert (a[at], b[at + 2]) == (text.index("abc"), text.index("abc") + 3)
        assert max(y - x for x, y in zip(a, b)) <= 3
    df = spark.createDataFrame([(0, "কো abc abd abc")], "doc_id long, text string")
    e = en.encode(spark, df, MODEL)
    got = [(r["token"], r["start"], r["end"]) for r in en.token_offsets(e).orderBy("token_idx").collect()]
    text = "কো abc abd abc"
    cut = text.index("a")
    assert got[-4:] == [("abc", cut, cut + 3), ("ab", cut + 4, cut + 6), ("d", cut + 6, cut + 7), ("abc", cut + 8, cut + 11)]
    pairs = en.overlap_pairs(en.token_word_spans(e)).count()
    assert pairs == len(got)


def test_alignment_on_random_text():
    import random
    rng = random.Random(9)
    pool = "ab é\u0301\u1112\u1161\u11a8ক\u09c7\u09beﬁ½\u0327ＡＢ\u3099か"
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))
        norm, a, b = en.nfkc_with_alignment(t)
        assert norm == unicodedata.normalize("NFKC", t), t.encode("unicode_escape")
        assert len(norm) == len(a) == len(b) and all(x < y for x, y in zip(a, b)) and a == sorted(a)


def test_words_without_tokens_stay(spark):
    texts = ["abc abd, cab.", "  किन abc x", "ﬁab ab", "", "a b  c\td"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sp = en.token_word_spans(en.encode(spark, df, MODEL))
    pairs = {}
    for r in en.overlap_pairs(sp).collect():
        pairs.setdefault((r["doc_id"], r["word_idx"]), []).append(r["token_idx"])
    got = {(r["doc_id"], r["word_idx"]): list(range(r["tlo"], r["thi"])) for r in en.word_token_ranges(sp).collect()}
    assert got == {(i, k): sorted(pairs.get((i, k), [])) for i, t in enumerate(texts) for k, _ in enumerate(t.split())}
    wt, ws, lo, hi, tlo, thi = en._spans("ab cd ef", [0, 6], [2, 8])      # no token on the second word
    assert [(x, y) for x, y in zip(tlo.tolist(), thi.tolist())] == [(0, 1), (1, 1), (1, 2)]


def test_decode_skip_special(spark):
    df = spark.createDataFrame([(0, [2, 14, 1, 9])], "doc_id long, ids array<int>")
    assert en.decode(df, MODEL).collect()[0]["text"] == "[CLS] ab [UNK] c"
    assert en.decode(df, MODEL, skip_special=True).collect()[0]["text"] == "ab c"


def test_token_json_and_ratio_text(spark):
    import json
    model = BpeModel(VOCAB + ('"', "\\", "é"), MODEL.merges)
    df = spark.createDataFrame([(0, 'ab "c\\ é ñ')], "doc_id long, text string")
    e = en.encode(spark, df, model)
    got = e.select(en.token_json(e).alias("j")).collect()[0]["j"]
    r = e.collect()[0]
    exp = json.dumps([{"idx": i, "token": t, "id": n} for i, (t, n) in enumerate(zip(r["tokens"], r["ids"]))])
    assert got == exp
    vals = [2.225, 0.125, 1.005, 2.675, 0.375, 3.0]
    d = spark.createDataFrame([(v,) for v in vals], "r double")
    assert [x["t"] for x in d.select(en.ratio_text(F.col("r")).alias("t")).collect()] == [f"{v:.2f}" for v in vals]


def test_md5_fold_equals_python(spark):
    from lipi.functions.ids import hsl_color, md5_bucket
    df = spark.range(0, 300).select(F.col("id").cast("string").alias("k"))
    rows = df.select("k", md5_bucket(F.col("k"), 360).alias("h"), hsl_color(F.col("k")).alias("c")).collect()
    for r in rows:
        h = int(hashlib.md5(r["k"].encode()).hexdigest(), 16)
        assert r["h"] == h % 360
        assert r["c"] == f"hsl({h % 360}, {60 + h % 30}%, {75 + h % 15}%)"


def test_decode_cleanup_option(spark):
    model = BpeModel(("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "a", ".", "'", "s", ",", "n't"), ())
    df = spark.createDataFrame([(0, [5, 9, 5, 7, 8, 5, 6])], "doc_id long, ids array<int>")
    assert en.decode(df, model).collect()[0]["text"] == "a , a ' s a ."
    assert en.decode(df, model, cleanup=True).collect()[0]["text"] == "a, a's a."


def test_row_local_spans_match_brute_force(spark):
    """The in-row binary search gives the same token/word pairs and labels
    as a plain nested loop over the spans."""
    texts = ["abc abd, cab.", "  किन abc x", "ﬁab ab", "", "a b  c\td"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sp = en.token_word_spans(en.encode(spark, df, MODEL))
    toks = en.token_offsets(en.encode(spark, df, MODEL)).collect()
    words = {i: [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", t)] for i, t in enumerate(texts)}
    brute = {(t["doc_id"], t["token_idx"], k) for t in toks for k, (_, ws, we) in enumerate(words[t["doc_id"]])
             if t["start"] is not None and t["start"] < we and t["end"] > ws}
    got = {(r["doc_id"], r["token_idx"], r["word_idx"]) for r in en.overlap_pairs(sp).collect()}
    assert got == brute
    labels = {(r["doc_id"], r["token_idx"]): r["label"] for r in en.token_word_ranges(sp).select(
        "doc_id", "token_idx", en.token_label(F.col("lo"), F.col("hi"), F.col("wt")).alias("label")).collect()}
    for t in toks:
        ks = sorted(k for d, ti, k in brute if d == t["doc_id"] and ti == t["token_idx"])
        assert labels[(t["doc_id"], t["token_idx"])] == ", ".join(words[t["doc_id"]][k][0] for k in ks[:2])


def test_spans_null_and_blank_text(spark):
    df = spark.createDataFrame([(0, None), (1, "   "), (2, "ab")], "doc_id long, text string")
    sp = en.token_word_spans(en.encode(spark, df, MODEL))
    got = sorted((r["doc_id"], r["token_idx"], r["word_idx"]) for r in en.overlap_pairs(sp).collect())
    assert got == [(2, 0, 0)]
    assert {r["doc_id"]: r["wt"] for r in sp.collect()} == {0: None, 1: [], 2: ["ab"]}


def spans(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int, start int, end int")


def test_overlap_of_two_span_tables(spark):
    """Any spans, from different tables, against all pairs; each pair once."""
    import random
    rnd = random.Random(5)

    def make(n):
        out = []
        for i in range(n):
            a = rnd.randint(0, 700)
            out.append((rnd.randint(0, 2), i, a, a + rnd.choice([0, 1, 3, 40, 200])))
        return out + [(0, n, None, 4), (1, n + 1, 9, None), (7, n + 2, 0, 5), (None, n + 3, 0, 9)]
    left, right = make(150), make(120)
    want = sorted((a[0], a[1], b[1]) for a in left for b in right
                  if a[0] is not None and a[0] == b[0] and None not in (a[2], a[3], b[2], b[3])
                  and a[3] > a[2] and b[3] > b[2] and a[2] < b[3] and a[3] > b[2])
    for block in (1, 64, 10_000):
        got = en.overlap_join(spans(spark, left, "token_idx"), spans(spark, right, "word_idx"), "doc_id", block)
        assert got.columns == ["doc_id", "token_idx", "start", "end", "word_idx", "r_start", "r_end"]
        assert sorted((r.doc_id, r.token_idx, r.word_idx) for r in got.collect()) == want
    assert en.overlap_join(spans(spark, [], "a"), spans(spark, right, "b"), "doc_id").collect() == []


def test_dictionary_encoding_equals_row_local(spark, monkeypatch):
    model = BpeModel(("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "a", "b", "c", "ab", "bc", "abc"),
                     (("b", "c"), ("a", "b"), ("a", "bc")))
    docs = [(1, "abc ab abc"), (2, ""), (3, None), (4, "the abc " * 50), (5, "ab[CLS]  xａｂ"), (6, "  "), (7, "c" * 5000)]
    docs += [(100 + i, "abc w%d" % (i % 3)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {r.doc_id: list(r.ids or []) for r in en.encode_ids(spark, df, model).collect()}
    for share in (10_000, 5, 0):             # all words hot, some, none
        monkeypatch.setattr(en, "HOT_SHARE", share)
        got = en.encode_dictionary(spark, df, model).collect()
        assert len(got) == len(docs) and {r.doc_id: list(r.ids) for r in got} == want


def test_functions_and_table_function_in_sql(spark):
    from lipi.functions import sql
    model = BpeModel(("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "a", "b", "c", "ab", "bc", "abc"),
                     (("b", "c"), ("a", "b"), ("a", "bc")))
    other = BpeModel(("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "a", "b"), ())
    sql.register(spark, model)
    sql.register(spark, other, "plain")
    df = spark.createDataFrame([(1, "abc ab [CLS]x"), (2, None), (3, ""), (4, "ａb")], "k int, t string")
    got = {r.k: (r.ids, r.d, r.p) for r in spark.sql("""
        SELECT k, lipi_encode(lipi_pieces(t)) AS ids, lipi_decode(array(10, 3, 99, 8)) AS d, plain_encode(plain_pieces(t)) AS p
        FROM {df}""", df=df).collect()}
    assert got == {1: ([10, 8, 2, 1], "abc [SEP] ab", [5, 6, 1, 5, 6, 2, 1]), 2: ([], "abc [SEP] ab", []),
                   3: ([], "abc [SEP] ab", []), 4: ([8], "abc [SEP] ab", [5, 6])}
    rows = spark.sql("SELECT d.k, x.* FROM (SELECT k, lipi_pieces(t) AS p FROM {df}) d, LATERAL lipi_tokens(d.p) x", df=df).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "abc", 10, 0, 3), (1, 1, "ab", 8, 4, 6), (1, 2, "[CLS]", 2, 7, 12),
                                        (1, 3, "[UNK]", 1, 12, 13), (4, 0, "ab", 8, 0, 2)]
    off = en.token_offsets(en.encode(spark, df.where("k = 1"), model, "k", "t"), "k")
    assert sorted(map(tuple, off.collect())) == [r for r in sorted(map(tuple, rows)) if r[0] == 1]


def test_first_rows_by_key_ranges(spark, tmp_path):
    from lipi.session import first_by_key
    rows = [(k // 2 if k % 7 else None, k) for k in range(4000)]          # two rows a key, some without
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "k long, v long").repartitionByRange(5, "k").write.parquet(path)
    source, seen = spark.read.parquet(path), []

    def make(part):
        seen.append(part)
        return part.where("v % 3 = 0")
    kept = sorted((k, v) for k, v in rows if k is not None and v % 3 == 0)
    for n in (1, 40, 500, 5000):
        seen.clear()
        got = first_by_key(source, "k", n, make, "k", "v")
        assert [tuple(r) for r in got.collect()] == kept[:n]
        read = sum(p.count() for p in seen)
        assert n == 5000 or read < 12 * n + 100                          # only the ranges that were needed
    plan = seen[0]._jdf.queryExecution().toString()
    assert first_by_key(source.where("k < 0"), "k", 3, make).collect() == []
    assert "PushedFilters" in plan
