import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lipi.llm import packing as P, separator_scan as Q
from lipi.llm.tokens import WordTokenizer, tokenizer_path

from .helpers import sample_docs, table

TOK = Tokenizer.from_file(tokenizer_path())
FAST = WordTokenizer(tokenizer_path())


def plain(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def awkward():
    return [(1, None), (2, ""), (3, " lead  and\n trail "), (4, "x" * 5000), (5, "a b c  d\t e"),
            (6, "<|endoftext|> special <|endoftext|>"), (7, "w " * 40000), (8, "same"), (8, "same"), (None, "no id"),
            (9, "don't we'll  'tis\r\n\r\n ok"), (10, "日本語 テスト 😀 é")]


def test_packs_every_id_once_with_little_padding(spark):
    rows = sample_docs(spark) + [(None if d is None else d + 10_000, t) for d, t in awkward() if d not in (8, None)]
    ids = {r[0]: plain(r[1]) + [0] for r in rows}
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in P.pack(table(spark, rows), with_ids=True).collect():
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert np.frombuffer(r.ids, "<u4").tolist() == part
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        docs[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for d, want in ids.items():
        at = 0
        for start, length in sorted(docs[d]):
            assert start == at and length > 0
            at += length
        assert at == len(want)
    fill = 0
    for s in seqs.values():
        at = 0
        for off, length in sorted(s):
            assert off == at
            at += length
        assert at <= P.CAPACITY
        fill += at
    assert fill / (P.CAPACITY * len(seqs)) > 0.98


def test_repeated_rows_null_ids_and_empty_table(spark):
    got = P.pack(table(spark, [(8, "same"), (8, "same"), (None, "no id"), (1, None)])).collect()
    assert sorted((r.doc_id or -1, r.doc_tokens) for r in got) == [(-1, 3), (1, 1), (8, 2), (8, 2)]
    assert P.pack(table(spark, [])).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10_000))
def test_cut_fills_its_class(n):
    got = P.cut(n)
    assert sum(length for length, _ in got) == n
    assert all(P.CAPACITY - P.SLACK <= k * length <= P.CAPACITY for length, k in got)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1 .'\n\t  é日<|")), max_size=40))
def test_word_cache_equals_tokenizer(text):
    assert np.frombuffer(FAST.encode([text])[0], "<u4").tolist() == plain(text)


def test_ordinary_texts_take_the_short_way(monkeypatch):
    """Plain words and texts of single spaces need neither costly pattern."""
    from lipi.llm import tokens as T

    class Never:
        def __getattr__(self, name):
            raise AssertionError(name)
    texts = ["One word, two words; three.", "word words. word!", "", "a", "tail. tail"]
    want = [plain(t) for t in texts]
    monkeypatch.setattr(T, "_NEAR_SPACE", Never())
    monkeypatch.setattr(T, "_PLAIN", Never())
    tok = T.WordTokenizer(tokenizer_path())
    short = [[t for t in texts if t]]
    got = tok.encode(short[0])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [w for t, w in zip(texts, want) if t]


def test_first_fit_keeps_ids_of_any_size():
    import pyarrow as pa
    from lipi.llm.packing import first_fit
    big = (1 << 62) + 1
    tail = pa.table({"doc_id": pa.array([None, big, 5, big], pa.int64()), "start": [0, 0, 0, 9], "length": [3, 3, 7, 8],
                     "full": [2, 2, 2, 2]})
    got = first_fit(tail, 10).select(["doc_id", "start", "length", "sequence_id", "offset"]).to_pylist()
    assert [tuple(r.values()) for r in got] == [(big, 9, 8, 2, 0), (5, 0, 7, 3, 0), (big, 0, 3, 3, 7), (None, 0, 3, 4, 0)]


def test_separator_scan_counts_every_document(spark):
    rows = sample_docs(spark, n=40) + [(d if d is None else d + 10_000, t) for d, t in awkward()]
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    want = sorted(((r[0], len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=repr)
    manifest = Q.write_flat(table(spark, rows))
    for block in (1 << 20, 7, 100):                # documents cross blocks, blocks without separators
        counted = Q.count_documents(manifest.select("file").distinct(), block_tokens=block)
        got = manifest.join(counted, ["file", "place"]).select("doc_id", "n_tokens").collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert Q.token_counts(table(spark, [])).collect() == []


def test_separator_scan_of_odd_files(spark, tmp_path):
    def file(name, ids):
        p = tmp_path / name
        p.write_bytes(np.array(ids, "<u2").tobytes())
        return str(p)
    end = Q.END_OF_TEXT
    names = {file("a", [1, 2, end, end, 3]): [2, 0, 1], file("b", []): [], file("c", [end]): [0], file("d", [5] * 9): [9]}
    df = spark.createDataFrame([(n,) for n in names], "file string")
    for block in (2, 3, 100):
        got = defaultdict(list)
        for r in sorted(Q.count_documents(df, block_tokens=block).collect(), key=lambda r: r.place):
            got[r.file].append(r.n_tokens)
        assert dict(got) == {k: v for k, v in names.items() if v}


def test_words_with_any_marks_are_asked_of_the_model_alone():
    class NoPipeline:
        def encode_batch_fast(self, texts, **_):
            assert not texts, texts
    text = "plain word&&& word### öl%%% (not) x_y a/b\nthese$$$\nlines*** end{}|~"
    whole = [w for w in text.split(" ") if w not in ("(not)", "x_y", "a/b\nthese$$$\nlines***")]
    w = WordTokenizer(tokenizer_path())
    w.tok = NoPipeline()
    assert [np.frombuffer(x, "<u4").tolist() for x in w.encode([" ".join(whole)])] == [plain(" ".join(whole))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Be", "é", "ß", "'", "s", "&", "#", "<|endoftext|>", "<|", "_", "%$", ".", "\"", "`", "~", "7",
                                 " ", "\n", "\t"]), max_size=30).map("".join))
def test_marks_give_the_ids_of_the_whole_pipeline(text):
    assert np.frombuffer(FAST.encode([text])[0], "<u4").tolist() == plain(text)
