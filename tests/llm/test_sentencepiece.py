import numpy as np
import sentencepiece
from hypothesis import given, settings, strategies as st

from lipi.llm import sentencepiece_hf as S
from lipi.llm.tokens import tokenizer_path

from .helpers import sample_docs, table

PATH = tokenizer_path(S.PIECE_MODEL)
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
MINE = S.PieceTokenizer(PATH)


def test_parity_and_round_trip(spark):
    rows = sample_docs(spark) + [(1000, None), (1001, ""), (1002, "  two  spaces \n"), (1003, "emoji 😀 日本 ß"),
                                 (1004, "<s> x </s> <0x41>"), (1005, "a" * 30_000), (None, "x"), (None, "x")]
    text = {r[0]: r[1] or "" for r in rows}
    got = S.decode(S.encode(table(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == SP.encode(text[r.doc_id]) and r.n_tokens == len(ids) and r.parity
        assert r.decoded == text[r.doc_id] == SP.decode(ids)
    assert S.encode(table(spark, [])).collect() == []


def test_whole_texts_and_long_ones():
    """Cutting keeps the parity of whole texts; slices of a long text too."""
    import random
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeé日▁.ß") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    text = "".join(w + rnd.choice([" ", " ", " ", " ", "  ", "\n", " \n", "\u3000", "\t "]) for w in words)
    want = SP.encode(text)
    assert np.frombuffer(MINE.encode([text])[0][0], "<u4").tolist() == want
    for size in (1, 100, 5000):
        slices = list(MINE.slices(text, size))
        assert len(slices) > 1 and np.frombuffer(b"".join(i for i, _ in MINE.encode(slices)), "<u4").tolist() == want


def test_grouped_decoding_equals_the_decoder():
    """Any ids, not only those of texts."""
    import random
    rnd = random.Random(4)
    n = MINE.tok.get_vocab_size()
    lists = [[rnd.randrange(n) if rnd.random() < 0.5 else rnd.randrange(3, 262) for _ in range(rnd.randint(0, 30))] for _ in range(500)]
    got = MINE.decode([np.array(x, "<u4").tobytes() for x in lists])
    assert got == MINE.tok.decode_batch(lists, skip_special_tokens=False)


def test_differing_parts_are_told(spark, monkeypatch):
    """A part that the two libraries encode differently costs parity, in both ways of telling."""
    docs = [(1, "same words"), (2, "same odd words"), (3, None), (4, "odd")]
    real = S.unequal_parts
    monkeypatch.setattr(S, "unequal_parts", lambda parts, *a: parts.where("part = 'odd'"))
    got = {r.doc_id: r.parity for r in S.encode(table(spark, docs)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
    monkeypatch.setattr(S, "unequal_parts", real)
    monkeypatch.setattr(S, "BAD_PARTS", -1)        # every worker compares whole texts itself
    assert all(r.parity for r in S.encode(table(spark, docs)).collect())
    parts = {r.part for r in S.distinct_parts(S._rows(table(spark, docs), "doc_id", "text"), PATH).collect()}
    assert parts == {"same", "words", "odd", ""} and S.unequal_parts(spark.createDataFrame([(p,) for p in parts], "part string"), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z.\n\té日▁😀<s>0")), max_size=30))
def test_parity_on_random_text(text):
    assert np.frombuffer(MINE.encode([text])[0][0], "<u4").tolist() == SP.encode(text)


def test_unigram_models_are_rebuilt():
    def field(n, kind, payload):
        return bytes([n << 3 | kind]) + payload

    def text(b):
        return bytes([len(b)]) + b
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("▁a", -1.0, 1), ("b", -1.5, 1), ("ab", -1.2, 1), ("a", -3.0, 1)]
    data = b""
    for p, s, k in pieces:
        body = field(1, 2, text(p.encode())) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k]))
        data += field(1, 2, text(body))
    data += field(2, 2, text(field(3, 0, b"\x01"))) + field(3, 2, text(field(4, 0, b"\x00")))
    model = S.parse_model(data)
    assert [(p, round(s, 3), k) for p, s, k in model["pieces"]] == pieces and model["model_type"] == S.UNIGRAM
    tok = S.build(model)
    assert tok.encode("ab a").tokens == ["▁a", "b", "▁a"]
    assert tok.decode(tok.encode("ab a").ids) == "ab a"
