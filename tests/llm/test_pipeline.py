import corpus_pipeline as C
from tokenizers import Tokenizer

from lipi.llm import langid as L, pii
from lipi.llm.tokens import tokenizer_path

from .helpers import near_pairs, roots, sample_docs, shingles, table
from .test_langid import restated


def brute(spark, docs, rows):
    model = L.learn(docs.where(~L.held_out()))
    kept = [(d, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t) and restated(model, t)[2]]
    last = {}
    for d, t in kept:
        last[t] = max(last.get(t, -1), d)
    kept = [(d, t) for t, d in last.items()]
    sets = {d: shingles(t) for d, t in kept}
    up = roots(sets, near_pairs(sets))
    kept = [(d, t) for d, t in kept if up[d] == d]
    new = pii.replace_entities(table(spark, kept), pii.session_key(spark)).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    return {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in new}


def test_pipeline_equals_brute_force(spark):
    rows = sample_docs(spark, n=100)
    rows += [(1000, None, None), (1001, "", None), (1002, "12 34", None), (1003, rows[0][1], rows[0][2]),
             (1003, rows[0][1], rows[0][2]), (1004, rows[1][1] + " extra", rows[1][2])]
    docs = table(spark, rows)
    want = brute(spark, docs, rows)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        docs = C.staged(out, name)
    got = {}
    for r in C.STAGES[-1][1](spark, docs, "").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want


def test_pipeline_of_an_empty_table(spark):
    docs = table(spark, [])
    for name, stage in C.STAGES:
        docs = C.staged(stage(spark, docs, ""), name)
    assert docs.count() == 0


