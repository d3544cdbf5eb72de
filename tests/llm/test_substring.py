import hashlib
import random

from lipi.llm import substring as S

from .helpers import sample_docs, table, words


def expected(rows, window=50):
    first, out = {}, []
    for d, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), d)
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i:i + window])] < d:
                    gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest())
                   for r in S.remove_repeats(table(spark, rows), **kw).collect()), key=repr)


def awkward():
    rng = random.Random(3)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, edge = own(63), own(50)
    rows = [(i, " ".join(own(30) + passage[:50 + i % 14] + own(30))) for i in range(10, 40)]
    rows += [(40, " ".join(edge)), (41, "\n".join(edge)), (42, " ".join(edge[:49])), (43, " ".join(edge + edge)),
             (44, None), (45, ""), (46, "a " * 70), (47, "a " * 200), (48, "b " * 30000), (49, "b " * 100),
             (43, " ".join(edge + edge)), (None, " ".join(edge)), (5, " ".join(own(20) + passage)),
             (60, "É\t" + " ".join(edge) + "\x0b\x0cend")]
    return rows


def test_brute_force(spark):
    rows = sample_docs(spark, n=150)
    assert got(spark, rows) == expected(rows)


def test_awkward_rows(spark):
    assert got(spark, awkward()) == expected(awkward())


def test_crowded_anchors_and_several_shards(spark):
    assert got(spark, awkward(), shard=2, trim=1) == expected(awkward())
    assert got(spark, awkward(), shard=2, trim=99) == expected(awkward())


def test_empty_table(spark):
    assert got(spark, []) == []


def test_automaton_names_first_owner():
    rng = random.Random(5)
    for _ in range(50):
        docs = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(4)]
        sam = S.SuffixAutomaton()
        for i, d in enumerate(docs):
            sam.add(d, i)
        ask = [rng.randrange(3) for _ in range(30)]
        for size in (1, 3, 6):
            want = [next((i for i, d in enumerate(docs) if any(d[j:j + size] == ask[p:p + size]
                    for j in range(len(d) - size + 1))), None) for p in range(30 - size + 1)]
            assert sam.owners(ask, size) == want
