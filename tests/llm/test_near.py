import numpy as np

from lipi.llm import superminhash as S
from lipi.llm.components import components

from .helpers import near_pairs, roots, sample_docs, shingles, table


def check(spark, rows):
    sets = {}
    for d, t, *_ in rows:
        if d is not None:
            sets[d] = shingles(t)
    up = roots(sets, near_pairs(sets))
    got = S.near_groups(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), up[r.doc_id], up[r.doc_id] == r.doc_id)


def test_brute_force(spark):
    check(spark, sample_docs(spark))


def test_awkward_rows(spark):
    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base[:j] + ["X"] + base[j + 1:]) for j in range(0, 60, 3)]
    rows = [(100 + i, t) for i, t in enumerate(near)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"),
             (7, "ONE two three four\nfive"), (8, " ".join(base)), (8, " ".join(base)), (None, " ".join(base)),
             (9, "long " * 60000), (10, "long " * 60001)]
    check(spark, rows)


def test_many_components_in_one_bucket(spark, monkeypatch):
    # two rows a band make crowded buckets of documents that are not linked
    monkeypatch.setattr(S, "BLOCK", 4)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, shared + " " + " ".join(f"p{i // 2}x{j}" for j in range(10))) for i in range(40)]
    check(spark, rows)


def test_empty_table(spark):
    assert S.near_groups(table(spark, [])).collect() == []


def test_signature_is_minimum_over_elements_and_early_stop():
    rng = np.random.default_rng(1)
    elem = rng.integers(0, 2**63, 300).astype(np.uint64)
    a = S.signatures(np.zeros(300, np.int64), elem, 1)
    parts = [S.signatures(np.zeros(1, np.int64), elem[i:i + 1], 1)[0] for i in range(300)]
    assert (a[0] == np.min(parts, axis=0)).all()            # full permutations, joined by min
    assert sorted(parts[0] >> 32) == list(range(S.M))       # the ranks of one element are a permutation


def test_estimate_has_low_error():
    rng = np.random.default_rng(2)
    err = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 250).astype(np.uint64)
        x, y = pool[:200], pool[50:]
        sx, sy = (S.signatures(np.zeros(200, np.int64), z, 1)[0] for z in (x, y))
        err.append((sx == sy).mean() - 150 / 250)
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.05


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1000), (None, 3), (700, 600)], "a long, b long")
    got = {r.node: r.component_id for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 600: 600, 700: 600}


def test_ids_near_the_end_of_the_range(spark):
    """Sums of ids do not fit: nothing adds them."""
    rows = sample_docs(spark)
    big = lambda i: (1 << 62) + i if i % 2 else -(1 << 62) - i
    sets = {big(d): shingles(t) for d, t, _ in rows}
    up = roots(sets, near_pairs(sets))
    from lipi.llm import exact_dedup as E, substring as U
    docs = table(spark, [(big(d), t) for d, t, _ in rows])
    got = {r.doc_id: r.component_id for r in S.near_groups(docs).collect()}
    assert got == up
    same = {}
    for d, t, _ in rows:
        same.setdefault(t or "", []).append(big(d))
    assert {r.doc_id: r.keep_id for r in E.exact_groups(docs).collect()} == {d: max(v) for v in same.values() for d in v}
    plain = {r.doc_id: r.n_removed for r in U.remove_repeats(docs).collect()}
    order = sorted(sets)
    small = table(spark, [(order.index(big(d)), t) for d, t, _ in rows])
    assert plain == {order[r.doc_id]: r.n_removed for r in U.remove_repeats(small).collect()}
