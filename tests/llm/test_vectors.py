import numpy as np

from lipi.llm import nndescent as N

from .helpers import roots


def run(spark, rows, kind="float", **kw):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, node int, bin string")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in N.near_vectors(df, **kw).collect()), key=repr)


def expected(rows, dtype=np.float32):
    by = {}
    for i, v in rows:
        if i is not None:
            by.setdefault(i, v)
    x = {}
    for i, v in by.items():
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            a = np.array(v, dtype).astype(float)
            x[i] = a / np.linalg.norm(a)
    pairs = [(a, b) for a in x for b in x if a < b and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.95]
    up, deg = roots(by, pairs), dict.fromkeys(by, 0)
    for a, b in pairs:
        deg[a] += 1
        deg[b] += 1
    return sorted([(i, deg[i], up[i], up[i] == i) for i in by] + [(None, 0, None, True) for i, _ in rows if i is None], key=repr)


def cloud(seed, groups, dim=32):
    rng, rows = np.random.default_rng(seed), []
    for size in groups:
        c = rng.standard_normal(dim)
        rows += [c + 0.08 * rng.standard_normal(dim) for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(int(i), [float(np.float32(c)) for c in rows[j]]) for i, j in enumerate(order)]


def test_brute_force_with_saturated_lists(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = cloud(1, [1] * 150 + [2] * 20 + [5] * 6 + [60])
    assert run(spark, rows) == expected(rows)
    assert N.near_vectors.recall >= N.TARGET


def test_awkward_rows(spark):
    rows = cloud(2, [3, 3, 1])
    v = rows[0][1]
    rows += [(100, None), (101, []), (102, [0.0] * 32), (103, [float("nan")] + v[1:]), (104, [None] + v[1:]),
             (105, v), (106, v), (106, v), (107, [2 * c for c in v]), (108, v[:5]), (None, v), (109, [float("inf")] + v[1:])]
    assert run(spark, rows) == expected(rows)


def test_double_vectors_and_empty_table(spark):
    rows = cloud(3, [1] * 20 + [4])
    rows += [(500, [1e-200, 2e-200]), (501, [1e200, 2e200]), (502, [1.0, 2.0])]
    got = run(spark, rows, kind="double")
    assert got == expected([(i, [c / max(map(abs, v)) for c in v]) for i, v in rows], np.float64)
    assert run(spark, []) == []


def search_of(spark, rows):
    df = spark.createDataFrame([(i, 1, np.array(v, "<f4").tobytes()) for i, v in rows], "node long, weight long, bin binary")
    return N.Descent(df, 4, N.THRESHOLD)


def test_audit_counts_nodes_not_links(spark):
    """A found dense group does not hide isolated pairs that were not found."""
    rows = cloud(4, [1] * 100 + [2] * 10 + [80])
    want = expected(rows)
    search = search_of(spark, rows)
    exact = [(i, n, n, c) for i, n, c, _ in want]
    missed = [(i, n, n if n > 1 else 0, c) for i, n, c, _ in want]
    schema = "node long, n_links long, n_nodes long, component_id long"
    assert search.audit(spark.createDataFrame(exact, schema)) == 1.0
    assert search.audit(spark.createDataFrame(missed, schema)) == 0.0


def test_audit_asks_until_it_meets_links(spark, monkeypatch):
    """No linked node among the first nodes asked: the others are asked."""
    monkeypatch.setattr(N, "AUDIT", 2)
    monkeypatch.setattr(N, "ASK_MAX", 64)
    rows = cloud(5, [1] * 300 + [2])
    none = spark.createDataFrame([(i, 0, 0, i) for i, _ in rows],
                                 "node long, n_links long, n_nodes long, component_id long")
    assert search_of(spark, rows).audit(none) == 0.0


def test_target_that_the_rounds_miss(spark, monkeypatch):
    """All pairs are compared then, by blocks, copies and lengths included."""
    for name, value in (("ROUNDS", 1), ("ITERATIONS", 0), ("TREES", 1), ("LEAF", 2), ("TILE", 24)):
        monkeypatch.setattr(N, name, value)
    rows = cloud(6, [1] * 60 + [2] * 20 + [4] * 3 + [40])
    rows += [(1000 + i, v) for i, v in rows[:5]] + [(2000, [1.0, 2.0]), (2001, [2.0, 4.0]), (2002, [2.0, 4.1]), (2003, [1.0])]
    assert run(spark, rows) == expected(rows)
    assert N.near_vectors.recall == 1.0
    assert run(spark, rows, target=1.01) == expected(rows)
    assert run(spark, []) == []


def test_ids_near_the_end_of_the_range(spark):
    rows = cloud(8, [1] * 30 + [3] * 5 + [20])
    rows = [((1 << 62) + i if i % 2 else -(1 << 62) - i, v) for i, v in rows]
    assert run(spark, rows) == expected(rows)
