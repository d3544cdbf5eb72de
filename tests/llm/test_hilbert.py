import numpy as np
import pytest

from lipi.llm import hilbert as H

ASKED = "vec_id % 5 = 0"


def run(spark, rows, kind="float", **kw):
    df = spark.createDataFrame([(i, v, 7, 0.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, block int, score double")
    return sorted(map(tuple, H.nearest(df, ASKED, **kw).collect()))


def usable(rows, kind):
    x = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x.setdefault(i, [float(kind(c)) for c in v])
    return x


def brute(rows, top=20, kind=np.float32):
    x, out = usable(rows, kind), []
    for q in x:
        if q % 5 == 0:
            scored = []
            for i, v in x.items():
                if i != q and len(v) == len(x[q]):
                    s = 0.0
                    for a, b in zip(x[q], v):
                        s += a * b
                    scored.append((-s, i))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def cloud(seed, n, dim=16, inner=3, scale=True):
    """Points near a plane of ``inner`` dimensions, of all lengths."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, inner)) @ rng.standard_normal((inner, dim)) + 0.05 * rng.standard_normal((n, dim))
    x *= rng.uniform(0.2, 2, (n, 1)) if scale else 1
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2), (1, 5)])
def test_curve_visits_every_cell_once_and_steps_to_a_neighbour(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    place = H.hilbert_places(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_lifted_points_order_by_inner_product():
    x = np.array([v for _, v in cloud(1, 50)])
    p, q = H.points(x, float(H._lengths(x).max()), False), H.points(x[:1], 1.0, True)
    assert np.argsort(((p - q) ** 2).sum(axis=1)).tolist() == np.argsort(-(x @ x[0])).tolist()


def test_one_block_is_exact(spark):
    rows = cloud(2, 200)
    assert run(spark, rows) == brute(rows)
    assert H.nearest.recall == 1.0


def test_windows_reach_the_target(spark, monkeypatch):
    """Many small blocks: narrow windows find nearly all, and the audit's figure is the true one."""
    monkeypatch.setattr(H, "BLOCK", 16)
    rows = cloud(3, 1500, scale=False)
    got, want = run(spark, rows, top=5, target=0.9), brute(rows, 5)
    share = len(set(got) & set(want)) / len(want)
    assert share >= 0.88 and 2 * H.nearest.radius + 1 < 1500 / 16
    assert len(got) == len(want) and abs(share - H.nearest.recall) < 0.1
    exact = {(q, i): s for q, _, i, s in brute(rows, 1500)}
    assert all(exact[q, i] == s for q, _, i, s in got)      # whatever is returned is scored exactly


def test_windows_grow_until_they_hold_the_whole_curve(spark, monkeypatch):
    """Vectors without structure and a target of all: the last window is exact."""
    monkeypatch.setattr(H, "BLOCK", 8)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(32)]) for i in range(300)]
    assert run(spark, rows, top=7, target=1.0) == brute(rows, 7)


def test_copies_ties_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 16)
    rows = cloud(5, 60)
    v = rows[10][1]
    rows += [(100 + i, v) for i in range(90)] + [(15, v), (300, None), (301, []), (302, [0.0] * 16), (305, [float("nan")] + v[1:]),
             (310, [None] + v[1:]), (315, [float("inf")] + v[1:]), (None, v), (320, v[:4]), (325, v[:4]), (330, [1.0] + [0.0] * 15),
             (335, [-0.0, 1.0] + [0.0] * 14), (340, [0.0, 1.0] + [0.0] * 14), (-(1 << 62), v), (1 << 62, rows[0][1])]
    assert rows[15][0] == 15
    fixed = [r for r in rows if r[0] != 15] + [(15, min([rows[15][1], v], key=lambda x: np.array(x, "<f4").tobytes()))]
    assert run(spark, rows, target=1.0) == brute(fixed)


def test_double_components_and_empty_tables(spark):
    rows = cloud(6, 40) + [(500, [1e-200, 2e-200]), (505, [1e150, 2e150]), (510, [1.0, 2.0])]
    assert run(spark, rows, kind="double") == brute(rows, kind=np.float64)
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []
    assert run(spark, [(5, [1.0]), (6, [-2.0])]) == [(5, 1, 6, -2.0)]
