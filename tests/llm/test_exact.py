import hashlib
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from lipi.llm import exact_dedup as X

from .helpers import table


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for d, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df, **kw):
    return sorted((tuple(r) for r in X.exact_groups(df, **kw).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


ROWS = ([(i, "same text é") for i in range(40)] + [(50, None), (51, ""), (52, "alone"), (53, "alone"), (53, "alone"),
        (54, "x" * 200_000), (55, "x" * 200_000), (56, "x" * 199_999 + "y"), (None, "alone"), (None, "z"), (57, "other")])


def test_brute_force_and_awkward_rows(spark):
    assert got(table(spark, ROWS)) == expected(ROWS)


def test_huge_texts_and_salted_levels(spark):
    # every text over 10 bytes counts as huge; four rows of a group per task
    assert got(table(spark, ROWS), huge=10, fan=4) == expected(ROWS)


def test_empty_and_no_duplicates(spark):
    assert got(table(spark, [])) == []
    rows = [(1, "a"), (2, "b"), (3, None)]
    assert got(table(spark, rows)) == expected(rows)


def test_colliding_fingerprints_stay_apart(spark, monkeypatch):
    rows = [(i, f"text {i % 3}") for i in range(9)]
    real = X.fingerprints

    def collide(*a, **k):
        from pyspark.sql import functions as F
        return real(*a, **k).withColumn("f1", F.lit(1).cast("long")).withColumn("f2", F.lit(1).cast("long"))
    monkeypatch.setattr(X, "fingerprints", collide)
    assert got(table(spark, rows)) == expected(rows)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_hashes_compose(a, b):
    assert X.combine(X.fingerprint(a), X.fingerprint(b), len(b)) == X.fingerprint(a + b)
    p = X.P
    assert X.fingerprint(a) == [sum((c + 1) * pow(base, len(a) - 1 - i, p) for i, c in enumerate(a)) % p
                                for base in X.BASES]
