"""Small tables with the awkward rows every operator must take, and plain
Python versions of the set semantics."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

# clash: names the operators use inside themselves
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, h long, k int, ctx long, "
          "_bytes string, r string, score double, entities string")


def table(spark, rows, cols="doc_id, text, lang, source, n_chars"):
    """documents from (doc_id, text[, lang]) rows, with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src0", len(r[1]) if r[1] else None,
             1, 2, 3, "x", "y", 0.5, "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def sample_docs(spark, sf="/root/testdata/sf0.001", n=120):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(n)
    return [tuple(r) for r in rows.collect()]


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_pairs(sets):
    """All pairs with 100 * intersection >= 75 * union, by an inverted index."""
    index = defaultdict(list)
    for d, s in sets.items():
        for e in s:
            index[e].append(d)
    for d, s in sets.items():
        both = Counter(o for e in s for o in index[e] if o < d)
        for o, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                yield o, d
