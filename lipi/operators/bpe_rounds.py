"""What one training round needs beside Spark's counting: cutting words into
segments, choosing merges on a bounded table of segments, applying them.

Why a round may commit every merge of count >= floor from segments alone. Let
the hot pairs be all pairs whose count is at least ``floor`` when the round
begins. A pair that a merge creates stands where a pair stood when the round
began (the last old symbol of its left token next to the first old symbol of
its right token), and always at places of that one pair, as long as no text is
derived in two ways; so it is never more frequent than that pair was. Places of
a pair that is not hot can thus be cut: no merge of count >= floor ever crosses
them. The segments between cuts, with their summed counts, hold every pair of
count >= floor exactly. The round ends with the last merge of count >= floor,
or behind a merge whose text exists already (a second derivation).
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import pyarrow as pa

from .counts import SYM_CLOSE, SYM_OPEN

_JOIN = SYM_CLOSE + SYM_OPEN
FLUSH = 200_000          # distinct segments a task sums up before it emits them


def symbols(sym: str) -> list:
    return sym[1:-1].split(_JOIN)


def cut_words(hot: frozenset):
    """(sym, cnt) -> (seg, cnt): runs of symbols joined by hot pairs, summed
    within the task."""
    def run(batches):
        total: dict = {}
        for b in batches:
            for sym, cnt in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = symbols(sym)
                start = 0
                for i in range(len(t) - 1):
                    if (t[i], t[i + 1]) not in hot:
                        if i > start:
                            seg = _JOIN.join(t[start:i + 1])
                            total[seg] = total.get(seg, 0) + cnt
                        start = i + 1
                if len(t) - 1 > start:
                    seg = _JOIN.join(t[start:])
                    total[seg] = total.get(seg, 0) + cnt
            if len(total) > FLUSH:
                yield _rows(total)
                total = {}
        yield _rows(total)
    return run


def _rows(total):
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                      names=["seg", "cnt"])


def choose(segments, floor: int, texts: set, room: int) -> list:
    """Merges (left, right, merged, count, adds a text) of count >= floor in
    training order, from (segment, count) rows: at most ``room`` new texts, and
    nothing behind a second derivation. ``texts`` is not changed."""
    seqs = [s.split(_JOIN) for s, _ in segments]
    weight = [c for _, c in segments]
    count, where = Counter(), defaultdict(set)
    for i, t in enumerate(seqs):
        for p in zip(t, t[1:]):
            count[p] += weight[i]
            where[p].add(i)
    heap = [(-n, *p) for p, n in count.items() if n >= floor]
    heapq.heapify(heap)
    new, out = set(), []
    while heap and room > 0:
        n, a, b = heapq.heappop(heap)
        now = count[a, b]
        if now != -n:
            if now >= floor:
                heapq.heappush(heap, (-now, a, b))
            continue
        merged = a + b
        adds = merged not in texts and merged not in new
        out.append((a, b, merged, now, adds))
        if not adds:
            break
        new.add(merged)
        room -= 1
        touched = set()
        for i in where.pop((a, b)):
            t, w = seqs[i], weight[i]
            for p in zip(t, t[1:]):
                count[p] -= w
                touched.add(p)
            seqs[i] = t = replace_pair(t, a, b, merged)
            for p in zip(t, t[1:]):
                count[p] += w
                where[p].add(i)
                touched.add(p)
        del count[a, b]
        touched.discard((a, b))
        for p in touched:
            if count[p] >= floor:
                heapq.heappush(heap, (-count[p], *p))
    return out


def replace_pair(t: list, a: str, b: str, merged: str) -> list:
    """Left to right, not overlapping."""
    out, i = [], 0
    while i < len(t):
        if i + 1 < len(t) and t[i] == a and t[i + 1] == b:
            out.append(merged)
            i += 2
        else:
            out.append(t[i])
            i += 1
    return out


def apply_in_order(t: list, ranks: dict) -> list:
    """All merges of ``ranks`` ((left, right) -> place), one after the other.
    Candidates wait by (place, position) over a linked list of symbols, so a
    word of L symbols costs O(L log L); a pair that appears when its turn is
    over stays."""
    n = len(t)
    heap = [(r, i, t[i], t[i + 1]) for i in range(n - 1) if (r := ranks.get((t[i], t[i + 1]))) is not None]
    if not heap:
        return t
    heapq.heapify(heap)
    t = list(t)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while heap:
        turn, i, left, right = heapq.heappop(heap)
        j = after[i]
        if t[i] != left or j >= n or t[j] != right:
            continue
        t[i], t[j] = left + right, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n:
                r = ranks.get((t[x], t[y]))
                if r is not None and r > turn:
                    heapq.heappush(heap, (r, x, t[x], t[y]))
    return [s for s in t if s is not None]


def merge_words(merges: list):
    """(sym, cnt) -> (sym, cnt) with the merges applied; words of one symbol
    are done and leave the table."""
    ranks = {}
    for place, (a, b) in enumerate(merges):
        ranks.setdefault((a, b), place)

    def run(batches):
        for b in batches:
            syms, counts = [], []
            for sym, cnt in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = symbols(sym)
                got = apply_in_order(t, ranks)
                if len(got) > 1:
                    syms.append(sym if got is t else SYM_OPEN + _JOIN.join(got) + SYM_CLOSE)
                    counts.append(cnt)
            yield pa.RecordBatch.from_arrays([pa.array(syms, pa.string()), pa.array(counts, pa.int64())], names=["sym", "cnt"])
    return run
