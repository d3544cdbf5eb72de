"""Repeated passages by suffix automata and matching statistics.

A window is WINDOW consecutive words. A word is removed when a window that
covers it also starts in a document with a smaller id.

1. Routing. In every window the K-gram with the smallest hash is its anchor
   (winnowing: equal windows have equal anchors, about one anchor in 20
   words). The windows of one anchor are a context. Only anchors that occur in
   two documents matter, and equal contexts of an anchor are one reference,
   owned by the smallest document.
2. Reference shards. The contexts of an anchor are a shard, of at most SHARD
   contexts. An anchor with more has several shards, and every shard meets
   every block of its contexts. An anchor with over TRIM shards is first
   trimmed to windows whose hash occurs in two documents: surroundings of a
   frequent passage go, the passage itself collapses to one context.
3. A shard's suffix automaton is built over its references by rising owner, so
   the owner of a state is the first document that holds its substrings. It is
   sent to the tasks that hold contexts of that anchor (never to all tasks: its
   size is bounded by SHARD, the number of shards grows with the corpus).
   Contexts stream through it; where the matching statistic reaches WINDOW,
   the state of that suffix names the window's first owner.
4. Windows owned by a smaller document become word spans, maximal per
   document, and the words in them are removed.

Defined results: null text has no words; fewer than WINDOW words: nothing is
removed; repeats inside one document stay; rows that share a doc_id are one
document in comparisons; a null doc_id is never removed from and never a
reference; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, parts, shuffled, staged
from .textwords import U, _BASE, _INV, _powers, blocks_of, hash_words, mix, spans, window_hash

WINDOW = 50
K = 12                   # words of an anchor
SHARD = 1000             # contexts of one reference shard
TRIM = 16                # shards from which trimming (a row per window, about 25 a
                         # context) costs less than pairing (a row per shard)


def anchors(words: np.ndarray, doc: np.ndarray, window: int = WINDOW, k: int = K) -> tuple:
    """Contexts of a block of documents: (document, first word, windows, anchor
    hash, anchor's place in the context) per run of windows with one anchor."""
    n = len(words) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = window_hash(words, k)
    v = ((grams >> U(32)) << U(32)) | np.arange(len(grams), dtype=np.uint64)
    width, best, have = window - k + 1, v, 1
    while have < width:                       # sliding minimum by doubling
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    pos = (best & U(0xFFFFFFFF)).astype(np.int64)
    first = np.arange(n)
    inside = doc[:n] == doc[window - 1:]      # the window lies in one document
    first, pos = first[inside], pos[inside]
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.ones(len(first), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(first)))
    start = first[at]
    return doc[start], start, count, grams[pos[at]], pos[at] - start


def _word_block(buf, offs):
    h, start, end = hash_words(buf)
    return h, np.searchsorted(offs, start, side="right") - 1, start, end


def _anchor_rows(batches):
    for b in batches:
        ids, xx = b.column("doc_id").to_numpy(), b.column("xx").to_numpy()
        for first, buf, offs in blocks_of(b.column("_bytes")):
            words, doc, _, _ = _word_block(buf, offs)
            d, start, count, gram, rel = anchors(words, doc)
            if not len(d):
                continue
            m = len(words)
            run = np.empty(m + 1, np.uint64)
            run[0] = 0
            np.cumsum(words * _powers(_BASE, m)[:m], out=run[1:])
            ctx = mix((run[start + count + WINDOW - 1] - run[start]) * _powers(_INV, m)[start]
                      + (count.astype(np.uint64) << U(32)) + rel.astype(np.uint64))
            base = np.searchsorted(doc, d)     # first word of the document
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(ids[first + d]),
                 pa.array(xx[first + d]), pa.array((start - base).astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["h", "ctx", "doc_id", "xx", "start", "n"])


def _cut_contexts(batches):
    """Exemplar documents with the list of contexts to cut out of them."""
    for b in batches:
        lists = b.column("cuts").to_pylist()
        ids = b.column("doc_id").to_pylist()
        h, ctx, owner, top, blob = [], [], [], [], []
        for first, buf, offs in blocks_of(b.column("_bytes")):
            words, doc, _, _ = _word_block(buf, offs)
            base = np.searchsorted(doc, np.arange(len(offs) - 1))
            for i in range(len(offs) - 1):
                for c in lists[first + i]:
                    lo = base[i] + c["start"]
                    h.append(c["h"])
                    ctx.append(c["ctx"])
                    owner.append(ids[first + i])
                    top.append(c["top"])
                    blob.append(words[lo:lo + c["n"] + WINDOW - 1].tobytes())
            if len(h) > 8192:
                yield _context_batch(h, ctx, owner, top, blob)
                h, ctx, owner, top, blob = [], [], [], [], []
        if h:
            yield _context_batch(h, ctx, owner, top, blob)


def _context_batch(h, ctx, owner, top, blob):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in (h, ctx, owner, top)] + [pa.array(blob, pa.binary())],
        names=["h", "ctx", "owner", "top", "words"])


class SuffixAutomaton:
    """Generalised suffix automaton over integer sequences. ``owner[s]`` is the
    owner of the first sequence added that holds the substrings of state s."""

    def __init__(self):
        self.next, self.link, self.length, self.owner = [{}], [-1], [0], [None]

    def _state(self, edges, link, length, owner):
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.length) - 1

    def _split(self, p, c, q):
        """The state for the strings of q no longer than length[p] + 1."""
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.owner[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence, owner):
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            cur, p = self._state({}, 0, length[last] + 1, owner), last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def owners(self, sequence, size):
        """First owner of every substring of ``size`` items (None: absent),
        read off the matching statistics, capped at ``size``."""
        nxt, link, length, owner = self.next, self.link, self.length, self.owner
        out, s, n = [], 0, 0
        for i, c in enumerate(sequence):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s, n = nxt[s][c], n + 1
            while s and length[link[s]] >= size:     # shorten to the suffix of ``size``
                s = link[s]
            if n > size:
                n = size
            if i >= size - 1:
                out.append(owner[s] if n >= size else None)
        return out


def _runs(owners):
    """Runs of windows with one owner: (first window, last window, owner)."""
    out = []
    for j, o in enumerate(owners):
        if o is None:
            continue
        if out and out[-1][2] == o and out[-1][1] == j - 1:
            out[-1][1] = j
        else:
            out.append([j, j, o])
    return out


RESULT = "h long, ctx long, at int, first int, last int, owner long"


def _match(batches):
    """Rows sorted by (h, shard, block): a shard's references make the
    automaton, the contexts of the block stream through it."""
    out: list = []

    def flush(rows):
        sam = SuffixAutomaton()
        for r in sorted((r for r in rows if r[0] & 1), key=lambda r: (r[3], r[2])):
            sam.add(r[4], r[3])
        for flag, h, ctx, _, words, at in rows:
            if flag & 2:
                out.extend((h, ctx, at, a, z, o) for a, z, o in _runs(sam.owners(words, WINDOW)))

    def batch():
        cols = list(zip(*out))
        out.clear()
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          names=["h", "ctx", "at", "first", "last", "owner"])

    key, rows = None, []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("h", "shard", "block", "flag", "ctx", "owner", "words", "at")]
        for h, shard, block, flag, ctx, owner, words, at in zip(*cols):
            if (h, shard, block) != key:
                flush(rows)
                if len(out) > 20000:
                    yield batch()
                key, rows = (h, shard, block), []
            rows.append((flag, h, ctx, owner, np.frombuffer(words, np.uint64).tolist(), at))
    flush(rows)
    if out:
        yield batch()


def _window_keys(batches):
    """Contexts of a crowded anchor: one row per window."""
    for b in batches:
        for h, ctx, owner, top, words in zip(*(b.column(c).to_pylist() for c in ("h", "ctx", "owner", "top", "words"))):
            w = window_hash(np.frombuffer(words, np.uint64), WINDOW)
            n = len(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * n, pa.int64()) for x in (h, ctx, owner, top)] + [
                 pa.array(w.view(np.int64)), pa.array(np.arange(n, dtype=np.int32))],
                names=["h", "ctx", "owner", "top", "w", "j"])


def _trim(batches):
    """Cut a context to its maximal runs of kept windows."""
    for b in batches:
        rows = []
        for h, ctx, owner, words, js in zip(*(b.column(c).to_pylist() for c in ("h", "ctx", "owner", "words", "js"))):
            w = np.frombuffer(words, np.uint64)
            js = sorted(set(js))
            lo = 0
            for i in range(1, len(js) + 1):
                if i == len(js) or js[i] != js[i - 1] + 1:
                    part = w[js[lo]:js[i - 1] + WINDOW]
                    rows.append((h, ctx, js[lo], owner, part.tobytes()))
                    lo = i
        if rows:
            cols = list(zip(*rows))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["h", "ctx", "at", "owner", "words"])


def _remove(batches):
    for b in batches:
        spans_in = b.column("cover").to_pylist()
        n_words, n_removed, cut, kept = [], [], [], []
        for v, cover in zip(b.column("_bytes").to_pylist(), spans_in):
            buf = np.frombuffer(v, np.uint8)
            start, end = spans(buf)
            stay = np.ones(len(start), bool)
            merged: list = []
            for lo, hi in sorted((c["lo"], c["hi"]) for c in cover or ()):
                if merged and lo <= merged[-1]["hi"]:
                    merged[-1]["hi"] = max(hi, merged[-1]["hi"])
                else:
                    merged.append({"lo": lo, "hi": hi})
            for m in merged:
                stay[m["lo"]:m["hi"]] = False
            n_words.append(len(start))
            n_removed.append(int(len(start) - stay.sum()))
            cut.append(merged)
            kept.append(b" ".join([v[s:e] for s, e in zip(start[stay].tolist(), end[stay].tolist())]))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(cut, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
             pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, trim: int = TRIM) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word ranges removed), kept_text
    (kept words joined by one space): one row per input row."""
    spark = docs.sparkSession
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bytes")).select(
        "doc_id", F.xxhash64("_bytes").alias("xx"), "_bytes")
    every = staged(raw.where("doc_id is not null").mapInArrow(
        _anchor_rows, "h long, ctx long, doc_id long, xx long, start int, n int"), "anchors")
    twice = every.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
    shared = staged(every.join(apart(twice), "h"), "shared_anchors")
    # one exemplar (its owner) of every distinct context
    refs = shared.groupBy("h", "ctx").agg(F.min(F.struct("doc_id", "xx", "start", "n")).alias("e"),
                                          F.max("doc_id").alias("top"))
    cuts = (refs.select("e.doc_id", "e.xx", F.struct("h", "ctx", "e.start", "e.n", "top").alias("c"))
            .groupBy("doc_id", "xx").agg(F.collect_list("c").alias("cuts")))
    found = raw.join(apart(cuts), ["doc_id", "xx"])
    contexts = staged(found.select("doc_id", "_bytes", "cuts").mapInArrow(
        _cut_contexts, "h long, ctx long, owner long, top long, words binary"), "contexts")
    per = contexts.groupBy("h").agg(F.count("*").alias("m"))
    crowded = per.where(F.col("m") > shard * trim).select("h")
    # crowded anchors: windows that one document alone holds cannot match
    thick = contexts.join(apart(crowded), "h", "left_semi")
    keys = thick.mapInArrow(_window_keys, "h long, ctx long, owner long, top long, w long, j int")
    common = keys.groupBy("h", "w").agg(F.min("owner").alias("lo"), F.max("top").alias("hi")).where("lo < hi")
    common = staged(keys.join(apart(common.select("h", "w")), ["h", "w"])
                    .groupBy("h", "ctx").agg(F.collect_set("j").alias("js")), "common_windows")
    trimmed = staged(thick.join(shuffled(common), ["h", "ctx"]).select("h", "ctx", "owner", "words", "js")
                     .mapInArrow(_trim, "h long, ctx long, at int, owner long, words binary"), "trimmed")
    # equal trimmed pieces of an anchor are one reference again
    piece = trimmed.withColumn("pc", F.xxhash64("words"))
    one = (piece.groupBy("h", "pc", "words").agg(F.min("owner").alias("owner"))
           .select("h", F.col("pc").alias("ctx"), F.lit(0).alias("at"), "owner", "words"))
    thin = (contexts.join(apart(crowded), "h", "left_anti")
            .select("h", "ctx", F.lit(0).alias("at"), "owner", "words"))

    def matched(rows):
        shards = F.ceil(F.col("m") / shard)
        own = F.pmod(F.xxhash64("ctx"), shards)
        dealt = rows.join(apart(rows.groupBy("h").agg(F.count("*").alias("m"))), "h").withColumn("own", own)
        # as a reference in its own shard for every block, as a query in its own block for every shard
        roles = F.when(F.col("m") <= shard, F.array(F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("block"), F.lit(3).alias("flag")))).otherwise(
            F.concat(F.transform(F.sequence(F.lit(0).cast("long"), shards - 1), lambda j: F.struct(
                F.col("own").alias("shard"), j.alias("block"), F.when(j == F.col("own"), 3).otherwise(1).alias("flag"))),
                F.transform(F.filter(F.sequence(F.lit(0).cast("long"), shards - 1), lambda j: j != F.col("own")),
                            lambda j: F.struct(j.alias("shard"), F.col("own").alias("block"), F.lit(2).alias("flag")))))
        spread = (dealt.withColumn("r", F.explode(roles))
                  .select("h", "r.shard", "r.block", "r.flag", "ctx", "owner", "words", "at")
                  .repartition(parts(spark), "h", "shard", "block").sortWithinPartitions("h", "shard", "block"))
        return spread.mapInArrow(_match, RESULT)

    direct = matched(thin).select("h", "ctx", F.col("first"), F.col("last"), "owner")
    via = (matched(one).select("h", F.col("ctx").alias("pc"), "first", "last", "owner")
           .join(shuffled(piece.select("h", "ctx", "pc", "at")), ["h", "pc"])
           .select("h", "ctx", (F.col("first") + F.col("at")).alias("first"),
                   (F.col("last") + F.col("at")).alias("last"), "owner"))
    owned = staged(direct.union(via), "owners")
    cover = (shared.join(shuffled(owned), ["h", "ctx"]).where(F.col("owner") < F.col("doc_id"))
             .select("doc_id", "xx", F.struct((F.col("start") + F.col("first")).alias("lo"),
                                              (F.col("start") + F.col("last") + WINDOW).alias("hi")).alias("c"))
             .groupBy("doc_id", "xx").agg(F.collect_set("c").alias("cover")))
    return raw.join(apart(cover), ["doc_id", "xx"], "left").select("doc_id", "_bytes", "cover").mapInArrow(
        _remove, "doc_id long, n_words long, n_removed long, spans array<struct<lo:int,hi:int>>, kept_text string")
