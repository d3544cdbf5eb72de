"""Encode, decode and token/word alignment over whole tables of text.

Encode keeps Spark doing the text work: NFKC (JVM guard + Arrow UDF for the
rows that can change), pre-tokenisation with the training regex
(JVM), and only the per-word merge loop in Python. That loop runs inside an
Arrow UDF with a per-process word cache, so each distinct word of a batch is
merged once; no shuffle at all (a hot word cannot skew anything).

Spark's Arrow batches are bounded in rows first, not in tokens. The queries here
therefore ask for batches of few bytes (session.small_batches), and the functions
that give lists take a batch in slices of SLICE_CHARS characters of text, keep
numbers in typed buffers and give back one small batch a slice: a task holds the
pieces of one batch and the lists of one slice, however long texts are. A task
runs one Python worker for each function of its plan, so their modules load no
pandas.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial, reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SPECIAL_TOKENS, UNK_ID
from ..functions.text import NEEDS_NFKC_RE, WS_PY_CHARS, nfkc
from ..session import ship_code, small_batches
from .packs import pack, pack_groups, packed, stretches, unpack

# Largest model shipped to tasks; a vocabulary is bounded by vocab_size.
MAX_MODEL_TOKENS = 2_000_000

_SPECIALS_ALT = "|".join(
    t.replace("[", r"\[").replace("]", r"\]") for t in SPECIAL_TOKENS)
# Pieces covering the whole text: literal specials, word runs, punctuation
# runs that stop before a literal special, whitespace runs.
PIECES_RE = (rf"(?U){_SPECIALS_ALT}|\w+|(?:(?!{_SPECIALS_ALT})[^\w\s])+|\s+")


@dataclass(frozen=True)
class BpeModel:
    vocab: tuple            # id -> token text
    merges: tuple           # ((left, right), ...) in rank order

    @staticmethod
    def from_rows(vocab_rows, merge_rows) -> "BpeModel":
        vocab = [None] * len(vocab_rows)
        for i, tok in vocab_rows:
            vocab[i] = tok
        merges = tuple((a, b) for _, a, b in sorted(merge_rows))
        if len(vocab) > MAX_MODEL_TOKENS or len(merges) > MAX_MODEL_TOKENS:
            raise ValueError("model too large to ship to tasks")
        return BpeModel(tuple(vocab), merges)

    @staticmethod
    def from_frames(vocab: DataFrame, merges: DataFrame) -> "BpeModel":
        # Bounded by vocab_size: counted before anything is collected.
        if max(vocab.count(), merges.count()) > MAX_MODEL_TOKENS:
            raise ValueError("model too large to ship to tasks")
        v = [(r["id"], r["token"]) for r in vocab.select("id", "token").collect()]
        m = [(r["rank"], r["left"], r["right"]) for r in
             merges.select("rank", "left", "right").collect()]
        return BpeModel.from_rows(v, m)


# Unicode White_Space, the (?U)\s of the piece regex (no \x1c-\x1f).
_WHITE_SPACE = frozenset(
    [chr(c) for c in range(0x09, 0x0E)]
    + [chr(c) for c in (0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    + [chr(c) for c in range(0x2000, 0x200B)])

# ---- per-process state of the word encoder ---------------------------------
_TABLES: dict = {}
_CACHE_LIMIT = 100_000    # words, some 25 MB a worker
_CACHE_CHARS = 64        # longer pre-tokens are not kept


def _entry(model: BpeModel):
    # The entry holds the model itself, so its id() cannot be reused by a
    # later model while the entry lives (a freed broadcast value's address
    # can be handed to the next one; an id-only key then serves stale ids).
    t = _TABLES.get(id(model))
    if t is None or t[0] is not model:
        tok2id = {tok: i for i, tok in enumerate(model.vocab)}
        ranks = {}
        for r, (a, b) in enumerate(model.merges):
            ranks.setdefault((a, b), (r, a + b))
        # codes: an id, or the number of tokens + the place of a special
        texts = pa.array([*model.vocab, *SPECIAL_TOKENS], pa.string())
        ids = np.array([*range(len(model.vocab)), *range(len(SPECIAL_TOKENS))], np.int32)
        t = (model, tok2id, ranks, {}, texts, ids)
        _TABLES.clear()
        _TABLES[id(model)] = t
    return t


def _tables(model: BpeModel):
    return _entry(model)[1:4]


def encode_word(word: str, tok2id: dict, ranks: dict) -> list:
    """BPE on one pre-token: start from code points, repeatedly merge the
    present pair of lowest rank (leftmost on ties). A character outside the
    vocabulary is one [UNK] and never merges.

    Candidates wait in a heap ordered by (rank, position); symbols form a
    linked list, so a merge touches its two neighbours only: O(L log L) for a
    run of L characters. A heap entry is stale when its left symbol or the one
    behind it is no longer what it was."""
    syms = list(word)
    n = len(syms)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        hit = ranks.get((syms[i], syms[i + 1]))
        if hit is not None:
            heap.append((hit[0], i, syms[i], syms[i + 1]))
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if syms[i] != left or j >= n or syms[j] != right:
            continue
        syms[i], syms[j] = left + right, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n:
                hit = ranks.get((syms[x], syms[y]))
                if hit is not None:
                    heapq.heappush(heap, (hit[0], x, syms[x], syms[y]))
    return [(s, tok2id.get(s, UNK_ID)) for s in syms if s is not None]


_ENC_SCHEMA = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("tokens", T.ArrayType(T.StringType())),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
])


# ---- slices of an Arrow batch ---------------------------------------------------
SLICE_CHARS = 1 << 20    # bytes of text, or list entries, handled at once


def _slices(weights, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``most`` (SLICE_CHARS) in weight, or of one row."""
    total = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
    a, n = 0, len(total) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, total[a] + (most or SLICE_CHARS), side="right")) - 1)
        yield a, b
        a = b


def _lengths(lists: pa.Array) -> np.ndarray:
    """Entries per row, 0 for null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _text_bytes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def _at_rows(per_entry, lengths) -> np.ndarray:
    """Running total of ``per_entry`` before each row and behind the last, for
    rows of ``lengths`` entries."""
    total = np.concatenate([[0], np.cumsum(per_entry, dtype=np.int64)])
    return total[np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])]


def _lists(at, values, missing=None) -> pa.Array:
    """List array from row bounds; ``missing``: rows that are null."""
    mask = pa.array(missing, pa.bool_()) if missing is not None and np.any(missing) else None
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values, mask=mask)


def _word_codes(word, model: BpeModel) -> array:
    """code, length, code, length, ... of a piece's tokens; -1 for white space,
    which holds its place only. Specials and [UNK] are codes of their own."""
    if not word:
        return array("i")
    base = len(model.vocab)
    if word in SPECIAL_TOKENS:
        return array("i", (base + SPECIAL_TOKENS.index(word), len(word)))
    if word[0] in _WHITE_SPACE:
        return array("i", (-1, len(word)))
    _, tok2id, ranks = _entry(model)[:3]
    return array("i", [x for t, i in encode_word(word, tok2id, ranks)
                       for x in (base + UNK_ID if i == UNK_ID else i, len(t))])


def _coded(pieces: pa.Array, model: BpeModel):
    """Per slice of rows: (codes, starts, ends, row bounds) of the tokens;
    offsets count the row's characters. No tokens for a null row."""
    cache = _entry(model)[3]
    weights = np.diff(_at_rows(_text_bytes(pieces.flatten()), _lengths(pieces)))
    for a, b in _slices(weights):
        part = pieces.slice(a, b - a)
        if len(cache) > _CACHE_LIMIT:
            cache.clear()
        out, upto = array("i"), array("q", (0,))
        for p in part.flatten().to_pylist():
            got = cache.get(p)
            if got is None:
                got = _word_codes(p, model)
                if p is None or len(p) <= _CACHE_CHARS:
                    cache[p] = got
            out.extend(got)
            upto.append(len(out))
        codes, lens = np.frombuffer(out, np.int32).reshape(-1, 2).T if len(out) else np.zeros((2, 0), np.int32)
        rows = np.concatenate([[0], np.cumsum(_lengths(part), dtype=np.int64)])
        bounds = np.frombuffer(upto, np.int64)[rows] // 2
        before = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        start = before[:-1] - np.repeat(before[bounds[:-1]], np.diff(bounds))
        keep = codes >= 0
        kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[bounds]
        yield codes[keep], start[keep].astype(np.int32), (start + lens)[keep].astype(np.int32), kept


def _make_encoder(bc):
    @F.arrow_udf(_ENC_SCHEMA)
    def enc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pieces in batches:
            texts, ids = _entry(bc.value)[4:]
            for codes, starts, ends, at in _coded(pieces, bc.value):
                yield pa.StructArray.from_arrays(
                    [_lists(at, pa.array(ids[codes])), _lists(at, texts.take(pa.array(codes))),
                     _lists(at, pa.array(starts)), _lists(at, pa.array(ends))],
                    names=["ids", "tokens", "starts", "ends"])
    return enc


# ---- NFKC with an alignment back to the original text ------------------------
_ALIGN_SCHEMA = T.StructType([
    T.StructField("norm", T.StringType()),
    T.StructField("ostart", T.ArrayType(T.IntegerType())),
    T.StructField("oend", T.ArrayType(T.IntegerType())),
])


@lru_cache(1 << 16)
def _meet(a: str, b: str) -> bool:
    """The starter b composes with the segment a before it."""
    nfkc = unicodedata.normalize
    return not b.isascii() and nfkc("NFKC", a + b) != nfkc("NFKC", a) + nfkc("NFKC", b)


def nfkc_with_alignment(text: str):
    """Normalise segment by segment; every normalised character points at the
    original span of its segment. A segment is a starter and the marks after
    it, and grows as long as it composes with what follows (Hangul jamo,
    two-part vowel signs of class 0), so segment-wise NFKC is NFKC of the
    whole text. Unchanged segments keep exact character offsets.

    Where all characters but the first are starters and none composes with the
    one before it (both known per character or pair), every character is a
    segment."""
    nfkc = unicodedata.normalize
    if not any(map(unicodedata.combining, set(text[1:]))) and not any(_meet(a, b) for a, b in set(zip(text, text[1:]))):
        own = {c: nfkc("NFKC", c) for c in set(text)}
        if all(len(x) == 1 for x in own.values()):
            return "".join([own[c] for c in text]), list(range(len(text))), list(range(1, len(text) + 1))
        ostart = np.repeat(np.arange(len(text)), [len(own[c]) for c in text])
        return "".join([own[c] for c in text]), ostart.tolist(), (ostart + 1).tolist()
    segs, start = [], 0
    for i in range(1, len(text) + 1):
        if i == len(text) or unicodedata.combining(text[i]) == 0:
            if segs and not text[start].isascii():
                a, b = segs[-1]
                # only the last character of a segment can meet the next one
                if nfkc("NFKC", text[a:i]) != nfkc("NFKC", text[a:b]) + nfkc("NFKC", text[b:i]):
                    segs[-1] = (a, i)
                    start = i
                    continue
            segs.append((start, i))
            start = i
    norm, ostart, oend = [], [], []
    for a, b in segs:
        seg = text[a:b]
        out = nfkc("NFKC", seg)
        if out == seg:
            ostart.extend(range(a, b))
            oend.extend(range(a + 1, b + 1))
        else:
            ostart.extend([a] * len(out))
            oend.extend([b] * len(out))
        norm.append(out)
    return "".join(norm), ostart, oend


@F.arrow_udf(_ALIGN_SCHEMA)
def _nfkc_align_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for a, b in _slices(_text_bytes(texts)):
            norm, at, starts, ends = [], [0], array("i"), array("i")
            for x in texts.slice(a, b - a).to_pylist():
                if x is None or unicodedata.is_normalized("NFKC", x):
                    norm.append(None)
                else:
                    n, os_, oe = nfkc_with_alignment(x)
                    norm.append(n)
                    starts.extend(os_)
                    ends.extend(oe)
                at.append(len(starts))
            missing = np.array([n is None for n in norm], bool)
            yield pa.StructArray.from_arrays(
                [pa.array(norm, pa.string()), _lists(at, pa.array(np.frombuffer(starts, np.int32)), missing),
                 _lists(at, pa.array(np.frombuffer(ends, np.int32)), missing)], names=["norm", "ostart", "oend"])


def _make_id_encoder(bc):
    """Ids only: what id lists, counts and ratios need (Spark cannot prune the
    fields a Python function builds)."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def enc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pieces in batches:
            ids = _entry(bc.value)[5]
            for codes, _, _, at in _coded(pieces, bc.value):
                yield _lists(at, pa.array(ids[codes]))
    return enc


def encode_ids(spark: SparkSession, df: DataFrame, model: BpeModel, key="doc_id", text: str = "text") -> DataFrame:
    """(*keys, text, ids) without token texts and offsets. Row-local."""
    ship_code(spark)
    t = F.col(text)
    pieces = F.regexp_extract_all(nfkc(t), F.lit(PIECES_RE), 0)
    return df.select(*_keys(key), t.alias("text"), _make_id_encoder(_broadcast_model(spark, model))(pieces).alias("ids"))


def _broadcast_model(spark: SparkSession, model: BpeModel):
    """The model for a Python function; its plan passes small batches."""
    small_batches(spark)
    return spark.sparkContext.broadcast(model)


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def _no_nulls(keys: list) -> Column:
    return reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])


def _having(df: DataFrame, keys: list) -> DataFrame:
    """The rows without a null in their keys."""
    return df.where(_no_nulls(keys))


def encode(spark: SparkSession, df: DataFrame, model: BpeModel,
           key="doc_id", text: str = "text") -> DataFrame:
    """Per row: ids, tokens and code-point offsets into the original text.
    Output: (*keys, text, ids, tokens, starts, ends). Row-local, no shuffle."""
    ship_code(spark)
    keys = _keys(key)
    bc = _broadcast_model(spark, model)
    enc = _make_encoder(bc)
    t = F.col(text)
    aligned = _nfkc_align_udf(F.when(t.rlike(NEEDS_NFKC_RE), t))
    step1 = df.select(*keys, t.alias("text"), aligned.alias("al"))
    norm = F.coalesce(F.col("al.norm"), F.col("text"))
    pieces = F.regexp_extract_all(norm, F.lit(PIECES_RE), 0)
    step2 = step1.select(*keys, "text", F.col("al.ostart").alias("ostart"),
                         F.col("al.oend").alias("oend"), enc(pieces).alias("e"))
    has_al = F.col("ostart").isNotNull()
    starts = F.when(has_al, F.transform("e.starts", lambda s: F.element_at("ostart", s + 1))) \
        .otherwise(F.col("e.starts"))
    ends = F.when(has_al, F.transform("e.ends", lambda e: F.element_at("oend", e))) \
        .otherwise(F.col("e.ends"))
    return step2.select(*keys, "text", F.col("e.ids").alias("ids"),
                        F.col("e.tokens").alias("tokens"),
                        starts.alias("starts"), ends.alias("ends"))


def ids_csv(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def compression_ratio(text: Column, ids: Column) -> Column:
    """Characters incl. spaces per token; 0.0 when there is no token."""
    n = F.size(ids)
    return F.when(n > 0, F.length(text) / n).otherwise(F.lit(0.0)).cast("double")


@F.arrow_udf(T.StringType())
def _fmt_2f(r: pa.Array) -> pa.Array:
    return pa.array([None if x is None or x != x else f"{x:.2f}" for x in r.to_pylist()], pa.string())


def ratio_text(r: Column) -> Column:
    """f"{r:.2f}" exactly as Python prints it (correct rounding of the binary
    value); Java's %.2f rounds the shortest decimal form half-up instead
    (2.675 -> 2.68 where Python gives 2.67), so this one text column uses
    a vectorised helper."""
    return _fmt_2f(r)


def encode_summary(encoded: DataFrame, key="doc_id") -> DataFrame:
    """(*keys, ids, [tokens,] ids_csv, token_count, compression_ratio)."""
    n = F.size("ids")
    ratio = compression_ratio(F.col("text"), F.col("ids"))
    return encoded.select(*_keys(key), "ids", *[c for c in ("tokens",) if c in encoded.columns],
                          ids_csv(F.col("ids")).alias("ids_csv"),
                          n.cast("int").alias("token_count"),
                          ratio.cast("double").alias("compression_ratio"))


def token_offsets(encoded: DataFrame, key="doc_id") -> DataFrame:
    """(*keys, token_idx, token, id, start, end), one row per token."""
    keys = _keys(key)
    z = F.arrays_zip("tokens", "ids", "starts", "ends")
    return (encoded.select(*keys, F.posexplode(z).alias("token_idx", "t"))
            .select(*keys, F.col("token_idx").cast("int"),
                    F.col("t.tokens").alias("token"), F.col("t.ids").alias("id"),
                    F.col("t.starts").alias("start"), F.col("t.ends").alias("end")))


def json_ascii(c: Column) -> Column:
    """A JSON string literal as json.dumps writes it (ensure_ascii): quote
    and backslash escaped, control and non-ASCII characters as \\uXXXX
    (surrogate pairs above the BMP)."""
    def u4(x):
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(x)), 4, "0"))
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t",
             "\b": "\\b", "\f": "\\f"}

    def one(ch):
        cp = F.ascii(ch)
        e = F.when(F.lit(False), F.lit(None))
        for k, v in short.items():
            e = e.when(ch == F.lit(k), F.lit(v))
        hi = F.floor((cp - 0x10000) / 1024) + 0xD800
        lo = F.pmod(cp - 0x10000, F.lit(1024)) + 0xDC00
        return (e.when(cp < 0x20, u4(cp))
                .when(cp < 0x7F + 1, ch)
                .when(cp <= 0xFFFF, u4(cp))
                .otherwise(F.concat(u4(hi), u4(lo))))
    from .counts import chars
    body = F.when(c.rlike(r'^[ !#-\[\]-~]*$'), c) \
        .otherwise(F.array_join(F.transform(chars(c), one), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def token_json(encoded: DataFrame) -> Column:
    """json.dumps([{"idx": i, "token": t, "id": n}, ...]) as text."""
    z = F.arrays_zip("tokens", "ids")
    items = F.transform(z, lambda x, i: F.concat(
        F.lit('{"idx": '), i.cast("string"), F.lit(', "token": '), json_ascii(x["tokens"]),
        F.lit(', "id": '), x["ids"].cast("string"), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


# ---- words of the original text and the token/word overlap --------------------
_WORD_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("w", T.StringType()), T.StructField("s", T.IntegerType())]))
_NON_SPACE = re.compile(r"\S+")


@F.arrow_udf(_WORD_SCHEMA)
def _words_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for a, b in _slices(_text_bytes(texts)):
            words, starts, at, missing = [], array("i"), [0], []
            for t in texts.slice(a, b - a).to_pylist():
                for m in _NON_SPACE.finditer(t or ""):
                    words.append(m.group())
                    starts.append(m.start())
                at.append(len(words))
                missing.append(t is None)
            found = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(np.frombuffer(starts, np.int32))], names=["w", "s"])
            yield _lists(at, found, missing)


def word_positions(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """re.finditer(r'\\S+') per text: (doc_id, word_idx, word, start, end).
    Python's own `re` gives the word definition exactly; match offsets have
    no JVM built-in (they would need a prefix sum over pieces), and this
    row-local helper measured 2.5x faster than pieces + numpy prefix sums."""
    small_batches(df.sparkSession)
    step = df.select(F.col(key).alias("doc_id"), F.posexplode(_words_udf(F.col(text))).alias("word_idx", "x"))
    return step.select("doc_id", F.col("word_idx").cast("int"), F.col("x.w").alias("word"),
                       F.col("x.s").alias("start"),
                       (F.col("x.s") + F.length("x.w")).cast("int").alias("end"))


_SPAN_SCHEMA = T.StructType([
    T.StructField("wt", T.ArrayType(T.StringType())),
    T.StructField("ws", T.ArrayType(T.IntegerType())),
    T.StructField("lo", T.ArrayType(T.IntegerType())),
    T.StructField("hi", T.ArrayType(T.IntegerType())),
    T.StructField("tlo", T.ArrayType(T.IntegerType())),
    T.StructField("thi", T.ArrayType(T.IntegerType())),
])


def _spans(text, starts, ends):
    """Words and their starts, lo and hi per token, tlo and thi per word."""
    ms = list(_NON_SPACE.finditer(text))
    wt = [m.group() for m in ms]
    ws = np.fromiter((m.start() for m in ms), np.int64, len(ms))
    we = np.fromiter((m.end() for m in ms), np.int64, len(ms))
    ts, te = np.asarray(starts, float), np.asarray(ends, float)      # None: nan
    ok = ~(np.isnan(ts) | np.isnan(te)) & (te > ts)
    # Words are sorted and disjoint: the words a span [ts, te) overlaps are
    # exactly those with we > ts and ws < te, a contiguous index range.
    lo = np.searchsorted(we, np.where(ok, ts, 0), side="right")
    hi = np.where(ok, np.maximum(np.searchsorted(ws, np.where(ok, te, 0), side="left"), lo), lo)
    # The other way round: token ranges rise with the token, so the tokens of
    # word k are those between the first with hi > k and the last with lo <= k.
    some = np.flatnonzero(hi > lo)
    k = np.arange(len(ws))
    first, last = np.searchsorted(hi[some], k, side="right"), np.searchsorted(lo[some], k, side="right")
    ends_at = np.append(some, len(lo))
    tlo = ends_at[first]
    thi = np.where(last > first, some[np.maximum(last, 1) - 1] + 1 if len(some) else 0, tlo)
    return [wt] + [x.astype(np.int32) for x in (ws, lo, hi, tlo, thi)]


def _numbers(lists: pa.Array):
    """Entries of all rows as doubles (null: nan) and the rows' bounds."""
    flat = pc.fill_null(lists.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    return flat, np.concatenate([[0], np.cumsum(_lengths(lists), dtype=np.int64)])


@F.arrow_udf(_SPAN_SCHEMA)
def _spans_udf(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, starts, ends in batches:
        for a, b in _slices(_text_bytes(texts) + _lengths(starts)):
            part = texts.slice(a, b - a).to_pylist()
            (ts, t_at), (te, e_at) = _numbers(starts.slice(a, b - a)), _numbers(ends.slice(a, b - a))
            got = [([],) + (np.zeros(0, np.int32),) * 5 if t is None else
                   _spans(t, ts[t_at[i]:t_at[i + 1]], te[e_at[i]:e_at[i + 1]]) for i, t in enumerate(part)]
            missing = [t is None for t in part]
            words, numbers = [w for g in got for w in g[0]], [np.concatenate(x) for x in [*zip(*got)][1:]]
            word_at, tok_at = (np.concatenate([[0], np.cumsum([len(g[k]) for g in got])]) for k in (1, 2))
            ws, lo, hi, tlo, thi = map(pa.array, numbers)
            yield pa.StructArray.from_arrays(
                [_lists(at, x, missing) for at, x in ((word_at, pa.array(words, pa.string())), (word_at, ws), (tok_at, lo),
                                                      (tok_at, hi), (word_at, tlo), (word_at, thi))],
                names=["wt", "ws", "lo", "hi", "tlo", "thi"])


def token_word_spans(encoded: DataFrame) -> DataFrame:
    """Adds, per encoded row, the words of its text (`wt` word, `ws` start,
    as re.finditer(r'\\S+')) and for every token the range [lo, hi) of word
    indices its span overlaps (ts < we and te > ws; tokens without a span
    get an empty range), and for every word the range [tlo, thi) of its tokens
    (empty for a word no token overlaps).

    Tokens and words come from the same row, so the token/word range join
    is solved inside the row by binary search, O((T + W) log W) per text:
    no shuffle, no tokens x words loop, unaffected by hot keys."""
    sp = _spans_udf(F.col("text"), F.col("starts"), F.col("ends"))
    cols = [c for c in encoded.columns]
    return encoded.select(*cols, sp.alias("sp")).select(
        *cols, *[F.col(f"sp.{k}").alias(k) for k in ("wt", "ws", "lo", "hi", "tlo", "thi")])


def token_word_ranges(spanned: DataFrame, key="doc_id") -> DataFrame:
    """One row per token: (*keys, token_idx, id, lo, hi, wt)."""
    keys = _keys(key)
    z = F.arrays_zip(F.col("ids").alias("id"), F.col("lo").alias("lo"), F.col("hi").alias("hi"))
    return (spanned.select(*keys, "wt", F.posexplode(z).alias("token_idx", "r"))
            .select(*keys, F.col("token_idx").cast("int"), F.col("r.id").alias("id"),
                    F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), "wt"))


def word_token_ranges(spanned: DataFrame, key="doc_id", ids: str = "ids") -> DataFrame:
    """One row per word: (*keys, word_idx, word, tlo, thi, ids). Words that no
    token overlaps stay, with an empty range. Row-local."""
    keys = _keys(key)
    z = F.arrays_zip(F.col("wt").alias("w"), F.col("tlo").alias("a"), F.col("thi").alias("b"))
    return (spanned.select(*keys, F.col(ids).alias("ids"), F.posexplode(z).alias("word_idx", "r"))
            .select(*keys, F.col("word_idx").cast("int"), F.col("r.w").alias("word"),
                    F.col("r.a").alias("tlo"), F.col("r.b").alias("thi"), "ids"))


def index_list(lo: Column, hi: Column) -> Column:
    """'lo,...,hi-1', empty for an empty range."""
    return F.when(hi > lo, F.array_join(F.transform(F.sequence(lo, hi - 1), lambda x: x.cast("string")), ",")) \
        .otherwise(F.lit(""))


def overlap_pairs(spanned: DataFrame, key="doc_id") -> DataFrame:
    """(*keys, token_idx, word_idx, id) for every overlapping pair, row-local."""
    keys = _keys(key)
    r = token_word_ranges(spanned, keys).filter(F.col("hi") > F.col("lo"))
    return r.select(*keys, "token_idx", "id",
                    F.explode(F.sequence("lo", F.col("hi") - 1)).alias("word_idx")) \
        .select(*keys, "token_idx", F.col("word_idx").cast("int"), "id")


def token_label(lo: Column, hi: Column, words: Column) -> Column:
    """The first two overlapping words joined by ', ', else ''."""
    n = F.least(hi - lo, F.lit(2))
    return F.when(hi > lo, F.array_join(F.slice(words, lo + 1, n), ", ")).otherwise(F.lit(""))


# ---- the overlap of two span tables -------------------------------------------
SPAN_BLOCK = 4096        # characters of a block of the interval join
_MATCH_ROWS = 1 << 16    # spans matched, and pairs given back, at once


def _ranks(rows: int, *positions):
    """Positions as whole numbers in the same order, and how many there are, so
    that row * many + position fits 64 bits."""
    whole = np.concatenate(positions)
    if whole.dtype.kind == "i":
        low, many = int(whole.min()), int(whole.max()) - int(whole.min()) + 1
        if many * (rows + 1) < 1 << 62:
            return [p.astype(np.int64) - low for p in positions], many
    values, at = np.unique(whole, return_inverse=True)
    return np.split(at.astype(np.int64), np.cumsum([len(p) for p in positions])[:-1]), len(values)


def _ranges(low, high) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, x) for every x of [low[i], high[i]), some at a time."""
    n = np.maximum(high - low, 0)
    for a, b in _slices(n, _MATCH_ROWS):
        i = np.repeat(np.arange(a, b), n[a:b])
        before = np.cumsum(n[a:b]) - n[a:b]
        yield i, np.arange(len(i)) + np.repeat(low[a:b] - before, n[a:b])


def _meeting(a, b, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """a, b: (row, start, end, here) of the spans on either side. The places of
    all pairs of one row that share a position and whose later start is ``here``:
    for each span, the starts of the other side that lie inside it are a range of
    the sorted ones. Equal starts count as later on the side of a."""
    (a_row, a_start, a_end, a_here), (b_row, b_start, b_end, b_here) = a, b
    (a_start, a_end, b_start, b_end), many = _ranks(rows, a_start, a_end, b_start, b_end)
    a_low, a_high, b_low, b_high = a_row * many + a_start, a_row * many + a_end, b_row * many + b_start, b_row * many + b_end
    late = np.flatnonzero(a_here)
    late = late[np.argsort(a_low[late], kind="stable")]
    for i, x in _ranges(np.searchsorted(a_low[late], b_low, "left"), np.searchsorted(a_low[late], b_high, "left")):
        yield late[x], i
    late = np.flatnonzero(b_here)
    late = late[np.argsort(b_low[late], kind="stable")]
    for i, x in _ranges(np.searchsorted(b_low[late], a_low, "right"), np.searchsorted(b_low[late], a_high, "left")):
        yield i, late[x]


def _match_packs(n: int, a_at: tuple, b_at: tuple, names: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(*n keys, pack of a, pack of b) -> the pairs of spans; a_at, b_at: where a
    side's start and end stand. A pack's last column tells whether a span starts
    in the block that the pack belongs to."""
    for batch in batches:
        packs = zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())
        rows, held, size = [], [], 0
        for i, (x, y) in enumerate(packs):
            held.append((unpack(x), unpack(y)))
            rows.append(i)
            size += len(held[-1][0][0]) + len(held[-1][1][0])
            if size < _MATCH_ROWS and i + 1 < batch.num_rows:
                continue
            sides = []
            for k, (start, end) in enumerate((a_at, b_at)):
                columns = [pa.concat_arrays(c) for c in zip(*(h[k] for h in held))]
                row = np.repeat(np.arange(len(rows)), [len(h[k][0]) for h in held])
                sides.append((columns, (row, *(columns[j].to_numpy(zero_copy_only=False) for j in (start, end, -1)))))
            (left, a), (right, b) = sides
            for ia, ib in _meeting(a, b, len(rows)):
                if len(ia):
                    keys, at_a, at_b = pa.array(np.array(rows)[a[0][ia]]), pa.array(ia), pa.array(ib)
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).take(keys) for j in range(n)), *(c.take(at_a) for c in left[:-1]),
                                                      *(c.take(at_b) for c in right[:-1])], names=names)
            rows, held, size = [], [], 0


def overlap_join(left: DataFrame, right: DataFrame, on, block: int = SPAN_BLOCK) -> DataFrame:
    """left and right: (*on, start, end, ...) span tables that need not come
    from one row -> every pair of rows whose spans share a character, with the
    other columns of both (right's spans as r_start, r_end).

    Spans are dealt to the blocks of ``block`` positions they touch, an equi-join
    on (*on, block) brings those of one block together, and the pair is reported
    in the block where the later of the two starts, so once. The spans of a block
    travel as packs (packs.packed), not as rows, and are matched by binary search:
    no pairs are met but those reported. A block holds bounded stretches of
    text, so a long text is many keys. Spans that are empty or lack an end take no
    part."""
    keys = _keys(on)
    where = [*keys, "_block"]

    def dealt(df):
        first, last = (F.floor(x / block).cast("long") for x in (F.col("start"), F.col("end") - 1))
        rest = [c for c in df.columns if c not in keys]
        spans = (_having(df, keys).where(F.col("end") > F.col("start"))
                 .select("*", first.alias("_first"), F.explode(F.sequence(first, last)).alias("_block"))
                 .select(*where, *rest, (F.col("_first") == F.col("_block")).cast("tinyint").alias("_here")))
        return packed(spans, where), rest
    (a, a_rest), (b, b_rest) = dealt(left), dealt(right)
    both = a.withColumnRenamed("pack", "_a").join(b.withColumnRenamed("pack", "_b").hint("merge"), where).select(*keys, "_a", "_b")
    fields = [*[left.schema[k] for k in keys], *[left.schema[c] for c in a_rest], *[right.schema[c] for c in b_rest]]
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])    # both sides may use a name
    match = partial(_match_packs, len(keys), tuple(map(a_rest.index, ("start", "end"))), tuple(map(b_rest.index, ("start", "end"))), plain.names)
    return both.mapInArrow(match, plain).toDF(*keys, *a_rest, *[{"start": "r_start", "end": "r_end"}.get(c, c) for c in b_rest])


# ---- encoding by a dictionary of the whole corpus -------------------------------
HOT_SHARE = 10_000       # a word in more than 1 / HOT_SHARE of all (chunk, word) rows is hot
CHUNK_BYTES = 1 << 23    # text of a chunk
CHUNK_WORDS = 1 << 17    # distinct words after which it ends as well
WORD_BUCKETS = 4096      # buckets of words at most


class _Numbers(dict):
    """word -> its place among the words met so far, from 1; 0 for white space."""

    def __init__(self):
        self.words = []

    def __missing__(self, word):
        n = 0
        if word and word[0] not in _WHITE_SPACE:
            self.words.append(word)
            n = len(self.words)
        self[word] = n
        return n


def _chunk(words: list, held: list) -> list:
    """The distinct words, most frequent first, and the texts: *keys, numbers."""
    *keys, lists = (pa.concat_arrays(c) for c in zip(*(b.columns for b in held)))
    numbers = lists.flatten().to_numpy()
    order = np.argsort(-np.bincount(numbers, minlength=len(words) + 1)[1:], kind="stable")
    new = np.zeros(len(words) + 1, np.int32)
    new[order + 1] = np.arange(1, len(words) + 1)
    return [pack([pa.array([words[i] for i in order], pa.string())]),
            pack([*keys, pa.ListArray.from_arrays(lists.offsets, pa.array(new[numbers]))])]


def _to_chunks(n: int, places: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(*n keys, pieces) -> a row per chunk of texts: how many distinct words,
    these words, and the texts as lists of their numbers; with ``places`` white
    space has a number too, so that a piece's place is its place in the list."""
    chunk, numbers, held, size = TaskContext.get().partitionId() << 32, _Numbers(), [], 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([len(numbers.words)], pa.int64()),
                                           *([x] for x in _chunk(numbers.words, held))], names=["chunk", "n", "words", "texts"])
    for batch in batches:
        weights = np.diff(_at_rows(_text_bytes(batch.column(n).flatten()), _lengths(batch.column(n)))) + 16
        for a, b in _slices(weights):
            part = batch.slice(a, b - a)
            found = np.frombuffer(array("i", map(numbers.__getitem__, part.column(n).flatten().to_pylist())), np.int32)
            kept = np.ones(len(found), bool) if places else found > 0
            at = _at_rows(kept, _lengths(part.column(n)))
            held.append(pa.RecordBatch.from_arrays([*part.columns[:n], _lists(at, pa.array(found[kept]))], names=batch.schema.names))
            size += int(weights[a:b].sum())
            if size >= CHUNK_BYTES or len(numbers.words) >= CHUNK_WORDS:
                yield row()
                chunk, numbers, held, size = chunk + 1, _Numbers(), [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield row()


def _chunk_words(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, words) -> packs of (word, number) by bucket."""
    for batch in batches:
        for chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
            words = unpack(data)[0]
            bucket = np.fromiter((crc32(w.encode()) % buckets for w in words.to_pylist()), np.int32, len(words))
            if len(words):
                (found,), packs = pack_groups(pa.table([bucket, words, np.arange(1, len(words) + 1, dtype=np.int32)], names=["bucket", "word", "num"]), 1)
                yield pa.RecordBatch.from_arrays([found, pa.array([chunk] * len(found), pa.int64()), packs], names=["bucket", "chunk", "pack"])


def _unpack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
            words, num = unpack(data)
            yield pa.RecordBatch.from_arrays([words, pa.array([chunk] * len(num), pa.int64()), num], names=["word", "chunk", "num"])


def _code_words(bc, share: int, entries: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, chunk, num) in order of the word -> packs of (num, ids) by chunk. A
    word is encoded once. A word that has more than entries / share rows gives a
    pack (word, ids) without a chunk instead of the rows that follow."""
    hot = []

    def coded():
        last, last_ids, met = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            _entry(bc.value)[3].clear()             # no word comes again
            runs = pc.run_end_encode(batch.column(0))
            words, n = runs.values, np.diff(runs.run_ends.to_numpy().astype(np.int64), prepend=0)
            again = int(last is not None and words[0].as_py() == last)
            fresh = words.slice(again)
            ids = [last_ids] * again + [_lists(at, pa.array(_entry(bc.value)[5][codes])) for codes, _, _, at in
                                        _coded(_lists(np.arange(len(fresh) + 1), fresh), bc.value)]
            ids, total = pa.concat_arrays(ids), n.copy()
            total[0] += met * again
            over = total * share > entries
            for i in np.flatnonzero(over & (((total - n) * share <= entries) | (np.arange(len(n)) >= again))):
                hot.append(pack([words.slice(i, 1), ids.slice(i, 1)]))
            last, last_ids, met = words[-1].as_py(), ids.slice(len(ids) - 1), int(total[-1])
            rows = np.flatnonzero(np.repeat(~over, n))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows)), batch.column(2).take(pa.array(rows)),
                                              ids.take(pa.array(np.repeat(np.arange(len(n)), n)[rows]))], names=["chunk", "num", "ids"])
    for table in stretches(coded()):
        (chunks,), packs = pack_groups(table.sort_by([("chunk", "ascending"), ("num", "ascending")]), 1)
        yield pa.RecordBatch.from_arrays([chunks, packs], names=["chunk", "pack"])
    if hot:
        yield pa.RecordBatch.from_arrays([pa.nulls(len(hot), pa.int64()), pa.array(hot, pa.binary())], names=["chunk", "pack"])


def _text_ids(n: int, places: bool, names: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, texts, packs of (num, ids), packs of hot (word, ids)) of a chunk ->
    (*n keys, ids) per text; with ``places`` (*n keys, pack of tokens per piece, ids)."""
    def joined(packs):
        got = [*zip(*map(unpack, packs))] or [[pa.array([], pa.int32())], [pa.array([], pa.list_(pa.int32()))]]
        return [pa.concat_arrays(c) for c in got]
    shared, hot_words, hot_ids = [], None, None
    for batch in batches:
        for words, texts, parts, hot in zip(*(c.to_pylist() for c in batch.columns)):
            words = unpack(words)[0]
            num, ids = joined(parts or [])
            if hot:
                if hot != shared:
                    shared, (hot_words, hot_ids) = hot, joined(hot)
                found = pc.index_in(words, value_set=hot_words)
                here = found.is_valid().to_numpy(zero_copy_only=False)
                num = pa.concat_arrays([num, pa.array(np.flatnonzero(here) + 1, num.type)])
                ids = pa.concat_arrays([ids, hot_ids.take(found.drop_null())])
            lens, values = _lengths(ids).astype(np.int64), ids.flatten().to_numpy()
            length, start = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64)
            length[num], start[num] = lens, np.cumsum(lens) - lens
            if not length[1:].all():
                raise RuntimeError("a word of a chunk is not in the dictionary")
            *keys, numbers = unpack(texts)
            for a, b in _slices(_lengths(numbers), SLICE_CHARS // 4):
                part = numbers.slice(a, b - a)
                number = part.flatten().to_numpy()
                size = length[number]
                got = values[np.repeat(start[number] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                found = _lists(_at_rows(size, _lengths(part)), pa.array(got))
                if places:
                    counts = _lists(_at_rows(np.ones(len(size)), _lengths(part)), pa.array(size.astype(np.int32)))
                    found = pa.array([pack([counts.slice(i, 1), found.slice(i, 1)]) for i in range(b - a)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(k.slice(a, b - a) for k in keys), found], names=names)


def _by_place(packs: list) -> list:
    """The ids of the texts of one key, in the order of (place, ids)."""
    words = []
    for sizes, ids in packs:
        sizes, ids = sizes.flatten().to_numpy(), ids.flatten().to_pylist()
        ends = np.cumsum(sizes)
        words += [(int(i), ids[ends[i] - sizes[i]:ends[i]]) for i in np.flatnonzero(sizes)]
    return [x for _, ids in sorted(words) for x in ids]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _unpacked_ids_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for lists in batches:
        weights = np.diff(_at_rows(_text_bytes(lists.flatten()), _lengths(lists)))
        for a, b in _slices(weights, SLICE_CHARS // 8):
            rows = [[unpack(p) for p in packs or []] for packs in lists.slice(a, b - a).to_pylist()]
            ids = [r[0][1].flatten() if len(r) == 1 else pa.array(_by_place(r), pa.int32()) for r in rows]
            yield _lists(np.concatenate([[0], np.cumsum([len(i) for i in ids])]), pa.concat_arrays(ids))


def encode_dictionary(spark: SparkSession, df: DataFrame, model: BpeModel, key="doc_id", text: str = "text") -> DataFrame:
    """(*keys, ids) as encode_ids gives them, but every distinct word of the
    corpus is encoded once for the whole job. A text without a key has no ids;
    texts of one key have the ids of all of them, place by place.

    A task's texts are cut into chunks, in which a word is a number. Words go to
    their buckets in packs, one row for each chunk and distinct word, so no word
    dominates; there the dictionary is made. Its ids come back to the chunks in
    packs, those of hot words, of which there can be HOT_SHARE at most, by
    broadcast. The texts move as numbers, once, and as ids only where keys repeat."""
    ship_code(spark)
    keys = _keys(key)
    bc = _broadcast_model(spark, model)
    some = _having(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    places = not some.isEmpty()
    pieces = F.when(_no_nulls(keys), F.regexp_extract_all(nfkc(F.col(text)), F.lit(PIECES_RE), 0))
    chunks = (df.select(*keys, pieces.alias("pieces"))
              .mapInArrow(partial(_to_chunks, len(keys), places), "chunk long, n long, words binary, texts binary")).checkpoint()
    entries = chunks.agg(F.sum("n")).first()[0] or 0
    buckets = min(WORD_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = chunks.select("chunk", "words").mapInArrow(partial(_chunk_words, buckets), "bucket int, chunk long, pack binary").repartition(buckets, "bucket")
    words = dealt.select("chunk", "pack").mapInArrow(_unpack_words, "word string, chunk long, num int").sortWithinPartitions("word")
    coded = words.mapInArrow(partial(_code_words, bc, HOT_SHARE, max(1, entries)), "chunk long, pack binary").checkpoint()
    # of the chunk's own words, and of hot ones
    parts = coded.where("chunk IS NOT NULL").repartition("chunk").groupBy("chunk").agg(F.collect_list("pack").alias("parts"))
    hot = coded.where("chunk IS NULL").agg(F.collect_list("pack").alias("hot"))
    whole = (chunks.drop("n").join(parts.hint("merge"), "chunk", "left").crossJoin(F.broadcast(hot))
             .select("words", "texts", "parts", "hot"))
    found = T.StructField("pack", T.BinaryType()) if places else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*[df.schema[k] for k in keys], found])
    ids = whole.mapInArrow(partial(_text_ids, len(keys), places, schema.names), schema)
    if not places:
        return ids
    packs = ids.repartition(*keys).groupBy(*keys).agg(F.collect_list("pack").alias("packs"))
    return df.select(*keys).join(packs.hint("merge"), keys, "left").select(*keys, _unpacked_ids_udf("packs").alias("ids"))


# ---- decode ---------------------------------------------------------------------
_DEVANAGARI_DIGITS = "\u0966\u0967\u0968\u0969\u096a\u096b\u096c\u096d\u096e\u096f"


def parse_ids(c: Column) -> Column:
    """'1, 2,,3' -> struct(ids ARRAY<INT>, valid BOOLEAN).

    Items blank after a Unicode strip are skipped. An item is valid when it
    is an optionally signed run of digits (Devanagari digits allowed, as
    Python int() takes them) whose value fits an unsigned 32-bit id."""
    items = F.transform(F.split(c, ","), lambda x: F.trim(x, F.lit(WS_PY_CHARS)))
    items = F.filter(items, lambda x: x != "")
    items = F.transform(items, lambda x: F.translate(x, _DEVANAGARI_DIGITS, "0123456789"))
    ok_form = F.forall(items, lambda x: x.rlike(r"^[+-]?[0-9]+$"))
    as_dec = F.transform(items, lambda x: x.try_cast("decimal(38,0)"))
    in_range = F.forall(as_dec, lambda d: (d >= 0) & (d <= 4294967295))
    valid = F.coalesce(ok_form & in_range, F.lit(False))
    ids = F.when(valid, F.transform(as_dec, lambda d: d.cast("bigint")))
    return F.struct(ids.alias("ids"), valid.alias("valid"))


def _token_lookup(spark: SparkSession, model: BpeModel, skip_special: bool):
    """ids -> token texts with the broadcast vocabulary (bounded by
    vocab_size); NULL for ids that are NULL, negative or past the end."""
    bc = _broadcast_model(spark, model)
    lo = len(SPECIAL_TOKENS) if skip_special else 0

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            n, texts = len(bc.value.vocab), _entry(bc.value)[4]
            for a, b in _slices(_lengths(lists)):
                part = lists.slice(a, b - a)
                ids = part.flatten()
                known = pc.fill_null(pc.and_(pc.greater_equal(ids, lo), pc.less(ids, n)), False)
                tokens = texts.take(pc.if_else(known, ids, pa.scalar(None, ids.type)))
                at = np.concatenate([[0], np.cumsum(_lengths(part), dtype=np.int64)])
                yield _lists(at, tokens, part.is_null().to_numpy(zero_copy_only=False))
    return look


def id_tokens(ids: Column, model: BpeModel, skip_special: bool = False) -> Column:
    """ids -> token texts; ids outside the vocabulary give NULL."""
    return _token_lookup(SparkSession.getActiveSession(), model, skip_special)(ids.cast("array<bigint>"))


# --- Fixed values: the clean-up of tokenization spaces (optional decode
# step), applied in this order: " ." " ?" " !" " ," " ' " " n't" " 'm"
# " 's" " 've" " 're" lose their leading space (" ' " becomes "'").
CLEANUP_REPLACEMENTS = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"),
                        (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"),
                        (" 're", "'re"))


def cleanup_spaces(c: Column) -> Column:
    for a, b in CLEANUP_REPLACEMENTS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decode(df: DataFrame, model: BpeModel, key: str = "doc_id", ids: str = "ids",
           skip_special: bool = False, sep: str = " ", cleanup: bool = False) -> DataFrame:
    """ids -> text: tokens joined by one space (no decoder is configured).
    Unknown ids (NULL, negative or past the end) are skipped and flagged. Input ids: an integer array or a
    CSV string (parsed as the decode endpoint does). Row-local: no shuffle.
    Output: (doc_id, ids, text, status), status ok | unknown_id | invalid_id_list."""
    dtype = dict(df.dtypes)[ids]
    if dtype == "string":
        p = parse_ids(F.col(ids))
        base = df.select(F.col(key).alias("doc_id"), p["ids"].alias("ids"), p["valid"].alias("valid"))
    else:
        base = df.select(F.col(key).alias("doc_id"), F.col(ids).cast("array<bigint>").alias("ids"),
                         F.lit(True).alias("valid"))
    n = len(model.vocab)
    base = base.select("doc_id", "ids", "valid", id_tokens(F.col("ids"), model, skip_special).alias("toks"))
    toks = F.col("toks")
    text = F.array_join(F.filter(toks, lambda t: t.isNotNull()), sep)
    if cleanup:
        text = cleanup_spaces(text)
    unknown = F.exists("ids", lambda i: i.isNull() | (i < 0) | (i >= n))
    status = (F.when(~F.col("valid"), F.lit("invalid_id_list"))
              .when(unknown, F.lit("unknown_id"))
              .otherwise(F.lit("ok")))
    return base.select("doc_id", F.col("ids"),
                       F.when(F.col("valid"), text).alias("text"), status.alias("status"))
