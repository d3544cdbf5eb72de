"""SentencePiece models on the tokenizers library.

The model file (a protobuf) is parsed here, and its parts are rebuilt as a
``tokenizers`` pipeline: the normaliser (precompiled character map, extra
white space, dummy prefix, metaspace marker), the unigram scores or, for a
BPE model, the merges implied by its scores, byte fallback, and the decoder.
Batches are encoded by the library's own threads. Every distinct part of the
table's texts is also encoded by the sentencepiece library, once for the whole
job, and compared (``parity``).

Where no piece holds the metaspace marker behind another character (checked
on the model), a text can be cut at single spaces and its parts, which
repeat, kept in a bounded cache; otherwise whole texts are encoded. Ids are
decoded in groups from marker to marker, which repeat as well. One Python worker
a task encodes and decodes; the second library is loaded only by the tasks that
compare.

Defined results: null text counts as empty; an empty text has no ids and
decodes to an empty text; rows are never dropped; null ids and repeated rows
are encoded like any other; an empty table gives no rows; control pieces
written out in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged
from .tokens import CACHE_CHARS, Generations, text_groups, tokenizer_path

PIECE_MODEL = "piece_bpe_32k.model"
THREADS = 2
YOUNG_PARTS, YOUNG_GROUPS = 300_000, 50_000   # entries of a cache generation; the four are some 160 MB
SLICE_CHARS = 1 << 20    # a longer text is encoded in slices
GROUP_CHARS = 1 << 20    # characters handed to the library at once
BAD_PARTS = 10_000       # differing parts sent to the tasks
MARK = "▁"
# SentencePiece's piece and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes):
    """(field number, value) of a protobuf message: integers, 4-byte floats
    as raw bytes, nested messages and strings as bytes."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n = varint()
            yield tag >> 3, data[i:i + n]
            i += n


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, type) and the settings that matter here."""
    out = {"pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "unk_id": 0, "charsmap": b"",
           "dummy_prefix": True, "remove_extra": True, "escape": True}
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out["pieces"].append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                key = {3: "model_type", 35: "byte_fallback", 40: "unk_id"}.get(n)
                if key:
                    out[key] = bool(v) if key == "byte_fallback" else v
        elif number == 3:
            for n, v in fields(value):
                key = {2: "charsmap", 3: "dummy_prefix", 4: "remove_extra", 5: "escape"}.get(n)
                if key:
                    out[key] = v if key == "charsmap" else bool(v)
    return out


def merges_of(model: dict) -> list:
    """The merges a BPE model's scores imply: every way to join two pieces
    into a third, best score first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model["pieces"]) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for piece, score, kind in model["pieces"]:
        if kind != NORMAL or len(piece) < 2:
            continue
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in ids and b in ids:
                found.append((-score, ids[piece], ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: dict):
    """The tokenizers pipeline of a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers
    pieces = model["pieces"]
    if model["model_type"] == BPE:
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(pieces)}, merges=merges_of(model),
                          unk_token=pieces[model["unk_id"]][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    elif model["model_type"] == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in pieces], model["unk_id"], model["byte_fallback"])
    else:
        raise ValueError("only unigram and BPE models")
    tok = Tokenizer(core)
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["remove_extra"]:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK if model["escape"] else " "))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                    + ([decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []))
    user = [p for p, _, kind in pieces if kind == USER]
    if user:
        tok.add_tokens([AddedToken(p, normalized=False) for p in user])
    return tok


def can_cut(model: dict) -> bool:
    """No piece crosses a single space: a marker only ever starts a piece (or
    a run of markers does), and the dummy prefix makes every part look alike."""
    return model["dummy_prefix"] and model["escape"] and not any(
        MARK in p.lstrip(MARK) for p, _, kind in model["pieces"] if kind in (NORMAL, USER))


# Letters and marks that no normaliser step touches when there is no character map.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,;:!?]*")
_NEAR = re.compile(rf"^ | \s|[^\S ] |{MARK}| $")
_CUT = re.compile(rf"(?<=[^\s{MARK}]) (?=[^\s{MARK}])")


class PieceTokenizer:
    """Encode and decode batches with bounded caches of parts."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            model = parse_model(f.read())
        self.tok = build(model)
        self.cut = can_cut(model)
        self.strips = model["dummy_prefix"]
        # a piece that starts with the marker starts a group of ids
        self.opens = np.array([p.startswith(MARK) and kind in (NORMAL, USER) for p, _, kind in model["pieces"]])
        # what the decoder makes of an ordinary piece, and the value of a byte piece (-1: another piece)
        self.said = [p.replace(MARK, " ") if kind in (NORMAL, USER) else "" for p, _, kind in model["pieces"]]
        self.byte = np.array([int(p[3:5], 16) if kind == BYTE else -1 for p, _, kind in model["pieces"]], np.int16)
        self.simple = np.array([kind in (NORMAL, USER, BYTE) for _, _, kind in model["pieces"]])
        # without a character map and user pieces, the normaliser only marks the start of a part without blanks
        self.direct = (not model["charsmap"] and model["dummy_prefix"] and model["escape"]
                       and not any(kind == USER for _, _, kind in model["pieces"]))
        self.model = self.tok.model
        self.ids = Generations(YOUNG_PARTS)       # part -> ids
        self.texts = Generations(YOUNG_GROUPS)    # ids of a group -> text

    def parts(self, text: str) -> list:
        """What a text is cut into; a part is encoded on its own."""
        if not self.cut:
            return [text]
        return _CUT.split(text) if _NEAR.search(text) else text.split(" ")

    def slices(self, text: str, size: int = SLICE_CHARS):
        """A text in slices of about ``size`` characters, cut where parts are."""
        at = 0
        while self.cut and len(text) - at > size:
            m = _CUT.search(text, at + size)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.end()
        yield text[at:]

    def _known(self, cache: Generations, keys: set, ask, long) -> list:
        """Fill the cache with what ask gives; returns the keys not worth keeping."""
        new = cache.missing(keys)
        for i in range(0, len(new), 20000):
            part = new[i:i + 20000]
            cache.update(zip(part, ask(part)))
        return [k for k in new if len(k) > long]

    def _ask_ids(self, parts: list) -> list:
        """Ids of parts: the model is asked for plain ones, the whole pipeline for all others."""
        out, others = [None] * len(parts), []
        for i, p in enumerate(parts):
            if self.direct and _PLAIN.fullmatch(p):
                out[i] = array("I", [t.id for t in self.model.tokenize(MARK + p)]).tobytes()
            else:
                others.append(i)
        for i, ids in zip(others, self._ask_pipeline([parts[i] for i in others])):
            out[i] = ids
        return out

    def _ask_pipeline(self, parts: list) -> list:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def _ask_texts(self, groups: list) -> list:
        return self.tok.decode_batch([np.frombuffer(g, "<u4").tolist() for g in groups], skip_special_tokens=False)

    def encode(self, texts: list, bad=frozenset()) -> list:
        """(ids as little-endian bytes, whether no part is in ``bad``) per text."""
        cut = [self.parts(t or "") for t in texts]
        wanted: set = set()
        wanted.update(*cut)
        drop = self._known(self.ids, wanted, self._ask_ids, CACHE_CHARS)
        ids = self.ids
        out = [(b"".join([ids[p] for p in c]), not bad or bad.isdisjoint(c)) for c in cut]
        for p in drop:
            del ids[p]
        return out

    def decode(self, ids: list) -> list:
        """Texts of id lists. Ordinary pieces are read off a table, and runs of
        byte pieces are UTF-8 (U+FFFD for each byte of a run that is not); lists
        that hold an unknown or control piece go to the library's decoder."""
        out, hard = [], []
        for at, blob in enumerate(ids):
            a = np.frombuffer(blob, "<u4")
            if len(a) and (int(a.max()) >= len(self.said) or not self.simple[a].all()):
                hard.append(at)
                out.append("")
                continue
            text = "".join(self._runs(a))
            out.append(text[1:] if self.strips and text[:1] == " " else text)
        for at, text in zip(hard, self._decode_groups([ids[at] for at in hard])):
            out[at] = text
        return out

    def _runs(self, a):
        """Texts of the maximal runs of byte pieces and of ordinary ones."""
        value = self.byte[a]
        edges = np.flatnonzero(np.diff(value >= 0)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(a)]):
            if lo < hi and value[lo] >= 0:
                run = value[lo:hi].astype(np.uint8).tobytes()
                try:
                    yield run.decode()
                except UnicodeDecodeError:
                    yield "\ufffd" * len(run)
            else:
                for i in range(lo, hi, SLICE_CHARS):
                    yield "".join(map(self.said.__getitem__, a[i:min(hi, i + SLICE_CHARS)].tolist()))

    def _decode_groups(self, ids: list) -> list:
        """Ids are grouped from marker to marker; groups repeat, and no byte
        sequence runs from one into the next."""
        cut = []
        for blob in ids:
            a = np.frombuffer(blob, "<u4")
            at = np.flatnonzero(self.opens[np.minimum(a, len(self.opens) - 1)] & (a < len(self.opens)))
            edges = [0, *(4 * at[at > 0]).tolist(), len(blob)]
            cut.append([blob[x:y] for x, y in zip(edges, edges[1:])] if blob else [])
        wanted: set = set()
        wanted.update(*cut)
        drop = self._known(self.texts, wanted, self._ask_texts, 4 * CACHE_CHARS)
        texts, out = self.texts, []
        for c in cut:
            # the decoder strips the blank of every group; only the first one's goes
            out.append((" " if self.strips else "").join([texts[g] for g in c]))
        for g in drop:
            del texts[g]
        return out


_LOADED: dict = {}


def piece_tokenizer(path: str, threads: int = THREADS) -> PieceTokenizer:
    if path not in _LOADED:
        _LOADED[path] = PieceTokenizer(path, threads)
    return _LOADED[path]


def _rows(docs, id_col, text_col):
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def distinct_parts(rows: DataFrame, path: str, threads: int = THREADS) -> DataFrame:
    """(part): everything that the texts are cut into, each once for the job.
    A task emits its own distinct parts, YOUNG_PARTS at a time."""
    def run(batches):
        tok = piece_tokenizer(path, threads)
        seen: set = set()
        for b in batches:
            for text in b.column(0):
                for piece in tok.slices(text.as_py() or ""):
                    seen.update(tok.parts(piece))
                    if len(seen) > YOUNG_PARTS or (not tok.cut and sum(map(len, seen)) > SLICE_CHARS):
                        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["part"])
                        seen = set()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["part"])
    return rows.select("text").mapInArrow(run, "part string").distinct()


def unequal_parts(parts: DataFrame, path: str, threads: int = THREADS) -> DataFrame:
    """The parts whose ids differ between this pipeline and the sentencepiece
    library, which is loaded here only."""
    def run(batches):
        import sentencepiece
        tok, other = piece_tokenizer(path, threads), sentencepiece.SentencePieceProcessor(model_file=path)
        for b in batches:
            for _, group in text_groups(b.column(0).to_pylist()):
                theirs = other.encode(group, num_threads=1)
                wrong = [p for p, a, c in zip(group, tok._ask_ids(group), theirs) if np.frombuffer(a, "<u4").tolist() != c]
                yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.string())], names=["part"])
    return parts.mapInArrow(run, "part string")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           threads: int = THREADS, with_text: bool = False, with_decoded: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens, parity (and the
    text, and the text decoded from the ids, if asked for).

    parity: every distinct part of the table was encoded once by both libraries
    before, and none of this text's parts came out differently. Differing parts
    go to the tasks while there are BAD_PARTS of them at most; beyond, every
    worker compares the parts it meets itself."""
    model = path or tokenizer_path(PIECE_MODEL)
    rows = _rows(docs, id_col, text_col)
    wrong = staged(unequal_parts(distinct_parts(rows, model, threads), model, threads), "unequal-parts")
    few = [r.part for r in wrong.limit(BAD_PARTS + 1).collect()]
    discard(wrong)
    compare_here = len(few) > BAD_PARTS
    bad = frozenset(() if compare_here else few)

    def run(batches):
        tok = piece_tokenizer(model, threads)
        other = None
        if compare_here:
            import sentencepiece
            other = sentencepiece.SentencePieceProcessor(model_file=model)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for first, n, group in _groups(texts):
                got = [_whole(tok, t, bad, other) if len(t) > SLICE_CHARS else None for t in group]
                short = iter(tok.encode([t for t in group if len(t) <= SLICE_CHARS], bad))
                got = [next(short) if g is None else g for g in got]
                if other is not None:
                    got = [(i, np.frombuffer(i, "<u4").tolist() == other.encode(t)) for (i, _), t in zip(got, group)]
                columns = [pa.array(ids[first:first + n], pa.int64()), pa.array([g[0] for g in got], pa.binary()),
                           pa.array([len(g[0]) // 4 for g in got], pa.int64()), pa.array([g[1] for g in got])]
                columns += [texts.slice(first, n)] * with_text
                if with_decoded:
                    columns.append(pa.array(tok.decode([g[0] for g in got]), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "ids", "n_tokens", "parity"] + ["text"] * with_text + ["decoded"] * with_decoded
    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long, parity boolean" + ", text string" * with_text
                           + ", decoded string" * with_decoded)


def _whole(tok, text, bad, other):
    """A long text, a slice at a time: its parts are never all held."""
    ids, same = [], True
    for piece in tok.slices(text):
        (got, ok), = tok.encode([piece], bad)
        ids.append(got)
        same &= ok
    return b"".join(ids), same


def _groups(column):
    """(first row, rows, texts) of about GROUP_CHARS characters."""
    lo, group, total = 0, [], 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        group.append(t)
        total += len(t) + 1
        if total >= GROUP_CHARS:
            yield lo, len(group), group
            lo, group, total = i + 1, [], 0
    if group:
        yield lo, len(group), group


def decode(encoded: DataFrame, path: str | None = None, threads: int = THREADS) -> DataFrame:
    """The encoded rows with ``decoded`` text."""
    model = path or tokenizer_path(PIECE_MODEL)
    schema = type(encoded.schema)(list(encoded.schema.fields))

    def run(batches):
        tok = piece_tokenizer(model, threads)
        for b in batches:
            at = b.schema.names.index("ids")
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                text = tok.decode([x or b"" for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())],
                                                 names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema.add("decoded", "string"))
