"""Byte-level BPE ids of whole texts, at the speed of a word cache.

The vocabulary's pre-tokeniser always starts a new token at a space between
two non-space characters, so a text cut at such spaces encodes to the
concatenation of its parts. Parts repeat (they are words), so a bounded cache
per worker leaves only new words to the tokenizer. Texts with a space next to
other white space are cut by the exact rule, the rest by a plain split.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import chain

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
CACHE_CHARS = 64         # longer parts are not kept
YOUNG_WORDS = 600_000    # entries of a cache generation (two are kept: about 200 MB)

# A part of plain words: letters, then marks, and the same again behind a line
# end. Its pre-tokens are these groups (letters with the space before them),
# so the model can be asked for each without the pipeline around it. Marks are
# ASCII's without the apostrophe, which begins contractions.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
_MARK = f"[{re.escape(_MARKS)}]"
_PLAIN = re.compile(rf"({_LETTERS}+)({_MARK}*)(?:(\n)({_LETTERS}+)({_MARK}*))?")
_NEVER_PLAIN = re.compile(rf"{_MARK}{_LETTERS}")     # in no plain part
UNITS, UNIT_CHARS = 50_000, 8    # runs of marks kept, and their length


def byte_alphabet() -> dict:
    """Byte -> character of byte-level vocabularies: printable Latin-1 stands
    for itself, the other bytes for the characters from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    return {**{b: chr(b) for b in kept}, **{b: chr(256 + i) for i, b in enumerate(others)}}


_NEAR_SPACE = re.compile(r" \s|[^\S ] ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TWO = re.compile(r"\s\s")     # every hit of _NEAR_SPACE holds one; far cheaper to look for


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


class Generations(dict):
    """A bounded cache in two generations: when the young one is full it
    becomes the old one, and what is still in use comes back from there."""

    def __init__(self, young: int = YOUNG_WORDS):
        super().__init__()
        self.old: dict = {}
        self.young = young

    def missing(self, keys: set) -> list:
        """Keys in neither generation; the old one's hits are taken over."""
        if len(self) + len(keys) > self.young:
            self.old = dict(self)
            self.clear()
        old, new = self.old, [k for k in keys if k not in self]
        if old:
            back = {k: v for k in new if (v := old.get(k)) is not None}
            self.update(back)
            new = [k for k in new if k not in back]
        return new


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, special_as_text: bool = False):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.width = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        shape = json.loads(self.tok.to_str())
        before = shape["pre_tokenizer"] or {}
        self.plain = (shape["normalizer"] is None and before.get("type") == "ByteLevel"
                      and before.get("use_regex") and not before.get("add_prefix_space")
                      and all(_NEVER_PLAIN.search(t["content"]) for t in shape["added_tokens"]))
        self.table = {b: c for b, c in byte_alphabet().items() if chr(b) != c}
        self.code = "H" if self.width == "<u2" else "I"
        self.model = self.tok.model
        self.units: dict = {}         # marks and the line end
        self.first = Generations()    # parts at the start of a text
        self.after = Generations()    # parts behind a space

    def _learn(self, cache: Generations, parts: set, prefix: str) -> list:
        """Every part gets its ids; returns the long ones, to be forgotten."""
        new, width, other = cache.missing(parts), self.width, []
        plain, code, tokenize, get = self.plain, self.code, self.model.tokenize, cache.get
        ascii_prefix = "\u0120" if prefix else ""
        for p in new:
            word = p.rstrip(_MARKS)
            if plain and word.isascii() and word.isalpha():     # most parts
                marks = p[len(word):]
                # the bare word may be known from another part
                raw = get(word) if marks else None
                if raw is None:
                    raw = array(code, [t.id for t in tokenize(ascii_prefix + word)]).tobytes()
                cache[p] = raw + self._unit(marks) if marks else raw
                continue
            m = _PLAIN.fullmatch(p) if plain else None
            if m is None:
                other.append(p)
                continue
            a, b, c, d, e = m.groups()
            raw = self._word(prefix + a)
            if b:
                raw += self._unit(b)
            if c:
                raw += self._unit(c) + self._word(d)
                if e:
                    raw += self._unit(e)
            cache[p] = raw
        for i in range(0, len(other), 20000):
            part = other[i:i + 20000]
            got = self.tok.encode_batch_fast([prefix + p for p in part], add_special_tokens=False)
            ids = [e.ids for e in got]
            flat = np.fromiter(chain.from_iterable(ids), self.width).tobytes()
            at, step = 0, int(width[2])
            for p, x in zip(part, ids):
                end = at + step * len(x)
                cache[p] = flat[at:end]
                at = end
        return [p for p in new if len(p) > CACHE_CHARS]

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token."""
        if word.isascii():
            word = "\u0120" + word[1:] if word[0] == " " else word
        else:
            word = word.encode().decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _unit(self, marks: str) -> bytes:
        raw = self.units.get(marks)
        if raw is None:
            raw = array(self.code, [t.id for t in self.model.tokenize(marks.translate(self.table))]).tobytes()
            if len(marks) <= UNIT_CHARS and len(self.units) < UNITS:
                self.units[marks] = raw
        return raw

    def encode(self, texts: list) -> list:
        cut = [_CUT.split(t) if _TWO.search(t) and _NEAR_SPACE.search(t) else t.split(" ")
               for t in (t or "" for t in texts)]
        tails: set = set()
        tails.update(*cut)            # first parts too: they are words as well
        drop_first = self._learn(self.first, {c[0] for c in cut}, "")
        drop_after = self._learn(self.after, tails, " ")
        first, after = self.first, self.after
        out = []
        for c in cut:
            rest = iter(c)
            head = first[next(rest)]
            raw = head + b"".join([after[p] for p in rest])
            out.append(raw if self.width == "<u4" else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
        for cache, parts in ((first, drop_first), (after, drop_after)):
            for p in parts:
                del cache[p]
        return out


_LOADED: dict = {}


def word_tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    key = (path, special_as_text)
    if key not in _LOADED:
        _LOADED[key] = WordTokenizer(path, special_as_text)
    return _LOADED[key]


def text_groups(texts: list, chars: int = 1 << 21):
    """(first, texts) groups of about ``chars`` characters."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "") + 1
        if total >= chars:
            yield lo, texts[lo:i + 1]
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]
