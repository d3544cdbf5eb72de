"""Text column expressions (all JVM-side except NFKC).

Character classes are written as Java regex text; the same strings are
valid RE2 (DuckDB) unless noted.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values ------------------------------------------------------------
# Python str.isspace() whitespace (the `re` flavour of \s, and str.strip()).
WS_PY = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Unicode White_Space (the `regex`-module flavour of \s): no \x1c-\x1f.
WS_UNI = (r"[\t-\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The same two sets as literal characters (for trim()).
WS_PY_CHARS = ("".join(map(chr, range(0x09, 0x0E))) + "".join(map(chr, range(0x1C, 0x21)))
               + "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
               + "\u2028\u2029\u202f\u205f\u3000")
# Default character allow-list of the page cleaner (a character-class body,
# the same in Java, RE2 and Python): the Devanagari block, ASCII letters and
# digits, space and punctuation.
DEFAULT_ALLOWED = "\u0900-\u097Fa-zA-Z0-9 \u0964.!?,:;()\"'\u2019\u201C\u201D\\-/"
# Markup patterns of the page cleaner, applied in this order, each -> " ".
TAG_RE = r"<.*?>"
FILE_LINK_RE = r"\[\[File:.*?\]\]"
TEMPLATE_RE = r"\{\{.*?\}\}"
CITATION_RE = r"\[\p{Nd}+\]"
# Pre-tokeniser: runs of word characters, or runs of other non-space.
PRETOKEN_RE = r"(?U)\w+|[^\w\s]+"
# -----------------------------------------------------------------------------


def _class_ranges(cps):
    """Sorted code points -> "\\x{a}-\\x{b}..." character-class body."""
    out, start, prev = [], None, None
    for cp in sorted(cps):
        if start is None:
            start = prev = cp
        elif cp == prev + 1:
            prev = cp
        else:
            out.append((start, prev))
            start = prev = cp
    if start is not None:
        out.append((start, prev))
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


# The complement of the allow-list as a positive class, derived from it: Java
# matches it in about half the time of the negated one.
DISALLOWED_RE = "[" + _class_ranges(
    map(ord, re.findall(f"[^{DEFAULT_ALLOWED}]", "".join(map(chr, range(0x110000)))))) + "]"

# Java `.` also stops at \r, \x85,  ,  ; (?d) makes it stop at \n only.
_UNIX = "(?d)"


def py_strip(c: Column) -> Column:
    """str.strip(): remove leading/trailing Unicode whitespace. trim() with
    an explicit character set (plain trim() removes only 0x20)."""
    return F.trim(c, F.lit(WS_PY_CHARS))


def collapse_ws(c: Column, ws: str = WS_PY) -> Column:
    """Every whitespace run -> one space. A run that already is one space is
    left alone (no match), so ordinary text costs no replacement."""
    not_space = ws.replace(r"\x{1c}-\x{20}", r"\x{1c}-\x{1f}").replace(r"\x{20}", "")
    return F.regexp_replace(c, f" {ws}+|{not_space}{ws}*", " ")


def _where(c: Column, mark: str, changed: Column) -> Column:
    """A text without the opening mark cannot match: skip its regex."""
    return F.when(c.contains(mark), changed).otherwise(c)


def strip_tags(c: Column) -> Column:
    return _where(c, "<", F.regexp_replace(c, _UNIX + TAG_RE, " "))


def strip_markup(c: Column) -> Column:
    """File links, templates, numeric citations -> one space each."""
    changed = c
    for pattern in (_UNIX + FILE_LINK_RE, _UNIX + TEMPLATE_RE, CITATION_RE):
        changed = F.regexp_replace(changed, pattern, " ")
    return F.when(c.contains("[") | c.contains("{{"), changed).otherwise(c)


def allow_chars(c: Column, allowed: str = DEFAULT_ALLOWED) -> Column:
    """Every character outside the allow-list becomes one space. `allowed`
    is a character-class body; the default list uses its precomputed
    positive complement."""
    pat = DISALLOWED_RE if allowed == DEFAULT_ALLOWED else f"[^{allowed}]"
    return F.regexp_replace(c, pat, " ")


def clean_line(c: Column, allowed: str = DEFAULT_ALLOWED) -> Column:
    """Page cleaner: strip, tags, file links, templates, citations,
    collapse whitespace, allow-list, strip (in that order)."""
    c = py_strip(c)
    c = strip_tags(c)
    c = strip_markup(c)
    c = collapse_ws(c)
    c = allow_chars(c, allowed)
    return py_strip(c)


def eval_clean(c: Column) -> Column:
    """Evaluation cleaner: str.strip(), then `regex` \\s+ -> ' '."""
    return collapse_ws(py_strip(c), WS_UNI)


def pretokenize(c: Column) -> Column:
    """text -> array of pre-tokens (word runs and punctuation runs)."""
    return F.regexp_extract_all(c, F.lit(PRETOKEN_RE), 0)


def length_no_space(c: Column) -> Column:
    return F.length(F.replace(c, F.lit(" "), F.lit("")))


def words_per_line(c: Column) -> Column:
    """len(s.split()): number of whitespace-separated words."""
    return F.size(F.filter(F.split(c, f"{WS_PY}+"), lambda x: x != ""))


# --- NFKC -------------------------------------------------------------------
def _nfkc_unsafe_latin1():
    """Latin-1 code points that NFKC may change or that may combine with a
    neighbour (derived by rule from unicodedata)."""
    return [cp for cp in range(0x100)
            if not (unicodedata.is_normalized("NFKC", chr(cp))
                    and unicodedata.combining(chr(cp)) == 0)]


# A row needs the Python normaliser only if it holds one of these characters
# or anything above Latin-1. Written as a positive class: Java matches it
# about 6x faster than the equivalent negated class of the safe ranges.
NEEDS_NFKC_RE = ("[" + "".join(f"\\x{{{cp:x}}}" for cp in _nfkc_unsafe_latin1())
                 + "\\x{100}-\\x{10ffff}]")


@F.arrow_udf(T.StringType())
def _nfkc_udf(s: pa.Array) -> pa.Array:
    def one(x):
        if x is None or unicodedata.is_normalized("NFKC", x):
            return x
        return unicodedata.normalize("NFKC", x)
    return pa.array(map(one, s.to_pylist()), pa.string())


def nfkc(c: Column) -> Column:
    """NFKC normalisation. Rows made of NFKC-safe Latin-1 are not sent to
    Python at all: the UDF receives NULL for them (Arrow carries a null bit)."""
    needs = c.rlike(NEEDS_NFKC_RE)
    return F.coalesce(_nfkc_udf(F.when(needs, c)), c)
