"""Alphanumeric words, shared by importance resampling and ranked search.

A word is a maximal run of 0-9, a-z (A-Z are lowered, nothing else) and all
characters from U+0080 on. As no byte of a UTF-8 sequence is an ASCII one, the
same rule holds for bytes: one translation makes every separator a blank, and
splitting at blanks gives the words in UTF-8.
"""

from __future__ import annotations

_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TO = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))
PIECE = 1 << 20          # bytes whose words are held at once


def pieces(text: bytes | None, size: int = PIECE):
    """The words of a text, as lists of the words of some ``size`` bytes each:
    a piece ends at a separator, a longer word is a piece of its own."""
    at, text = 0, (text or b"").translate(_TO)
    while at < len(text):
        end = len(text)
        if end - at > size:
            cut = text.rfind(b" ", at + 1, at + size)
            cut = cut if cut > 0 else text.find(b" ", at + size)
            end = cut if cut > 0 else end
        words = text[at:end].split()
        if words:
            yield words
        at = end
