"""Splits text into the words of ``word_bpe_49k.json``: its special strings, normaliser and word pattern.

The tokenizers library counts letters and numbers by Unicode 16 and lowers letters by Unicode 17; what these added to
the tables of Python 3.13 (Unicode 15.1) is listed here.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

#: Strings of the tokenizer file that stand for one token wherever they occur in a raw text.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")


# Code points that Unicode 16 added, first and last.
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEWER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# Capital letters of Unicode 16 and 17, first and last, and the small letter of the first.
NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_SMALL = {c: small + c - first for first, last, small in NEWER_CAPITALS for c in range(first, last + 1)}
_CAPITAL = re.compile("[" + "".join(map(chr, _SMALL)) + "]")


def _ranges(kind: str, top: int) -> str:
    """A character class's inside for the code points up to ``top`` whose general category starts with ``kind``."""
    newer = {c for first, last in (NEWER_LETTERS if kind == "L" else NEWER_NUMBERS) for c in range(first, last + 1)}
    out, start = [], None
    for c in range(top + 2):
        inside = c <= top and (unicodedata.category(chr(min(c, top)))[0] == kind or c in newer)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(None)
def _word_pattern(top: int) -> re.Pattern:
    """The word pattern for texts without code points above ``top``; smaller classes are faster."""
    letter, number = _ranges("L", top), _ranges("N", top)
    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return re.compile(f"[{letter}]+|'(?:[stmd]|re|ve|ll)|[{number}]|[^{space}{letter}{number}]+")


def _find(text: str) -> list[str]:
    try:
        text.encode("latin-1")
        top = 0xFF
    except UnicodeEncodeError:
        top = 0xFFFF if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else sys.maxunicode
    return _word_pattern(top).findall(text)


def normalise(text: str) -> str:
    """NFC, then lower case letter by letter (a final sigma gets no form of its own)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if _CAPITAL.search(text):
            text = text.translate(_SMALL)
    return text.lower()


def words(text: str | None) -> list[str]:
    """The words of a text in order; special strings come as they are. Null and empty texts have none."""
    if not text:
        return []
    if "<|" not in text:
        return _find(normalise(text))
    out: list[str] = []
    for k, part in enumerate(_SPECIAL.split(text)):
        if k % 2:
            out.append(part)
        elif part:
            out += _find(normalise(part))
    return out


@lru_cache(None)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


def letters(word: str) -> str:
    """A word as byte letters."""
    table = byte_letters()
    return word if word.isascii() and word.isprintable() else "".join(table[b] for b in word.encode())
