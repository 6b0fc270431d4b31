"""Texts of plain characters cut to pieces by array operations on their bytes, many texts at once.

Plain are ASCII and the Latin letters, digits and marks below U+0180 that are normal as they stand and have one lower case.
Patterns of tokenizers cut such texts into runs of letters, digits and other characters; what differs between patterns is
left to their modules."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: Kinds of characters; what is not plain is FOREIGN.
SPACE, LETTER, DIGIT, OTHER, FOREIGN = range(5)
PLAIN = 0x180
#: Endings that an apostrophe takes, in the order in which patterns try them.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind and the lower case of each character below PLAIN."""
    kind, lower = np.full(PLAIN, OTHER, np.uint8), np.arange(PLAIN, dtype=np.uint16)
    for i in range(PLAIN):
        c = chr(i)
        lower[i] = ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < PLAIN else i
        category = unicodedata.category(c)
        if c in " \t\n\x0b\x0c\r":
            kind[i] = SPACE
        elif 0x7F < i <= 0xA0 or len(c.lower()) != 1 or unicodedata.normalize("NFC", c) != c:
            kind[i] = FOREIGN  # among them the white space beyond ASCII
        elif category[0] in "LN":
            kind[i] = LETTER if category[0] == "L" else DIGIT
    return kind, lower


def classify(data: np.ndarray, rows: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts laid end to end (rows: where they start, and the end), lower-cased if asked for; the kind of the
    character of each byte; the texts that are not plain."""
    of_kind, of_lower = kinds()
    ascii_only = np.minimum(data, 0x7F)
    kind = of_kind[ascii_only]
    low = of_lower[:0x80].astype(np.uint8)[ascii_only] if lower else data
    high = np.flatnonzero(data >= 0x80)
    if not len(high):
        return low, kind, np.zeros(0, np.int64)
    lead = high[data[high] >= 0xC0]
    code = (data[lead].astype(np.int64) & 0x3F) << 6 | data[np.minimum(lead + 1, len(data) - 1)] & 0x3F
    own = (data[lead] < 0xE0) & (code < PLAIN)
    found = np.where(own, of_kind[np.where(own, code, 0)], FOREIGN)
    odd = np.unique(np.searchsorted(rows, lead[found == FOREIGN], side="right") - 1)
    lead, code, found = lead[own], code[own], found[own]
    kind[lead] = kind[lead + 1] = found
    if lower:
        low[high] = data[high]
        new = of_lower[code]
        low[lead], low[lead + 1] = 0xC0 | new >> 6, 0x80 | new & 0x3F
    return low, kind, odd


def runs(kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether a run of one kind starts at each byte; texts start runs."""
    first = np.empty(len(kind), bool)
    first[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first[rows[:-1][rows[:-1] < len(kind)]] = True
    return first


def contract(low: np.ndarray, kind: np.ndarray, rows: np.ndarray, first: np.ndarray) -> None:
    """Gives an apostrophe that is a whole run the ending behind it, in place."""
    mark = np.flatnonzero((low[:-1] == 0x27) & first[:-1] & first[1:] & (kind[1:] == LETTER))
    mark = mark[~np.isin(mark + 1, rows)]
    if not len(mark):
        return
    stop = np.append(rows[1:], len(low))[np.searchsorted(rows, mark, side="right") - 1]
    free = np.ones(len(mark), bool)
    for x in CONTRACTIONS:
        fits = free & (mark + len(x) < stop)
        for k, c in enumerate(x.encode(), 1):
            fits[fits] = low[mark[fits] + k] == c
        free &= ~fits
        at = mark[fits]
        first[at + 1] = False
        after = at + len(x) + 1
        first[after[after < len(low)]] = True
