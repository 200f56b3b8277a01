"""Characters as 6-bit symbols, and character n-grams as integer codes.

Symbol 0 is the boundary: any run of ASCII white space, and the space before and
after a text. a-z (either case) are 1-26, digits 27, other ASCII signs 28-35 by
their code, and all other code points hash to 36-63 after lower-casing. An n-gram of
up to four symbols is the exact 6n-bit number of its symbols, so a table of n-grams
has at most 2^(6n) entries whatever the size of the corpus; the code's upper bits are
its context and its lower bits its suffix.
"""

from __future__ import annotations

import functools

import numpy as np

BITS = 6
SYMBOLS = 1 << BITS
ORDER = 4


@functools.cache
def symbol_table() -> np.ndarray:
    """Symbol of every code point."""
    points = np.arange(0x110000, dtype=np.uint32)
    lower = points.copy()
    for c in range(0x80, 0x590):  # cased letters of the common scripts
        if len(small := chr(c).lower()) == 1:
            lower[c] = ord(small)
    table = (36 + (lower * np.uint32(2654435761) >> np.uint32(16)) % 28).astype(np.uint8)
    ascii_ = table[:128]
    ascii_[:] = 28 + points[:128] % 8
    ascii_[ord("0") : ord("9") + 1] = 27
    for first in "aA":
        ascii_[ord(first) : ord(first) + 26] = np.arange(1, 27)
    ascii_[9:14] = 0
    ascii_[32] = 0
    return table


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row and the length of each text's part.

    A text's part has single boundaries between words and one at its end, none at its
    start; a text without words has length 0.
    """
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    s = symbol_table()[points]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    keep = s != 0
    keep[1:] |= s[:-1] != 0  # the first blank after a word stays
    keep[starts] = s[starts] != 0
    kept = np.add.reduceat(keep, starts, dtype=np.int64) if len(texts) else sizes
    return s[keep], kept


def codes(s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The n-gram of order ``ORDER`` that ends at each symbol; texts start in boundaries."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    padded = np.zeros(len(s) + (ORDER - 1) * len(starts), np.uint32)
    mine = np.ones(len(padded), bool)
    at = starts + (ORDER - 1) * np.arange(len(starts))
    for k in range(ORDER - 1):
        mine[at + k] = False
    padded[mine] = s
    out = padded.copy()
    for k in range(1, ORDER):
        out[k:] |= padded[:-k] << np.uint32(BITS * k)
    return out[mine]


def tally(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and their counts."""
    code = np.sort(code)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], np.diff(np.r_[first, len(code)])
