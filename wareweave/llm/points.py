"""Code-point n-grams as 60-bit codes, and counting them with Spark.

Symbol 0 is the boundary: any run of ASCII white space, and the space before and after
a text. A code point below 1,984 (Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic) is its
own symbol. Any other is two symbols, its upper eleven bits (1,088 values) and its lower
ten (1,024 values), so no two code points are ever taken for each other. A code's upper
bits are its context and its lower bits its suffix.

Whether several texts hold an n-gram follows from the least and the greatest hash of
the texts that hold it: they are equal for one text alone, copies of it included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareweave.llm.batches import slices, strings

BITS, ORDER = 12, 5
SYMBOLS = 1 << BITS
#: Code points that are symbols of their own; the first symbol of the lower ten bits of the others.
OWN, LOWER = 1984, 1984 + 1088
#: Symbols that are coded at once, and distinct n-grams that a task holds before it hands its tally on.
STRETCH, HELD = 1 << 21, 2_000_000

#: Sorted codes, their counts, and the least and greatest hash of the texts that hold each.
Tally = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, ORDER - 1 boundaries before each, and each one's text (-1: such a boundary).

    Words have single boundaries between them and one at the text's end; a text without
    words has no symbols.
    """
    parts = [np.zeros(0, np.uint16)]
    owner = [np.zeros(0, np.int32)]
    front = np.zeros(ORDER - 1, np.uint16)
    for i, text in enumerate(texts):
        points = np.frombuffer((text + " ").encode("utf-32-le", "replace"), np.uint32)
        blank = (points == 32) | (points - np.uint32(9) < 5)
        keep = ~blank
        keep[1:] |= ~blank[:-1]  # the first blank after a word stays
        points = np.where(blank, 0, points)[keep]
        wide = points >= OWN
        s = np.where(wide, OWN + (points >> 10), points).astype(np.uint16)
        if wide.any():
            last = np.cumsum(1 + wide) - 1
            s = np.repeat(s, 1 + wide)
            s[last[wide]] = LOWER + (points[wide] & 1023)
        if len(s):
            parts += [front, s]
            owner += [np.full(ORDER - 1, -1, np.int32), np.full(len(s), i, np.int32)]
    return np.concatenate(parts), np.concatenate(owner)


def stretches(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-gram that ends at each symbol, and the number of its text, a stretch at a time."""
    s, owner = _padded(texts)
    for start in range(ORDER - 1, len(s), STRETCH):
        stop = min(start + STRETCH, len(s))
        code = s[start:stop].astype(np.uint64)
        for k in range(1, ORDER):
            code |= s[start - k : stop - k].astype(np.uint64) << np.uint64(BITS * k)
        mine = owner[start:stop] >= 0
        yield code[mine], owner[start:stop][mine]


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _sum(code: np.ndarray, n: np.ndarray, least: np.ndarray, most: np.ndarray) -> Tally:
    """One row for each of the sorted codes."""
    first = _starts(code)
    if not len(first):
        return code, n, least, most
    return code[first], np.add.reduceat(n, first), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)


def _tally(code: np.ndarray, text: np.ndarray) -> Tally:
    order = np.argsort(code)
    text = text[order]
    return _sum(code[order], np.ones(len(code), np.int64), text, text)


def _merge(parts: list[Tally]) -> Tally:
    code, *others = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(code)
    return _sum(code[order], *(x[order] for x in others))


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(code, n, shared): every n-gram of the single string column, its count, and whether several texts hold it."""
    column = texts.columns[0]

    def rows(tally: Tally) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in tally], names=["code", "n", "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Tally] = []
        for batch in batches:
            for part in slices(batch, column):
                found = strings(part.column(0))
                hashes = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) for t in found], np.uint64).astype(np.int64)
                for code, row in stretches(found):
                    held.append(_tally(code, hashes[row]))
                    if sum(len(part[0]) for part in held) > HELD:
                        held = [_merge(held)]
                        if len(held[0][0]) > HELD // 2:
                            yield rows(held.pop())
        if held:
            yield rows(_merge(held))

    counted = texts.mapInArrow(run, "code long, n long, least long, most long").groupBy("code")
    return counted.agg(F.sum("n").alias("n"), (F.min("least") < F.max("most")).alias("shared"))
