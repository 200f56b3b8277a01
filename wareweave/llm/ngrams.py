"""Counting symbol n-grams with Spark, and smoothed models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareweave.llm.batches import slices, strings
from wareweave.llm.symbols import BITS, ORDER, SYMBOLS, codes, symbols, tally

#: Distinct n-grams that a task holds before it hands its tally on.
HELD = 2_000_000


def suffix(code: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols of each n-gram."""
    return code & np.uint32((1 << BITS * order) - 1)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def merge(tallies: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum tallies: sorted distinct codes and their counts."""
    code = np.concatenate([np.zeros(0, np.uint32), *(c for c, _ in tallies)])
    n = np.concatenate([np.zeros(0, np.int64), *(k for _, k in tallies)])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = _starts(code)
    return code[first], np.add.reduceat(n, first) if len(n) else n


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(code, n): every 4-gram of the single string column of all rows, and its count."""
    column = texts.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, column):
                held.append(tally(codes(*symbols(strings(part.column(0))))))
                if sum(len(c) for c, _ in held) > HELD:
                    held = [merge(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield _rows(*held.pop())
        yield _rows(*merge(held))

    return texts.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _rows(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(n.astype(np.int64))], names=["code", "n"])


def gather(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The counted table as sorted arrays: at most 2^24 rows, bounded by the code."""
    found = counts.toArrow()
    return merge([(found.column("code").to_numpy().astype(np.uint32), found.column("n").to_numpy())])


class NgramTables:
    """For each order, sorted n-gram hashes with log probabilities, and sorted context
    hashes with log back-off weights; an n-gram that was not seen backs off."""

    def __init__(
        self,
        levels: list[tuple[np.ndarray, np.ndarray]],
        smooth: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    ):
        """levels: sorted hashes and counts from order 1 up. smooth(counts, starts of the
        contexts' runs) gives each n-gram's own mass, and of each context the mass it
        leaves to the lower order and the sum of both."""
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []
        for order, (hashes, n) in enumerate(levels, 1):
            if not len(hashes):
                nothing = np.zeros(0, np.float32)
                self.grams.append((hashes, nothing))
                self.backoff.append((hashes, nothing))
                continue
            context = hashes >> np.uint32(BITS)
            first = _starts(context)
            own, left, total = smooth(n, first)
            which = np.cumsum(np.r_[False, context[1:] != context[:-1]])
            shorter = np.exp(self.score(suffix(hashes, order - 1), order - 1))
            p = own / total[which] + (left / total)[which] * shorter
            self.grams.append((hashes, np.log(p).astype(np.float32)))
            self.backoff.append((context[first], np.log(left / total).astype(np.float32)))

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search: the values of the wanted keys (0 if absent), and which are there."""
        if not len(keys):
            return np.zeros(len(wanted), np.float32), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        known = keys[at] == wanted
        return np.where(known, values[at], np.float32(0)), known

    def score(self, wanted: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Natural log probability of the last symbol of each n-gram given the others."""
        if order == 0:
            return np.full(len(wanted), -np.log(SYMBOLS), np.float32)
        out, known = self._find(*self.grams[order - 1], wanted)
        if not known.all():
            rest = wanted[~known]
            weight, _ = self._find(*self.backoff[order - 1], rest >> np.uint32(BITS))
            out[~known] = weight + self.score(suffix(rest, order - 1), order - 1)
        return out


def text_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, given the texts' lengths."""
    ends, stop = np.r_[0, np.cumsum(values, dtype=np.float64)], np.cumsum(sizes)
    return ends[stop] - ends[stop - sizes]
