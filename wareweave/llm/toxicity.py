"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (lower-cased words, cut at ASCII signs and blanks, and
their beginnings), each a 32-bit CRC. The machine has a bias, a weight per term and a
vector of ``FACTORS`` numbers per term; the product of two terms' vectors is the weight
of the pair, so a combination can count more or less than its parts. It is fitted on a
bounded sample of labelled rows outside the held-out fold (``ROWS_PER_CLASS`` of each
class, ``SAMPLE_BYTES`` of text).

Which terms enter is decided twice. Single terms enter whose share of documents differs
between the classes by ``MIN_Z`` standard errors. Pairs are screened as well: among the
``PAIR_TERMS`` most frequent terms (of those in exactly the same rows one), both
terms of a pair enter if the pair's share of documents departs from the product of its
terms' shares differently in the two classes, by a bound of standard errors; so an insult
and a group mention that are as common in clean documents, but not together, are learnt.
The bound is at least what one chance pair in a hundred samples reaches among all pairs;
which of it and ``PAIR_BOUNDS`` holds is chosen by cross-validation over ``INNER_FOLDS``
folds of the sample itself, by the log loss at the labelled rows' class frequencies (of
equal ones the stricter bound). ``MAX_TERMS`` bounds the model. The
bias is then moved to the class frequencies of all labelled rows, since the sample holds
both classes in equal parts. Scoring reads every term of every whole text.

Defined cases: null, empty and blank texts have no terms and get the bias alone; a very
long text is read whole, as the set of its terms; of equally clear terms the smaller hash
enters first; repeated rows get the same score; without labelled rows of both classes
the score is the smoothed share of toxic labels; an empty table gives an empty result;
input columns named like an output column are replaced, others pass through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareweave.llm.batches import add_columns
from wareweave.llm.common import shield, table, unshield, whole_text
from wareweave.llm.sampling import held_out, labelled_sample

ROWS_PER_CLASS = 6000
SAMPLE_BYTES = 64 << 20
MAX_TERMS, MIN_Z, MIN_DOCS = 2048, 6.0, 10
#: Terms whose pairs are screened, and stricter bounds than chance that are tried; the last admits no pair.
PAIR_TERMS, PAIR_BOUNDS = 4096, (12.0, 20.0, 30.0, np.inf)
#: Folds of the sample and steps of a fit in the choice of the bound.
INNER_FOLDS, INNER_STEPS = 3, 100
#: Columns and rows of a block of the pair counts.
BLOCK_TERMS, BLOCK_ROWS = 512, 1500
FACTORS, STEPS, RATE, DECAY = 8, 300, 0.05, 1e-4
THRESHOLD = 0.5
#: Bytes of the beginnings of words that are terms of their own.
PREFIXES = (4, 6)
#: ASCII signs and blanks part terms.
PARTED = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def terms(text: str) -> list[int]:
    """Hashes of the distinct words of a text and of their distinct beginnings.

    Beginnings let a word with an ending that was never labelled count as its stem.
    """
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(PARTED).split())
    out = list(map(zlib.crc32, words))
    for size in PREFIXES:
        out += [zlib.crc32(p, size) for p in {w[:size] for w in words if len(w) > size}]
    return out


@dataclass
class Machine:
    known: np.ndarray  # sorted term hashes
    weight: np.ndarray
    vectors: np.ndarray
    bias: float

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        place = {h: i for i, h in enumerate(self.known.tolist())}
        out = np.full(len(rows), self.bias)
        for r, row in enumerate(rows):
            if at := [i for h in row if (i := place.get(h)) is not None]:
                v = self.vectors[at]
                out[r] += self.weight[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _columns(owner: np.ndarray, place: np.ndarray, chosen: np.ndarray, rows: int, terms: int, kind: type) -> np.ndarray:
    """0/1 matrix of rows by chosen terms."""
    column = np.full(terms, -1, np.int32)
    column[chosen] = np.arange(len(chosen), dtype=np.int32)
    x = np.zeros((rows, len(chosen)), kind)
    there = column[place] >= 0
    x[owner[there], column[place][there]] = 1
    return x


def _paired(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each column, how clearly its clearest pair interacts differently in the classes.

    Counts of pairs are made a block of columns and rows at a time, each pair once.
    """
    clearest = np.zeros(x.shape[1], np.float32)
    sides = [(x[label == c], sign) for c, sign in ((1, np.float32(1)), (0, np.float32(-1)))]
    shares = [side.mean(0, dtype=np.float64).astype(np.float32) for side, _ in sides]
    for at in range(0, x.shape[1], BLOCK_TERMS):
        excess, variance = np.float32(0), np.float32(0)
        for (side, sign), p in zip(sides, shares, strict=True):
            met = np.zeros((min(BLOCK_TERMS, x.shape[1] - at), x.shape[1] - at), np.float32)
            for row in range(0, len(side), BLOCK_ROWS):
                part = side[row : row + BLOCK_ROWS, at:].astype(np.float32)
                met += part[:, :BLOCK_TERMS].T @ part
            together = np.outer(p[at : at + BLOCK_TERMS], p[at:])
            excess = excess + sign * (met / np.float32(len(side)) - together)
            variance = variance + together * (1 - together) / np.float32(len(side))
        z = np.abs(excess) / np.sqrt(np.maximum(variance, np.float32(1e-9)))
        np.fill_diagonal(z, 0)
        clearest[at : at + BLOCK_TERMS] = np.maximum(clearest[at : at + BLOCK_TERMS], z.max(1, initial=0))
        clearest[at:] = np.maximum(clearest[at:], z.max(0, initial=0))
    return clearest


@dataclass
class Sample:
    """Labelled rows as places in the list of known terms: owner is the row of each place."""

    owner: np.ndarray
    place: np.ndarray
    label: np.ndarray
    terms: int

    def part(self, taken: np.ndarray) -> Sample:
        number = np.cumsum(taken, dtype=np.int32) - 1
        there = taken[self.owner]
        return Sample(number[self.owner[there]], self.place[there], self.label[taken], self.terms)

    def matrix(self, chosen: np.ndarray, kind: type = np.float32) -> np.ndarray:
        return _columns(self.owner, self.place, chosen, len(self.label), self.terms, kind)


@dataclass
class Screen:
    clear: np.ndarray  # terms that enter alone, clearest first
    common: np.ndarray  # terms whose pairs were screened, clearest first
    pair: np.ndarray  # how clear the clearest pair of each is
    chance: float

    def entering(self, bound: float) -> np.ndarray:
        joint = self.common[self.pair >= max(bound, self.chance)]
        return np.sort(np.r_[self.clear, joint[~np.isin(joint, self.clear)]][:MAX_TERMS])


def _screen(s: Sample) -> Screen:
    n1, n0 = int(s.label.sum()), int((1 - s.label).sum())
    with1 = np.bincount(s.place, weights=s.label[s.owner], minlength=s.terms)
    with_any = np.bincount(s.place, minlength=s.terms)
    p = with_any / (n1 + n0)
    z = (with1 / n1 - (with_any - with1) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    clear = np.flatnonzero((np.abs(z) >= MIN_Z) & (with_any >= MIN_DOCS))
    clear = clear[np.argsort(-np.abs(z[clear]), kind="stable")][:MAX_TERMS]
    common = np.flatnonzero((with_any >= MIN_DOCS) & (p < 0.95))
    # a word and its beginning that are in the same rows are one term of the screening
    mark = np.bincount(s.place, weights=np.random.default_rng(5).random(len(s.label))[s.owner], minlength=s.terms)
    common = common[np.sort(np.unique(mark[common], return_index=True)[1])]
    common = common[np.argsort(-with_any[common], kind="stable")][:PAIR_TERMS]
    pair = _paired(s.matrix(common, np.uint8), s.label)
    order = np.argsort(-pair, kind="stable")
    pairs = max(len(common) * (len(common) - 1) // 2, 1)
    return Screen(clear, common[order], pair[order], NormalDist().inv_cdf(1 - 0.005 / pairs))


def _descend(x: np.ndarray, label: np.ndarray, steps: int) -> list[np.ndarray]:
    """Bias, weights and vectors by Adam on the log loss, both classes weighing the same."""
    y = label.astype(np.float32)
    rng = np.random.default_rng(7)
    width = x.shape[1]
    params = [np.zeros(1, np.float32), np.zeros(width, np.float32), rng.normal(0, 0.05, (width, FACTORS)).astype(np.float32)]
    moments = [[np.zeros_like(q), np.zeros_like(q)] for q in params]
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()).astype(np.float32)
    for step in range(1, steps + 1):
        _, _, v = params
        s = x @ v
        g = (1 / (1 + np.exp(-np.clip(_logits(x, params, s), -30, 30))) - y) * balance
        back = x.T @ g
        grads = [g.sum(keepdims=True), back + DECAY * params[1], x.T @ (g[:, None] * s) - back[:, None] * v + DECAY * v]
        for q, d, (m, u) in zip(params, grads, moments, strict=True):
            m += 0.1 * (d - m)
            u += 0.001 * (d * d - u)
            q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-8)
    return params


def _logits(x: np.ndarray, params: list[np.ndarray], s: np.ndarray | None = None) -> np.ndarray:
    bias, w, v = params
    s = x @ v if s is None else s
    return bias + x @ w + 0.5 * ((s * s).sum(1) - x @ (v * v).sum(1))


def pair_bound(s: Sample, fold: np.ndarray, prior: float) -> float:
    """The bound of least log loss over the folds, each judged by a fit on the others.

    Where a fold leaves out a whole class, only chance bounds the pairs (0).
    """
    bounds = (*PAIR_BOUNDS[::-1], 0.0)
    loss = np.zeros(len(bounds))
    for k in range(INNER_FOLDS):
        rest, own = s.part(fold != k), s.part(fold == k)
        if min(len(set(rest.label.tolist())), len(set(own.label.tolist()))) < 2:
            return 0.0
        screen, before, last = _screen(rest), None, 0.0
        share = 1 / (1 + np.exp(-prior))
        for i, bound in enumerate(bounds):
            chosen = screen.entering(bound)
            if before is None or not np.array_equal(chosen, before):
                logit = _logits(own.matrix(chosen), _descend(rest.matrix(chosen), rest.label, INNER_STEPS)).astype(float) + prior
                each = np.logaddexp(0, np.where(own.label == 1, -logit, logit))
                last = share * each[own.label == 1].mean() + (1 - share) * each[own.label == 0].mean()
            loss[i] += last
            before = chosen
    return bounds[int(np.argmin(loss))]


def fit(rows: list[np.ndarray], label: np.ndarray, population: dict[int, int]) -> Machine:
    """Fit on rows of the term hashes of each text; their order does not matter."""
    prior = float(np.log((population[1] + 0.5) / (population[0] + 0.5)))
    if not label.sum() or not (1 - label).sum():
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), prior)
    digest = np.array([zlib.crc32(np.sort(np.asarray(r, np.uint32)).tobytes()) for r in rows])
    order = np.lexsort((label, digest))
    rows, label, fold = [rows[i] for i in order], label[order], digest[order] % INNER_FOLDS
    known, place = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    sample = Sample(owner, place.astype(np.int32), label, len(known))
    chosen = _screen(sample).entering(pair_bound(sample, fold, prior))
    bias, w, v = _descend(sample.matrix(chosen), label, STEPS)
    return Machine(known[chosen], w.astype(float), v.astype(float), float(bias[0]) + prior)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> Machine:
    """Fit on the bounded sample; only its term hashes come to the driver."""
    sample, population = labelled_sample(docs, labels, label, rows_per_class, SAMPLE_BYTES)
    added = T.StructType([T.StructField("terms", T.BinaryType())])  # packed: four bytes a term
    packed = lambda texts: [pa.array([np.array(terms(t), np.uint32).tobytes() for t in texts], pa.binary())]
    found = add_columns(sample, "text", added, packed).select("terms", "label").toArrow()
    rows = [np.frombuffer(r.as_buffer(), np.uint32) for r in found.column("terms")]
    return fit(rows, found.column("label").to_numpy().astype(np.int64), population)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # MAX_TERMS rows at most
    added = T.StructType([T.StructField("score", T.DoubleType())])
    work = lambda texts: [pa.array(model.value.scores([terms(t) for t in texts]))]
    scored = add_columns(docs.withColumn("text", whole_text()), "text", added, work)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic; texts stay as they were, null included."""
    rows = shield(docs, "score", "predicted").withColumn("__ww_null", F.col("text").isNull())
    kept = score(rows, train(docs, labels)).filter("predicted = 0")
    return unshield(kept.withColumn("text", F.when(~F.col("__ww_null"), F.col("text"))), docs.columns)
