"""Document quality by a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it, the
last one aligned to its end; a document shorter than a chunk is padded. Each byte has
a learned vector; learned filters of ``WIDTH`` bytes move over a chunk every ``STRIDE``
bytes, are rectified and max-pooled over the chunk. The chunks' maxima are combined
by their maximum and their mean, and one logistic unit turns these into a
probability. The network is fitted by Adam on whole texts of a bounded sample of
labelled rows outside the held-out fold (``ROWS_PER_CLASS`` of each class and
``SAMPLE_BYTES`` of text); its bias is then moved to the class frequencies of all
labelled rows.

Defined cases: a null text counts as empty; an empty text is a chunk of padding and
gets its score; a very long text is scored whole, in pieces that overlap like its chunks;
of equal maxima the first window counts; repeated rows get the same score; without labelled rows of both
classes the score is the smoothed share of good labels; an empty table gives an empty
result; input columns named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareweave.llm.batches import add_columns
from wareweave.llm.common import table, whole_text
from wareweave.llm.sampling import held_out, labelled_sample

ROWS_PER_CLASS = 1500
SAMPLE_BYTES = 32 << 20
CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE, VECTOR, FILTERS = 8, 4, 6, 24
EPOCHS, BATCH, RATE = 8, 32, 0.01
THRESHOLD = 0.3
#: Byte value used for padding; it occurs in no UTF-8 text.
PAD = 0xFF
#: Bytes that the filters run over at once.
BLOCK = 1 << 20


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, padded; start and end window of every chunk; chunks per text."""
    windows = (CHUNK - WIDTH) // STRIDE + 1
    parts, starts, counts, base = [], [], [], 0
    for t in texts:
        length = max(CHUNK, -(-len(t) // STRIDE) * STRIDE)
        parts.append(t.ljust(length, bytes([PAD])))
        first = list(range(0, length - CHUNK, CHUNK - OVERLAP)) + [length - CHUNK]
        starts += [(base + f) // STRIDE for f in first]
        counts.append(len(first))
        base += length
    data = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.array(starts, np.int64)
    return data, begin, begin + windows, np.array(counts, np.int64)


@dataclass
class Network:
    vectors: np.ndarray  # byte value x VECTOR
    filters: np.ndarray  # WIDTH * VECTOR x FILTERS
    offsets: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    bias: float

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Rectified filter responses at every window."""
        x = self.vectors[data].ravel()
        n = (len(data) - WIDTH) // STRIDE + 1
        step = x.strides[0]
        view = np.lib.stride_tricks.as_strided(x, (n, WIDTH * VECTOR), (STRIDE * VECTOR * step, step), writeable=False)
        return np.maximum(view @ self.filters + self.offsets, 0)

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of every chunk, and chunks per text."""
        data, begin, end, counts = layout(texts)
        h = self.responses(data)
        h = np.vstack([h, h[-1:]])  # so that the last chunk's end is an index
        return np.maximum.reduceat(h, np.column_stack([begin, end]).ravel())[::2], counts

    def features(self, chunks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        first = np.cumsum(counts) - counts
        return np.hstack([np.maximum.reduceat(chunks, first), np.add.reduceat(chunks, first) / counts[:, None]])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        i = 0
        while i < len(texts):  # long texts in pieces that overlap like their chunks
            j, held = i, 0
            while j < len(texts) and (j == i or held + len(texts[j]) <= BLOCK):
                held += len(texts[j])
                j += 1
            f = self._long(texts[i]) if j == i + 1 and held > BLOCK else self.features(*self.pooled(texts[i:j]))
            out[i:j] = f @ self.out + self.bias
            i = j
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def _long(self, text: bytes) -> np.ndarray:
        """Features of one text above the block size, the same as in one piece."""
        step = CHUNK - OVERLAP
        length = -(-len(text) // STRIDE) * STRIDE
        text = text.ljust(length, bytes([PAD]))
        per, best, total, n = BLOCK // step, None, 0.0, 0
        firsts = list(range(0, length - CHUNK, step))
        for k in range(0, len(firsts), per):
            group = firsts[k : k + per]
            chunks, _ = self.pooled([text[group[0] : group[-1] + CHUNK]])
            chunks = chunks[: len(group)]
            best = chunks.max(0) if best is None else np.maximum(best, chunks.max(0))
            total, n = total + chunks.sum(0), n + len(group)
        last, _ = self.pooled([text[length - CHUNK :]])
        return np.hstack([np.maximum(best, last[0]), (total + last[0]) / (n + 1)])[None, :]


def fit(texts: list[bytes], label: np.ndarray, population: dict[int, int]) -> Network:
    rng = np.random.default_rng(11)
    prior = float(np.log((population[1] + 0.5) / (population[0] + 0.5)))
    params = [
        rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
        rng.normal(0, (WIDTH * VECTOR) ** -0.5, (WIDTH * VECTOR, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        np.zeros(1, np.float32),
    ]
    n1, n0 = int(label.sum()), int((1 - label).sum())
    if not n1 or not n0:
        params[3][:] = 0
        return Network(*params[:4], prior)
    weight = np.where(label == 1, 0.5 * len(label) / n1, 0.5 * len(label) / n0)
    moments = [[np.zeros_like(q), np.zeros_like(q)] for q in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            step += 1
            grads = _gradients(Network(*params[:4], float(params[4][0])), [texts[i] for i in rows], label[rows], weight[rows])
            rate = RATE * (1 - epoch / EPOCHS)
            for q, d, (m, u) in zip(params, grads, moments, strict=True):
                m += 0.1 * (d - m)
                u += 0.001 * (d * d - u)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-7)
    return Network(*params[:4], float(params[4][0]) + prior)


def _gradients(net: Network, texts: list[bytes], label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted log loss; a maximum passes them to its window only."""
    data, begin, end, counts = layout(texts)
    h = net.responses(data)
    top = np.array([h[a:b].argmax(0) + a for a, b in zip(begin, end, strict=True)])  # chunk x filter: window
    chunks = np.take_along_axis(h, top, 0)
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), counts)
    f = net.features(chunks, counts)
    g = ((1 / (1 + np.exp(-(f @ net.out + net.bias))) - label) * weight / len(texts)).astype(np.float32)
    back = g[:, None] * net.out
    is_top = chunks == f[owner, :FILTERS]
    is_top &= np.cumsum(is_top, 0) - (np.cumsum(is_top, 0) - is_top)[first][owner] == 1  # one winner a text
    to_chunk = back[owner, :FILTERS] * is_top + back[owner, FILTERS:] / counts[owner][:, None]
    to_chunk = (to_chunk * (chunks > 0)).astype(np.float32)
    span = top[..., None] * STRIDE + np.arange(WIDTH)  # chunk x filter x byte
    seen = data[span]
    x = net.vectors[seen].reshape(*top.shape, WIDTH * VECTOR)
    d_filters = np.einsum("cf,cfk->kf", to_chunk, x)
    d_x = (to_chunk[..., None] * net.filters.T).reshape(-1, VECTOR)
    d_vectors = np.zeros_like(net.vectors)
    np.add.at(d_vectors, seen.ravel(), d_x)
    return [d_vectors, d_filters, to_chunk.sum(0), f.T @ g, g.sum(keepdims=True)]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows_per_class: int = ROWS_PER_CLASS) -> Network:
    """Fit on whole texts of the bounded sample."""
    sample, population = labelled_sample(docs, labels, label, rows_per_class, SAMPLE_BYTES)
    found = sample.toArrow()
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in found.column("text").to_pylist()]
    return fit(texts, found.column("label").to_numpy().astype(np.int64), population)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """docs with score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand numbers
    added = T.StructType([T.StructField("score", T.DoubleType())])
    work = lambda texts: [pa.array(model.value.scores([t.encode("utf-8", "surrogatepass") for t in texts]))]
    scored = add_columns(docs.withColumn("text", whole_text()), "text", added, work)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
