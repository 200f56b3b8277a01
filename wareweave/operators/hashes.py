"""Near duplicates by three fused 64-bit image hashes: one row an image, no list of pairs.

Similarity is the weighted mean of 1 - differing bits / 64 over the average, perceptual and
wavelet hash, .2, .5 and .3. Two images are near-identical above 0.95, so that twice the
first's differing bits, five times the second's and three times the third's are at most 31.
With four or more bits of the second apart, at most three of the third's are: so every near
pair has the second or the third hash at most three bits apart. Either is cut into five
bands of which two must agree, which makes ten keys of about 25 bits for each hash.

Only distinct hash triples are compared. A crowded key is cut into tiles, and each tile
gives one row an image: how many it is linked with and the least of those that the tile
connects it with, so output and shuffle stay linear where many images are alike. A pair counts
under the first key on which it agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareweave.operators.components import components
from wareweave.operators.tiles import self_tiled
from wareweave.session import checkpoint

#: Tenths that a differing bit of each hash costs, and the most that near-identical images may cost.
COSTS, MOST = (2, 5, 3), 31
#: Bits of the second or third hash that are at most apart, and bands that then agree.
APART, AGREE = 3, 2
TILE_ROWS = 2048
#: Rows of one side that a tile compares at a time.
STRIPE = 256


def band_masks(apart: int = APART, agree: int = AGREE, bits: int = 64) -> list[int]:
    """Masks of all choices of ``agree`` of the bands, of which ``apart`` more are cut."""
    bands = apart + agree
    edges = [bits * i // bands for i in range(bands + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _near(first: np.ndarray, second: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Near pairs of two blocks of hash triples as row numbers and their three differences."""
    for start in range(0, len(first), STRIPE):
        block = first[start : start + STRIPE]
        apart = block[:, None, :] ^ second[None, :, :]
        cost = (np.bitwise_count(apart).astype(np.int32) * np.array(COSTS, dtype=np.int32)).sum(2)
        i, j = np.nonzero(cost <= MOST)
        if same:
            i, j = i[i + start < j], j[i + start < j]
        if len(i):
            yield i + start, j, apart[i, j]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tile(ids: np.ndarray, hashes: np.ndarray, second: np.ndarray, cross: bool, key: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(id, root, links) of the rows that a tile links; ids ascend."""
    left = np.flatnonzero(~second)
    right = np.flatnonzero(second) if cross else left
    a, b, links = [], [], np.zeros(len(ids), np.int64)
    for i, j, bits in _near(hashes[left], hashes[right], not cross):
        a.append(left[i])
        b.append(right[j])
        # keys before this one on which the pair agrees, of the second and then of the third hash
        earlier = np.array([((bits[:, 1 + k // (len(masks))] & masks[k % len(masks)]) == 0) for k in range(key)]).any(0) if key else np.zeros(len(i), bool)
        np.add.at(links, np.concatenate([left[i[~earlier]], right[j[~earlier]]]), 1)
    if not a:
        return None
    root = _roots(len(ids), np.concatenate(a), np.concatenate(b))
    named = (links > 0) | (root != np.arange(len(ids)))
    return ids[named], ids[root[named]], links[named]


def linked(first: DataFrame) -> DataFrame:
    """(id, root, links), a row for each tile and image that has links there.

    first: id, h1, h2, h3 with distinct triples of hashes.
    """
    masks = band_masks()
    of = lambda h, k, m: F.struct(F.lit(k).alias("number"), F.col(h).bitwiseAND(F.lit(_signed(m)).cast("long")).alias("bits"))
    keys = [of("h2", k, m) for k, m in enumerate(masks)] + [of("h3", len(masks) + k, m) for k, m in enumerate(masks)]
    posts = first.select("id", "h1", "h2", "h3", F.inline(F.array(*keys)))
    tiles = self_tiled(posts, ["number", "bits"], [F.col("id")], TILE_ROWS)
    group = F.xxhash64("number", "bits", "tile")
    dealt = tiles.select("id", "h1", "h2", "h3", "number", "second", "cross", group.alias("group"))
    dealt = dealt.repartition("group").sortWithinPartitions("group", "number", "id")
    table = np.array([np.uint64(m) for m in masks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group_rows in _runs(batches, "group"):
            ids = np.asarray(group_rows.column("id"))
            hashes = np.stack([np.asarray(group_rows.column(h)).view(np.uint64) for h in ("h1", "h2", "h3")], axis=1)
            second = np.asarray(group_rows.column("second"))
            found = _tile(ids, hashes, second, group_rows.column("cross")[0].as_py(), group_rows.column("number")[0].as_py(), table)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["id", "root", "links"])

    return dealt.mapInArrow(run, "id long, root long, links long")


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys of sorted batches, each as one table of contiguous columns."""
    rows = (piece for batch in batches for piece in _pieces(batch, column))
    for _, pieces in groupby(rows, key=lambda x: x[0]):
        yield pa.Table.from_batches([x[1] for x in pieces]).combine_chunks()


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    keys = np.asarray(batch.column(column))
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield int(keys[a]), batch.slice(a, b - a)


def fused_near(images: DataFrame, id_: str, h1: str, h2: str, h3: str) -> DataFrame:
    """(id, rep, links, class_id) of every image.

    rep is the least id of the same three hashes, links the number of other triples that
    are near-identical, class_id the least id that near-identical images lead to, over any
    number of steps. Images without an id or without one of the hashes have no row; repeated rows are
    rows; an empty table gives an empty result.
    """
    hashed = images.select(F.col(id_).cast("long").alias("id"), *[F.col(h).cast("long").alias(n) for h, n in zip((h1, h2, h3), ("h1", "h2", "h3"), strict=True)]).dropna()
    triple = ["h1", "h2", "h3"]
    first = checkpoint(hashed.groupBy(*triple).agg(F.min("id").alias("id")))
    found = checkpoint(linked(first))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.filter("id <> root").select("id", "root")).select(F.col("node").alias("id"), F.col("root").alias("class_id"))
    reps = first.join(links, "id", "left").join(classes, "id", "left")
    reps = reps.select(*triple, F.col("id").alias("rep"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("class_id", "id").alias("class_id"))
    return hashed.join(reps, triple).select("id", "rep", "links", "class_id")
