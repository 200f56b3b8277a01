"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Two fingerprints at most two bits apart share at least six of their eight bytes, each
at its own position: that is the guaranteed minimum of the count filter. A posting
list per single byte value would hold a 256th of all fingerprints, so a posting's key is
the value of several positional bytes at once. The first index has twelve keys of four
bytes: choices of two pairs out of the pairings of i with i+1, i+2 and i+4 (by bit), so
that the keys inside any six positions cover all six of them. Every pair that meets is
tallied: the positional bytes of all keys under which it met are put together, pairs with
fewer than six are dropped, and what is left is verified by the count of differing bits.

Only distinct fingerprints are indexed, so copies never meet. A key with more than
``hot`` fingerprints is not paired: its fingerprints are split further by two more
positional bytes each, that is, posted under all 28 keys of six bytes and tallied alike;
a pair that met under the crowded key shares one of them. Fingerprints crowded even
there agree in six bytes with more than ``hot`` others out of the 65,536 that can, and
post themselves under all 65 values at most one bit away. Two fingerprints share such a
value exactly if they are at most two bits apart, and no value can have more than 65
posters, so this last way is exact and linear. Links are joined into components by
alternating stars.

Defined cases: a text without words (null, empty, white space) has fingerprint zero
and is linked like any other; fewer than three words form one shingle; a very long text
is hashed whole, its bits unpacked in blocks; a bit set in exactly half of the hashes is
0; repeated rows get the same result; a null doc_id is a member but never names a
component unless all members' ids are null; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareweave.llm.batches import slices, strings
from wareweave.llm.common import checkpoint, table, whole_text
from wareweave.llm.components import components

SEED = 42
SHINGLE = 3
#: Text bytes that a task handles at once, and hashes whose bits it unpacks at once; one longer text goes alone.
SLICE_BYTES, HASHES = 1 << 20, 25_000
#: Differing bits of a link, and the positional bytes that it shares at least.
BITS = 2
MIN_SHARED = 8 - BITS
#: Fingerprints under one key up to which pairs are formed.
HOT = 64
#: A fingerprint of more than one row in so many is joined by broadcast.
FREQUENT = 1000
#: Two hashes of all columns tell rows apart (96 bits).
ROW = ("__ww_row", "__ww_row2")


def _four_bytes() -> list[tuple[int, ...]]:
    """The choices of four positions: two pairs of one of three pairings of the eight."""
    pairings = [{tuple(sorted((i, i ^ d))) for i in range(8)} for d in (1, 2, 4)]
    return sorted({tuple(sorted(a + b)) for p in pairings for a, b in combinations(sorted(p), 2)})


def _six_bytes() -> list[tuple[int, ...]]:
    return list(combinations(range(8), MIN_SHARED))


def shingle_hashes(text: str) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return [h(b" ".join(words), SEED)] if words else []
    return [h(b" ".join(s), SEED) for s in zip(words, words[1:], words[2:], strict=False)]


def simhashes(texts: list[str]) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is set if it is set in over half the hashes."""
    out = np.zeros(len(texts), np.int64)
    hashes = [np.array(shingle_hashes(t), np.uint64) for t in texts]
    filled = [i for i, h in enumerate(hashes) if len(h)]
    block, held = [], 0
    for i in [*filled, None]:  # bits are unpacked for a bounded number of hashes at a time
        if block and (i is None or held + len(hashes[i]) > HASHES):
            sizes = np.array([len(hashes[j]) for j in block])
            bits = np.unpackbits(np.concatenate([hashes[j] for j in block]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            sums = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
            out[block] = np.packbits(2 * sums > sizes[:, None], axis=1).view(">u8").astype(np.uint64).astype(np.int64)[:, 0]
            block, held = [], 0
        if i is not None:
            block.append(i)
            held += len(hashes[i])
    return out


def fingerprints(docs: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, other columns, fp) of every row."""
    rows = docs.select("doc_id", *others, whole_text().alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                fp = pa.array(simhashes(strings(part.column("text"))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], fp], names=schema.names)

    return rows.mapInArrow(run, schema)


def _signed(value: int) -> int:
    return int(np.array(value, np.uint64).astype(np.int64))


def _met(fps: DataFrame, choices: list[tuple[int, ...]], hot: int) -> tuple[DataFrame, DataFrame]:
    """Verified pairs that meet under keys of at most hot members, and the members of other keys."""
    keys = F.array(
        *[
            F.struct(
                F.lit(sum(1 << i for i in positions)).alias("positions"),
                F.col("fp").bitwiseAND(F.lit(_signed(sum(0xFF << 8 * i for i in positions)))).alias("bytes"),
            )
            for positions in choices
        ]
    )
    postings = fps.select("fp", F.inline(keys))
    sizes = postings.groupBy("positions", "bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = checkpoint(postings.join(sizes, ["positions", "bytes"]))
    cold = members.filter(F.col("n") <= hot).select("positions", "bytes", "fp")
    tally = (
        cold.withColumnRenamed("fp", "a")
        .join(cold.withColumnRenamed("fp", "b"), ["positions", "bytes"])
        .filter("a < b")
        .groupBy("a", "b")
        .agg(F.bit_count(F.bit_or("positions")).alias("shared"))
    )
    enough = tally.filter(F.col("shared") >= MIN_SHARED)
    verified = enough.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)
    return verified.select("a", "b"), members.filter(F.col("n") > hot).select("fp").distinct()


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) pairs that connect all distinct fingerprints at most two bits apart."""
    pairs, crowded = _met(fps, _four_bytes(), hot)
    more, crowded = _met(crowded, _six_bytes(), hot)
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    near = crowded.select("fp", F.explode(flips).alias("value")).groupBy("value").agg(F.collect_list("fp").alias("posters"))
    stars = near.filter(F.size("posters") > 1).select(F.array_min("posters").alias("a"), F.explode("posters").alias("b"))
    return pairs.unionByName(more).unionByName(stars.filter("a <> b"))


def _linked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fp and others, checkpointed) with root and component_id.

    A fingerprint of more than a thousandth of all rows is settled by a broadcast of
    those few, so that a large group of copies is not one task of the join.
    """
    fps = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = checkpoint(rooted.join(named, "root").select("fp", "root", "component_id", "n"))
    frequent = by_fp.filter(F.col("n") * FREQUENT > rows.count()).drop("n")  # fewer than FREQUENT rows
    ordinary = rows.join(F.broadcast(frequent.select("fp")), "fp", "left_anti").join(by_fp.drop("n"), "fp")
    return rows.join(F.broadcast(frequent), "fp").unionByName(ordinary)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    return _linked(checkpoint(fingerprints(docs))).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: each component keeps one row.

    It is the row with the smallest doc_id (null last), then the smallest hash of all
    its columns; rows equal in every column count as one. The decision is by row, so
    rows that share a doc_id but not a component are judged apart.
    """
    hashable = [f"`{f.name}`" for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    hashes = F.xxhash64(*hashable), F.hash(*hashable)
    keyed = docs.withColumns(dict(zip(ROW, hashes, strict=True)))
    linked = _linked(checkpoint(fingerprints(keyed, ROW)))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW)).alias("first")
    kept = linked.groupBy("root").agg(first).select(*[F.col(f"first.{c}").alias(c) for c in ROW])
    return keyed.join(kept, list(ROW), "left_semi").dropDuplicates(list(ROW)).drop(*ROW)


def simhash_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
