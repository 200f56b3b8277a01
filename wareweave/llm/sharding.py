"""Byte-balanced shards by histogram sort, in DataFrame functions only.

Rows are ordered by (xxhash64 of the text, xxhash64 of doc_id), so equal texts lie
side by side and only a boundary that must cut a large group of copies does so.
Each round counts the exact bytes and rows of every candidate interval inside the
interval that still holds a boundary, 4096 finer intervals per boundary, until all
splitters meet the tolerance or single rows are reached. Only these counts (at most
4096 per boundary) come to the driver. Then the rows are exchanged once, keyed by
blocks of the same order, which gives every row its slot.

Defined cases: a null text has no bytes, size 1 and CRC 0; a null doc_id hashes like
any value; repeated rows are all placed; one document larger than a shard's share
gives the boundary next to it; an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareweave.llm.common import checkpoint, table, whole_text

SHARDS = 16
#: Allowed distance of a splitter from its target, as a share of one shard.
TOLERANCE = 0.001
#: Bits that one round resolves.
STEP = 12
#: Rows that one block of the exchange should hold at most.
BLOCK_ROWS = 100_000


def keyed_rows(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(F.col("doc_id")).alias("tie"),
    )


def _levels() -> list[tuple[str, int]]:
    """(column, shift) of each round: ever finer prefixes of key, then of tie."""
    shifts = [*range(64 - STEP, 0, -STEP), 0]
    return [(c, s) for c in ("key", "tie") for s in shifts]


def _inside(level: tuple[str, int], parents: list[tuple[int, ...]]) -> Column:
    """Rows within any of the parent intervals; a parent is (key prefix[, tie prefix])."""
    column, shift = level
    if column == "key":
        return F.shiftright("key", shift).isin([p[0] for p in parents])
    hit = F.lit(False)
    for key, prefix in parents:
        hit = hit | ((F.col("key") == key) & (F.shiftright("tie", shift) == prefix))
    return hit


def _prefix(level: tuple[str, int]) -> list[Column]:
    column, shift = level
    own = F.shiftright(column, shift).alias("p0" if column == "key" else "p1")
    return [own] if column == "key" else [F.col("key").alias("p0"), own]


def find_splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[Column]:
    """One condition per boundary, true for the rows at or above it."""
    levels = _levels()
    total = None
    open_: dict[int, tuple[tuple[int, ...] | None, int]] = {b: (None, 0) for b in range(1, shards)}
    found: dict[int, Column] = {}
    for i, level in enumerate(levels):
        part = rows
        if i and levels[i - 1][0] == level[0]:
            part = rows.filter(_inside(levels[i - 1], sorted({p for p, _ in open_.values()})))
        elif i:
            part = rows.filter(F.col("key").isin(sorted({p[0] for p, _ in open_.values()})))
        counts = part.groupBy(*_prefix(level)).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        if total is None:
            total = sum(r["bytes"] for r in counts)
            if not total:
                return []
        bins: dict[tuple[int, ...] | None, list] = defaultdict(list)
        for r in sorted(counts, key=lambda r: (r["p0"], r["p1"] if "p1" in r else 0)):
            at = (r["p0"],) if level[0] == "key" else (r["p0"], r["p1"])
            for parent in {p for p, _ in open_.values()}:
                if _is_parent(parent, at, level):
                    bins[parent].append((at, r["bytes"], r["n"]))
        last = i == len(levels) - 1
        nxt: dict[int, tuple[tuple[int, ...] | None, int]] = {}
        for b, (parent, below) in open_.items():
            goal, seen = total * b / shards, below
            for at, size, n in bins[parent]:
                if seen + size >= goal:
                    if min(goal - seen, seen + size - goal) <= tolerance * total / shards or n == 1 or last:
                        found[b] = _at_or_above(level, at, inclusive=goal - seen <= seen + size - goal)
                    else:
                        nxt[b] = (at, seen)
                    break
                seen += size
        open_ = nxt
        if not open_:
            break
    return [found[b] for b in sorted(found)]


def _is_parent(parent: tuple[int, ...] | None, at: tuple[int, ...], level: tuple[str, int]) -> bool:
    if parent is None:
        return True
    if level[0] == "tie" and len(parent) == 1:  # the first round on tie refines a single key
        return parent[0] == at[0]
    wider = STEP if level[1] else 64 % STEP or STEP
    return parent[:-1] == at[:-1] and parent[-1] == at[-1] >> wider


def _at_or_above(level: tuple[str, int], at: tuple[int, ...], inclusive: bool) -> Column:
    column, shift = level
    own = F.shiftright(column, shift)
    beyond = own >= at[-1] if inclusive else own > at[-1]
    return beyond if column == "key" else (F.col("key") > at[0]) | ((F.col("key") == at[0]) & beyond)


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    rows = checkpoint(keyed_rows(docs))
    shard = sum((c.cast("int") for c in find_splitters(rows, shards, tolerance)), F.lit(0))
    # Blocks are prefixes of the order; their number follows the rows, not the data's shape.
    bits = max(STEP, math.ceil(math.log2(max(1, rows.count()) / BLOCK_ROWS)))
    placed = rows.withColumn("shard", shard.cast("int"))
    placed = placed.withColumn("kb", F.shiftright("key", 64 - bits // 2))
    placed = placed.withColumn("tb", F.shiftright("tie", 64 - (bits - bits // 2)))
    block = ["shard", "kb", "tb"]
    before = Window.partitionBy("shard").orderBy("kb", "tb").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy(*block).orderBy("key", "tie", "doc_id", "text_crc32")
    return (
        placed.withColumn("in_block", F.row_number().over(order))
        .join(starts, block)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("in_block") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def shard_query(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
