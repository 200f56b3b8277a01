"""The bounded, reproducible sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareweave.llm.common import checkpoint, whole_text

FOLDS = 5


def held_out() -> Column:
    """True for the fold that no classifier learns from; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, total_bytes: int = 64 << 20
) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of labelled rows of both classes outside the held-out fold, and the
    number of labelled rows of each class there.

    The sample has at most rows_per_class rows of each class and total_bytes bytes of
    text, half of them for each class; a text above a 32nd of that half is not sampled.
    Rows are taken by the order of a hash of doc_id, so the sample does not depend on
    how the tables are partitioned. Its ids are at most 2 * rows_per_class and are
    broadcast; texts are whole.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    taken = [known.filter(F.col("label") == c).orderBy(order, "doc_id").limit(rows_per_class) for c in (0, 1)]
    ids = taken[0].unionByName(taken[1]).groupBy("doc_id").agg(F.max("label").alias("label"))
    found = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(ids), "doc_id")
    # repeated rows of an id count once, so that the sample keeps its bound
    once = checkpoint(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
    share = total_bytes // 2
    size = F.octet_length("text").cast("long")
    fitting = once.filter(size <= share // 32).select("doc_id", "label", size.alias("size"))
    running = F.sum("size").over(Window.partitionBy("label").orderBy(order, "doc_id"))  # 2 * rows_per_class rows
    chosen = fitting.withColumn("running", running).filter(F.col("running") <= share).select("doc_id")
    return once.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "label"), {c: sizes.get(c, 0) for c in (0, 1)}
