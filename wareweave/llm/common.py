"""Shared helpers: table reading, lineage cuts, and the word definition."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words.
BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors reach.

    It is the context's checkpoint folder, or the one that spark.checkpoint.dir names.
    Only a local session, where all tasks share this machine, gets a temporary folder; a
    cluster without one is an error, as a machine's own folder would not survive it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def whole_text(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that bear the name of a column about to be added."""
    return df.drop(*names)


def shield(df: DataFrame, *names: str) -> DataFrame:
    """Put input columns that bear an operator's working name out of its way."""
    return df.withColumnsRenamed({n: f"__ww_own_{n}" for n in names if n in df.columns})


def unshield(df: DataFrame, columns: list[str]) -> DataFrame:
    """The input's columns with their own values, in their order."""
    own = lambda c: f"__ww_own_{c}"
    return df.select(*[F.col(f"`{own(c)}`").alias(c) if own(c) in df.columns else F.col(f"`{c}`") for c in columns])
