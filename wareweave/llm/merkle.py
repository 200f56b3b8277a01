"""A Merkle manifest of a dataset: digests of rows, of sources and of the whole, with proofs.

H is the lowercase-hex SHA-256 of its inputs, concatenated. A row's leaf is H of its
fields, each as UTF-8 byte count, ``:`` and value, or ``-`` if null. The leaves of a source
stand in order of doc_id; while more than one node remains, every 16 consecutive ones
become their H. What remains is the source's subroot, and the subroots, in order of source,
grow into the root in the same way.

Each level is one window over runs of 16: lag and lead columns of fixed offsets, masked
by the slot in the run and the run's length, are a node's siblings, and the rows in slot 0
hash themselves and the siblings on their right into the next level. A proof is the list
of (left, right) siblings from the leaf to the root: the runs' parents hand their own
proofs down, so a leaf joins one row of a sixteenth as many.

A source is never one task. Rows are dealt by ranges of (source, doc_id) and numbered
inside their range; a range's start in its source comes from the counts of the source's
ranges, one row for each. All windows hold 16 rows. Only the root comes to the driver.

Defined cases: a null source is a source of its own and comes first; a null doc_id comes
first in its source; rows of one doc_id stand in order of their leaves, equal rows are
leaves of their own; null fields hash as ``-``, unlike empty ones; texts are hashed whole;
a source of one row has its leaf as subroot; an empty table gives an empty result; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareweave.llm.common import checkpoint, table

#: Children of a node.
RUN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Ranges (one row for each source and task) up to which their starts are broadcast.
BROADCAST_STARTS = 50_000
#: monotonically_increasing_id() holds the task above these bits and the row below.
ROW_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length before it, so that no two lists of fields concatenate alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, **instead: Column) -> Column:
    """The digest of a row's fields, of which some may be given instead."""
    return digest(*[field(instead.get(c, docs[c])) for c in FIELDS])


def source_key(source: Column) -> Column:
    """Sources as keys that are never null and keep their order, null first."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """Add pos, from 0, in each key's order, and n, the key's nodes."""
    dealt = nodes.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    rows = checkpoint(dealt.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", ROW_BITS)
    ranges = rows.groupBy("key", part.alias("part")).agg(F.count(F.lit(1)).alias("held"), F.min("at").alias("first"))
    all_of = Window.partitionBy("key")
    before = all_of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpoint(
        ranges.select(
            "key", "part", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(all_of).alias("n")
        )
    )
    if starts.count() <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    found = rows.withColumn("part", part).join(starts, ["key", "part"])
    return found.withColumn("pos", F.col("start") + F.col("at") - F.col("first")).drop("at", "part", "first", "start")


def siblings(nodes: DataFrame) -> DataFrame:
    """Add run, slot, and left and right: the siblings' digests before and after a node's own."""
    nodes = nodes.withColumns({"run": F.floor(F.col("pos") / RUN).cast("long"), "slot": (F.col("pos") % RUN).cast("int")})
    length = F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN)
    along = Window.partitionBy("key", "run").orderBy("pos")
    left = [F.when(F.col("slot") >= k, F.lag("node", k).over(along)) for k in range(RUN - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < length, F.lead("node", k).over(along)) for k in range(1, RUN)]
    return nodes.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right)})


def parents(level: DataFrame) -> DataFrame:
    """The next level: the first row of each run hashes itself and its siblings."""
    first = level.filter("slot = 0")
    return first.select("key", F.col("run").alias("pos"), F.ceil(F.col("n") / RUN).cast("long").alias("n"), digest(F.col("node"), F.col("right")).alias("node"))


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Each level's nodes, leaves first, and one row a key: key, level, node (its root)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [nodes], []
    while True:
        tops.append(levels[-1].filter("n = 1").select("key", F.lit(len(tops)).alias("level"), "node"))
        if most <= 1:
            break
        levels.append(checkpoint(parents(siblings(levels[-1].filter("n > 1")))))
        most = -(-most // RUN)
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    return levels, checkpoint(roots)


def hand_down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first level's nodes with their proofs; tops: key, level, proof, and what else to add."""
    added = [c for c in tops.columns if c not in ("key", "level", "proof")]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        alone = levels[k].filter("n = 1").join(tops.filter(F.col("level") == k).drop("level"), "key")
        if above is not None:
            level = siblings(levels[k].filter("n > 1"))
            one = F.array(F.struct("left", "right"))
            level = level.join(above, ["key", "run"]).withColumn("proof", F.concat(one, "proof"))
            alone = alone.unionByName(level.drop("run", "slot", "left", "right"))
        above = alone.select("key", F.col("pos").alias("run"), "proof", *added) if k else alone
    return above


def manifest(leaves: DataFrame) -> DataFrame:
    """Rows of key, doc_id, node and any others, with subroot, root and proof added.

    proof is an array of structs (left, right) of concatenated digests, the leaf's run first.
    """
    placed_leaves = placed(leaves, "doc_id", "node")
    levels, roots = grow(placed_leaves)
    sources = roots.select(F.lit("").alias("key"), F.col("key").alias("source"), "level", "node")
    upper, root = grow(placed(sources, "source"))
    whole = root.first()  # one row, or none for an empty table
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    apex = root.select("key", "level", nothing.alias("proof"))
    # the source's own level is a column of the upper tree's leaves, the apex's is its own
    upper = [upper[0].withColumnRenamed("level", "ends"), *upper[1:]]
    subroots = hand_down(upper, apex).select(F.col("source").alias("key"), F.col("ends").alias("level"), F.col("node").alias("subroot"), "proof")
    found = hand_down(levels, checkpoint(subroots))
    return found.withColumn("root", F.lit(whole["node"] if whole else None).cast("string")).drop("pos", "n")


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, start, lambda node, step: digest(step["left"], node, step["right"]))


def proof_digest(proof: Column) -> Column:
    """H of all siblings of a proof in their order."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def merkle_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate(docs["text"], string.ascii_uppercase, string.ascii_lowercase)
    marked = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    leaves = docs.select(
        source_key(docs["source"]).alias("key"),
        docs["doc_id"],
        leaf(docs).alias("node"),
        F.when(marked, leaf(docs, text=lowered)).alias("tampered"),
    )
    proved = manifest(checkpoint(leaves))
    root = folded(F.coalesce("tampered", "node"), F.col("proof"))
    return proved.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _levels_sql(tag: str, first: str, levels: int) -> str:
    """CTEs {tag}0.. of nodes and {tag}s0.. of their siblings; a key's lone node stays as it is."""
    out = [f"{tag}0 AS ({first})"]
    for i in range(levels + 1):
        run = f"OVER (PARTITION BY k, pos // {RUN} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        out.append(f"""{tag}s{i} AS (
  SELECT k, pos, n, CASE WHEN n = 1 THEN '' ELSE array_to_string(l[1:slot], '') END AS l, CASE WHEN n = 1 THEN '' ELSE array_to_string(l[slot + 2:], '') END AS r
  FROM (SELECT *, pos % {RUN} AS slot, list(node) {run} AS l FROM {tag}{i}))""")
        out.append(f"""{tag}{i + 1} AS (
  SELECT k, pos // {RUN} AS pos, (n + {RUN - 1}) // {RUN} AS n, CASE WHEN n = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node
  FROM {tag}{i} GROUP BY k, pos // {RUN}, n)""")
    return ",\n".join(out)


def _oracle(levels: int = 5, upper: int = 2) -> str:
    """The manifest in SQL, for sources of up to 16^6 rows and up to 16^3 sources."""
    record = "sha256(" + " || ".join(_field_sql("{text}" if c == "text" else c) for c in FIELDS) + ")"
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    bit = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
        f" lambda d: CAST(ord(d) AS BIGINT))), lambda c, b: {bit}))"
    )
    steps, proof = [], []
    for tag, count in (("t", levels), ("u", upper)):
        for i in range(count + 1):
            s = f"{tag}s{i}"
            steps.append(f"JOIN {s} ON {s}.k = {'d.k' if tag == 't' else repr('')} AND {s}.pos = {'d.pos' if tag == 't' else 'o.pos'} // {RUN**i}")
            proof.append(f"{s}.l || {s}.r")
    # each fold mentions the one before twice, so they are steps of their own
    folds, last = [], "start"
    for tag, count in (("t", levels), ("u", upper)):
        for i in range(count + 1):
            s, name = f"{tag}s{i}", f"f_{tag}{i}"
            folds.append(f"CASE WHEN {s}_n = 1 THEN {last} ELSE sha256({s}_l || {last} || {s}_r) END AS {name}")
            last = name
    kept = ", ".join(f"{tag}s{i}.{c} AS {tag}s{i}_{c}" for tag, count in (("t", levels), ("u", upper)) for i in range(count + 1) for c in "nlr")
    return f"""WITH h AS (
  SELECT doc_id, coalesce('1' || source, '0') AS k, {record.format(text='text')} AS leaf, {record.format(text=lowered)} AS bent, {crc} % 5 = 0 AS marked FROM documents
), d AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n,
    CASE WHEN marked THEN bent ELSE leaf END AS start FROM h
), {_levels_sql('t', 'SELECT k, pos, n, leaf AS node FROM d', levels)},
o AS (SELECT k AS source, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n, node FROM t{levels + 1}),
{_levels_sql('u', "SELECT '' AS k, pos, n, node FROM o", upper)},
j AS (
  SELECT d.doc_id, d.leaf, d.start, o.node AS subroot, u{upper + 1}.node AS root, sha256({' || '.join(proof)}) AS proof_sha256, {kept}
  FROM d JOIN o ON o.source = d.k CROSS JOIN u{upper + 1} {' '.join(steps)}
), f AS (SELECT *, {', '.join(folds)} FROM j)
SELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, {last} = root AS verified FROM f"""


MERKLE_SQL = _oracle()
