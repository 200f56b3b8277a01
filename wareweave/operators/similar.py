"""Similarity joins of sets and names: an inverted index over the rarest items, exact.

Two sets that must share ``need`` items share at least c of the first ``n - need + c`` in
any common order, so with the rarest items first each set is posted under the c-subsets of
its prefix. A larger c makes more keys, each of which fewer sets have: the number of pairs
that the keys 1, 2 and 3 would bring together is counted on a sixteenth of the keys, and
the cheapest is taken. Where the sizes of a pair together tell how much it must share, a
fourth way is counted too: a set is posted for each size of partner, so that nearly every
pair that meets is one. A pair is settled where it meets under its first common subset, so
no pair is emitted twice and none is gathered to drop repeats. Keys that stay hot are cut
into tiles (operators/tiles.py). Sets of more than ``LONG`` items are posted under single
items with ids only, and fetched for the pairs that meet.

All joins work on distinct texts: what repeats a text joins it by that text.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareweave.operators.tiles import TILE_ROWS, merged, small, tiled_join
from wareweave.session import checkpoint

#: Items of a set beyond which it is posted without them.
LONG = 64
#: Subset sizes that are tried as keys.
SUBSETS = (1, 2, 3)
#: The other choice: keys that hold both sizes, of up to MOST items as long as a prefix has no more than MANY subsets.
BY_SIZE, MOST, MANY = 0, 4, 35
#: One of so many keys of several items is counted to choose among them.
SAMPLED = 16

Bound = Callable[[Column], Column]
Both = Callable[[int, int], int]


def ranked(sides: list[DataFrame]) -> list[DataFrame]:
    """Each side's text and size with its items as numbers, rarest first over all sides."""
    posts = [s.select("text", "size", F.explode("items").alias("item")) for s in sides]
    every = posts[0].select("item")
    for p in posts[1:]:
        every = every.unionByName(p.select("item"))
    counts = small(checkpoint(every.groupBy("item").agg(F.count(F.lit(1)).alias("n")).withColumn("number", F.monotonically_increasing_id())))
    entry = F.struct("n", "number")
    sort = lambda s: F.transform(F.array_sort(F.array_distinct(F.collect_list(s))), lambda x: x["number"])
    # written, not kept in memory: later stages have as many tasks as the size asks for
    return [checkpoint(p.join(counts, "item").groupBy("text", "size").agg(sort(entry).alias("items"))) for p in posts]


def _subsets(items: Column, c: int, *chosen: Column) -> Column:
    """Hashes of all c-subsets of an array, in order; the array's first items first."""
    if c == 1:
        return F.transform(items, lambda x: F.xxhash64(*chosen, x))
    rest = lambda i: F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0)))
    return F.flatten(F.transform(items, lambda x, i: _subsets(rest(i), c - 1, *chosen, x)))


def _prefix(need: Bound, c: int) -> Column:
    """Items that are posted for keys of c: those of which a partner must share c."""
    return F.slice("items", 1, F.greatest(F.size("items") - F.greatest(need(F.col("size")), F.lit(c)) + c, F.lit(0)).cast("int"))


def postings(side: DataFrame, need: Bound, reach: Bound, most: int) -> DataFrame:
    """(text, size, items, kind, key) of the sets; kind c holds the pairs whose longer text needs c or more."""
    kind = lambda size: F.least(F.lit(most), need(size))
    short = side.filter(F.size("items") <= LONG)
    out = None
    for c in range(1, most + 1):
        mine = short.filter((kind(F.col("size")) <= c) & (kind(reach(F.col("size"))) >= c))
        rows = mine.withColumn("kind", F.lit(c)).withColumn("key", F.explode(_subsets(_prefix(need, c), c)))
        out = rows if out is None else out.unionByName(rows)
    return out


def _subsets_of(n: int, m: int, need: int) -> tuple[int, range]:
    """Items of a key of sets of n and m that share need, and their prefix: as many as keep the larger prefix's subsets few."""
    c = max(c for c in range(1, min(MOST, need) + 1) if c == 1 or math.comb(max(n, m) - need + c, c) <= MANY)
    return c, range(n - need + c)


def sized_postings(side: DataFrame, sizes: list[int], others: list[int], both: Both, left: bool) -> DataFrame:
    """(text, size, items, kind, least, chosen, key) of the sets for partners of each other size; a kind is a pair of sizes.

    The subsets of a prefix depend on the two sizes only: their places are a table, of no more than LONG sizes of either side.
    """
    places = []
    for n in sizes:
        for m in others:
            if (need := both(n, m)) <= min(n, m):
                c, prefix = _subsets_of(n, m, need)
                kind = n * (LONG + 1) + m if left else m * (LONG + 1) + n
                places += [(n, kind, need, c, list(at)) for at in itertools.combinations(prefix, c)]
    table = side.sparkSession.createDataFrame(places, "size int, kind int, least int, chosen int, places array<int>")
    key = F.xxhash64(F.transform("places", lambda i: F.get("items", i)))
    return side.filter(F.size("items") <= LONG).join(F.broadcast(table), "size").select("text", "size", "items", "kind", "least", "chosen", key.alias("key"))


def _by_size(a: DataFrame, b: DataFrame, both: Both) -> tuple[DataFrame, DataFrame]:
    """Both sides' postings by the sizes that the two have."""
    mine, theirs = ([r["size"] for r in s.filter(F.size("items") <= LONG).select("size").distinct().collect()] for s in (a, b))
    return sized_postings(a, mine, theirs, both, True), sized_postings(b, theirs, mine, both, False)


def cheapest(a: DataFrame, b: DataFrame, need: Bound, reach: Bound, sized: tuple[DataFrame, DataFrame] | None = None) -> int:
    """The subset size, or BY_SIZE, whose keys make the fewest pairs and postings, counted on some keys.

    It decides the work only: any choice gives the same pairs.
    """
    choices = {most: (postings(a, need, reach, most), postings(b, need, reach, most)) for most in SUBSETS} | ({BY_SIZE: sized} if sized else {})
    counts = None
    for most, sides in choices.items():
        for side, mark in zip(sides, (1, 0), strict=True):
            items = F.col("chosen" if most == BY_SIZE else "kind")
            # single items are few and may be common: all of them are counted
            weight = F.when(items == 1, 1).when(F.pmod("key", F.lit(SAMPLED)) == 0, SAMPLED)
            rows = side.select(F.lit(most).alias("most"), "kind", "key", F.lit(mark).alias("left"), weight.alias("weight")).filter("weight > 0")
            counts = rows if counts is None else counts.unionByName(rows)
    each = counts.groupBy("most", "kind", "key").agg(F.sum("left").alias("na"), F.sum(1 - F.col("left")).alias("nb"), F.first("weight").alias("weight"))
    work = F.sum(F.col("weight") * (F.col("na").cast("double") * F.col("nb") + 4 * (F.col("na") + F.col("nb"))))
    found = {r["most"]: r["work"] for r in each.groupBy("most").agg(work.alias("work")).collect()}
    return min(choices, key=lambda c: found.get(c, 0.0))


def overlapping(
    a: DataFrame, b: DataFrame, need: Bound, reach: Bound, most: int | None = None, rows: int = TILE_ROWS, self_join: bool = False, both: Both | None = None
) -> DataFrame:
    """(a, b, size_a, size_b, shared): pairs of texts that share at least need(longer size) items.

    Sides: text, size, items (distinct). need is the least number of items that a text
    shares with any partner that is no longer, at least 1 and growing with the size;
    reach is the size of the longest partner of a text. both, if given, is the least number
    that a pair of two sizes shares. With self_join, a < b only.
    """
    a, b = ranked([a, b]) if not self_join else [ranked([a])[0]] * 2
    sized = _by_size(a, b, both) if both and not most else None
    most = cheapest(a, b, need, reach, sized) if most is None else most
    posts = sized if most == BY_SIZE else (postings(a, need, reach, most), postings(b, need, reach, most))
    side = lambda s, x: s.withColumnsRenamed({"text": x, "size": f"size_{x}", "items": f"items_{x}"})
    met = tiled_join(side(posts[0], "a"), side(posts[1], "b").drop("least", "chosen"), ["kind", "key"], [F.col("a")], [F.col("b")], rows)
    if self_join:
        met = met.filter("a < b")
    longer = F.greatest("size_a", "size_b")
    if most == BY_SIZE:
        least, key = F.col("least"), F.xxhash64(F.slice("common", 1, F.col("chosen")))
    else:
        met = met.filter((longer <= reach(F.least("size_a", "size_b"))) & (F.col("kind") == F.least(F.lit(most), need(longer))))
        least, key = need(longer), F.xxhash64(F.get("common", F.lit(0)))
        for c in range(2, most + 1):
            key = F.when(F.col("kind") == c, F.xxhash64(*[F.get("common", F.lit(i)) for i in range(c)])).otherwise(key)
    # exploded, so that a pair's common items are computed once; the first of a pair that shares enough lie in both prefixes
    met = met.withColumn("common", F.explode(F.array(F.array_intersect("items_a", "items_b"))))
    found = met.filter((F.size("common") >= least) & (F.col("key") == key)).select("a", "b", "size_a", "size_b", F.size("common").alias("shared"))
    return found.unionByName(_long(a, b, need, reach, rows, self_join).filter(F.col("shared") >= need(longer)))


def _long(a: DataFrame, b: DataFrame, need: Bound, reach: Bound, rows: int, self_join: bool) -> DataFrame:
    """The same for pairs of which one has more than LONG items: ids meet, items are fetched."""
    least = {}
    for x, s in (("a", a), ("b", b)):
        least[x] = s.filter(F.size("items") > LONG).agg(F.min("size")).first()[0]
    if all(v is None for v in least.values()):
        return a.select(F.col("text").alias("a"), F.col("text").alias("b"), F.col("size").alias("size_a"), F.col("size").alias("size_b"), F.lit(0).alias("shared")).limit(0)
    floor = min(v for v in least.values() if v is not None)
    post = lambda s, x: s.filter(reach(F.col("size")) >= floor).select(
        F.col("text").alias(x), F.col("size").alias(f"size_{x}"), (F.size("items") > LONG).alias(f"long_{x}"), F.explode(_prefix(need, 1)).alias("key")
    )
    met = tiled_join(post(a, "a"), post(b, "b"), ["key"], [F.col("a")], [F.col("b")], rows).filter("long_a OR long_b")
    if self_join:
        met = met.filter("a < b")
    met = met.filter(F.greatest("size_a", "size_b") <= reach(F.least("size_a", "size_b"))).select("a", "b", "size_a", "size_b").distinct()
    met = merged(merged(met).join(a.select(F.col("text").alias("a"), F.col("items").alias("ia")), "a")).join(b.select(F.col("text").alias("b"), F.col("items").alias("ib")), "b")
    return met.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("ia", "ib")).alias("shared"))


def token_sets(names: DataFrame, name: str) -> DataFrame:
    """Distinct texts with their distinct lower-cased tokens; texts without tokens have no partners."""
    one = names.select(F.col(name).alias("text")).dropna().distinct()
    items = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    return one.withColumn("items", items).withColumn("size", F.size("items")).filter("size > 0")


def _ceil(x: Column) -> Column:
    """Rounded up, without what floating point adds to a whole number."""
    return F.ceil(x - 1e-9).cast("int")


def _floor(x: Column) -> Column:
    return F.floor(x + 1e-9).cast("int")


def jaccard_pairs(a: DataFrame, b: DataFrame | None, least: float, rows: int = TILE_ROWS, most: int | None = None) -> DataFrame:
    """(a, b, similarity) of distinct texts (token_sets) whose token sets are that alike; b None: a < b of one table.

    Sets of n and m tokens, m the larger, share at least least * m, and least / (1 + least) of n + m.
    """
    need, reach = lambda m: _ceil(m * least), lambda s: _floor(s / least)
    both = lambda n, m: math.ceil((n + m) * (least / (1 + least)) - 1e-9)
    met = overlapping(a, a if b is None else b, need, reach, most, rows, b is None, None if b is None else both)
    similarity = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    return met.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= least)


def name_search(queries: DataFrame, name: str, candidates: DataFrame, title: str, k: int = 5, least: float = 0.5, rows: int = TILE_ROWS) -> DataFrame:
    """The k titles most like each distinct name: name, title, similarity, rank.

    Ties go by title. A name without a title that is ``least`` alike has no row; nulls and
    blanks have none. The names' and titles' own rows join by the text.
    """
    found = jaccard_pairs(token_sets(queries, name), token_sets(candidates, title), least, rows)
    order = Window.partitionBy("name").orderBy(F.desc("similarity"), "title")
    return found.select(F.col("a").alias("name"), F.col("b").alias("title"), "similarity").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def grams(names: DataFrame, name: str, q: int) -> DataFrame:
    """Distinct texts with their q-grams, the repeats of a gram numbered, and their length."""
    one = names.select(F.col(name).alias("text")).dropna().distinct().withColumn("size", F.char_length("text"))
    at = F.sequence(F.lit(1), F.greatest(F.col("size") - q + 1, F.lit(1)))
    cut = one.select("text", "size", F.posexplode(F.transform(at, lambda i: F.substr(F.col("text"), i, F.lit(q)))).alias("at", "gram"))
    number = F.row_number().over(Window.partitionBy("text", "gram").orderBy("at"))
    numbered = cut.withColumn("item", F.concat(F.col("gram"), F.lit("\0"), number.cast("string")))
    return numbered.groupBy("text", "size").agg(F.collect_list("item").alias("items"))


#: Numbered characters that have a bit each, the commonest; a text's others are counted.
BITS = 128
#: Texts of either side that a task compares, and those of one side that it compares at a time.
BLOCK, STRIPE, CHUNK = 16_384, 64, 8_192
#: Characters up to which a text is one machine word of the longest common subsequence.
WORD = 64


def _masked(side: DataFrame, bits: DataFrame) -> DataFrame:
    """(text, size, m0, m1, others): numbered characters as bits, and the number of those without one."""
    items = side.select("text", "size", F.explode("items").alias("item")).join(F.broadcast(bits), "item", "left")  # BITS rows
    word = lambda w: F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0).cast("long")).alias(f"m{w}")
    return items.groupBy("text", "size").agg(word(0), word(1), F.count_if(F.col("word").isNull()).alias("others"))


def _common(words: np.ndarray, codes: np.ndarray, row: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Longest common subsequences of pairs: words[row, c] has a bit for each place of c, codes[other] are the partners' characters."""
    free = np.full(len(row), np.iinfo(np.uint64).max)
    flat, base = words.ravel(), row * words.shape[1]
    for step in codes[other].T:
        hit = flat[base + step] & free
        free = (free + hit) | (free - hit)
    return WORD - np.bitwise_count(free).astype(np.int64)


def _long_common(x: str, y: str) -> int:
    """The same for one pair of texts of any length, each row one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    free = full = (1 << len(x)) - 1
    for c in y:
        hit = free & at.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(x) - free.bit_count()


def _block_pairs(left: pa.Table, right: pa.Table, least: float) -> Iterator[pa.Table]:
    """(a, b, ratio) of two blocks: numbered characters bound the common subsequence, which is found for survivors."""

    def columns(t: pa.Table):
        t = t.sort_by("size").combine_chunks()
        get = lambda c: np.asarray(t.column(c))
        return t.column("text").to_pylist(), get("size").astype(np.int64), [get(m).view(np.uint64) for m in ("m0", "m1")], get("others").astype(np.int64)

    if not left.num_rows or not right.num_rows:
        return
    (ta, na, ma, oa), (tb, nb, mb, ob) = columns(left), columns(right)
    code: dict[str, int] = {}
    spelled = [[code.setdefault(c, len(code) + 1) for c in t] for t in tb]
    edges = [0, *(np.flatnonzero(na[1:] != na[:-1]) + 1).tolist(), len(na)]
    stripes = [(i, min(i + STRIPE, hi)) for lo, hi in zip(edges, edges[1:], strict=False) for i in range(lo, hi, STRIPE)]
    near = least / (2 - least)
    for b0 in range(0, len(tb), CHUNK):
        b1 = min(b0 + CHUNK, len(tb))
        wide = min(int(nb[b1 - 1]), int(WORD / near) + 1)  # longer texts have no partner of one word
        codes = None
        for a0, a1 in stripes:
            n = int(na[a0])
            # partners' lengths, with room for floating point
            j0, j1 = b0 + np.searchsorted(nb[b0:b1], n * near - 1e-6), b0 + np.searchsorted(nb[b0:b1], n / near + 1e-6, "right")
            if j0 >= j1:
                continue
            met = np.bitwise_count(ma[0][a0:a1, None] & mb[0][None, j0:j1]) + np.bitwise_count(ma[1][a0:a1, None] & mb[1][None, j0:j1])
            need = np.ceil((n + nb[j0:j1]) * least / 2 - 1e-6).astype(np.int64)
            if oa[a0:a1].any() and ob[j0:j1].any():
                met = met + np.minimum(oa[a0:a1, None], ob[None, j0:j1])
            else:
                need = np.minimum(need, 255).astype(np.uint8)  # of BITS common ones at most
            i, j = np.nonzero(met >= need)
            if not len(i):
                continue
            if n <= WORD:
                if codes is None:
                    codes = np.zeros((b1 - b0, wide), np.int32)
                    for k in range(b0, b0 + int(np.searchsorted(nb[b0:b1], wide, "right"))):
                        codes[k - b0, : len(spelled[k])] = spelled[k]
                words = np.zeros((a1 - a0, len(code) + 1), np.uint64)
                for k in range(a0, a1):
                    for at, c in enumerate(ta[k]):
                        if c in code:
                            words[k - a0, code[c]] |= np.uint64(1 << at)
                cells = max(1, 4_000_000 // wide)
                common = np.concatenate([_common(words, codes, i[k : k + cells], j[k : k + cells] + (j0 - b0)) for k in range(0, len(i), cells)])
            else:
                common = np.array([_long_common(ta[a0 + x], tb[j0 + y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
            ratio = 2 * common / (n + nb[j0 + j])
            hit = np.flatnonzero(ratio >= least - 1e-12)
            if len(hit):
                yield pa.table({"a": [ta[a0 + x] for x in i[hit]], "b": [tb[j0 + y] for y in j[hit]], "ratio": ratio[hit]})


def edit_pairs(a: DataFrame, name_a: str, b: DataFrame, name_b: str, least: float, rows: int = BLOCK) -> DataFrame:
    """(a, b, ratio): distinct texts whose edit ratio, 2 * LCS / both lengths, is that high.

    Texts of n and m characters with a ratio of at least t share t (n + m) / 2 characters,
    repeats counted, and the shorter has t / (2 - t) of the longer's length. Names are made
    of few words, so most share any few pieces and no key parts them: every two blocks of
    ``rows`` distinct texts meet in a task, which compares the texts' numbered characters
    as two machine words and finds the longest common subsequence for the survivors alone.
    The pairs compared grow with the product of the distinct texts, copies cost nothing;
    a task's memory does not grow.
    """
    if not 0 < least <= 1:
        raise ValueError("least must lie above 0 and be at most 1")
    one, two = (checkpoint(grams(s, n, 1).filter("size > 0")) for s, n in ((a, name_a), (b, name_b)))
    items = one.select(F.explode("items").alias("item")).unionByName(two.select(F.explode("items").alias("item")))
    common = [r["item"] for r in items.groupBy("item").count().orderBy(F.desc("count"), "item").limit(BITS).collect()]
    bit = lambda i: (1 << i) - (1 << 64 if i == 63 else 0)
    bits = a.sparkSession.createDataFrame([(x, i // 64, bit(i % 64)) for i, x in enumerate(common)], "item string, word int, bit long")
    parts = [max(1, -(-side.count() // rows)) for side in (one, two)]

    def dealt(side: DataFrame, mine: int, theirs: int, first: bool) -> DataFrame:
        own = F.pmod(F.xxhash64("text"), F.lit(mine))
        copied = _masked(side, bits).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))))
        tile = F.col("own") * theirs + F.col("other") if first else F.col("other") * mine + F.col("own")
        return copied.select("text", "size", "m0", "m1", "others", tile.cast("long").alias("tile")).repartition(parts[0] * parts[1], "tile").groupBy("tile")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("ratio", pa.float64())])
        return pa.concat_tables([schema.empty_table(), *(t.cast(schema) for t in _block_pairs(left, right, least))])

    scored = dealt(one, *parts, True).cogroup(dealt(two, *parts[::-1], False)).applyInArrow(run, "a string, b string, ratio double")
    blank = lambda s, n, x: s.filter(F.col(n) == "").select(F.col(n).alias(x)).distinct()
    empty = blank(a, name_a, "a").join(blank(b, name_b, "b"), F.col("a") == F.col("b")).withColumn("ratio", F.lit(1.0))
    return scored.unionByName(empty)
