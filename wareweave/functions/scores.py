"""Similarity scores as Column functions; a scorer takes columns and returns a column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareweave.functions.text import SPEC_PATTERNS, normalize_name, spec_hits
from wareweave.session import checkpoint


@F.pandas_udf(T.DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - insertions and deletions / total length, by the longest common subsequence.

    Spark's levenshtein() counts substitutions, so it can't give this ratio. Bit-parallel:
    each row of the table is one integer.
    """

    def ratio(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if not x and not y:
            return 1.0
        at: dict[str, int] = {}
        for i, c in enumerate(x):
            at[c] = at.get(c, 0) | 1 << i
        free = full = (1 << len(x)) - 1
        for c in y:
            hit = free & at.get(c, 0)
            free = ((free + hit) | (free - hit)) & full
        common = len(x) - free.bit_count()
        return 2 * common / (len(x) + len(y))

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=np.float64)


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two names' distinct tokens, lower-cased."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def tfidf_cosine(a: Column, b: Column) -> Column:
    """Cosine of the two texts' term vectors weighed on just these two texts.

    Terms are words of two or more characters and their bigrams; a term of both texts
    weighs 1, a term of one text 1 + ln 1.5. Texts without terms count as 0.5.
    """

    def grams(c: Column) -> Column:
        w = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), 0)
        pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
        return F.concat(w, pairs)

    x, y = grams(a), grams(b)
    count = lambda terms, t: F.size(F.filter(terms, lambda u: u == t)).cast("double")
    one = float(1 + np.log(1.5))

    def norm(mine: Column, theirs: Column) -> Column:
        part = lambda s, t: s + F.pow(count(mine, t) * F.when(F.array_contains(theirs, t), 1.0).otherwise(one), 2)
        return F.aggregate(F.array_sort(F.array_distinct(mine)), F.lit(0.0), part)

    dot = F.aggregate(F.array_sort(F.array_intersect(x, y)), F.lit(0.0), lambda s, t: s + count(x, t) * count(y, t))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 0.5).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(
        dot / F.sqrt(norm(x, y) * norm(y, x))
    )


def spec_similarity(a: Column, b: Column) -> Column:
    """1 if some kind of specification agrees on both sides, else 0.5."""
    agree = [F.arrays_overlap(spec_hits(a, kind), spec_hits(b, kind)) for kind in SPEC_PATTERNS]
    hit = agree[0]
    for x in agree[1:]:
        hit = hit | x
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.5)


def text_score(edit: Column, tfidf: Column, token: Column, spec: Column, vector: Column | None = None) -> Column:
    """Weighed text score; without vectors only edit and tf-idf count, and no specification."""
    if vector is None:
        return edit * 0.3 + tfidf * 0.7
    score = edit * 0.15 + tfidf * 0.15 + token * 0.10 + vector * 0.60
    return F.least(F.when(spec > 0.8, score * (1 + (spec - 0.8) * 0.5)).otherwise(score), F.lit(1.0))


def score_names(pairs: DataFrame, a: str, b: str, edit, score: str, clean=None) -> DataFrame:
    """Pairs of names with their text score without vectors; ``clean`` is applied to the names first.

    0 where either name has nothing left when normalised; null names score 0. ``edit`` makes the edit
    ratio's column of two columns. The normal forms and the score are checkpointed: the
    score mentions each form many times, and whoever filters by the score mentions that
    again, and Catalyst would put the whole expressions in those places.
    """
    clean = clean or (lambda c: c)
    ready = pairs.withColumns({"__ww_a": clean(F.col(a)), "__ww_b": clean(F.col(b))})
    ready = ready.withColumns({f"__ww_n{x}": F.coalesce(normalize_name(F.col(f"__ww_{x}")), F.lit("")) for x in "ab"})
    ready = checkpoint(ready)
    na, nb = F.col("__ww_na"), F.col("__ww_nb")
    value = text_score(edit(na, nb), tfidf_cosine(na, nb), token_jaccard(F.col("__ww_a"), F.col("__ww_b")), spec_similarity(F.col("__ww_a"), F.col("__ww_b")))
    scored = ready.withColumn(score, F.when((na == "") | (nb == ""), 0.0).otherwise(value))
    return checkpoint(scored.drop("__ww_a", "__ww_b", "__ww_na", "__ww_nb"))


def adaptive_weights(text: Column, image: Column, has_images: Column, base=(0.7, 0.3), floors=(0.3, 0.2)) -> Column:
    """struct(w_text, w_image): base weights moved by the scores, floored, summing to 1."""
    first_text, first_image = text > 0.9, image > 0.9
    low_text = text < 0.3
    t = F.when(first_text, base[0] * 1.2).when(low_text, base[0] * 0.8).otherwise(F.lit(base[0]))
    i = F.when(first_text, base[1] * 0.8).when(low_text, base[1] * 1.2).otherwise(F.lit(base[1]))
    t = F.when(first_image, t * 0.8).when(image < 0.3, t * 1.2).otherwise(t)
    i = F.when(first_image, i * 1.2).when(image < 0.3, i * 0.8).otherwise(i)
    t, i = F.greatest(t, F.lit(floors[0])), F.greatest(i, F.lit(floors[1]))
    return F.struct(
        F.when(has_images, t / (t + i)).otherwise(1.0).alias("w_text"),
        F.when(has_images, i / (t + i)).otherwise(0.0).alias("w_image"),
    )


def image_score(hash_: Column, exact: Column, parts: list[Column], last: Column) -> Column:
    """Fusion of image similarity columns: exact and near-identical hashes settle it."""
    weights = (0.15, 0.25, 0.10, 0.30, 0.10, 0.10)
    mean = sum(parts[1:], parts[0]) / len(parts)
    terms = [p * w for p, w in zip(parts, weights[:5], strict=True)]
    fused = sum(terms[1:], terms[0]) + F.when(mean < 0.3, 0.0).otherwise(last) * weights[5]
    return F.when(exact, 1.0).when(hash_ > 0.95, 0.95 + (hash_ - 0.95) * 0.5).otherwise(fused)


def histogram_similarity(a: Column, b: Column) -> Column:
    """Mean closeness of two arrays of shares."""
    close = F.zip_with(a, b, lambda x, y: 1 - F.least(F.abs(x - y), F.lit(1.0)))
    return F.aggregate(close, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sign_hash(vector: Column, size: int = 64) -> Column:
    """64-bit hash of a vector: bit i is set where component i is positive."""
    bit = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0))
    out = bit(0).cast("long")
    for i in range(1, size):
        out = out.bitwiseOR(bit(i).cast("long"))
    return out
