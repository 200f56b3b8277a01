"""The Merkle manifest, the integer clusters and the main text against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from wareweave.llm import clustering, main_text, merkle, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle", "op12_clustering"])
def test_matches_oracle(spark, name):
    same(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name])


# op11: Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_tree(nodes):
    """The root, and each node's list of (left, right) on the way there."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run, slot = k // 16, k % 16
            mine = nodes[run * 16 : run * 16 + 16]
            proofs[i].append(("".join(mine[:slot]), "".join(mine[slot + 1 :])))
            at[i] = run
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], proofs


def brute_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in sources:
        mine = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[s] = (mine, *brute_tree([brute_leaf(r) for r in mine]))
    root, upper = brute_tree([trees[s][1] for s in sources])
    for s, up in zip(sources, upper, strict=True):
        mine, subroot, proofs = trees[s]
        for r, proof in zip(mine, proofs, strict=True):
            path = [*proof, *up]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            lowered = (r[4] or "").translate({c: c + 32 for c in range(65, 91)})
            node = brute_leaf((*r[:4], lowered)) if bad else brute_leaf(r)
            for left, right in path:
                node = h(left, node, right)
            out.append((r[0], brute_leaf(r), subroot, root, h(*[x for p in path for x in p]), node, node == root))
    return sorted(out, key=str)


def merkle_rows(spark, tmp_path, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string, node int, key string"
    folder = str(tmp_path / "in")
    spark.createDataFrame([(*r, 1, "x") for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, merkle.merkle_query(spark, folder).collect()), key=str)


def test_manifest_by_brute_force(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "big", "en", i % 7, rng.choice(["Aa", "b", "", "É A", None])) for i in range(277)]
    rows += [(1000 + i, f"s{i:02}", None, None, "One") for i in range(18)]
    rows += [(None, None, "en", 1, "No id"), (None, None, "en", 1, "No id"), (5, None, "-", 0, "x"), (5, None, "-", 0, "Y" * 200_000)]
    rows += [(2000, "", "en", 3, "empty source name"), (2001, "", "en", 3, "12:ab")]
    assert merkle_rows(spark, tmp_path, rows) == brute_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_manifest_of_one_source(spark, tmp_path, n):
    rows = [(i, "s", "en", 1, "Text") for i in range(n)]
    assert merkle_rows(spark, tmp_path, rows) == (brute_manifest(rows) if n else [])


def test_many_ranges_are_joined_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_STARTS", 0)
    rows = [(i * 37 % 1000, "s" if i % 3 else "t", "en", 1, f"T{i}") for i in range(300)]
    assert merkle_rows(spark, tmp_path, rows) == brute_manifest(rows)


def test_fields_do_not_run_into_each_other(spark):
    rows = [(1, "a", "b1:c", 1, "x"), (1, "a1:b", "c", 1, "x"), (1, "", None, 1, "-"), (1, None, "", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert docs.select(merkle.leaf(docs).alias("leaf")).distinct().count() == 4


# op12: integer clusters


def brute_clusters(vectors, clusters=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, h(f"3:{r[0]}"), r[1]))
    centroids = [list(v) for _, v in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            if mine := [v for c, (_, v) in zip(of, kept, strict=True) if c == k]:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = lambda k: sum(d for _, d, c in found if c == k)
    digest = [h(",".join(map(str, c))) for c in centroids]
    whole = sum(d for _, d, _ in found)
    return sorted([(i, c, d, inertia(c), whole, digest[c]) for i, d, c in found], key=str)


def cluster_rows(spark, tmp_path, vectors):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(i, v, 9) for i, v in vectors], "vec_id long, embedding array<float>, cluster int").write.parquet(f"{folder}/embeddings.parquet")
    return sorted(map(tuple, clustering.cluster_query(spark, folder).collect()), key=str)


def test_clusters_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(i % 5, 0.5, 64)]) for i in range(90)]
    vectors += [(100 + i, [float(i % 2)] * 64) for i in range(20)]  # equal vectors and ties
    vectors += [(7, vectors[7][1]), (7, [0.25] * 64), (None, [-0.5] * 64)]
    vectors += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 63 + [None]), (204, [1.0] * 63 + [math.nan]), (205, [1.0] * 63 + [-math.inf])]
    assert cluster_rows(spark, tmp_path, vectors) == brute_clusters(vectors)


@pytest.mark.parametrize("n", [0, 3])
def test_few_vectors(spark, tmp_path, n):
    vectors = [(i, [i / 3.0] * 64) for i in range(n)]
    assert cluster_rows(spark, tmp_path, [(i, [float(np.float32(x)) for x in v]) for i, v in vectors]) == brute_clusters([(i, [float(np.float32(x)) for x in v]) for i, v in vectors])


def test_filter_measures_few_and_misses_none():
    rng = np.random.default_rng(3)
    scale = np.r_[np.full(8, 3000), np.full(56, 30)]
    x = (rng.normal(0, 1, (4000, 64)) * scale @ np.linalg.qr(rng.normal(size=(64, 64)))[0]).astype(np.int64)
    ones = np.hstack([np.ones((len(x), 1)), x])
    mean, axes = clustering.principal_axes(ones.T @ ones)
    centroids = x[rng.choice(len(x), 8, replace=False)]
    cluster, distance, measured = clustering.nearest(x, *clustering.rotate(x.astype(float), mean, axes, 16), centroids, mean, axes)
    exact = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert measured < 1.1 * len(x)  # of 8 distances a vector


def test_largest_components_stay_exact():
    x = np.array([[clustering.LARGEST * 1024] * 64, [-clustering.LARGEST * 1024] * 64, [0] * 64], dtype=np.int64)
    mean, axes = np.zeros(64), np.eye(64)
    _, distance, _ = clustering.nearest(x, *clustering.rotate(x.astype(float), mean, axes, 16), x[:1], mean, axes)
    assert distance.tolist() == [0, 64 * (2 * clustering.LARGEST * 1024) ** 2, 64 * (clustering.LARGEST * 1024) ** 2]


# op13: main text


def test_pages_hold_whole_documents(spark):
    """Every page's text is a title and then a document, paragraph by paragraph."""
    flat = lambda t: "\n\n".join(x for x in (" ".join(p.split()) for p in (t or "").split("\n")) if x)
    docs = {flat(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = registry.queries()["op13_main_text"](spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r["text"].split("\n\n", 1)[1] in docs and r["n_chars"] == len(r["text"]) for r in found)


LONG = "<p>A sentence of the text, with marks. Another one follows it.</p>"
SAID = "A sentence of the text, with marks. Another one follows it."


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain &lt;text&gt; &amp; more&nbsp;&#x41;", "plain <text> & more A"),
        ("<article><h1>T</h1><p>a<br>b\n\t c<p><b>d<p>e</b> f</article>", "T\n\na b c\n\nd\n\ne f"),
        ("<nav>menu</nav><article><p>One.</p><div class='ad'>Buy, now.</div><p>Two.</p></article><footer>f</footer>", "One.\n\nTwo."),
        ("<article><header><h1>T</h1><p>By me</p></header><p>x</p><footer>tags</footer></article>", "T\n\nx"),
        ("<article><p>x</p><section id='comments'><article class='comment'><p>Nice, text. Really, long. " + "Yes. " * 50 + "</p></article></section></article>", "x"),
        ("<div class='page has-sidebar'><form><main><p>x</p><form><p>name</p><input></form></main></form><div id='sidebar'><p>y</p></div></div>", "x"),
        ("<article><p>x</p><p hidden>n</p><p style='display: none'>n</p><script>'</p>'</script><style>p{}</style><select><option>1<option>2</select></article>", "x"),
        ("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><th>k<th>v<tr><td>1<td>2</table></article>", "a\n\nb\n\nc\n\nk v\n\n1 2"),
        ("<article><p>x</p><ul><li><a href=1>Other story</a><li><a href=2>One more</a></ul></article>", "x"),
        ("<article><p>See <a href=1>the other text</a> for it.</p></article>", "See the other text for it."),
        ("<article><p>cut <b>here</b> and th", "cut here and th"),
        ("<article><p>cut</p", "cut"),
        ("<article><p>a <!-- never closed <p>b", "a"),
        ("<article><p title=it's>Don't</p><p title='a>b'>c</p></article>", "Don't\n\nc"),
        ("<article><p>a &amp</p><p>b &am</p><p>1 < 2 <3</p></article>", "a &\n\nb &am\n\n1 < 2 <3"),
        (f"<div><div><a href=1>Home</a> <a href=2>News</a></div><div><h2>Head</h2>{LONG * 4}<p>Short</p></div><div>Mail us</div></div>", "\n\n".join(["Head", *[SAID] * 4, "Short"])),
        (f"<form id=page class='search form'>{LONG * 3}</form>", "\n\n".join([SAID] * 3)),
    ],
)
def test_main_text(page, expected):
    assert main_text.main_text(page or "") == expected


def test_paths_score_by_text_and_marks_smoothed():
    paths = np.array([0, 1, 1, 2])
    score = main_text.path_scores(paths, np.array([5.0, 100.0, 300.0, 5.0]), np.array([0.0, 2.0, 4.0, 0.0]))
    length, mark = np.array([5, 200, 200, 5.0]), np.array([0, 3, 3, 0.0])
    padded = lambda x: [x[0], x[0], *x, x[-1], x[-1]]
    bell = lambda x: np.array([sum(w * padded(x)[i + k] for k, w in enumerate(main_text.BELL)) for i in range(4)])
    fused = np.sqrt(length * (1 + mark) * bell(length) * (1 + bell(mark)))
    assert np.allclose(score, [fused[0], fused[1:3].mean(), fused[1:3].mean(), fused[3]])


def test_pages_pass_other_columns_and_ties(spark):
    rows = [(1, "u", "<article><p>x</p></article>", "own", 7)] * 2 + [(None, None, None, None, None)]
    found = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, tag int"))
    assert sorted(map(tuple, found.select("page_id", "text", "n_chars", "tag").collect()), key=str) == [(1, "x", 1, 7)] * 2 + [(None, "", 0, None)]
    assert main_text.extract(spark.createDataFrame([], "html string")).count() == 0


@pytest.mark.parametrize("unit", ["<div>", "<p>x", "<ul><li><div>", "</b><b>x", "<a href='", "<table><tr><td>", "<li>", "<article class=comment><p>y", "&amp;", "<!--"])
def test_reading_is_linear(unit):
    """Deep, broken and very long pages are read in one pass."""
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        main_text.main_text(unit * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1


def test_a_very_long_page(spark):
    page = "<article>" + LONG * 100_000 + "</article>"
    found = main_text.extract(spark.createDataFrame([(page,)], "html string")).select(F.col("n_chars")).first()[0]
    assert found == 100_000 * (len(SAID) + 2) - 2
