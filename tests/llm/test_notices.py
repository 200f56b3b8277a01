"""Licence notices that follow each other: none lost, none of another family, in time that grows with the words."""

import random
import time

import pytest

from wareweave.llm import licenses

FOUR = {
    "MIT": "Released under the MIT License.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(9)
    plain = [" ".join(rng.choice(["the", "of", "river", "stone", "was", "market", "green", "and", "seen", "song"]) for _ in range(12)) for _ in range(600)]
    return licenses.fit(plain)


def laid_out(families, how):
    text = (" " if how in ("line", "wrapped") else "\n" if how == "block" else "\n\n").join(FOUR[f] for f in families)
    w = text.split(" ")
    return "\n".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5)) if how == "wrapped" else text


@pytest.mark.parametrize("how", ["block", "line", "wrapped", "apart"])
@pytest.mark.parametrize("n", [2, 8, 20, 32, 200, 2000])
def test_every_notice_is_found_with_its_family(model, how, n):
    rng = random.Random(n)
    for families in ([list(FOUR)[i % 4] for i in range(n)], [rng.choice(list(FOUR)) for _ in range(n)], ["MIT"] * n):
        found = licenses.notices(laid_out(families, how), model)
        assert [x[2] for x in found] == families and all(x[5] for x in found)


def test_any_templates_in_any_order(model):
    rng = random.Random(3)
    every = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    picked = [rng.choice(every) for _ in range(300)]
    found = licenses.notices("\n".join(t for _, t in picked), model)
    assert [x[2] for x in found if x[5]] == [f for f, _ in picked]
    assert [x[0] for x in found if x[5]] == list(range(300))


def brute_stretches(tokens, template):
    """All longest runs of consecutive words that a text shares with a template."""
    runs = set()
    for i in range(len(tokens)):
        for j in range(len(template)):
            k = 0
            while i + k < len(tokens) and j + k < len(template) and tokens[i + k] == template[j + k]:
                k += 1
            if k > 1 and not (i and j and tokens[i - 1] == template[j - 1]):
                runs.add((i, i + k))
    return runs


def test_whole_templates_are_stretches_by_brute_force():
    """Every place where a template stands whole is a stretch of share one."""
    rng = random.Random(4)
    every = [licenses.words(t) for ts in licenses.TEMPLATES.values() for t in ts]
    for _ in range(20):
        tokens = [w for _ in range(12) for w in (rng.choice(every) if rng.random() < 0.6 else [rng.choice(["of", "the", "license", "under", "x"]) for _ in range(4)])]
        got = {(a, b) for a, b, _, share, _ in licenses.aligned(tokens) if share == 1.0}
        want = {(a, b) for t in every for a, b in brute_stretches(tokens, t) if b - a == len(t)}
        assert want <= got


def test_words_put_in_or_left_out_stay_one_notice(model):
    text = "This program is free software: and you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License"
    found = [x for x in licenses.notices(text, model) if x[5]]
    assert [x[2] for x in found] == ["GPL"]


def test_time_grows_with_the_words(model):
    rng = random.Random(5)
    took = []
    for n in (5_000, 20_000):
        text = "\n".join(FOUR[rng.choice(list(FOUR))] for _ in range(n))
        began = time.perf_counter()
        assert len(licenses.notices(text, model)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1


def test_a_very_long_text_in_a_task(spark, model):
    rng = random.Random(6)
    families = [rng.choice(list(FOUR)) for _ in range(20_000)]
    df = spark.createDataFrame([(1, laid_out(families, "line")), (2, "word " * 200_000)], "doc_id long, text string")
    found = licenses.scan(df, model).groupBy("doc_id", "confirmed").count().collect()
    assert [tuple(r) for r in found] == [(1, True, 20_000)]


def test_content_is_the_notice_itself(model):
    text = "Intro words, then: Released under the\nMIT License. Licensed under CC BY-NC 4.0. The rest is other text"
    assert [x[6] for x in licenses.notices(text, model) if x[5]] == ["Released under the\nMIT License", "Licensed under CC BY-NC 4.0"]
