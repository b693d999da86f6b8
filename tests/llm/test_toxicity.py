import collections
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framesift.llm import toxicity


def maximal(scores, at=0):
    """All maximal scoring segments by their definition: the best one, then those left and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-9:
        return []
    i, j = -best[2], -best[2] - best[1]
    return maximal(scores[:i], at) + [(at + i, at + j - 1, best[0])] + maximal(scores[j:], at + j)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(0.01, 5)), max_size=14), st.floats(0.1, 2))
def test_segments_are_the_maximal_ones(tokens, drift):
    # distinct in the last digits, so that no two sums are equal
    tokens = [None if t is None else t + random.Random(i).random() * 1e-4 for i, t in enumerate(tokens)]
    found = toxicity.segments([(i, t) for i, t in enumerate(tokens) if t is not None], drift)
    want = maximal([-drift if t is None else t for t in tokens])
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert [x[2] for x in found] == pytest.approx([x[2] for x in want])


def test_scan_is_linear():
    found = toxicity.segments(((2 * i, 1.0 + (i % 7) / 10) for i in range(300_000)), 1.2)
    assert len(found) >= 1 and sum(last - first + 1 for first, last, _ in found) <= 600_000


def test_words_of_long_texts_are_not_cut():
    text = "Ärger " * 300_000 + "x" * 2_000_000 + " Σίσυφος"
    words = [w for part in toxicity.words_of(text) for w in part]
    assert words == re.findall(r"[^\W\d_]+", text.lower()) and list(toxicity.words_of(None)) == []


BAD = ["grumf", "zilk", "vortap"]


def corpus(n, seed, offset=0):
    rng = random.Random(seed)
    usual = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ana", "elo", "ipi", "oru", "uta", "ay", "esk", "ond")]
    rows = []
    for i in range(n):
        words, toxic = rng.choices(usual, k=rng.randint(20, 200)), i % 8 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.sample(BAD, 2)
        rows.append((offset + i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.train(docs, labels)


def test_held_out_accuracy_and_passages(spark, trained):
    model = trained[3]
    rows = corpus(300, 2, 10_000)
    docs = spark.createDataFrame([(i, t, "z", 1.0, 3) for i, t, _ in rows], "doc_id long, text string, label string, score double, n int")
    found = {r["doc_id"]: r["toxicity"] for r in toxicity.find_toxic(docs, model).collect()}
    for i, text, toxic in rows:
        assert 0 <= found[i]["score"] <= 1 and (found[i]["score"] >= 0.5) == bool(toxic)
        words = re.findall(r"[^\W\d_]+", text.lower())
        marked = {words[k] for p in found[i]["passages"] for k in range(p["first"], p["last"] + 1)}
        assert marked & set(BAD) if toxic else not marked & set(BAD)


def test_word_scores_by_the_formula(spark, trained):
    rows, docs, labels, model = trained
    drawn = {r["id"] for r in docs.select(F.col("doc_id").cast("string").alias("id")).where(F.pmod(F.xxhash64("id"), F.lit(toxicity.CALIBRATED)) == 0).collect()}
    seen = {0: collections.Counter(), 1: collections.Counter()}
    for i, text, y in rows:
        if i != 3 and str(i) not in drawn:
            seen[y].update(set(re.findall(r"[^\W\d_]+", text.lower())))
    if "3" not in drawn:
        seen[rows[3][2]].update(set(re.findall(r"[^\W\d_]+", rows[3][1].lower())))  # its null label doesn't count beside the other
    n = {y: sum(seen[y].values()) for y in seen}
    V = len(set(seen[0]) | set(seen[1]))

    def score(w):
        logit = {}
        for y in (0, 1):
            a = toxicity.PRIOR * n[y] / (n[0] + n[1])
            logit[y] = math.log((seen[y][w] + a) / (n[y] + a * V - seen[y][w] - a))
        return logit[1] - logit[0] - toxicity.DRIFT

    want = {w: score(w) for w in set(seen[0]) | set(seen[1]) if score(w) > 0}
    assert set(want) >= set(BAD) and model.scores == pytest.approx(want)


def test_statistics():
    values, tokens = np.array([0.5, 2.0, -1.0]), np.array([30.0, 4.0, 900.0])
    rate = toxicity.solve_rate(tokens, values)
    assert float((tokens / tokens.sum()) @ np.exp(rate * values)) == pytest.approx(1)
    x = np.random.default_rng(1).normal(size=(400, 2))
    y = (np.random.default_rng(2).random(400) < 1 / (1 + np.exp(-(x @ [1.5, -2.0] + 0.5)))).astype(float)
    assert toxicity.fit_logistic(x, y, ridge=1e-9) == pytest.approx([0.5, 1.5, -2.0], abs=0.6)


SCHEMA = "doc_id long, text string, label string, score double, toxic int, n int, id string"


def test_awkward_texts_and_tables(spark, trained):
    model = trained[3]
    texts = [None, "", "123 ...", "grumf zilk " * 50_000, "GRUMF ZILK", "grumf zilk", "bana " * 200_000]
    docs = spark.createDataFrame([(i if i else None, t, "x", 0.5, 1, 2, "y") for i, t in enumerate(texts)], SCHEMA)
    found = [r["toxicity"] for r in toxicity.find_toxic(docs, model).orderBy(F.col("doc_id").asc_nulls_first()).collect()]
    scores = [r["score"] for r in found]
    assert scores[0] == scores[1] == scores[2] < 0.5 and scores[3] > 0.5 and scores[4] == scores[5] > 0.5 and scores[6] < 0.5
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.find_toxic(empty, model).collect() == []
    nothing = toxicity.train(empty, empty)
    assert {r["toxicity"]["score"] for r in toxicity.find_toxic(docs, nothing).collect()} == {0.0}
    one_class = toxicity.train(docs, docs.withColumn("toxic", F.lit(0)))
    assert {r["toxicity"]["score"] for r in toxicity.find_toxic(docs, one_class).collect()} == {0.0}
