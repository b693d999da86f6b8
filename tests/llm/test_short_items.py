"""Every placement of up to three substitutions in short benchmark items against brute force (op9)."""

import math
from itertools import combinations

import pytest

from framesift.llm import decontam


@pytest.mark.parametrize("bound", [decontam.BROADCAST_HASHES, 0])
def test_short_items_with_substitutions(spark, make, bound):
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in (*range(5, 19), 20, 31)}
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    texts, want = [], {}
    for n, own in items.items():
        for k in range(4):
            for places in combinations(range(n), k):
                if n > 15 and k == 3 and sum(places) % 7:
                    continue
                changed = [f"other{i}" if i in places else w for i, w in enumerate(own)]
                if n - k >= math.ceil(0.8 * n):
                    want[len(texts), n] = n - k
                texts.append(" ".join(["before", "it", *changed, "after", "it"]))
        for cut in (own[1:], own[:-1]):  # the text begins or ends inside the item
            want[len(texts), n] = n - 1
            texts.append(" ".join(cut))
    for n in (20, 31):  # spread over the whole item, no long run of words
        want[len(texts), n] = math.ceil(0.8 * n)
        changed = [f"other{i}" if i % 5 == 4 and i < n - n % 5 else w for i, w in enumerate(items[n])]
        want[len(texts), n] = sum(a == b for a, b in zip(changed, items[n], strict=True))
        texts.append(" ".join(changed))
    found = {(r["doc"], r["item"]): r for r in decontam.find_overlaps(make(texts), benchmark, broadcast_hashes=bound, broadcast_laid=bound, broadcast_words=bound).collect()}
    assert set(found) == set(want)
    for (doc, n), r in found.items():
        assert min(13, math.ceil(0.8 * n)) <= r["n_matched"] <= want[doc, n]
        assert r["n_matched"] <= r["n_words"] <= r["item_words"] == n


def test_items_of_few_words_need_all_of_them(spark, make):
    benchmark = spark.createDataFrame([(1, "Solo"), (2, "two words"), (3, "three of them"), (4, "a set of four"), (5, "..."), (5, "two words"), (6, None)], "item_id long, text string")
    texts = ["here is SOLO, alone", "two other words", "so: two words!", "three of", "three of them", "a set of five", "it is a set of four", "", None]
    found = {(r["doc"], r["item"], r["start"], r["n_words"]) for r in decontam.find_overlaps(make(texts), benchmark).collect()}
    assert found == {(0, 1, 2, 1), (2, 2, 1, 2), (2, 5, 1, 2), (4, 3, 0, 3), (6, 4, 2, 4)}
    assert {r["item"] for r in decontam.find_overlaps(make(texts), benchmark, min_item=3).collect()} == {3, 4}


def test_a_long_item_sends_no_words_with_its_seeds(spark, make):
    words = [f"w{i}" for i in range(4000)]
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    _, seeds = decontam._seeds(benchmark.select(decontam.F.lit(7).cast("long").alias("key"), decontam.words_of(decontam.F.col("text")).alias("words"), decontam.F.lit(4000).alias("n_item")), decontam.MASKS)
    assert set(seeds.columns) == {"hash", "key", "item_at", "n_item"} and seeds.count() * 28 < 1_000_000
    text = "x " * 5000 + " ".join(words[:3900]) + " y"
    found = decontam.find_overlaps(make([text, text, "z " * 20000]), benchmark).collect()
    assert [(r["doc"], r["start"], r["n_matched"]) for r in sorted(found)] == [(0, 5000, 3900), (1, 5000, 3900)]
