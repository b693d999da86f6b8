import random
import re

import pytest
from pyspark.sql import functions as F

from framesift.operators import lookups, resample, sampling, scoring, selection


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[-1] if "== Initial Plan ==" in text else text


def pools(spark, path, sizes=(1, 3, 7, 40, 200)):
    rng = random.Random(2)
    rows = []
    for v, n in enumerate(sizes):
        for i in range(n):
            rows.append((v, 10 * i, i, n, *[round(rng.random(), 3) if v else 0.5 for _ in range(3)]))
    spark.createDataFrame(rows, "video long, frame_id long, pos long, n long, score_clip double, score_siglip2 double, score_blip double").write.parquet(path)
    return spark.read.parquet(path)


def test_eight_methods_equal_single_calls_in_one_scan(spark, tmp_path):
    scored = pools(spark, str(tmp_path / "p"))
    k = 8
    found = selection.select_methods(scored, k, t1=0.2, t2=0.05, power=2.0)
    single = {
        "uniform": selection.pick_uniform(scored, k),
        **{f"aks-{e}": selection.pick_recursive_segments(scored.withColumn("score", F.col(f"score_{e}")), k, t1=0.2, t2=0.05) for e in ("blip", "clip")},
        **{f"bolt-{e}": selection.pick_inverse_transform(scored.withColumn("score", F.col(f"score_{e}")), k, 2.0) for e in ("clip", "siglip2")},
        **{f"{e}-new": selection.pick_top(scored.withColumn("score", F.col(f"score_{e}")), k) for e in ("clip", "blip", "siglip2")},
    }
    assert set(single) == set(selection.METHODS)
    rows = {}
    for r in found.collect():
        rows.setdefault(r["method"], []).append((r["video"], r["ord"], r["frame_id"]))
    for name, want in single.items():
        assert sorted(rows[name]) == sorted((r["video"], r["ord"], r["frame_id"]) for r in want.collect()), name
    text = plan(found)
    assert len(re.findall("FileScan", text)) == 1 and len(re.findall("Exchange hashpartitioning", text)) == 1 and "Join" not in text
    with pytest.raises(ValueError):
        selection.select_methods(scored, k, {"x": ("none", "clip")})


def test_tree_rows_and_depths(spark, tmp_path):
    scored = pools(spark, str(tmp_path / "p")).withColumn("score", F.col("score_clip"))
    tree = selection.segment_tree(scored, 8, t1=0.2, t2=0.05)
    rows = [r.asDict() for r in tree.collect()]
    assert {r["video"] for r in rows} == {3, 4}  # smaller pools aren't segmented
    for r in rows:
        own = [x["score"] for x in scored.where(f"video = {r['video']}").orderBy("pos").collect()]
        low, high = min(own), max(own)
        part = [(x - low) / (high - low) for x in own][r["first"] : r["last"]]
        assert r["mean"] == pytest.approx(sum(part) / len(part), abs=1e-6)
        assert r["top"] == pytest.approx(sum(sorted(part, reverse=True)[:8]) / min(8, len(part)), abs=1e-6)
        children = [c for c in rows if c["video"] == r["video"] and (c["parent_first"], c["parent_last"]) == (r["first"], r["last"]) and c["depth"] == r["depth"] + 1]
        assert len(children) == (0 if r["done"] else 2)
        assert r["done"] or sorted((c["first"], c["last"]) for c in children) == [(r["first"], (r["first"] + r["last"]) // 2), ((r["first"] + r["last"]) // 2, r["last"])]
        assert not r["done"] or r["depth"] == 3 or r["last"] - r["first"] < 2 or (r["top"] - r["mean"] > 0.2 and r["deviation"] > 0.05)
    hist = {(r["video"], r["depth"]): r["n"] for r in selection.depth_histogram(tree).collect()}
    assert all(sum(2 ** -d * n for (v, d), n in hist.items() if v == video) == 1 for video in (3, 4))


def test_all_filters_in_one_scan(spark, tmp_path):
    rows = [(["a"], "en", "A", "a ", True, None, None), (["a"], "mcq", "A", "B", True, None, None), (None, "en", None, None, False, 2.0, 1.0), (None, None, None, None, False, 2.0, None), (["b"], None, "B", "B", True, None, None)]
    path = str(tmp_path / "s")
    spark.createDataFrame(rows, "options array<string>, task_type string, truth string, answer string, is_mcq boolean, truth_number double, number double").write.parquet(path)
    samples = spark.read.parquet(path)
    found = scoring.accuracies(samples)
    assert {r["wanted"]: (r["correct"], r["n_mcq"], r["n_numeric"], r["accuracy"]) for r in found.collect()} == {
        "all": (2, 3, 1, 62.5),
        "mcq": (2, 3, 0, round(200 / 3, 6)),
        "generation": (0, 0, 1, 0.0),
        "numeric": (0, 0, 1, 50.0),
        "en": (1, 1, 1, 100.0),
    }
    for wanted in ("all", "mcq", "numeric", "en"):  # equal to one call for each filter
        one = scoring.accuracy(scoring.tally(scoring.filter_tasks(samples, wanted), []), wanted).head()
        assert one["accuracy"] == found.where(F.col("wanted") == wanted).head()["accuracy"]
    text = plan(found)
    assert len(re.findall("FileScan", text)) == 1 and len(re.findall("Exchange", text)) == 1
    assert scoring.accuracies(samples.limit(0)).collect() == []


def test_summary_and_empty_selections(spark):
    rows = spark.createDataFrame([(1.0, 50.0, 0.5, 1, 0), (1.0, 100.0, 1.0, 1, 1), (2.0, 0.0, 0.0, None, None)], "strength double, same_frame_percent double, jaccard double, coverage_correct int, topk_correct int")
    assert sorted(tuple(r) for r in scoring.ablation_summary(rows, ["strength"]).collect()) == [(1.0, 2, 75.0, 0.75, 100.0, 50.0, 2, 1), (2.0, 1, 0.0, 0.0, 0.0, 0.0, 0, 0)]
    selected = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("b", 1, 6)], "config string, video long, frame_id long")
    spine = spark.createDataFrame([(c, v) for c in "abc" for v in (1, 2)], "config string, video long")
    found = {(r["config_a"], r["config_b"]): (r["n_samples"], r["mean_overlap"]) for r in scoring.overlap_matrix(selected, 2, spine=spine).collect()}
    assert found[("a", "b")] == (2, 0.75) and found[("a", "c")] == (2, 0.5) and found[("c", "c")] == (2, 1.0) and len(found) == 9
    assert len(scoring.overlap_matrix(selected, 2).collect()) == 4


def test_rasters(spark):
    frames = spark.createDataFrame([("x", 0, 10), ("x", 9, 10), ("x", 9, 10), ("y", 0, 1), ("z", 5, 3000)], "s string, pos long, n_frames long")
    spine = spark.createDataFrame([("x",), ("y",), ("z",), ("none",)], "s string")
    for bins in (1, 4, 9, 3000):
        rows = resample.rasters(frames, spine, bins, keys=["s"]).withColumn("row", resample.dense(F.col("bits"), bins)).collect()
        for r in rows:
            want = {round(p / (n - 1) * (bins - 1)) if n > 1 else 0 for s, p, n in [("x", 0, 10), ("x", 9, 10), ("y", 0, 1), ("z", 5, 3000)] if s == r["s"]}
            assert r["row"] == [int(i in want) for i in range(bins)] and r["filled"] == len(want)
    with pytest.raises(ValueError):
        resample.rasters(frames, spine, 0, keys=["s"])


def test_step_lookup_and_sizes(spark):
    steps = spark.createDataFrame([("m", 64, 112), ("m", 576, 336), ("m", 576, 400), ("m", 256, 224), ("o", 1, 9)], "model string, budget int, edge int")
    values = spark.createDataFrame([("m", 5000), ("m", 576), ("m", 575), ("m", 10), ("m", None), ("o", 0), ("none", 7)], "model string, tokens int")
    found = lookups.step_lookup(values, steps, by=["model"], value="tokens", step="budget", out="edge")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("m", 5000, 336), ("m", 576, 336), ("m", 575, 224), ("m", 10, 112), ("m", None, None), ("o", 0, 9), ("none", 7, None)], key=repr)
    bare = lookups.step_lookup(values, steps, by=["model"], value="tokens", step="budget", out="edge", last=False)
    assert {r["tokens"]: r["edge"] for r in bare.where("model = 'm'").collect()}[10] is None
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    row = spark.createDataFrame([(1920, 1080, 336), (300, 200, 336), (10, 4000, 100), (640, 480, None)], "w int, h int, e int")
    sizes = row.select(resample.bounded_size(F.col("w"), F.col("h"), F.col("e")).alias("s"), resample.tokens_per_frame(F.col("h"), context=8192, reserve=512).alias("t")).collect()
    assert [tuple(r["s"]) for r in sizes] == [(336, 189), (300, 200), (1, 100), (640, 480)] and sizes[0]["t"] == 7


def test_repeated_keys(spark):
    rows = spark.createDataFrame([(i % 10, i) for i in range(30)] + [(None, 1)], "k long, x int")
    split = sampling.seeded_split(rows, 0.5, 3, "k")
    sides = {}
    for r in split.collect():
        sides.setdefault(r["k"], set()).add(r["is_train"])
    assert all(len(s) == 1 for s in sides.values()) and sum(s == {True} for s in sides.values()) == 5 and split.count() == 31
    cached = spark.createDataFrame([("a", []), ("a", ["x"]), ("a", ["y"]), ("b", []), ("b", None)], "key string, kws array<string>")
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, n int")
    state = lookups.cache_state(wanted, cached, "key", "kws").collect()
    assert sorted((r["key"], r["n"], r["kws"], r["state"]) for r in state if r["key"] != "b") == [("a", 1, ["x"], "hit"), ("c", 3, None, "miss")]
    assert [r["state"] for r in state if r["key"] == "b"] == ["empty"]
