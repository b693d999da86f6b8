import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from framesift.functions import answers
from framesift.sources import adapters, runs


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")


def record(sample, frames, mode=0, **config):
    return {"sample_id": sample, "frame_selection_mode": mode, "selection_config": config or None, "selected_frame_ids": frames}


def test_run_dirs_and_manifest(spark, tmp_path):
    at = datetime(2024, 5, 6, 7, 8, 9)
    made = [runs.new_run_dir(spark, str(tmp_path), at) for _ in range(3)]
    assert [m.rsplit("/", 1)[1] for m in made] == ["20240506_070809", "20240506_070809_1", "20240506_070809_2"]
    lines(tmp_path / "20240506_070809" / runs.INDEX_NAME, [record("s", [3])])
    for strength in (1.0, 2.0):
        runs.write_manifest(spark.createDataFrame([(strength, True)], "keyword_weight_strength double, ensure_keyword_min_coverage boolean"), made[0])
    found = runs.read_selections(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(2.0, True, "s", [3])]


def test_selections_over_runs(spark, tmp_path):
    whole = {"keyword_weight_strength": 1, "ensure_keyword_min_coverage": True}
    lines(tmp_path / "a" / runs.INDEX_NAME, [record("s", [5, 2, 5], **whole), record("t", [1], **whole), record("t", [2], **whole), record("u", [9], mode=1, **whole)])
    lines(tmp_path / "b" / runs.INDEX_NAME, [record("s", [7], **whole), record("s", [8], keyword_weight_strength=3), record("v", [])])
    (tmp_path / "b" / runs.MANIFEST_NAME).write_text(json.dumps({"keyword_weight_strength": 9.0, "ensure_keyword_min_coverage": False}, indent=2))
    lines(tmp_path / "c" / runs.INDEX_NAME, [record("w", [1]), record("x", [1], keyword_weight_strength=1)])
    found = runs.read_selections(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [(1.0, True, "s", [7]), (1.0, True, "t", [2]), (3.0, False, "s", [8]), (9.0, False, "v", [])]
    assert runs.read_selections(spark, str(tmp_path), "a").count() == 2
    with pytest.raises(FileNotFoundError):
        runs.read_selections(spark, str(tmp_path), "none*")


def test_reports(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = spark.createDataFrame([(2, "b"), (1, "z"), (1, "a")], "n int, name string")
    runs.write_report(rows.repartition(3), path, ["n", "name"])
    parts = [p.read_text().splitlines()[1:] for p in sorted((tmp_path / "report").glob("part-*.csv"))]
    assert [x for p in parts for x in p] == ["1,a", "1,z", "2,b"]
    assert runs.read_report(spark, path, ["n"]).count() == 3
    with pytest.raises(ValueError, match="lacks columns: a, b"):
        runs.read_report(spark, path, ["b", "n", "a"])
    empty = tmp_path / "empty.csv"
    empty.write_text("n,name\n")
    with pytest.raises(ValueError, match="no row"):
        runs.read_report(spark, str(empty), ["n"])


def test_captions(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"v": ["one", "two, \"three\""], "w": "[none", "x": {"a": 1}, "y": [], "z": [1, 2.5]}, indent=1))
    assert sorted(tuple(r) for r in runs.read_captions(spark, str(path)).collect()) == [("v", ["one", 'two, "three"']), ("y", []), ("z", ["1", "2.5"])]


def test_sampler_check():
    runs.check_sampler("clip", prepared=True)
    runs.check_sampler("other", prepared=False)
    with pytest.raises(ValueError):
        runs.check_sampler("other", prepared=True)


def test_json_else_parquet(spark, tmp_path):
    rows = [{"scene_name": "s", "question": "which", "ground_truth": "A", "options": ["A. x", "B. y"]}]
    spark.createDataFrame(rows, "scene_name string, question string, ground_truth string, options array<string>").write.parquet(str(tmp_path / "p"))
    (tmp_path / "j.json").write_text(json.dumps(rows * 2))
    assert adapters.read_either(spark, "vsibench", str(tmp_path / "none.json"), str(tmp_path / "p")).count() == 1
    assert adapters.read_either(spark, "vsibench", str(tmp_path / "j.json"), str(tmp_path / "p")).count() == 2


def test_answer_and_confidence_fallbacks(spark):
    texts = ['{"final_answer": "b"}', '{"final_answer": 7}', "none", '{"confidence": 2}', '{"confidence": "3"}', '{"confidence": 8}', '{"confidence": "sure"}', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = rows.select("i", answers.answer_or_draw(F.col("t"), 1, F.col("i")).alias("a"), answers.confidence(F.col("t"), 1, F.col("i")).alias("c"))
    one, two = (found.orderBy("i").collect() for _ in range(2))
    assert one == two
    assert [r["a"] for r in one][0] == 1 and one[1]["a"] in range(5) and [r["a"] for r in one[2:]] == [-1] * 6
    assert [r["c"] for r in one[:5]] == [1, 1, 1, 2, 3] and one[5]["c"] in (1, 2, 3) and [r["c"] for r in one[6:]] == [1, 1]


def test_splits_and_roots():
    assert adapters.split_name("mlvu", " VAL ") == "dev" and adapters.split_name("MLVU", "testset") == "test"
    assert adapters.split_name("longvideobench", "val") == "validation" and adapters.split_name("nextqa", "Any") == "any"
    for dataset, split in (("mlvu", "other"), ("longvideobench", "test")):
        with pytest.raises(ValueError):
            adapters.split_name(dataset, split)
    roots = {"a": "sets/a", "b": "s3://bucket/b"}
    assert adapters.dataset_root("A", roots, {}, "ROOT") == "sets/a"
    assert adapters.dataset_root("a", roots, {"ROOT": "/x/"}, "ROOT") == "/x/sets/a"
    assert adapters.dataset_root("b", roots, {"ROOT": "/x"}, "ROOT") == "s3://bucket/b"
    with pytest.raises(ValueError):
        adapters.dataset_root("c", roots, {}, "ROOT")


def test_summary(spark, tmp_path):
    rows = spark.createDataFrame([(2.0, 10, 71.26), (0.5, None, 3.0), (1.0, 7, None)], "s double, k int, a double")
    path = str(tmp_path / "summary")
    runs.write_summary(rows, path, {"s": "%6.1f", "k": "%4d", "a": "%6.1f"}, order=["s"], head=["title", "-----"])
    assert [r["value"] for r in spark.read.text(path).collect()] == ["title", "-----", "   0.5 |      |    3.0", "   1.0 |    7 |       ", "   2.0 |   10 |   71.3"]
