import json

import pytest

from framesift.sources import adapters, annotations


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def load(spark, root, dataset="mlvu", **options):
    annotations.register(spark)
    return spark.read.format("annotations").options(dataset=dataset, root=str(root), **options).load()


def mlvu(tmp_path):
    """Two development files and the three test files, some of them damaged."""
    row = {"video": "a.mp4", "question": "q", "candidates": ["red", "blue"], "answer": "blue", "question_type": "order", "duration": 12.5}
    put(tmp_path / "MLVU/json/2_b.json", [row, {"video": "b.mp4", "question": "q2", "answer": "long text"}])
    put(tmp_path / "MLVU/json/1_a.json", [row | {"question_id": "own"}, "no object", [1], row])
    put(tmp_path / "MLVU/json/3_c.json", "{ broken")
    put(tmp_path / "MLVU/json/notes.txt", "x")
    put(tmp_path / "test-ground-truth/test_mcq_gt.json", [row, row])
    put(tmp_path / "test-ground-truth/test_ssc_gt.json", [{"video": "c.mp4", "question": "tell", "answer": "a story", "scoring_points": ["x", {"y": 1}]}])
    put(tmp_path / "test-ground-truth/test_vs_gt.json", {"not": "an array"})
    return tmp_path


def test_development_files(spark, tmp_path):
    rows = load(spark, mlvu(tmp_path), split="VAL")
    assert rows.rdd.getNumPartitions() == 3
    found = sorted((r["_file"], r["_file_no"], r["_place"], r["question_id"], r["candidates"], r["duration"], r["_malformed"] is None) for r in rows.collect())
    assert found == [("1_a.json", 0, 0, "own", ["red", "blue"], "12.5", True), ("1_a.json", 0, 1, None, None, None, False), ("1_a.json", 0, 2, None, None, None, False), ("1_a.json", 0, 3, None, ["red", "blue"], "12.5", True), ("2_b.json", 1, 0, None, ["red", "blue"], "12.5", True), ("2_b.json", 1, 1, None, None, None, True), ("3_c.json", 2, 0, None, None, None, False)]
    wrong = {r["_malformed"] for r in rows.where("_malformed IS NOT NULL").collect()}
    assert {'"no object"', "[1]"} < wrong and any("3_c.json" in w for w in wrong)
    samples = annotations.read_set(spark, "MLVU", str(tmp_path), "dev").collect()
    assert sorted((r["sample_id"], r["answer"], r["task_type"]) for r in samples) == [("dev_1_a_3", "B", "order"), ("dev_2_b_0", "B", "order"), ("dev_2_b_1", "long text", "generation"), ("own", "B", "order")]


def test_filters_choose_files(spark, tmp_path):
    root = mlvu(tmp_path)
    assert {n: load(spark, root, split="testset", task_filter=n).rdd.getNumPartitions() for n in ("all", "mcq", "generation", "numeric", "order")} == {"all": 3, "mcq": 1, "generation": 3, "numeric": 3, "order": 1}
    rows = load(spark, root, split="test")
    assert rows.where("_format = 'mcq'").rdd.getNumPartitions() == 1 and rows.where("_format IN ('generation', 'x')").rdd.getNumPartitions() == 2
    assert rows.where("_format = 'mcq'").count() == 2 and rows.where("_split = 'dev'").count() == 0
    assert rows.where("_format = 'mcq' AND answer = 'red'").count() == 0  # what isn't a file's stays with Spark
    put(root / "test-ground-truth/test_ssc_gt.json", "")  # a file that isn't chosen isn't opened
    assert rows.where("_format = 'mcq' AND _malformed IS NOT NULL").count() == 0
    ids = sorted(r["sample_id"] for r in annotations.read_set(spark, "mlvu", str(root), "test", "mcq").collect())
    assert ids == ["mlvu_0", "mlvu_1"]  # places count over all files


def test_splits_and_errors(spark, tmp_path):
    for options in ({"dataset": "mlvu", "split": "dev"}, {"dataset": "mlvu", "split": "other"}, {"dataset": "none"}, {"dataset": "longvideobench", "split": "test"}, {"dataset": "longvideobench", "split": "val"}):
        with pytest.raises(Exception, match="no annotations|has no split|unknown dataset"):
            load(spark, tmp_path / "empty", **options).collect()


def test_json_else_parquet_and_lines(spark, tmp_path):
    row = {"id": None, "video_id": "v", "video_path": "v.mp4", "question": "q", "option0": "a", "option1": "b", "correct_choice": 1, "duration_group": 15, "duration": 3.5}
    spark.createDataFrame([("i", "v.mp4", "q", "a", "b", 0)], "id string, video_path string, question string, option0 string, option1 string, correct_choice int").coalesce(1).write.parquet(str(tmp_path / "p"))
    (part,) = (tmp_path / "p").glob("*.parquet")
    part.rename(tmp_path / "validation-00000-of-00001.parquet")
    assert [(r["sample_id"], r["answer"]) for r in annotations.read_set(spark, "longvideobench", str(tmp_path), "validation").collect()] == [("i", "A")]
    put(tmp_path / "lvb_val.json", [row, row | {"id": " x "}])
    found = annotations.read_set(spark, "longvideobench", str(tmp_path), "val").collect()
    assert sorted((r["sample_id"], r["answer"], r["task_type"], r["preprocess_key"]) for r in found) == [("lvb_0", "B", "15", "v"), ("x", "B", "15", "v")]
    put(tmp_path / "vsi/test_1.jsonl", json.dumps({"scene_name": "s", "question": "far?", "ground_truth": 2.5}) + "\n\nbad\n")
    put(tmp_path / "vsi/other.json", [])
    found = load(spark, tmp_path / "vsi", dataset="vsibench", split="test").collect()
    assert sorted((r["ground_truth"], r["_malformed"]) for r in found if r["_malformed"] is None) == [("2.5", None)] and len(found) == 2
    assert [r["sample_id"] for r in annotations.read_set(spark, "vsibench", str(tmp_path / "vsi"), "test").collect()] == ["vsibench_0"]


def samples(spark, dataset, rows, index=True):
    """Raw rows through an adapter, as (id, path, answer, options, task, key) in order."""
    text = [json.dumps(r | ({"source_index": i} if index else {})) for i, r in enumerate(rows)]
    raw = spark.read.json(spark.createDataFrame([(t,) for t in text], "value string").coalesce(1).rdd.map(lambda r: r["value"]))
    return [(r["sample_id"], r["video_path"], r["answer"], r["options"], r["task_type"], r["preprocess_key"]) for r in adapters.adapter(dataset)(raw).collect()]


def test_adapters_drop_and_name_rows_by_the_rules(spark):
    assert samples(spark, "vsibench", [{"scene_name": "s", "question": " far ", "ground_truth": 2.5, "options": []}, {"scene_name": "", "question": "q", "ground_truth": "A"}, {"scene_name": "s", "question": "which", "ground_truth": "A", "options": ["A. x", "B. y"]}]) == [
        ("vsibench_0", "s.mp4", "2.5", None, "numeric", "vsibench_0"),
        ("vsibench_2", "s.mp4", "A", ["A. x", "B. y"], "mcq", "vsibench_2"),
    ]
    base = {"videoID": "y", "question": "q", "options": [" a ", ""], "answer": " b.", "duration": "LONG"}
    assert samples(spark, "videomme", [base | {"question_id": "1-1"}, base | {"options": None}, base | {"options": [" "]}, base | {"duration": "odd", "answer": "none of them"}]) == [
        ("1-1", "y", "B", ["a"], "long", "1-1"),
        ("videomme_3", "y", "NONE OF THEM", ["a"], "short", "videomme_3"),
    ]
    base = {"video_path": "v/x.mp4", "question": "q", "option0": "a", "option1": "n/a", "option2": " c ", "question_category": "TOS"}
    assert samples(spark, "longvideobench", [base | {"correct_choice": "abc"}, base | {"correct_choice": 26, "id": "i", "video_id": "vid"}, base | {"correct_choice": "b it is"}, base | {"correct_choice": -1}, base | {"correct_choice": " "}, {"question": "q", "video_path": "v", "correct_choice": 1, "option0": "N/A"}]) == [
        ("lvb_0", "v/x.mp4", "ABC", ["a", "c"], "TOS", "lvb_0"),
        ("i", "v/x.mp4", "26", ["a", "c"], "TOS", "vid"),
        ("lvb_2", "v/x.mp4", "B", ["a", "c"], "TOS", "lvb_2"),
        ("lvb_3", "v/x.mp4", "-1", ["a", "c"], "TOS", "lvb_3"),
    ]
    assert samples(spark, "mlvu", [{"video": "a", "question": "q", "candidates": ["Red", " blue "], "answer": "BLUE"}, {"video": "a", "question": "q", "answer": ""}, {"video": "a", "question": "q", "answer": " free ", "task_type": "t", "question_id": "m"}]) == [
        ("mlvu_0", "a", "B", ["Red", "blue"], "mcq", "mlvu_0"),
        ("m", "a", "free", None, "t", "m"),
    ]
    base = {"video": "12.0", "question": "q", "a0": "p", "a1": "q", "a2": "r", "a3": "s", "a4": "t", "answer": 3}
    assert [r[0] for r in samples(spark, "nextqa", [base, base, base | {"qid": 7}])] == ["nextqa_0", "nextqa_1", "nextqa_7"]
    base = {"question": "q", "option": ["a", "b"], "answer": "0"}
    assert samples(spark, "egoschema", [base | {"video_uid": "u", "video_idx": "i", "q_uid": "q"}, base | {"q_uid": "q", "id": "d", "answer": "5"}, base | {"uid": "w", "question_idx": "9"}, base]) == [
        ("egoschema_0", "u.mp4", "A", ["a", "b"], "mcq", "egoschema_0"),
        ("egoschema_1", "q.mp4", "E", ["a", "b"], "mcq", "egoschema_1"),
        ("egoschema_2", "w.mp4", "A", ["a", "b"], "mcq", "egoschema_2"),
    ]
    unnamed = samples(spark, "nextqa", [{**{f"a{i}": "x" for i in range(5)}, "video": "1", "question": f"q{k}", "answer": 1} for k in range(2)], index=False)
    assert len({r[0] for r in unnamed}) == 2  # no place and no id: a hash of the question
