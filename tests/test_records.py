import json

import pytest
from pyspark.sql import functions as F

from framesift.functions import answers, names
from framesift.operators import iterative
from framesift.sources import sinks


def column(spark, values, made, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["made"] for r in rows.select("i", made(F.col("v")).alias("made")).orderBy("i").collect()]


def test_harness_names_and_aliases(spark):
    ids = ["lmms-lab/LLaVA-Video-7B-Qwen2", "x/llava-onevision-qwen2", "llava-hf/llava-onevision", "lmms-lab/llava_onevision", "x/LLaVA-NeXT", "x/llava-video", "Qwen/Qwen3-VL-8B", "Qwen/Qwen2.5-VL-7B", "Qwen/Qwen2-VL", "other", None]
    assert column(spark, ids, names.harness_model) == ["llava_vid", "llava_hf", "llava_hf", "llava_onevision", "llava_hf", "llava_vid", "qwen3_vl", "qwen2_5_vl", "qwen2_vl", "qwen2_5_vl", None]
    order = ["ours", "visual"]
    for ours, visual, overridden, want in [("a", "b", set(), "a"), ("a", "b", {"visual"}, "b"), ("a", "b", {"ours", "visual"}, "a"), ("", "b", {"ours"}, "b"), ("a", None, {"visual"}, "a"), (None, " ", set(), None), ("a", "a", set(), "a")]:
        assert names.aliased({"ours": ours, "visual": visual}, order, overridden) == want


def test_query_wordings(spark):
    rows = spark.createDataFrame([(" q ", ["A. x", "y"]), ("q", ["x", " "]), ("q", None), (" ", ["x"]), (None, None)], "q string, o array<string>")
    assert [r[0] for r in rows.select(answers.open_query(F.col("q"), F.col("o"))).collect()] == ["q\nOptions:\nA. x\nB. y", "q", "q", answers.FIND_FRAMES, answers.FIND_FRAMES]
    assert rows.limit(1).select(answers.good_frame_query(F.col("q"), F.col("o"))).head()[0] == "Question: q\nOptions:\nA. x\nB. y. Is this a good frame can answer the question?"
    assert rows.limit(1).select(answers.question_query(F.col("q"))).head()[0] == "q"
    with pytest.raises(Exception, match="needs a question"):
        rows.select(answers.question_query(F.col("q"))).collect()
    listed = spark.createDataFrame([("why", [" a ", "n/a", None, "", "b"]), ("why", None)], "q string, o array<string>")
    assert [r[0] for r in listed.select(answers.candidate_prompt(F.col("q"), F.col("o"), "pre ", "post")).collect()] == ["pre why\nA. a\nB. \nC. b\npost", "pre why\n\npost"]


def test_selection_records(spark, tmp_path):
    samples = spark.createDataFrame([("s", "t", "q", ["x"], "A", " a", ["k"], [10, 20, 30], [10], "d"), ("u", None, None, None, None, None, None, None, None, None)], "sample_id string, task_type string, question string, options array<string>, gt_answer string, pred_answer string, keywords array<string>, frame_ids array<bigint>, prescreen_frame_ids array<bigint>, detail_path string")
    selected = spark.createDataFrame([("s", 1, 2), ("s", 0, 0)], "sample_id string, ord int, index_in_pool int")
    made = sinks.selection_records(samples, selected, {"max_keywords": "5", "other": "x"}, mode="0")
    sinks.append_json(made, str(tmp_path / "r"))
    rows = {r["sample_id"]: r for r in spark.read.schema(made.schema).json(str(tmp_path / "r")).collect()}
    s, u = rows["s"], rows["u"]
    assert [tuple(f) for f in s["selected_frames"]] == [(0, 0, 10), (1, 2, 30)] and s["selected_frame_ids"] == [10, 30] and s["is_correct"] and s["selection_config"] == {"max_keywords": "5"}
    assert (s["candidate_pool_size"], s["selected_count"], s["prescreen_candidate_count"], s["frame_selection_mode"], s["verbose_detail_path"]) == (3, 2, 1, "0", "d")
    assert (u["selected_count"], u["candidate_pool_size"], u["options"], u["task_type"], u["selected_frames"]) == (0, 0, [], "", [])


def test_round_details(spark):
    rounds = spark.createDataFrame([("a/b", "main", 3, "q", ["x"], "A", "a ", "said", 1.5, {"A": 0.9}, 40), ("c", "main", 1, "q", None, "A", None, None, 0.0, None, 0)], "sample_id string, stage string, round_id int, question string, options array<string>, gt_answer string, answer string, response string, inference_time double, option_probs map<string,double>, candidate_count int")
    frames = spark.createDataFrame([("a/b", "main", 3, 1, 7, 70, None, {f"k{i}": i / 10 for i in range(7)}), ("a/b", "main", 3, 0, 2, 20, "hi", None)], "sample_id string, stage string, round_id int, ord int, index_in_pool int, frame_id bigint, subtitle string, keyword_scores map<string,double>")
    keywords = spark.createDataFrame([("a/b", "k1", 0.5, None, 0.25, None)], "sample_id string, text string, local_evidence_score double, info_score double, weight double, used_for_selection boolean")
    one, two = sinks.round_details(rounds, frames, keywords).orderBy("sample_id").collect()
    assert [(f["order"], f["file"], f["subtitle"], len(f["top_keywords"])) for f in one["frames"]["selected"]] == [(0, "00_frame_20.jpg", "hi", 0), (1, "01_frame_70.jpg", "", 5)]
    assert [(k["keyword"], k["clip_score"]) for k in one["frames"]["selected"][1]["top_keywords"]][:2] == [("k6", 0.6), ("k5", 0.5)]
    assert one["prediction"]["is_correct"] and tuple(one["keywords"]["final"][0]) == ("k1", 0.5, 0.0, 0.25, True) and one["detail_path"].endswith("main_round_03/info.json")
    assert two["frames"]["selected_count"] == 0 and not two["prediction"]["is_correct"]
    assert json.loads(sinks.round_details(rounds, frames, keywords).toJSON().collect()[0])


def test_cached_keywords_by_id(spark):
    cache = spark.createDataFrame([("a_b", "a b", ["k"], ["K"]), ("a_b", "a/b", ["other"], ["O"]), ("c", None, ["n"], ["N"]), ("d", "e", ["wrong"], ["W"])], "file_id string, sample_id string, kws array<string>, kws_raw array<string>")
    found = {r["sample_id"]: r["kws"] for r in sinks.cached_keywords(spark.createDataFrame([("a b",), ("a/b",), ("c",), ("d",), ("z",)], "sample_id string"), cache).collect()}
    assert found == {"a b": ["k"], "a/b": ["other"], "c": ["n"], "d": None, "z": None}


def test_answers_read_by_a_callback(spark):
    rounds = spark.createDataFrame([(1, 1, "so B.", 1.0, True, [1]), (1, 2, "", 1.0, True, [1, 2]), (2, 1, "about 7.5 m", None, None, None)], "sample bigint, round bigint, response string, prob double, has_options boolean, frames array<bigint>")
    read = iterative.extracted(rounds, lambda text, has: F.when(has, answers.letter(text)).otherwise(answers.number(text)))
    assert {(r["sample"], r["round"]): r["answer"] for r in iterative.fold_rounds(read).collect()} == {(1, 1): "B", (1, 2): "B", (2, 1): "7.5"}
