import json

import pytest
from pyspark.sql import functions as F

from framesift.functions import models
from framesift.sources import adapters, frames, sinks, subtitles
from framesift.streaming import run_logs


def test_registry():
    assert adapters.supported() == sorted(adapters.supported()) and "mlvu" in adapters.supported()
    assert adapters.adapter("MLVU") is adapters.mlvu
    with pytest.raises(ValueError):
        adapters.adapter("none")


def write(tmp_path, name, rows):
    path = tmp_path / name
    path.write_text(json.dumps(rows))
    return str(path)


def test_adapters(spark, tmp_path):
    vsi = write(tmp_path, "v.json", [{"scene_name": "s", "question": "how far", "ground_truth": "2.5", "options": None}, {"scene_name": "s", "question": "which", "ground_truth": "A", "options": ["A. x", "B. y"]}, {"scene_name": "s", "question": "", "ground_truth": "A"}])
    found = adapters.read_samples(spark, "vsibench", vsi, "json").orderBy("question").collect()
    assert [(r["task_type"], r["video_path"], r["answer"]) for r in found] == [("numeric", "s.mp4", "2.5"), ("mcq", "s.mp4", "A")]
    lvb = write(tmp_path, "l.json", [{"id": "i", "video_id": "vid", "video_path": "vid.mp4", "question": "q", "option0": "a", "option1": "N/A", "option2": "c", "option3": "", "option4": None, "correct_choice": 2, "duration_group": "15", "question_category": "TOS"}])
    rows = adapters.read_samples(spark, "longvideobench", lvb, "json")
    r = rows.head()
    assert (r["options"], r["answer"], r["task_type"], r["preprocess_key"]) == (["a", "c"], "C", "15", "vid")
    assert adapters.longvideobench_filter(rows, "TOS").count() == 1 and adapters.longvideobench_filter(rows, "TOS", strict=True).count() == 0
    nx = write(tmp_path, "n.json", [{"video": 12.0, "question": "q", "a0": "p", "a1": "q", "a2": "r", "a3": "s", "a4": "t", "answer": 3, "qid": 7, "type": "CW"}, {"video": 1, "question": "q", "a0": "p", "a1": "", "a2": "r", "a3": "s", "a4": "t", "answer": 3, "qid": 8, "type": "CW"}])
    found = adapters.read_samples(spark, "nextqa", nx, "json").collect()
    assert [(r["sample_id"], r["answer"], r["preprocess_key"]) for r in found] == [("nextqa_7", "D", "nextqa_video_12")]
    ml = write(tmp_path, "m.json", [{"video": "a.mp4", "question": "q", "candidates": ["red", "blue"], "answer": "blue", "question_type": "order"}, {"video": "a.mp4", "question": "q2", "answer": "long text"}])
    found = adapters.read_directory_of_arrays(spark, ml)
    assert sorted((r["sample_id"], r["answer"], r["task_type"]) for r in adapters.mlvu(found).collect()) == [("dev_m_0", "B", "order"), ("dev_m_1", "long text", "generation")]
    ego = write(tmp_path, "e.json", [{"question_idx": "9", "question": "q", "video_idx": "v", "option": ["a", "b", "c", "d", "e"], "answer": "5"}])
    r = adapters.read_samples(spark, "egoschema", ego, "json").head()
    assert (r["sample_id"], r["answer"], len(r["options"])) == ("egoschema_9", "E", 5)
    mme = write(tmp_path, "x.json", [{"question_id": "1", "videoID": "y", "question": "q", "options": ["A. a"], "answer": "(A)", "duration": "LONG"}, {"question_id": "2", "videoID": "y", "question": "q", "options": ["A. a"], "answer": "A", "duration": "odd"}])
    assert sorted(r["task_type"] for r in adapters.read_samples(spark, "videomme", mme, "json").collect()) == ["long", "short"]


def test_subtitles(spark):
    srt = "1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hello</i>\r\nthere\r\n\r\nbad block\r\n\r\n00:00:03,000 --> 00:00:04,000\r\nbye\r\n"
    found = subtitles.parse_srt(spark.createDataFrame([("f", srt)], "path string, content string")).orderBy("seq").collect()
    assert [(r["start_s"], r["end_s"], r["text"]) for r in found] == [(1.0, 2.5, "Hello there"), (3.0, 4.0, "bye")]
    js = json.dumps([{"line": "b", "start": "00:00:10,000", "end": "00:00:09,000"}, {"text": "a", "timestamp": [3, 5.5]}, {"text": ""}])
    found = subtitles.parse_json(spark.createDataFrame([("f", js, 4.0)], "path string, content string, off double"), "off").collect()
    assert [(r["seq"], r["start_s"], r["end_s"], r["text"]) for r in found] == [(0, 0.0, 1.5, "a"), (1, 6.0, 6.0, "b")]


def test_frames(spark):
    meta = spark.createDataFrame([("a", [5, 9], ["f5", "f9"]), ("b", [], ["x"])], "sample_id string, frame_ids array<bigint>, files array<string>")
    listing = spark.createDataFrame([("a", "frame_00000001.jpg"), ("b", "frame_00000020.jpg"), ("b", "frame_00000003.jpg"), ("b", "note.txt")], "sample_id string, file string")
    found = sorted((r["sample_id"], r["pos"], r["frame_id"]) for r in frames.frames_of(meta, listing).collect())
    assert found == [("a", 0, 5), ("a", 1, 9), ("b", 0, 3), ("b", 1, 20)]
    files = spark.createDataFrame([("/r2/v.MP4", 2), ("/r1/v.mkv", 1), ("/r1/n.txt", 1)], "path string, root int")
    assert [tuple(r) for r in frames.video_index(files, root="root").collect()] == [("v", "/r1/v.mkv")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "x string, y int")
    path = str(tmp_path / "log")
    assert sinks.append_csv(rows, path) and sinks.append_csv(rows, path)
    assert not sinks.append_csv(rows.withColumnRenamed("y", "z"), path)
    assert spark.read.csv(path, header=True).count() == 2
    assert sinks.run_log(spark.createDataFrame([("d",)], "dataset string")).columns == sinks.RUN_COLUMNS
    key = sinks.cache_path("Video MME", "org/model", 2, 10, 1, "short")
    entries = spark.createDataFrame([("s", ["k"]), ("t", [])], "sample_id string, kws array<string>")
    sinks.write_cache(entries, str(tmp_path / "cache"), key)
    assert [r["sample_id"] for r in sinks.read_cache(spark, str(tmp_path / "cache"), key).collect()] == ["s"]
    selected = spark.createDataFrame([(1, 1, 20), (1, 0, 10)], "video long, ord long, frame_id long")
    record = sinks.selection_index(selected, {"k": "2"}).head()
    assert [f["frame_id"] for f in record["selected_frames"]] == [10, 20] and record["selection_config"] == {"k": "2"}
    sinks.append_json(sinks.selection_index(selected, {}), str(tmp_path / "index"))
    assert spark.read.json(str(tmp_path / "index")).count() == 1


def test_models(spark):
    rows = spark.createDataFrame([("ab",), ("c",), ("ab",)], "prompt string")
    encode = models.encoder(lambda: lambda xs: [[float(len(x))] for x in xs])
    assert [r["v"] for r in rows.select(encode(F.col("prompt")).alias("v")).collect()] == [[2.0], [1.0], [2.0]]
    said = models.generate(rows, lambda: lambda xs: [x.upper() for x in xs]).collect()
    assert sorted(r["response"] for r in said) == ["AB", "AB", "C"]
    kept = spark.createDataFrame([("ab", "yes")], "p string, response string").select(F.md5("p").alias("prompt_key"), "response")
    assert sorted(str(r["response"]) for r in models.replay(rows, kept).collect()) == ["None", "yes", "yes"]


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"ts": f"2026-01-01T00:0{i}:00Z", "dataset": "d", "sample_id": str(i % 3), "is_correct": i % 2 == 0}) for i in range(4)))
    q = run_logs.windowed_accuracy(run_logs.read_scores(spark, str(source))).writeStream.outputMode("update").format("memory").queryName("acc").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    r = spark.sql("select * from acc").collect()[-1]
    assert r["n"] == 3
