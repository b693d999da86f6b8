import pytest
from pyspark.sql import functions as F

from framesift.functions import names
from framesift.operators import lookups


def column(spark, values, kind, made):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["made"] for r in rows.select("i", made(F.col("v")).alias("made")).orderBy("i").collect()]


def test_model_rules(spark):
    ids = ["Org/Qwen3-VL-4B", "Org/Qwen2.5-VL-7B", "x/llava-onevision-next", "x/LLaVA-NeXT", "x/llava-next-onevision llava-onevision", "x/some-vl-2b", "x/text", None]
    assert column(spark, ids, "string", names.pixel_factor) == [32, 28, None, None, None, None, None, None]
    assert column(spark, ids, "string", names.is_vision_model) == [True, True, True, True, True, True, False, None]
    assert column(spark, ids, "string", names.has_pixel_limits)[:7] == [True, True, False, True, False, False, False]


def test_extractor_spec(spark):
    def made(c):
        return names.extractor_spec(c, ["poe", "or"])

    specs = ["local", " LOCAL ", "", None, "local-a/b", "Poe_gpt", "or:x/y-z", "order-model", "plain"]
    assert [tuple(r) for r in column(spark, specs, "string", made)] == [
        ("local", "", ""), ("local", "", ""), ("local", "", ""), ("local", "", ""), ("local", "", "a/b"),
        ("remote", "poe", "gpt"), ("remote", "or", "x/y-z"), ("remote", "", "order-model"), ("remote", "", "plain"),
    ]
    with pytest.raises(Exception, match="no model is named"):
        column(spark, ["poe-"], "string", made)


def test_prepared_dir(spark):
    assert column(spark, [2.0, 0.5, 10.0], "double", lambda c: names.prepared_dir("/b/", F.lit(" d "), c)) == ["/b/d/clip_2", "/b/d/clip_0.5", "/b/d/clip_10"]


def test_bundle_text(spark):
    kind = "array<struct<question_id:string,question:string,options:array<string>,answer:string,domain:string,sub_category:string,task_type:string>>"
    two = [("q1", "Which?", ["A. x", "B. y"], "A", "d", "", None), ("q2", "How?", None, "3", None, None, "t")]
    found = column(spark, [two, [], None], kind, lambda c: names.bundle_text(F.lit("v"), F.lit("v.mp4"), c))
    assert found[0] == "Video ID: v\nVideo File: v.mp4\nQuestion Count: 2\n\n[Q1] q1\nQuestion: Which?\n  A. x\n  B. y\nAnswer: A\nDomain: d\n\n[Q2] q2\nQuestion: How?\nAnswer: 3\nTask Type: t\n"
    assert found[1] == found[2] == "Video ID: v\nVideo File: v.mp4\nQuestion Count: 0\n"


def test_verify(spark):
    wanted = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1), (None, 7), ("c", None)], "split string, k int")
    there = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    found = {r["split"]: (r["found"], r["missing"], r["missing_examples"]) for r in lookups.verify(wanted, there, ["k"], by=["split"], examples=3).collect()}
    assert found == {"a": (2, 7, ["0", "3", "4"]), "b": (1, 0, []), None: (0, 1, ["7"]), "c": (0, 1, [""])}
