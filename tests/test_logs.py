import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from framesift.sources import frames, listing, logs


def batches(path):
    return sorted(x for x in os.listdir(path) if x.startswith("batch="))


def test_writers_at_once_never_mix_headers(spark, tmp_path):
    path = str(tmp_path / "log")
    kinds = [["a", "b"], ["a", "c"], ["b", "a"]]

    def write(i):
        rows = spark.createDataFrame([(f"x{i}", f'q"{i}\n, y')] * 3, kinds[i % 3]).repartition(2)
        return i % 3, logs.append_log(rows, path)

    with ThreadPoolExecutor(9) as pool:
        done = list(pool.map(write, range(9)))
    (kind,) = {k for k, ok in done if ok}
    assert [ok for k, ok in done] == [k == kind for k, _ in done]  # all of one header, none of another
    assert logs.header_of(spark, path) == kinds[kind] and len(batches(path)) == 3
    found = logs.read_log(spark, path, required=["a"]).collect()
    assert len(found) == 9 and found[0].__fields__ == kinds[kind] and sum("\n" in v for r in found for v in r) == 9
    assert not os.listdir(tmp_path / "log/_staging")
    with pytest.raises(ValueError):
        logs.read_log(spark, path, required=["zzz"])


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("a"))
    with pytest.raises(Exception, match="broken"):
        logs.append_log(rows, path)
    assert logs.header_of(spark, path) is None and not os.path.exists(path) or batches(path) == []
    with pytest.raises(FileNotFoundError):
        logs.read_log(spark, path)
    good = spark.createDataFrame([("1", None)], "a string, b string")
    assert logs.append_log(good, path) and logs.append_log(good, path) and not logs.append_log(good.select("b", "a"), path)
    with pytest.raises(Exception, match="broken"):
        logs.append_log(rows.withColumn("b", F.lit("x")), path)
    assert [tuple(r) for r in logs.read_log(spark, path).collect()] == [("1", None)] * 2 and len(batches(path)) == 2
    assert logs.append_log(good.limit(0), path) and logs.read_log(spark, path).count() == 2


def test_the_log_of_a_split(spark):
    rows = spark.createDataFrame([("d", 3, 2.0, 66.6666, 0.12345, 1.0, True, 0.5)], "dataset string, num_samples int, correct_count double, accuracy_percent double, avg_inference_time double, avg_total_time_hours double, use_train_split boolean, train_ratio double")
    found = logs.split_run_log(rows).head().asDict()
    assert list(found) == logs.SPLIT_RUN_COLUMNS
    assert {k: v for k, v in found.items() if v is not None} == {"dataset": "d", "num_samples": "3", "correct_count": "2.000000", "accuracy_percent": "66.67", "avg_inference_time": "0.123", "avg_total_time_hours": "1.000000", "train_ratio": "0.5", "eval_split": "train"}


def test_listing(spark, tmp_path):
    for i in range(30):
        folder = tmp_path / f"one/d{i}/deep"
        folder.mkdir(parents=True)
        for k in range(40):
            (folder / f"v{i}_{k}.mp4").touch()
        (folder.parent / f"n{i}.txt").touch()
    (tmp_path / "two/sub").mkdir(parents=True)
    (tmp_path / "two/sub/v3_4.MKV").write_bytes(b"12345")
    (tmp_path / "two/only here.webm").touch()
    (tmp_path / "one/v3_5.mp4").touch()
    one, two, none = (str(tmp_path / x) for x in ("one", "two", "none"))
    for folders in (1, 4, 64):
        rows = listing.list_files(spark, [one, two, none], folders=folders)
        assert rows.count() == 30 * 41 + 3 and rows.select("path").distinct().count() == 30 * 41 + 3
        assert rows.where("path LIKE '%/two/sub/%'").select("root", "root_no", "size").head()[:] == (two, 1, 5)
    assert listing.list_files(spark, [one]).rdd.getNumPartitions() > 30
    index = {r["stem"]: r["path"] for r in listing.index_videos(spark, [one, two]).collect()}
    assert len(index) == 1201 and index["v3_4"].startswith(one) and index["only here"] == f"{two}/only here.webm"
    assert index["v3_5"] == f"{one}/d3/deep/v3_5.mp4"  # the first path of the first root
    assert {r["stem"]: r["path"] for r in listing.index_videos(spark, [two, one]).where("stem = 'v3_4'").collect()} == {"v3_4": f"{two}/sub/v3_4.MKV"}
    plan = listing.index_videos(spark, [one])._jdf.queryExecution().executedPlan().toString()
    assert "listing" in plan and "FileScan" not in plan


def test_a_hundred_thousand_files(spark, tmp_path):
    for i in range(100):
        os.mkdir(tmp_path / f"s{i}")
        for k in range(1000):
            os.mknod(tmp_path / f"s{i}/frame_{k * 7:08}.jpg")
    found = frames.frames_of(spark.createDataFrame([], frames.META), listing.list_frames(spark, [str(tmp_path)]))
    assert found.count() == 100_000
    assert found.where("sample_id = 's42' AND pos = 999").head()["frame_id"] == 6993
