import json
import random

from framesift.operators import naming
from framesift.sources import runs


def one_by_one(bases):
    taken, found = set(), []
    for base in bases:
        base, k = base if base is not None else "unknown", 0
        name = base
        while name in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name)
        found.append(name)
    return found


def test_equal_to_naming_row_by_row(spark):
    rng = random.Random(5)
    for bases in (
        ["a", "a", "a_1", "a", "a_2", "a_1", "a_1_1", "a"],
        ["a_1", "a_2", "a", "a", "a_1", "a_1_1", None, "unknown", ""],
        [rng.choice(["a", "a_1", "a_2", "a_1_1", "b", "b_1", "c"]) for _ in range(60)],
        ["x"] * 40 + ["x_39", "x_5"],
    ):
        rows = spark.createDataFrame([(i, b, "k", 0) for i, b in enumerate(bases)], "i int, b string, name string, k int").repartition(5).drop("name")
        found = naming.unique_names(rows, "b", ["i"], suffix=".pt").orderBy("i").collect()
        assert [r["name"] for r in found] == [f"{n}.pt" for n in one_by_one(bases)]
    assert naming.unique_names(rows.limit(0), "b", ["i"]).collect() == []


def test_embedding_files_and_index(spark, tmp_path):
    rows = [("/v/a b.mp4", "s1", None, 25.0, 100, [0, 5], [[1.0, 2.0], [3.0, 4.0]]), ("/w/a b.mkv", "s2", "k", None, 7, [], []), ("/w/a_b_1.mp4", None, None, 1.0, 1, [0], [[1.0, 2.0]])]
    df = spark.createDataFrame(rows, "video_path string, sample_id string, preprocess_key string, fps double, total_frames long, frame_indices array<long>, embedding array<array<float>>")
    index = runs.write_embeddings(df, str(tmp_path / "e"), {"dataset": "d"}, order=["video_path"])
    assert [(r["embedding_file"], r["num_sampled_frames"], r["embedding_shape"]) for r in index.orderBy("video_path").collect()] == [("a_b", 2, [2, 2]), ("a_b_1", 0, [0, 0]), ("a_b_1_1", 1, [1, 2])]
    one = spark.read.parquet(str(tmp_path / "e/embeddings")).where("embedding_file = 'a_b'").head()
    assert one["embedding"] == [[1.0, 2.0], [3.0, 4.0]] and one["sample_id"] == "s1"
    (part,) = (tmp_path / "e/index.json").glob("part-*.json")
    assert json.loads(part.read_text()) == {"dataset": "d", "num_videos_success": 3}
