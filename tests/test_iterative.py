import random

import pytest

from framesift.operators import iterative
from framesift.streaming import rounds as stream

SCHEMA = "sample bigint, round bigint, answer string, prob double, has_options boolean, frames array<bigint>"


def plain(rows, streak=3, threshold=0.9):
    """The loop of a sample, round by round."""
    found, by = [], {}
    for r in rows:
        by.setdefault(r[0], {})[r[1]] = r
    for sample, rounds in by.items():
        cache, final, stable, run, hits, i = set(), None, None, 0, 0, 0
        while i + 1 in rounds:
            i += 1
            _, _, answer, prob, has_options, frames = rounds[i]
            letter = (answer or "").strip(" ").upper()
            if has_options and letter in ("A", "B", "C", "D") and (prob or 0.0) > threshold:
                run = run + 1 if letter == stable else 1
                stable = letter
            else:
                stable, run = None, 0
            final = answer if answer is not None else final
            for f in frames or []:
                hits += f in cache
                cache.add(f)
            found.append((sample, i, final, run, run >= streak, hits, len(cache)))
            if run >= streak:
                break
    return sorted(found)


def rows(seed=1, samples=40):
    rng, made = random.Random(seed), []
    for s in range(samples):
        for i in range(1, rng.randint(1, 14)):
            if s % 9 == 0 and i == 4:
                continue  # a gap
            answer = rng.choice(["A", "A", " a", "b ", "E", "12", None, "Z"]) if s % 3 else rng.choice(["A", "a", "A "])
            frames = None if rng.random() < 0.1 else [rng.randint(0, 6) for _ in range(i)]
            made.append((s, i, answer, rng.choice([0.95, 0.99, 0.91, 0.9, None]) if s % 2 else 0.95, rng.choice([True, True, True, True, False]) if s % 5 else s % 10 == 0, frames))
    return made


def listed(df):
    return sorted((r["sample"], r["round"], r["answer"], r["streak"], r["stopped"], r["hits"], r["misses"]) for r in df.collect())


def test_batch_equals_the_loop(spark):
    given = rows()
    folded = iterative.fold_rounds(spark.createDataFrame(given, SCHEMA))
    want = plain(given)
    assert listed(folded) == want and any(r[4] for r in want)
    last = {r[0]: r for r in want}
    assert {r["sample"]: (r["answer"], r["rounds_used"], r["stopped"], r["hits"], r["misses"]) for r in iterative.results(folded).collect()} == {s: (r[2] or "", r[1], *r[4:]) for s, r in last.items()}
    assert listed(iterative.fold_rounds(spark.createDataFrame([], SCHEMA))) == []


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_batch(spark, tmp_path, shuffled):
    given = rows(2, 15)
    if shuffled:
        random.Random(3).shuffle(given)
    source, third = str(tmp_path / "in"), len(given) // 3 + 1
    for k in range(3):
        spark.createDataFrame(given[k * third : (k + 1) * third], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    for key, value in stream.PROVIDER.items():
        spark.conf.set(key, value)
    folded = stream.fold_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
    name = f"folded_{shuffled}".lower()
    query = folded.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    assert listed(spark.table(name)) == plain(given) == listed(iterative.fold_rounds(spark.createDataFrame(given, SCHEMA)))


def test_only_letters_of_samples_with_options_stop(spark):
    from framesift.operators import ranking

    given = [("x", i, "Z", 1.0, True) for i in (1, 2, 3)] + [("y", i, " a", 1.0, False) for i in (1, 2, 3)] + [("z", i, a, 1.0, True) for i, a in enumerate(["E", "a", "A ", None], 1)] + [("n", 1, "A", None, True)]
    rows = spark.createDataFrame(given, "sample string, round int, answer string, prob double, options boolean")
    found = ranking.early_stop(rows, sample="sample", order="round", answer="answer", prob="prob", threshold=0.9, streak=2, has_options="options")
    assert {r["sample"]: r["stop_round"] for r in found.collect()} == {"x": None, "y": None, "z": 3, "n": None}
