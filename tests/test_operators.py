import math
import random

import pytest
from pyspark.sql import functions as F

from framesift.functions import answers, draws, texts, vectors
from framesift.operators import intervals, lookups, ranking, resample, sampling, scoring, selection


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).head()["y"]


@pytest.mark.parametrize(
    "text,wanted",
    [("The answer is B.", "B"), ("a cat", "A"), ("ÄB ß", None), ("nothing", None), ("(c)", "C"), ("12 or D", "D"), ("", None), (None, None)],
)
def test_letter(spark, text, wanted):
    assert one(spark, text, answers.letter) == wanted


@pytest.mark.parametrize(
    "text,wanted",
    [("x</think> <answer>b</answer> A", "B"), ("A </think> 3.5 m", "3.5"), ("no idea", "no idea"), ("x</think>y</think>C", "C")],
)
def test_parse_answer(spark, text, wanted):
    assert one(spark, text, answers.parse_answer) == wanted


@pytest.mark.parametrize("given,wanted", [("b", "B"), ("0", "A"), ("4", "E"), ("5", "E"), ("6", "6"), ("blue ", "blue"), ("", ""), (None, None)])
def test_normalize_choice(spark, given, wanted):
    assert one(spark, given, answers.normalize_choice) == wanted


def test_choice_by_option(spark):
    row = spark.createDataFrame([("Blue", ["red", "blue"])], "a string, o array<string>")
    assert row.select(answers.choice_letter(F.col("a"), F.col("o")).alias("y")).head()["y"] == "B"


def test_options_keep_their_letter(spark):
    row = spark.createDataFrame([(["A. red", " ", None, "blue"],)], "o array<string>")
    assert row.select(answers.label_options(F.col("o")).alias("y")).head()["y"] == "A. red\nD. blue"


@pytest.mark.parametrize("p,g,wanted", [(8.0, 10.0, 0.8), (30.0, 10.0, 0.0), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (None, 1.0, None)])
def test_relative_accuracy(spark, p, g, wanted):
    row = spark.createDataFrame([(p, g)], "p double, g double")
    found = row.select(answers.relative_accuracy(F.col("p"), F.col("g")).alias("y")).head()["y"]
    assert found == wanted if wanted is None else found == pytest.approx(wanted)


def test_texts(spark):
    assert one(spark, "01:02:03,500", texts.seconds_of) == 3723.5
    assert one(spark, "7.25", texts.number_or_stamp) == 7.25
    assert one(spark, "bad", texts.number_or_stamp) is None
    assert one(spark, "12.0", texts.whole_number_text) == "12"
    assert one(spark, "__a b/c__", texts.safe_name) == "a_b_c"
    assert one(spark, "///", texts.safe_name) == "unknown"
    assert one(spark, "/a/b.c.mp4", texts.stem) == "b.c"
    assert one(spark, '["x", "y"]', texts.string_list) == ["x", "y"]
    assert one(spark, "say \"p\" or 'q', \"r\"", texts.string_list) == ["p", "r"]
    assert one(spark, "- p\n2. q", texts.string_list) == ["p", "q"]
    assert one(spark, ["A", "b", "a "], texts.distinct_ignoring_case, "array<string>") == ["A", "b"]
    assert one(spark, [0.5, float("-inf")], texts.pipe_list, "array<double>").startswith("0.500000|-")
    assert one(spark, 1536.0, texts.human_bytes, "double") == "1.5 KB"
    assert one(spark, [3.0, 4.0], vectors.norm, "array<double>") == 5.0


def test_uniform_is_open(spark):
    rows = spark.range(1000).select(draws.uniform(1, F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).head()
    assert 0 < rows[0] < rows[1] < 1 and abs(rows[2] - 0.5) < 0.05


def pool(spark, scores, video=1):
    n = len(scores)
    return spark.createDataFrame([(video, 10 * i, i, n, float(s)) for i, s in enumerate(scores)], "video long, frame_id long, pos long, n long, score double")


def ids(found):
    return [r["frame_id"] for r in found.orderBy("video", "ord").collect()]


@pytest.mark.parametrize("method", sorted(selection.SELECTORS))
@pytest.mark.parametrize("scores", [[1.0], [2.0, 2.0, 2.0], [0.1, 0.9, 0.3, 0.3, 0.7, 0.2, 0.0]])
def test_every_selector_on_small_pools(spark, method, scores):
    found = ids(selection.select_frames(pool(spark, scores), method, 4))
    assert 1 <= len(found) <= 4
    assert set(found) <= {10 * i for i in range(len(scores))}
    assert found == sorted(found)


def test_unknown_selector(spark):
    with pytest.raises(ValueError, match="unknown method"):
        selection.select_frames(pool(spark, [1.0]), "nope", 1)


def aks_model(z, k, t1, t2, depth):
    def top(x, m):
        return sorted(range(len(x)), key=lambda i: (-x[i], i))[:m]

    def split(first, last, d):
        own = z[first:last]
        mean = sum(own) / len(own)
        std = (sum((x - mean) ** 2 for x in own) / len(own)) ** 0.5
        best = [own[i] for i in top(own, k)]
        if d == depth or len(own) < 2 or (sum(best) / len(best) - mean > t1 and std > t2):
            return [(first, last, d)]
        mid = first + (last - first) // 2
        return split(first, mid, d + 1) + split(mid, last, d + 1)

    if len(z) <= k:
        return list(range(len(z)))
    out = []
    for first, last, d in split(0, len(z), 0):
        out += [first + i for i in top(z[first:last], int(k / 2**d))]
    return sorted(out)[:k]


@pytest.mark.parametrize("k,t1,t2", [(4, 0.3, 0.05), (8, 0.2, 0.1), (12, 0.8, -100.0)])
def test_recursive_segments_against_model(spark, k, t1, t2):
    rng = random.Random(5)
    for n in (9, 33, 64):
        scores = [round(rng.random(), 3) for _ in range(n)]
        low, high = min(scores), max(scores)
        z = [round((s - low) / (high - low), 9) for s in scores]
        found = ids(selection.pick_recursive_segments(pool(spark, scores), k, t1=t1, t2=t2))
        assert found == [10 * i for i in aks_model(z, k, t1, t2, min(5, k.bit_length() - 1))]


def test_quota_fold_fills_the_budget(spark):
    rng = random.Random(2)
    sims = [(1, kw, f, f, 20, round(rng.random(), 3)) for kw in range(3) for f in range(20)]
    rows = spark.createDataFrame(sims, "video long, kw_id long, frame_id long, pos long, n long, sim double")
    allotted = selection.quotas(selection.power_weights(selection.local_evidence(rows), 1.0), 8)
    picked = selection.pick_by_quota(rows, allotted, 8).collect()
    quota = {r["kw_id"]: r["quota"] for r in allotted.collect()}
    assert sum(quota.values()) == 8 and len({r["frame_id"] for r in picked}) == 8
    for kw, n in quota.items():
        assert sum(r["kw_id"] == kw for r in picked) == n
    taken = set()
    order = sorted(allotted.collect(), key=lambda r: (-r["weight"], r["kw_id"]))
    for r in order:
        ranked = [f for _, _, f, _, _, _ in sorted((s for s in sims if s[1] == r["kw_id"]), key=lambda s: (-s[5], s[2]))]
        own = [f for f in ranked if f not in taken][: r["quota"]]
        assert sorted(own) == sorted(p["frame_id"] for p in picked if p["kw_id"] == r["kw_id"])
        taken |= set(own)


def test_constant_similarities_give_uniform_weights(spark):
    rows = spark.createDataFrame([(1, k, f, f, 4, 0.5) for k in (0, 1) for f in range(4)], "video long, kw_id long, frame_id long, pos long, n long, sim double")
    found = selection.power_weights(selection.local_evidence(rows), 0.0).collect()
    assert [r["weight"] for r in found] == [0.5, 0.5]


def test_bucket_sizes():
    assert selection.bucket_sizes(44, (4, 8, 32)) == (4, 8)
    assert selection.bucket_sizes(3, (4, 8, 32))[0] == 1


def test_split_laws(spark):
    rows = spark.range(997).withColumnRenamed("id", "k")
    a = sampling.seeded_split(rows, 0.8, 1, "k")
    report = sampling.split_report(a, 0.8, "k").head()
    assert report["n"] == 997 and report["n_train"] == 797 and report["n_test"] == 200 and report["overlap"] == 0 and report["ratio_ok"]
    again = {r["k"] for r in sampling.seeded_split(rows.repartition(7), 0.8, 1, "k").where("is_train").collect()}
    assert again == {r["k"] for r in a.where("is_train").collect()}
    assert again != {r["k"] for r in sampling.seeded_split(rows, 0.8, 2, "k").where("is_train").collect()}


def test_resampling_edges(spark):
    rows = spark.createDataFrame([(1, 1, 0.0), (2, 10, 25.0)], "video long, n_frames long, fps double")
    assert {(r["video"], r["pos"]) for r in resample.to_fps(rows, 10.0, keys=["video"]).collect()} == {(1, 0), (2, 0), (2, 2), (2, 5), (2, 8)}
    with pytest.raises(ValueError):
        resample.to_fps(rows, 0, keys=["video"])
    assert [r["pos"] for r in resample.inclusive(rows, 1, keys=["video"]).orderBy("video").collect()] == [0, 0]
    assert [r["n_used"] for r in resample.schedule(rows, 4, keys=["video"]).orderBy("video", "round_idx").collect()] == [1, 4, 8, 10]


def test_intervals(spark):
    at = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 2.0, 59.0, 61.0, 130.0)], "video long, t double")
    seg = spark.createDataFrame([(1, 0, 1.0, 2.0, "a"), (1, 1, 1.0, 125.0, "b"), (1, 2, 5.0, 4.0, "never")], "video long, seq long, start_s double, end_s double, text string")
    found = {r["t"]: r["subtitle"] for r in intervals.match_segments(at, seg, group="video", at="t").collect()}
    assert found == {0.0: "", 1.0: "a", 2.0: "b", 59.0: "b", 61.0: "b", 130.0: ""}
    assert intervals.distinct_texts(intervals.match_segments(at, seg, group="video", at="t"), group="video", at="t").head()["subtitles"] == "a b"


def test_scoring(spark):
    rows = spark.createDataFrame(
        [("t", True, "A", " a ", None, None), ("t", True, "A", "B", None, None), ("t", False, None, None, 10.0, 8.0), ("t", False, None, None, 10.0, None)],
        "task string, is_mcq boolean, truth string, answer string, truth_number double, number double",
    )
    tallied = scoring.tally(rows, ["task"])
    assert scoring.accuracy(tallied, "mcq").head()["accuracy"] == 50.0
    assert scoring.accuracy(tallied, "numeric").head()["accuracy"] == 80.0
    assert scoring.accuracy(scoring.tally(rows, ["task"], unparsed="zero"), "numeric").head()["accuracy"] == 40.0
    assert scoring.accuracy(tallied, "all").head()["accuracy"] == 60.0
    assert scoring.accuracy(tallied, "generation").head()["accuracy"] == 0.0
    flat = spark.createDataFrame([(0.5, 1), (0.5, 0)], "p double, c int")
    assert scoring.correlation(flat, "p", "c").head()["corr"] is None
    bins = scoring.confidence_bins(spark.createDataFrame([(0.0, 1), (0.1, 0), (1.0, 1)], "prob double, correct int")).orderBy("bin").collect()
    assert [b["n"] for b in bins] == [2, 0, 0, 0, 0, 0, 0, 0, 0, 1]


def test_rounds(spark):
    rows = spark.createDataFrame([("s", 0, "A", 0.9), ("s", 1, "B", 0.9), ("s", 2, "B", 0.4), ("s", 3, "B", 0.9), ("s", 4, "B", 0.95), ("u", 0, None, None)], "s string, r long, a string, p double")
    found = {r["s"]: r["stop_round"] for r in ranking.early_stop(rows, sample="s", order="r", answer="a", prob="p", threshold=0.5, streak=2).collect()}
    assert found == {"s": 4, "u": None}


def test_lookups(spark):
    wanted = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "id long, paths array<string>")
    there = spark.createDataFrame([("y",), ("y",)], "path string")
    assert [tuple(r) for r in lookups.first_existing(wanted, there, key="id", candidates="paths", path="path").collect()] == [(1, "y")]
    state = lookups.cache_state(wanted.select("id"), spark.createDataFrame([(1, ["k"])], "id long, kws array<string>"), "id", "kws")
    with pytest.raises(LookupError):
        lookups.require_cached(state, "id")
    with pytest.raises(LookupError):
        lookups.dimension(spark.createDataFrame([("m",)], "model string"), spark.createDataFrame([("other", 1)], "model string, mode int"), "model")


# ---- rules of answers, prompts and labels


def value(spark, **columns):
    """One row whose columns are Python values."""
    return spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in columns.items()])


def test_numbers_may_have_signs_and_begin_with_a_point(spark):
    for text, wanted in [(".5", ".5"), ("+3 m", "+3"), ("-2.75", "-2.75"), ("about 12.", "12")]:
        assert value(spark, t=text).select(answers.number(F.col("t"))).head()[0] == wanted


def test_letters_only_where_there_are_options(spark):
    row = value(spark, t="a distance of 3 m")
    assert row.select(answers.parse_answer(F.col("t"), has_options=F.lit(False))).head()[0] == "3"
    assert row.select(answers.parse_answer(F.col("t"), has_options=F.lit(True))).head()[0] == "A"
    assert value(spark, t="why </think> none").select(answers.parse_answer(F.col("t"))).head()[0] == "why </think> none"


def test_choices_reach_from_a_to_f(spark):
    row = spark.createDataFrame([("I am here", ["x", "I am here"]), ("g", ["x"]), ("f", ["x"]), ("red", None)], "a string, o array<string>")
    assert [r[0] for r in row.select(answers.choice_letter(F.col("a"), F.col("o"))).collect()] == ["B", "g", "F", "red"]


def test_option_prefixes(spark):
    row = spark.createDataFrame([(["A- red", "B.", "c) green"],)], "o array<string>")
    assert row.select(answers.label_options(F.col("o"))).head()[0] == "A. red\nB. B.\nC. green"


def test_prompts(spark):
    row = spark.createDataFrame([("Why?", ["x", "y"], "one\ntwo"), ("How far?", None, " ")], "q string, o array<string>, s string")
    asked = [r[0] for r in row.select(answers.question_prompt(F.col("q"), F.col("o"))).collect()]
    assert asked == ["Why?\n\nOptions:\nA. x\nB. y\n\nDirectly answer with the option letter only. Do not explain.", "How far?\n\nPlease provide the numerical answer directly."]
    shown = [r[0] for r in row.select(answers.question_prompt(F.col("q"), F.col("o"), F.col("s"))).collect()]
    assert shown[0].startswith("This video's subtitles are listed below:\none\ntwo\n\nSelect") and shown[0].endswith("Why?\n\nOptions:\nA. x\nB. y\nThe best answer is:")
    assert "\nNo subtitles available\n" in shown[1] and shown[1].endswith("Options:\n\nThe best answer is:")
    with pytest.raises(Exception, match="blank"):
        row.select(answers.retrieval_text(F.col("q"), F.col("o"))).collect()
    pairs = spark.createDataFrame([("q", "a"), ("q", " "), (None, "a"), ("", None)], "q string, a string")
    assert [r[0] for r in pairs.select(answers.focus_query(F.col("q"), F.col("a"))).collect()] == ["Question: q\nAnswer: a", "q", "a", "What is happening in this video?"]


@pytest.mark.parametrize(
    "text,wanted",
    [('{"final_answer": 3}', 3), ("so {'final_answer': 'b'} done", 1), ('{"x": 1} {"final_answer": "option 2"} {"y": 2}', 2), ('{"final_answer": -1}', -1), ("none", None), ('{"final_answer": "9"}', None), (None, None)],
)
def test_answers_in_objects(spark, text, wanted):
    assert value(spark, t=text).select(answers.answer_index(F.col("t"))).head()[0] == wanted


def test_labels(spark):
    from framesift.functions import texts

    row = spark.createDataFrame([([3.0, 2.46, 0.0], 2.0, True, "/data/v/a.mp4", "/c/models--org--name--x/snap", "20260430_194104")], "v array<double>, w double, c boolean, p string, h string, d string")
    found = row.select(
        texts.allocation_text(F.col("v")), texts.config_label(F.col("w"), F.col("c")), texts.config_label(F.lit(0.5), ~F.col("c")), texts.relative_path(F.col("p"), "/data/"),
        texts.relative_path(F.col("p"), "/other"), texts.hub_id(F.col("h")), texts.hub_id(F.col("p")), texts.run_stamp(texts.parse_run_stamp(F.col("d"))), texts.parse_run_stamp(F.col("p")),
    ).head()
    assert tuple(found) == ("[3, 2.5, 0]", "ws=2\ncov=T", "ws=0.5\ncov=F", "v/a.mp4", "a.mp4", "org/name--x", None, "20260430_194104", None)


def test_runs_and_probabilities(spark):
    from framesift.functions import vectors

    row = spark.createDataFrame([([1, 2, 3, 2, 3], [2, 3], [-1.0, -3.0], [float("-inf"), -1.0])], "v array<int>, w array<int>, lp array<double>, bad array<double>")
    none = F.array().cast("array<int>")
    found = row.select(vectors.first_run(F.col("v"), F.col("w")), vectors.first_run(F.col("v"), F.col("w"), last=True), vectors.first_run(F.col("w"), F.col("v")), vectors.first_run(F.col("v"), none), vectors.mean_probability(F.col("lp")), vectors.mean_probability(F.col("bad"))).head()
    assert tuple(found[0]) == (1, 3) and tuple(found[1]) == (3, 5) and found[2] is None and found[3] is None
    assert found[4] == pytest.approx(0.1353352832) and found[5] == 0.0


def test_equal_moments_keep_their_rows(spark):
    from framesift.operators import intervals

    moments = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 9.0), (None, 1.0)], "video string, at_s double")
    segments = spark.createDataFrame([("a", 0, 0.5, 2.0, "hi")], "video string, seq int, start_s double, end_s double, text string")
    found = intervals.match_segments(moments, segments, group="video", at="at_s")
    assert sorted((r["at_s"], r["subtitle"]) for r in found.collect()) == [(1.0, ""), (1.0, "hi"), (1.0, "hi"), (9.0, "")]


def test_small_pools_and_ties(spark):
    from framesift.operators import scoring, selection

    assert scoring.judged_by_choices("short") and not scoring.judged_by_choices(" all ")
    sets = spark.createDataFrame([([], []), ([1, 2], [2])], "a array<int>, b array<int>")
    assert [(r["jaccard"], r["only_a"], r["only_b"]) for r in scoring.compare_sets(sets, "a", "b").collect()] == [(0.0, 0, 0), (0.5, 1, 0)]
    keywords = spark.createDataFrame([(1, k, v) for k, v in enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])], "video long, kw_id long, vec array<double>")
    assert sorted(r["kw_id"] for r in selection.cap_keywords(keywords, 2).collect()) == [1, 2]
    weights = spark.createDataFrame([(1, 0, 0.5, 3), (1, 1, 0.5, 3)], "video long, kw_id long, weight double, n long")
    assert sorted(r["quota"] for r in selection.quotas(weights, 16, pool="n").collect()) == [1, 2]
    scored = spark.createDataFrame([(1, i, i, 6, float(i)) for i in range(6)], "video long, frame_id long, pos long, n long, score double")
    assert sorted(r["scale"] for r in selection.pick_gumbel_buckets(scored, 44).collect()) == [0.25] * (6 - sum(selection.bucket_sizes(6, (4, 8, 32)))) + [0.5] * selection.bucket_sizes(6, (4, 8, 32))[1] + [1.0] * selection.bucket_sizes(6, (4, 8, 32))[0]
    assert selection.pick_recursive_segments(scored, 6).count() < 6  # a pool of just the budget is segmented too
    tallied = spark.createDataFrame([(1, 2, 0.5, 1)], "correct long, n_mcq long, mra_sum double, n_numeric long")
    assert scoring.accuracy(tallied, "short").head()["accuracy"] == 50.0


def test_intervals_of_any_length(spark):
    from framesift.operators import intervals

    rng = random.Random(8)
    segments, moments = [], []
    for i in range(60):
        start = rng.choice([rng.uniform(-500, 500), rng.uniform(0, 1e6), 60.0 * rng.randint(-3, 9)])
        segments.append(("ab"[i % 2], i, start, start + rng.choice([0.0, -5.0, 3.0, 60.0, 500.0, 1e5, 1e12, 6e8, math.inf]), f"t{i}"))
    segments += [("a", 90, math.nan, 5.0, "bad"), ("a", 91, 5.0, math.nan, "bad"), ("a", 92, None, 5.0, "bad"), ("b", 93, -math.inf, -1e300, "far")]
    for i in range(150):
        moments.append(("abc"[i % 3], rng.choice([rng.uniform(-600, 600), rng.uniform(0, 2e6), 60.0 * rng.randint(-4, 12), 9e11, 1e300, -1e300, segments[i % 60][2]])))
    at = spark.createDataFrame(moments, "video string, at_s double")
    seg = spark.createDataFrame(segments, "video string, seq int, start_s double, end_s double, text string")

    def first(video, t):
        return next((s[4] for s in segments if s[0] == video and s[2] is not None and s[2] <= t < s[3]), "")

    for slot in (60.0, 0.5):
        found = intervals.match_segments(at, seg, group="video", at="at_s", slot=slot).collect()
        assert sorted(map(tuple, found)) == sorted((v, t, first(v, t)) for v, t in moments)
    assert {r["subtitle"] for r in intervals.match_segments(at, seg.limit(0), group="video", at="at_s").collect()} == {""}
    spread = spark.range(1).select(F.explode(intervals.cells(F.lit(-7).cast("bigint"), F.lit(1000).cast("bigint"))).alias("c")).collect()
    assert sorted(x for r in spread for x in range(r["c"]["cell"] << r["c"]["level"], r["c"]["cell"] + 1 << r["c"]["level"])) == list(range(-7, 1001))
