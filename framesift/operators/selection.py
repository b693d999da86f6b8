"""Budgeted frame selection. Input: scored frames (video, frame_id, pos, n, score); output: video, ord, frame_id.

Each strategy is windows and joins on the video. What is folded is one video's few keywords, never its frames' table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.draws import digest, uniform
from framesift.operators import ranking, resample

SAMPLE = "video"


def in_time_order(picked: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy(SAMPLE).orderBy(*(order or ("frame_id",)))
    return picked.select(SAMPLE, (F.row_number().over(w) - 1).cast("bigint").alias("ord"), "frame_id")


def _videos(scored: DataFrame) -> DataFrame:
    return scored.groupBy(SAMPLE).agg(F.max("n").cast("bigint").alias("n_frames"))


def _at(scored: DataFrame, places: DataFrame) -> DataFrame:
    return scored.join(places, [SAMPLE, "pos"])


def pick_uniform(scored: DataFrame, k: int) -> DataFrame:
    places = resample.uniform(_videos(scored), k, keys=[SAMPLE]).select(SAMPLE, "pos").distinct()
    return in_time_order(_at(scored, places))


def pick_random(scored: DataFrame, k: int, seed: int = 0) -> DataFrame:
    w = Window.partitionBy(SAMPLE).orderBy(digest(seed, F.col(SAMPLE), F.col("frame_id")))
    return in_time_order(scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k))


def pick_top(scored: DataFrame, k: int) -> DataFrame:
    """Best k by score, in time order."""
    return in_time_order(scored.withColumn("r", F.row_number().over(ranking.best_first())).where(F.col("r") <= k))


def pick_iterative(scored: DataFrame, step: int) -> DataFrame:
    """Rounds of the best step, 2 step, ... frames, the last of all: video, round_idx, ord, frame_id. Early stops are ranking.early_stop()."""
    rounds = resample.schedule(_videos(scored), step, keys=[SAMPLE])
    ranked = scored.withColumn("r", F.row_number().over(ranking.best_first())).select(SAMPLE, "frame_id", "r")
    w = Window.partitionBy(SAMPLE, "round_idx").orderBy("frame_id")
    used = ranked.join(rounds, SAMPLE).where(F.col("r") <= F.col("n_used"))
    return used.select(SAMPLE, "round_idx", (F.row_number().over(w) - 1).cast("bigint").alias("ord"), "frame_id")


def pick_segment_best(scored: DataFrame, k: int) -> DataFrame:
    """Best frame of each of k equal segments, cut at floor(i n / k)."""
    parts = F.least(F.lit(k).cast("bigint"), F.col("n"))
    cut = scored.withColumn("parts", parts).withColumn("segment", F.expr("((pos + 1) * parts - 1) div n"))
    w = Window.partitionBy(SAMPLE, "segment").orderBy(F.col("score").desc(), "frame_id")
    return in_time_order(cut.withColumn("r", F.row_number().over(w)).where("r = 1"))


def pick_inverse_transform(scored: DataFrame, k: int, power: float = 1.0) -> DataFrame:
    """Frames where the cumulative (score - min) / (max - min), to a power, passes k even points from 1/k to 1 - 1/k. Repeats stay."""
    scaled = ranking.min_max(scored)
    mass = scaled.withColumn("score", F.round(F.pow("scaled", F.lit(power)), 12))
    cdf = ranking.cumulative_share(mass.drop("scaled"))
    # Shifted again inside cumulative_share by a minimum that is 0 here.
    cdf = cdf.withColumn("cdf", F.round("cdf", 9))
    i = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    low, high = 1 / k, 1 - 1 / k
    points = _videos(scored).withColumn("i", i)
    points = points.withColumn("u", F.round(F.lit(low) + F.col("i") * F.lit((high - low) / max(1, k - 1)), 9))
    before = points.join(cdf.select(SAMPLE, "cdf"), SAMPLE).groupBy(SAMPLE, "i", "n_frames").agg(F.count(F.when(F.col("cdf") < F.col("u"), 1)).alias("n_before"))
    places = before.select(SAMPLE, "i", F.least("n_before", F.col("n_frames") - 1).alias("pos"))
    return in_time_order(_at(scored, places), "pos", "i")


def _segmented(scored: DataFrame, k: int, *, ratio: int, t1: float, t2: float, max_depth: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """The frames of a pool with their place (at), the pool's size (m), z, and the segment (first, last, depth, done) that they end in.

    `path` has the segments on the way there, from the whole pool down: first, last, depth, mean, top (mean of its k best), deviation, done. Levels are
    unrolled: each is windows over a video's segments, so the video's rows are exchanged once for all of them.
    """
    pool = scored.where((F.col("pos") % ratio == 0) & (F.col("pos") < F.expr(f"(n div {ratio}) * {ratio}")))
    w = Window.partitionBy(SAMPLE).orderBy("pos")
    pool = pool.withColumn("at", (F.row_number().over(w) - 1).cast("bigint")).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(SAMPLE)))
    pool = ranking.min_max(pool).withColumn("z", F.round("scaled", 9))
    kept = (SAMPLE, "frame_id", "at", "m", "z", *carry)
    empty = F.array().cast("array<struct<first:bigint,last:bigint,depth:int,mean:double,top:double,deviation:double,done:boolean>>")
    rows = pool.select(*kept, F.lit(0).cast("bigint").alias("first"), F.col("m").alias("last"), F.lit(0).alias("depth"), F.lit(False).alias("done"), empty.alias("path"))
    levels = min(max_depth, max(0, k.bit_length() - 1))
    segment = Window.partitionBy(SAMPLE, "first", "last")
    for level in range(levels + 1):
        best = F.row_number().over(segment.orderBy(F.col("z").desc(), "at"))
        rows = rows.withColumn("best", F.when(best <= k, F.col("z")))
        rows = rows.withColumn("mean", F.avg("z").over(segment)).withColumn("top", F.avg("best").over(segment)).withColumn("deviation", F.round(F.stddev_pop("z").over(segment), 9))
        stands_out = (F.round(F.col("top") - F.col("mean"), 9) > t1) & (F.col("deviation") > t2)
        open_ = ~F.col("done")
        ends = F.lit(True) if level == levels else F.col("done") | stands_out | (F.col("last") - F.col("first") < 2)
        step = F.struct("first", "last", "depth", F.round("mean", 9).alias("mean"), F.round("top", 9).alias("top"), "deviation", ends.alias("done"))
        rows = rows.withColumn("path", F.when(open_, F.concat("path", F.array(step))).otherwise(F.col("path"))).withColumn("done", ends)
        if level == levels:
            break
        middle = F.col("first") + F.expr("(last - first) div 2")
        left = F.col("at") < middle
        rows = rows.select(
            *kept,
            F.when(F.col("done") | left, F.col("first")).otherwise(middle).alias("first"),
            F.when(F.col("done") | ~left, F.col("last")).otherwise(middle).alias("last"),
            F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + 1).alias("depth"),
            "done",
            "path",
        )
    return rows.select(*kept, "first", "last", "depth", "path")


def _segment_share(rows: DataFrame, k: int, out: str) -> DataFrame:
    """rows with `out`: 1 for the frames that their segments give, null for others; a pool below k gives all."""
    segment = Window.partitionBy(SAMPLE, "first", "last")
    share = F.floor(F.lit(k) / F.pow(F.lit(2.0), "depth"))
    rows = rows.withColumn("given", F.when((F.col("m") < k) | (F.row_number().over(segment.orderBy(F.col("z").desc(), "at")) <= share), 1))
    so_far = F.count("given").over(Window.partitionBy(SAMPLE).orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.when(F.col("given").isNotNull() & (so_far <= max(k, 0)), 1)).drop("given")


def pick_recursive_segments(scored: DataFrame, k: int, *, ratio: int = 1, t1: float = 0.8, t2: float = -100.0, max_depth: int = 5) -> DataFrame:
    """Halves segments until their best frames stand out, then takes the best int(k / 2^depth) of each.

    Every ratio-th frame counts. A segment is done if (mean of its k best - mean) > t1 and its standard deviation > t2, or at
    depth min(max_depth, floor(log2 k)). So fewer than k come out where k is no power of two. A pool below k is taken whole.
    """
    rows = _segmented(scored, k, ratio=ratio, t1=t1, t2=t2, max_depth=max_depth)
    return in_time_order(_segment_share(rows, k, "picked").where("picked = 1"))


def segment_tree(scored: DataFrame, k: int, *, ratio: int = 1, t1: float = 0.8, t2: float = -100.0, max_depth: int = 5) -> DataFrame:
    """The segments that pick_recursive_segments goes through, a row each: video, depth, first, last (excluded), parent_first, parent_last,
    mean, top, deviation, done. A pool below k isn't segmented."""
    rows = _segmented(scored, k, ratio=ratio, t1=t1, t2=t2, max_depth=max_depth).where(F.col("m") >= k)
    parent = F.get("path", F.col("i") - 1)
    rows = rows.select(SAMPLE, "path", F.posexplode("path").alias("i", "node")).select(SAMPLE, "node.*", parent["first"].alias("parent_first"), parent["last"].alias("parent_last"))
    return rows.distinct()


def depth_histogram(tree: DataFrame) -> DataFrame:
    """video, depth, n: how many segments ended at each depth."""
    return tree.where("done").groupBy(SAMPLE, "depth").agg(F.count(F.lit(1)).alias("n"))


#: Eight selections: the rule, and the encoder by whose score it goes.
METHODS = {
    "uniform": ("uniform", None),
    "aks-blip": ("segments", "blip"),
    "aks-clip": ("segments", "clip"),
    "bolt-clip": ("inverse", "clip"),
    "bolt-siglip2": ("inverse", "siglip2"),
    "clip-new": ("top", "clip"),
    "blip-new": ("top", "blip"),
    "siglip2-new": ("top", "siglip2"),
}


def select_methods(scored: DataFrame, k: int, methods: dict[str, tuple[str, str | None]] | None = None, *, power: float = 1.0, **segments) -> DataFrame:
    """video, method, ord, frame_id: several selections of one pool at once, each equal to its own call.

    scored: video, frame_id, pos (all from 0 to n - 1), n, and a column score_<encoder> for each encoder. Every rule says by windows over the
    video how often it takes a frame, so the pool is read and exchanged once; only the frames taken become rows.
    """
    methods = METHODS if methods is None else methods
    rows, taken = scored, {}
    base = scored.columns
    for name, (rule, encoder) in methods.items():
        mark = f"times_{len(taken)}"
        own = [*base, *taken.values()]
        if encoder is not None:
            rows = rows.withColumn("score", F.col(f"score_{encoder}"))
        if rule == "uniform":
            i = F.expr(f"(pos * {k} + n - 1) div n")
            rows = rows.withColumn("i", i).withColumn(mark, F.when((F.col("i") < k) & (F.expr(f"(i * n) div {k}") == F.col("pos")), 1))
        elif rule == "top":
            rows = rows.withColumn(mark, F.when(F.row_number().over(ranking.best_first()) <= k, 1))
        elif rule == "inverse":
            mass = ranking.min_max(rows).withColumn("score", F.round(F.pow("scaled", F.lit(power)), 12))
            cdf = ranking.cumulative_share(mass).withColumn("cdf", F.round("cdf", 9))
            before = F.coalesce(F.lag("cdf").over(Window.partitionBy(SAMPLE).orderBy("pos")), F.lit(-1.0))
            low, high = 1 / k, 1 - 1 / k
            points = F.array(*[F.round(F.lit(low) + F.lit(i) * F.lit((high - low) / max(1, k - 1)), 9) for i in range(k)])
            rows = cdf.withColumn("before", before)
            rows = rows.withColumn(mark, F.size(F.filter(points, lambda u: (u > F.col("before")) & ((u <= F.col("cdf")) | (F.col("pos") == F.col("n") - 1)))))
        elif rule == "segments":
            settings = {"ratio": 1, "t1": 0.8, "t2": -100.0, "max_depth": 5} | segments
            rows = _segment_share(_segmented(rows, k, carry=tuple(c for c in own if c not in (SAMPLE, "frame_id")), **settings), k, mark)
        else:
            raise ValueError(f"unknown rule {rule!r}")
        taken[name] = mark
        rows = rows.select(*own, mark)
    each = F.array(*[F.struct(F.lit(name).alias("method"), F.coalesce(F.col(mark), F.lit(0)).alias("times")) for name, mark in taken.items()])
    chosen = rows.select(SAMPLE, "frame_id", F.explode(F.filter(each, lambda x: x["times"] > 0)).alias("x"))
    chosen = chosen.select(SAMPLE, "frame_id", "x.method", F.explode(F.sequence(F.lit(1), F.col("x.times"))).alias("copy"))
    w = Window.partitionBy(SAMPLE, "method").orderBy("frame_id", "copy")
    return chosen.select(SAMPLE, "method", (F.row_number().over(w) - 1).cast("bigint").alias("ord"), "frame_id")


def pick_coarse_to_fine(scored: DataFrame, k: int, *, coarse: int = 32, anchors: int = 8, local: int = 8, extras: int = 3, seed: int = 0) -> DataFrame:
    """Coarse midpoints, a window around the best of them with local midpoints and a few seeded extras, then the best k of all.

    The extras of a window come from frames that no midpoint has taken, by hash order.
    """
    first = _at(scored, resample.midpoints(_videos(scored), coarse, keys=[SAMPLE]))
    top = first.withColumn("r", F.row_number().over(ranking.best_first())).where(F.col("r") <= min(anchors, k))
    half = F.greatest(F.lit(4).cast("bigint"), F.expr(f"n div {coarse}"))
    windows = top.select(SAMPLE, F.col("pos").alias("anchor"), F.greatest(F.col("pos") - half, F.lit(0)).alias("low"), F.least(F.col("pos") + half, F.col("n") - 1).alias("high"))
    windows = windows.withColumn("size", F.col("high") - F.col("low") + 1)
    inner = windows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(local - 1))))
    s = F.col("size") / F.lit(float(local))
    inner = inner.select(SAMPLE, (F.col("low") + F.least(F.floor(F.col("i") * s + s / 2), F.col("size") - 1)).cast("bigint").alias("pos"))
    known = first.select(SAMPLE, "pos").unionByName(inner).distinct()
    free = windows.withColumn("pos", F.explode(F.sequence(F.col("low"), F.col("high")))).join(known, [SAMPLE, "pos"], "left_anti")
    w = Window.partitionBy(SAMPLE, "anchor").orderBy(digest(seed, F.col(SAMPLE), F.col("anchor"), F.col("pos")))
    drawn = free.withColumn("r", F.row_number().over(w)).where(F.col("r") <= extras).select(SAMPLE, "pos")
    return pick_top(_at(scored, known.unionByName(drawn).distinct()), k)


def pick_gumbel_buckets(scored: DataFrame, k: int, *, pool: int = 128, temperature: float = 0.8, ratio: tuple[int, int, int] = (4, 8, 32), seed: int = 0) -> DataFrame:
    """Gumbel top-k over log-softmax scores, in buckets of high, middle and low resolution: video, ord, frame_id, scale."""
    first = _at(scored, resample.inclusive(_videos(scored), pool, keys=[SAMPLE]))
    noise = -F.ln(-F.ln(uniform(seed, F.col(SAMPLE), F.col("frame_id"))))
    drawn = ranking.log_softmax(first, temperature=temperature).withColumn("key", F.round(F.col("log_prob") + noise, 9))
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy(SAMPLE).orderBy(F.col("key").desc(), "frame_id"))).where(F.col("r") <= k)
    # A pool below k is dealt to the buckets by its own size.
    sizes = [bucket_sizes(i, ratio) for i in range(k + 1)]
    have = F.least(F.count(F.lit(1)).over(Window.partitionBy(SAMPLE)), F.lit(k)).cast("int")
    high, middle = (F.get(F.array(*[F.lit(s[i]) for s in sizes]), have) for i in (0, 1))
    scale = F.when(F.col("r") <= high, 1.0).when(F.col("r") <= high + middle, 0.5).otherwise(0.25)
    w = Window.partitionBy(SAMPLE).orderBy("frame_id")
    return ranked.select(SAMPLE, (F.row_number().over(w) - 1).cast("bigint").alias("ord"), "frame_id", scale.alias("scale"))


def bucket_sizes(k: int, ratio: tuple[int, int, int]) -> tuple[int, int]:
    """Sizes of the first two buckets by largest remainder; the first has at least one."""
    whole = sum(ratio)
    floors = [k * r // whole for r in ratio]
    by_fraction = sorted(range(3), key=lambda i: (-(k * ratio[i] % whole), i))
    for i in by_fraction[: k - sum(floors)]:
        floors[i] += 1
    if k and not floors[0]:
        floors[0] = 1
        floors[floors.index(max(floors[1:]), 1)] -= 1
    return floors[0], floors[1]


# ---- keywords


def local_evidence(sims: DataFrame) -> DataFrame:
    """video, kw_id, phi: Hoyer sparsity of a keyword's similarities above their lower median, 0 to 1."""
    keys = [SAMPLE, "kw_id"]
    clamped = sims.withColumn("s", F.greatest("sim", F.lit(0.0)))
    w = Window.partitionBy(*keys)
    place, count = F.row_number().over(w.orderBy("s")), F.count(F.lit(1)).over(w)
    ranked = clamped.withColumn("place", place).withColumn("n_all", count)
    median = F.max(F.when(F.col("place") == F.expr("(n_all + 1) div 2"), F.col("s"))).over(w)
    z = ranked.withColumn("z", F.greatest(F.col("s") - median, F.lit(0.0)))
    sums = z.groupBy(*keys).agg(F.sum("z").alias("l1"), F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("l2"), F.sqrt(F.count(F.lit(1)).cast("double")).alias("root"))
    phi = F.coalesce(F.try_divide(F.col("root") - F.try_divide(F.col("l1"), F.col("l2")), F.col("root") - 1), F.lit(0.0))
    return sums.select(*keys, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), phi)), 9).alias("phi"))


def power_weights(evidence: DataFrame, strength: float) -> DataFrame:
    """phi^strength over their sum; uniform where the sum is about 0."""
    w = Window.partitionBy(SAMPLE)
    p = F.pow("phi", F.lit(float(strength)))
    share = F.when(F.sum(p).over(w) > 1e-12, p / F.sum(p).over(w)).otherwise(1.0 / F.count(F.lit(1)).over(w))
    return evidence.withColumn("weight", F.round(share, 9))


def linear_weights(evidence: DataFrame, strength: float) -> DataFrame:
    """(1 - s) uniform + s phi / sum, s cut to 0..1."""
    s = min(1.0, max(0.0, strength))
    w = Window.partitionBy(SAMPLE)
    even = 1.0 / F.count(F.lit(1)).over(w)
    informed = F.coalesce(F.try_divide(F.col("phi"), F.sum("phi").over(w)), even)
    return evidence.withColumn("weight", F.round((1 - s) * even + s * informed, 9))


def cap_keywords(keywords: DataFrame, max_keywords: int) -> DataFrame:
    """Drops the keywords most similar to another one until max_keywords are left; of equals the smaller id goes first: video, kw_id, max_sim."""
    pairs = keyword_self_similarity(keywords)
    w = Window.partitionBy(SAMPLE)
    ranked = pairs.withColumn("r", F.row_number().over(w.orderBy(F.col("max_sim").desc(), "kw_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("r") > F.col("n") - max_keywords).select(SAMPLE, "kw_id", "max_sim")


def keyword_self_similarity(keywords: DataFrame) -> DataFrame:
    """video, kw_id, max_sim to any other keyword of the video (0 if alone)."""
    from framesift.functions.vectors import dot

    a, b = keywords.alias("a"), keywords.alias("b")
    both = a.join(b, (F.col(f"a.{SAMPLE}") == F.col(f"b.{SAMPLE}")) & (F.col("a.kw_id") != F.col("b.kw_id")), "left")
    return both.groupBy(F.col(f"a.{SAMPLE}").alias(SAMPLE), F.col("a.kw_id").alias("kw_id")).agg(F.coalesce(F.max(F.round(dot(F.col("a.vec"), F.col("b.vec")), 9)), F.lit(0.0)).alias("max_sim"))


def quotas(weights: DataFrame, budget: int, *, pool: str | None = None) -> DataFrame:
    """Frames of the budget, or of a smaller pool (a column), by weight."""
    return ranking.largest_remainder(weights, F.least(F.lit(budget), F.col(pool)) if pool else budget, group=[SAMPLE], key="kw_id")


def frames_allocated(allotted: DataFrame, picked: DataFrame) -> DataFrame:
    """allotted with frames_allocated: how many frames each keyword has got (pick_by_quota)."""
    got = picked.groupBy(SAMPLE, "kw_id").agg(F.count(F.lit(1)).alias("frames_allocated"))
    return allotted.join(got, [SAMPLE, "kw_id"], "left").withColumn("frames_allocated", F.coalesce("frames_allocated", F.lit(0).cast("bigint")))


def pick_by_quota(sims: DataFrame, allotted: DataFrame, budget: int) -> DataFrame:
    """Keywords by weight each take their quota of the best frames that none before has taken: video, ord, frame_id, kw_id.

    Quotas sum to the budget and each keyword ranks all frames, so the budget is filled whenever the pool has as many. A
    keyword of rank r needs at most its best (sum of quotas so far) frames, so no more than those are gathered: the fold
    runs over a list of that length per keyword.
    """
    order = Window.partitionBy(SAMPLE).orderBy(F.col("weight").desc(), "kw_id")
    kws = allotted.withColumn("turn", F.row_number().over(order)).withColumn("reach", F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy(SAMPLE, "kw_id").orderBy(F.col("sim").desc(), "frame_id")
    near = sims.select(SAMPLE, "kw_id", "frame_id", F.row_number().over(best).alias("r"), "sim").where(F.col("r") <= budget)
    lists = near.join(kws, [SAMPLE, "kw_id"]).where(F.col("r") <= F.col("reach"))
    lists = lists.groupBy(SAMPLE, "turn", "kw_id", "quota").agg(F.array_sort(F.collect_list(F.struct("r", "frame_id"))).alias("ranked"))
    folded = lists.groupBy(SAMPLE).agg(F.array_sort(F.collect_list(F.struct("turn", "kw_id", "quota", F.col("ranked.frame_id").alias("frames")))).alias("kws"))
    start = F.array().cast("array<struct<frame_id:bigint,kw_id:bigint>>")

    def take(taken: Column, kw: Column) -> Column:
        used = F.transform(taken, lambda t: t["frame_id"])
        fresh = F.filter(kw["frames"], lambda f: ~F.array_contains(used, f))
        return F.concat(taken, F.transform(F.slice(fresh, F.lit(1), kw["quota"].cast("int")), lambda f: F.struct(f.alias("frame_id"), kw["kw_id"].alias("kw_id"))))

    taken = folded.select(SAMPLE, F.explode(F.aggregate("kws", start, take)).alias("t")).select(SAMPLE, "t.frame_id", "t.kw_id")
    w = Window.partitionBy(SAMPLE).orderBy("frame_id")
    return taken.select(SAMPLE, (F.row_number().over(w) - 1).cast("bigint").alias("ord"), "frame_id", "kw_id")


def pick_candidates(scored: DataFrame, k: int, **params) -> DataFrame:
    """As pick_coarse_to_fine, of one frame at least."""
    return pick_coarse_to_fine(scored, max(1, k), **params)


#: Selection by name: f(scored, budget) -> video, ord, frame_id.
SELECTORS = {
    "uniform": pick_uniform,
    "random": pick_random,
    "clip": pick_segment_best,
    "siglip2": pick_segment_best,
    "blip": pick_segment_best,
    "clip-new": pick_top,
    "siglip2-new": pick_top,
    "blip-new": pick_top,
    "bolt-clip": pick_inverse_transform,
    "bolt-siglip2": pick_inverse_transform,
    "aks": pick_recursive_segments,
    "aks-blip": pick_recursive_segments,
    "aks-clip": pick_recursive_segments,
    "focus": pick_coarse_to_fine,
    "sevila": pick_candidates,
    "qframe": pick_gumbel_buckets,
}


def select_frames(scored: DataFrame, method: str, budget: int, **params) -> DataFrame:
    """Selection by name."""
    if method.lower() not in SELECTORS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(sorted(SELECTORS))}")
    return SELECTORS[method.lower()](scored, budget, **params)
