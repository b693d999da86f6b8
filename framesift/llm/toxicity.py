r"""Toxic passages by maximum-scoring segments of token log-odds.

Training. In how many labelled texts of either class a word occurs gives its log-odds with a Dirichlet prior (Monroe, Colaresi and
Quinn): the prior's mass for a word is PRIOR, dealt to the classes by their sizes, so that a word never seen has log-odds 0 and one
seen once or twice little more. A token scores its log-odds less DRIFT; other words than those of the model score -DRIFT, so
that a clean text's running sum falls. The model has the words of positive score, the MODEL_WORDS strongest where there are more (that and MAX_CHARS
bound what is broadcast: 17 MB of characters at the very most).

Scoring. One scan over a text finds all its maximal scoring segments (Ruzzo and Tompa's linear-time algorithm, over the tokens that score).
By Karlin and Altschul, the count of segments of score s or more in m clean tokens is expected to be E = K m exp(-lambda s): lambda solves
sum p(s) exp(lambda s) = 1 over the clean tokens' scores, K fits the clean texts' best segments by extreme values (maximum
likelihood of P(best < s) = exp(-E)). Segments with E of SIGNIFICANT or less are toxic passages. A text's score is a logistic function of
-ln E of its best segment and of the sum over its KEPT best significant ones.

lambda, K and the logistic function are fitted on labelled texts whose words didn't train the log-odds (CALIBRATED of them, drawn by a
hash of the id; about CALIBRATION_ROWS at most, the only bound on rows). Counts are over all other labelled texts and run in Spark.

Words are runs of letters, lower-cased. Defined results: a null text is empty; a text without a scoring segment gets the score of
none, empty ones too; an id with several labels has the largest; null labels and ids teach nothing; repeated rows count as often as they
stand there. With nothing to learn from every score is 0; where the calibration texts are of one class the score is
SIGNIFICANT / (SIGNIFICANT + E). A null id is never held out. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import materialized, releasing, table, text_batches
from framesift.llm.langid import held_out

PRIOR = 3.0
DRIFT = 1.0
MODEL_WORDS, MAX_CHARS = 1 << 18, 64
#: One labelled text in CALIBRATED fits the statistics and not the words; of these about CALIBRATION_ROWS at most.
CALIBRATED, CALIBRATION_ROWS = 4, 20_000
SIGNIFICANT = 0.05
KEPT = 16
#: Bins of the clean tokens' scores, bounds of -ln E as a feature, and the ridge of the logistic fit.
BINS, LEAST, MOST, RIDGE = 64, -5.0, 40.0, 1.0
#: Labels that may be broadcast (some 60 bytes each); beyond it texts and labels are exchanged.
BROADCAST_LABELS = 500_000
#: Distinct words that a task counts before it hands them on, and characters cut into words at once.
WORDS_AT_ONCE, CHARS_AT_ONCE = 200_000, 1 << 20
LETTERS = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s")


def words_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text, in lists: a very long text is cut at white space, which no word holds."""
    text = text or ""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + CHARS_AT_ONCE)
        end = cut.start() if cut else len(text)
        yield LETTERS.findall(text[at:end].lower())
        at = end


def segments(hits: Iterable[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence, left to right. hits: places and scores of the tokens that score
    above 0; every other token scores -drift.

    A candidate is (sum before it, sum with it, first, last, the nearest earlier candidate with a smaller sum before it); each is
    added once and merged away at most once.
    """
    held: list[tuple[float, float, int, int, int]] = []
    total, at = 0.0, 0
    for place, score in hits:
        before = total - drift * (place - at)
        total, at = before + score, place + 1
        low, high, first, j = before, total, place, len(held) - 1
        while True:
            while j >= 0 and held[j][0] >= low:
                j = held[j][4]
            if j < 0 or held[j][1] >= high:
                break
            low, first = held[j][0], held[j][2]
            del held[j:]
            j -= 1
        held.append((low, high, first, place, j))
    return [(first, last, high - low) for low, high, first, last, _ in held]


@dataclass
class Model:
    """scores: of the words that score above 0. rate and scale: lambda and K. weights: of 1 and the two features, or None."""

    scores: dict[str, float]
    drift: float = DRIFT
    rate: float = 1.0
    scale: float = 1.0
    weights: list[float] | None = None
    significant: float = SIGNIFICANT

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]], list[float]]:
        """Tokens of a text, its segments, and the scores of its scoring tokens."""
        n, hits, known = 0, [], self.scores.get
        for words in words_of(text):
            hits += [(n + i, s) for i, s in enumerate(map(known, words)) if s is not None]
            n += len(words)
        return n, segments(hits, self.drift), [s for _, s in hits]

    def surprise(self, n: int, score: float) -> float:
        """-ln E."""
        return self.rate * score - math.log(self.scale * max(n, 1))

    def features(self, n: int, best: list[float]) -> tuple[float, float]:
        """best: scores of the best segments, at most KEPT, descending."""
        if not best:
            return LEAST, 0.0
        each = [self.surprise(n, s) for s in best]
        least = -math.log(self.significant)
        return min(MOST, max(LEAST, each[0])), math.log1p(sum(x for x in each if x >= least))

    def score(self, n: int, best: list[float]) -> float:
        if not best and (self.weights is None or not self.scores):
            return 0.0
        one, all_ = self.features(n, best)
        if self.weights is None:
            return self.significant / (self.significant + math.exp(-one))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.weights[0] + self.weights[1] * one + self.weights[2] * all_))))


def best_of(found: list[tuple[int, int, float]]) -> list[float]:
    return sorted((s for _, _, s in found), reverse=True)[:KEPT]


# ---- training


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, text, label (0 or 1) of the rows of docs that have a label."""
    own = labels.select(labels[id_col].cast("string").alias("id"), (labels[label_col].cast("double") > 0).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    own = own.groupBy("id").agg(F.max("label").alias("label"))
    if labels.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    return docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text")).join(own, "id")


def count_words(rows: DataFrame) -> DataFrame:
    """word, toxic, clean: in how many texts of either class it occurs. The null word has the sums over all words, long ones too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def told() -> pd.DataFrame:
            clean, toxic = held
            sums = [sum(toxic.values())], [sum(clean.values())]
            words = [w for w in {**toxic, **clean} if len(w) <= MAX_CHARS]
            made = pd.DataFrame({"word": [None, *words], "toxic": sums[0] + [toxic[w] for w in words], "clean": sums[1] + [clean[w] for w in words]})
            clean.clear()
            toxic.clear()
            return made

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                held[label].update(set().union(*words_of(text)))
                if len(held[0]) + len(held[1]) >= WORDS_AT_ONCE:
                    yield told()
        if held[0] or held[1]:
            yield told()

    found = text_batches(rows.select("text", "label")).mapInPandas(releasing(run), "word string, toxic long, clean long")
    return found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def word_scores(counts: DataFrame, *, prior: float = PRIOR, drift: float = DRIFT, limit: int = MODEL_WORDS) -> dict[str, float]:
    """The words of positive score, the strongest `limit` (equal ones by code point). counts is stored."""
    sums = counts.where("word IS NULL").collect()  # one row
    if not sums or not sums[0]["toxic"] or not sums[0]["clean"]:
        return {}
    n = {c: float(sums[0][c]) for c in ("toxic", "clean")}
    vocabulary = counts.where("word IS NOT NULL").count()
    share = {c: n[c] / sum(n.values()) for c in n}

    def logit(c: str):
        y = F.col(c) + prior * share[c]
        return F.log(y / (n[c] + prior * vocabulary * share[c] - y))

    scored = counts.where("word IS NOT NULL").select("word", (logit("toxic") - logit("clean") - drift).alias("score")).where("score > 0")
    return {r["word"]: r["score"] for r in scored.orderBy(F.desc("score"), "word").limit(limit).collect()}


def solve_rate(tokens: np.ndarray, values: np.ndarray) -> float:
    """The positive root of sum p exp(rate * value) = 1; the mean of value is below 0 and some value above."""
    p = tokens / tokens.sum()
    if float(p @ values) >= 0:
        return 1e-3  # scores that rise in clean texts tell nothing
    low, high = 0.0, 1.0
    while float(p @ np.exp(np.minimum(high * values, 700.0))) < 1:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if float(p @ np.exp(middle * values)) < 1 else (low, middle)
    return high


def fit_logistic(features: np.ndarray, label: np.ndarray, ridge: float = RIDGE) -> list[float]:
    """Newton's steps on the ridge-penalised likelihood."""
    x = np.column_stack([np.ones(len(features)), features])
    penalty, w = np.diag([1e-6, ridge, ridge]), np.zeros(3)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - z @ label + w @ penalty @ w / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (label - p) - penalty @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w.tolist()


def calibrate(model: Model, rows: DataFrame) -> Model:
    """model with rate, scale and weights fitted on rows (text, label), which are few."""
    top = max(model.scores.values(), default=0.0)
    if not top:
        return model
    width = top / (BINS - 1)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            made = []
            for text, label in zip(batch["text"], batch["label"], strict=True):
                n, found, scores = model.scan(text)
                bins = np.bincount(np.ceil(np.array(scores) / width).astype(int), minlength=BINS).tolist() if scores and not label else []
                made.append((label, n, best_of(found), bins))
            yield pd.DataFrame(made, columns=["label", "n", "best", "bins"])

    drawn = text_batches(rows.select("text", "label")).mapInPandas(releasing(run), "label int, n long, best array<double>, bins array<long>").collect()
    clean = [r for r in drawn if not r["label"]]
    bins = np.zeros(BINS)
    for r in clean:
        if r["bins"]:
            bins += np.array(r["bins"][:BINS], dtype=float)
    # One token more, of the highest score: a word that no drawn clean text holds may still stand in another.
    bins[BINS - 1] += 1
    others = max(1.0, sum(r["n"] for r in clean) + 1 - bins.sum())
    model.rate = solve_rate(np.append(bins, others), np.append(np.arange(BINS) * width, -model.drift))
    spread = sum(r["n"] * math.exp(-model.rate * max(r["best"], default=0.0)) for r in clean)
    model.scale = len(clean) / spread if spread > 0 else 1.0
    label = np.array([r["label"] for r in drawn], dtype=float)
    if 0 < label.sum() < len(label):
        model.weights = fit_logistic(np.array([model.features(r["n"], r["best"]) for r in drawn]), label)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float = PRIOR, drift: float = DRIFT, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Fits a model on the rows of docs that labels names."""
    rows = labelled(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    drawn = F.pmod(F.xxhash64("id"), F.lit(CALIBRATED)) == 0
    counts = materialized(count_words(rows.where(~drawn)))
    model = Model(word_scores(counts, prior=prior, drift=drift), drift)
    named = labels.select(labels[id_col].cast("string").alias("id")).where(drawn).count()
    share = min(1.0, calibration_rows / max(named, 1))
    return calibrate(model, rows.where(drawn & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) < share * 1_000_003)))


# ---- scoring


def find_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a column `out`: struct(score, passages); a passage is a significant segment: first and last word (from 0), score, e_value."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "score double, passages array<struct<first:long,last:long,score:double,e_value:double>>"

    @F.pandas_udf(kind)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        least = -math.log(model.significant)
        for texts in batches:
            made = []
            for text in texts:
                n, found, _ = model.scan(text)
                passages = [(first, last, s, math.exp(-x)) for first, last, s in found if (x := model.surprise(n, s)) >= least]
                made.append((model.score(n, best_of(found)), [dict(zip(("first", "last", "score", "e_value"), p, strict=True)) for p in passages]))
            yield pd.DataFrame(made, columns=["score", "passages"])

    return text_batches(docs).withColumn(out, judge(docs[text_col].cast("string")))


def query(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(docs["doc_id"])
    model = train(docs.where(~out), labels)
    found = find_toxic(docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "toxicity.score", (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.size("toxicity.passages").alias("n_passages"))
