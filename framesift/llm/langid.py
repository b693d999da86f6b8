r"""Language identification by word-first backoff.

A known word scores its log frequency in each language. A word that training hasn't seen is scored by its
character n-grams instead: at each place the longest n-gram ending there that training has seen, from MAX_GRAM
characters down to one. A document's language is the one with the largest sum over its words.

Training counts words over a sample of labelled rows: about SAMPLE_ROWS of each language, drawn by a hash
of the id, all rows where there are fewer. Every word of the sample is in the model, and
n-grams are counted over those words; beyond MODEL_WORDS pairs of a word and a language the commonest ones are. That and MAX_CHARS bound what
comes to the driver and is broadcast (some 200 MB at the very most), whatever the texts are. Words are runs of letters (\p{L}), lower-cased, in training and in prediction.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text if there is nothing
to learn from; rows without lang or text teach nothing; more than MAX_LANGUAGES languages are an error, since that column names none; equal sums go to the language first by code point; a
null id is never held out; repeated rows are rows of their own. An empty table gives an empty result. Extra columns
are ignored, and whatever their names, only the text is read for a prediction.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm.common import materialized, release_memory, text_batches

SAMPLE_ROWS = 1_000
MAX_LANGUAGES = 1_000
MODEL_WORDS, MAX_CHARS = 1 << 20, 64
MAX_GRAM = 5
UNDETERMINED = "und"
SMOOTHING = 0.5
#: An unseen word's n-gram scores count for as much as this many words' worth of evidence.
GRAM_WEIGHT = 1.5
#: Words after which more text doesn't make the score surer.
SURE_WORDS = 10
#: Unseen words whose n-grams a task keeps, and n-grams that are summed at once.
CACHE, AT_ONCE = 1 << 16, 1 << 18
#: Letters, and what else Python takes for them (Roman numerals, fractions), which count_words takes out.
LETTERS = re.compile(r"[^\W\d_]+")


def count_words(text: str | None) -> Counter:
    """Lower-cased runs of letters and their counts."""
    words = Counter(LETTERS.findall((text or "").lower()))
    for word in [w for w in words if not w.isalpha()]:
        n = words.pop(word)
        for letters, run in groupby(word, str.isalpha):
            if letters:
                words["".join(run)] += n
    return words


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Word and n-gram scores, a row for each entry, a column for each language."""

    def __init__(self, counts: dict[str, dict[str, int]], totals: dict[str, int], max_gram: int = MAX_GRAM):
        """counts: word -> language -> count. totals: language -> count of all its words in the sample."""
        self.languages = sorted(totals)
        self.max_gram = max_gram
        at = {lang: i for i, lang in enumerate(self.languages)}
        n, L = len(counts), len(self.languages)
        self.words = {w: i for i, w in enumerate(counts)}
        table = np.full((n, L), SMOOTHING)
        grams: dict[str, list[float]] = defaultdict(lambda: [0.0] * L)
        for w, by in counts.items():
            marked = f"^{w}$"
            for lang, c in by.items():
                table[self.words[w], at[lang]] += c
                weight = math.log1p(c)  # rare words shape unseen ones as much as common ones do
                for size in range(1, max_gram + 1):
                    for i in range(len(marked) - size + 1):
                        if (gram := marked[i : i + size]) not in "^$":
                            grams[gram][at[lang]] += weight
        size = np.array([totals[lang] for lang in self.languages], dtype=float) + SMOOTHING * (n + 1)
        self.scores = np.log(table / size)
        self.grams = {g: i for i, g in enumerate(grams)}
        found = np.array(list(grams.values()), dtype=float).reshape(len(grams), L)
        of_size = np.array([len(g) for g in grams], dtype=int)
        self.gram_scores = np.zeros((len(grams), L))
        for s in range(1, max_gram + 1):
            own = of_size == s
            self.gram_scores[own] = np.log((found[own] + SMOOTHING) / (found[own].sum(axis=0) + SMOOTHING * max(1, own.sum())))
        self.cache: dict[str, list[int]] = {}

    def backoff(self, word: str) -> list[int]:
        """For each place of an unseen word the longest known n-gram ending there, as rows of gram_scores."""
        if (kept := self.cache.get(word)) is not None:
            return kept
        marked, rows, grams, size = f"^{word}$", [], self.grams, self.max_gram
        for end in range(2, len(marked) + 1):
            for start in range(max(0, end - size), end):
                if (at := grams.get(marked[start:end])) is not None:
                    rows.append(at)
                    break
        if len(word) <= 40:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = rows
        return rows

    def sums(self, words: Counter) -> np.ndarray:
        """Each language's score: of known words their log frequency, of others the mean over their places times GRAM_WEIGHT, as often as they occur."""
        total = np.zeros(len(self.languages))
        known, counts, grams, weights = [], [], [], []
        for word, n in words.items():
            if (at := self.words.get(word)) is not None:
                known.append(at)
                counts.append(n)
            elif rows := self.backoff(word):
                grams += rows
                weights += [n / len(rows)] * len(rows)
                if len(grams) >= AT_ONCE:
                    total += GRAM_WEIGHT * (np.array(weights) @ self.gram_scores[grams])
                    grams, weights = [], []
        if grams:
            total += GRAM_WEIGHT * (np.array(weights) @ self.gram_scores[grams])
        if known:
            total += np.array(counts, dtype=float) @ self.scores[known]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        words = count_words(text)
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        total, n = self.sums(words), sum(words.values())
        best = int(total.argmax())
        sure = np.exp((total - total[best]) * (min(n, SURE_WORDS) / n))
        return self.languages[best], float(1 / sure.sum())


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, model_words: int = MODEL_WORDS) -> Model:
    """Fits a model on labelled rows; counts run in Spark, those of the model's words come to the driver."""
    rows = labelled.select(labelled[id_col].cast("string").alias("id"), labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}  # a row for each language
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values; it doesn't name languages")
    share = F.try_element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_rows / n))]), F.col("lang")) if sizes else F.lit(0.0)
    drawn = rows.where((F.xxhash64("id") % 1_000_003 + 1_000_003) % 1_000_003 < share * 1_000_003)
    words = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    totals: Counter = Counter()
    counted = materialized(words.groupBy("lang", "word").agg(F.count("*").alias("n")))
    for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect():  # a row for each language
        totals[r["lang"]] = r["n"]
    kept = counted.where(F.char_length("word") <= MAX_CHARS)
    if kept.count() > model_words:
        kept = kept.orderBy(F.desc("n"), "lang", "word").limit(model_words)
    for r in kept.coalesce(4).toLocalIterator():
        counts[r["word"]][r["lang"]] = r["n"]
    return Model(dict(sorted(counts.items())), dict(totals))


def predictor(spark: SparkSession, model: Model):
    """A column function: text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])
        model.cache.clear()  # workers outlive tasks
        release_memory()

    return predict


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a column `out`: struct(lang_pred, score). Each row on its own; nothing is exchanged."""
    return text_batches(docs).withColumn(out, predictor(docs.sparkSession, model)(docs[text_col].cast("string")))


def query(spark, sf_dir):
    from framesift.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(docs["doc_id"])))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), "text")
    found = identify(rows, model)
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score")
