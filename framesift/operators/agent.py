"""An agent that asks a model for an answer from few captions, and for more captions where it isn't sure.

Each sample starts from five captions spread over its video. The model answers, and rates its own confidence. Samples that stay below SURE go
on: the model names segments between the chosen captions, the best-scored caption inside each of them is added, and it answers again.
The last round's answer stands without a rating. A round is a step over a table of states (sample, chosen), which only holds the samples still
undecided; a decided one is never asked again. States are stored after each round, so a round's plan doesn't grow with those before.

Calls go through `ask`: a table of calls (sample, step, call_key, system, prompt) comes back with a response each. replayed() answers
from a table of recorded responses by call_key; models.generate or any other operator can stand behind it.

Defined results: samples with fewer than two captions, or null captions, have no rounds; a response without an object is answer -1 and confidence 1; answers and
ratings out of range are drawn by seed, round and sample; segments that don't exist are passed over, one named twice counts once,
one without a caption inside adds none; equal scores go to the earlier caption, null scores are last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions import answers, models
from framesift.session import stored

FIRST, SURE, ROUNDS = 5, 3, 3
SYSTEM = "You answer with one JSON object and nothing else."
Ask = Callable[[DataFrame], DataFrame]


def replayed(responses: DataFrame) -> Ask:
    """Answers calls from a table (call_key, response)."""
    return lambda calls: models.replay_calls(calls, responses)


# ---- prompts


def answer_prompt(n: Column, shown: Column, question: Column) -> Column:
    return F.concat(F.lit("A video has "), n.cast("string"), F.lit(" captioned frames. Some of them:\n"), shown, F.lit("\nQuestion: "), question, F.lit('\nReply with the index of the best answer: {"final_answer": index}'))


def judge_prompt(asked: Column, response: Column) -> Column:
    return F.concat(asked, F.lit("\nThe answer was: "), F.coalesce(response, F.lit("")), F.lit('\nRate how far the captions support it (1 hardly, 2 partly, 3 fully): {"confidence": rating}'))


def describe_prompt(asked: Column, segments: Column) -> Column:
    return F.concat(asked, F.lit("\nThese captions are not enough. Segments between them: "), segments, F.lit('\nName those worth a look: {"frame_descriptions": [{"segment_id": number, "description": text}]}'))


def shown_captions(captions: Column, chosen: Column) -> Column:
    return F.array_join(F.transform(chosen, lambda i: F.concat(F.lit("frame "), i.cast("string"), F.lit(": "), F.coalesce(F.get(captions, i - 1), F.lit("")))), "\n")


def segment_list(chosen: Column) -> Column:
    """'1: a-b, 2: b-c' for the stretches between chosen captions."""
    ends = F.transform(chosen, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x.cast("string"), F.lit("-"), F.get(chosen, i + 1).cast("string")))
    return F.array_join(F.slice(ends, 1, F.greatest(F.size(chosen) - 1, F.lit(0))), ", ")


# ---- steps


def first_captions(n: Column, count: int = FIRST) -> Column:
    """Numbers from 1 to n, count of them evenly spread and truncated, each once."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(1 + i * ((n - 1) / F.lit(float(count - 1)))).cast("int"))
    return F.array_sort(F.array_distinct(spread))


def thinned(chosen: Column, budget: int) -> Column:
    """budget of the chosen, evenly spread and truncated; all where there are no more."""
    m = F.size(chosen) - 1
    if budget == 1:
        spread = F.array(F.lit(0))
    else:
        spread = F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), lambda i: F.when(i == budget - 1, m).otherwise(F.floor(i * (m / F.lit(float(budget - 1)))).cast("int")))
    return F.when(m + 1 > budget, F.transform(spread, lambda i: F.get(chosen, i))).otherwise(chosen)


def _asked(calls: DataFrame, ask: Ask, step: str, model: str) -> DataFrame:
    """sample, response of calls sample, prompt."""
    keyed = calls.select("sample", F.lit(step).alias("step"), models.call_key(model, F.lit(SYSTEM), F.col("prompt")).alias("call_key"), F.lit(SYSTEM).alias("system"), "prompt")
    return ask(keyed).select("sample", "response")


def _answered(state: DataFrame, ask: Ask, model: str, seed: int, round_: int, last: bool) -> DataFrame:
    """state (sample, n, question, captions, chosen) -> sample, chosen, round, answer, confidence, stored."""
    calls = state.select("sample", "chosen", answer_prompt(F.col("n"), shown_captions(F.col("captions"), F.col("chosen")), F.col("question")).alias("prompt"))
    said = calls.join(_asked(calls, ask, "answer", model), "sample")
    found = said.select("sample", "chosen", F.lit(round_).alias("round"), "prompt", "response", answers.answer_or_draw(F.col("response"), seed, F.lit(f"answer{round_}"), F.col("sample")).alias("answer"))
    if last:
        return stored(found.select("sample", "chosen", "round", "answer", F.lit(None).cast("int").alias("confidence")))
    found = stored(found)
    rated = _asked(found.select("sample", judge_prompt(F.col("prompt"), F.col("response")).alias("prompt")), ask, "confidence", model)
    rated = rated.select("sample", answers.confidence(F.col("response"), seed, F.lit(f"confidence{round_}"), F.col("sample")).alias("confidence"))
    return stored(found.join(rated, "sample").select("sample", "chosen", "round", "answer", "confidence"))


def _widened(state: DataFrame, scores: DataFrame, ask: Ask, model: str) -> DataFrame:
    """state with the best captions inside the segments that the model names among the chosen. scores: sample, idx, score."""
    prompt = describe_prompt(answer_prompt(F.col("n"), shown_captions(F.col("captions"), F.col("chosen")), F.col("question")), segment_list(F.col("chosen")))
    said = _asked(state.select("sample", prompt.alias("prompt")), ask, "describe", model)
    named = F.array_distinct(F.transform(answers.descriptions(F.col("response")), lambda d: F.trim(d["segment_id"]).try_cast("int")))
    segments = state.select("sample", "chosen").join(said, "sample").select("sample", "chosen", F.explode(named).alias("segment"))
    bounds = segments.where("segment BETWEEN 1 AND size(chosen) - 1").select("sample", "segment", F.get("chosen", F.col("segment") - 1).alias("first"), F.get("chosen", F.col("segment")).alias("last"))
    inside = bounds.join(scores.select("sample", "idx", "score"), "sample").where((F.col("idx") > F.col("first")) & (F.col("idx") < F.col("last")))
    best = inside.groupBy("sample", "segment").agg(F.max(F.struct("score", (-F.col("idx")).alias("earlier"))).alias("best"))
    added = best.groupBy("sample").agg(F.collect_list((-F.col("best.earlier")).cast("int")).alias("added"))
    wider = F.array_sort(F.array_union("chosen", F.coalesce("added", F.array().cast("array<int>"))))
    return state.join(added, "sample", "left").withColumn("chosen", wider).drop("added")


def agent_rounds(samples: DataFrame, scores: DataFrame, ask: Ask, *, model: str, seed: int = 0, rounds: int = ROUNDS, sure: int = SURE) -> DataFrame:
    """A row for each round of each sample: sample, round, chosen (numbers of captions, from 1), answer, confidence (null in the last round).

    samples: sample (distinct), question, captions (array of texts).
    """
    whole = samples.select("sample", F.coalesce("question", F.lit("")).alias("question"), "captions", F.size("captions").alias("n")).where("n >= 2")
    state, found = whole.withColumn("chosen", first_captions(F.col("n"))), None
    for i in range(1, rounds + 1):
        asked = _answered(state, ask, model, seed, i, last=i == rounds)
        found = asked if found is None else found.unionByName(asked)
        undecided = asked.where(F.col("confidence") < sure)
        if i == rounds or undecided.isEmpty():
            break
        state = stored(_widened(whole.join(undecided.select("sample", "chosen"), "sample"), scores, ask, model))
    return found.select("sample", "round", "chosen", "answer", "confidence")


def pick_agent(samples: DataFrame, scores: DataFrame, ask: Ask, budget: int, **settings) -> DataFrame:
    """A row for each sample: sample, rounds, answer, chosen (at most budget captions of its last round)."""
    if budget < 1:
        raise ValueError("budget must be 1 or more")
    found = agent_rounds(samples, scores, ask, **settings)
    last = found.groupBy("sample").agg(F.max(F.struct("round", "chosen", "answer")).alias("last"))
    return last.select("sample", F.col("last.round").alias("rounds"), "last.answer", thinned(F.col("last.chosen"), budget).alias("chosen"))
