"""Where models plug in: encoders, pair scorers and generators as injected callables, or replayed from a table.

A callable is made once per Python worker by a factory and gets batches, so a model loads once and never per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encoder(factory: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """Column function: text or path to a vector."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            yield pd.Series(model(batch.tolist()))

    return encode


def pair_scorer(factory: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """Column function: (frame, text) to a score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for frames, queries in batches:
            yield pd.Series(model(frames.tolist(), queries.tolist()), dtype=float)

    return score


def generate(prompts: DataFrame, factory: Callable[[], Callable[[list[str]], list[str]]], *, prompt: str = "prompt", tries: int = 2) -> DataFrame:
    """prompts plus response. Equal prompts are generated once; an empty answer is asked for again, `tries` times in all."""
    distinct = prompts.select(F.md5(prompt).alias("prompt_key"), F.col(prompt).alias("asked")).dropDuplicates(["prompt_key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            said = model(batch["asked"].tolist())
            for _ in range(tries - 1):
                again = [i for i, s in enumerate(said) if not (s or "").strip()]
                if not again:
                    break
                for i, s in zip(again, model([batch["asked"].iloc[i] for i in again]), strict=True):
                    said[i] = s
            yield pd.DataFrame({"prompt_key": batch["prompt_key"], "response": said})

    answered = distinct.mapInPandas(run, "prompt_key string, response string")
    return prompts.withColumn("prompt_key", F.md5(prompt)).join(answered, "prompt_key", "left").drop("prompt_key")


def call_key(model: str, system: Column, prompt: Column) -> Column:
    """Names a call by model and messages."""
    return F.md5(F.concat_ws("\n", F.lit(model), system, prompt))


def replay_calls(calls: DataFrame, responses: DataFrame) -> DataFrame:
    """calls plus response from a table (call_key, response); null where none was recorded, the least text where several were."""
    return calls.join(responses.groupBy("call_key").agg(F.min("response").alias("response")), "call_key", "left")


def replay(prompts: DataFrame, responses: DataFrame, *, prompt: str = "prompt") -> DataFrame:
    """prompts plus response from a table (prompt_key, response); null where none was recorded."""
    return prompts.withColumn("prompt_key", F.md5(prompt)).join(responses, "prompt_key", "left").drop("prompt_key")
