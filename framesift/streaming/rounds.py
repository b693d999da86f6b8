"""Iterative answering over a stream of rounds: a state for each sample, ended by its early stop.

Rounds may arrive in any order and over any micro-batches; one that is ahead waits in the state for those before it. A stopped sample keeps only the fact
that it has stopped. Rows are those of operators.iterative.fold_rounds over all rounds that have arrived.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framesift.operators.iterative import LETTERS, THRESHOLD, WINDOW

OUTPUT = "sample bigint, round bigint, answer string, streak bigint, stopped boolean, hits bigint, misses bigint"
#: The state store that the processor needs, for the session's configuration.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class RoundsProcessor(StatefulProcessor):
    """State of a sample: done (rounds folded), answer, letter, streak, hits, stopped; frames seen; rounds that wait."""

    def __init__(self, streak: int = WINDOW, threshold: float = THRESHOLD):
        self.window, self.threshold = streak, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "done bigint, answer string, letter string, streak bigint, hits bigint, misses bigint, stopped boolean")
        self.seen = handle.getMapState("seen", "frame bigint", "round bigint")
        self.waiting = handle.getMapState("waiting", "round bigint", "answer string, prob double, has_options boolean, frames array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, answer, letter, streak, hits, misses, stopped = self.sums.get() if self.sums.exists() else (0, None, None, 0, 0, 0, False)
        for batch in rows:
            for r in batch.itertuples(index=False):
                if not stopped and r.round > done and not self.waiting.containsKey((int(r.round),)):
                    self.waiting.updateValue((int(r.round),), (_text(r.answer), _number(r.prob), bool(r.has_options) if not pd.isna(r.has_options) else False, [int(f) for f in r.frames] if r.frames is not None else []))
        made = []
        while not stopped and self.waiting.containsKey((done + 1,)):
            done += 1
            said, prob, has_options, frames = self.waiting.getValue((done,))
            self.waiting.removeKey((done,))
            said_letter = said.strip(" ").upper() if said is not None else None
            stable = said_letter if has_options and prob is not None and prob > self.threshold and said_letter in LETTERS else None
            streak = 0 if stable is None else streak + 1 if stable == letter else 1
            letter, answer, stopped = stable, said if said is not None else answer, streak >= self.window
            for frame in frames:
                if self.seen.containsKey((frame,)):
                    hits += 1
                else:
                    misses += 1
                    self.seen.updateValue((frame,), (done,))
            made.append((key[0], done, answer, streak, stopped, hits, misses))
        self.sums.update((done, answer, letter, streak, hits, misses, stopped))
        if stopped:
            self.seen.clear()
            self.waiting.clear()
        yield pd.DataFrame(made, columns=["sample", "round", "answer", "streak", "stopped", "hits", "misses"])

    def close(self) -> None:
        pass


def _text(value) -> str | None:
    return None if value is None or (isinstance(value, float) and pd.isna(value)) else str(value)


def _number(value) -> float | None:
    return None if value is None or pd.isna(value) else float(value)


def fold_stream(rounds: DataFrame, *, streak: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """rounds: a stream of sample, round, answer, prob, has_options, frames."""
    typed = rounds.select(rounds["sample"].cast("bigint").alias("sample"), rounds["round"].cast("bigint").alias("round"), "answer", rounds["prob"].cast("double").alias("prob"), "has_options", rounds["frames"].cast("array<bigint>").alias("frames"))
    return typed.groupBy("sample").transformWithStateInPandas(RoundsProcessor(streak, threshold), OUTPUT, "Append", "None")
