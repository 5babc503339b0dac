"""Interfaces to what can't be computed in a plan: decoding, encoding, a vision model.

A provider turns batches of rows into batches of rows and runs under mapInPandas, one
instance for each task. ``Recorded`` answers from a table, for tests and replays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

class Provider(Protocol):
    schema: str

    def answer(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def provide(rows: DataFrame, make: Callable[[], Provider], schema: str) -> DataFrame:
    """``rows`` through a provider that is made once in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            yield provider.answer(batch)

    return rows.mapInPandas(run, schema)


def recorded(rows: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with recorded answers by key; rows without one get nulls."""
    return rows.join(answers, keys, "left")


def first_success(attempts: DataFrame, item: str, attempt: str, category: str, none: str = "uncategorized") -> DataFrame:
    """One row an item: the first attempt with a category, else the last attempt."""
    good = F.col(category) != none
    rest = F.struct(*[c for c in attempts.columns if c != item])
    return attempts.groupBy(item).agg(F.coalesce(F.min_by(F.when(good, rest), F.when(good, F.col(attempt))), F.max_by(rest, F.col(attempt))).alias("_r")).select(item, "_r.*")


def cascade(attempts: DataFrame, item: str, frames: str, category: str, confidence: str, votes: DataFrame) -> DataFrame:
    """(item, category, via): of a moving picture, the answer for the most frames asked at once that has a category, else what single frames vote.

    attempts: item, frames (3, 2, 1), category, confidence; votes: item, category.
    """
    good = attempts.where(F.col(category) != "uncategorized")
    best = good.groupBy(item).agg(F.max_by(category, frames).alias("_best"), F.max(frames).alias("_frames"))
    every = attempts.select(item).unionByName(votes.select(item)).distinct()
    met = every.join(best, item, "left").join(votes.select(item, F.col(category).alias("_vote")), item, "left")
    via = F.when(F.col("_best").isNotNull(), F.concat(F.lit("frames"), F.col("_frames").cast("string"))).when(F.col("_vote").isNotNull(), "vote").otherwise("none")
    return met.select(item, F.coalesce("_best", "_vote", F.lit("uncategorized")).alias(category), via.alias("via"))
