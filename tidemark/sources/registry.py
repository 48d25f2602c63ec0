"""A registry of stored feature views, and their materialization into online state."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import us
from tidemark.operators.asof import as_of
from tidemark.sources.files import exists, read_json, write_json

_US = timedelta(microseconds=1)


@dataclass(frozen=True)
class View:
    """A view's place, entity key, columns and how long a row stays valid."""

    name: str
    path: str
    key: str
    columns: tuple[str, ...]
    ttl: timedelta = timedelta(days=30)
    time: str = "observation_time"


class Registry:
    def __init__(self, *views: View) -> None:
        self.views = {v.name: v for v in views}

    def view(self, name: str, columns: list[str] | None = None) -> View:
        v = self.views.get(name)
        if v is None:
            raise ValueError(f"no view {name!r}; there are {sorted(self.views)}")
        odd = set(columns or ()) - set(v.columns)
        if odd:
            raise ValueError(f"{name} does not declare {sorted(odd)}")
        return v


def historical(spark: SparkSession, observations: DataFrame, view: View, columns: list[str]) -> DataFrame:
    """Observations with the view's latest row at or before their time, unless it is older than the ttl."""
    rows = spark.read.parquet(view.path)
    versions = rows.select(view.key, F.col(view.time).alias("published_at"), *columns)
    return as_of(observations, versions, [view.key], columns, ttl=view.ttl // _US + 1)


def materialize(rows: DataFrame, view: View, start: datetime, end: datetime) -> DataFrame:
    """The latest row of each entity in ``(start, end]``, with ``expires_at``: the online state."""
    t = us(F.col(view.time))
    inside = rows.where((t > us(F.lit(start))) & (t <= us(F.lit(end))))
    kept = inside.groupBy(view.key).agg(F.max_by(F.struct(view.time, *view.columns), F.col(view.time)).alias("r")).select(view.key, "r.*")
    return kept.withColumn("expires_at", F.col(view.time) + view.ttl)


def materialize_incremental(spark: SparkSession, rows: DataFrame, view: View, end: datetime, mark: str, first: datetime) -> DataFrame:
    """As ``materialize`` from where the watermark file ``mark`` stands; ``advance`` moves it after the write."""
    start = datetime.fromisoformat(json.loads(read_json(spark, mark))["until"]) if exists(spark, mark) else first
    if end <= start:
        raise ValueError("the range to materialize is empty")
    return materialize(rows, view, start, end)


def advance(spark: SparkSession, mark: str, end: datetime) -> None:
    write_json(spark, mark, {"until": end.isoformat()}, overwrite=True)
