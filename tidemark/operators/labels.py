"""Labels over ``(t, t + horizon]``; observations whose horizon is not over are left out and counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import FILTER_NODES, Compiler, names_in
from tidemark.functions.times import micros, us
from tidemark.operators.features import range_join
from tidemark.operators.identity import first_delivery, require_no_conflict
from tidemark.plans.contract import EventContract
from tidemark.plans.spec import LabelSpec


@dataclass
class Labels:
    """``values``: one row per complete observation; ``observations`` splits into complete and not."""

    values: DataFrame
    complete: DataFrame
    incomplete: DataFrame

    def excluded(self) -> int:
        return self.incomplete.count()


def invalid_observations(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a time, or with a null, empty or spaced key."""
    bad = F.col("observation_time").isNull()
    for k in keys:
        text = F.col(k).cast("string")
        bad |= F.col(k).isNull() | (text == "") | text.rlike(r"\s")
    return observations.where(bad)


def label(events: DataFrame, observations: DataFrame, spec: LabelSpec, contract: EventContract, data_end: Column, checked: bool = False) -> Labels:
    """``value`` (true or a count) and ``observable_at`` of each observation with ``t + horizon <= data_end``.

    ``data_end`` is a literal: until when events are known to be complete.
    """
    spec.check(contract)
    if not checked:
        require_no_conflict(events, contract)
    if invalid_observations(observations, spec.keys).limit(1).count():
        raise ValueError("an observation has no time, or a null, empty or spaced key")
    horizon = micros(spec.horizon)
    timed = observations.withColumn("_t", us(F.col("observation_time")))
    whole = F.col("_t") + horizon <= us(data_end)
    complete, rest = timed.where(whole), timed.where(~whole)
    text = spec.outcome.get("filter")
    used = sorted({contract.time, *(names_in(text, FILTER_NODES) if text else ())} - set(spec.keys))
    unique = first_delivery(events, contract).select(*spec.keys, *used, us(F.col(contract.time)).alias("_us"))
    obs = complete.groupBy(*spec.keys, "observation_time", "_t").agg(F.count(F.lit(1)).alias("_n"))
    joined = range_join(obs, unique, spec.keys, horizon, after=True)
    hit = F.col("_us").isNotNull()
    if text:
        hit &= Compiler({c: F.col(c) for c in [*spec.keys, *used]}, contract.kinds()).predicate(text)
    n = F.count(F.when(hit, 1))
    value = (n > 0 if spec.outcome["op"] == "exists" else n).alias("value")
    out = joined.groupBy(*spec.keys, "observation_time", "_t", "_n").agg(value)
    out = out.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    seen = F.timestamp_micros(F.col("_t") + horizon).alias("observable_at")
    return Labels(out.select(*spec.keys, "observation_time", "value", seen), complete.drop("_t"), rest.drop("_t"))
