"""As-of joins: what had been published by an observation's time, and had not expired.

Versions and observations are sorted together by entity and time, and the
last version is carried forward.  Nothing is expanded: an entity with many
versions costs their sort, not versions times observations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import us


def as_of(
    observations: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    rank: Sequence[Column] = (),
    published: str = "published_at",
    ttl: int | None = None,
    version: int | None = None,
) -> DataFrame:
    """``observations`` (distinct) with the ``values`` in force and ``status``.

    The latest version with ``published <= t`` counts; equal times are
    ordered by ``rank``, larger later.  status: ``present``,
    ``not_published``, or ``expired`` from ``published + ttl`` on, when
    values are null.  ``version`` keeps one ``spec_version`` only.
    """
    if version is not None:
        versions = versions.where(F.col("spec_version") == version)
    obs = observations.select(*keys, "observation_time").distinct()
    end = obs.agg(F.max("observation_time")).first()[0]
    if end is not None:
        versions = versions.where(F.col(published) <= F.lit(end))  # literal, so partitions can be pruned
    ranks = [r.alias(f"_r{i}") for i, r in enumerate(rank)]
    names = [f"_r{i}" for i in range(len(rank))]
    state = F.struct(us(F.col(published)).alias("_at"), *values)
    right = versions.select(*keys, us(F.col(published)).alias("_us"), F.lit(0).alias("_kind"), *ranks, state.alias("_v"), F.lit(None).cast(obs.schema["observation_time"].dataType).alias("observation_time"))
    left = obs.select(*keys, us(F.col("observation_time")).alias("_us"), F.lit(1).alias("_kind"), *(F.lit(None).cast(right.schema[n].dataType).alias(n) for n in names), F.lit(None).cast(right.schema["_v"].dataType).alias("_v"), "observation_time")
    order = Window.partitionBy(*keys).orderBy("_us", "_kind", *names)
    both = right.unionByName(left).withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where("_kind = 1")
    dead = F.lit(False) if ttl is None else F.col("_us") >= F.col("_last._at") + ttl
    status = F.when(F.col("_last").isNull(), "not_published").when(dead, "expired").otherwise("present")
    out = both.withColumn("status", status)
    live = F.col("status") == "present"
    return out.select(*keys, "observation_time", *(F.when(live, F.col(f"_last.{v}")).alias(v) for v in values), F.when(live, F.timestamp_micros("_last._at")).alias(published), "status")


def history_start(versions: DataFrame, published: str = "published_at"):
    start = versions.agg(F.min(published)).first()[0]
    if start is None:
        raise ValueError("the history is empty")
    return start
