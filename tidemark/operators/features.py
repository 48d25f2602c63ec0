"""Feature values of many entities at many times, each over ``(t - size, t]``.

Events and observations meet on the entity keys and on a time bucket as
long as the window: an event can matter only to its own bucket and the next,
so an entity's whole history never meets all of its observations.  The
range itself is a condition of the left join; observations without events
survive with their empty values.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import FILTER_NODES, Compiler, names_in
from tidemark.functions.times import us, window_end
from tidemark.operators.identity import first_delivery, require_no_conflict
from tidemark.plans.contract import EventContract
from tidemark.plans.spec import Aggregation, FeatureSpec


_US = timedelta(microseconds=1)


def aggregate(a: Aggregation, compiler: Compiler, present: Column, time: Column, identity: Column) -> Column:
    """One aggregation over the rows where ``present`` holds; missing is never zero but for counts and sums."""
    if a.filter:
        present = present & compiler.predicate(a.filter)
    if a.op == "count":
        return F.count(F.when(present, 1))
    value = F.when(present, compiler.columns[a.column])
    match a.op:
        case "sum":
            return F.coalesce(F.sum(value), F.lit(0))
        case "avg":
            return F.avg(value)
        case "min":
            return F.min(value)
        case "max":
            return F.max(value)
        case "approx_distinct":
            # Exact; null counts as one more value.
            return F.count_distinct(value) + F.max(F.when(present & compiler.columns[a.column].isNull(), 1).otherwise(0))
        case _:
            # Ordered by time, then by the identity as text; the array holds one window's events.
            row = F.when(present, F.struct(time.alias("t"), identity.cast("string").alias("i"), compiler.columns[a.column].alias("v")))
            ordered = F.sort_array(F.collect_list(row))
            tail = F.slice(ordered, F.greatest(F.size(ordered) - a.k + 1, F.lit(1)), F.lit(a.k))
            return F.transform(tail, lambda x: x["v"])


def with_derived(frame: DataFrame, spec: FeatureSpec) -> DataFrame:
    compiler = Compiler({a.name: F.col(a.name) for a in spec.aggregations})
    return frame.select("*", *(compiler.value(text).alias(name) for name, text in spec.derived.items()))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], size: int, after: bool = False) -> DataFrame:
    """Left join of observations (``_t``) with events (``_us``) by keys and ``(t - size, t]``, or ``(t, t + size]``."""
    bucket = F.floor(F.col("_us") / size)
    spread = F.explode(F.array(bucket, bucket - 1 if after else bucket + 1))
    events = right.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in right.columns if c not in keys), spread.alias("_b"))
    inside = (F.col("_us") > F.col("_t")) & (F.col("_us") <= F.col("_t") + size) if after else (F.col("_us") > F.col("_t") - size) & (F.col("_us") <= F.col("_t"))
    on = inside & (F.col("_ob") == F.col("_b"))
    for k in keys:
        on &= F.col(k) == F.col(f"_k_{k}")
    return left.withColumn("_ob", F.floor(F.col("_t") / size)).join(events, on, "left")


def point_in_time(events: DataFrame, observations: DataFrame, spec: FeatureSpec, contract: EventContract, checked: bool = False) -> DataFrame:
    """Keys, ``observation_time`` and the spec's outputs, one row per row of ``observations``.

    checked: the caller has tested identities already.  Observations that
    repeat are evaluated once and given back as often as they came.
    """
    spec.check(contract)
    if not checked:
        require_no_conflict(events, contract)
    unique = first_delivery(events, contract)
    used = sorted({contract.time, contract.identity, *(a.column for a in spec.aggregations if a.column), *_filter_names(spec)} - set(spec.keys))
    unique = unique.select(*spec.keys, *used, us(F.col(contract.time)).alias("_us"))
    obs = observations.groupBy(*spec.keys, "observation_time").agg(F.count(F.lit(1)).alias("_n")).withColumn("_t", us(F.col("observation_time")))
    joined = range_join(obs, unique, spec.keys, spec.size_us)
    # Keys are equal on both sides, so filters may read either.
    compiler = Compiler({c: F.col(c) for c in [*spec.keys, *used]}, contract.kinds())
    present, time, identity = F.col("_us").isNotNull(), F.col("_us"), F.col(contract.identity)
    aggs = [aggregate(a, compiler, present, time, identity).alias(a.name) for a in spec.aggregations]
    values = joined.groupBy(*spec.keys, "observation_time", "_n").agg(*aggs)
    out = with_derived(values, spec).withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return out.select(*spec.keys, "observation_time", *spec.outputs)


def _filter_names(spec: FeatureSpec) -> set[str]:
    return set().union(*(names_in(a.filter, FILTER_NODES) for a in spec.aggregations if a.filter))


def sliding_windows(events: DataFrame, spec: FeatureSpec, contract: EventContract) -> DataFrame:
    """Keys, ``window_end`` and outputs of every slide's window that holds an event (counts and sums).

    Events are counted once into panes as long as the slide; a window is the
    sum of its panes, so an event is never copied into size/slide windows.
    """
    if any(a.op not in ("count", "sum") for a in spec.aggregations):
        raise ValueError("panes add up counts and sums only")
    slide, size = spec.window.slide // _US, spec.size_us
    compiler = Compiler({c: F.col(c) for c in contract.columns}, contract.kinds())
    at = us(F.col(contract.time))
    rows = events.withColumn("_end", window_end(at, slide))
    aggs = [aggregate(a, compiler, F.lit(True), at, F.col(contract.identity)).alias(a.name) for a in spec.aggregations]
    panes = rows.groupBy(*spec.keys, "_end").agg(*aggs)
    # A pane is in the windows that end with it and with the size/slide - 1 slides after it.
    ends = F.explode(F.sequence(F.col("_end"), F.col("_end") + size - slide, F.lit(slide)))
    sums = panes.select(*spec.keys, ends.alias("_w"), *(a.name for a in spec.aggregations)).groupBy(*spec.keys, "_w")
    return with_derived(sums.agg(*(F.sum(a.name).alias(a.name) for a in spec.aggregations)), spec).withColumn("window_end", F.timestamp_micros("_w")).drop("_w")


def trailing(events: DataFrame, keys: list[str], value: Column, size: int, contract: EventContract) -> DataFrame:
    """Each event with the sum and count of ``value`` over its own trailing window, by a range frame and no join."""
    w = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-size + 1, 0)
    timed = events.withColumn("_us", us(F.col(contract.time)))
    return timed.withColumn("trailing_count", F.count(value).over(w)).withColumn("trailing_sum", F.coalesce(F.sum(value).over(w), F.lit(0.0))).drop("_us")



