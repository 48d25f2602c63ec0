"""Right-closed event-time windows as a native streaming aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.expressions import Compiler
from tidemark.functions.times import micros, us
from tidemark.operators.features import aggregate, with_derived
from tidemark.operators.identity import IdentityConflict
from tidemark.plans.contract import EventContract
from tidemark.plans.spec import FeatureSpec


def windowed(events: DataFrame, spec: FeatureSpec, contract: EventContract) -> DataFrame:
    """Keys, ``window_start_exclusive``, ``observation_time`` and outputs; run it in update mode.

    Spark's windows are closed on the left.  Shifted back by a microsecond,
    an event falls into the window that is closed on the right; the
    watermark is declared on the shifted column.  It waits for the delay and
    the allowed lateness, so late events correct windows until then.
    """
    spec.check(contract)
    shifted = events.withColumn("_at", F.timestamp_micros(us(F.col(contract.time)) - 1))
    wait = micros(spec.lateness["watermark_delay"]) + micros(spec.lateness["allowed"])
    marked = shifted.withWatermark("_at", f"{wait} microseconds")
    size, slide = f"{spec.size_us} microseconds", f"{micros(spec.window.slide)} microseconds"
    compiler = Compiler({c: F.col(c) for c in contract.columns}, contract.kinds())
    at = us(F.col(contract.time))
    aggs = [aggregate(a, compiler, F.lit(True), at, F.col(contract.identity)).alias(a.name) for a in spec.aggregations]
    grouped = marked.groupBy(*spec.keys, F.window("_at", size, slide).alias("_w")).agg(*aggs)
    bounds = [F.col("_w.start").alias("window_start_exclusive"), F.col("_w.end").alias("observation_time")]
    return with_derived(grouped, spec).select(*spec.keys, *bounds, *spec.outputs)


def validated(events: DataFrame, contract: EventContract) -> DataFrame:
    """The rows of a stream that satisfy the contract."""
    return events.where(F.size(contract.violations()) == 0)


def deduplicated(events: DataFrame, contract: EventContract, wait: str) -> DataFrame:
    """One row per identity within a watermark; for streams that feed no late corrections."""
    return events.withWatermark(contract.time, wait).dropDuplicatesWithinWatermark([contract.identity])


def deduplicated_for(events: DataFrame, contract: EventContract, ttl: str) -> DataFrame:
    """The first delivery of each identity; another payload within ``ttl`` of the first stops the stream.

    State is 128 bits of hash for each identity, kept for ``ttl`` of processing time.
    """
    kept = micros(ttl) // 1000
    mark = F.concat_ws(":", F.xxhash64(F.lit(1), *contract.payload), F.xxhash64(F.lit(2), *contract.payload))
    names, identity = events.columns, contract.identity

    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get[0] if state.exists else None
        for frame in frames:
            odd = set(frame["_mark"]) - {known if known is not None else frame["_mark"].iloc[0]}
            if odd:
                raise IdentityConflict(f"{identity}={key[0]} has different payloads")
            if known is None:
                known = frame["_mark"].iloc[0]
                at = frame[contract.receipt].idxmin() if contract.receipt else frame.index[0]
                yield frame.loc[[at], names]
        if not state.exists:
            state.update((known,))
            state.setTimeoutDuration(kept)

    marked = events.withColumn("_mark", mark)
    return marked.groupBy(identity).applyInPandasWithState(first, events.schema, "mark string", "append", GroupStateTimeout.ProcessingTimeTimeout)
