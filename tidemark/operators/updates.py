"""Guarded updates of the latest state: newer windows win, corrections only grow.

For one window a count vector may be replaced by one with no smaller count;
one with no larger count is stale, an equal one changes nothing, and any
other cannot be ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class UpdateConflict(ValueError):
    """Two count vectors of one window cannot be ordered."""


def decide(old: tuple | None, new: tuple) -> str:
    """``written``, ``unchanged`` or ``stale`` for (time, counts); raises UpdateConflict."""
    if old is None:
        return "written"
    (t0, a), (t1, b) = old, new
    if set(a) != set(b):
        raise ValueError(f"count names differ: {sorted(a)} and {sorted(b)}")
    if t1 != t0:
        return "written" if t1 > t0 else "stale"
    steps = {(b[k] > a[k]) - (b[k] < a[k]) for k in a}
    if steps <= {0}:
        return "unchanged"
    if len(steps - {0}) == 1:
        return "written" if 1 in steps else "stale"
    raise UpdateConflict(f"counts of one window cannot be ordered: {a} and {b}")


def decision(old_time: Column, new_time: Column, counts: Mapping[str, tuple[Column, Column]]) -> Column:
    """The same rule on columns; ``conflict`` where the function raises."""
    same = never_less = never_more = F.lit(True)
    for a, b in counts.values():
        same, never_less, never_more = same & (a == b), never_less & (b >= a), never_more & (b <= a)
    return (
        F.when(old_time.isNull(), "written")
        .when(new_time > old_time, "written")
        .when(new_time < old_time, "stale")
        .when(same, "unchanged")
        .when(never_less, "written")
        .when(never_more, "stale")
        .otherwise("conflict")
    )


def fold(rows: Sequence[dict], stored: dict | None, names: Sequence[str]) -> tuple[dict | None, list[str]]:
    """Apply the rows of one entity in order; the state after them and each outcome."""
    outcomes = []
    for row in rows:
        new = (row["observation_time"], {n: row[n] for n in names})
        old = None if stored is None else (stored["observation_time"], {n: stored[n] for n in names})
        outcomes.append(decide(old, new))
        if outcomes[-1] == "written":
            stored = row
    return stored, outcomes


def latest_state(updates: DataFrame, keys: Sequence[str], names: Sequence[str], time: str = "observation_time") -> DataFrame:
    """The state that any order of non-conflicting updates ends in: newest window, largest counts."""
    order = [F.col(time), *(F.col(n) for n in sorted(names))]
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return updates.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def update_id(spec_name: str, version: int, keys: Sequence[str], names: Sequence[str]) -> Column:
    """SHA-256 of the canonical identity of an update: spec, version, entity, time, counts in order."""
    at = F.date_format("observation_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    parts = F.struct(F.lit(spec_name).alias("spec"), F.lit(version).alias("version"), F.struct(*keys).alias("entity"), at.alias("observation_time"), F.struct(*names).alias("counts"))
    return F.sha2(F.to_json(parts), 256)
