"""Data-quality reports: each is one aggregation with a condition per check."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def report(frame: DataFrame, checks: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Rows that break each check (named column), with ``n_rows``; per group if ``by``."""
    counts = [F.count(F.when(bad, 1)).alias(name) for name, bad in checks.items()]
    return frame.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_rows"), *counts)


def unknown_references(frame: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """(``n_unknown``): non-null references that ``known`` lacks."""
    refs = frame.where(F.col(column).isNotNull()).select(F.col(column).alias("_ref"))
    return refs.join(known.select(F.col(key).alias("_ref")).distinct(), "_ref", "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))


def duplicated_rows(frame: DataFrame, keys: list[str]) -> DataFrame:
    """(``n_rows``): all rows whose key comes more than once."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


@dataclass(frozen=True)
class FeatureView:
    """What a stored feature view must look like."""

    name: str
    key: str
    counts: tuple[str, ...]
    total: str
    parts: tuple[str, ...]
    unique: str
    recency: str


# Names and columns of the two stored views.
USER_VIEW = FeatureView(
    "user_engagement_features", "user_id",
    ("event_count", "unique_content_count", "total_watch_seconds", "search_count", "play_count", "watch_count"),
    "event_count", ("search_count", "play_count", "watch_count"), "unique_content_count", "days_since_last_activity",
)
CONTENT_VIEW = FeatureView(
    "content_popularity_features", "content_id",
    ("view_count", "unique_viewer_count", "total_watch_seconds", "average_watch_seconds", "search_count", "play_count", "watch_count"),
    "view_count", ("search_count", "play_count", "watch_count"), "unique_viewer_count", "days_since_last_view",
)


def check_view(frame: DataFrame | None, view: FeatureView) -> list[tuple[str, str, bool, str]]:
    """(partition, check, passed, detail) of each partition ``observation_date``.

    ``frame`` is None if the view's folder does not exist.  Checks of the
    schema stop what depends on them; all row checks are one aggregation.
    """
    if frame is None:
        return [("", "exists", False, f"{view.name} is not there")]
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    need = [view.key, "observation_time", "window_days", *view.counts, view.recency]
    missing = [c for c in need if c not in kinds]
    if missing:
        return [("", "columns", False, f"missing {missing}")]
    odd = [c for c in (*view.counts, view.recency, "window_days") if not isinstance(kinds[c], T.NumericType)]
    rows = [("", "columns", True, ""), ("", "numeric", not odd, str(odd) if odd else ""), ("", "utc", isinstance(kinds["observation_time"], T.TimestampType), "")]
    if odd:
        return rows
    c = F.col
    key_text = c(view.key).cast("string")
    checks = {
        "keys": c(view.key).isNull() | (F.trim(key_text) == ""),
        "observation_time": c("observation_time").isNull(),
        "window_days": c("window_days").isNull() | (c("window_days") <= 0),
        "values": sum((c(m).isNull().cast("int") for m in view.counts), F.lit(0)) > 0,
        "non_negative": sum(((c(m) < 0).cast("int") for m in view.counts), F.lit(0)) > 0,
        "recency": c(view.recency) < 0,
        "parts_within_total": sum((c(p) for p in view.parts), F.lit(0)) > c(view.total),
        "unique_within_total": c(view.unique) > c(view.total),
    }
    span = [f(n).alias(f"{a}_{n}") for n in ("observation_time", "window_days") for a, f in (("min", F.min), ("max", F.max))]
    counted = frame.groupBy("observation_date").agg(F.count(F.lit(1)).alias("n_rows"), *span, *(F.count(F.when(b, 1)).alias(k) for k, b in checks.items()))
    twice = frame.groupBy("observation_date", view.key, "observation_time").count().where("count > 1").groupBy("observation_date").agg(F.sum("count").alias("unique"))
    found = counted.join(twice, "observation_date", "left").orderBy("observation_date").collect()  # one row a partition
    if not found:
        return [*rows, ("", "partitions", False, "no partition holds a row")]
    for r in found:
        at = str(r.observation_date)
        rows += [(at, k, r[k] == 0, f"{r[k]} rows") for k in checks]
        rows.append((at, "unique", not r["unique"], f"{r['unique'] or 0} rows"))
        rows += [(at, f"single_{n}", r[f"min_{n}"] == r[f"max_{n}"], "") for n in ("observation_time", "window_days")]
    return rows


def passed(rows: list[tuple[str, str, bool, str]]) -> bool:
    return all(ok for _, _, ok, _ in rows)


def freshness(newest: date | None, now: datetime, max_lag_days: float) -> tuple[bool, float | None]:
    """Whether the newest partition is fresh, and its lag in days; none and future ones are not."""
    if newest is None:
        return False, None
    lag = (now - datetime(newest.year, newest.month, newest.day, tzinfo=timezone.utc)).total_seconds() / 86400
    return 0 <= lag <= max_lag_days, lag


@dataclass(frozen=True)
class Expected:
    """What a generated dataset was asked to hold."""

    base_events: int
    duplicate_rate: float
    late_rate: float
    labels: int

    @property
    def duplicates(self) -> int:
        return int(self.base_events * self.duplicate_rate)

    @property
    def events(self) -> int:
        return self.base_events + self.duplicates

    @property
    def late(self) -> int:
        return int(self.events * self.late_rate)


def dataset_report(users: DataFrame, content: DataFrame, events: DataFrame, labels: DataFrame, expected: Expected) -> DataFrame:
    """One row: sizes, counts of what breaks each rule, what was expected, and ``passed``.

    Events: known users; known items but for searches, which have none; watched
    seconds above zero for play and watch and zero otherwise; received no
    earlier than they happened, and later if marked late.  Labels: known
    users, windows that end after they begin.  Four counts must be as expected.
    """
    c = F.col
    watched = c("event_type").isin("play", "watch")
    search = c("event_type") == "search"
    known_users = users.select(c("user_id").alias("_u")).distinct()
    known_items = content.select(c("content_id").alias("_c")).distinct()
    marked = events.join(known_users, c("user_id") == c("_u"), "left").join(known_items, c("content_id") == c("_c"), "left")
    rules = {
        "unknown_event_users": c("_u").isNull(),
        "unknown_event_content": ~search & c("_c").isNull(),
        "searches_with_content": search & c("content_id").isNotNull(),
        "wrong_watch_seconds": (watched & (c("watch_seconds") <= 0)) | (~watched & (c("watch_seconds") != 0)),
        "received_before_event": c("ingested_at") < c("event_time"),
        "late_without_delay": c("is_late") & (c("ingested_at") <= c("event_time")),
    }
    counted = marked.agg(
        F.count(F.lit(1)).alias("event_count"), F.count(F.when(c("is_duplicate"), 1)).alias("duplicate_count"), F.count(F.when(c("is_late"), 1)).alias("late_event_count"),
        *(F.count(F.when(bad, 1)).alias(name) for name, bad in rules.items()),
    )
    of_labels = labels.join(known_users, c("user_id") == c("_u"), "left").agg(
        F.count(F.lit(1)).alias("label_count"), F.count(F.when(c("_u").isNull(), 1)).alias("unknown_label_users"),
        F.count(F.when(c("label_window_end") <= c("observation_time"), 1)).alias("empty_label_windows"),
    )
    sizes = users.agg(F.count(F.lit(1)).alias("user_count")).join(content.agg(F.count(F.lit(1)).alias("content_count")))
    wanted = {"duplicate_count": expected.duplicates, "late_event_count": expected.late, "event_count": expected.events, "label_count": expected.labels}
    # Every side of these joins is one row.
    out = sizes.join(counted).join(of_labels)
    for name, n in wanted.items():
        out = out.withColumn(f"expected_{name}", F.lit(n).cast("long")).withColumn(f"{name}_matches", c(name) == n)
    good = F.lit(True)
    for name in (*rules, "unknown_label_users", "empty_label_windows"):
        good &= c(name) == 0
    for name in wanted:
        good &= c(f"{name}_matches")
    return out.withColumn("passed", good)
