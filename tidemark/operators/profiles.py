"""Engagement and popularity profiles: fixed measures over trailing days, zero-filled for every entity.

All dates are one job: entities meet the dates, events meet the window of
each date, one aggregation follows.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import us

_DAY = 86_400_000_000


def dates(spark, first: date, last: date) -> DataFrame:
    """(``observation_date``, ``_t``): both ends included, at UTC midnight."""
    if last < first:
        raise ValueError("the last date is before the first")
    days = F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("observation_date")
    return spark.range(1).select(days).withColumn("_t", us(F.col("observation_date").cast("timestamp")))


def profile(
    events: DataFrame,
    entities: DataFrame,
    key: str,
    days: DataFrame,
    window_days: int,
    measures: dict[str, Column],
    time: str,
    recency: str,
) -> DataFrame:
    """Every entity at every date: ``measures`` over ``(t - window, t]`` (nothing counts as 0) and days since the last event (null if none).

    An event is dealt to the at most ``window_days`` dates whose window holds
    it before anything is joined.
    """
    if window_days < 1:
        raise ValueError("window_days must be positive")
    timed = events.where(F.col(key).isNotNull()).withColumn("_us", us(F.col(time)))
    low, high = days.agg(F.min("_t"), F.max("_t")).first()
    timed = timed.where((F.col("_us") > low - window_days * _DAY) & (F.col("_us") <= high))
    first = F.col("_us") + F.pmod(-F.col("_us"), F.lit(_DAY))
    ends = F.sequence(F.greatest(first, F.lit(low)), F.least(first + (window_days - 1) * _DAY, F.lit(high)), F.lit(_DAY))
    dealt = timed.where(F.greatest(first, F.lit(low)) <= F.least(first + (window_days - 1) * _DAY, F.lit(high))).withColumn("_t", F.explode(ends))
    made = dealt.groupBy(key, "_t").agg(*(m.alias(n) for n, m in measures.items()), F.max("_us").alias("_last"))
    # Every date of every entity is a row of the result; it is generated in place, not joined.
    listed = F.array(*(F.struct(F.lit(r.observation_date).alias("d"), F.lit(r._t).alias("t")) for r in days.collect()))
    grid = entities.select(key).distinct().select(key, F.explode(listed).alias("_d")).select(key, F.col("_d.d").alias("observation_date"), F.col("_d.t").alias("_t"))
    joined = grid.join(made, [key, "_t"], "left")
    filled = [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in measures]
    return joined.select(key, "observation_date", F.lit(window_days).alias("window_days"), *filled, ((F.col("_t") - F.col("_last")) / float(_DAY)).alias(recency))


def count_of(column: str, value: str) -> Column:
    return F.count(F.when(F.col(column) == value, 1))


def ratio(total: Column, count: Column) -> Column:
    """``total / count``, 0.0 for nothing."""
    return F.when(count > 0, total / count).otherwise(F.lit(0.0))


def user_engagement(events: DataFrame, users: DataFrame, days: DataFrame, window_days: int = 30) -> DataFrame:
    """Seven measures of each user's activity."""
    measures = {
        "event_count": F.count(F.lit(1)), "unique_content_count": F.count_distinct("content_id"), "total_watch_seconds": F.sum("watch_seconds"),
        "search_count": count_of("event_type", "search"), "play_count": count_of("event_type", "play"), "watch_count": count_of("event_type", "watch"),
    }
    return profile(events, users, "user_id", days, window_days, measures, "event_time", "days_since_last_activity")


def content_popularity(events: DataFrame, content: DataFrame, days: DataFrame, window_days: int = 30) -> DataFrame:
    """Eight measures of each item's audience; events without an item play no part."""
    measures = {
        "view_count": F.count(F.lit(1)), "unique_viewer_count": F.count_distinct("user_id"), "total_watch_seconds": F.sum("watch_seconds"),
        "average_watch_seconds": ratio(F.sum("watch_seconds"), F.count(F.lit(1))),
        "search_count": count_of("event_type", "search"), "play_count": count_of("event_type", "play"), "watch_count": count_of("event_type", "watch"),
    }
    return profile(events, content, "content_id", days, window_days, measures, "event_time", "days_since_last_view")


def date_range(first: date, last: date) -> list[date]:
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]
