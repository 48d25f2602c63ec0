"""Deterministic synthetic users, items and interactions, as expressions over a range."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(seed: int, tag: str, *ids: Column) -> Column:
    """A number in [0, 1) fixed by seed, tag and ids, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), *ids), F.lit(1 << 30)) / float(1 << 30)


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.floor(at * len(values)).cast("int"))


def interactions(spark: SparkSession, n: int, users: int, items: int, start: datetime, days: int, seed: int = 1, late: float = 0.03, repeated: float = 0.02) -> DataFrame:
    """Interactions by the streaming contract; some are received late, some are delivered twice."""
    i = F.col("id")
    rows = spark.range(n)
    at = F.timestamp_micros((F.unix_micros(F.lit(start)) + draw(seed, "t", i) * days * 86_400_000_000).cast("long"))
    delay = F.when(draw(seed, "late", i) < late, 3600 + draw(seed, "d", i) * 7200).otherwise(draw(seed, "d", i) * 30)
    kind = pick(("impression", "play", "skip", "complete"), draw(seed, "k", i))
    # A square of a uniform draw favours the first users and items.
    made = rows.select(
        F.concat(F.lit("e"), i.cast("string")).alias("event_id"), at.alias("event_time"),
        F.timestamp_micros((F.unix_micros(at) + delay * 1_000_000).cast("long")).alias("ingested_at"),
        F.format_string("user%06d", F.floor(F.pow(draw(seed, "u", i), 2) * users).cast("long")).alias("user_id"),
        F.format_string("item%06d", F.floor(F.pow(draw(seed, "c", i), 2) * items).cast("long")).alias("content_id"),
        kind.alias("event_type"), F.when(kind == "impression", 0).otherwise(F.floor(draw(seed, "s", i) * 600)).cast("long").alias("play_seconds"),
        pick(("web", "mobile", "tv"), draw(seed, "o", i)).alias("source"), F.lit("v1").alias("schema_version"),
    )
    again = made.where(draw(seed, "again", F.col("event_id")) < repeated)
    return made.unionByName(again.withColumn("ingested_at", F.col("ingested_at") + F.expr("interval 1 minute")))


PLANS, COUNTRIES, GENRES = ("free", "basic", "premium"), ("DE", "FR", "GB", "JP", "US"), ("comedy", "drama", "news", "science", "sport")
KINDS = ("search", "impression", "click", "play", "watch")


def users(spark: SparkSession, n: int, start: datetime, seed: int = 1) -> DataFrame:
    """``n`` users who signed up in the year before ``start``."""
    i = F.col("id")
    signed = F.timestamp_micros((F.unix_micros(F.lit(start)) - draw(seed, "since", i) * 365 * 86_400_000_000).cast("long"))
    return spark.range(n).select(F.format_string("user%06d", i).alias("user_id"), pick(COUNTRIES, draw(seed, "land", i)).alias("country"), pick(PLANS, draw(seed, "plan", i)).alias("plan"), signed.alias("signup_time"))


def content(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """``n`` items with a genre, a length and a weight that favours few of them."""
    i = F.col("id")
    weight = F.pow(F.lit(1.0) - draw(seed, "weight", i) * 0.999, -0.5)
    return spark.range(n).select(F.format_string("item%06d", i).alias("content_id"), pick(GENRES, draw(seed, "genre", i)).alias("genre"), (F.floor(draw(seed, "long", i) * 7000) + 60).cast("long").alias("duration_seconds"), weight.alias("popularity_weight"))


def _chosen(frame: DataFrame, key: str, n: int, seed: int, tag: str) -> DataFrame:
    """Exactly ``n`` rows, those with the smallest draws; ``n`` keys are sorted, nothing is gathered."""
    order = draw(seed, tag, F.col(key))
    return frame.select(key).orderBy(order, key).limit(n).select(key)


def watch_events(spark: SparkSession, n: int, n_users: int, n_items: int, start: datetime, days: int, seed: int = 1, duplicate_rate: float = 0.02, late_rate: float = 0.03) -> DataFrame:
    """``n`` events, ``int(n * duplicate_rate)`` of them twice, and ``int(all * late_rate)`` received late.

    A search names no item; only play and watch have watched seconds.
    """
    i = F.col("id")
    at = F.timestamp_micros((F.unix_micros(F.lit(start)) + draw(seed, "t", i) * days * 86_400_000_000).cast("long"))
    kind = pick(KINDS, draw(seed, "k", i))
    base = spark.range(n).select(
        F.format_string("e%09d", i).alias("event_id"), at.alias("event_time"),
        F.format_string("user%06d", F.floor(F.pow(draw(seed, "u", i), 2) * n_users).cast("long")).alias("user_id"),
        F.when(kind != "search", F.format_string("item%06d", F.floor(F.pow(draw(seed, "c", i), 2) * n_items).cast("long"))).alias("content_id"), kind.alias("event_type"),
        F.when(kind.isin("play", "watch"), F.floor(draw(seed, "s", i) * 1800) + 1).otherwise(0).cast("long").alias("watch_seconds"),
    )
    twice = base.join(_chosen(base, "event_id", int(n * duplicate_rate), seed, "again"), "event_id", "left_semi")
    both = base.withColumn("is_duplicate", F.lit(False)).unionByName(twice.withColumn("is_duplicate", F.lit(True)))
    both = both.withColumn("delivery_id", F.concat_ws("#", "event_id", F.col("is_duplicate").cast("int")))
    late = _chosen(both, "delivery_id", int((n + int(n * duplicate_rate)) * late_rate), seed, "late").withColumn("is_late", F.lit(True))
    wait = F.when(F.col("is_late"), 3600 + draw(seed, "d", F.col("delivery_id")) * 82_800).otherwise(draw(seed, "d", F.col("delivery_id")) * 60)
    out = both.join(late, "delivery_id", "left").withColumn("is_late", F.coalesce("is_late", F.lit(False)))
    return out.withColumn("ingested_at", F.timestamp_micros((F.unix_micros("event_time") + F.floor(wait * 1_000_000)).cast("long")))


def labels(spark: SparkSession, n: int, n_users: int, start: datetime, days: int, window_days: int = 7, seed: int = 1) -> DataFrame:
    """``n`` observations of users with the window their label looks at."""
    i = F.col("id")
    at = F.timestamp_micros((F.unix_micros(F.lit(start)) + draw(seed, "ot", i) * days * 86_400_000_000).cast("long"))
    made = spark.range(n).select(F.format_string("user%06d", F.floor(draw(seed, "ou", i) * n_users).cast("long")).alias("user_id"), at.alias("observation_time"), (draw(seed, "l", i) < 0.3).alias("label"))
    return made.withColumn("label_window_end", F.timestamp_micros(F.unix_micros("observation_time") + F.lit(window_days * 86_400_000_000)))
