"""Online lookups as joins: explicit statuses, staleness, fallbacks, and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import us
from tidemark.plans.spec import FeatureSpec

MOST_ENTITIES, MOST_FEATURES = 100, 50


def lookup(requests: DataFrame, state: DataFrame, spec: FeatureSpec, now: Column, failed: Column | None = None) -> DataFrame:
    """Per requested entity: outputs, ``status``, ``freshness``, ``age_seconds``, ``defaulted``.

    status: ``ok``, ``missing``, ``stale`` (too old or of the future; values
    stay) or ``backend_error``.  Expired state (``expires_at <= now``) is
    missing.  The fallback ``default_value`` fills missing and error rows.
    """
    live = state.where(us(F.col("expires_at")) > us(now)) if "expires_at" in state.columns else state
    live = live.select(*spec.keys, *spec.outputs, "observation_time")
    joined = requests.join(live, spec.keys, "left")
    age = (us(now) - us(F.col("observation_time"))) / 1e6
    slo = spec.freshness_slo.total_seconds()
    error = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    missing = F.col("observation_time").isNull()
    status = F.when(error, "backend_error").when(missing, "missing").when((age < 0) | (age > slo), "stale").otherwise("ok")
    fresh = F.when(error | missing, None).when(age < 0, "future").when(age > slo, "stale").otherwise("fresh")
    out = joined.withColumn("status", status).withColumn("freshness", fresh).withColumn("age_seconds", F.when(error, None).otherwise(age))
    back = spec.online.fallback
    absent = F.col("status").isin("missing", "backend_error")
    values = []
    for name in spec.outputs:
        kept = F.when(~error, F.col(name))
        values.append((F.when(absent, F.lit(back.defaults[name])).otherwise(kept) if back.policy == "default_value" else kept).alias(name))
    defaulted = (absent if back.policy == "default_value" else F.lit(False)).alias("defaulted")
    failing = ((F.col("status") == "backend_error") if back.policy == "fail" else F.lit(False)).alias("fails_request")
    return out.select(*spec.keys, *values, "status", "freshness", "age_seconds", defaulted, failing)


def availability(value: Column, at: Column, now: Column, max_age_seconds: float) -> dict[str, Column]:
    """``availability``, ``freshness`` and ``age_seconds`` of one value read at a time."""
    age = (us(now) - us(at)) / 1e6
    fresh = F.when(at.isNull(), "unknown").when(age < 0, "future").when(age > max_age_seconds, "stale").otherwise("fresh")
    return {"availability": F.when(value.isNull(), "missing").otherwise("present"), "freshness": fresh, "age_seconds": age}


class LookupFailed(LookupError):
    """A policy or a missing record does not let the request be answered."""


def check_request(n_entities: int, n_features: int) -> None:
    if not 0 < n_entities <= MOST_ENTITIES or not 0 < n_features <= MOST_FEATURES:
        raise ValueError(f"a request has 1 to {MOST_ENTITIES} entities and 1 to {MOST_FEATURES} features")


def bounded(value: Column, cap: float) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)) / F.lit(cap), F.lit(1.0))


def recency(days: Column) -> Column:
    """1 for activity just now, 0 from seven days on or without activity."""
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.least(days, F.lit(7.0)) / 7.0), F.lit(0.0))


# Weight and cap of each measure of the two scores.
USER_WEIGHTS = (("event_count", 0.30, 10.0), ("unique_content_count", 0.20, 10.0), ("total_watch_seconds", 0.15, 3600.0), ("search_count", 0.10, 3.0), ("play_count", 0.10, 3.0), ("watch_count", 0.05, 3.0))
CONTENT_WEIGHTS = (("view_count", 0.30, 50.0), ("unique_viewer_count", 0.20, 50.0), ("total_watch_seconds", 0.15, 18000.0), ("average_watch_seconds", 0.10, 1800.0), ("search_count", 0.05, 10.0), ("play_count", 0.10, 15.0), ("watch_count", 0.05, 15.0))
RANK_WEIGHTS = (0.45, 0.55)


def score(weights: tuple, days: str, days_weight: float) -> Column:
    total = F.lit(days_weight) * recency(F.col(days))
    for name, weight, cap in reversed(weights):
        total = F.lit(weight) * bounded(F.col(name), cap) + total
    return F.round(total, 6)


def user_score() -> Column:
    return score(USER_WEIGHTS, "days_since_last_activity", 0.10)


def content_score() -> Column:
    return score(CONTENT_WEIGHTS, "days_since_last_view", 0.05)


def rank(candidates: DataFrame, user: Column, content: Column, key: str, k: int) -> DataFrame:
    """The ``k`` best candidates by score, ties to the smaller key; repeated candidates count once."""
    if k <= 0:
        raise ValueError("k must be positive")
    a, b = RANK_WEIGHTS
    scored = once(candidates, key).withColumn("score", F.round(a * user + b * content, 6))
    return scored.orderBy(F.desc("score"), key).limit(k)


def once(rows: DataFrame, key: str, position: str | None = None) -> DataFrame:
    """One row a key: the one at the smallest ``position``, else the smallest in the order of its columns."""
    rest = [position, *(c for c in rows.columns if c not in (key, position))] if position else [c for c in rows.columns if c != key]
    if not rest:
        return rows.distinct()
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(rows.columns)


def measures_of(record: DataFrame, counts: list[str], recent: str) -> DataFrame:
    """Stored measures as served: a record with no value at all is missing; in a present one a null count is 0."""
    present = F.coalesce(*(F.col(n).cast("double") for n in (*counts, recent))).isNotNull()
    filled = {n: F.when(F.col("present"), F.coalesce(n, F.lit(0))) for n in counts}
    return record.withColumn("present", present).withColumns(filled)


def rank_online(candidates: DataFrame, user: DataFrame, content: DataFrame, key: str, k: int, position: str = "position") -> tuple[DataFrame, DataFrame]:
    """(the best ``k`` of one user's candidates, the candidates without a record in the order asked for).

    ``candidates`` holds ``key`` and ``position``; repeats count once, at their
    first position.  ``user`` is the user's stored record, ``content`` the
    records of items.  No record of the user, or of no candidate at all, fails.
    """
    wanted = once(candidates.select(position, key), key, position)
    if wanted.where(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).limit(1).count() or not wanted.limit(1).count():
        raise ValueError("candidates must be one or more non-empty ids")
    names = [n for n, _, _ in USER_WEIGHTS]
    known = measures_of(user, names, "days_since_last_activity").where("present").limit(1)
    if not known.count():
        raise LookupFailed("the user has no stored record")
    items = [n for n, _, _ in CONTENT_WEIGHTS]
    met = measures_of(wanted.join(content.select(key, *items, "days_since_last_view"), key, "left"), items, "days_since_last_view")
    found, skipped = met.where("present"), met.where("NOT present")
    if not found.limit(1).count():
        raise LookupFailed("no candidate has a stored record")
    taste = known.select(user_score().alias("user_score"))  # one row
    scored = found.withColumn("content_score", content_score()).join(F.broadcast(taste))
    return rank(scored.select(key, "user_score", "content_score"), F.col("user_score"), F.col("content_score"), key, k), skipped.orderBy(position).select(key)


def read_group(requests: DataFrame, stored: DataFrame, key: str, group: str, features: list[str], now: Column, max_age_seconds: float, failed: Column | None = None) -> DataFrame:
    """A row for each requested entity and feature of a stored group, in the shape of a single read.

    ``feature`` (group.name), ``entity``, ``value``, ``availability`` (present,
    missing or error), ``freshness``, ``age_seconds``, ``error_type``.  A record's
    time is its ``observation_time``; ``failed`` marks entities whose read fails.
    """
    met = requests.select(key).join(stored.select(key, "observation_time", *features), key, "left")
    error = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    listed = F.array(*(F.struct(F.lit(f"{group}.{n}").alias("feature"), F.col(n).cast("double").alias("value")) for n in features))
    each = met.select(F.col(key).cast("string").alias("entity"), "observation_time", error.alias("_e"), F.explode(listed).alias("_f")).select("*", "_f.*")
    shown = availability(F.col("value"), F.col("observation_time"), now, max_age_seconds)
    there = ~F.col("_e") & F.col("value").isNotNull()
    return each.select(
        "feature", "entity", F.when(there, F.col("value")).alias("value"), F.when(F.col("_e"), "error").otherwise(shown["availability"]).alias("availability"),
        F.when(there, shown["freshness"]).alias("freshness"), F.when(there, shown["age_seconds"]).alias("age_seconds"), F.when(F.col("_e"), "ReadError").alias("error_type"),
    )


def resolve(specs: list[FeatureSpec], name: str, version: int | None = None) -> FeatureSpec:
    """The spec of a name and version, the newest if none is asked for."""
    known = {s.version: s for s in specs if s.name == name}
    if not known:
        raise ValueError(f"unknown feature {name}")
    if version is not None and version not in known:
        raise ValueError(f"unknown version {version} of feature {name}")
    return known[max(known) if version is None else version]


def lookup_features(requests: DataFrame, n_entities: int, wanted: list[tuple[str, int | None]], specs: list[FeatureSpec], states: dict[tuple[str, int], DataFrame], now: Column, failed: Column | None = None) -> DataFrame:
    """Entities times features in one frame: keys, ``feature``, ``version``, ``values`` (a map) and what ``lookup`` tells.

    ``n_entities`` is the request's size, held to the limits; ``failed`` marks entities
    that cannot be read.  There a feature whose policy is to fail fails the request.
    """
    check_request(n_entities, len(wanted))
    chosen = [resolve(specs, name, version) for name, version in wanted]
    if len({(s.name, s.version) for s in chosen}) < len(chosen):
        raise ValueError("a feature is asked for twice")
    if len({tuple(s.keys) for s in chosen}) > 1:
        raise ValueError("the features have different entity keys")
    parts = []
    for s in chosen:
        found = lookup(requests, states[s.name, s.version], s, now, failed)
        values = F.create_map(*(x for n in s.outputs for x in (F.lit(n), F.col(n).cast("double"))))
        parts.append(found.select(*s.keys, F.lit(s.name).alias("feature"), F.lit(s.version).alias("version"), values.alias("values"), "status", "freshness", "age_seconds", "defaulted", "fails_request"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    failing = sorted(r.feature for r in out.where("fails_request").select("feature").distinct().collect())  # at most MOST_FEATURES
    if failing:
        raise LookupFailed(f"no value for {failing}")
    return out.drop("fails_request")


# Where the segments of the demonstration score begin.
SEGMENTS = (("high_engagement", 0.65), ("medium_engagement", 0.30))


def segment(value: Column) -> Column:
    """The named segment of a score."""
    out = F.lit("low_engagement")
    for name, low in reversed(SEGMENTS):
        out = F.when(value >= low, name).otherwise(out)
    return out
