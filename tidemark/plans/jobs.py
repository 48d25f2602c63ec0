"""Batch jobs around the operators: profile backfills with manifests, the quality gate, materialization."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import profiles
from tidemark.operators.quality import CONTENT_VIEW, USER_VIEW, FeatureView, check_view, freshness, passed
from tidemark.sources import files
from tidemark.sources.registry import View, advance, materialize, materialize_incremental

VIEWS: dict[str, FeatureView] = {v.name: v for v in (USER_VIEW, CONTENT_VIEW)}


class Blocked(RuntimeError):
    """The quality gate has stopped a materialization."""


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the source tables ``users``, ``content``, ``events``, ``labels``."""
    return files.read_parquet(spark, f"{folder}/{name}.parquet")


def backfill(spark: SparkSession, sources: str, output: str, first: date, last: date, window_days: int = 30) -> dict:
    """Both feature views for every date, one job each; partitions of these dates are replaced, others stay.

    The manifest says how it ended, also if it failed.
    """
    manifest = {"first": first, "last": last, "window_days": window_days, "views": {}, "status": "failed"}
    name = f"{output}/_manifests/backfill-{first}-{last}-{window_days}d.json"
    try:
        events, days = source(spark, sources, "events"), profiles.dates(spark, first, last)
        made = {
            USER_VIEW: profiles.user_engagement(events, source(spark, sources, "users"), days, window_days),
            CONTENT_VIEW: profiles.content_popularity(events, source(spark, sources, "content"), days, window_days),
        }
        for view, frame in made.items():
            rows = frame.withColumn("observation_time", F.col("observation_date").cast("timestamp"))
            files.write_partitions(rows.repartitionByRange("observation_date", view.key), f"{output}/{view.name}", ["observation_date"])
            back = files.read_parquet(spark, f"{output}/{view.name}").where(F.col("observation_date").between(F.lit(first), F.lit(last)))
            manifest["views"][view.name] = {str(r.observation_date): r["count"] for r in back.groupBy("observation_date").count().collect()}  # one row a date
        manifest["status"] = "completed"
    finally:
        files.write_json(spark, name, manifest, overwrite=True)
    return manifest


def stored_view(spark: SparkSession, output: str, view: FeatureView) -> DataFrame | None:
    path = f"{output}/{view.name}"
    return files.read_parquet(spark, path) if files.exists(spark, path) else None


def newest(frame: DataFrame | None) -> date | None:
    return None if frame is None else frame.agg(F.max("observation_date")).first()[0]


def gate(spark: SparkSession, output: str, view: FeatureView, now: datetime, max_lag_days: float) -> list[tuple[str, str, bool, str]]:
    """All checks of a stored view, freshness last."""
    frame = stored_view(spark, output, view)
    ok, lag = freshness(newest(frame), now, max_lag_days)
    return [*check_view(frame, view), ("", "freshness", ok, f"lag {lag} days")]


def publish(spark: SparkSession, output: str, online: str, start: datetime | None, end: datetime, now: datetime | None = None, max_lag_days: float = 2.0) -> dict:
    """Latest rows of both views to ``online``; from the watermark on if ``start`` is None.

    Nothing is published unless every check passes; the manifest is written either way.
    """
    now = now or datetime.now(timezone.utc)
    manifest = {"start": start, "end": end, "status": "blocked", "failed_checks": [], "rows": {}}
    name = f"{online}/_manifests/materialize-{end:%Y%m%dT%H%M%S}.json"
    try:
        for view in VIEWS.values():
            rows = gate(spark, output, view, now, max_lag_days)
            manifest["failed_checks"] += [(view.name, *r) for r in rows if not r[2]]
            if not passed(rows):
                continue
        if manifest["failed_checks"]:
            raise Blocked(str(manifest["failed_checks"][0]))
        manifest["status"] = "failed"
        for view in VIEWS.values():
            described = View(view.name, f"{output}/{view.name}", view.key, (*view.counts, view.recency))
            frame, mark = stored_view(spark, output, view), f"{online}/{view.name}.mark.json"
            if start is None:
                state = materialize_incremental(spark, frame, described, end, mark, datetime(1970, 1, 1, tzinfo=timezone.utc))
            else:
                state = materialize(frame, described, start, end)
            state.write.mode("overwrite").parquet(f"{online}/{view.name}/until={end:%Y%m%dT%H%M%S}")
            advance(spark, mark, end)
            manifest["rows"][view.name] = files.read_parquet(spark, f"{online}/{view.name}/until={end:%Y%m%dT%H%M%S}").count()
        manifest["status"] = "completed"
    finally:
        files.write_json(spark, name, manifest, overwrite=True)
    return manifest
