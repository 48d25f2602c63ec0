import json
from datetime import date, datetime, timedelta, timezone

import pytest

from tests.unit.test_features import T0, event
from tidemark import cli
from tidemark.plans import jobs

SPEC = """
name: rate
version: 1
owner: o
description: d
entity: user_id
source: s
aggregations:
  - {name: plays, op: count, filter: "event_type == 'play'"}
window: {size: 24h, slide: 1m, boundary: right_closed}
lateness: {watermark_delay: 10m, allowed: 30m}
dedupe: {key: event_id, ttl: 48h}
online: {store: redis, ttl: 25h, update_policy: append_only}
offline: {store: iceberg, table: features.rate}
freshness_slo: 5m
"""
LABEL = "{name: again, version: 1, owner: o, description: d, entity: user_id, source: s, outcome: {op: exists}, horizon: 7d, dedupe: {key: event_id}}"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "s.yaml").write_text(SPEC)
    (tmp_path / "l.yaml").write_text(LABEL)
    (tmp_path / "bad.yaml").write_text(SPEC.replace("slide: 1m", "slide: 7h"))
    stamp = lambda t: t.replace(tzinfo=timezone.utc).isoformat()
    rows = [event(f"e{i}", T0 + timedelta(hours=i)) for i in range(30)]
    (tmp_path / "e.jsonl").write_text("\n".join(json.dumps(r | {k: stamp(r[k]) for k in ("event_time", "ingested_at")}) for r in rows))
    (tmp_path / "o.jsonl").write_text(json.dumps({"user_id": "u1", "observation_time": stamp(T0)}))
    return tmp_path


def test_specs(spark, files, capsys):
    assert cli.main(["validate-spec", f"{files}/s.yaml"]) == 0 and cli.main(["validate-label-spec", f"{files}/l.yaml"]) == 0
    assert cli.main(["validate-spec", f"{files}/bad.yaml"]) == 1 and cli.main(["validate-spec", f"{files}/l.yaml"]) == 1
    assert cli.main(["validate-spec", f"{files}/none.yaml"]) == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["no-such-command"])
    assert e.value.code == 2
    capsys.readouterr()
    assert cli.main(["test-spec", f"{files}/s.yaml", "--events", f"{files}/e.jsonl", "--entity", "user_id=u1", "--at", "2026-01-03T12:00:00+00:00"]) == 0
    assert json.loads(capsys.readouterr().out) == {"plays": 24}


def test_backfill_and_dataset(spark, files, capsys):
    common = ["--events", f"{files}/e.jsonl", "--observations", f"{files}/o.jsonl"]
    assert cli.main(["backfill-spec", f"{files}/s.yaml", *common, "--output", f"{files}/b"]) == 0
    assert spark.read.parquet(f"{files}/b").first().plays == 1
    assert cli.main(["backfill-spec", f"{files}/s.yaml", *common, "--output", f"{files}/b"]) != 0
    build = ["build-training-dataset", "--features", f"{files}/s.yaml", "--label", f"{files}/l.yaml", *common, "--output", f"{files}/d"]
    assert cli.main([*build, "--mode", "event_time", "--data-end", "2026-01-05T00:00:00+00:00"]) == 1  # nothing is complete
    assert cli.main([*build[:-1], f"{files}/d2", "--mode", "event_time", "--data-end", "2026-01-15T00:00:00+00:00"]) == 0
    assert cli.main([*build, "--mode", "published_as_of", "--data-end", "2026-01-15T00:00:00+00:00"]) == 1
    assert cli.main(["generate", "--output", f"{files}/g", "--events", "50"]) == 0


def test_profiles_to_online(spark, tmp_path):
    rows = [("u1", "c1", "play", datetime(2026, 1, 1, 12), 30), ("u2", "c1", "watch", datetime(2026, 1, 2, 12), 60)]
    spark.createDataFrame(rows, "user_id string, content_id string, event_type string, event_time timestamp, watch_seconds long").write.parquet(f"{tmp_path}/src/events.parquet")
    spark.createDataFrame([("u1",), ("u2",)], "user_id string").write.parquet(f"{tmp_path}/src/users.parquet")
    spark.createDataFrame([("c1",)], "content_id string").write.parquet(f"{tmp_path}/src/content.parquet")
    with pytest.raises(Exception):
        jobs.backfill(spark, f"{tmp_path}/nowhere", f"{tmp_path}/off", date(2026, 1, 2), date(2026, 1, 2))
    assert json.loads((tmp_path / "off/_manifests/backfill-2026-01-02-2026-01-02-30d.json").read_text())["status"] == "failed"
    base = ["--sources", f"{tmp_path}/src", "--output", f"{tmp_path}/off"]
    assert cli.main(["backfill", *base, "--first", "2026-01-02", "--last", "2026-01-03"]) == 0
    assert cli.main(["compute-features", *base, "--first", "2026-01-03"]) == 0  # the same partition again
    off = ["--output", f"{tmp_path}/off", "--now", "2026-01-03T06:00:00+00:00"]
    assert cli.main(["check-freshness", *off]) == 0 and cli.main(["check-freshness", *off, "--max-lag-days", "0.1"]) == 1
    late = ["--output", f"{tmp_path}/off", "--now", "2026-03-01T00:00:00+00:00", "--online", f"{tmp_path}/on", "--end", "2026-01-04T00:00:00+00:00"]
    assert cli.main(["materialize-incremental", *late]) == 1 and not (tmp_path / "on/user_engagement_features").exists()
    fresh = [*off, "--online", f"{tmp_path}/on", "--end", "2026-01-03T00:00:00+00:00"]
    assert cli.main(["materialize", *fresh, "--start", "2026-01-01T00:00:00+00:00"]) == 0
    got = {r.user_id: r.event_count for r in spark.read.parquet(f"{tmp_path}/on/user_engagement_features").collect()}
    assert got == {"u1": 1, "u2": 1}
    assert cli.main(["materialize-incremental", *fresh]) == 1  # nothing new since the mark
