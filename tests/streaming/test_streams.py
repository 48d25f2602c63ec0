import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.plans import spec as specs
from tidemark.plans.contract import INTERACTIONS
from tidemark.streaming.feature_stream import TOO_LATE, FeatureStream
from tidemark.streaming.windows import deduplicated, deduplicated_for, validated, windowed

DAY = datetime(2026, 1, 1, tzinfo=timezone.utc)
PLAYS = specs.feature(
    "plays", "user_id", [{"name": "n", "op": "count", "filter": "event_type == 'play'"}], "1h", "30m",
    update_policy="append_only", lateness={"watermark_delay": "10m", "allowed": "30m"},
)


def line(i, hour, minute=0, user="u1", micro=0, **more):
    at = DAY + timedelta(hours=hour, minutes=minute, microseconds=micro)
    e = {"event_id": i, "event_time": at.isoformat(), "ingested_at": (at + timedelta(hours=9)).isoformat(), "user_id": user, "content_id": "c", "event_type": "play", "play_seconds": 5, "source": "web", "schema_version": "v1"}
    return json.dumps(e | more)


def feed(folder, number, *lines):
    path = folder / f"{number:03d}.txt"
    path.write_text("\n".join(lines) + "\n")
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))  # files are taken by age


def stream(spark, folder):
    return spark.readStream.option("maxFilesPerTrigger", 1).text(f"file://{folder}")


@pytest.fixture
def places(tmp_path):
    for n in ("in", "out", "check"):
        (tmp_path / n).mkdir()
    return tmp_path


def run(spark, places):
    s = FeatureStream(spark, f"file://{places}/out", PLAYS, INTERACTIONS)
    q = s.start(stream(spark, places / "in"), f"file://{places}/check")
    q.awaitTermination(120)
    if q.exception():
        raise q.exception()
    return s


def test_corrections_late_routing_and_replay(spark, places):
    feed(places / "in", 0, line("a", 11, 30), line("a", 11, 30), "{broken", line("bad", 11, 30, event_type="jump"))
    feed(places / "in", 1, line("b", 12, 11, user="u2"))
    feed(places / "in", 2, line("c", 11, 30))  # late, but its windows still count
    feed(places / "in", 3, line("d", 14, 0, user="u2"))
    feed(places / "in", 4, line("e", 11, 30))  # all windows are over
    s = run(spark, places)
    history = {(r.user_id, r.observation_time.hour, r.observation_time.minute, r.n) for r in s.history.read().collect()}
    assert {("u1", 11, 30, 1), ("u1", 12, 0, 1), ("u1", 12, 0, 2)} <= history
    assert ("u1", 12, 0, 3) not in history
    assert [(r.event_id, r.reason_code) for r in s.late.read().collect()] == [("e", TOO_LATE)]
    assert sorted(r.reason_code for r in s.rejected.read().collect()) == ["EVENT_CONTRACT_VIOLATION", "INVALID_JSON"]
    assert {r.user_id: (r.observation_time.hour, r.n) for r in s.state().collect()} == {"u1": (12, 2), "u2": (14, 1)}
    before = s.history.read().count()
    s.batch(spark.createDataFrame([(line("a", 11, 30),)], "value string"), 0)  # an old batch again
    s.batch(spark.createDataFrame([(line("b", 12, 11, user="u2"),)], "value string"), 99)  # a redelivery
    assert s.history.read().count() == before and s.facts.read().count() == 5


def test_conflict_stops_the_stream(spark, places):
    feed(places / "in", 0, line("a", 11, 30))
    feed(places / "in", 1, line("a", 11, 30, play_seconds=6))
    with pytest.raises(Exception, match="different payloads"):
        run(spark, places)


def test_right_closed_windows(spark, places):
    feed(places / "in", 0, line("a", 12, 0), line("b", 12, 0, micro=1), line("x", 12, 0, event_type="jump"))
    parsed = stream(spark, places / "in").select(F.from_json("value", INTERACTIONS.schema).alias("e")).select("e.*")
    s = specs.feature("w", "user_id", [{"name": "n", "op": "count"}], "1h")
    q = windowed(validated(parsed, INTERACTIONS), s, INTERACTIONS).writeStream.format("memory").queryName("right_closed").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.observation_time.hour, r.n) for r in spark.table("right_closed").collect()} == {(12, 1), (13, 1)}


def test_deduplicated(spark, places):
    feed(places / "in", 0, line("a", 12, 0), line("a", 12, 0), line("b", 12, 1))
    parsed = stream(spark, places / "in").select(F.from_json("value", INTERACTIONS.schema).alias("e")).select("e.*")
    q = deduplicated(parsed, INTERACTIONS, "1 hour").writeStream.format("memory").queryName("dedup").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.event_id for r in spark.table("dedup").collect()) == ["a", "b"]


def test_only_counts(spark, places):
    with pytest.raises(ValueError):
        FeatureStream(spark, f"file://{places}/out", specs.feature("s", "user_id", [{"name": "s", "op": "sum", "column": "play_seconds"}], "1h"), INTERACTIONS)


def test_keyed_state_finds_conflicts(spark, places):
    quiet = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(quiet, "false")
    try:
        feed(places / "in", 0, line("a", 12, 0), line("a", 12, 0), line("b", 12, 1))
        feed(places / "in", 1, line("a", 12, 0), line("c", 12, 0))
        rows = stream(spark, places / "in").select(F.from_json("value", INTERACTIONS.schema).alias("e")).select("e.*")
        q = deduplicated_for(rows, INTERACTIONS, "1h").writeStream.format("memory").queryName("kept").option("checkpointLocation", f"file://{places}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(r.event_id for r in spark.table("kept").collect()) == ["a", "b", "c"]
        feed(places / "in", 2, line("b", 12, 1, play_seconds=77))
        q = deduplicated_for(rows, INTERACTIONS, "1h").writeStream.foreachBatch(lambda f, n: f.count()).option("checkpointLocation", f"file://{places}/check").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="different payloads"):
            q.awaitTermination(120)
    finally:
        spark.conf.set(quiet, "true")
