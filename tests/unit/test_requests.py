"""Requests, records, writers and generated datasets."""

import json
import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests import oracle
from tests.unit.test_features import RATE, T0, event, frame
from tidemark.functions.numbers import isclose
from tidemark.functions.times import micros
from tidemark.operators import dataset, records, serving
from tidemark.operators.asof import as_of
from tidemark.operators.identity import IdentityConflict
from tidemark.operators.quality import Expected, dataset_report
from tidemark.plans import spec as specs
from tidemark.plans.contract import INTERACTIONS
from tidemark.sources import files, synthetic
from tidemark.sources.snapshots import SnapshotTable
from tidemark.streaming.event_writer import consume_batch, flush_is_due

H = timedelta(hours=1)
ITEM = "content_id string, view_count long, unique_viewer_count long, total_watch_seconds long, average_watch_seconds double, search_count long, play_count long, watch_count long, days_since_last_view double"
USER = "event_count long, unique_content_count long, total_watch_seconds long, search_count long, play_count long, watch_count long, days_since_last_activity double"


def test_ranking_skips_and_fails(spark):
    asked = spark.createDataFrame([(0, "c"), (1, "a"), (2, "gone"), (3, "a"), (4, "empty"), (5, "b")], "position int, content_id string")
    items = spark.createDataFrame([("a", 50, None, 0, 0.0, 0, 0, 0, None), ("b", 10, 1, 0, 0.0, 0, 0, 0, 1.0), ("c", 10, 1, 0, 0.0, 0, 0, 0, 1.0), ("empty", *[None] * 8)], ITEM)
    user = spark.createDataFrame([(10, None, 0, 0, 0, 0, None)], USER)
    best, skipped = serving.rank_online(asked, user, items, "content_id", 3)
    assert [r.content_id for r in best.collect()] == ["a", "b", "c"] and [r.content_id for r in skipped.collect()] == ["gone", "empty"]
    assert best.first().score == round(0.45 * 0.30 + 0.55 * 0.30, 6)
    with pytest.raises(serving.LookupFailed, match="user"):
        serving.rank_online(asked, user.limit(0), items, "content_id", 3)
    with pytest.raises(serving.LookupFailed, match="candidate"):
        serving.rank_online(asked, user, items.limit(0), "content_id", 3)
    with pytest.raises(ValueError):
        serving.rank_online(asked.limit(0), user, items, "content_id", 3)
    shown = {r.content_id: r for r in serving.measures_of(items, ["view_count", "unique_viewer_count"], "days_since_last_view").collect()}
    assert shown["a"].unique_viewer_count == 0 and shown["empty"].view_count is None and not shown["empty"].present


def test_lookup_of_several_features(spark):
    state = spark.createDataFrame([("u1", T0, 3, 1, 0.25)], "user_id string, observation_time timestamp, plays long, skips long, rate double")
    strict = specs.feature("strict", "user_id", [{"name": "plays", "op": "count"}], "24h", online={"fallback": {"policy": "fail"}})
    states = {("rate", 1): state, ("strict", 1): state}
    asked = spark.createDataFrame([("u1",)], "user_id string")
    now = F.lit(T0 + timedelta(minutes=1))
    got = {r.feature: r for r in serving.lookup_features(asked, 1, [("rate", None), ("strict", None)], [RATE, strict], states, now).collect()}
    assert got["rate"]["values"] == {"plays": 3.0, "skips": 1.0, "rate": 0.25} and got["strict"].status == "ok"
    for wanted, n, message in (([("nope", None)], 1, "unknown feature"), ([("rate", 9)], 1, "unknown version"), ([("rate", 1), ("rate", None)], 1, "twice"), ([("rate", 1)], 101, "entities"), ([], 1, "features")):
        with pytest.raises(ValueError, match=message):
            serving.lookup_features(asked, n, wanted, [RATE, strict], states, now)
    with pytest.raises(serving.LookupFailed, match="strict"):
        serving.lookup_features(asked, 1, [("strict", None)], [RATE, strict], states, now, F.lit(True))
    missing = serving.lookup_features(spark.createDataFrame([("nobody",)], "user_id string"), 1, [("strict", None)], [RATE, strict], states, now).first()
    assert missing.status == "missing" and missing["values"] == {"plays": None}


def record(**more):
    base = {"feature_schema_version": "v1", "feature_name": "rate", "user_id": "u1", "observation_time": "2026-01-02T12:00:00Z", "window_start_exclusive": "2026-01-01T12:00:00.000000+00:00", "plays": 3, "skips": 1, "rate": 0.25}
    return json.dumps({k: v for k, v in (base | more).items() if v != "drop"})


def test_records(spark):
    cases = [
        (record(), None), (record(rate=0.25 + 1e-14), None), (record(rate=0.2501), "rate does not match its expression"), (record(plays=3.0), None), (record(plays=True), "plays must be a non-negative integer"),
        (record(plays=-1), "plays must be a non-negative integer"), (record(plays="3"), "plays must be a non-negative integer"), (record(rate="x"), "rate must be a finite number"), (record(more=1), "record fields do not match the spec"),
        (record(skips="drop"), "record fields do not match the spec"), (record(user_id="a b"), "user_id must be a non-empty string without white space"), (record(user_id=""), "user_id must be a non-empty string without white space"),
        (record(feature_name="other"), "feature_name is wrong"), (record(feature_schema_version="v2"), "feature_schema_version is wrong"), (record(observation_time="2026-01-02T12:00:00"), "observation_time must be a time with zone"),
        (record(window_start_exclusive="2026-01-01T13:00:00Z"), "the window has another size"), ("{", "record is not JSON"), ("[1]", "record must be an object"), (None, "tombstone"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, value string")
    got = {r.i: r for r in records.checked_records(df, RATE).collect()}
    wrong = [(cases[i], got[i].problem) for i in range(len(cases)) if got[i].problem != cases[i][1] and "3.0" not in str(cases[i][0])]
    assert not wrong
    assert got[0].record.user_id == "u1" and got[0].record.observation_time == T0 and got[2].record is None
    made = spark.createDataFrame([("u1", T0, 3, 1, 0.25)], "user_id string, observation_time timestamp, plays long, skips long, rate double")
    text = made.select(records.to_records(made, RATE).alias("value"))
    assert list(json.loads(text.first().value)) == sorted(json.loads(record())) and records.checked_records(text, RATE).first().problem is None
    assert records.materialize_records(text, RATE).first().plays == 3
    for bad, message in ((df.limit(0), "no records"), (df.where("value IS NULL"), "tombstone")):
        with pytest.raises(ValueError, match=message):
            records.materialize_records(bad, RATE)


def test_isclose(spark):
    pairs = [(1.0, 1.0 + 1e-10), (1.0, 1.1), (0.0, 1e-16), (float("inf"), float("inf")), (float("inf"), 1.0), (float("nan"), 1.0), (-2.0, -2.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    assert [r.o for r in df.select(isclose(F.col("a"), F.col("b"), 1e-9, 1e-15).alias("o")).collect()] == [math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-15) for a, b in pairs]


def payload(i, **more):
    e = event(i, T0) | more
    return json.dumps({k: v.isoformat().replace("+00:00", "") + "Z" if isinstance(v, datetime) else v for k, v in e.items()})


def test_writer_counts_every_payload(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/facts", INTERACTIONS.schema, "event_time")
    batch = [payload("a").encode(), payload("a").encode(), payload("b").encode(), b"{broken", b"\xff\xfe", None, payload("x", event_type="jump").encode()]
    df = spark.createDataFrame([(x,) for x in batch], "value binary")
    assert consume_batch(df, t, INTERACTIONS) == {"appended": 2, "duplicate": 1, "rejected_invalid_json": 1, "rejected_invalid_encoding": 1, "rejected_tombstone": 1, "rejected_event_contract_violation": 1}
    assert consume_batch(spark.createDataFrame([(payload("a"),)], "value string"), t, INTERACTIONS) == {"duplicate": 1}
    with pytest.raises(IdentityConflict):
        consume_batch(spark.createDataFrame([(payload("a", play_seconds=99),), (payload("c"),)], "value string"), t, INTERACTIONS)
    assert t.read().count() == 2 and t.read(between=(T0 + 48 * H, T0 + 72 * H)).count() == 0
    assert flush_is_due(0.0, 2.0, 2.0) and not flush_is_due(0.0, 1.9, 2.0)


def test_bad_line_is_named(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("\n".join([payload("a"), "", payload("b"), payload("c", event_type="jump"), "{broken"]) + "\n")
    with pytest.raises(ValueError, match=r"e\.jsonl, line 4: .*event_type is not allowed"):
        files.read_events_jsonl(spark, f"file://{tmp_path}/e.jsonl", INTERACTIONS)


def test_overwritten_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/mark.json"
    for n in range(3):
        files.write_json(spark, path, {"n": n}, overwrite=True)
        assert json.loads(files.read_json(spark, path)) == {"n": n}
    with pytest.raises(FileExistsError):
        files.write_json(spark, path, {})


def test_arrow_batches_check_the_manifest(spark, tmp_path):
    e = frame(spark, [event(f"e{i}", T0 + i * H, "play" if i % 3 else "skip") for i in range(240)])
    obs = e.where("event_type = 'skip'").select("user_id", F.col("event_time").alias("observation_time"))
    out, excluded = dataset.assemble(e, obs, [RATE], specs.label("again", "user_id", "exists", "2d", "event_type == 'skip'"), INTERACTIONS, F.lit(T0 + 239 * H), "event_time")
    manifest = dataset.build(out, excluded, f"file://{tmp_path}/d", "event_time", {})
    made = dataset.BatchedDataset(f"file://{tmp_path}/d")
    parts = list(made.batches(7))
    assert sum(b.num_rows for b in parts) == manifest["rows"] and max(b.num_rows for b in parts) <= 7 and parts[0].schema.names == manifest["columns"]
    victim = next((tmp_path / "d").glob("observation_date=*/*.parquet"))
    victim.unlink()
    with pytest.raises(ValueError, match="manifest"):
        dataset.BatchedDataset(str(tmp_path / "d"))


def test_generated_dataset_passes_and_faults_are_counted(spark):
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    users, items = synthetic.users(spark, 50, start), synthetic.content(spark, 30)
    made = synthetic.watch_events(spark, 1000, 50, 30, start, 10, duplicate_rate=0.05, late_rate=0.1)
    labels = synthetic.labels(spark, 200, 50, start, 10)
    r = dataset_report(users, items, made, labels, Expected(1000, 0.05, 0.1, 200)).first()
    assert r.passed and (r.event_count, r.duplicate_count, r.late_event_count, r.label_count, r.user_count, r.content_count) == (1050, 50, 105, 200, 50, 30)
    bad = made.withColumn("watch_seconds", F.when(F.col("event_type") == "search", 5).otherwise(F.col("watch_seconds"))).withColumn("user_id", F.when(F.col("event_id") == "e000000001", "nobody").otherwise(F.col("user_id")))
    r = dataset_report(users, items, bad, labels, Expected(1000, 0.05, 0.1, 201)).first()
    assert not r.passed and r.wrong_watch_seconds == made.where("event_type = 'search'").count() and r.unknown_event_users >= 1 and not r.label_count_matches
    assert sorted(map(tuple, synthetic.watch_events(spark, 100, 5, 5, start, 1).collect())) == sorted(map(tuple, synthetic.watch_events(spark, 100, 5, 5, start, 1).repartition(3).collect()))


def test_as_of_against_one_time_at_a_time(spark):
    import random

    r, ttl = random.Random(7), 5 * H
    versions = [(f"u{r.randrange(4)}", T0 + timedelta(minutes=r.randrange(900)), r.randrange(3), i) for i in range(80)]
    times = [(f"u{r.randrange(5)}", T0 + timedelta(minutes=r.randrange(-60, 1500))) for _ in range(120)] + [(u, t) for u, t, *_ in versions[:20]] + [(u, t + ttl) for u, t, *_ in versions[:20]]
    v = spark.createDataFrame(versions, "user_id string, published_at timestamp, n int, tag int")
    obs = spark.createDataFrame(times, "user_id string, observation_time timestamp")
    for row in as_of(obs, v, ["user_id"], ["tag"], [F.col("n"), F.col("tag")], ttl=micros(ttl)).collect():
        assert (row.tag, row.status) == oracle.published(versions, row.user_id, row.observation_time, ttl)
