import itertools
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.unit.test_features import RATE, T0, event, frame
from tidemark.operators import dataset, diagnostics, profiles, quality, serving
from tidemark.operators.identity import IdentityConflict
from tidemark.operators.updates import UpdateConflict, decide, decision, fold
from tidemark.plans import spec as specs
from tidemark.plans.contract import INTERACTIONS
from tidemark.sources import files, registry
from tidemark.sources.snapshots import SnapshotTable
from tidemark.sources.synthetic import interactions


def test_decisions_agree_exhaustively(spark):
    vectors = list(itertools.product(range(3), range(3)))
    cases = [(t0, a, t1, b) for t0, t1 in ((1, 1), (1, 2), (2, 1)) for a in vectors for b in vectors]
    want = []
    for t0, a, t1, b in cases:
        try:
            want.append(decide((t0, dict(zip("xy", a, strict=True))), (t1, dict(zip("xy", b, strict=True)))))
        except UpdateConflict:
            want.append("conflict")
    df = spark.createDataFrame([(i, t0, *a, t1, *b) for i, (t0, a, t1, b) in enumerate(cases)], "i int, t0 int, x0 int, y0 int, t1 int, x int, y int")
    c = F.col
    got = df.withColumn("o", decision(c("t0"), c("t1"), {"x": (c("x0"), c("x")), "y": (c("y0"), c("y"))})).orderBy("i").collect()
    assert [r.o for r in got] == want and set(want) == {"written", "unchanged", "stale", "conflict"}


def test_fold_in_order():
    rows = [{"observation_time": 1, "n": 1}, {"observation_time": 1, "n": 2}, {"observation_time": 1, "n": 1}, {"observation_time": 2, "n": 0}, {"observation_time": 2, "n": 0}]
    assert fold(rows, None, ["n"]) == (rows[3], ["written", "written", "stale", "written", "unchanged"])
    with pytest.raises(ValueError):
        decide((1, {"a": 1}), (1, {"b": 1}))


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/facts", INTERACTIONS.schema, "event_time")
    with pytest.raises(ValueError, match="empty"):
        t.read()
    assert t.append_events(frame(spark, [event("a", T0), event("a", T0, receipt=5)]), INTERACTIONS) == 0
    assert t.append_events(frame(spark, [event("a", T0, receipt=9)]), INTERACTIONS) is None
    assert t.append_events(frame(spark, [event("a", T0), event("b", T0)]), INTERACTIONS) == 1
    with pytest.raises(IdentityConflict):
        t.append_events(frame(spark, [event("b", T0, seconds=3), event("c", T0)]), INTERACTIONS)
    assert t.read().count() == 2 and t.read(0).count() == 1
    with pytest.raises(ValueError, match="no snapshot"):
        t.read(7)
    with pytest.raises(ValueError, match="schema"):
        SnapshotTable(spark, f"file://{tmp_path}/facts", INTERACTIONS.schema.add("x", "integer"))


def test_dataset_round_trip_and_modes(spark, tmp_path):
    e = frame(spark, [event(f"e{i}", T0 + timedelta(hours=i), "play" if i % 3 else "skip") for i in range(240)])
    obs = e.where("event_type = 'skip'").select("user_id", F.col("event_time").alias("observation_time"))
    target = specs.label("again", "user_id", "exists", "2d", "event_type == 'skip'")
    end = F.lit(T0 + timedelta(hours=239))
    out, gone = dataset.assemble(e, obs, [RATE], target, INTERACTIONS, end, "event_time")
    path = f"file://{tmp_path}/set"
    manifest = dataset.build(out, gone, path, "event_time", {"rate": 1})
    assert manifest["rows"] + manifest["excluded"]["incomplete"] == 80
    back = dataset.load(spark, path, ["user_id"])
    assert back.count() == manifest["rows"] and sum(map(len, dataset.batches(back, 7))) == manifest["rows"]
    with pytest.raises(Exception, match="(?i)exist"):
        dataset.build(out, gone, path, "event_time", {})
    history = obs.select(
        "user_id", "observation_time", F.lit(1).cast("long").alias("plays"), F.lit(1).cast("long").alias("skips"), F.lit(0.5).alias("rate"),
        F.col("observation_time").alias("published_at"), F.lit(1).alias("spec_version"), F.lit("id").alias("update_id"),
    ).where(F.col("published_at") >= F.lit(T0 + timedelta(hours=30)))
    out, gone = dataset.assemble(e, obs, [RATE], target, INTERACTIONS, end, "published_as_of", {"rate": history})
    assert gone["before_history"].count() == 10 and {r["rate__status"] for r in out.collect()} == {"present"}
    with pytest.raises(ValueError):
        dataset.assemble(e, obs, [RATE], target, INTERACTIONS, end, "whatever")
    with pytest.raises(ValueError):
        dataset.check_specs([RATE, RATE], target)


def test_jsonl(spark, tmp_path):
    good = '{"event_id":"a","event_time":"2026-01-01T00:00:00Z","ingested_at":"2026-01-01T00:00:01Z","user_id":"u","content_id":"c","event_type":"play","play_seconds":3,"source":"web","schema_version":"v1"}'
    p = tmp_path / "e.jsonl"
    p.write_text(good + "\n")
    assert files.read_events_jsonl(spark, str(p), INTERACTIONS).first().play_seconds == 3
    bad = {
        "T": good.replace("01T00:00:00Z", "01 00:00:00Z"), "zone": good.replace("00:00:00Z", "00:00:00"), "kind": good.replace('"play"', '"jump"'), "extra": good[:-1] + ',"x":1}',
        "order": good.replace("00:00:01Z", "00:00:00Z").replace("00:00:00Z", "00:00:05Z", 1), "space": good.replace('"u"', '"u x"'), "number": good.replace(":3,", ':"3",'), "negative": good.replace(":3,", ":-3,"),
        "impression": good.replace('"play"', '"impression"'), "missing": good.replace('"user_id":"u",', ""), "json": "{nope",
    }
    rows = files.parsed_events(spark.createDataFrame([(k, v) for k, v in bad.items()], "k string, value string"), INTERACTIONS).collect()
    assert {r.k: r.reason_code for r in rows} == {k: "INVALID_JSON" if k == "json" else "EVENT_CONTRACT_VIOLATION" for k in bad}
    p.write_text(good + "\n" + bad["kind"] + "\n")
    with pytest.raises(ValueError, match="e.jsonl"):
        files.read_events_jsonl(spark, str(p), INTERACTIONS)
    q = tmp_path / "o.jsonl"
    q.write_text('{"user_id":"u","observation_time":"2026-01-01T00:00:00+02:00"}\n')
    assert files.read_observations_jsonl(spark, str(q), ["user_id"]).first().observation_time == datetime(2025, 12, 31, 22)
    q.write_text("")
    with pytest.raises(ValueError):
        files.read_observations_jsonl(spark, str(q), ["user_id"])


def test_profiles_and_quality(spark):
    rows = [("u1", "c1", "play", T0.replace(hour=0), 30), ("u1", None, "search", T0, 0), ("u1", "c1", "watch", T0 - timedelta(days=6), 60)]
    e = spark.createDataFrame(rows, "user_id string, content_id string, event_type string, event_time timestamp, watch_seconds long")
    users = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    days = profiles.dates(spark, date(2026, 1, 2), date(2026, 1, 3))
    got = {(r.user_id, str(r.observation_date)): r for r in profiles.user_engagement(e, users, days, 7).collect()}
    first, second, empty = got["u1", "2026-01-02"], got["u1", "2026-01-03"], got["u2", "2026-01-03"]
    assert (first.event_count, first.total_watch_seconds, first.unique_content_count, first.days_since_last_activity) == (2, 90, 1, 0.0)
    assert (second.event_count, second.search_count, second.days_since_last_activity) == (2 + 1, 1, 0.5)
    assert (empty.event_count, empty.days_since_last_activity) == (0, None)
    content = profiles.content_popularity(e, spark.createDataFrame([("c1",)], "content_id string"), days, 7).orderBy("observation_date").collect()
    assert (content[1].view_count, content[1].average_watch_seconds) == (2, 45.0)
    view = profiles.user_engagement(e, users, days, 7).withColumn("observation_time", F.col("observation_date").cast("timestamp"))
    assert quality.passed(quality.check_view(view, quality.USER_VIEW))
    bad = quality.check_view(view.unionByName(view.limit(1)).withColumn("event_count", F.lit(-1).cast("long")), quality.USER_VIEW)
    assert {c for _, c, ok, _ in bad if not ok} >= {"non_negative", "unique", "parts_within_total"}
    assert not quality.passed(quality.check_view(None, quality.USER_VIEW)) and not quality.passed(quality.check_view(users, quality.USER_VIEW))
    now = datetime(2026, 1, 3, tzinfo=timezone.utc)
    assert quality.freshness(date(2026, 1, 2), now, 1) == (True, 1.0) and not quality.freshness(date(2026, 1, 4), now, 9)[0] and quality.freshness(None, now, 1) == (False, None)


def test_lookup_statuses(spark):
    state = spark.createDataFrame([("a", T0, 1, 1, 0.5), ("b", T0 - timedelta(hours=1), 1, 1, 0.5), ("c", T0 + timedelta(hours=1), 1, 1, 0.5)], "user_id string, observation_time timestamp, plays long, skips long, rate double")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "user_id string")
    got = {r.user_id: (r.status, r.freshness, r.plays) for r in serving.lookup(asked, state, RATE, F.lit(T0 + timedelta(minutes=5))).collect()}
    assert got == {"a": ("ok", "fresh", 1), "b": ("stale", "stale", 1), "c": ("stale", "future", 1), "d": ("missing", None, None)}
    filled = specs.feature("n", "user_id", [{"name": "n", "op": "count"}], "1h", online={"fallback": {"policy": "default_value", "defaults": {"n": 7.0}}})
    r = serving.lookup(asked, state.withColumnRenamed("plays", "n"), filled, F.lit(T0), failed=F.col("user_id") == "a").orderBy("user_id").collect()
    assert (r[0].status, r[0].n, r[0].defaulted) == ("backend_error", 7.0, True) and (r[3].n, r[3].defaulted) == (7.0, True)
    expired = serving.lookup(asked, state.withColumn("expires_at", F.lit(T0)), RATE, F.lit(T0)).collect()
    assert {x.status for x in expired} == {"missing"}
    with pytest.raises(ValueError):
        serving.check_request(101, 1)


def test_scores_and_rank(spark):
    row = dict.fromkeys([n for n, _, _ in serving.USER_WEIGHTS], 1e6) | {"days_since_last_activity": 0.0}
    assert spark.createDataFrame([row]).select(serving.user_score().alias("s")).first().s == 1.0
    c = spark.createDataFrame([("x", 0.5), ("b", 0.9), ("a", 0.9), ("a", 0.9)], "content_id string, p double")
    assert [r.content_id for r in serving.rank(c, F.lit(0.0), F.col("p"), "content_id", 2).collect()] == ["a", "b"]


def test_diagnostics(spark):
    df = spark.createDataFrame([(i, float(i % 5), i % 2 == 0, T0 + timedelta(days=i)) for i in range(40)], "i long, s double, y boolean, t timestamp")
    pairs = [(a, b) for a in range(40) for b in range(40) if a % 2 == 0 and b % 2 == 1]
    want = sum(1.0 if a % 5 > b % 5 else 0.5 if a % 5 == b % 5 else 0.0 for a, b in pairs) / len(pairs)
    assert diagnostics.auc(df, "s", F.col("y")).first().auc == pytest.approx(want)
    assert diagnostics.auc(df.where("y"), "s", F.col("y")).first().auc is None
    assert diagnostics.at_k(df.limit(0), "s", F.col("y"), "i", 5).first().precision == 0.0
    parts = {r.split: r["count"] for r in diagnostics.time_split(df, "t", "i").groupBy("split").count().collect()}
    assert parts == {"train": 28, "validation": 6, "test": 6}
    with pytest.raises(ValueError):
        diagnostics.time_split(df.limit(1), "t", "i")
    assert diagnostics.quantile_edges(df.select(F.lit(1.0).alias("s")), "s") == []
    bins = diagnostics.compare_bins(df.where("i < 20"), df.where("i >= 20 AND s < 3"), "s", F.col("y")).orderBy("bin").collect()
    assert [r.train_rows for r in bins] == [8, 4, 4, 4] and bins[3].test_rows is None
    import math

    assert math.isnan(diagnostics.drift(df.withColumn("s", F.lit(1.0)), df, ["s"]).first()["shift"])


def test_registry(spark, tmp_path):
    rows = spark.createDataFrame([("u", T0, 1), ("u", T0 + timedelta(hours=1), 2), ("v", T0 - timedelta(days=40), 3)], "user_id string, observation_time timestamp, n int")
    path = f"file://{tmp_path}/view"
    files.write_new(rows, path)
    view = registry.View("v", path, "user_id", ("n",))
    reg = registry.Registry(view)
    assert reg.view("v", ["n"]) is view
    with pytest.raises(ValueError):
        reg.view("v", ["window_days"])
    obs = spark.createDataFrame([("u", T0 + timedelta(minutes=5)), ("v", T0)], "user_id string, observation_time timestamp")
    assert {r.user_id: r.n for r in registry.historical(spark, obs, view, ["n"]).collect()} == {"u": 1, "v": None}
    state = registry.materialize(rows, view, T0 - timedelta(days=1), T0 + timedelta(days=1)).collect()
    assert [(r.user_id, r.n) for r in state] == [("u", 2)]
    mark = f"file://{tmp_path}/mark.json"
    registry.advance(spark, mark, T0)
    assert registry.materialize_incremental(spark, rows, view, T0 + timedelta(days=1), mark, T0 - timedelta(days=99)).first().n == 2
    with pytest.raises(ValueError):
        registry.materialize_incremental(spark, rows, view, T0, mark, T0)


def test_synthetic_is_valid_and_stable(spark):
    a = interactions(spark, 500, 20, 10, T0, 5)
    assert a.where(F.size(INTERACTIONS.violations()) > 0).count() == 0
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, interactions(spark, 500, 20, 10, T0, 5).repartition(7).collect()))
