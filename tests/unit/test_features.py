import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import oracle
from tidemark.functions.times import micros
from tidemark.operators.asof import as_of
from tidemark.operators.features import point_in_time, sliding_windows
from tidemark.operators.identity import IdentityConflict
from tidemark.operators.labels import label
from tidemark.plans import spec as specs
from tidemark.plans.contract import INTERACTIONS

T0 = datetime(2026, 1, 2, 12)
US, H = timedelta(microseconds=1), timedelta(hours=1)
#: One measure of each kind over the whole day, and two over a part of it.
DAY = specs.feature(
    "day", "user_id",
    [
        {"name": "actions", "op": "count"},
        {"name": "finished", "op": "count", "filter": "event_type == 'complete' and play_seconds >= 40"},
        {"name": "seconds", "op": "sum", "column": "play_seconds", "filter": "event_type != 'impression'"},
        {"name": "typical", "op": "avg", "column": "play_seconds", "filter": "event_type in ['play', 'complete']"},
        {"name": "shortest", "op": "min", "column": "play_seconds", "filter": "event_type == 'complete'"},
        {"name": "longest", "op": "max", "column": "play_seconds"},
        {"name": "trail", "op": "last_k", "column": "content_id", "k": 3},
        {"name": "variety", "op": "approx_distinct", "column": "content_id"},
    ],
    "24h", derived={"share": "finished / actions if actions >= 2 else -1.0", "gap": "longest - shortest"},
)
RATE = specs.feature(
    "rate", "user_id", [{"name": "plays", "op": "count", "filter": "event_type == 'play'"}, {"name": "skips", "op": "count", "filter": "event_type == 'skip'"}],
    "24h", derived={"rate": "skips / (plays + skips) if (plays + skips) > 0 else 0.0"},
)


def event(i, at, kind="play", user="u1", seconds=10, content="c1", receipt=0):
    return {"event_id": i, "event_time": at, "ingested_at": at + timedelta(seconds=receipt), "user_id": user, "content_id": content, "event_type": kind, "play_seconds": seconds, "source": "web", "schema_version": "v1"}


def frame(spark, events):
    return spark.createDataFrame([tuple(e[c] for c in INTERACTIONS.columns) for e in events], INTERACTIONS.schema)


def at(spark, *rows):
    return spark.createDataFrame(list(rows), "user_id string, observation_time timestamp")


def test_a_day_of_three_users(spark):
    """Worked by hand: an own day, a day with one action at the window's open end, and no day at all."""
    M = timedelta(minutes=1)
    mine = [("complete", 41, "x", 600), ("complete", 39, "y", 480), ("impression", 0, "x", 300), ("skip", 7, "z", 299), ("play", 55, "y", 1), ("play", 70, "w", 0)]
    events = [event(f"m{k}", T0 - ago * M, kind, "ann", seconds, content) for k, (kind, seconds, content, ago) in enumerate(mine)]
    events += [event("late", T0 + US, "play", "ann", 999), event("open", T0 - 24 * H, "play", "bob", 8), event("in", T0 - 24 * H + M, "skip", "bob", 3, "q")]
    got = {r.user_id: r for r in point_in_time(frame(spark, events), at(spark, ("ann", T0), ("bob", T0), ("eve", T0)), DAY, INTERACTIONS).collect()}
    names = ("actions", "finished", "seconds", "typical", "shortest", "longest", "trail", "variety", "share", "gap")
    assert [got["ann"][n] for n in names] == [6, 1, 212, 51.25, 39, 70, ["z", "y", "w"], 4, pytest.approx(1 / 6), 31]
    assert [got["bob"][n] for n in names] == [1, 0, 3, None, None, 3, ["q"], 1, -1.0, None]
    assert [got["eve"][n] for n in names] == [0, 0, 0, None, None, None, [], 0, -1.0, None]


@pytest.mark.parametrize("shift, n", [(-24 * H - US, 0), (-24 * H, 0), (-24 * H + US, 1), (timedelta(0), 1), (US, 0)])
def test_edges(spark, shift, n):
    got = point_in_time(frame(spark, [event("a", T0 + shift)]), at(spark, ("u1", T0)), RATE, INTERACTIONS).first()
    assert got.plays == n


def test_redelivery_conflict_and_repeated_observations(spark):
    e = [event("a", T0 - H), event("a", T0 - H, receipt=60), event("b", T0)]
    got = point_in_time(frame(spark, e), at(spark, ("u1", T0), ("u1", T0)), RATE, INTERACTIONS).collect()
    assert [r.plays for r in got] == [2, 2]
    with pytest.raises(IdentityConflict):
        point_in_time(frame(spark, [event("z", T0 - 99 * H), event("z", T0 - 99 * H, seconds=11)]), at(spark, ("u1", T0)), RATE, INTERACTIONS)


def world(seed):
    r = random.Random(seed)
    events = [event(f"e{i}", T0 + timedelta(minutes=r.randrange(4000)), r.choice(["play", "skip", "complete"]), f"u{r.randrange(4)}", r.randrange(50), f"c{r.randrange(5)}") for i in range(120)]
    events += [dict(e, ingested_at=e["ingested_at"] + H) for e in r.sample(events, 12)]
    edges = [e["event_time"] + d for e in r.sample(events, 15) for d in (-US, timedelta(0), US, 24 * H - US, 24 * H, 24 * H + US)]
    return events, [(f"u{r.randrange(5)}", t) for t in edges]


def test_against_the_oracle(spark):
    events, obs = world(3)
    got = {(r.user_id, r.observation_time): r for r in point_in_time(frame(spark, events), at(spark, *obs), DAY, INTERACTIONS).collect()}
    for user, t in obs:
        want = oracle.features(events, DAY, INTERACTIONS, {"user_id": user}, t)
        r = got[user, t]
        assert r.trail == want.pop("trail"), (user, t)
        assert {k: r[k] for k in want} == pytest.approx(want), (user, t)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-90_000_000_000, 1_000_000), max_size=12), st.integers(0, 3))
def test_counts_by_hypothesis(spark, offsets, kinds):
    events = [event(f"e{i}", T0 + timedelta(microseconds=o), ["play", "skip"][(i + kinds) % 2]) for i, o in enumerate(offsets)]
    want = oracle.features(events, RATE, INTERACTIONS, {"user_id": "u1"}, T0)
    got = point_in_time(frame(spark, events), at(spark, ("u1", T0)), RATE, INTERACTIONS).first()
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_panes_equal_point_in_time(spark):
    events, _ = world(5)
    s = specs.feature("w", "user_id", [{"name": "n", "op": "count"}, {"name": "s", "op": "sum", "column": "play_seconds"}], "3h", "30m")
    unique = oracle.conflict_free(events, "event_id")
    panes = sliding_windows(frame(spark, unique), s, INTERACTIONS)
    obs = panes.select("user_id", F.col("window_end").alias("observation_time"))
    want = {(r.user_id, r.observation_time): (r.n, r.s) for r in point_in_time(frame(spark, unique), obs, s, INTERACTIONS).collect()}
    got = {(r.user_id, r.window_end): (r.n, r.s) for r in panes.collect()}
    assert got == want and got


def test_label_edges_and_completeness(spark):
    s = specs.label("l", "user_id", "count", "7d", "event_type == 'play'")
    d = timedelta(days=7)
    e = frame(spark, [event("a", T0), event("b", T0 + US), event("c", T0 + d), event("d", T0 + d + US)])
    for end, complete in ((T0 + d - US, 0), (T0 + d, 1)):
        found = label(e, at(spark, ("u1", T0), ("u1", T0)), s, INTERACTIONS, F.lit(end))
        assert found.values.count() == 2 * complete and found.excluded() == 2 - 2 * complete
    row = found.values.first()
    assert (row.value, row.observable_at) == (2, T0 + d)
    exists = label(e, at(spark, ("nobody", T0)), specs.label("l", "user_id", "exists", "7d"), INTERACTIONS, F.lit(T0 + d)).values.first()
    assert exists.value is False
    with pytest.raises(ValueError):
        label(e, at(spark, ("a b", T0)), s, INTERACTIONS, F.lit(T0 + d))
    with pytest.raises(ValueError):
        label(e, at(spark, ("u1", None)), s, INTERACTIONS, F.lit(T0 + d))


def test_as_of_edges_and_ranks(spark):
    ttl = 25 * H
    v = spark.createDataFrame([("u1", T0, 1, "x"), ("u1", T0, 2, "y"), ("u1", T0 - H, 9, "z")], "user_id string, published_at timestamp, n int, tag string")
    times = [T0 - H - US, T0 - US, T0, T0 + ttl - US, T0 + ttl]
    got = {r.observation_time: (r.tag, r.status) for r in as_of(at(spark, *[("u1", t) for t in times]), v, ["user_id"], ["tag"], [F.col("n")], ttl=micros(ttl)).collect()}
    assert [got[t] for t in times] == [(None, "not_published"), ("z", "present"), ("y", "present"), ("y", "present"), (None, "expired")]
