import pytest
from pyspark.sql import functions as F

from tidemark.functions.expressions import DERIVED_NODES, FILTER_NODES, Compiler, names_in
from tidemark.functions.times import duration, micros
from tidemark.plans import spec as specs
from tidemark.plans.contract import CLICKS, INTERACTIONS

COUNT = [{"name": "n", "op": "count"}]


def make(**more):
    return specs.feature("f", "user_id", COUNT, "24h", **more)


@pytest.mark.parametrize("text", ["f(x)", "a.b", "a % 2 == 0", "a ** 2", "a // 2", "a is None", "a[0]", "lambda: 1", "a ==", "a + 1"])
def test_filters_reject(text):
    with pytest.raises(ValueError):
        names_in(text, FILTER_NODES)


def test_names():
    assert names_in("a > 1 and b in (1, 2)", FILTER_NODES) == {"a", "b"}
    assert names_in("x / y if y > 0 else -1.0", DERIVED_NODES) == {"x", "y"}


@pytest.mark.parametrize("value, seconds", [("5s", 5), ("10m", 600), ("24h", 86400), ("7d", 604800)])
def test_duration(value, seconds):
    assert duration(value).total_seconds() == seconds and micros(value) == seconds * 10**6


@pytest.mark.parametrize("value", ["", "5", "h", "1.5h", "-1h", "1w", None, 5])
def test_bad_duration(value):
    with pytest.raises(ValueError):
        duration(value)


@pytest.mark.parametrize(
    "change",
    [
        {"version": 0}, {"name": "Bad"}, {"slide": "7h"}, {"dedupe": {"key": "event_id", "ttl": "24h"}}, {"derived": {"d": "missing + 1"}},
        {"derived": {"n": "n + 1"}}, {"aggregations": [*COUNT, *COUNT]}, {"aggregations": [{"name": "s", "op": "sum"}]},
        {"aggregations": [{"name": "s", "op": "last_k", "column": "value"}]}, {"aggregations": [{"name": "s", "op": "count", "k": 1}]},
        {"aggregations": [{"name": "s", "op": "median", "column": "value"}]}, {"online": {"ttl": "1h"}}, {"online": {"store": "disk"}},
        {"update_policy": "append_only", "aggregations": [{"name": "s", "op": "sum", "column": "value"}]},
        {"update_policy": "append_only", "aggregations": [*COUNT, {"name": "m", "op": "count"}]},
        {"online": {"fallback": {"policy": "default_value", "defaults": {}}}}, {"online": {"fallback": {"policy": "omit", "defaults": {"n": 0}}}},
        {"offline": {"store": "iceberg", "table": "plain"}}, {"window": {"size": "1h", "slide": "1h", "boundary": "left_closed"}},
    ],
)
def test_bad_specs(change):
    base = {"name": "f", "entity": "user_id", "aggregations": COUNT, "window": "24h"}
    if isinstance(change.get("window"), dict):
        with pytest.raises(ValueError):
            specs.Window(**change["window"])
        return
    with pytest.raises(ValueError):
        specs.feature(**(base | change))


def test_fields_must_be_in_the_contract():
    with pytest.raises(ValueError, match="contract"):
        specs.feature("f", "account", COUNT, "1h").check(CLICKS)
    with pytest.raises(ValueError, match="never is"):
        specs.label("l", "user_id", "exists", "7d", "event_type == 'jump'").check(INTERACTIONS)
    specs.label("l", "user_id", "count", "7d", "event_type in ('play', 'skip')").check(INTERACTIONS)


def test_yaml(tmp_path):
    p = tmp_path / "s.yaml"
    p.write_text(
        "{name: r, version: 1, owner: o, description: d, entity: user_id, source: s, aggregations: [{name: n, op: count, filter: \"event_type == 'play'\"}],"
        " window: {size: 1h, slide: 1m, boundary: right_closed}, lateness: {watermark_delay: 1m, allowed: 30m}, dedupe: {key: event_id, ttl: 2h},"
        " online: {store: redis, ttl: 2h, update_policy: append_only}, offline: {store: iceberg, table: a.b}, freshness_slo: 5m}"
    )
    s = specs.load(str(p), INTERACTIONS)
    assert s.outputs == ["n"] and s.keys == ["user_id"]
    p.write_text("{name: l, version: 1, owner: o, description: d, entity: [user_id, source], source: s, outcome: {op: exists}, horizon: 7d, dedupe: {key: event_id}}")
    assert specs.load(str(p), INTERACTIONS).keys == ["user_id", "source"]
    p.write_text("{name: l, nonsense: 1}")
    with pytest.raises(ValueError):
        specs.load(str(p))


def test_predicates_never_null(spark):
    df = spark.createDataFrame([(1, "a", True), (None, None, None), (0, "", False)], "x int, s string, b boolean")
    c = Compiler({k: F.col(k) for k in "xsb"}, {"x": "int", "s": "string", "b": "boolean"})
    cases = {
        "x == 1": [True, False, False], "x != 1": [False, True, True], "x not in (1, 2)": [False, True, True], "x in (1, 2)": [True, False, False],
        "not x > 0": [False, True, True], "x": [True, False, False], "s": [True, False, False], "b": [True, False, False], "0 <= x < 1": [False, False, True],
        "s == None": [False, True, False], "x == 1 or s == ''": [True, False, True],
    }
    got = df.select(*(c.predicate(t).alias(f"c{i}") for i, t in enumerate(cases))).collect()
    for i, (text, expected) in enumerate(cases.items()):
        assert [r[i] for r in got] == expected, text


def test_derived_null_and_guard(spark):
    df = spark.createDataFrame([(1, 2), (0, 0), (None, 1)], "a long, b long")
    c = Compiler({k: F.col(k) for k in "ab"})
    got = df.select(c.value("a / b if b > 0 else 0.0").alias("v"), c.value("-a + 2 * b").alias("w"), c.value("1.5").alias("k")).collect()
    assert [tuple(r) for r in got] == [(0.5, 3, 1.5), (0.0, 0, 1.5), (None, None, 1.5)]
