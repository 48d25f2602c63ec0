"""Queries over the star-schema and event tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import us
from tidemark.operators import diagnostics, profiles, serving
from tidemark.operators.asof import as_of
from tidemark.operators.dataset import assemble
from tidemark.operators.features import point_in_time, sliding_windows, trailing
from tidemark.operators.identity import conflicts, first_delivery, new_only
from tidemark.operators.labels import label
from tidemark.operators.quality import duplicated_rows, report, unknown_references
from tidemark.operators.updates import decision, latest_state
from tidemark.plans import spec as specs
from tidemark.plans.contract import CLICKS
from tidemark.session import configured

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _query(sql: str):
    def add(f):
        _ALL[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configured(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def purchases(e: DataFrame) -> DataFrame:
    return e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("observation_time")).distinct()


def _plain(df: DataFrame) -> DataFrame:
    """Times without zone, as in the tables."""
    return df.select(*(F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields))


VIEWS_CLICKS = [{"name": "view_count", "op": "count", "filter": "event_type == 'view'"}, {"name": "click_count", "op": "count", "filter": "event_type == 'click'"}]
RATIO = {"click_rate": "click_count / (view_count + click_count) if (view_count + click_count) > 0 else 0.0"}
_OBS = "obs AS (SELECT DISTINCT user_id, ts AS t FROM events WHERE event_type = 'purchase')"
_IN_24H = "e.user_id = o.user_id AND e.ts > o.t - INTERVAL 24 HOUR AND e.ts <= o.t"


@_query(f"""
WITH {_OBS}
SELECT o.user_id, o.t AS observation_time, count(e.event_id) FILTER (WHERE e.event_type = 'view') AS view_count,
       count(e.event_id) FILTER (WHERE e.event_type = 'click') AS click_count
FROM obs o LEFT JOIN events e ON {_IN_24H} GROUP BY 1, 2
""")
def pit_counts_24h(spark, sf_dir):
    e = events(spark, sf_dir)
    return _plain(point_in_time(e, purchases(e), specs.feature("counts", "user_id", VIEWS_CLICKS, "24h"), CLICKS))


@_query(f"""
WITH {_OBS}, c AS (
SELECT o.user_id, o.t AS observation_time, count(e.event_id) FILTER (WHERE e.event_type = 'view') AS view_count,
       count(e.event_id) FILTER (WHERE e.event_type = 'click') AS click_count
FROM obs o LEFT JOIN events e ON {_IN_24H} GROUP BY 1, 2)
SELECT *, CASE WHEN view_count + click_count > 0 THEN click_count::DOUBLE / (view_count + click_count) ELSE 0.0::DOUBLE END AS click_rate FROM c
""")
def pit_ratio_24h(spark, sf_dir):
    e = events(spark, sf_dir)
    return _plain(point_in_time(e, purchases(e), specs.feature("ratio", "user_id", VIEWS_CLICKS, "24h", derived=RATIO), CLICKS))


@_query(f"""
WITH {_OBS}
SELECT o.user_id, o.t AS observation_time, count(e.event_id) AS n, round(coalesce(sum(e.value), 0), 4)::DOUBLE AS total, round(avg(e.value) + 1e-9::DOUBLE, 6) AS mean,
       min(e.value) AS lowest, max(e.value) AS highest, count(DISTINCT e.event_type) AS n_types,
       count(e.event_id) FILTER (WHERE e.event_type IN ('view', 'click') AND NOT e.value < 10) AS n_big
FROM obs o LEFT JOIN events e ON {_IN_24H} GROUP BY 1, 2
""")
def pit_all_ops(spark, sf_dir):
    e = events(spark, sf_dir)
    s = specs.feature(
        "all_ops", "user_id",
        [{"name": "n", "op": "count"}, {"name": "total", "op": "sum", "column": "value"}, {"name": "mean", "op": "avg", "column": "value"},
         {"name": "lowest", "op": "min", "column": "value"}, {"name": "highest", "op": "max", "column": "value"},
         {"name": "n_types", "op": "approx_distinct", "column": "event_type"},
         {"name": "n_big", "op": "count", "filter": "event_type in ('view', 'click') and not value < 10"}], "24h",
    )
    out = _plain(point_in_time(e, purchases(e), s, CLICKS))
    return out.withColumn("total", F.round(F.col("total").cast("double"), 4)).withColumn("mean", F.round(F.col("mean") + 1e-9, 6))


@_query(f"""
WITH {_OBS}, r AS (
SELECT o.user_id, o.t, e.event_id, row_number() OVER (PARTITION BY o.user_id, o.t ORDER BY e.ts DESC, e.event_id::VARCHAR DESC) AS r, e.ts
FROM obs o LEFT JOIN events e ON {_IN_24H})
SELECT user_id, t AS observation_time, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id::VARCHAR) FILTER (WHERE r <= 3), '') AS last_three FROM r GROUP BY 1, 2
""")
def pit_last_k(spark, sf_dir):
    e = events(spark, sf_dir)
    s = specs.feature("last", "user_id", [{"name": "last", "op": "last_k", "column": "event_id", "k": 3}], "24h")
    return _plain(point_in_time(e, purchases(e), s, CLICKS)).select("user_id", "observation_time", F.array_join(F.transform("last", lambda x: x.cast("string")), ",").alias("last_three"))


@_query("""
WITH obs AS (SELECT DISTINCT user_id, event_type, ts AS t FROM events WHERE event_type IN ('purchase', 'view'))
SELECT o.user_id, o.event_type, o.t AS observation_time, count(e.event_id) AS n, round(coalesce(sum(e.value), 0), 4)::DOUBLE AS total
FROM obs o LEFT JOIN events e ON e.user_id = o.user_id AND e.event_type = o.event_type AND e.ts > o.t - INTERVAL 24 HOUR AND e.ts <= o.t GROUP BY 1, 2, 3
""")
def pit_composite_key(spark, sf_dir):
    e = events(spark, sf_dir)
    obs = e.where("event_type IN ('purchase', 'view')").select("user_id", "event_type", F.col("ts").alias("observation_time")).distinct()
    s = specs.feature("pair", ["user_id", "event_type"], [{"name": "n", "op": "count"}, {"name": "total", "op": "sum", "column": "value"}], "24h")
    return _plain(point_in_time(e, obs, s, CLICKS)).withColumn("total", F.round(F.col("total").cast("double"), 4))


@_query("""
SELECT event_id, user_id, ts, count(value) OVER w AS trailing_count, round(coalesce(sum(value) OVER w, 0), 4)::DOUBLE AS trailing_sum
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)
""")
def trailing_24h(spark, sf_dir):
    t = trailing(events(spark, sf_dir), ["user_id"], F.col("value"), 86_400_000_000, CLICKS)
    return _plain(t.select("event_id", "user_id", "ts", "trailing_count", F.round("trailing_sum", 4).alias("trailing_sum")))


_LABEL = f"""
WITH {_OBS}, fin AS (SELECT max(ts) AS data_end FROM events), whole AS (SELECT o.* FROM obs o, fin WHERE o.t + INTERVAL 7 DAY <= data_end)
SELECT o.user_id, o.t AS observation_time, %s AS value, o.t + INTERVAL 7 DAY AS observable_at
FROM whole o LEFT JOIN events e ON e.user_id = o.user_id AND e.ts > o.t AND e.ts <= o.t + INTERVAL 7 DAY %s GROUP BY 1, 2, 4
"""


def _labels(spark, sf_dir, op: str, text: str | None = None):
    e = events(spark, sf_dir)
    return label(e, purchases(e), specs.label("active", "user_id", op, "7d", text), CLICKS, F.lit(e.agg(F.max("ts")).first()[0]))


@_query(_LABEL % ("count(e.event_id) > 0", "AND e.event_type = 'signup'"))
def label_exists_7d(spark, sf_dir):
    return _plain(_labels(spark, sf_dir, "exists", "event_type == 'signup'").values)


@_query(_LABEL % ("count(e.event_id)", ""))
def label_count_7d(spark, sf_dir):
    return _plain(_labels(spark, sf_dir, "count").values)


@_query(f"""
WITH {_OBS}, fin AS (SELECT max(ts) AS data_end FROM events)
SELECT count(*) FILTER (WHERE t + INTERVAL 7 DAY > data_end) AS n_incomplete, count(*) FILTER (WHERE t + INTERVAL 7 DAY <= data_end) AS n_complete FROM obs, fin
""")
def label_excluded(spark, sf_dir):
    found = _labels(spark, sf_dir, "count")
    both = found.incomplete.select(F.lit(1).alias("i")).unionByName(found.complete.select(F.lit(0).alias("i")))
    return both.agg(F.coalesce(F.sum("i"), F.lit(0)).alias("n_incomplete"), F.coalesce(F.sum(1 - F.col("i")), F.lit(0)).alias("n_complete"))


@_query(f"""
WITH {_OBS}, fin AS (SELECT max(ts) AS data_end FROM events), whole AS (SELECT o.* FROM obs o, fin WHERE o.t + INTERVAL 7 DAY <= data_end),
l AS (SELECT o.user_id, o.t, count(e.event_id) AS n FROM whole o LEFT JOIN events e ON e.user_id = o.user_id AND e.event_type = 'purchase' AND e.ts > o.t AND e.ts <= o.t + INTERVAL 7 DAY GROUP BY 1, 2),
f AS (SELECT o.user_id, o.t, count(e.event_id) FILTER (WHERE e.event_type = 'view') AS v, count(e.event_id) FILTER (WHERE e.event_type = 'click') AS c
      FROM whole o LEFT JOIN events e ON {_IN_24H} GROUP BY 1, 2)
SELECT l.user_id, l.t AS observation_time, l.n > 0 AS label__buys_again, l.t + INTERVAL 7 DAY AS label__buys_again__observable_at, f.v AS ratio__view_count, f.c AS ratio__click_count,
       CASE WHEN v + c > 0 THEN c::DOUBLE / (v + c) ELSE 0.0::DOUBLE END AS ratio__click_rate
FROM l JOIN f ON l.user_id = f.user_id AND l.t = f.t
""")
def dataset_event_time(spark, sf_dir):
    e = events(spark, sf_dir)
    target = specs.label("buys_again", "user_id", "exists", "7d", "event_type == 'purchase'")
    out, _ = assemble(e, purchases(e), [specs.feature("ratio", "user_id", VIEWS_CLICKS, "24h", derived=RATIO)], target, CLICKS, F.lit(e.agg(F.max("ts")).first()[0]), "event_time")
    return _plain(out)


def _versions(e: DataFrame) -> DataFrame:
    """A history made of views: published up to ten minutes after they happened."""
    late = F.timestamp_micros(us(F.col("ts")) + (F.col("event_id") % 600) * 1_000_000)
    return e.where("event_type = 'view'").select("user_id", late.alias("published_at"), F.col("value").alias("score"), "event_id")


_ASOF = f"""
WITH {_OBS}, v AS (SELECT user_id, ts + INTERVAL 1 SECOND * (event_id %% 600) AS p, value AS score, event_id FROM events WHERE event_type = 'view'),
j AS (SELECT o.user_id, o.t, v.score, v.p, v.event_id, row_number() OVER (PARTITION BY o.user_id, o.t ORDER BY v.p DESC NULLS LAST, v.event_id DESC) AS r
      FROM obs o LEFT JOIN v ON v.user_id = o.user_id AND v.p <= o.t),
s AS (SELECT *, CASE WHEN p IS NULL THEN 'not_published' WHEN t >= p + INTERVAL %s THEN 'expired' ELSE 'present' END AS status FROM j WHERE r = 1)
SELECT user_id, t AS observation_time, CASE WHEN status = 'present' THEN score END AS score, CASE WHEN status = 'present' THEN event_id END AS event_id,
       CASE WHEN status = 'present' THEN p END AS published_at, status FROM s
"""


@_query(_ASOF % "25 HOUR")
def asof_published(spark, sf_dir):
    e = events(spark, sf_dir)
    return _plain(as_of(purchases(e), _versions(e), ["user_id"], ["score", "event_id"], [F.col("event_id")], ttl=25 * 3_600_000_000))


@_query(f"""
WITH v AS (SELECT user_id, ts + INTERVAL 1 SECOND * (event_id % 600) AS p, event_id FROM events WHERE event_type = 'view'),
obs AS (SELECT DISTINCT user_id, t FROM (SELECT user_id, p AS t FROM v UNION ALL SELECT user_id, p - INTERVAL 1 MICROSECOND FROM v UNION ALL SELECT user_id, p + INTERVAL 1 HOUR FROM v)),
j AS (SELECT o.user_id, o.t, v.p, row_number() OVER (PARTITION BY o.user_id, o.t ORDER BY v.p DESC NULLS LAST) AS r FROM obs o LEFT JOIN v ON v.user_id = o.user_id AND v.p <= o.t)
SELECT CASE WHEN p IS NULL THEN 'not_published' WHEN t >= p + INTERVAL 1 HOUR THEN 'expired' ELSE 'present' END AS status, count(*) AS n FROM j WHERE r = 1 GROUP BY 1
""")
def asof_boundary(spark, sf_dir):
    v = _versions(events(spark, sf_dir))
    at = us(F.col("published_at"))
    edges = F.explode(F.array(at, at - 1, at + 3_600_000_000)).alias("u")
    obs = v.select("user_id", edges).select("user_id", F.timestamp_micros("u").alias("observation_time"))
    return as_of(obs, v, ["user_id"], ["event_id"], [F.col("event_id")], ttl=3_600_000_000).groupBy("status").agg(F.count(F.lit(1)).alias("n"))




def _profile(spark, sf_dir, days):
    e = events(spark, sf_dir)
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    measures = {
        "event_count": F.count(F.lit(1)), "type_count": F.count_distinct("event_type"), "total_value": F.round(F.sum("value"), 4),
        "view_count": profiles.count_of("event_type", "view"), "mean_value": F.round(profiles.ratio(F.sum("value"), F.count(F.lit(1))) + 1e-9, 6),
    }
    out = profiles.profile(e, users, "user_id", days, 7, measures, "ts", "days_since")
    return out.withColumn("days_since", F.round("days_since", 6)).withColumn("observation_date", F.col("observation_date").cast("string"))


_PROFILE = """
WITH d AS (SELECT unnest(generate_series(DATE '%s', DATE '%s', INTERVAL 1 DAY))::DATE AS day), u AS (SELECT DISTINCT c_custkey AS user_id FROM customer),
j AS (SELECT u.user_id, d.day, count(e.event_id) AS event_count, count(DISTINCT e.event_type) AS type_count, sum(e.value) AS s, count(*) FILTER (WHERE e.event_type = 'view') AS view_count, max(e.ts) AS last
      FROM u CROSS JOIN d LEFT JOIN events e ON e.user_id = u.user_id AND e.ts > d.day::TIMESTAMP - INTERVAL 7 DAY AND e.ts <= d.day::TIMESTAMP GROUP BY 1, 2)
SELECT user_id, strftime(day, '%%Y-%%m-%%d') AS observation_date, 7::INTEGER AS window_days, event_count, type_count, coalesce(round(s, 4), 0) AS total_value, view_count,
       CASE WHEN event_count > 0 THEN round(s / event_count + 1e-9::DOUBLE, 6) ELSE 0 END AS mean_value, round((epoch_us(day::TIMESTAMP) - epoch_us(last)) / 86400000000.0::DOUBLE, 6) AS days_since FROM j
"""


@_query(_PROFILE % ("2024-01-15", "2024-01-15"))
def profile_user_7d(spark, sf_dir):
    return _profile(configured(spark), sf_dir, profiles.dates(spark, date(2024, 1, 15), date(2024, 1, 15)))


@_query(_PROFILE % ("2024-01-08", "2024-01-14"))
def profile_backfill_days(spark, sf_dir):
    return _profile(configured(spark), sf_dir, profiles.dates(spark, date(2024, 1, 8), date(2024, 1, 14)))


_WINDOWS = """
WITH p AS (SELECT user_id, event_type, ((epoch_us(ts) + %(slide)d - 1) // %(slide)d) * %(slide)d AS pane FROM events),
w AS (SELECT user_id, event_type, make_timestamp(pane + %(slide)d::BIGINT * k) AS window_end FROM p, unnest(range(%(n)d)) AS r(k))
SELECT user_id, window_end, count(*) FILTER (WHERE event_type = 'view') AS view_count, count(*) FILTER (WHERE event_type = 'click') AS click_count FROM w GROUP BY 1, 2
"""


def _windows(spark, sf_dir, size: str, slide: str):
    return _plain(sliding_windows(events(spark, sf_dir), specs.feature("w", "user_id", VIEWS_CLICKS, size, slide), CLICKS))


@_query(_WINDOWS % {"slide": 3_600_000_000, "n": 1})
def tumbling_1h(spark, sf_dir):
    return _windows(spark, sf_dir, "1h", "1h")


@_query(_WINDOWS % {"slide": 600_000_000, "n": 6})
def sliding_1h_10m(spark, sf_dir):
    return _windows(spark, sf_dir, "1h", "10m")


@_query(_WINDOWS % {"slide": 3_600_000_000, "n": 24})
def pane_sliding_24h(spark, sf_dir):
    return _windows(spark, sf_dir, "24h", "1h")


def _copies(e: DataFrame) -> DataFrame:
    """Events with redeliveries (every 50th) and conflicts (every 70th)."""
    return e.unionByName(e.where("event_id % 50 = 0")).unionByName(e.where("event_id % 70 = 0").withColumn("value", F.col("value") + 1))


@_query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def dedupe_first(spark, sf_dir):
    e = events(spark, sf_dir)
    kept = first_delivery(e.unionByName(e.where("event_id % 50 = 0")), CLICKS)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@_query("SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 3 ELSE 2 END::BIGINT AS rows FROM events WHERE event_id % 70 = 0")
def identity_conflicts(spark, sf_dir):
    return conflicts(_copies(events(spark, sf_dir)), CLICKS)


@_query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def antijoin_new(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id")
    return new_only(e, e.where("event_id % 3 = 0"), "event_id")


_HOURLY = "h AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1, 2)"


def _hourly(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(profiles.count_of("event_type", "view").alias("v"), profiles.count_of("event_type", "click").alias("c"))


@_query(f"""
WITH {_HOURLY}, d AS (SELECT user_id, date_trunc('day', h) AS day, v, c, lag(v) OVER w AS v0, lag(c) OVER w AS c0 FROM h WINDOW w AS (PARTITION BY user_id, date_trunc('day', h) ORDER BY h))
SELECT CASE WHEN v0 IS NULL THEN 'written' WHEN v = v0 AND c = c0 THEN 'unchanged' WHEN v >= v0 AND c >= c0 THEN 'written' WHEN v <= v0 AND c <= c0 THEN 'stale' ELSE 'conflict' END AS outcome, count(*) AS n FROM d GROUP BY 1
""")
def count_vector_decision(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "day").orderBy("h")
    d = _hourly(spark, sf_dir).withColumn("day", F.date_trunc("day", "h"))
    d = d.withColumn("v0", F.lag("v").over(w)).withColumn("c0", F.lag("c").over(w)).withColumn("t0", F.when(F.col("v0").isNotNull(), F.col("day")))
    return d.withColumn("outcome", decision(F.col("t0"), F.col("day"), {"v": (F.col("v0"), F.col("v")), "c": (F.col("c0"), F.col("c"))})).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_HOURLY} SELECT user_id, h AS observation_time, v, c FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY h DESC) = 1")
def latest_online_state(spark, sf_dir):
    return _plain(latest_state(_hourly(spark, sf_dir).withColumnRenamed("h", "observation_time"), ["user_id"], ["v", "c"]))


@_query("""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_quantity <= 0) AS bad_quantity, count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.1) AS bad_discount,
       count(*) FILTER (WHERE l_returnflag IS NULL OR trim(l_returnflag) = '') AS blank_flag, count(*) FILTER (WHERE l_shipdate < DATE '1993-01-01') AS early,
       (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS n_unknown,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS n_duplicated FROM lineitem
""")
def quality_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = F.col
    checks = {"bad_quantity": c("l_quantity") <= 0, "bad_discount": (c("l_discount") < 0) | (c("l_discount") > 0.1), "blank_flag": c("l_returnflag").isNull() | (F.trim("l_returnflag") == ""), "early": c("l_shipdate") < F.lit(date(1993, 1, 1))}
    known = unknown_references(li, "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey")
    twice = duplicated_rows(li, ["l_orderkey", "l_linenumber"]).withColumnRenamed("n_rows", "n_duplicated")
    tagged = [f.withColumn("_one", F.lit(1)) for f in (report(li, checks), known, twice)]  # one row each
    return tagged[0].join(tagged[1], "_one").join(tagged[2], "_one").drop("_one")


@_query("""
SELECT strftime(ts::DATE, '%Y-%m-%d') AS observation_date, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS no_value, count(*) FILTER (WHERE value < 0) AS negative,
       date_diff('day', ts::DATE, DATE '2024-02-01')::INTEGER AS lag_days, date_diff('day', ts::DATE, DATE '2024-02-01') BETWEEN 0 AND 10 AS fresh FROM events GROUP BY ts::DATE
""")
def freshness(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("observation_date", F.to_date("ts"))
    r = report(e, {"no_value": F.col("value").isNull(), "negative": F.col("value") < 0}, ["observation_date"])
    lag = F.datediff(F.lit(date(2024, 2, 1)), F.col("observation_date"))
    return r.withColumn("lag_days", lag).withColumn("fresh", F.col("lag_days").between(0, 10)).withColumn("observation_date", F.col("observation_date").cast("string"))


@_query("""
WITH s AS (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS m, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
r AS (SELECT p_partkey, p_name, round(0.6 * least(coalesce(n, 0) / 50.0::DOUBLE, 1) + 0.4 * least(coalesce(q, 0) / 2000.0::DOUBLE, 1), 6) AS score FROM part LEFT JOIN s ON l_partkey = p_partkey)
SELECT * FROM r ORDER BY score DESC, p_partkey LIMIT 20
""")
def rank_topk(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name").join(s, "p_partkey", "left")
    total = 0.6 * serving.bounded(F.coalesce("n", F.lit(0)), 50.0) + 0.4 * serving.bounded(F.coalesce("q", F.lit(0)), 2000.0)
    return p.select("p_partkey", "p_name", F.round(total, 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)


@_query(f"""
WITH {_HOURLY}, s AS (SELECT user_id, h AS t, v, c FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY h DESC) = 1)
SELECT k.c_custkey AS user_id, coalesce(v, 0)::DOUBLE AS view_count, coalesce(c, 0)::DOUBLE AS click_count,
       CASE WHEN t IS NULL THEN 'missing' WHEN age < 0 OR age > 172800 THEN 'stale' ELSE 'ok' END AS status, CASE WHEN t IS NULL THEN NULL WHEN age < 0 THEN 'future' WHEN age > 172800 THEN 'stale' ELSE 'fresh' END AS freshness,
       age AS age_seconds, t IS NULL AS defaulted
FROM customer k LEFT JOIN (SELECT *, (epoch_us(TIMESTAMP '2024-01-30 22:30:00') - epoch_us(t)) / 1000000.0::DOUBLE AS age FROM s) s ON s.user_id = k.c_custkey
""")
def online_lookup_status(spark, sf_dir):
    state = latest_state(_hourly(spark, sf_dir).withColumnRenamed("h", "observation_time"), ["user_id"], ["v", "c"])
    state = state.select("user_id", "observation_time", F.col("v").cast("double").alias("view_count"), F.col("c").cast("double").alias("click_count"))
    s = specs.feature("counts", "user_id", VIEWS_CLICKS, "1h", freshness_slo="2d", online={"fallback": {"policy": "default_value", "defaults": {"view_count": 0.0, "click_count": 0.0}}})
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return serving.lookup(users, state, s, F.lit("2024-01-30 22:30:00").cast("timestamp")).drop("fails_request")


def _halves(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("hour", F.hour("ts").cast("double"))
    mid = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return e.where(F.col("ts") < mid), e.where(F.col("ts") >= mid)


@_query("""
WITH x AS (SELECT value, hour(ts)::DOUBLE AS hour, ts < TIMESTAMP '2024-01-16' AS train FROM events), u AS (SELECT 'value' AS name, value AS v, train FROM x UNION ALL SELECT 'hour', hour, train FROM x),
m AS (SELECT name, avg(v) FILTER (WHERE train) AS a, avg(v) FILTER (WHERE NOT train) AS b, stddev_pop(v) FILTER (WHERE train) AS s FROM u GROUP BY 1)
SELECT name, round(a, 6) AS train_mean, round(b, 6) AS test_mean, round((b - a) / s, 6) AS shift FROM m
""")
def drift(spark, sf_dir):
    out = diagnostics.drift(*_halves(spark, sf_dir), ["value", "hour"])
    return out.select("name", *(F.round(c, 6).alias(c) for c in ("train_mean", "test_mean", "shift")))


@_query("""
WITH f AS (SELECT min(ts)::DATE AS d FROM events)
SELECT (date_diff('day', f.d, ts::DATE) // 7)::BIGINT AS period, count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'purchase') AS positives, round(avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END), 6) AS rate,
       count(*) FILTER (WHERE event_type != 'purchase') AS negatives FROM events, f GROUP BY 1
""")
def weekly_rate(spark, sf_dir):
    return diagnostics.weekly_rate(events(spark, sf_dir), "ts", F.col("event_type") == "purchase").withColumn("rate", F.round("rate", 6))


@_query("""
WITH r AS (SELECT event_type = 'purchase' AS y, (rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE) AS r FROM events WHERE value IS NOT NULL),
a AS (SELECT sum(r) FILTER (WHERE y) AS rs, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM r)
SELECT round((rs - p * (p + 1) / 2.0::DOUBLE) / (p * n::DOUBLE), 6) AS auc FROM a
""")
def auc(spark, sf_dir):
    return diagnostics.auc(events(spark, sf_dir), "value", F.col("event_type") == "purchase").select(F.round("auc", 6).alias("auc"))


@_query("""
WITH x AS (SELECT *, ts < TIMESTAMP '2024-01-16' AS train FROM events), q AS (SELECT quantile_cont(value, 0.0) AS a, quantile_cont(value, 0.25) AS b, quantile_cont(value, 0.5) AS c, quantile_cont(value, 0.75) AS d, quantile_cont(value, 1.0) AS e FROM x WHERE train)
SELECT CASE WHEN value <= b THEN 0 WHEN value <= c THEN 1 WHEN value <= d THEN 2 ELSE 3 END::INTEGER AS bin, count(*) AS n_rows, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS rate
FROM x, q WHERE NOT train AND value BETWEEN a AND e GROUP BY 1
""")
def quantile_rates(spark, sf_dir):
    train, test = _halves(spark, sf_dir)
    edges = diagnostics.quantile_edges(train, "value")
    return diagnostics.quantile_rates(test, "value", F.col("event_type") == "purchase", edges).withColumn("rate", F.round("rate", 6))


@_query("""
WITH n AS (SELECT count(*) AS n FROM events), r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM events)
SELECT CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * (0.7 + 0.15)) THEN 'validation' ELSE 'test' END AS split, count(*) AS n_rows, min(ts) AS first, max(ts) AS last FROM r, n GROUP BY 1
""")
def split(spark, sf_dir):
    out = diagnostics.time_split(events(spark, sf_dir), "ts", "event_id")
    return _plain(out.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first"), F.max("ts").alias("last")))


@_query("""
WITH t AS (SELECT event_type = 'purchase' AS y FROM events ORDER BY value DESC, event_id LIMIT 100)
SELECT avg(CASE WHEN y THEN 1.0 ELSE 0.0 END)::DOUBLE AS precision, round(count(*) FILTER (WHERE y) / (SELECT count(*) FROM events WHERE event_type = 'purchase')::DOUBLE, 9) AS recall FROM t
""")
def precision_at_100(spark, sf_dir):
    e = events(spark, sf_dir).where("value IS NOT NULL")
    return diagnostics.at_k(e, "value", F.col("event_type") == "purchase", "event_id", 100).withColumn("recall", F.round("recall", 9))


@_query("""
WITH u AS (SELECT 'value' AS name, value AS v FROM events UNION ALL SELECT 'user_id', user_id::DOUBLE FROM events)
SELECT name, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS null_rate, (count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END))::BIGINT AS n_distinct, min(v) AS low, max(v) AS high, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) <= 1 AS constant FROM u GROUP BY 1
""")
def column_profile(spark, sf_dir):
    return diagnostics.column_profile(events(spark, sf_dir), ["value", "user_id"])


@_query("SELECT (props->>'k')::BIGINT AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy(F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@_query("""
SELECT n_name, c_mktsegment, count(DISTINCT o_orderkey) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= DATE '1995-01-01' GROUP BY 1, 2
""")
def star_revenue(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit(date(1995, 1, 1)))
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@_query("""
WITH e AS (SELECT *, ts < TIMESTAMP '2024-01-16' AS train FROM events), q AS (SELECT quantile_cont(value, 0.0) AS a, quantile_cont(value, 0.25) AS b, quantile_cont(value, 0.5) AS c, quantile_cont(value, 0.75) AS d, quantile_cont(value, 1.0) AS z FROM e WHERE train),
x AS (SELECT train, event_type = 'purchase' AS y, CASE WHEN value <= b THEN 0 WHEN value <= c THEN 1 WHEN value <= d THEN 2 ELSE 3 END::INTEGER AS bin FROM e, q WHERE value BETWEEN a AND z)
SELECT bin, nullif(count(*) FILTER (WHERE train), 0) AS train_rows, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) FILTER (WHERE train), 6) AS train_rate,
       nullif(count(*) FILTER (WHERE NOT train), 0) AS test_rows, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT train), 6) AS test_rate FROM x GROUP BY 1
""")
def compare_bins(spark, sf_dir):
    train, test = _halves(spark, sf_dir)
    out = diagnostics.compare_bins(train, test, "value", F.col("event_type") == "purchase")
    return out.select("bin", "train_rows", F.round("train_rate", 6).alias("train_rate"), "test_rows", F.round("test_rate", 6).alias("test_rate"))


@_query("""
WITH s AS (SELECT user_id, count(*) AS event_count, count(DISTINCT event_type) AS unique_content_count, sum(value) AS total_watch_seconds, count(*) FILTER (WHERE event_type = 'click') AS search_count,
                  count(*) FILTER (WHERE event_type = 'view') AS play_count, count(*) FILTER (WHERE event_type = 'purchase') AS watch_count, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 86400000000.0::DOUBLE AS days FROM events GROUP BY 1)
SELECT user_id, round(round(0.30::DOUBLE * least(event_count / 10.0::DOUBLE, 1) + 0.20::DOUBLE * least(unique_content_count / 10.0::DOUBLE, 1) + 0.15::DOUBLE * least(total_watch_seconds / 3600.0::DOUBLE, 1) + 0.10::DOUBLE * least(search_count / 3.0::DOUBLE, 1)
       + 0.10::DOUBLE * least(play_count / 3.0::DOUBLE, 1) + 0.05::DOUBLE * least(watch_count / 3.0::DOUBLE, 1) + 0.10::DOUBLE * greatest(0, 1 - least(days, 7) / 7.0::DOUBLE), 6) + 1e-10::DOUBLE, 5) AS score FROM s
""")
def engagement_score(spark, sf_dir):
    e = events(spark, sf_dir)
    count = profiles.count_of
    s = e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.count_distinct("event_type").alias("unique_content_count"), F.sum("value").alias("total_watch_seconds"), count("event_type", "click").alias("search_count"),
        count("event_type", "view").alias("play_count"), count("event_type", "purchase").alias("watch_count"), ((us(F.lit("2024-01-31").cast("timestamp")) - F.max(us(F.col("ts")))) / 86_400_000_000.0).alias("days_since_last_activity"),
    )
    return s.select("user_id", F.round(serving.user_score() + 1e-10, 5).alias("score"))


@_query("""
WITH r AS (SELECT o_custkey, count(*) FILTER (WHERE n_copy > 1) AS repeated FROM (SELECT o_custkey, o_orderpriority, count(*) AS n_copy FROM orders GROUP BY 1, 2) GROUP BY 1)
SELECT c_custkey, coalesce(repeated, 0) AS repeated FROM customer LEFT JOIN r ON o_custkey = c_custkey WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)
""")
def repeated_priorities(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    r = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("repeated"))
    c = table(spark, sf_dir, "customer")
    known = c.join(table(spark, sf_dir, "nation"), c["c_nationkey"] == F.col("n_nationkey"), "left_semi")
    return known.join(r, "c_custkey", "left").select("c_custkey", F.coalesce("repeated", F.lit(0)).alias("repeated"))
