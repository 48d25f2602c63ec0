"""Queries that run whole jobs: streams over what there is, table layers, stores and requests.

Each writes to the shared folder what a job would write, and returns it read back.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import us
from tidemark.operators import dataset, profiles, records, serving
from tidemark.operators.asof import history_start
from tidemark.operators.quality import Expected, FeatureView, check_view, dataset_report
from tidemark.operators.updates import latest_state, update_id
from tidemark.plans import spec as specs
from tidemark.plans.catalog import RATIO, VIEWS_CLICKS, _plain, _query, events, purchases, table
from tidemark.plans.contract import CLICKS, EventContract
from tidemark.session import work_path
from tidemark.sources import registry
from tidemark.sources.files import parsed_events, read_events_jsonl
from tidemark.sources.snapshots import SnapshotTable
from tidemark.streaming.feature_stream import FeatureStream
from tidemark.streaming.windows import deduplicated_for, validated, windowed

#: The same events under a contract that knows three kinds only.
THREE_KINDS = EventContract(columns=CLICKS.columns, time="ts", identity="event_id", allowed={"event_type": ("click", "view", "purchase")})
COUNTS = specs.feature("counts", "user_id", VIEWS_CLICKS, "1h", update_policy="componentwise_monotonic", lateness={"watermark_delay": "10m", "allowed": "30m"})
_HOUR = "time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR"


def _stream(spark, sf_dir: str) -> DataFrame:
    """The event table as a stream of its files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows a bounded run of a stream gives, with the number of the batch (``_batch``)."""
    spark = stream.sparkSession
    out = work_path(spark, name)

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/_batch={number}")

    # Timers of kept state would ask for batches without data for ever; a bounded run has none.
    quiet = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(quiet)
    spark.conf.set(quiet, "false")
    started = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", work_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start()
    spark.conf.set(quiet, before)
    started.awaitTermination()
    if started.exception():
        raise started.exception()
    return spark.read.option("basePath", out).schema(stream.schema.add("_batch", "long")).parquet(out)


@_query(f"""
SELECT user_id, {_HOUR} - INTERVAL 1 HOUR AS window_start_exclusive, {_HOUR} AS observation_time, count(*) FILTER (WHERE event_type = 'view') AS view_count,
       count(*) FILTER (WHERE event_type = 'click') AS click_count FROM events GROUP BY 1, 2, 3
""")
def stream_windows_1h(spark, sf_dir):
    """Watermarked right-closed windows of a stream; of a window's corrections the last one counts."""
    found = _finished(windowed(validated(_stream(spark, sf_dir), CLICKS), COUNTS, CLICKS), "stream-windows", "update")
    last = Window.partitionBy("user_id", "observation_time").orderBy(F.desc("_batch"))
    return _plain(found.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_batch"))


@_query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY 1")
def stream_dedupe(spark, sf_dir):
    """Every event delivered twice; one is kept in keyed state with a time to live."""
    twice = _stream(spark, sf_dir).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("_n")).drop("_n")
    kept = _finished(deduplicated_for(twice, CLICKS, "1d"), "stream-dedupe")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"))


def _lines(frame: DataFrame) -> DataFrame:
    return frame.select(F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "user_id", "event_type", "value", "props")).alias("value"))


@_query("""
SELECT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'valid' ELSE 'EVENT_CONTRACT_VIOLATION' END AS route, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT 'INVALID_JSON', count(*) FROM events WHERE event_id % 100 = 0
""")
def stream_routes(spark, sf_dir):
    """Text lines validated and routed; one more broken line for every hundredth event."""
    e = _stream(spark, sf_dir)
    good = _lines(e)
    broken = e.where("event_id % 100 = 0").select(F.concat(F.lit("{broken "), F.col("event_id").cast("string")).alias("value"))
    rows = parsed_events(good.unionByName(broken), THREE_KINDS)
    found = _finished(rows.select(F.coalesce("reason_code", F.lit("valid")).alias("route")), "stream-routes")
    return found.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def _folder_of_lines(spark, sf_dir: str, halves: bool = False) -> str:
    """The events as JSON lines; two files by time if ``halves``."""
    out = work_path(spark, "lines")
    e = events(spark, sf_dir)
    if not halves:
        _lines(e).write.text(out)
        return out
    middle = F.lit("2024-01-16").cast("timestamp")
    for part in (e.where(F.col("ts") <= middle), e.where(F.col("ts") > middle)):
        _lines(part).coalesce(1).write.mode("append").text(out)
    return out


def _feature_stream(spark, sf_dir) -> FeatureStream:
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(_folder_of_lines(spark, sf_dir, halves=True))
    made = FeatureStream(spark, work_path(spark, "feature-stream"), COUNTS, CLICKS)
    run = made.start(lines, work_path(spark, "feature-checkpoint"))
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return made


_STREAM_STATE = f"""
SELECT user_id, {_HOUR} AS observation_time, count(*) FILTER (WHERE event_type = 'view') AS view_count, count(*) FILTER (WHERE event_type = 'click') AS click_count FROM events GROUP BY 1, 2
"""


@_query(f"SELECT *, observation_time + INTERVAL 2 HOUR AS expires_at FROM ({_STREAM_STATE}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY observation_time DESC) = 1")
def stream_online_state(spark, sf_dir):
    """Guarded online state after a bounded run over two files: the newest window of each user, with its expiry."""
    return _plain(_feature_stream(spark, sf_dir).state())


@_query(f"SELECT *, observation_time - INTERVAL 1 HOUR AS window_start_exclusive, 1 AS spec_version FROM ({_STREAM_STATE})")
def stream_history(spark, sf_dir):
    """Evidence of every window the run published; of a corrected window the last."""
    found = _feature_stream(spark, sf_dir).history.read()
    last = Window.partitionBy("user_id", "observation_time").orderBy(F.desc("published_at"), F.desc(F.col("view_count") + F.col("click_count")))
    return _plain(found.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "update_id", "published_at"))


@_query("""
SELECT 0 AS snapshot, count(*) AS n, sum(event_id) AS ids FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 1, count(*), sum(event_id) FROM events
""")
def snapshot_facts(spark, sf_dir):
    """Facts appended twice, the second time with redeliveries: a pinned snapshot stays, the newest has each event once."""
    e = events(spark, sf_dir).select(*CLICKS.columns)
    t = SnapshotTable(spark, work_path(spark, "facts"), CLICKS.schema, "ts")
    first = t.append_events(e.where("event_id % 2 = 0"), CLICKS)
    second = t.append_events(e.unionByName(e.where("event_id % 3 = 0")), CLICKS)
    parts = [t.read(t.require(n)).agg(F.lit(n).alias("snapshot"), F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")) for n in (first, second)]
    return parts[0].unionByName(parts[1])


_START, _END = datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 25, tzinfo=timezone.utc)


def _view(spark, sf_dir) -> registry.View:
    path = work_path(spark, "view")
    rows = events(spark, sf_dir).where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("observation_time")).agg(F.sum("value").alias("spent"), F.count(F.lit(1)).alias("n"))
    rows.write.parquet(path)
    return registry.Registry(registry.View("spending", path, "user_id", ("spent", "n"), timedelta(days=2))).view("spending", ["spent"])


_VIEWED = "v AS (SELECT user_id, ts AS t, sum(value) AS spent, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2)"


@_query(f"""
WITH {_VIEWED} SELECT user_id, t AS observation_time, spent, n, t + INTERVAL 2 DAY AS expires_at FROM v WHERE t > TIMESTAMP '2024-01-15' AND t <= TIMESTAMP '2024-01-25'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC) = 1
""")
def registry_materialize(spark, sf_dir):
    """Online state of the range that a watermark file leaves to be done."""
    view, mark = _view(spark, sf_dir), f"{work_path(spark, 'mark')}.json"
    rows = spark.read.parquet(view.path)
    registry.materialize_incremental(spark, rows, view, datetime(2024, 1, 15, tzinfo=timezone.utc), mark, _START).count()
    registry.advance(spark, mark, datetime(2024, 1, 15, tzinfo=timezone.utc))
    return _plain(registry.materialize_incremental(spark, rows, view, _END, mark, _START))


@_query(f"""
WITH {_VIEWED}, o AS (SELECT DISTINCT user_id, ts AS t FROM events WHERE event_type = 'purchase'),
j AS (SELECT o.user_id, o.t, v.t AS p, v.spent FROM o LEFT JOIN v ON v.user_id = o.user_id AND v.t <= o.t QUALIFY row_number() OVER (PARTITION BY o.user_id, o.t ORDER BY v.t DESC NULLS LAST) = 1)
SELECT user_id, t AS observation_time, CASE WHEN t <= p + INTERVAL 2 DAY THEN spent END AS spent FROM j
""")
def registry_historical(spark, sf_dir):
    """Rows of a stored view as of each purchase, unless older than the view's time to live."""
    return _plain(registry.historical(spark, purchases(events(spark, sf_dir)), _view(spark, sf_dir), ["spent"]).select("user_id", "observation_time", "spent"))


@_query("""
WITH m AS (SELECT max(ts) AS m FROM events), o AS (SELECT DISTINCT user_id, ts AS t FROM events WHERE event_type = 'purchase')
SELECT strftime(t, '%Y-%m-%d') AS day, count(*) AS n FROM o, m WHERE t + INTERVAL 7 DAY <= m GROUP BY 1
""")
def dataset_build_load(spark, sf_dir):
    """A training set written once with its manifest, held against it and loaded in order: rows by day."""
    e = events(spark, sf_dir)
    target = specs.label("buys_again", "user_id", "exists", "7d", "event_type == 'purchase'")
    feature = specs.feature("ratio", "user_id", VIEWS_CLICKS, "24h", derived=RATIO)
    out, excluded = dataset.assemble(e, purchases(e), [feature], target, CLICKS, F.lit(e.agg(F.max("ts")).first()[0]), "event_time")
    path = f"{work_path(spark, 'dataset')}"
    dataset.build(out, excluded, path, "event_time", {"features": ["ratio"], "label": "buys_again"})
    loaded = dataset.load(spark, path, ["user_id"])
    return loaded.groupBy(F.date_format("observation_time", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"""
SELECT sha256('{{"spec":"counts","version":1,"entity":{{"user_id":' || user_id || '}},"observation_time":"' || strftime(observation_time, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","counts":{{"view_count":' || view_count || ',"click_count":' || click_count || '}}}}') AS update_id
FROM ({_STREAM_STATE})
""")
def update_identity(spark, sf_dir):
    """SHA-256 over the canonical identity of every hourly update."""
    e = events(spark, sf_dir)
    end = F.timestamp_micros(F.expr("unix_micros(ts) + pmod(-unix_micros(ts), 3600000000)"))
    hourly = e.groupBy("user_id", end.alias("observation_time")).agg(profiles.count_of("event_type", "view").alias("view_count"), profiles.count_of("event_type", "click").alias("click_count"))
    return hourly.select(update_id("counts", 1, ["user_id"], ["view_count", "click_count"]).alias("update_id"))


@_query("""
WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 'search' WHEN 'purchase' THEN 'watch' WHEN 'view' THEN 'play' ELSE 'click' END AS k, CASE WHEN event_type IN ('view', 'purchase') THEN floor(value)::BIGINT ELSE 0 END AS w,
           CASE WHEN event_type <> 'error' THEN event_id % 1500 END AS c, event_id % 50 = 0 AS late, event_id % 40 = 0 AS dup FROM events),
m AS (SELECT count(*) AS event_count, count(*) FILTER (WHERE dup) AS duplicate_count, count(*) FILTER (WHERE late) AS late_event_count, count(*) FILTER (WHERE user_id NOT IN (SELECT c_custkey FROM customer)) AS unknown_event_users,
      count(*) FILTER (WHERE k <> 'search' AND NOT coalesce(c IN (SELECT p_partkey FROM part), false)) AS unknown_event_content, count(*) FILTER (WHERE k = 'search' AND c IS NOT NULL) AS searches_with_content,
      count(*) FILTER (WHERE (k IN ('play', 'watch') AND w <= 0) OR (k NOT IN ('play', 'watch') AND w <> 0)) AS wrong_watch_seconds, count(*) FILTER (WHERE late AND event_id % 100 = 0) AS late_without_delay FROM e),
l AS (SELECT count(*) AS label_count, count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS unknown_label_users, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS empty_label_windows FROM orders)
SELECT event_count, duplicate_count, late_event_count, unknown_event_users, unknown_event_content, searches_with_content, wrong_watch_seconds, 0::BIGINT AS received_before_event, late_without_delay, label_count, unknown_label_users,
       empty_label_windows, duplicate_count = (event_count * 0.02)::BIGINT AS duplicate_count_matches, label_count = 15000 AS label_count_matches, false AS passed FROM m, l
""")
def quality_dataset(spark, sf_dir):
    """The report of a dataset made of the driver's tables, with faults put in."""
    e, c = events(spark, sf_dir), F.col
    kind = F.when(c("event_type") == "error", "search").when(c("event_type") == "purchase", "watch").when(c("event_type") == "view", "play").otherwise("click")
    late = c("event_id") % 50 == 0
    made = e.select(
        "user_id", kind.alias("event_type"), F.when(c("event_type") != "error", c("event_id") % 1500).alias("content_id"), F.when(c("event_type").isin("view", "purchase"), F.floor("value")).otherwise(0).alias("watch_seconds"),
        c("ts").alias("event_time"), F.timestamp_micros(us(c("ts")) + F.when(late & (c("event_id") % 100 == 0), 0).otherwise(60_000_000)).alias("ingested_at"), late.alias("is_late"), (c("event_id") % 40 == 0).alias("is_duplicate"),
    )
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("user_id"), c("o_orderdate").cast("timestamp").alias("observation_time"), F.timestamp_micros(us(c("o_orderdate")) + F.when(c("o_orderkey") % 7 == 0, 0).otherwise(1)).alias("label_window_end"))
    users, items = table(spark, sf_dir, "customer").select(c("c_custkey").alias("user_id")), table(spark, sf_dir, "part").select(c("p_partkey").alias("content_id"))
    found = dataset_report(users, items, made, o, Expected(made.count(), 0.0, 0.02, 15000))
    n = c("event_count")
    return found.select(
        "event_count", "duplicate_count", "late_event_count", "unknown_event_users", "unknown_event_content", "searches_with_content", "wrong_watch_seconds", "received_before_event", "late_without_delay", "label_count", "unknown_label_users",
        "empty_label_windows", (c("duplicate_count") == F.round(n * 0.02).cast("long")).alias("duplicate_count_matches"), "label_count_matches", "passed",
    )


def _item_records(spark, sf_dir) -> DataFrame:
    """Stored records of parts: measures of their lines; parts of few lines have none."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("content_id")).agg(
        F.count(F.lit(1)).alias("view_count"), F.count_distinct("l_suppkey").alias("unique_viewer_count"), F.sum("l_quantity").cast("long").alias("total_watch_seconds"), F.round(F.avg("l_quantity"), 4).alias("average_watch_seconds"),
        profiles.count_of("l_returnflag", "R").alias("search_count"), profiles.count_of("l_returnflag", "A").alias("play_count"), F.lit(None).cast("long").alias("watch_count"), F.lit(2.0).alias("days_since_last_view"),
    )
    return s.where("view_count >= 25")


def _user_record(spark) -> DataFrame:
    return spark.range(1).select(F.lit(9).alias("event_count"), F.lit(4).alias("unique_content_count"), F.lit(1800).alias("total_watch_seconds"), F.lit(1).alias("search_count"), F.lit(2).alias("play_count"), F.lit(None).cast("int").alias("watch_count"), F.lit(1.5).alias("days_since_last_activity"))


_RECORDS = """r AS (SELECT l_partkey AS content_id, count(*) AS view_count, count(DISTINCT l_suppkey) AS viewers, sum(l_quantity)::BIGINT AS seconds, round(avg(l_quantity), 4) AS mean, count(*) FILTER (WHERE l_returnflag = 'R') AS s,
      count(*) FILTER (WHERE l_returnflag = 'A') AS p FROM lineitem GROUP BY 1 HAVING count(*) >= 25)"""


@_query(f"""
WITH {_RECORDS}, x AS (SELECT content_id, round(0.30::DOUBLE * least(view_count / 50.0::DOUBLE, 1) + 0.20::DOUBLE * least(viewers / 50.0::DOUBLE, 1) + 0.15::DOUBLE * least(seconds / 18000.0::DOUBLE, 1) + 0.10::DOUBLE * least(mean / 1800.0::DOUBLE, 1) + 0.05::DOUBLE * least(s / 10.0::DOUBLE, 1)
  + 0.10::DOUBLE * least(p / 15.0::DOUBLE, 1) + 0.05::DOUBLE * (1 - 2.0::DOUBLE / 7.0::DOUBLE), 6) AS c FROM r)
SELECT content_id, round(round(0.45::DOUBLE * round(0.30::DOUBLE * 0.9 + 0.20::DOUBLE * 0.4 + 0.15::DOUBLE * 0.5 + 0.10::DOUBLE * 1 / 3.0::DOUBLE + 0.10::DOUBLE * 2 / 3.0::DOUBLE + 0.10::DOUBLE * (1 - 1.5::DOUBLE / 7.0::DOUBLE), 6) + 0.55::DOUBLE * c, 6) + 1e-10::DOUBLE, 5) AS score
FROM x ORDER BY round(c, 6) DESC, content_id LIMIT 15
""")
def rank_online_items(spark, sf_dir):
    """The best fifteen of all parts for one user; candidates asked for twice count once."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("content_id"))
    asked = parts.withColumn("position", F.col("content_id")).unionByName(parts.withColumn("position", F.col("content_id") + 10_000_000))
    best, _ = serving.rank_online(asked, _user_record(spark), _item_records(spark, sf_dir), "content_id", 15)
    return best.select("content_id", F.round(F.col("score") + 1e-10, 5).alias("score"))


@_query(f"WITH {_RECORDS} SELECT p_partkey AS content_id FROM part WHERE p_partkey NOT IN (SELECT content_id FROM r)")
def rank_online_skipped(spark, sf_dir):
    """Candidates without a stored record."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("content_id"), F.col("p_partkey").alias("position"))
    return serving.rank_online(parts, _user_record(spark), _item_records(spark, sf_dir), "content_id", 5)[1]


_GROUP = """
WITH s AS (SELECT user_id, max(ts) AS t, count(*) AS n, sum(CASE WHEN event_type = 'view' THEN 1 END) AS views FROM events GROUP BY 1), q AS (SELECT c_custkey AS user_id, t, n, views FROM customer LEFT JOIN s ON user_id = c_custkey),
u AS (SELECT user_id, t, 'activity.n' AS feature, n::DOUBLE AS value FROM q UNION ALL SELECT user_id, t, 'activity.views', views::DOUBLE FROM q),
a AS (SELECT *, user_id % 97 = 0 AS e, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(t)) / 1000000.0::DOUBLE AS age FROM u)
SELECT feature, user_id::VARCHAR AS entity, CASE WHEN NOT e THEN value END AS value, CASE WHEN e THEN 'error' WHEN value IS NULL THEN 'missing' ELSE 'present' END AS availability,
       CASE WHEN NOT e AND value IS NOT NULL THEN CASE WHEN age < 0 THEN 'future' WHEN age > 86400 THEN 'stale' ELSE 'fresh' END END AS freshness, CASE WHEN NOT e AND value IS NOT NULL THEN age END AS age_seconds,
       CASE WHEN e THEN 'ReadError' END AS error_type FROM a
"""


@_query(_GROUP)
def batch_group_read(spark, sf_dir):
    """All features of a stored group for every customer, with availability and freshness; reads of some entities fail."""
    s = events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("observation_time"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("event_type") == "view", 1)).alias("views"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return serving.read_group(asked, s, "user_id", "activity", ["n", "views"], F.lit("2024-01-30 12:00:00").cast("timestamp"), 86400, F.col("user_id") % 97 == 0)


@_query(f"""
WITH h AS ({_STREAM_STATE}), s AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY observation_time DESC) = 1), q AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey <= 100),
j AS (SELECT q.user_id, s.*, (epoch_us(TIMESTAMP '2024-01-30 22:00:00') - epoch_us(observation_time)) / 1000000.0::DOUBLE AS age FROM q LEFT JOIN s ON s.user_id = q.user_id),
v AS (SELECT 'views' AS feature, 2 AS version, 7200.0 AS slo UNION ALL SELECT 'clicks', 1, 172800.0)
SELECT j.user_id, feature, version, CASE WHEN feature = 'views' THEN view_count ELSE coalesce(click_count, -1) END::DOUBLE AS value, CASE WHEN age IS NULL THEN 'missing' WHEN age < 0 OR age > slo THEN 'stale' ELSE 'ok' END AS status,
       age AS age_seconds, age IS NULL AND feature = 'clicks' AS defaulted FROM j, v
""")
def lookup_two_features(spark, sf_dir):
    """Two features, one by its newest version, for a request of a hundred customers."""
    now = F.lit("2024-01-30 22:00:00").cast("timestamp")
    end = F.timestamp_micros(F.expr("unix_micros(ts) + pmod(-unix_micros(ts), 3600000000)"))
    hourly = events(spark, sf_dir).groupBy("user_id", end.alias("observation_time")).agg(profiles.count_of("event_type", "view").alias("view_count"), profiles.count_of("event_type", "click").alias("click_count"))
    state = latest_state(hourly, ["user_id"], ["view_count", "click_count"])
    views = [specs.feature("views", "user_id", VIEWS_CLICKS[:1], "1h", version=v, freshness_slo="2h") for v in (1, 2)]
    clicks = specs.feature("clicks", "user_id", VIEWS_CLICKS[1:], "1h", freshness_slo="2d", online={"fallback": {"policy": "default_value", "defaults": {"click_count": -1.0}}})
    states = {("views", 1): state.limit(0), ("views", 2): state, ("clicks", 1): state}
    asked = table(spark, sf_dir, "customer").where("c_custkey <= 100").select(F.col("c_custkey").alias("user_id"))
    found = serving.lookup_features(asked, 100, [("views", None), ("clicks", 1)], [*views, clicks], states, now)
    return found.select("user_id", "feature", "version", F.element_at(F.map_values("values"), 1).alias("value"), "status", "age_seconds", "defaulted")


@_query(f"""
WITH h AS (SELECT *, (user_id + extract(hour FROM observation_time)) % 5 AS k FROM ({_STREAM_STATE}))
SELECT CASE k WHEN 1 THEN 'click_rate does not match its expression' WHEN 2 THEN 'feature_name is wrong' WHEN 3 THEN 'view_count must be a non-negative integer' WHEN 4 THEN 'record fields do not match the spec' END AS problem,
       count(*) AS n, sum(CASE WHEN k = 0 THEN view_count END)::BIGINT AS views FROM h GROUP BY 1
""")
def record_validation(spark, sf_dir):
    """Published records as JSON, four of five with a fault each, checked against their spec."""
    s = specs.feature("rates", "user_id", VIEWS_CLICKS, "1h", derived=RATIO)
    end = F.timestamp_micros(F.expr("unix_micros(ts) + pmod(-unix_micros(ts), 3600000000)"))
    hourly = events(spark, sf_dir).groupBy("user_id", end.alias("observation_time")).agg(profiles.count_of("event_type", "view").alias("view_count"), profiles.count_of("event_type", "click").alias("click_count"))
    both = F.col("view_count") + F.col("click_count")
    hourly = hourly.withColumn("click_rate", F.when(both > 0, F.col("click_count") / both).otherwise(0.0)).withColumn("_k", (F.col("user_id") + F.hour("observation_time")) % 5)
    text = records.to_records(hourly, s)
    broken = (
        F.when(F.col("_k") == 1, F.regexp_replace(text, '"click_rate":[^,}]*', '"click_rate":7.5')).when(F.col("_k") == 2, F.replace(text, F.lit('"rates"'), F.lit('"other"')))
        .when(F.col("_k") == 3, F.regexp_replace(text, '"view_count":(\\d+)', '"view_count":"$1"')).when(F.col("_k") == 4, F.replace(text, F.lit('"click_count"'), F.lit('"clicks"'))).otherwise(text)
    )
    checked = records.checked_records(hourly.select(broken.alias("value")), s)
    return checked.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.sum("record.view_count").alias("views"))


@_query("""
WITH s AS (SELECT c_custkey, round((c_acctbal + 1000) / 11000.0::DOUBLE, 4) AS score FROM customer)
SELECT CASE WHEN score >= 0.65 THEN 'high_engagement' WHEN score >= 0.30 THEN 'medium_engagement' ELSE 'low_engagement' END AS segment, count(*) AS n FROM s GROUP BY 1
""")
def score_segments(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.round((F.col("c_acctbal").cast("double") + 1000) / 11000.0, 4).alias("score"))
    return c.groupBy(serving.segment(F.col("score")).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def events_from_lines(spark, sf_dir):
    """Events written as JSON lines and read back through the contract."""
    e = read_events_jsonl(spark, _folder_of_lines(spark, sf_dir), CLICKS)
    return _plain(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last")))


_POPULAR = """
WITH e AS (SELECT user_id, (event_id % 40)::VARCHAR AS content_id, ts, value, event_type FROM events WHERE ts > TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20'),
s AS (SELECT {key}, count(*) AS n, count(DISTINCT {other}) AS m, sum(value) AS w, max(ts) AS t, count(*) FILTER (WHERE event_type = 'click') AS k FROM e GROUP BY 1)
"""


def _watched(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "click", "search").otherwise(F.col("event_type"))
    return e.select("user_id", (F.col("event_id") % 40).cast("string").alias("content_id"), F.col("ts").alias("event_time"), kind.alias("event_type"), F.col("value").alias("watch_seconds"))


@_query(_POPULAR.format(key="content_id", other="user_id") + """
SELECT x.content_id, coalesce(n, 0) AS view_count, coalesce(m, 0) AS unique_viewer_count, round(coalesce(w, 0), 3)::DOUBLE AS total_watch_seconds, coalesce(round(w / n, 5), 0)::DOUBLE AS average_watch_seconds, coalesce(k, 0) AS search_count,
       round((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(t)) / 86400000000.0::DOUBLE, 9) AS days_since_last_view FROM (SELECT DISTINCT (event_id % 40)::VARCHAR AS content_id FROM events) x LEFT JOIN s ON s.content_id = x.content_id
""")
def profile_content_popularity(spark, sf_dir):
    """Popularity measures of every item over seven days, zero-filled."""
    w = _watched(spark, sf_dir)
    found = profiles.content_popularity(w, w.select("content_id").distinct(), profiles.dates(spark, datetime(2024, 1, 20).date(), datetime(2024, 1, 20).date()), 7)
    r = F.round
    return found.select("content_id", "view_count", "unique_viewer_count", r(F.col("total_watch_seconds").cast("double"), 3).alias("total_watch_seconds"), r(F.col("average_watch_seconds").cast("double"), 5).alias("average_watch_seconds"), "search_count", r("days_since_last_view", 9).alias("days_since_last_view"))


@_query(_POPULAR.format(key="user_id", other="content_id") + """
SELECT c_custkey AS user_id, coalesce(n, 0) AS event_count, coalesce(m, 0) AS unique_content_count, round(coalesce(w, 0), 3)::DOUBLE AS total_watch_seconds, coalesce(k, 0) AS search_count,
       round((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(t)) / 86400000000.0::DOUBLE, 9) AS days_since_last_activity FROM customer LEFT JOIN s ON s.user_id = c_custkey
""")
def profile_user_engagement(spark, sf_dir):
    """Engagement measures of every customer over seven days, zero-filled."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    found = profiles.user_engagement(_watched(spark, sf_dir), users, profiles.dates(spark, datetime(2024, 1, 20).date(), datetime(2024, 1, 20).date()), 7)
    r = F.round
    return found.select("user_id", "event_count", "unique_content_count", r(F.col("total_watch_seconds").cast("double"), 3).alias("total_watch_seconds"), "search_count", r("days_since_last_activity", 9).alias("days_since_last_activity"))


@_query("""
WITH v AS (SELECT ts AS p FROM events WHERE event_type = 'view' AND ts > TIMESTAMP '2024-01-10') SELECT count(*) AS n, min(ts) AS first FROM events WHERE event_type = 'purchase' AND ts >= (SELECT min(p) FROM v)
""")
def history_start_filter(spark, sf_dir):
    """Observations from the first publication of a history on."""
    e = events(spark, sf_dir)
    history = e.where("event_type = 'view' AND ts > '2024-01-10'").select(F.col("ts").alias("published_at"))
    kept = e.where("event_type = 'purchase'").where(F.col("ts") >= F.lit(history_start(history)))
    return _plain(kept.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first")))


@_query("""
WITH d AS (SELECT date_trunc('day', ts)::DATE AS d, user_id, count(*) AS n, count(DISTINCT event_type) AS m FROM events GROUP BY 1, 2) SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n_rows, count(*) FILTER (WHERE m > n) AS unique_over_total,
       count(*) FILTER (WHERE n = 1) AS parts_over_total FROM d GROUP BY 1
""")
def partition_checks(spark, sf_dir):
    """Row checks of a stored view, partition by partition; some rows claim more parts than events."""
    d = events(spark, sf_dir).groupBy(F.to_date("ts").alias("observation_date"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("m"))
    view = FeatureView("daily", "user_id", ("n", "m", "part"), "n", ("part",), "m", "recent")
    rows = d.withColumns({"observation_time": F.col("observation_date").cast("timestamp"), "window_days": F.lit(1), "recent": F.lit(0.5), "part": F.when(F.col("n") == 1, 2).otherwise(1)})
    path = work_path(spark, "daily-view")
    rows.repartitionByRange("observation_date", "user_id").write.partitionBy("observation_date").parquet(path)
    found: dict[str, dict[str, int]] = {}
    for at, check, _, detail in check_view(spark.read.parquet(path), view):
        if at and check in ("parts_within_total", "unique_within_total"):
            found.setdefault(at, {})[check] = int(detail.split()[0])
    counts = spark.read.parquet(path).groupBy(F.date_format("observation_date", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))
    told = spark.createDataFrame([(at, c["unique_within_total"], c["parts_within_total"]) for at, c in found.items()], "day string, unique_over_total long, parts_over_total long")  # one row a day
    return counts.join(told, "day")
