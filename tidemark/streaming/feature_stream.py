"""Events to online state and history, batch by batch.

The fact table is the truth for identity: redeliveries vanish, conflicts
stop the stream.  A batch recomputes just the windows its new events fall
in, from facts; guarded updates decide what the state takes, and what it took
is evidence for the history.  Every step is idempotent, so a batch that runs
again after a failure changes nothing.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import Compiler
from tidemark.functions.times import micros, us, window_end
from tidemark.operators.features import aggregate, range_join, with_derived
from tidemark.operators.updates import decision, latest_state, update_id
from tidemark.plans.contract import EventContract
from tidemark.plans.spec import FeatureSpec
from tidemark.sources.files import exists, parsed_events, read_json, write_json
from tidemark.sources.snapshots import SnapshotTable

TOO_LATE = "TOO_LATE_FOR_ALL_ASSIGNED_WINDOWS"


def reject(rows: DataFrame, column: str = "value") -> DataFrame:
    """Rejection records of parsed rows."""
    return rows.where(F.col("reason_code").isNotNull()).select(F.lit("v1").alias("error_schema_version"), "reason_code", F.col(column).alias("raw_payload"), "errors")


class FeatureStream:
    """``batch`` is the body of ``foreachBatch``; tables live under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, spec: FeatureSpec, contract: EventContract) -> None:
        if any(a.op != "count" for a in spec.aggregations):
            raise ValueError("guarded updates order counts only")
        self.spark, self.folder, self.spec, self.contract = spark, folder.rstrip("/"), spec.check(contract), contract
        own = contract.columns
        keys = [T.StructField(k, T.StructType.fromDDL(f"x {own[k]}")[0].dataType) for k in spec.keys]
        values = [*(T.StructField(a.name, T.LongType()) for a in spec.aggregations), *(T.StructField(d, T.DoubleType()) for d in spec.derived)]
        at = T.StructField("observation_time", T.TimestampType())
        self.state_schema = T.StructType([*keys, at, *values, T.StructField("expires_at", T.TimestampType())])
        more = [T.StructField("update_id", T.StringType()), T.StructField("spec_version", T.IntegerType())]
        self.history = self._table("history", T.StructType([*more, *keys, at, T.StructField("window_start_exclusive", T.TimestampType()), *values, T.StructField("published_at", T.TimestampType())]), "published_at")
        self.facts = self._table("facts", contract.schema, contract.time)
        self.rejected = self._table("rejected", T.StructType.fromDDL("error_schema_version string, reason_code string, raw_payload string, errors array<string>"))
        self.late = self._table("late", contract.schema.add("reason_code", "string"))

    def _table(self, name: str, schema: T.StructType, day: str | None = None) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.folder}/{name}", schema, day)

    def _mark(self) -> dict:
        path = f"{self.folder}/mark.json"
        return json.loads(read_json(self.spark, path)) if exists(self.spark, path) else {"watermark": None, "state": None, "batch": -1}

    def state(self) -> DataFrame:
        at = self._mark()["state"]
        return self.spark.read.schema(self.state_schema).parquet(f"{self.folder}/state/{at}") if at is not None else self.spark.createDataFrame([], self.state_schema)

    def batch(self, lines: DataFrame, number: int) -> None:
        mark = self._mark()
        if number <= mark["batch"]:
            return  # done before the restart
        rows = parsed_events(lines, self.contract).persist()
        try:
            self._apply(rows, number, mark)
        finally:
            rows.unpersist()

    def _apply(self, rows: DataFrame, number: int, mark: dict) -> None:
        rejected = reject(rows)
        if rejected.limit(1).count():
            self.rejected.append(rejected)
        events = rows.where(F.col("reason_code").isNull()).select("event.*")
        size, slide = self.spec.size_us, micros(self.spec.window.slide)
        t, allowed = us(F.col(self.contract.time)), micros(self.spec.lateness["allowed"])
        low = mark["watermark"]
        # The last window an event falls in ends size - slide after its own pane.
        over = F.lit(False) if low is None else window_end(t, slide) + (size - slide + allowed) <= low
        late = events.where(over)
        if late.limit(1).count():
            self.late.append(late.withColumn("reason_code", F.lit(TOO_LATE)))
        self.facts.append_events(events, self.contract)
        timely = events.where(~over)
        ends = F.explode(F.sequence(window_end(t, slide), window_end(t, slide) + (size - slide), F.lit(slide)))
        touched = timely.select(*self.spec.keys, ends.alias("_t")).distinct()
        if low is not None:
            touched = touched.where(F.col("_t") + allowed > low)
        state = self._publish(touched, number) if touched.limit(1).count() else mark["state"]
        top = events.agg(F.max(t)).first()[0]
        ahead = None if top is None else top - 1 - micros(self.spec.lateness["watermark_delay"])
        new_low = max((x for x in (low, ahead) if x is not None), default=None)
        write_json(self.spark, f"{self.folder}/mark.json", {"watermark": new_low, "state": state, "batch": number}, overwrite=True)

    def _publish(self, touched: DataFrame, number: int) -> str:
        spec, contract, names = self.spec, self.contract, [a.name for a in self.spec.aggregations]
        used = [c for c in contract.columns if c not in spec.keys]
        low, high = touched.agg(F.min("_t"), F.max("_t")).first()
        between = tuple(datetime.fromtimestamp(x / 1e6, timezone.utc) + timedelta(seconds=s) for x, s in ((low - spec.size_us, -1), (high, 1)))
        facts = self.facts.read(between=between).select(*spec.keys, *used, us(F.col(contract.time)).alias("_us"))
        joined = range_join(touched, facts, spec.keys, spec.size_us)
        compiler = Compiler({c: F.col(c) for c in [*spec.keys, *used]}, contract.kinds())
        aggs = [aggregate(a, compiler, F.col("_us").isNotNull(), F.col("_us"), F.col(contract.identity)).alias(a.name) for a in spec.aggregations]
        values = with_derived(joined.groupBy(*spec.keys, "_t").agg(*aggs), spec)
        values = values.withColumn("observation_time", F.timestamp_micros("_t")).withColumn("expires_at", F.timestamp_micros(F.col("_t") + micros(spec.online.ttl)))
        new = values.select(self.state_schema.names).persist()
        old = self.state()
        try:
            before = old.select(*spec.keys, F.col("observation_time").alias("_old"), *(F.col(n).alias(f"_old_{n}") for n in names))
            judged = new.join(before, spec.keys, "left").withColumn("outcome", decision(F.col("_old"), F.col("observation_time"), {n: (F.col(f"_old_{n}"), F.col(n)) for n in names}))
            clash = judged.where("outcome = 'conflict'").limit(1).collect()
            if clash:
                raise ValueError(f"counts of one window cannot be ordered: {clash[0].asDict()}")
            # Windows are published whatever the state keeps; equal evidence is known by its id.
            evidence = judged.where("outcome != 'stale'").select(
                update_id(spec.name, spec.version, spec.keys, names).alias("update_id"), F.lit(spec.version).alias("spec_version"), *spec.keys, "observation_time",
                F.timestamp_micros(us(F.col("observation_time")) - spec.size_us).alias("window_start_exclusive"), *spec.outputs, F.lit(datetime.now(timezone.utc)).alias("published_at"),
            )
            taken = judged.where("outcome = 'written'").select(self.state_schema.names)
            name = f"b{number:012d}"
            latest_state(old.unionByName(taken), spec.keys, names).write.mode("overwrite").parquet(f"{self.folder}/state/{name}")
            self.history.append_new(evidence, "update_id")
            return name
        finally:
            new.unpersist()

    def start(self, lines: DataFrame, checkpoint: str, bounded: bool = True):
        """Run on a stream of text lines (``value``); bounded stops at what there is now."""
        writer = lines.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if bounded else writer).start()
