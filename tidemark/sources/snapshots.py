"""Append-only tables with pinned snapshots.

A table is a folder of Parquet commits and of snapshot files; a snapshot
lists the commits it is made of.  A commit is written first and the snapshot
moved into place after it, so readers never see half a commit, and a
snapshot that has been read stays what it was.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.identity import IdentityConflict, conflicts, first_delivery, new_only
from tidemark.plans.contract import EventContract
from tidemark.sources.files import exists, listed, read_json, write_json


class SnapshotTable:
    """``schema`` is fixed; an existing table with another one is refused."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition_time: str | None = None) -> None:
        self.spark, self.path, self.schema, self.partition_time = spark, path.rstrip("/"), schema, partition_time
        found = f"{self.path}/schema.json"
        if exists(spark, found):
            if json.loads(read_json(spark, found)) != json.loads(schema.json()):
                raise ValueError(f"{path} has another schema")
        else:
            write_json(spark, found, json.loads(schema.json()))

    def snapshots(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in listed(self.spark, f"{self.path}/snapshots") if n.endswith(".json")]

    def current(self) -> int | None:
        return max(self.snapshots(), default=None)

    def require(self, snapshot: int | None = None) -> int:
        """The pinned snapshot; unknown ids and empty tables fail."""
        known = self.snapshots()
        if not known:
            raise ValueError(f"{self.path} is empty")
        if snapshot is not None and snapshot not in known:
            raise ValueError(f"{self.path} has no snapshot {snapshot}")
        return max(known) if snapshot is None else snapshot

    def _commits(self, snapshot: int | None) -> list[str]:
        return json.loads(read_json(self.spark, f"{self.path}/snapshots/{snapshot:012d}.json"))["commits"] if snapshot is not None else []

    def read(self, snapshot: int | None = None, between: tuple[datetime, datetime] | None = None) -> DataFrame:
        """The rows of a snapshot; ``between`` (both ends included) leaves the days outside it unread."""
        commits = self._commits(self.require(snapshot))
        base = f"{self.path}/data"
        frame = self.spark.read.schema(self.schema).option("basePath", base).parquet(*(f"{base}/commit={c}" for c in commits))
        if between and self.partition_time:
            low, high = (F.lit(x) for x in between)
            frame = frame.where(F.col("_day").between(F.to_date(low), F.to_date(high)) & F.col(self.partition_time).between(low, high))
        return frame.select(self.schema.names)

    def _read_or_empty(self) -> DataFrame:
        return self.read() if self.current() is not None else self.spark.createDataFrame([], self.schema)

    def append(self, frame: DataFrame) -> int:
        """One commit and its snapshot; a second writer of the same number fails and may try again."""
        before = self.current()
        commit = uuid.uuid4().hex
        rows = frame.select(self.schema.names)
        if self.partition_time:
            # A day is spread over as many tasks as it needs: ranges of time, not one task a day.
            rows = rows.withColumn("_day", F.to_date(self.partition_time)).repartitionByRange("_day", self.partition_time)
            rows.write.mode("errorifexists").partitionBy("_day").parquet(f"{self.path}/data/commit={commit}")
        else:
            rows.write.mode("errorifexists").parquet(f"{self.path}/data/commit={commit}")
        number = 0 if before is None else before + 1
        write_json(self.spark, f"{self.path}/snapshots/{number:012d}.json", {"commits": [*self._commits(before), commit]})
        return number

    def append_new(self, frame: DataFrame, key: str) -> int | None:
        """Append rows whose key is new, the first of each; nothing new is no commit."""
        rows = new_only(frame.dropDuplicates([key]), self._read_or_empty(), key)
        return self.append(rows) if rows.limit(1).count() else None

    def append_events(self, events: DataFrame, contract: EventContract) -> int | None:
        """Idempotent append of facts: known equal events are dropped, a conflict writes nothing."""
        known = self._read_or_empty()
        touched = known.join(events.select(contract.identity).distinct(), contract.identity, "left_semi")
        bad = conflicts(touched.unionByName(events.select(touched.columns)), contract).limit(1).collect()
        if bad:
            raise IdentityConflict(f"{contract.identity}={bad[0][0]} has different payloads")
        return self.append_new(first_delivery(events, contract), contract.identity)
