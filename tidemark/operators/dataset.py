"""Training datasets: labels with point-in-time features, written once with a manifest.

``event_time`` computes features from events; ``published_as_of`` takes what
a history had published.  The modes never stand in for each other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import as_of, history_start
from tidemark.operators.features import point_in_time
from tidemark.operators.identity import require_no_conflict
from tidemark.operators.labels import label
from tidemark.plans.contract import EventContract
from tidemark.plans.spec import FeatureSpec, LabelSpec
from tidemark.session import require_utc
from tidemark.sources.files import read_json, write_json

MODES = ("event_time", "published_as_of")
_US = timedelta(microseconds=1)


def check_specs(features: list[FeatureSpec], target: LabelSpec) -> None:
    if not features:
        raise ValueError("a dataset needs a feature spec")
    if len({f.name for f in features}) != len(features):
        raise ValueError("feature specs must have different names")
    odd = [f.name for f in features if f.keys != target.keys]
    if odd:
        raise ValueError(f"entity keys of {odd} differ from the label's")


def assemble(
    events: DataFrame,
    observations: DataFrame,
    features: list[FeatureSpec],
    target: LabelSpec,
    contract: EventContract,
    data_end: Column,
    mode: str,
    histories: dict[str, DataFrame] | None = None,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The dataset and the frames of excluded observations (``incomplete``, ``before_history``)."""
    if mode not in MODES:
        raise ValueError(f"the mode is one of {MODES}")
    check_specs(features, target)
    require_no_conflict(events, contract)
    labels = label(events, observations, target, contract, data_end, checked=True)
    rows, before = labels.values, labels.values.limit(0)
    if mode == "published_as_of":
        if any(len(f.keys) != 1 for f in features):
            raise ValueError("a history has one entity key")
        start = F.lit(max(history_start(histories[f.name]) for f in features))
        rows, before = rows.where(F.col("observation_time") >= start), rows.where(F.col("observation_time") < start)
    keys = [*target.keys, "observation_time"]
    name = f"label__{target.name}"
    out = rows.select(*keys, F.col("value").alias(name), F.col("observable_at").alias(f"{name}__observable_at"))
    wanted = rows.select(*keys).distinct()
    for f in features:
        if mode == "event_time":
            values = point_in_time(events, wanted, f, contract, checked=True)
            picked = [F.col(c).alias(f"{f.name}__{c}") for c in f.outputs]
        else:
            order = [F.col("observation_time"), *(F.col(a.name) for a in f.aggregations), F.col("update_id")]
            values = as_of(wanted, histories[f.name], f.keys, f.outputs, order, ttl=f.online.ttl // _US, version=f.version)
            picked = [*(F.col(c).alias(f"{f.name}__{c}") for c in f.outputs), F.col("status").alias(f"{f.name}__status")]
        out = out.join(values.select(*keys, *picked), keys, "left")
    return out, {"incomplete": labels.incomplete, "before_history": before}


def build(out: DataFrame, excluded: dict[str, DataFrame], path: str, mode: str, specs: dict) -> dict:
    """Write once by UTC day, count what was written, and only then the manifest."""
    spark = out.sparkSession
    require_utc(spark)
    dated = out.withColumn("observation_date", F.to_date("observation_time"))
    dated.repartitionByRange("observation_date", *(c for c in out.columns if c == "observation_time")).write.mode("errorifexists").partitionBy("observation_date").parquet(path)
    back = spark.read.parquet(path)
    counts = {str(r.observation_date): r["count"] for r in back.groupBy("observation_date").count().collect()}  # one row a day
    if not counts:
        raise ValueError("no observation is complete; nothing to train on")
    manifest = {
        "mode": mode, "specs": specs, "rows": sum(counts.values()), "partitions": dict(sorted(counts.items())),
        "excluded": {k: f.count() for k, f in excluded.items()}, "columns": back.columns, "written_at": datetime.now(timezone.utc).isoformat(),
    }
    write_json(spark, f"{path}/_manifest.json", manifest)
    return manifest


def load(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The dataset in order, after its counts have been held against the manifest."""
    manifest = json.loads(read_json(spark, f"{path}/_manifest.json"))
    frame = spark.read.parquet(path)
    counts = {str(r.observation_date): r["count"] for r in frame.groupBy("observation_date").count().collect()}
    if counts != manifest["partitions"]:
        raise ValueError("the files do not match the manifest")
    return frame.orderBy(*keys, "observation_time")


class BatchedDataset:
    """A dataset whose files agree with its manifest, read as Arrow batches without Spark.

    Any store that pyarrow's filesystems can open will do.  Columns come in the
    manifest's order; files in the order of their paths.
    """

    def __init__(self, path: str) -> None:
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with store.open_input_stream(f"{base}/_manifest.json") as f:
            self.manifest = json.loads(f.read())
        part = ds.partitioning(pa.schema([("observation_date", pa.string())]), flavor="hive")
        self.dataset = ds.dataset(base, format="parquet", filesystem=store, partitioning=part)
        missing = [c for c in self.manifest["columns"] if c not in self.dataset.schema.names]
        if missing:
            raise ValueError(f"the files lack columns of the manifest: {missing}")
        self.fragments = sorted(self.dataset.get_fragments(), key=lambda x: x.path)
        counts: dict[str, int] = {}
        for x in self.fragments:
            day = ds.get_partition_keys(x.partition_expression)["observation_date"]
            counts[day] = counts.get(day, 0) + x.count_rows()
        if counts != self.manifest["partitions"] or sum(counts.values()) != self.manifest["rows"]:
            raise ValueError("the files do not match the manifest")

    def batches(self, size: int = 65_536) -> Iterator:
        for x in self.fragments:
            yield from x.to_batches(schema=self.dataset.schema, columns=self.manifest["columns"], batch_size=size)


def batches(frame: DataFrame, size: int = 10_000) -> Iterator[list]:
    """Rows in batches, a partition at a time on the driver."""
    held: list = []
    for row in frame.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
