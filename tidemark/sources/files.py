"""Files in any store Spark can reach: Parquet with a schema, checked JSON lines, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.contract import EventContract


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _hadoop(spark, path)
    return store.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; empty if it is not there."""
    store, p = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []


def write_json(spark: SparkSession, path: str, value, overwrite: bool = False) -> None:
    """A small file, written under a temporary name and moved into place.

    With ``overwrite`` the move replaces the old file in one step, so there is
    no moment without one.
    """
    store, p = _hadoop(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    out = store.create(draft, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=1, default=str).encode()))
    out.close()
    if overwrite:
        jvm = spark.sparkContext._jvm
        how = jvm.org.apache.hadoop.fs.Options.Rename
        options = spark.sparkContext._gateway.new_array(how, 1)
        options[0] = how.OVERWRITE
        whole = store.makeQualified(p)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(store.makeQualified(draft), whole, options)
        return
    if store.exists(p) or not store.rename(draft, p):
        store.delete(draft, False)
        raise FileExistsError(path)


def read_json(spark: SparkSession, path: str) -> str:
    store, p = _hadoop(spark, path)
    stream = store.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_new(frame: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet that must not exist yet."""
    writer = frame.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_partitions(frame: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions that ``frame`` holds."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def parsed_events(lines: DataFrame, contract: EventContract, column: str = "value") -> DataFrame:
    """JSON text to ``event`` and ``errors`` (INVALID_JSON, or the contract's), keeping ``column``.

    Unknown fields, times without T or zone, and wrong types are errors.
    """
    raw = F.col(column)
    as_text = T.StructType([T.StructField(c, T.StringType()) for c in contract.columns])
    whole = F.from_json(raw, T.MapType(T.StringType(), T.StringType()))
    text = F.from_json(raw, as_text)
    rows = lines.withColumn("_m", whole).withColumn("_t", text)
    fields, problems = [], []
    for c, kind in contract.columns.items():
        value = F.col(f"_t.{c}")
        if kind == "timestamp":
            ok = value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:\d\d)$")
            problems.append(F.when(value.isNotNull() & ~ok, F.lit(f"{c} is no time with T and zone")))
            fields.append(F.when(ok, F.try_to_timestamp(value)).alias(c))
        elif kind == "bigint":
            ok = value.rlike(r"^-?\d{1,18}$")
            quoted = raw.rlike(rf'"{c}"\s*:\s*"')
            problems.append(F.when(value.isNotNull() & (~ok | quoted), F.lit(f"{c} is no integer")))
            fields.append(F.when(ok, value.cast("bigint")).alias(c))
        elif kind == "double":
            fields.append(F.expr(f"try_cast(_t.{c} AS DOUBLE)").alias(c))
        else:
            fields.append(value.alias(c))
    extra = F.array_except(F.map_keys("_m"), F.array(*(F.lit(c) for c in contract.columns)))
    problems.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown fields "), F.array_join(extra, ","))))
    # The text's own columns stand aside, as the contract may use their names.
    typed = rows.select(F.struct(*lines.columns).alias("_l"), "_m", *fields, F.filter(F.array(*problems), lambda x: x.isNotNull()).alias("_p"))
    broken = F.col("_m").isNull()
    errors = F.when(broken, F.array(F.lit("INVALID_JSON"))).otherwise(F.concat("_p", contract.violations()))
    return typed.select("_l.*", F.struct(*contract.columns).alias("event"), errors.alias("errors"), F.when(broken, "INVALID_JSON").when(F.size(errors) > 0, "EVENT_CONTRACT_VIOLATION").alias("reason_code"))


def read_events_jsonl(spark: SparkSession, path: str, contract: EventContract) -> DataFrame:
    """Events from JSON lines; the first bad line fails with its file, number and text."""
    lines = spark.read.text(path).withColumn("_file", F.input_file_name()).where(F.trim("value") != "")
    rows = parsed_events(lines, contract)
    bad = rows.where(F.size("errors") > 0).agg(F.min("_file")).first()[0]
    if bad:
        # Only a file that fails is read again, as a whole, to count its lines.
        numbered = spark.read.text(bad, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value")).where(F.trim("value") != "")
        first = parsed_events(numbered, contract).where(F.size("errors") > 0).orderBy("n").first()
        raise ValueError(f"{bad}, line {first.n + 1}: {list(first.errors)} in {first.value[:200]}")
    return rows.select("event.*")


def read_observations_jsonl(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Observations with exactly ``keys`` and ``observation_time`` (with zone); none at all is an error."""
    contract = EventContract({**dict.fromkeys(keys, "string"), "observation_time": "timestamp"}, "observation_time", keys[0], ids=tuple(keys))
    frame = read_events_jsonl(spark, path, contract)
    if not frame.limit(1).count():
        raise ValueError(f"{path} holds no observation")
    return frame
