"""Session set-up that the temporal semantics rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configured(spark: SparkSession) -> SparkSession:
    """Apply the settings every plan here assumes to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError(f"the session time zone must be UTC, not {zone}")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can read and write.

    A cluster names it in ``spark.checkpoint.dir`` or sets it on the context.
    Only in local mode a temporary folder of this machine stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_on_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_on_context.isDefined():
            found = set_on_context.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
