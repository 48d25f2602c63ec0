"""Raw payloads to the fact table, a batch at a time, with a count of what became of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.contract import EventContract
from tidemark.sources.files import parsed_events
from tidemark.sources.snapshots import SnapshotTable


def consume_batch(payloads: DataFrame, table: SnapshotTable, contract: EventContract, column: str = "value") -> dict[str, int]:
    """Append the valid events of ``payloads`` (text, bytes or null); counts by outcome, without zeros.

    Outcomes: appended, duplicate, rejected_tombstone, rejected_invalid_encoding
    and rejected_ with a reason code.  Rejected payloads are no facts.  A conflict of
    identities propagates and nothing is written, so the batch may come again.
    """
    raw = payloads.select(F.col(column).alias("_raw"))
    is_bytes = raw.schema["_raw"].dataType.simpleString() == "binary"
    decoded = F.when(F.is_valid_utf8(F.col("_raw").cast("string")), F.col("_raw").cast("string")) if is_bytes else F.col("_raw")
    lines = raw.withColumn("value", decoded)
    rows = parsed_events(lines.where(F.col("value").isNotNull()), contract).persist()
    try:
        reasons = rows.where(F.col("reason_code").isNotNull()).groupBy("reason_code").count().collect()  # one row a reason
        out = {f"rejected_{r.reason_code.lower()}": r["count"] for r in reasons}
        lost = lines.where(F.col("value").isNull()).agg(F.count(F.when(F.col("_raw").isNull(), 1)), F.count(F.when(F.col("_raw").isNotNull(), 1))).first()
        out |= {"rejected_tombstone": lost[0], "rejected_invalid_encoding": lost[1]}
        events = rows.where(F.col("reason_code").isNull()).select("event.*")
        before = table.read().count() if table.current() is not None else 0
        n = events.count()
        table.append_events(events, contract)
        added = (table.read().count() if table.current() is not None else 0) - before
        out |= {"appended": added, "duplicate": n - added}
        return {k: v for k, v in out.items() if v}
    finally:
        rows.unpersist()


def flush_is_due(first_pending_at: float, now: float, max_batch_seconds: float) -> bool:
    """A partial batch is written once its oldest event has waited this long."""
    return now - first_pending_at >= max_batch_seconds
