"""Event contracts: which columns there are and what makes a row valid."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class EventContract:
    """Names of the special columns and the allowed values.

    ``payload`` is what identity compares; receipt time is not part of it.
    """

    columns: dict[str, str]
    time: str
    identity: str
    receipt: str | None = None
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ids: tuple[str, ...] = ()
    non_negative: tuple[str, ...] = ()
    zero_when: tuple[str, str, str] | None = None

    @property
    def payload(self) -> list[str]:
        return [c for c in self.columns if c not in (self.receipt, self.identity)]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in self.columns.items()))

    def kinds(self) -> dict[str, str]:
        return dict(self.columns)

    def violations(self) -> Column:
        """Array of the names of the rules a row breaks; empty if it is valid."""
        checks: list[tuple[str, Column]] = [(f"{c} is missing", F.col(c).isNull()) for c in self.columns]
        checks += [(f"{c} is blank or has white space", F.col(c).isNotNull() & ((F.col(c) == "") | F.col(c).rlike(r"\s"))) for c in self.ids]
        checks += [(f"{c} is not allowed", F.col(c).isNotNull() & ~F.col(c).isin(*v)) for c, v in self.allowed.items()]
        checks += [(f"{c} is negative", F.col(c) < 0) for c in self.non_negative]
        if self.receipt:
            checks.append((f"{self.receipt} is before {self.time}", F.col(self.receipt) < F.col(self.time)))
        if self.zero_when:
            column, value, zero = self.zero_when
            checks.append((f"{zero} of {value} is not zero", (F.col(column) == value) & (F.col(zero) != 0)))
        found = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks))
        return F.filter(found, lambda x: x.isNotNull())


#: The streaming contract of interactions; field names and values are fixed by the data.
INTERACTIONS = EventContract(
    columns={
        "event_id": "string", "event_time": "timestamp", "ingested_at": "timestamp", "user_id": "string", "content_id": "string",
        "event_type": "string", "play_seconds": "bigint", "source": "string", "schema_version": "string",
    },
    time="event_time", identity="event_id", receipt="ingested_at",
    allowed={"event_type": ("impression", "play", "skip", "complete"), "source": ("web", "mobile", "tv"), "schema_version": ("v1",)},
    ids=("event_id", "user_id", "content_id"), non_negative=("play_seconds",), zero_when=("event_type", "impression", "play_seconds"),
)

#: Clickstream events with a numeric value and a JSON payload.
CLICKS = EventContract(
    columns={"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
    time="ts", identity="event_id",
    allowed={"event_type": ("signup", "error", "click", "view", "purchase")},
)
