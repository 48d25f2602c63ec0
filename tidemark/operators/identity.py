"""Event identity: conflicts fail loudly, redeliveries collapse to the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.contract import EventContract


class IdentityConflict(ValueError):
    """One identity came with two different payloads."""


def conflicts(events: DataFrame, contract: EventContract) -> DataFrame:
    """(identity, ``payloads``) of identities whose rows differ beyond the receipt time.

    Smallest and largest payload hashes (two of 64 bits with different seeds)
    are combined before the shuffle; two of one of them mean two payloads,
    so no set of payloads is ever gathered.
    """
    one, two = F.xxhash64(F.lit(1), *contract.payload), F.xxhash64(F.lit(2), *reversed(contract.payload))
    ends = [f(h).alias(f"{name}{i}") for i, h in enumerate((one, two)) for name, f in (("low", F.min), ("high", F.max))]
    found = events.groupBy(contract.identity).agg(*ends, F.count(F.lit(1)).alias("rows"))
    return found.where("low0 != high0 OR low1 != high1").select(contract.identity, "rows")


def require_no_conflict(events: DataFrame, contract: EventContract) -> None:
    bad = conflicts(events, contract).limit(1).collect()
    if bad:
        raise IdentityConflict(f"{contract.identity}={bad[0][0]} has different payloads")


def first_delivery(events: DataFrame, contract: EventContract) -> DataFrame:
    """One row per identity: the one received first (ties: any, as they are equal)."""
    rest = [c for c in events.columns if c != contract.identity]
    if contract.receipt:
        kept = events.groupBy(contract.identity).agg(F.min_by(F.struct(*rest), F.col(contract.receipt)).alias("_r"))
    else:
        kept = events.groupBy(contract.identity).agg(F.min(F.struct(*rest)).alias("_r"))
    return kept.select(contract.identity, "_r.*").select(events.columns)


def new_only(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key ``known`` lacks."""
    return incoming.join(known.select(key).distinct(), key, "left_anti")
