"""Published feature records as JSON: made in a canonical form, and checked field by field.

A record names its schema version, feature, entity, window and counts, and
carries derived values, which are computed again from the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import Compiler
from tidemark.functions.numbers import isclose
from tidemark.functions.times import iso, us
from tidemark.plans.spec import FeatureSpec

# The version and the common fields of a record.
SCHEMA_VERSION = "v1"
BASE_FIELDS = ("feature_schema_version", "feature_name", "observation_time", "window_start_exclusive")
_TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:\d\d)$"


def record_fields(spec: FeatureSpec) -> list[str]:
    """The fields of a spec's records, sorted; counts of one entity only."""
    if len(spec.keys) != 1 or any(a.op != "count" for a in spec.aggregations):
        raise ValueError("records hold counts of one entity key")
    taken = [*BASE_FIELDS, *spec.keys, *spec.outputs]
    if len(set(taken)) != len(taken):
        raise ValueError(f"field names of {spec.name} must differ")
    return sorted(taken)


def to_records(values: DataFrame, spec: FeatureSpec) -> Column:
    """Canonical JSON of rows with the key, ``observation_time`` and the outputs: sorted fields, no spaces, UTC times."""
    start = F.timestamp_micros(us(F.col("observation_time")) - spec.size_us)
    made = {
        "feature_schema_version": F.lit(SCHEMA_VERSION), "feature_name": F.lit(spec.name), "observation_time": iso(F.col("observation_time")), "window_start_exclusive": iso(start),
        spec.keys[0]: F.col(spec.keys[0]).cast("string"), **{n: F.col(n) for n in spec.outputs},
    }
    return F.to_json(F.struct(*(made[n].alias(n) for n in record_fields(spec))))


def checked_records(rows: DataFrame, spec: FeatureSpec, column: str = "value") -> DataFrame:
    """``rows`` with ``record`` (key, times, outputs) and ``problem``, the first rule a record breaks (null: none).

    A null payload is a tombstone, which records do not have.
    """
    fields, key = record_fields(spec), spec.keys[0]
    parsed = rows.withColumn("_j", F.try_parse_json(column))

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_j", f"$.{name}", "variant"))

    def text(name: str) -> Column:
        return F.try_variant_get("_j", f"$.{name}", "string")

    def time(name: str) -> Column:
        return F.when(text(name).rlike(_TIME), F.try_to_timestamp(text(name)))

    given = F.map_keys(F.from_json(F.col(column), "map<string,string>"))
    counts = [a.name for a in spec.aggregations]
    number = {n: F.try_variant_get("_j", f"$.{n}", "bigint") for n in counts}
    value = {n: F.try_variant_get("_j", f"$.{n}", "double") for n in spec.derived}
    again = Compiler({n: F.col(f"_n.{n}") for n in counts})
    parsed = parsed.withColumn("_n", F.struct(*(number[n].alias(n) for n in counts)))
    problems: list[tuple[str, Column]] = [
        ("tombstone", F.col(column).isNull()),
        ("record is not JSON", F.col("_j").isNull()),
        ("record must be an object", ~F.schema_of_variant("_j").startswith("OBJECT")),
        ("record fields do not match the spec", (F.size(F.array_except(given, F.array(*map(F.lit, fields)))) > 0) | (F.size(F.array_except(F.array(*map(F.lit, fields)), given)) > 0)),
        ("feature_schema_version is wrong", ~text("feature_schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))),
        ("feature_name is wrong", ~text("feature_name").eqNullSafe(F.lit(spec.name))),
        (f"{key} must be a non-empty string without white space", (kind(key) != "STRING") | (text(key) == "") | text(key).rlike(r"\s")),
        *((f"{n} must be a time with zone", time(n).isNull()) for n in ("observation_time", "window_start_exclusive")),
        ("the window has another size", us(time("observation_time")) - us(time("window_start_exclusive")) != spec.size_us),
        *((f"{n} must be a non-negative integer", (kind(n) != "BIGINT") | number[n].isNull() | (number[n] < 0)) for n in counts),
    ]
    for n, expression in spec.derived.items():
        problems.append((f"{n} must be a finite number", ~kind(n).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") | value[n].isNull() | F.isnan(value[n]) | (F.abs(value[n]) == float("inf"))))
        problems.append((f"{n} does not match its expression", ~F.coalesce(isclose(value[n], again.value(expression).cast("double"), 1e-12, 1e-15), F.lit(False))))
    first = F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in problems))
    record = F.struct(
        text(key).alias(key), time("observation_time").alias("observation_time"), time("window_start_exclusive").alias("window_start_exclusive"),
        *(number[n].alias(n) for n in counts), *(value[n].alias(n) for n in spec.derived),
    )
    return parsed.select(*rows.columns, F.when(first.isNull(), record).alias("record"), first.alias("problem"))


def materialize_records(rows: DataFrame, spec: FeatureSpec, column: str = "value") -> DataFrame:
    """The records of a range of payloads; an empty range, a tombstone or a broken record is refused."""
    if not rows.limit(1).count():
        raise ValueError("there are no records to materialize")
    checked = checked_records(rows, spec, column)
    bad = checked.where(F.col("problem").isNotNull()).select("problem").limit(1).collect()
    if bad:
        raise ValueError(bad[0].problem)
    return checked.select("record.*")
