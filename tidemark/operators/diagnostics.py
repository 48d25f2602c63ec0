"""Diagnostics of datasets and models: rates, drift, quantiles, AUC, precision at k, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import work_path


def weekly_rate(frame: DataFrame, time: str, label: Column, days: int = 7) -> DataFrame:
    """Rows, positives, negatives and rate per run of days from the first day on."""
    start = frame.agg(F.min(F.col(time)).cast("date")).first()[0]
    week = F.floor(F.datediff(F.col(time), F.lit(start)) / days)
    hit = F.when(label, 1).otherwise(0)
    out = frame.groupBy(week.alias("period")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(hit).alias("positives"), F.avg(hit).alias("rate"))
    return out.withColumn("negatives", F.col("n_rows") - F.col("positives"))


def column_profile(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(``name``, ``null_rate``, ``n_distinct`` with null as a value, ``low``, ``high``, ``constant``): one pass, one row a column."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(F.when(x.isNull(), 1.0).otherwise(0.0)).alias(f"{c}__nulls"), (F.count_distinct(x) + F.max(x.isNull().cast("int"))).alias(f"{c}__distinct"), F.min(x).alias(f"{c}__low"), F.max(x).alias(f"{c}__high")]
    one = frame.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"{c}__nulls").alias("null_rate"), F.col(f"{c}__distinct").alias("n_distinct"), F.col(f"{c}__low").alias("low"), F.col(f"{c}__high").alias("high")) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("constant", F.col("n_distinct") <= 1)


def drift(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """(``name``, means, ``shift``): test mean less train mean, in population deviations of train (NaN if they are 0)."""
    def means(frame: DataFrame, tag: str) -> DataFrame:
        aggs = [F.struct(F.lit(c).alias("name"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_pop(F.col(c).cast("double")).alias("std")).alias(c) for c in columns]
        return frame.agg(*aggs).select(F.explode(F.array(*columns)).alias("r")).select("r.name", F.col("r.mean").alias(f"{tag}_mean"), F.col("r.std").alias(f"{tag}_std"))

    both = means(train, "train").join(means(test, "test"), "name")
    shift = F.when(F.col("train_std") == 0, F.lit(float("nan"))).otherwise((F.col("test_mean") - F.col("train_mean")) / F.col("train_std"))
    return both.select("name", "train_mean", "test_mean", shift.alias("shift"))


def auc(frame: DataFrame, score: str, label: Column) -> DataFrame:
    """(``auc``): from average ranks; null unless both classes occur.

    Scores are counted per value first, so ranks follow from running sums
    over distinct scores, and equal scores share a rank without being
    gathered.  The sums run inside ranges of scores, written once so that a
    range stays what it is; only one total a range is summed in one place.
    """
    spark = frame.sparkSession
    per = frame.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(label, 1).otherwise(0)).alias("p"))
    spread = per.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "s").withColumn("range", F.spark_partition_id())
    path = work_path(spark, "score-ranges")
    spread.write.parquet(path)
    spread = spark.read.schema(spread.schema).parquet(path)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = spread.groupBy("range").agg(F.sum("n").alias("t")).select("range", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("offset"))
    before = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = spread.join(offsets, "range").withColumn("r", F.col("offset") + F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    one = ranked.agg(F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"), F.sum(F.col("p") * F.col("r")).alias("rs"))
    value = (F.col("rs") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return one.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), value).alias("auc"))


def quantile_edges(frame: DataFrame, column: str, parts: int = 4) -> list[float]:
    """Distinct exact quantile edges; empty with fewer than ``parts`` distinct values."""
    at = [i / parts for i in range(parts + 1)]
    x = F.col(column).cast("double")
    row = frame.agg(F.percentile(x, F.array(*map(F.lit, at))).alias("e"), F.count_distinct(x).alias("n")).first()
    return sorted(set(row.e)) if row.e and row.n >= parts else []


def quantile_rates(frame: DataFrame, column: str, label: Column, edges: list[float]) -> DataFrame:
    """(``bin``, ``n_rows``, ``rate``) of the right-closed bins between edges, the first also left-closed."""
    x = F.col(column).cast("double")
    bin_ = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        low = x >= edges[0] if i == 0 else x > edges[i]
        bin_ = F.when(low & (x <= edges[i + 1]), F.lit(i)).otherwise(bin_)
    return frame.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.when(label, 1.0).otherwise(0.0)).alias("rate"))


def compare_bins(train: DataFrame, test: DataFrame, column: str, label: Column, parts: int = 4) -> DataFrame:
    """(``bin``, rows and rates of both): test rows by the train quantiles; bins of either side are kept."""
    edges = quantile_edges(train, column, parts)
    sides = [quantile_rates(f, column, label, edges).select("bin", F.col("n_rows").alias(f"{tag}_rows"), F.col("rate").alias(f"{tag}_rate")) for f, tag in ((train, "train"), (test, "test"))]
    return sides[0].join(sides[1], "bin", "outer")


def at_k(frame: DataFrame, score: str, label: Column, key: str, k: int) -> DataFrame:
    """(``precision``, ``recall``) of the k highest scores, ties to the smaller key; 0 for nothing."""
    hit = F.when(label, 1).otherwise(0)
    top = frame.select(F.col(score).alias("s"), F.col(key).alias("i"), hit.alias("y")).orderBy(F.desc("s"), "i").limit(k)
    found = top.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("hits"))
    total = frame.agg(F.coalesce(F.sum(hit), F.lit(0))).first()[0]
    precision = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(F.lit(0.0))
    return found.select(precision.alias("precision"), (F.col("hits") / F.lit(float(total)) if total else F.lit(0.0)).alias("recall"))


def time_split(frame: DataFrame, time: str, key: str, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """``frame`` with ``split`` by position in time (ties by key): train, validation, test; none may be empty.

    Days are counted first.  Only the days in which a cut falls are ordered
    row by row, so nothing sorts the whole frame in one task.
    """
    day = F.to_date(time)
    counts = sorted((r.d, r.n) for r in frame.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a day
    n = sum(c for _, c in counts)
    cuts = int(n * train), int(n * (train + validation))
    if not 0 < cuts[0] < cuts[1] < n:
        raise ValueError("a part of the split would be empty")
    before, at = {}, 0
    for d, c in counts:
        before[d] = at
        at += c
    start = F.create_map(*(F.lit(v) for d, b in before.items() for v in (d, b)))
    order = Window.partitionBy(day).orderBy(time, key)
    position = F.try_element_at(start, day) + F.row_number().over(order)
    return frame.withColumn("_p", position).withColumn("split", F.when(F.col("_p") <= cuts[0], "train").when(F.col("_p") <= cuts[1], "validation").otherwise("test")).drop("_p")
