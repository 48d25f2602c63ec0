"""Mixing sources to target weights by weighted fair queueing.

Each source gets a target share of the budget by its weight, capped at
``max_epochs`` times its size with the excess shared again by weight.  A
source's documents stand in a shuffled order, one epoch after the other, and
each copy has a virtual finish time: the words of its source up to and with
it, divided by the source's target.  The copies of all sources are
range-sorted by that time and the mix is cut where the total budget is used.
``mix`` leaves its rows in that order, and can name the time in a column.

A source's last epoch ends inside its target.  The shuffled order goes first
there as far as it fits; what is left is filled by the largest documents that
still fit, ``FILL`` of them, so a source misses its target by a few words.

Only (row, source, size) are sorted, never texts.  Running sums come from
range partitions and one total a partition and source, so a source that
holds a third of all rows is spread like any other.

Defined results: null or blank texts have size 0 and are taken 0 words; null
sources form one source after all others; rows that repeat are documents of
their own and interchangeable; ties in the shuffle are broken by id and row;
an empty table gives no rows; other columns are kept, whatever their names;
a text may be as long as a row can be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import stored, text_of, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Documents that fill the rest of a source's target.
FILL = 3


def _running(df: DataFrame, by: list[Column], values: dict[str, str], group: Column) -> DataFrame:
    """Running sums (``values``: column to sum -> name of the sum) within ``group`` in the order ``by``.

    ``by`` sorts by group first.  The rows are range-partitioned; a partition
    adds the totals of the partitions before it, of which there is one row
    for each group it holds.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = df.repartitionByRange(parts, *by).withColumn("_td_part", F.spark_partition_id()).withColumn("_td_g", group)
    spread = stored(spread, "spread")
    totals = spread.groupBy("_td_g", "_td_part").agg(*(F.sum(v).alias(f"_t_{o}") for v, o in values.items()))
    earlier = Window.partitionBy("_td_g").orderBy("_td_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_td_g", "_td_part", *(F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}") for o in values.values()))
    inside = Window.partitionBy("_td_g", "_td_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = spread.select("*", *(F.sum(v).over(inside).alias(f"_s_{o}") for v, o in values.items()))
    offsets = offsets.withColumnRenamed("_td_g", "_og").withColumnRenamed("_td_part", "_op")
    joined = summed.join(offsets, (F.col("_td_part") == F.col("_op")) & F.col("_td_g").eqNullSafe(F.col("_og")))
    return joined.select(*df.columns, *((F.col(f"_s_{o}") + F.col(f"_o_{o}")).alias(o) for o in values.values()))


def source_targets(sizes: DataFrame, budget: float, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(``source``, ``source_size``, ``target``) from (``source``, ``source_size``).

    Water-filling without a loop: a source is full when the level (words per
    unit of weight) reaches ``cap / weight``.  In that order the level that
    uses up the budget follows from running sums over the sources.
    """
    null, name = F.col("source").isNull(), F.col("source").cast("binary")
    s = _running(sizes.withColumn("one", F.lit(1)), [null, name], {"one": "rank"}, F.lit(0))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights)).cast("int"))
    s = s.withColumn("w", weight).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    s = stored(_running(s, [F.col("cap") / F.col("w"), null, name], {"cap": "caps", "w": "ws"}, F.lit(0)), "mix-levels")
    all_w = s.agg(F.sum("w")).first()[0] or 1.0
    # The level if all sources before this one are full and this one and the rest are not.
    level = (F.lit(float(budget)) - F.col("caps") + F.col("cap")) / (F.lit(all_w) - F.col("ws") + F.col("w"))
    top = s.select("w", "cap", level.alias("level")).where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.max("level")).first()[0]
    target = F.col("cap") if top is None else F.least(F.col("cap"), F.lit(top) * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def _fill(left: DataFrame, spent: DataFrame) -> DataFrame:
    """(``source``, ``picked``: rows in order) from the rows ``left`` and the words ``spent`` of each source's gap.

    Each step takes a source's largest row that still fits.
    """
    state = left.groupBy("source").agg(F.first("gap").alias("gap")).join(spent.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    state = state.select(F.col("source").alias("_s"), (F.col("gap") - F.coalesce("spent", F.lit(0))).alias("rest"), F.array().cast("array<long>").alias("picked"))
    for _ in range(FILL):
        state = stored(state, "mix-fill")
        free = left.select("source", "size", "r", "id", "rid").join(state, F.col("source").eqNullSafe(F.col("_s")))
        best = free.where((F.col("size") <= F.col("rest")) & ~F.array_contains("picked", F.col("rid"))).groupBy("source").agg(F.max(F.struct("size", "r", "id", "rid")).alias("m"))
        joined = state.join(best, F.col("source").eqNullSafe(F.col("_s")), "left")
        picked = F.when(F.col("m").isNull(), F.col("picked")).otherwise(F.concat("picked", F.array("m.rid")))
        state = joined.select("_s", (F.col("rest") - F.coalesce("m.size", F.lit(0))).alias("rest"), picked.alias("picked"))
    return stored(state, "mix-filled").select(F.posexplode("picked").alias("place", "rid"))


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = 3,
    seed: int = 7,
    share: float = 1.0,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``h`` (of the text), ``source``, ``size``, ``source_size``, ``target``, ``copies``.

    ``share`` scales the budget against the size of all documents.  Copy ``e``
    (from 0) of a row has the virtual finish time ``(cum + e * source_size) / target``;
    ``cum`` is null for rows that are never queued.  ``r`` is the shuffle.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("r", F.xxhash64(F.lit(seed), "id", "h")), "mix-rows")
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    budget = share * sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    targets = stored(source_targets(sizes, budget, weights, max_epochs), "mix-targets")
    rows = rows.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    queued = rows.where("size > 0 AND target > 0").withColumn("full", F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size"))).cast("int"))
    queued = stored(queued.withColumn("gap", F.col("target") - F.col("full") * F.col("source_size")), "mix-queue")
    order = [F.col("source"), F.col("r"), F.col("id"), F.col("rid")]
    tried = _running(queued.where("size <= gap"), order, {"size": "c"}, F.col("source"))
    fit = stored(tried.where("c <= gap").select("rid", "source", "size"), "mix-fit")
    spent = fit.groupBy("source").agg(F.sum("size").alias("spent"))
    left = queued.where("gap > 0 AND size <= gap").join(fit.select("rid"), "rid", "left_anti")
    turns = fit.select("rid", F.lit(-1).alias("turn")).unionByName(_fill(left, spent).select("rid", F.col("place").alias("turn")))
    settled = queued.join(turns, "rid", "left").withColumn("turn", F.coalesce("turn", F.lit(FILL)))
    once = stored(_running(settled, [F.col("source"), F.col("turn"), *order[1:]], {"size": "cum"}, F.col("source")), "mix-once")
    copies = once.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(F.col("full"), F.lit(max_epochs - 1)))))
    finish = (F.col("cum") + F.col("epoch") * F.col("source_size")) / F.col("target")
    queue = _running(copies.select("rid", "source", "r", "id", "size", finish.alias("finish")), [F.col("finish"), *order], {"size": "used"}, F.lit(0))
    taken = queue.where(F.col("used") <= F.lit(budget)).groupBy("rid").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    found = rows.join(once.select("rid", "cum"), "rid", "left").join(taken, "rid", "left")
    return found.select("id", "h", "source", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"), "cum", "r")


_IDENTITY = ["_td_i", "_td_h", "_td_s"]


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with a number ``_td_k`` of each row among those of its identity; a frequent identity is spread."""
    by = [*(F.col(c) for c in _IDENTITY), F.col("_td_row")]
    rows = df.withColumn("_td_row", F.monotonically_increasing_id()).withColumn("_td_one", F.lit(1))
    return _running(rows, by, {"_td_one": "_td_k"}, F.struct(*_IDENTITY)).drop("_td_row", "_td_one")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", position: str | None = None, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, sorted by virtual finish time (named ``position`` if given)."""
    wanted = plan(docs, id_col, text_col, source_col, **options)
    wanted = wanted.select(F.col("id").alias("_td_i"), F.col("h").alias("_td_h"), F.col("source").alias("_td_s"), "copies", "cum", "source_size", "target")
    wanted = stored(wanted.withColumn("_td_times", F.expr("transform(sequence(0, greatest(copies - 1, 0)), e -> (cum + e * source_size) / target)")), "mix-wanted")
    wanted = wanted.select(*_IDENTITY, "copies", "_td_times")
    groups = wanted.groupBy(*_IDENTITY).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("c"), F.first("_td_times").alias("_td_times"))
    groups = stored(groups.where("c > 0"), "mix-groups")
    rows = docs.withColumns({"_td_i": F.col(id_col), "_td_h": F.xxhash64(text_of(text_col)), "_td_s": F.col(source_col).cast("string")})

    def met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        other = right.select(*(F.col(c).alias(f"_r{c}") for c in on), *(c for c in right.columns if c not in on))
        same = F.lit(True)
        for c in on:
            same &= F.col(c).eqNullSafe(F.col(f"_r{c}"))
        return left.join(other, same, how).select(*left.columns, *([] if how == "left_semi" else (c for c in right.columns if c not in on)))

    found = met(rows, groups.where("n = 1").select(*_IDENTITY, "_td_times"), _IDENTITY)
    several = groups.where("n > 1").select(*_IDENTITY)
    if several.limit(1).count():
        # Equal rows are interchangeable: they get their copies by number.
        each = _numbered(met(wanted, several, _IDENTITY, "left_semi")).where("copies > 0").drop("copies")
        found = found.unionByName(met(_numbered(met(rows, several, _IDENTITY, "left_semi")), each, [*_IDENTITY, "_td_k"]).drop("_td_k"))
    name = position or "_td_finish"
    out = found.select(*docs.columns, F.explode("_td_times").alias(name)).repartitionByRange(F.col(name)).sortWithinPartitions(name)
    return out if position else out.drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: how often the mix takes each document of the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    p = plan(docs)
    return p.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
