"""Exact order statistics of groups of any size: counts by range narrow an interval until one value is left.

A percentile aggregate holds all distinct values of a group in one task. Here each round counts the rows of the interval that
holds the wanted rank by ``BINS`` ranges, so a task sends a few numbers a range and group, and the next interval is the range of the
rank, as wide as the values in it. Rounds cut the interval into equal widths and into equal ratios in turn, so that a few rounds
are enough for values of any distribution; an interval of at most ``FEW`` rows is cut into its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, finite
from ..functions.staged import settled

BINS, FEW = 1024, 4096
_STATE = ["_g", "rank", "lo", "hi", "before", "own", "after", "rows"]


def _group(keys) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def _range(ratios: bool) -> Column:
    """Which part of [lo, hi] a value lies in; never falls as the value rises, and lo and hi differ in an even round."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    if not ratios:
        share = (v - lo) / (hi - lo)
    else:
        up = F.try_divide(F.log(v) - F.log(lo), F.log(hi) - F.log(lo))
        down = F.try_divide(F.log(-lo) - F.log(-v), F.log(-lo) - F.log(-hi))
        share = F.when(lo > 0, up).when(hi < 0, down).otherwise((F.signum(v) + 1) / 2)
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)).cast("int")


def _narrowed(base: DataFrame, state: DataFrame) -> DataFrame:
    """The state with one value in every interval; ``base`` has _g, v, w."""
    state, turn = settled(state.select(*_STATE)), 0
    while True:
        wide = state.where("lo < hi")
        if wide.isEmpty():
            return state
        parts = (
            base.join(wide.select("_g", "lo", "hi", "rows").distinct(), "_g")
            .where(F.col("v").between(F.col("lo"), F.col("hi")))
            .groupBy("_g", "lo", "hi", F.when(F.col("rows") <= FEW, F.col("v")).otherwise(_range(turn % 2 == 1)).alias("part"))
            .agg(F.sum("w").alias("_own"), F.min("v").alias("_a"), F.max("v").alias("_b"), F.count("*").alias("_rows"))
        )
        w = Window.partitionBy("_g", "lo", "hi").orderBy("part")  # BINS or FEW rows at most
        parts = parts.withColumn("_upto", F.sum("_own").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead("_a").over(w))
        rest = F.col("rank") - F.col("before")
        hit = wide.join(parts, ["_g", "lo", "hi"]).where((rest <= F.col("_upto")) & (rest > F.col("_upto") - F.col("_own")))
        found = hit.select("_g", "rank", F.col("_a").alias("lo"), F.col("_b").alias("hi"), (F.col("before") + F.col("_upto") - F.col("_own")).alias("before"), F.col("_own").alias("own"), F.coalesce("_next", "after").alias("after"), F.col("_rows").alias("rows"))
        state, turn = settled(state.where("lo = hi").unionByName(found)), turn + 1


def _base(rows: DataFrame, keys, value: str | Column, weight: str | Column | None) -> DataFrame:
    w = F.lit(1) if weight is None else col(weight)
    return rows.select(_group(keys).alias("_g"), finite(value).alias("v"), w.cast("bigint").alias("w")).where("v is not null and w > 0")


def select(rows: DataFrame, keys: list[str], value: str | Column, ranks: DataFrame, weight: str | Column | None = None) -> DataFrame:
    """``keys, rank, value, before, own, after``: per group and wanted ``rank`` (from 1) the value that holds it.

    A row counts ``weight`` times (once without one). ``before`` is the weight of smaller values, ``own`` that of equal ones,
    ``after`` the next larger value. Rows without a finite value or a positive weight don't count; ranks outside a group have no row.
    """
    base = _base(rows, keys, value, weight)
    ends = base.groupBy("_g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("own"), F.count("*").alias("rows"))
    wanted = ranks.select(_group(keys).alias("_g"), F.col("rank").cast("bigint").alias("rank")).distinct()
    start = wanted.join(ends, "_g").where("rank between 1 and own").withColumns({"before": F.lit(0).cast("bigint"), "after": F.lit(None).cast("double")})
    return _narrowed(base, start).select(*[F.col(f"_g.{k}") for k in keys], "rank", F.col("lo").alias("value"), "before", "own", "after")


def medians(rows: DataFrame, keys: list[str], value: str | Column, name: str = "median") -> DataFrame:
    """``keys, <name>, n`` of each group with a finite value; the mean of the two middle values of an even number."""
    base = _base(rows, keys, value, None)
    start = base.groupBy("_g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("own"), F.count("*").alias("rows"))
    sizes = settled(start.withColumn("rank", F.floor((F.col("own") + 1) / 2).cast("bigint")).withColumns({"before": F.lit(0).cast("bigint"), "after": F.lit(None).cast("double")}))
    found = _narrowed(base, sizes).join(sizes.select("_g", F.col("own").alias("n")), "_g")
    both = (F.col("n") % 2 == 0) & (F.col("before") + F.col("own") == F.floor(F.col("n") / 2))
    middle = F.when(both, (F.col("lo") + F.col("after")) / 2).otherwise(F.col("lo"))
    return found.select(*[F.col(f"_g.{k}") for k in keys], middle.alias(name), "n")
