"""Vibration series from CSV files, checked cell by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_vibration(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``series, idx, value``: the named columns of a CSV with a header, as long rows in file order.

    Refuses no or repeated column names, columns that the header lacks, a file without samples, and any
    cell that is blank or not a finite number; the message names the first bad line and column.
    """
    if not columns or len(set(columns)) != len(columns):
        raise ValueError(f"{path}: name at least one column, and each once")
    at = F.monotonically_increasing_id()
    raw = spark.read.text(path).select(F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"), F.col("value").alias("_line"))
    sizes = raw.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each partition of the one file that is the series; lines are numbered where they stand
    numbered = raw.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").select((F.col("_before") + F.col("_at") + 1).alias("_n"), "_line")
    header = numbered.where("_n = 1").first()
    names = [] if header is None else [n.strip() for n in header["_line"].split(",")]
    absent = [c for c in columns if c not in names]
    if absent:
        raise ValueError(f"{path}: no column {', '.join(absent)}; the header has {', '.join(names) or 'nothing'}")
    cells = F.split("_line", ",", -1)
    place = F.array(*[F.struct(F.lit(c).alias("series"), F.lit(i).alias("k"), F.trim(F.coalesce(F.get(cells, F.lit(names.index(c))), F.lit(""))).alias("cell")) for i, c in enumerate(columns)])
    long = numbered.where("_n > 1").select("_n", F.explode(place).alias("c")).select("_n", "c.*")
    value = F.expr("try_cast(cell as double)")
    long = long.withColumn("value", F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value))
    seen = long.agg(F.count("*").alias("n"), F.min(F.when(F.col("value").isNull(), F.struct("_n", "k", "series", "cell"))).alias("m")).first()
    if seen["m"]:
        m = seen["m"]
        raise ValueError(f"{path}:{m['_n']}: column {m['series']} has {m['cell']!r} where a finite number should be")
    if not seen["n"]:
        raise ValueError(f"{path}: no sample in {', '.join(columns)}")
    return long.select("series", (F.col("_n") - 2).cast("bigint").alias("idx"), "value")
