"""What the operators on vectors share: usable rows, one width, Arrow lists as matrices, exact totals of tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, column: str, bound: float) -> DataFrame:
    """The rows whose vector is not null and has no entry that is null, not finite or of ``bound`` or more in size."""
    return rows.where(F.col(column).isNotNull() & F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < bound, F.lit(False))))


def one_width(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows of the commonest vector length (of equally common ones the longest) and that length; 0 for an empty table."""
    got = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = got[0] if got else 0
    return rows.where(F.size(column) == width), width


def matrix(column, width: int) -> np.ndarray:
    """A list column of an Arrow batch, all of one length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def whole(numbers: np.ndarray, most: float) -> np.ndarray:
    """Integers as they are while ``most`` (the largest result of what follows) fits 64 bits, else as Python's, which have no limit."""
    return numbers if most < 2.0**62 else numbers.astype(object)


def column_totals(rows: DataFrame, column: str, width: int, values) -> tuple[int, list[int]]:
    """The number of rows and the exact sums of ``values(matrix)`` by place; a task sends one row a place, whatever it has read."""

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        n, sums = 0, np.zeros(width, object)
        for batch in batches:
            x = values(matrix(batch.column(0), width))
            n += len(x)
            sums = sums + whole(x, float(np.abs(x).max(initial=0)) * len(x)).sum(axis=0)
        cells = [Decimal(int(v)) for v in (n, *sums)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width), pa.int32()), pa.array(cells, pa.decimal128(38, 0))], ["place", "v"])

    got = {r[0]: int(r[1]) for r in rows.select(column).mapInArrow(run, "place int, v decimal(38,0)").groupBy("place").agg(F.sum("v")).collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(width)]
