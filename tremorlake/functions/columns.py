"""Column expressions that stay inside generated code: times, windows, vectors, complex numbers, severities."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """The value, or null where it is NaN or infinite: from ingest on, missing is null only."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def total(terms: list[Column]) -> Column:
    return functools.reduce(operator.add, terms) if terms else F.lit(0.0)


def datenum_time(days: str | Column) -> Column:
    """A day count from year 0 as a timestamp, rounded to the nearest hour (half an hour rounds up)."""
    seconds = F.round((col(days) - 719529) * 86400).cast("bigint")
    return F.timestamp_seconds(F.floor((seconds + 1800) / 3600) * 3600)


def record_time(name: str | Column, origin: str) -> Column:
    """Start of a record named by week (two digits), weekday letter (A first) and hour (two digits)."""
    n = col(name)
    week, day, hour = F.substring(n, 1, 2).cast("int"), F.ascii(F.upper(F.substring(n, 3, 1))) - 65, F.substring(n, 4, 2).cast("int")
    return F.timestamp_seconds(F.unix_timestamp(F.lit(origin).cast("timestamp")) + ((week - 1) * 7 + day) * 86400 + hour * 3600)


def event_time(name: str | Column) -> Column:
    """The time in a file name such as 2023_03_09T23_45_25.csv."""
    return F.to_timestamp(F.regexp_extract(col(name), r"(\d{4}_\d\d_\d\dT\d\d_\d\d_\d\d)[^/]*$", 1), "yyyy_MM_dd'T'HH_mm_ss")


def hann(index: str | Column, n: str | Column, periodic: bool = False) -> Column:
    """Hann window weight; the symmetric form divides by n - 1, the periodic one by n. Fewer than two samples weigh 1."""
    n = col(n) if isinstance(n, (str, Column)) else F.lit(n)
    return F.when(n < 2, F.lit(1.0)).otherwise(0.5 - 0.5 * F.cos(2 * F.pi() * col(index) / (n if periodic else n - 1)))


def below_hinge(temperature: str | Column, hinge: float = 0.0) -> Column:
    """The second regressor of a bilinear temperature model: how far the temperature is below the hinge."""
    return F.least(col(temperature) - hinge, F.lit(0.0))


def parabolic_offset(left: Column, centre: Column, right: Column) -> Column:
    """Offset in bins of the vertex of the parabola through three log powers; 0 without a neighbour or a maximum."""
    a, b, c = F.log(left), F.log(centre), F.log(right)
    bend = a - 2 * b + c
    return F.when(left.isNull() | right.isNull() | (bend >= 0), F.lit(0.0)).otherwise(0.5 * (a - c) / bend)


def mac(a: str | Column, b: str | Column) -> Column:
    """Modal assurance criterion of two complex vectors, arrays of (re, im)."""
    a, b = col(a), col(b)

    def add(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    re = add(F.zip_with(a, b, lambda x, y: x["re"] * y["re"] + x["im"] * y["im"]))
    im = add(F.zip_with(a, b, lambda x, y: x["re"] * y["im"] - x["im"] * y["re"]))
    norm = lambda v: add(F.transform(v, lambda x: x["re"] * x["re"] + x["im"] * x["im"]))
    return (re * re + im * im) / (norm(a) * norm(b))


def severity(drop_percent: str | Column, warn: float = 5.0, alarm: float = 10.0) -> Column:
    """Of a drop in percent; a rise has none."""
    d = col(drop_percent)
    return F.when(d >= alarm, "alarm").when(d >= warn, "warn").when(d > 0, "watch").otherwise("none")


def severity_rank(name: str | Column) -> Column:
    n = col(name)
    return F.when(n == "alarm", 3).when(n == "warn", 2).when(n == "watch", 1).otherwise(0)


def centred(columns: list[str], mean) -> list[Column]:
    return [F.col(c) - float(m) for c, m in zip(columns, mean)]


def quadratic_form(z: list[Column], matrix) -> Column:
    """z' M z for a symmetric matrix of numbers, as one generated expression."""
    terms = [z[i] * z[i] * float(matrix[i][i]) for i in range(len(z))]
    terms += [z[i] * z[j] * float(2 * matrix[i][j]) for i in range(len(z)) for j in range(i)]
    return total(terms)


def linear_maps(z: list[Column], matrix) -> list[Column]:
    """One column per row of the matrix: its product with z."""
    return [total([x * float(m) for x, m in zip(z, row)]) for row in matrix]
