"""Operator 13: principal components and whitening of embeddings by a randomised range finder.

The fit list (each distinct quantised vector once) is written to the shared folder. A random matrix of a few more
columns than the wanted components is multiplied with its covariance again and again; each power pass is one scan
of all centred rows in which a task adds up its own product, so what travels is one small matrix a task and what
reaches the driver has width times columns numbers, whatever the number of rows. Rayleigh-Ritz in the space that the
passes found gives components; where a component's residual is too large beside the distance to its neighbouring
eigenvalues, the space grows to the full dimension, where the components are exact to rounding.

Defined edge cases: a row whose vector is null or has an entry that is null, not finite or of 2^50 or more in size is left out, as
are rows of another than the commonest vector length; empty texts don't exist here, empty vectors give no component; rows without
vec_id or with a repeated one are whitened like others; repeated vectors count once in the fit; components without
variance (eigenvalue below rounding of the largest) are left out, so a fit list of one vector and an empty table give no rows;
of equal eigenvalues any orthonormal choice may come; ``deviation`` is null where it passes 64 bits; other columns, whatever
their names, are not read. Vectors may be as long as memory has room for a width x width matrix at the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stage, table
from .vectors import column_totals, matrix, one_width, usable, whole

#: Wanted components; columns beside them; power passes before the first test; seed of the random matrix.
COMPONENTS, OVERSAMPLING, PASSES, SEED = 16, 10, 4, 13
#: Largest residual of a component, over the distance to its neighbouring eigenvalues, that counts as double precision.
RESIDUAL = 1e-11
SCALE, SHIFT, BOUND = 64, 1_000_000, 2.0**50
SCHEMA = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x).astype(np.int64) + SHIFT


@dataclass
class Whitening:
    """``vectors`` has a unit column per component, ``values`` their eigenvalues; ``basis`` is the size of the space they were found in."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    basis: int
    identity_error: float = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values)

    def transform(self, rows: DataFrame, row_id: str = "vec_id", column: str = "embedding") -> DataFrame:
        """``row_id, component, n, deviation, whitened, explained, identity_error``: one row per usable row and component."""
        fit, width, k = self, len(self.sums), len(self.values)
        kind = rows.schema[row_id].dataType.simpleString()

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                x = quantised(matrix(batch.column(1), width))
                m, each = len(x), np.repeat(np.arange(len(x)), k)
                far = [v if v < 2**63 else None for v in deviations(x, fit.n, fit.sums)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, fit.n), pa.int64()),
                        pa.array(far, pa.int64()).take(pa.array(each)),
                        pa.array(fit.scaled(x).ravel()),
                        pa.array(np.tile(fit.values / fit.trace, m)),
                        pa.array(np.full(m * k, fit.identity_error)),
                    ],
                    [row_id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        kept = usable(rows, column, BOUND).where(F.size(column) == width)
        return small_batches(kept).select(row_id, column).mapInArrow(run, f"`{row_id}` {kind}, {SCHEMA}")


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the places of (n x - S)^2, exact."""
    most = float(n) * float(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    d = whole(x, most) * n - np.array(sums, object if most >= 2.0**62 else np.int64)
    far = max((abs(int(v)) for v in (d.max(initial=0), d.min(initial=0))), default=0) if d.size else 0
    d = whole(d, float(far) ** 2 * max(len(sums), 1))
    return [int(v) for v in (d * d).sum(axis=1)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n with one rounding: the whole part of the mean is taken away in integers."""
    floors = [s // n for s in sums]
    rest = np.array([(s - f * n) / n for s, f in zip(sums, floors)])
    return (x - np.array(floors, np.int64)).astype(np.float64) - rest


def _gathered(fit_list: DataFrame, width: int, columns: int, work) -> np.ndarray:
    """The sum over all rows of ``work(x)``, a matrix of ``columns`` columns; tasks add up their own rows first."""

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            part = work(matrix(batch.column(0), width).astype(np.int64))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["cell", "v"])

    got = fit_list.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(got))
    for cell, v in got:
        out[cell] = v
    return out.reshape(-1, columns)


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES) -> Whitening | None:
    """Components of the distinct quantised vectors; None where there is none with variance."""
    kept, width = one_width(usable(rows, column, BOUND), column)
    if not width:
        return None
    whole_numbers = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT)
    fit_list = small_batches(stage(kept.select(whole_numbers.alias("x")).distinct(), "fit"))  # copies meet in their own task first
    n, sums = column_totals(fit_list, "x", width, lambda x: x.astype(np.int64))

    def covariance_times(q: np.ndarray) -> tuple[np.ndarray, float]:
        """V q, and the trace of V in a row of its own."""
        wide = q.shape[1]

        def work(x):
            z = centred(x, n, sums)
            trace = np.zeros((1, wide))
            trace[0, 0] = (z * z).sum()
            return np.vstack([z.T @ (z @ q), trace])

        got = _gathered(fit_list, width, wide, work) / n
        return got[:-1], got[-1, 0]

    size = min(width, components + oversampling)
    while True:
        if size < width:
            q = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, size)))[0]
            for _ in range(passes):
                q = np.linalg.qr(covariance_times(q)[0])[0]
        else:
            q = np.eye(width)
        y, trace = covariance_times(q)
        ritz = q.T @ y
        values, inner = np.linalg.eigh((ritz + ritz.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        vectors = q @ inner
        residuals = np.linalg.norm(y @ inner - vectors * values, axis=0)
        apart = np.abs(np.diff(values))
        apart = np.minimum(np.append(np.inf, apart), np.append(apart, np.inf))
        found = min(components, int((values > 16 * width * np.finfo(float).eps * max(values[0], 0)).sum()))
        if size == width or found == components and (residuals[:found] <= RESIDUAL * apart[:found]).all():
            break
        size = width
    if not found or values[0] <= 0:
        return None
    vectors = vectors[:, :found] / np.linalg.norm(vectors[:, :found], axis=0)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(found)] < 0, -1, 1)  # the largest entry is positive
    out = Whitening(n, sums, trace, values[:found], vectors, size)

    def squares(x):
        w = out.scaled(x)
        return np.vstack([w.T @ w, w.sum(axis=0)[None]])

    got = _gathered(fit_list, width, found, squares) / n
    out.identity_error = float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(found)).max())
    return out


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = fit(rows)
    if model is None:
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {SCHEMA}")
    return model.transform(rows)
