"""Novelty detectors: fitted on reference rows by Spark aggregations, applied as columns or joins.

A detector is fitted with ``fit(rows, features)`` and adds its score with ``score(rows)``; other classes
with these two can be put in ``REGISTRY`` or passed to the plans. A feature without spread has no
standard scale: the scores that need it are null.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import centred, finite, linear_maps, quadratic_form, total
from ..functions.dense import discarded_directions, gaussian_process, rbf, shrunk_covariance, stationary_combinations
from ..functions.staged import written
from .neighbours import PivotIndex
from .selection import select
from .statistics import Moments, moments, robust_scales, spreads, vector

PCA_VARIANCE = 0.90
NEIGHBOURS = 10
GP_BIN, GP_LENGTHS = 0.5, (1.0, 2.0, 4.0, 8.0, 16.0)


def precision_of(m: Moments) -> np.ndarray:
    return np.linalg.inv(shrunk_covariance(m.n, m.covariance, m.fourth))


def _numbers(values) -> Column:
    return F.lit([float(v) for v in values])


@dataclass
class Mahalanobis:
    features: list[str]
    mean: np.ndarray
    precision: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str]) -> Mahalanobis:
        m = moments(rows, features)
        return cls(list(features), m.mean, precision_of(m))

    @classmethod
    def left_out(cls, rows: DataFrame, row_id: str, features: list[str]) -> DataFrame:
        return leave_groups_out(rows, row_id, features).select(row_id, "score")

    def column(self) -> Column:
        return F.sqrt(F.greatest(quadratic_form(centred(self.features, self.mean), self.precision), F.lit(0.0)))

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", self.column())


@dataclass
class PcaResidual:
    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray | None
    retained: int

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], variance: float = PCA_VARIANCE) -> PcaResidual:
        m = moments(rows, features)
        scale = np.sqrt(np.diag(m.covariance))
        if (scale == 0).any():
            return cls(list(features), m.mean, scale, None, 0)
        directions, retained = discarded_directions(m.covariance / np.outer(scale, scale), variance)
        return cls(list(features), m.mean, scale, directions, retained)

    @classmethod
    def left_out(cls, rows: DataFrame, row_id: str, features: list[str], variance: float = PCA_VARIANCE) -> DataFrame:
        """A fold's covariance is that of all rows less the row's own product, so a task needs its rows and one matrix."""
        rows = rows.dropna(subset=features)
        m = moments(rows, features)
        n, mean, whole = m.n, m.mean, m.covariance
        kind = rows.schema[row_id].dataType.simpleString()

        def run(batches):
            import pandas as pd

            for pdf in batches:
                d, p = pdf.iloc[:, 1:].to_numpy(float) - mean, len(mean)
                score = np.full(len(d), np.nan)
                step = max(1, 4_000_000 // (p * p))
                for at in range(0, len(d) if n > 2 else 0, step):
                    x = d[at : at + step]
                    covariance = (n * whole - n / (n - 1) * x[:, :, None] * x[:, None, :]) / (n - 1)
                    scale = np.sqrt(np.maximum(np.einsum("bii->bi", covariance), 0))
                    spread = (scale > 1e-12 * np.sqrt(np.diag(whole))).all(axis=1)
                    unit = np.where(spread[:, None], scale, 1.0)
                    values, vectors = np.linalg.eigh(covariance / (unit[:, :, None] * unit[:, None, :]))
                    values, vectors = values[:, ::-1], vectors[:, :, ::-1]
                    share = np.cumsum(values, axis=1) / values.sum(axis=1, keepdims=True)
                    kept = np.minimum((share < variance).sum(axis=1) + 1, p - 1)
                    along = np.einsum("bi,bij->bj", x * n / (n - 1) / unit, vectors)
                    left = np.where(np.arange(p)[None, :] >= kept[:, None], along, 0.0)
                    score[at : at + step] = np.where(spread, np.sqrt((left * left).sum(axis=1)), np.nan)
                yield pd.DataFrame({row_id: pdf.iloc[:, 0], "score": score})

        return rows.select(row_id, *[F.col(f).cast("double") for f in features]).mapInPandas(run, f"`{row_id}` {kind}, score double").select(row_id, finite("score").alias("score"))

    def score(self, rows: DataFrame) -> DataFrame:
        if self.directions is None:
            return rows.withColumn("score", F.lit(None).cast("double"))
        z = [x / float(s) for x, s in zip(centred(self.features, self.mean), self.scale)]
        return rows.withColumn("score", F.sqrt(total([r * r for r in linear_maps(z, self.directions)])))


@dataclass
class NearestNeighbours:
    """Mean distance to the k nearest reference rows in reference-standardised units; exact, by a pivot index."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    index: PivotIndex
    k: int = NEIGHBOURS

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], row_id: str | None = None) -> NearestNeighbours:
        _, mean, scale = spreads(rows, features)
        unit = cls._units(features, mean, scale)
        keep = [] if row_id is None else [row_id]
        return cls(list(features), mean, scale, PivotIndex.build(rows.dropna(subset=features).select(*keep, unit.alias("v")), row_id))

    @staticmethod
    def _units(features: list[str], mean: np.ndarray, scale: np.ndarray) -> Column:
        """Standardised features; null without all of them, or where one has no spread."""
        if (scale == 0).any():
            return F.lit(None).cast("array<double>")
        unit = F.zip_with(F.zip_with(vector(features), _numbers(mean), lambda x, m: x - m), _numbers(scale), lambda x, s: x / s)
        return F.when(functools.reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features]), unit)

    @classmethod
    def left_out(cls, rows: DataFrame, row_id: str, features: list[str], k: int = NEIGHBOURS) -> DataFrame:
        """The index of all rows answers every fold: a fold leaves its own row out and measures in its own scale, whose ratio to that of all rows is a column."""
        rows = written(rows.dropna(subset=features).withColumn("_rid", F.monotonically_increasing_id()))
        whole = cls.fit(rows, features, "_rid")
        n = rows.count()
        unit = cls._units(features, whole.mean, whole.scale)
        # in units of all rows' deviation: the variance of the others, and its root's reciprocal
        others = F.transform(unit, lambda z: (n - n / max(n - 1, 1) * z * z) / max(n - 1, 1))
        ratio = F.transform(others, lambda v: F.when(v > 1e-24, 1 / F.sqrt(v)))
        asked = rows.select(F.col("_rid").alias("qid"), unit.alias("v"), ratio.alias("ratio"), F.col("_rid").alias("skip")).where(~F.exists("ratio", lambda x: x.isNull()))
        found = whole.index.nearest(asked if n > 1 else asked.limit(0), k)
        return rows.join(found, F.col("_rid") == F.col("qid"), "left").select(row_id, F.col("mean").alias("score"))

    def score(self, rows: DataFrame) -> DataFrame:
        if self.index is None:
            return rows.withColumn("score", F.lit(None).cast("double"))
        rows = written(rows.withColumn("qid", F.monotonically_increasing_id()))
        queries = rows.select("qid", self._units(self.features, self.mean, self.scale).alias("v"), F.lit(None).cast("array<double>").alias("ratio"), F.lit(None).alias("skip"))
        return rows.join(self.index.nearest(queries, self.k).select("qid", F.col("mean").alias("score")), "qid", "left").drop("qid")


@dataclass
class MaxDeviation:
    """The largest robust z-score of any feature."""

    features: list[str]
    centre: list[float]
    scale: list[float]

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str]) -> MaxDeviation:
        """Every feature's median and scaled median absolute deviation, all features at once; one without a finite value scores null."""
        values = written(rows.select(F.posexplode(vector(features)).alias("feature", "value")))
        found = {r["feature"]: r for r in robust_scales(values, ["feature"], "value").collect()}  # one row per feature
        return cls(list(features), *([found[i][k] if i in found else None for i in range(len(features))] for k in ("centre", "scale")))

    @classmethod
    def left_out(cls, rows: DataFrame, row_id: str, features: list[str]) -> DataFrame:
        """Without one row a median is one of two or three neighbouring values, or their mean, by the side the row lies on.

        So each feature has three centres at most over all folds, and each centre's deviations have their own middle values; all come
        from order statistics of whole columns.
        """
        rows = written(rows.dropna(subset=features).withColumn("_rid", F.monotonically_increasing_id()))
        n = rows.count()
        values = written(rows.select("_rid", F.posexplode(vector(features)).alias("feature", "v")))
        if n < 2:
            return rows.select(row_id, F.lit(None).cast("double").alias("score"))
        centres = _middle(values, ["feature"], "v", n).withColumnRenamed("feature", "_f")
        placed = written(values.join(F.broadcast(centres), F.col("feature") == F.col("_f")).withColumn("centre", _without(F.col("v"), n)).select("_rid", "feature", "v", "centre"))
        kinds = placed.select(F.col("feature").alias("_f"), F.col("centre").alias("_c")).distinct()  # three a feature at most
        far = values.join(F.broadcast(kinds), F.col("feature") == F.col("_f")).select("feature", F.col("_c").alias("centre"), F.abs(F.col("v") - F.col("_c")).alias("d"))
        spread = _middle(far, ["feature", "centre"], "d", n).withColumnsRenamed({"feature": "_f", "centre": "_c"})
        judged = placed.join(F.broadcast(spread), (F.col("feature") == F.col("_f")) & (F.col("centre") == F.col("_c"))).withColumn("d", F.abs(F.col("v") - F.col("centre")))
        mad = 1.4826 * _without(F.col("d"), n)
        worst = judged.groupBy(F.col("_rid").alias("_row")).agg(F.max(F.when(mad > 0, F.col("d") / mad)).alias("score"))
        return rows.join(worst, F.col("_rid") == F.col("_row"), "left").select(row_id, "score")

    def score(self, rows: DataFrame) -> DataFrame:
        known = [i for i, (c, s) in enumerate(zip(self.centre, self.scale)) if c is not None and s]
        if not known:
            return rows.withColumn("score", F.lit(None).cast("double"))
        away = F.zip_with(vector([self.features[i] for i in known]), _numbers([self.centre[i] for i in known]), lambda x, c: F.abs(x - c))
        return rows.withColumn("score", F.array_max(F.zip_with(away, _numbers([self.scale[i] for i in known]), lambda d, s: d / s)))


def _middle(rows: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """``keys, _a0, _a1, _a2``: the values of n around the middle of the n - 1 that a fold has."""
    first = n // 2
    ranks = rows.select(*keys).distinct().withColumn("rank", F.explode(F.array(*[F.lit(first + i) for i in range(3)])))
    found = select(rows, keys, value, ranks).groupBy(*keys)
    return found.agg(*[F.max(F.when(F.col("rank") == first + i, F.col("value"))).alias(f"_a{i}") for i in range(3)])


def _without(x: Column, n: int) -> Column:
    """The median of n values less the one that is x, from the middle values: what is at or below a place moves the place up by one."""
    a = [F.col(f"_a{i}") for i in range(3)]
    low = F.when(x <= a[0], a[1]).otherwise(a[0])
    return low if n % 2 == 0 else (low + F.when(x <= a[1], a[2]).otherwise(a[1])) / 2


@dataclass
class Cointegration:
    """Mahalanobis distance of the most mean-reverting combinations of the features."""

    features: list[str]
    vectors: np.ndarray
    inner: Mahalanobis

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], trends: int = 1) -> Cointegration:
        """``rows`` has ``ts``, one row an hour (of a ``unit``, where there is one); the steps are those between rows exactly an hour apart, met by a join on the hour."""
        units = ["unit"] if "unit" in rows.columns else []
        seconds = F.unix_timestamp("ts")
        earlier = rows.select(*units, (seconds + 3600).alias("_at"), *[F.col(f).alias(f"_p_{f}") for f in features])
        pairs = rows.select(*units, seconds.alias("_at"), *features).join(earlier, [*units, "_at"])
        joint = written(pairs.select(*features, *[F.col(f"_p_{f}") for f in features], *[(F.col(f) - F.col(f"_p_{f}")).alias(f"_d_{f}") for f in features]))
        p = len(features)
        c = moments(joint, [f"_d_{f}" for f in features] + [f"_p_{f}" for f in features]).covariance
        vectors = stationary_combinations(c[:p, :p], c[:p, p:], c[p:, p:], trends)
        names = [f"_v{i}" for i in range(vectors.shape[1])]
        current = joint.select(*[x.alias(n) for x, n in zip(linear_maps([F.col(f) for f in features], vectors.T), names)])
        return cls(list(features), vectors, Mahalanobis.fit(current, names))

    def score(self, rows: DataFrame) -> DataFrame:
        maps = dict(zip(self.inner.features, linear_maps([F.col(f) for f in self.features], self.vectors.T)))
        return self.inner.score(rows.withColumns(maps)).drop(*self.inner.features)


REGISTRY = {"raw_frequencies": Mahalanobis, "pca_residual": PcaResidual, "knn": NearestNeighbours}


@dataclass
class GaussianProcessBaseline:
    """Each target as a smooth function of temperature, from means of temperature bins."""

    targets: list[str]
    temperature: str
    curves: list[tuple[float, float, np.ndarray]]
    inputs: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, temperature: str, targets: list[str]) -> GaussianProcessBaseline:
        bins = gp_bins(rows, temperature, targets).orderBy("bin").collect()  # as many as the temperature has half degrees
        x, count = np.array([r["temperature"] for r in bins]), np.array([r["n"] for r in bins], float)
        n = count.sum()
        curves = []
        for t in targets:
            within = sum(r[f"ss_{t}"] for r in bins) / max(n - len(bins), 1)
            curves.append(gaussian_process(x, np.array([r[f"mean_{t}"] for r in bins]), count, within, GP_LENGTHS))
        return cls(list(targets), temperature, curves, x)

    def predict(self, target: int) -> Column:
        """The curve at the row's temperature: Arrow batches of temperatures, each different one evaluated once."""
        offset, length, weights = self.curves[target]
        inputs = self.inputs

        @F.pandas_udf("double")
        def curve(temperature):
            import pandas as pd

            t, place = np.unique(temperature.to_numpy(float), return_inverse=True)
            out = np.empty(len(t))
            step = max(1, 2_000_000 // len(inputs))
            for at in range(0, len(t), step):
                out[at : at + step] = offset + rbf(t[at : at + step], inputs, length) @ weights
            return pd.Series(out[place])

        return finite(curve(F.col(self.temperature).cast("double")))

    def residuals(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({t: F.col(t) - self.predict(i) for i, t in enumerate(self.targets)})


def gp_bins(rows: DataFrame, temperature: str, targets: list[str], width: float = GP_BIN) -> DataFrame:
    """``bin, n, temperature, mean_<t>, ss_<t>``: means and sums of squares around them per temperature bin."""
    return rows.groupBy(F.floor(F.col(temperature) / F.lit(width)).cast("bigint").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(temperature).alias("temperature"), *[x for t in targets for x in (F.avg(t).alias(f"mean_{t}"), (F.var_pop(t) * F.count(t)).alias(f"ss_{t}"))]
    )


def leave_groups_out(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Mahalanobis score of each row from a fit on all rows of other groups, from one aggregation per group.

    The sums a fold needs are those of all rows less those of its group, so nothing is refitted; the
    folds' means and precisions are joined back by group. Rows that lack a feature are in no fold and have no score;
    a row without a group is a fold of its own with the other rows without one.
    """
    rows = rows.dropna(subset=features)
    whole = moments(rows, features)
    z, p = centred(features, whole.mean), len(features)
    norm = total([x * x for x in z])
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = rows.groupBy(group).agg(
        F.count("*").alias("n"), F.array(*[F.sum(x) for x in z]).alias("s"), F.array(*[F.sum(z[i] * z[j]) for i, j in pairs]).alias("q"), F.sum(norm * norm).alias("f"), F.array(*[F.sum(norm * x) for x in z]).alias("c")
    )

    # what all groups add up to: one row of p (p + 1) / 2 values and a few more
    added = rows.agg(F.array(*[F.sum(x) for x in z]), F.array(*[F.sum(z[i] * z[j]) for i, j in pairs]), F.sum(norm * norm), F.array(*[F.sum(norm * x) for x in z])).first()
    totals, n, mean = tuple(np.array(x, float) for x in added), whole.n, whole.mean

    def square(flat):
        out = np.zeros((p, p))
        for (i, j), x in zip(pairs, flat):
            out[i, j] = out[j, i] = x
        return out

    def fold(batches):
        import pandas as pd

        for part in batches:
            out = []
            for key, size, s, q, f, c in part.itertuples(index=False):
                m = n - size
                if m < 2:
                    continue
                s, q, f, c = totals[0] - s, square(totals[1] - q), float(totals[2]) - f, totals[3] - c
                d = s / m
                dd = d @ d
                fourth = f + 4 * d @ q @ d + m * dd * dd - 4 * d @ c + 2 * dd * np.trace(q) - 4 * dd * m * dd
                precision = precision_of(Moments(m, mean + d, q / m - np.outer(d, d), fourth))
                out.append((key, (mean + d).tolist(), precision.tolist()))
            yield pd.DataFrame(out, columns=[group, "_mean", "_precision"])

    kind = rows.schema[group].dataType.simpleString()
    table = sums.mapInPandas(fold, f"`{group}` {kind}, _mean array<double>, _precision array<array<double>>")
    dev = F.zip_with(F.array(*features), F.col("_mean"), lambda x, y: x - y)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    form = dot(F.col("_dev"), F.transform("_precision", lambda row: dot(row, F.col("_dev"))))
    same = F.struct(F.col(group)) == F.struct(F.col("_group"))
    joined = rows.join(table.withColumnRenamed(group, "_group"), same).drop("_group")
    return joined.withColumn("_dev", dev).withColumn("score", F.sqrt(F.greatest(form, F.lit(0.0)))).drop("_mean", "_precision", "_dev")


#: Folds of a detector that only has ``fit`` and ``score`` are Spark fits of their own, up to so many.
REFITS = 500


def leave_one_out(detector, rows: DataFrame, row_id: str, features: list[str]) -> DataFrame:
    """``row_id, score`` of each reference row that has all features, scored by a detector that has not seen it.

    The library's detectors know their folds from sums, ranks or neighbours of all rows (``left_out``). Any other class with
    ``fit`` and ``score`` is fitted once a row, which is refused for more than ``REFITS`` rows.
    """
    if hasattr(detector, "left_out"):
        return detector.left_out(rows, row_id, features)
    ids = [r[0] for r in rows.select(row_id).distinct().limit(REFITS + 1).collect()]
    if len(ids) > REFITS:
        raise ValueError(f"{detector.__name__} has no left_out and would be fitted for each of more than {REFITS} rows")
    parts = [detector.fit(rows.where(F.col(row_id) != i), features).score(rows.where(F.col(row_id) == i)).select(row_id, "score") for i in ids]
    return functools.reduce(DataFrame.unionByName, parts)
