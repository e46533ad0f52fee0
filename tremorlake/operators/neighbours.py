"""Exact nearest neighbours by a pivot index: rings around pivots, bounds by the triangle inequality, nearest rings first.

Every reference vector belongs to its nearest pivot; vectors of a pivot, in the order of their distance to it, form rings
of a bounded number of rows. A query's distance to a pivot bounds its distance to every ring around it from below. The first round
visits the rings with the least bounds; the k-th distance found there rules out all rings whose bound is larger, and the second
round visits the rest. Queries meet the rows of a ring by a shuffle on (ring, part of its queries), so neither side is
broadcast; a task holds one ring and a bounded number of queries. What tasks do share is the table of rings
(``MAX_RINGS`` at most) and the pivots.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staged import written

#: Pivots are chosen, each far from those before, among so many vectors.
PIVOTS, PIVOT_SAMPLE = 64, 2048
#: Rows of a ring at least; rings at most (beyond that, rings have more rows).
RING_ROWS, MAX_RINGS = 1024, 65_536
#: Rings of the first round; queries that meet a ring in one task.
FIRST_RINGS, QUERIES = 3, 20_000
#: Bounds of queries to rings, and meetings of the two, that a task holds at once.
CELLS, SENT = 1_000_000, 10_000


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different rows: the first, then always the one farthest from all before."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(sum((a[:, None, i] - b[None, :, i]) ** 2 for i in range(a.shape[1])), 0))


def least_squares(a: np.ndarray, b: np.ndarray, w: np.ndarray, away: np.ndarray | None, k: int) -> np.ndarray:
    """The k least of the sums of ((a - b) w)^2 of each row of ``a`` to the rows of ``b``, ascending; pairs that are ``away`` are infinite.

    Matrix products say which pairs can be among them, within what their rounding allows; those are summed term by term.
    """
    w2 = w * w
    own, other = (w2 * a * a).sum(axis=1), w2 @ (b * b).T
    own, near = own[:, None], own[:, None] - 2 * (w2 * a) @ b.T + other
    slack = 1e-12 * np.where(np.isfinite(own + other), own + other, 0).max(axis=1) * a.shape[1]
    near[np.isnan(near)] = np.inf  # what isn't finite is no neighbour
    if away is not None:
        near[away] = np.inf
    kth = np.partition(near, k - 1, axis=1)[:, k - 1]
    i, j = np.nonzero(near <= (kth + slack)[:, None])
    exact = np.empty(len(i))
    for at in range(0, len(i), 50_000):
        p = slice(at, at + 50_000)
        exact[p] = (((a[i[p]] - b[j[p]]) * w[i[p]]) ** 2).sum(axis=1)
    exact[np.isnan(exact)] = np.inf
    if away is not None:
        exact[away[i, j]] = np.inf
    order = np.lexsort((exact, i))
    i, exact = i[order], exact[order]
    starts = np.searchsorted(i, np.arange(len(a)))
    return exact[starts[:, None] + np.arange(k)]


@dataclass
class PivotIndex:
    """``rings`` has ring, pivot, lo, hi, n; ``rows`` has ring, id, v. Both are written tables."""

    pivots: np.ndarray
    rings: DataFrame
    rows: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, row_id: str | None = None) -> PivotIndex | None:
        """An index of the vectors ``v`` (of one length, without nulls); ``row_id`` names rows that queries can leave out. None without a row."""
        ids = F.lit(None).cast("string") if row_id is None else F.col(row_id).cast("string")
        rows = rows.where("v is not null").select(ids.alias("id"), "v")
        n = rows.count()
        if not n:
            return None
        sample = np.array([r[0] for r in rows.select("v").orderBy(F.xxhash64("v"), "v").limit(PIVOT_SAMPLE).collect()])
        per_ring = max(RING_ROWS, -(-2 * n // MAX_RINGS))
        pivots = spread_out(sample, max(1, min(PIVOTS, n // per_ring)))

        def place(batches):
            import pandas as pd

            for pdf in batches:
                far = distances(np.stack(pdf["v"].to_list()), pivots) if len(pdf) else np.zeros((0, len(pivots)))
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "pivot": far.argmin(axis=1).astype(np.int32), "far": far.min(axis=1) if len(pdf) else []})

        def ring(batches):
            import pandas as pd
            from pyspark import TaskContext

            base, last, at, held = TaskContext.get().partitionId() << 32, None, -1, 0
            for pdf in batches:
                out = []
                for pivot in pdf["pivot"]:
                    if pivot != last or held == per_ring:
                        last, at, held = pivot, at + 1, 0
                    held += 1
                    out.append(base + at)
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "pivot": pdf["pivot"], "far": pdf["far"], "ring": out})

        placed = rows.mapInPandas(place, "id string, v array<double>, pivot int, far double").withColumn("_row", F.monotonically_increasing_id())
        parts = -(-n // (8 * per_ring))
        ringed = placed.repartitionByRange(parts, "pivot", "far", "_row").sortWithinPartitions("pivot", "far", "_row").drop("_row")
        held = written(ringed.mapInPandas(ring, "id string, v array<double>, pivot int, far double, ring bigint"))
        rings = held.groupBy("ring").agg(F.min("pivot").alias("pivot"), F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("n"))
        return cls(pivots, written(rings), held.select("ring", "id", "v"))

    def _table(self) -> dict[str, np.ndarray]:
        pdf = self.rings.toPandas()  # MAX_RINGS rows and a few more
        return {k: pdf[k].to_numpy() for k in pdf.columns}

    def _meetings(self, queries: DataFrame, k: int, seen: bool) -> DataFrame:
        """``qid, v, ratio, skip, ring``: the rings each query has to visit; those of the first round, or with ``seen`` those that its bound leaves besides."""
        t, pivots = self._table(), self.pivots

        def run(batches):
            import pandas as pd

            step = max(1, CELLS // max(1, len(t["ring"])))
            for pdf in (whole.iloc[at : at + step] for whole in batches for at in range(0, len(whole), step)):
                least = np.array([1.0 if w is None else np.min(w) for w in pdf["ratio"]])
                far = distances(np.stack(pdf["v"].to_list()), pivots)[:, t["pivot"]]
                low = np.maximum(0, np.maximum(far - t["hi"], t["lo"] - far)) * least[:, None]
                order = np.argsort(low, axis=1, kind="stable")
                held = np.cumsum(t["n"][order], axis=1)
                # enough rows for k neighbours and the query's own, and a few rings for a tight bound
                first = np.maximum((held < k + 1).sum(axis=1) + 1, FIRST_RINGS)
                if seen:
                    slack = low[np.arange(len(pdf))[:, None], order] * (1 - 1e-9)  # bounds are rounded
                    upto = (slack <= pdf["bound"].to_numpy()[:, None]).sum(axis=1)
                    spans = [order[i, a:b] for i, (a, b) in enumerate(zip(first, upto))]
                else:
                    spans = [order[i, :a] for i, a in enumerate(first)]
                each = np.repeat(np.arange(len(pdf)), [len(s) for s in spans])
                ring = t["ring"][np.concatenate(spans)] if len(each) else np.zeros(0, np.int64)
                for at in range(0, len(each), SENT):  # a row carries its query's vector, so few go at once
                    out = pdf[["qid", "v", "ratio", "skip"]].iloc[each[at : at + SENT]].reset_index(drop=True)
                    out["ring"] = ring[at : at + SENT]
                    yield out

        return queries.mapInPandas(run, "qid bigint, v array<double>, ratio array<double>, skip string, ring bigint")

    def _visited(self, meetings: DataFrame, k: int) -> DataFrame:
        """``qid, d``: the k least distances of each query to the rows of each ring that it visits."""
        asked = F.broadcast(written(meetings.groupBy("ring").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))))  # one row per ring
        left = meetings.join(asked, "ring").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
        right = self.rows.join(asked, "ring").select("ring", "id", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

        def run(q, r):
            import pandas as pd

            if not len(q) or not len(r):
                return pd.DataFrame({"qid": [], "d": []})
            a, b = np.stack(q["v"].to_list()), np.stack(r["v"].to_list())
            w = np.stack([np.ones(a.shape[1]) if x is None else x for x in q["ratio"]])
            skip, ids, out = q["skip"].to_numpy(object), r["id"].to_numpy(object), []
            step = max(1, 2_000_000 // len(b))
            for at in range(0, len(a), step):
                part = slice(at, at + step)
                away = skip[part][:, None] == ids[None, :] if any(s is not None for s in skip[part]) else None
                out.append(np.sqrt(least_squares(a[part], b, w[part], away, min(k, len(b)))))
            found = np.concatenate(out)
            pdf = pd.DataFrame({"qid": np.repeat(q["qid"].to_numpy(), found.shape[1]), "d": found.ravel()})
            return pdf[np.isfinite(pdf["d"])]

        return left.groupBy("ring", "part").cogroup(right.groupBy("ring", "part")).applyInPandas(run, "qid bigint, d double")

    @staticmethod
    def _least(found: DataFrame, k: int) -> DataFrame:
        best = Window.partitionBy("qid").orderBy("d")  # k rows a task and query are handed on
        return found.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k).drop("_k")

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """``qid, mean, farthest, n``: mean and largest of the distances to the k nearest reference rows (fewer where there are fewer).

        ``queries`` has ``qid`` (unique), ``v`` and, per place, ``ratio``: what a difference is multiplied with in this query's units (null: 1);
        a reference row whose id is ``skip`` is not a neighbour. Least ratios scale the bounds, so answers stay exact.
        """
        queries = written(queries.where("v is not null").select("qid", "v", "ratio", F.col("skip").cast("string").alias("skip")))
        first = written(self._least(self._visited(written(self._meetings(queries, k, False)), k), k))
        bound = first.groupBy("qid").agg(F.max("d").alias("bound"), F.count("*").alias("_n"))
        open_ = queries.join(bound, "qid", "left").withColumn("bound", F.when(F.col("_n") == k, F.col("bound")).otherwise(F.lit(float("inf"))))
        rest = self._visited(written(self._meetings(open_, k, True)), k)
        return self._least(first.unionByName(rest), k).groupBy("qid").agg(F.avg("d").alias("mean"), F.max("d").alias("farthest"), F.count("*").alias("n"))

    def compared(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """How many distances ``nearest`` computes, and how many there are."""
        queries = written(queries.select("qid", "v", F.lit(None).cast("array<double>").alias("ratio"), F.lit(None).cast("string").alias("skip")))
        meetings = written(self._meetings(queries, k, False))
        bound = self._least(self._visited(meetings, k), k).groupBy("qid").agg(F.max("d").alias("bound"))
        both = meetings.unionByName(self._meetings(queries.join(bound, "qid"), k, True))
        done = both.join(F.broadcast(self.rings), "ring").agg(F.sum("n")).first()[0] or 0
        return done, queries.count() * self.rows.count()
