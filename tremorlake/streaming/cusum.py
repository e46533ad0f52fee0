"""Scores and CUSUM levels of a stream of days against a frozen reference."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.calibration import DRIFT


def stream_p_values(days: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ``p_value`` against the frozen reference scores (one row per reference day) of each arm."""
    held = reference.groupBy("arm").agg(F.collect_list("score").alias("_ref"))
    above = F.size(F.filter("_ref", lambda x: x >= F.col("score")))
    return days.join(F.broadcast(held), "arm").withColumn("p_value", (1.0 + above) / (1.0 + F.size("_ref"))).drop("_ref")


LEVELS = "structure string, arm string, day date, level double, alarmed boolean"


def _climb(days, level: float, threshold: float, drift: float):
    """Levels of (day, p) pairs in the order given, from a level, as rows (day, level, alarmed), and the last level."""
    rows = []
    for day, p in days:
        level = max(0.0, level - math.log(p) - drift)
        rows.append((day, level, level >= threshold))
    return rows, level


def stream_cusum(days: DataFrame, threshold: float, drift: float = DRIFT, lateness: str | None = None) -> DataFrame:
    """``structure, arm, day, level, alarmed`` from a stream of ``structure, arm, day, p_value``.

    With ``lateness`` days may come in any order: a day waits in the key's state until the watermark (the latest day seen less the
    lateness) is past it, and is then added in its place, so the levels are those of the sorted record; the state is the level and the
    days that wait, as many as the lateness has. A day that comes later than that is dropped, as Spark drops rows behind the watermark; of a day that comes twice
    while it waits the last p counts. Without ``lateness`` days are taken as they come, sorted within a trigger, and the state is the level.
    """
    if lateness is None:

        def run(key, batches, state: GroupState):
            import pandas as pd

            seen = pd.concat(list(batches)).sort_values("day")
            rows, level = _climb(zip(seen["day"], seen["p_value"]), state.get[0] if state.exists else 0.0, threshold, drift)
            state.update((level,))
            yield pd.DataFrame([(*key, *r) for r in rows], columns=["structure", "arm", "day", "level", "alarmed"])

        return days.groupBy("structure", "arm").applyInPandasWithState(run, LEVELS, "level double", "append", GroupStateTimeout.NoTimeout)

    def ordered(key, batches, state: GroupState):
        import datetime as dt

        import pandas as pd

        level, numbers, ps = state.get if state.exists else (0.0, [], [])
        waiting = dict(zip(numbers, ps))
        if not state.hasTimedOut:
            for pdf in batches:
                waiting |= {(t - pd.Timestamp(0)).days: float(p) for t, p in zip(pd.to_datetime(pdf["day"]), pdf["p_value"])}
        mark = state.getCurrentWatermarkMs()
        ready = sorted(n for n in waiting if n * 86_400_000 < mark)
        rows, level = _climb([(n, waiting.pop(n)) for n in ready], level, threshold, drift)
        left = sorted(waiting)
        state.update((level, left, [waiting[n] for n in left]))
        if left:
            state.setTimeoutTimestamp(max(left[0] * 86_400_000, mark) + 1)
        yield pd.DataFrame([(*key, dt.date(1970, 1, 1) + dt.timedelta(days=n), x, a) for n, x, a in rows], columns=["structure", "arm", "day", "level", "alarmed"])

    timed = days.withColumn("_ts", F.col("day").cast("timestamp")).withWatermark("_ts", lateness)
    return timed.groupBy("structure", "arm").applyInPandasWithState(ordered, LEVELS, "level double, numbers array<bigint>, ps array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_daily_means(samples: DataFrame, lateness: str = "1 day") -> DataFrame:
    """``structure, day, value, n`` per closed day of an event stream ``structure, ts, value``."""
    return samples.withWatermark("ts", lateness).groupBy("structure", F.window("ts", "1 day").alias("w")).agg(F.avg("value").alias("value"), F.count("*").alias("n")).select("structure", F.to_date("w.start").alias("day"), "value", "n")
