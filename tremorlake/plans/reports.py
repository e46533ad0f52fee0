"""Reports from small result tables: Markdown and JSON."""

from __future__ import annotations

import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(table: DataFrame, digits: int = 3) -> str:
    """A result table (one row per arm, segment or label) as Markdown."""
    cell = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    rows = table.collect()
    return "\n".join(["| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def write_json(table: DataFrame, path: str) -> None:
    """A result table as a JSON file of one array."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(x) for x in table.toJSON().collect()], f, indent=2)


def protocol_markdown(result: dict) -> str:
    """One row per arm: alarms of the holdout and of the changed segment."""
    wide = result["alarms"].groupBy("arm").pivot("segment", ["holdout", "changed"]).agg(
        *[F.first(c).alias(c) for c in ("alarmed_days", "days", "delay_days", "min_p_value", "min_over_limit", "max_over_limit")]
    )
    return markdown(wide.orderBy("arm"))


#: What a study command returns when its data are missing.
NO_DATA = 2


def found(spark: SparkSession, path: str, hint: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None after a message on how to make it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        print(f"{path} is missing; {hint}", file=sys.stderr)
        return None


def rows(table: DataFrame) -> list[dict]:
    """A result table as plain values."""
    return [json.loads(x) for x in table.toJSON().collect()]


def finish(result: dict, path: str | None) -> int:
    """Write tables and values to a JSON file, where one is asked for."""
    if path:
        plain = {k: rows(v) if isinstance(v, DataFrame) else v for k, v in result.items()}
        with open(path, "w", encoding="utf-8") as f:
            json.dump(plain, f, indent=2)
    return 0
