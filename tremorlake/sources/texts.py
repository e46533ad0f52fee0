"""Measurement texts as columns: acceleration files, environment files, configurations, checksums, zipped CSVs."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col

CONFIG_FIELDS = ("channels", "name_origin", "deck_temperatures", "pavement_temperatures", "air_temperature", "humidity", "wind_speed", "voltage_conversions")
PLAUSIBLE_C = (-40.0, 60.0)


def load_config(path: str) -> dict:
    """The archive's description: channel names, the date of week 1, column labels and voltage conversions."""
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"{path} is missing: write one with the fields {', '.join(CONFIG_FIELDS)}")
    config = json.loads(file.read_text(encoding="utf-8"))
    absent = [f for f in CONFIG_FIELDS if f not in config]
    if absent:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    return config


def acceleration_samples(content: str | Column) -> Column:
    """The samples of an acceleration text: line 2 has their number, they start on line 4."""
    lines = F.split(col(content), "\n")
    return F.transform(F.slice(lines, F.lit(4), F.coalesce(F.trim(F.get(lines, F.lit(1))).try_cast("int"), F.lit(0))), lambda x: F.trim(x).try_cast("double"))


def accelerations(files: DataFrame, channels: list[str]) -> DataFrame:
    """``name, idx, channels``: per record the channels' samples side by side, cut to the shortest; records that lack a channel go."""
    wanted = F.lower(F.concat("name", "channel", F.lit(".aaa")))
    want = files.select("name").distinct().select("name", F.posexplode(F.array(*[F.lit(c) for c in channels])).alias("k", "channel"))
    have = files.select("name", F.lower("file").alias("_file"), acceleration_samples("content").alias("x"))
    got = want.withColumn("_file", wanted).join(have, ["name", "_file"]).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("all"))
    whole = got.where(F.size("all") == len(channels)).select("name", F.transform("all", lambda c: c["x"]).alias("all"))
    return whole.select("name", F.posexplode(F.arrays_zip(*[F.slice(F.col("all")[i], 1, F.array_min(F.transform("all", F.size))) for i in range(len(channels))])).alias("idx", "v")).select("name", "idx", F.array(*[F.col("v").getField(str(i)) for i in range(len(channels))]).alias("channels"))


def environment(files: DataFrame, conversions: dict[str, tuple[float, float]]) -> DataFrame:
    """``name, label, value``: the mean of each label's scans, converted.

    The first non-blank line names the labels between bracketed units; scans follow until a line that
    isn't all numbers; ragged scans are cut to the shortest; the first of equal labels counts.
    """
    lines = F.filter(F.transform(F.split("content", "\r?\n"), F.trim), lambda x: x != "")
    labels = F.filter(F.split(F.get(lines, F.lit(0)), r"\s+"), lambda x: ~x.startswith("["))
    rows = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda line: F.transform(F.split(line, r"\s+"), lambda x: x.try_cast("double")))
    env = files.where(F.lower("file") == F.lower(F.concat("name", F.lit("pre.env")))).select("name", labels.alias("labels"), rows.alias("rows"))
    bad = F.array_position(F.transform("rows", lambda row: F.exists(row, lambda x: x.isNull())), True)
    env = env.withColumn("rows", F.when(bad > 0, F.slice("rows", F.lit(1), (bad - 1).cast("int"))).otherwise(F.col("rows"))).where(F.size("rows") > 0)
    width = F.array_min(F.transform("rows", F.size))
    flat = env.select("name", "rows", width.alias("w"), F.posexplode("labels").alias("k", "label")).where("k < w")
    mean = F.aggregate(F.transform("rows", lambda row: F.get(row, F.col("k"))), F.lit(0.0), lambda a, x: a + x) / F.size("rows")
    first = flat.groupBy("name", "label").agg(F.min_by(mean, "k").alias("raw"))
    if not conversions:
        return first.withColumnRenamed("raw", "value")
    table = files.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in conversions.items()], "label string, scale double, offset double")
    return first.join(F.broadcast(table), "label", "left").select("name", "label", (F.col("raw") * F.coalesce("scale", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0))).alias("value"))


def plausible_median(readings: DataFrame, labels: list[str]) -> DataFrame:
    """``name, value``: the median of the labels' values strictly inside the plausible range; null without one."""
    good = F.col("label").isin(labels) & (F.col("value") > PLAUSIBLE_C[0]) & (F.col("value") < PLAUSIBLE_C[1])
    return readings.groupBy("name").agg(F.median(F.when(good, F.col("value"))).alias("value"))


def verified(files: DataFrame, digests: DataFrame, algorithm: str = "md5") -> DataFrame:
    """``binaryFile`` rows whose digest is the expected one of ``digests(name, digest)``; any other fails the job and is named."""
    name = F.element_at(F.split("path", "/"), -1)
    digest = F.md5("content") if algorithm == "md5" else F.sha2("content", 256)
    joined = files.withColumn("name", name).join(F.broadcast(digests), "name", "left")
    wrong = F.raise_error(F.concat(F.col("name"), F.lit(": the checksum differs")))
    return joined.withColumn("content", F.when(digest == F.col("digest"), F.col("content")).otherwise(wrong)).drop("digest")


def verified_samples(recordings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of ``recordings(recording, sensor, samples)`` whose SHA-256 over the samples' little-endian doubles is the manifest's."""
    @F.pandas_udf("string")
    def digest(samples: pd.Series) -> pd.Series:
        import hashlib

        import numpy as np

        return samples.map(lambda x: hashlib.sha256(np.asarray(x, "<f8").tobytes()).hexdigest())

    joined = recordings.join(manifest, ["recording", "sensor"], "left")
    wrong = F.raise_error(F.concat_ws("/", "recording", "sensor", F.lit("the samples changed")))
    return joined.withColumn("samples", F.when(digest("samples") == F.col("sha256"), F.col("samples")).otherwise(wrong)).drop("sha256")


def zipped_csvs(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``file, idx, <columns as doubles>``: the CSV members of a zip by name, only the named columns."""
    kinds = ", ".join(f"`{c}` double" for c in columns)
    names = list(columns)

    def run(batches):
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(m for m in z.namelist() if m.endswith(".csv")):
                        part = pd.read_csv(io.BytesIO(z.read(member)), usecols=names)[names].astype(float)
                        part.insert(0, "idx", range(len(part)))
                        part.insert(0, "file", member)
                        yield part

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"file string, idx bigint, {kinds}")
