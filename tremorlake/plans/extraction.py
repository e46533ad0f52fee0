"""Hourly spectra, tracked modes and environment from archived records: two passes over the same source.

python -m tremorlake.plans.extraction --extract --archive all.zip --members weeks.zip --config archive.json --fdd tables
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import record_time
from ..functions.staged import written
from ..operators import modal, statistics
from ..sources import damaged_zip, texts
from . import protocol, reports

#: A record with fewer segments than this is listed, not used.
MIN_SEGMENTS = 8


def extract(files: DataFrame, config: dict, sampling_hz: float, reference: tuple[str, str]) -> dict[str, DataFrame]:
    """From ``files(name, file, content)``: ``spectra``, ``environment``, ``channels`` in use and ``incomplete`` records.

    The first pass takes each channel's deviation per record and keeps the channels that are stable over
    the reference months; the second takes the singular-value spectra of the kept channels.
    """
    channels = list(config["channels"])
    samples = texts.accelerations(files, channels).withColumnRenamed("name", "record")
    length = samples.groupBy("record").agg(F.count("*").alias("n"))
    enough = length.where(F.col("n") >= MIN_SEGMENTS * modal.FDD_LENGTH).select("record")
    incomplete = files.select(F.col("name").alias("record")).distinct().join(enough, "record", "left_anti")
    whole = samples.join(enough, "record", "left_semi")

    ts = record_time("record", config["name_origin"])
    rms = written(modal.channel_rms(whole).withColumn("ts", ts))  # a row per record and channel, read in several rounds
    inside = rms.where((F.col("ts") >= F.lit(reference[0]).cast("timestamp")) & (F.col("ts") < F.lit(reference[1]).cast("timestamp")))
    kept = [r[0] for r in statistics.stable_channels(inside).select("channel").orderBy("channel").collect()]  # a handful of sensors
    narrow = whole.select("record", "idx", F.array(*[F.col("channels")[i] for i in kept]).alias("channels"))
    readings = texts.environment(files, {k: tuple(v) for k, v in config["voltage_conversions"].items()})
    return {
        "spectra": written(modal.fdd(narrow, sampling_hz).withColumn("ts", ts)),
        "environment": readings.withColumn("ts", record_time("name", config["name_origin"])),
        "channels": files.sparkSession.createDataFrame([(channels[i],) for i in kept], "channel string"),
        "incomplete": incomplete,
    }


def tracked_record(spectra: DataFrame, environment: DataFrame, deck: list[str], reference: tuple[str, str], unfrozen_c: float = 5.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``record(ts, mode, freq_hz)``, ``covariates(ts, temperature_c)`` and the reference modes.

    The modes come from reference hours with a warm deck, and are tracked by shape through all hours.
    """
    temperature = texts.plausible_median(environment.withColumn("name", F.col("ts").cast("string")), deck).select(F.col("name").cast("timestamp").alias("ts"), F.col("value").alias("temperature_c"))
    warm = temperature.where((F.col("temperature_c") > unfrozen_c) & (F.col("ts") >= F.lit(reference[0]).cast("timestamp")) & (F.col("ts") < F.lit(reference[1]).cast("timestamp")))
    modes = modal.reference_modes(spectra.join(warm.select("ts"), "ts", "left_semi"))
    record = modal.track_modes(spectra, modes, ["ts"]).select("ts", "mode", "freq_hz", "similarity")
    return record, temperature, modes


#: Segments and warm-deck months of the long record.
REFERENCE, HOLDOUT, CHANGED = ("1997-11-10", "1998-07-01"), ("1998-07-01", "1998-08-04"), ("1998-08-12", "1998-09-11")
TABLES = ("spectra", "environment", "channels", "incomplete", "damaged")
#: Weather readings that the environment arm takes besides the pavement's temperature.
WEATHER = ("air_temperature", "humidity", "wind_speed")


def extract_archive(spark: SparkSession, archive: str, members: list[str], config: dict, sampling_hz: float, reference: tuple[str, str], out: str) -> None:
    """Every table of ``extract`` as Parquet below ``out``, and the names of the records that the archive holds damaged."""
    records = damaged_zip.read_records(spark, archive, members)
    records.write.mode("overwrite").parquet(f"{out}/records")  # both passes read it
    records = spark.read.parquet(f"{out}/records")
    tables = extract(damaged_zip.unzipped(records), config, sampling_hz, reference)
    tables["damaged"] = records.where(~F.col("crc_ok")).select(F.col("name").alias("record"))
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{out}/{name}")


def weather(readings: DataFrame, config: dict) -> DataFrame:
    """``ts, pavement_c, air_temperature, humidity, wind_speed`` per hour; null where a reading is missing."""
    single = [F.max(F.when(F.col("label") == config[w], F.col("value"))).alias(w) for w in WEATHER]
    pavement = texts.plausible_median(readings.withColumn("name", F.col("ts").cast("string")), list(config["pavement_temperatures"]))
    pavement = pavement.select(F.col("name").cast("timestamp").alias("ts"), F.col("value").alias("pavement_c"))
    return pavement.join(readings.groupBy("ts").agg(*single), "ts")


def run_study(tables: dict[str, DataFrame], config: dict, p: protocol.Protocol, modes: list[int] | None = None, only: list[str] | None = None) -> dict:
    """The protocol over the tracked modes, with the reference modes, their tracked shares and the records that are missing."""
    record, covariates, found = tracked_record(tables["spectra"], tables["environment"], list(config["deck_temperatures"]), p.reference)
    if p.environment:
        covariates = covariates.join(weather(tables["environment"], config), "ts")
    table = found.orderBy("mode").select("mode", "freq_hz").collect()  # five at most
    known = [r["mode"] for r in table]
    result = protocol.run_protocol(record.dropna(subset=["freq_hz"]), covariates, p, known if modes is None else modes, only)
    shares = modal.tracked_share(record)
    return result | {"reference_modes_hz": [r["freq_hz"] for r in table], "tracked_share": shares, **{k: tables[k] for k in ("damaged", "incomplete", "channels")}}


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--archive", help="the zip archive of records")
    a.add_argument("--members", nargs="*", default=[], help="archives inside the archive; without any, its own members are the records")
    a.add_argument("--fdd", required=True, help="folder of the extracted tables")
    a.add_argument("--config", required=True, help="JSON description of the archive")
    a.add_argument("--extract", action="store_true", help="make the tables first")
    a.add_argument("--sampling-hz", type=float, default=100.0)
    for name, default in (("reference", REFERENCE), ("holdout", HOLDOUT), ("changed", CHANGED)):
        a.add_argument(f"--{name}", nargs=2, default=default, metavar=("START", "END"))
    a.add_argument("--alpha", type=float, default=0.01)
    a.add_argument("--modes", type=int, nargs="+", help="numbers of the reference modes to monitor")
    a.add_argument("--arms", nargs="*")
    a.add_argument("--environment", action="store_true", help="add the arm of weather and pavement temperatures")
    a.add_argument("--json-out")
    args = a.parse_args(argv)
    if args.extract and not args.archive:
        a.error("--extract takes an --archive")
    try:
        config = texts.load_config(args.config)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return reports.NO_DATA
    spark = SparkSession.builder.getOrCreate()
    if args.extract:
        extract_archive(spark, args.archive, args.members, config, args.sampling_hz, tuple(args.reference), args.fdd)
    tables = {}
    for name in TABLES:
        tables[name] = reports.found(spark, f"{args.fdd}/{name}", "make it with --extract")
        if tables[name] is None:
            return reports.NO_DATA
    p = protocol.Protocol(tuple(args.reference), tuple(args.holdout), tuple(args.changed), args.alpha, environment=["pavement_c", *WEATHER] if args.environment else [])
    result = run_study(tables, config, p, args.modes, args.arms)
    print(reports.protocol_markdown(result))
    return reports.finish(result, args.json_out)


if __name__ == "__main__":
    raise SystemExit(main())
