"""The protocol over tables on disk, and its sensitivity to injected shifts.

python -m tremorlake.plans.monitor --record record.parquet --covariates weather.parquet \\
    --reference 2018-10-01 2019-04-01 --holdout 2019-04-01 2019-05-15 --changed 2019-09-28 2020-01-16
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from . import protocol, reports

SHIFTS = (-0.001, -0.002, -0.005, -0.01, -0.02)


def sensitivity(record: DataFrame, covariates: DataFrame, p: protocol.Protocol, modes: list, arms: list[str] | None = None, shifts: tuple[float, ...] = SHIFTS) -> DataFrame:
    """``arm, scenario, detectable_shift``: every mode alone and all together lose a share of their frequency in the holdout."""
    scenarios = {**{f"mode {m}": [m] for m in modes}, "all modes": list(modes)}
    return protocol.detectable_shift(protocol.swept_rates(record, covariates, p, list(modes), scenarios, list(shifts), arms), ["arm", "scenario"])


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--record", required=True, help="Parquet with ts, mode, freq_hz")
    a.add_argument("--covariates", required=True, help="Parquet with ts, temperature_c and others")
    for name in ("reference", "holdout", "changed"):
        a.add_argument(f"--{name}", nargs=2, required=True, metavar=("START", "END"))
    a.add_argument("--alpha", type=float, default=0.01)
    a.add_argument("--calibration", default="leave_one_day_out")
    a.add_argument("--environment", nargs="*", default=[])
    a.add_argument("--modes", nargs="*", type=int)
    a.add_argument("--arms", nargs="*")
    a.add_argument("--sensitivity", action="store_true")
    a.add_argument("--json-out")
    args = a.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    record, covariates = (reports.found(spark, path, "name a Parquet table") for path in (args.record, args.covariates))
    if record is None or covariates is None:
        return reports.NO_DATA
    p = protocol.Protocol(tuple(args.reference), tuple(args.holdout), tuple(args.changed), args.alpha, args.calibration, None, args.environment)
    out = protocol.run_protocol(record, covariates, p, args.modes, args.arms)
    print(reports.protocol_markdown(out))
    if args.sensitivity:
        print(reports.markdown(sensitivity(record, covariates, p, out["modes"], args.arms).orderBy("arm", "scenario")))
    return reports.finish(out, args.json_out)


if __name__ == "__main__":
    raise SystemExit(main())
