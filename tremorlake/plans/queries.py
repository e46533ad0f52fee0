"""Registered queries over the driver's tables, each with the SQL that checks it where SQL can express it.

``lineitem`` stands in for a long daily record (rows of a day are its hours), ``events`` for an hourly
sensor stream with gaps, ``embeddings`` for labelled state samples, ``supplier`` and ``nation`` for tables
of modes and models.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.staged import by_key, settled, written
from ..operators import calibration, detectors, events, modal, physical, segments, spectral, statistics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SEGMENTS = {"reference": ("1995-01-01", "1999-01-01"), "holdout": ("1999-01-01", "2001-01-01"), "changed": ("2001-01-01", "2002-01-01")}
ALPHA, THRESHOLD = 0.01, 5.0
#: Keys repeat in ``lineitem``; rows that agree in all of these are alike.
ROW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 6):
    return F.round(C.col(c), digits)


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, dates as text: what the oracles compare."""
    return df.select(*[r(n, other.get(n, digits)).alias(n) if t == "double" else F.col(n).cast("string").alias(n) if t == "date" else F.col(n) for n, t in df.dtypes])


# --- daily record -----------------------------------------------------------------------------------


def daily_scores(spark: SparkSession, sf_dir: str, min_hours: int = statistics.MIN_HOURS) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("score"))
    return statistics.daily_medians(rows, min_hours=min_hours)


def daily_p(spark: SparkSession, sf_dir: str, min_hours: int = statistics.MIN_HOURS) -> DataFrame:
    daily = settled(daily_scores(spark, sf_dir, min_hours))  # a row a day, which the ranks read three times
    return calibration.conformal_p(daily.withColumn("is_ref", segments.in_segment_days("day", *SEGMENTS["reference"])))


DAILY_SQL = """daily AS (
  SELECT CAST(l_shipdate AS DATE) AS day, median(l_extendedprice) AS score, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 6
), ranked AS (
  SELECT day, score, n, (1.0 + sum(CASE WHEN day < DATE '1999-01-01' THEN 1 ELSE 0 END) OVER (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
         / (1.0 + sum(CASE WHEN day < DATE '1999-01-01' THEN 1 ELSE 0 END) OVER ()) AS p_value FROM daily
), lim AS (
  SELECT count(*) AS n_ref, list(score ORDER BY score) AS s FROM daily WHERE day < DATE '1999-01-01'
), control AS (
  SELECT n_ref, s[CAST(ceil((n_ref + 1) * 0.99 - 1e-9) AS BIGINT)] AS control_limit FROM lim
), seg AS (
  SELECT * FROM (VALUES ('reference', DATE '1995-01-01', DATE '1999-01-01'), ('holdout', DATE '1999-01-01', DATE '2001-01-01'), ('changed', DATE '2001-01-01', DATE '2002-01-01')) t(segment, a, b)
)"""


@query("SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, round(median(l_extendedprice), 6) AS score, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 6")
def daily_median(spark, sf_dir):
    return rounded(daily_scores(spark, sf_dir))


@query(f"WITH {DAILY_SQL} SELECT CAST(day AS VARCHAR) AS day, round(score, 6) AS score, round(CAST(p_value AS DOUBLE), 9) AS p_value FROM ranked")
def conformal_p(spark, sf_dir):
    return rounded(daily_p(spark, sf_dir).select("day", "score", "p_value"), p_value=9)


@query(f"WITH {DAILY_SQL} SELECT CAST(n_ref AS BIGINT) AS n_ref, round(control_limit, 6) AS control_limit FROM control")
def conformal_limit(spark, sf_dir):
    daily = daily_scores(spark, sf_dir).where(segments.in_segment_days("day", *SEGMENTS["reference"]))
    return rounded(calibration.conformal_limits(daily, ALPHA))


def with_limit(spark, sf_dir):
    daily = settled(daily_p(spark, sf_dir))
    return daily.crossJoin(F.broadcast(calibration.conformal_limits(daily.where("is_ref"), ALPHA)))


@query(f"""WITH {DAILY_SQL}
SELECT segment, count(*) AS days, CAST(sum(CASE WHEN p_value <= 0.010000000001 THEN 1 ELSE 0 END) AS BIGINT) AS alarmed_days,
       CAST(min(CASE WHEN p_value <= 0.010000000001 THEN day END) AS VARCHAR) AS first_alarm,
       CAST(min(CASE WHEN p_value <= 0.010000000001 THEN day END) - min(a) AS BIGINT) AS delay_days,
       round(CAST(min(p_value) AS DOUBLE), 6) AS min_p_value, round(min(score / control_limit), 6) AS min_over_limit, round(max(score / control_limit), 6) AS max_over_limit,
       round(CAST(sum(CASE WHEN p_value <= 0.010000000001 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS alarm_rate
FROM ranked JOIN seg ON day >= a AND day < b CROSS JOIN control GROUP BY segment""")
def alarm_summary(spark, sf_dir):
    return rounded(calibration.alarm_summary(with_limit(spark, sf_dir), ALPHA, SEGMENTS))


CUSUM_SQL = f"""{DAILY_SQL}, steps AS (
  SELECT segment, a, day, sum(-ln(p_value) - 1.5) OVER (PARTITION BY segment ORDER BY day) AS s FROM ranked JOIN seg ON day >= a AND day < b WHERE segment <> 'reference'
), path AS (
  SELECT segment, a, day, s - least(0, min(s) OVER (PARTITION BY segment ORDER BY day)) AS level FROM steps
)"""


@query(f"WITH {CUSUM_SQL} SELECT CAST(day AS VARCHAR) AS day, round(level, 6) AS level FROM path WHERE segment = 'holdout'")
def cusum_path(spark, sf_dir):
    daily = daily_p(spark, sf_dir).where(segments.in_segment_days("day", *SEGMENTS["holdout"]))
    return rounded(calibration.cusum_path(daily).select("day", "level"))


@query(f"""WITH {CUSUM_SQL}, f AS (SELECT segment, min(a) AS a, min(CASE WHEN level >= 5 THEN day END) AS first_alarm, max(level) AS top FROM path GROUP BY segment)
SELECT f.segment, CAST(first_alarm AS VARCHAR) AS first_alarm, CAST(first_alarm - f.a AS BIGINT) AS delay_days, round(coalesce(p.level, top), 6) AS peak
FROM f LEFT JOIN path p ON p.segment = f.segment AND p.day = f.first_alarm""")
def cusum_first_alarm(spark, sf_dir):
    return rounded(calibration.cusum_first_alarm(daily_p(spark, sf_dir), {k: SEGMENTS[k] for k in ("holdout", "changed")}, THRESHOLD))


@query("""SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax, count(*) AS n
FROM lineitem GROUP BY 1 HAVING count(*) >= 6""")
def daily_mean_vectors(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("ts", F.col("l_shipdate"))
    return rounded(statistics.daily_means(rows, ["l_quantity", "l_discount", "l_tax"]))


@query("""SELECT CASE WHEN l_shipdate < DATE '1999-01-01' THEN 'reference' WHEN l_shipdate < DATE '2001-01-01' THEN 'holdout' ELSE 'changed' END AS segment,
count(*) AS rows, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '2002-01-01' GROUP BY 1""")
def segment_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("segment", segments.segment_of(F.to_date("l_shipdate"), SEGMENTS)).where("segment is not null")
    return rows.groupBy("segment").agg(F.count("*").alias("rows"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


# --- regression -------------------------------------------------------------------------------------


def bilinear_rows(spark, sf_dir):
    t = F.col("l_quantity") - 25
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", t.alias("t"), C.below_hinge(t).alias("below"))


@query("SELECT l_orderkey, l_linenumber, l_quantity - 25 AS t, least(l_quantity - 25, 0) AS below FROM lineitem")
def bilinear_features(spark, sf_dir):
    return bilinear_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", "t", "below")


OLS_SQL = """b AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity - 25 AS t, least(l_quantity - 25, 0) AS h FROM lineitem),
m AS (SELECT avg(t) AS mt, avg(h) AS mh, avg(y) AS my, covar_pop(t, t) AS tt, covar_pop(h, h) AS hh, covar_pop(t, h) AS th, covar_pop(t, y) AS ty, covar_pop(h, y) AS hy FROM b),
k AS (SELECT *, (ty * hh - hy * th) / (tt * hh - th * th) AS bt, (hy * tt - ty * th) / (tt * hh - th * th) AS bh FROM m)"""


@query(f"WITH {OLS_SQL} SELECT round(my, 4) AS level, round(bt, 6) AS slope_t, round(bh, 6) AS slope_below FROM k")
def ols_baseline(spark, sf_dir):
    b = statistics.fit_linear(bilinear_rows(spark, sf_dir), ["t", "below"], ["l_extendedprice"])
    return spark.createDataFrame([(round(float(b.level[0]), 4), round(float(b.slopes[0][0]), 6), round(float(b.slopes[0][1]), 6))], "level double, slope_t double, slope_below double")


@query(f"WITH {OLS_SQL} SELECT l_orderkey, l_linenumber, round(y - (my + bt * (t - mt) + bh * (h - mh)), 2) AS residual FROM b CROSS JOIN k")
def ols_residuals(spark, sf_dir):
    rows = bilinear_rows(spark, sf_dir)
    b = statistics.fit_linear(rows, ["t", "below"], ["l_extendedprice"])
    return b.residuals(rows).select("l_orderkey", "l_linenumber", r("l_extendedprice", 2).alias("residual"))


@query(f"WITH {OLS_SQL} SELECT round(my, 4) AS reference_hz, round(bt / my, 9) AS per_k_above, round((bt + bh) / my, 9) AS per_k_below, bt / my < 0 AS sign_ok, round(bt / my / -1.5e-4, 5) AS ratio_to_material FROM k")
def temperature_sensitivity(spark, sf_dir):
    b = statistics.fit_linear(bilinear_rows(spark, sf_dir), ["t", "below"], ["l_extendedprice"])
    return rounded(statistics.sensitivity(b, spark, -1.5e-4).drop("target"), 9, reference_hz=4, ratio_to_material=5)


@query("""WITH g AS (SELECT CAST(floor(CAST(l_quantity AS DOUBLE) / 0.5) AS BIGINT) AS bin, l_quantity AS t, l_extendedprice AS y FROM lineitem)
SELECT bin, count(*) AS n, round(avg(t), 6) AS temperature, round(avg(y), 4) AS mean_l_extendedprice, round(var_pop(y) * count(*) / 1e6, 3) AS ss FROM g GROUP BY bin""")
def gp_bins(spark, sf_dir):
    out = detectors.gp_bins(read(spark, sf_dir, "lineitem"), "l_quantity", ["l_extendedprice"])
    return out.select("bin", "n", r("temperature").alias("temperature"), r("mean_l_extendedprice", 4).alias("mean_l_extendedprice"), r(F.col("ss_l_extendedprice") / 1e6, 3).alias("ss"))


@query()
def gp_baseline(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return detectors.GaussianProcessBaseline.fit(rows, "l_quantity", ["l_extendedprice"]).residuals(rows).select("l_orderkey", "l_linenumber", r("l_extendedprice", 2).alias("residual"))


# --- hourly stream ----------------------------------------------------------------------------------


def hourly(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("ts"), F.col("event_type").alias("mode")).agg(F.avg("value").alias("freq_hz"))


HOURLY_SQL = "h AS (SELECT date_trunc('hour', ts) AS ts, event_type AS mode, avg(value) AS freq FROM events GROUP BY 1, 2)"


@query(f"""WITH {HOURLY_SQL}, n AS (SELECT count(DISTINCT ts) AS hours FROM h)
SELECT mode, round(1 - count(*) / CAST(max(hours) AS DOUBLE), 6) AS missing_share FROM h CROSS JOIN n GROUP BY mode HAVING 1 - count(*) / CAST(max(hours) AS DOUBLE) <= 0.06""")
def mode_selection(spark, sf_dir):
    record = hourly(spark, sf_dir)
    return rounded(segments.select_modes(record, record.select("ts"), 0.06))


@query(f"""WITH {HOURLY_SQL}, c AS (SELECT ts FROM h GROUP BY ts HAVING count(*) = 5)
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS complete_hours FROM c GROUP BY 1""")
def complete_hours(spark, sf_dir):
    record = hourly(spark, sf_dir)
    kinds = [x[0] for x in record.select("mode").distinct().orderBy("mode").collect()]  # the modes of a record
    return rounded(segments.complete_hours(record, kinds).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("complete_hours")))


@query(f"""WITH {HOURLY_SQL}, s AS (SELECT mode, freq, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) = 3600 THEN freq - lag(freq) OVER w END AS step FROM h WINDOW w AS (PARTITION BY mode ORDER BY ts))
SELECT mode, count(step) AS pairs, round(sqrt(avg(step * step) / 2), 6) AS noise_sigma, round(stddev_pop(freq), 6) AS total_sigma, round(least(avg(step * step) / 2 / var_pop(freq), 1), 6) AS noise_share FROM s GROUP BY mode""")
def noise_split(spark, sf_dir):
    return rounded(statistics.noise_split(hourly(spark, sf_dir), ["mode"], "freq_hz"))


@query(f"""WITH {HOURLY_SQL}, p AS (SELECT mode, median(CASE WHEN ts < (SELECT min(ts) + INTERVAL 15 DAY FROM h) THEN freq END) AS a, median(CASE WHEN ts >= (SELECT min(ts) + INTERVAL 15 DAY FROM h) THEN freq END) AS b FROM h GROUP BY mode),
s AS (SELECT (b - a) / a AS shift FROM p)
SELECT min(shift) > 0 OR max(shift) < 0 AS same_sign, round(max(shift) - min(shift), 6) AS spread, round(avg(abs(shift)), 6) AS mean_abs_shift,
CASE WHEN (min(shift) > 0 OR max(shift) < 0) AND max(shift) - min(shift) <= 0.5 * avg(abs(shift)) THEN 'global' ELSE 'local' END AS pattern FROM s""")
def frequency_ratio(spark, sf_dir):
    return rounded(statistics.frequency_ratio(halves(spark, sf_dir)))


def halves(spark, sf_dir):
    record = hourly(spark, sf_dir)
    cut = record.agg((F.min("ts") + F.expr("INTERVAL 15 DAYS")).alias("_cut"))
    split = record.crossJoin(F.broadcast(cut)).withColumn("_half", F.when(F.col("ts") < F.col("_cut"), 0).otherwise(1))
    return statistics.medians(split, ["mode", "_half"], "freq_hz").groupBy("mode").agg(*[F.max(F.when(F.col("_half") == i, F.col("median"))).alias(n) for i, n in enumerate(("reference_hz", "changed_hz"))])


@query(f"""WITH {HOURLY_SQL}, p AS (SELECT mode, median(CASE WHEN ts < (SELECT min(ts) + INTERVAL 15 DAY FROM h) THEN freq END) AS a, median(CASE WHEN ts >= (SELECT min(ts) + INTERVAL 15 DAY FROM h) THEN freq END) AS b FROM h GROUP BY mode),
f AS (SELECT min_by(a, mode) AS fa, min_by(b, mode) AS fb FROM p)
SELECT mode, round((b - a) / a, 6) AS relative_shift, round((b / fb) / (a / fa) - 1, 6) AS ratio_change FROM p CROSS JOIN f""")
def ratio_changes(spark, sf_dir):
    return rounded(statistics.ratio_changes(halves(spark, sf_dir)))


@query()
def cointegration(spark, sf_dir):
    record = hourly(spark, sf_dir)
    kinds = [x[0] for x in record.select("mode").distinct().orderBy("mode").collect()]
    wide = segments.complete_hours(record, kinds)
    features = [f"m{k}" for k in kinds]
    return rounded(detectors.Cointegration.fit(wide, features).score(wide).select(F.col("ts").cast("string").alias("ts"), "score"))


PAIR_OF_MODES_SQL = f"""{HOURLY_SQL}, k AS (SELECT mode, row_number() OVER (ORDER BY mode) AS k FROM (SELECT DISTINCT mode FROM h)),
w AS (SELECT ts, max(CASE WHEN k = 1 THEN freq END) AS x, max(CASE WHEN k = 2 THEN freq END) AS y FROM h JOIN k USING (mode) WHERE k <= 2 GROUP BY ts HAVING count(*) = 2),
j AS (SELECT a.x, a.y, b.x AS px, b.y AS py, a.x - b.x AS dx, a.y - b.y AS dy FROM w a JOIN w b ON epoch(a.ts) = epoch(b.ts) + 3600),
m AS (SELECT var_pop(dx) AS d11, covar_pop(dx, dy) AS d12, var_pop(dy) AS d22, covar_pop(dx, px) AS c11, covar_pop(dx, py) AS c12, covar_pop(dy, px) AS c21, covar_pop(dy, py) AS c22, var_pop(px) AS p11, covar_pop(px, py) AS p12, var_pop(py) AS p22 FROM j),
a AS (SELECT *, (d22 * c11 - d12 * c21) / (d11 * d22 - d12 * d12) AS a11, (d22 * c12 - d12 * c22) / (d11 * d22 - d12 * d12) AS a12, (d11 * c21 - d12 * c11) / (d11 * d22 - d12 * d12) AS a21, (d11 * c22 - d12 * c12) / (d11 * d22 - d12 * d12) AS a22 FROM m),
b AS (SELECT *, c11 * a11 + c21 * a21 AS b11, c11 * a12 + c21 * a22 AS b12, c12 * a11 + c22 * a21 AS b21, c12 * a12 + c22 * a22 AS b22 FROM a),
e AS (SELECT (p22 * b11 - p12 * b21) / (p11 * p22 - p12 * p12) AS e11, (p22 * b12 - p12 * b22) / (p11 * p22 - p12 * p12) AS e12, (p11 * b21 - p12 * b11) / (p11 * p22 - p12 * p12) AS e21, (p11 * b22 - p12 * b12) / (p11 * p22 - p12 * p12) AS e22 FROM b),
v AS (SELECT e12 AS v1, (e11 + e22) / 2 + sqrt(pow((e11 - e22) / 2, 2) + e12 * e21) - e11 AS v2 FROM e),
s AS (SELECT avg(v1 * x + v2 * y) AS mean, stddev_pop(v1 * x + v2 * y) AS sd FROM j CROSS JOIN v)"""


@query(f"WITH {PAIR_OF_MODES_SQL} SELECT CAST(ts AS VARCHAR) AS ts, round(abs(v1 * x + v2 * y - mean) / sd, 5) AS score FROM w CROSS JOIN v CROSS JOIN s")
def cointegration_pair(spark, sf_dir):
    """The most mean-reverting combination of the first two modes, by the closed form of its eigenvalue."""
    record = hourly(spark, sf_dir)
    kinds = [x[0] for x in record.select("mode").distinct().orderBy("mode").limit(2).collect()]
    wide = segments.complete_hours(record.where(F.col("mode").isin(kinds)), kinds)
    return rounded(detectors.Cointegration.fit(wide, [f"m{k}" for k in kinds]).score(wide).select(F.col("ts").cast("string").alias("ts"), "score"), 5)


def protocol_tables(spark, sf_dir):
    """A record of one mode (hourly means) and its covariates (the mean minute as temperature)."""
    hours = read(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("freq_hz"), (F.avg(F.minute("ts")) - 30).alias("temperature_c"))
    return hours.select("ts", F.lit(0).alias("mode"), "freq_hz"), hours.select("ts", "temperature_c")


PROTOCOL_SEGMENTS = {"reference": ("2024-01-01", "2024-01-16"), "holdout": ("2024-01-16", "2024-01-23"), "changed": ("2024-01-23", "2024-01-31")}
#: Fits of all reference hours less a day's from sums; the two arms' scores of each hour, daily medians, ranks and alarms.
PROTOCOL_SQL = """hr AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS y, avg(minute(ts)) - 30 AS t FROM events GROUP BY 1),
b AS (SELECT CAST(ts AS DATE) AS day, y, t, least(t, 0) AS h, ts < TIMESTAMP '2024-01-16' AS ref FROM hr),
byday AS (SELECT day, count(*) AS n, sum(y) AS sy, sum(t) AS st, sum(h) AS sh, sum(y*y) AS yy, sum(t*t) AS tt, sum(h*h) AS hh, sum(t*h) AS th, sum(t*y) AS ty, sum(h*y) AS hy FROM b WHERE ref GROUP BY day),
whole AS (SELECT sum(n) AS n, sum(sy) AS sy, sum(st) AS st, sum(sh) AS sh, sum(yy) AS yy, sum(tt) AS tt, sum(hh) AS hh, sum(th) AS th, sum(ty) AS ty, sum(hy) AS hy FROM byday),
f AS (SELECT byday.day, whole.n - byday.n AS n, whole.sy - byday.sy AS sy, whole.st - byday.st AS st, whole.sh - byday.sh AS sh, whole.yy - byday.yy AS yy, whole.tt - byday.tt AS tt, whole.hh - byday.hh AS hh, whole.th - byday.th AS th, whole.ty - byday.ty AS ty, whole.hy - byday.hy AS hy FROM byday CROSS JOIN whole UNION ALL SELECT NULL, whole.n, whole.sy, whole.st, whole.sh, whole.yy, whole.tt, whole.hh, whole.th, whole.ty, whole.hy FROM whole),
c AS (SELECT day, sy / n AS my, st / n AS mt, sh / n AS mh, yy / n - sy * sy / n / n AS cyy, tt / n - st * st / n / n AS ctt, hh / n - sh * sh / n / n AS chh, th / n - st * sh / n / n AS cth, ty / n - st * sy / n / n AS cty, hy / n - sh * sy / n / n AS chy FROM f),
k AS (SELECT *, (cty * chh - chy * cth) / (ctt * chh - cth * cth) AS bt, (chy * ctt - cty * cth) / (ctt * chh - cth * cth) AS bh FROM c),
s AS (SELECT b.day, b.ref, abs(y - my) / sqrt(cyy) AS raw, abs(y - my - bt * (t - mt) - bh * (h - mh)) / sqrt(cyy - bt * cty - bh * chy) AS lin FROM b JOIN k ON k.day IS NOT DISTINCT FROM CASE WHEN ref THEN b.day END),
d AS (SELECT arm, day, ref, median(score) AS score FROM (SELECT day, ref, 'raw_frequencies' AS arm, raw AS score FROM s UNION ALL SELECT day, ref, 'temperature_normalized', lin FROM s) GROUP BY 1, 2, 3 HAVING count(*) >= 6),
p AS (SELECT a.arm, a.day, a.score, (1.0 + count(r.day)) / (1.0 + max(n)) AS p FROM d a JOIN (SELECT arm, count(*) AS n FROM d WHERE ref GROUP BY arm) USING (arm) LEFT JOIN d r ON r.arm = a.arm AND r.ref AND r.score >= a.score GROUP BY 1, 2, 3),
lim AS (SELECT arm, list(score ORDER BY score)[CAST(ceil((count(*) + 1) * 0.9 - 1e-9) AS BIGINT)] AS control FROM d WHERE ref GROUP BY arm),
seg AS (SELECT * FROM (VALUES ('reference', DATE '2024-01-01', DATE '2024-01-16'), ('holdout', DATE '2024-01-16', DATE '2024-01-23'), ('changed', DATE '2024-01-23', DATE '2024-01-31')) v(segment, a, z))"""


@query(f"""WITH {PROTOCOL_SQL} SELECT arm, segment, count(*) AS days, CAST(sum(CASE WHEN p <= 0.100000000001 THEN 1 ELSE 0 END) AS BIGINT) AS alarmed_days, CAST(min(CASE WHEN p <= 0.100000000001 THEN day END) AS VARCHAR) AS first_alarm,
CAST(min(CASE WHEN p <= 0.100000000001 THEN day END) - min(a) AS BIGINT) AS delay_days, round(CAST(min(p) AS DOUBLE), 6) AS min_p_value, round(min(score / control), 5) AS min_over_limit, round(max(score / control), 5) AS max_over_limit,
round(CAST(sum(CASE WHEN p <= 0.100000000001 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS alarm_rate FROM p JOIN seg ON day >= a AND day < z JOIN lim USING (arm) GROUP BY 1, 2""")
def protocol_alarms(spark, sf_dir):
    """The whole protocol over hourly means of ``events`` with the mean minute as temperature: alarms of the raw and the linear arm."""
    from .protocol import Protocol, judged_days

    arms = ["raw_frequencies", "temperature_normalized"]
    out = judged_days(*protocol_tables(spark, sf_dir), Protocol(*PROTOCOL_SEGMENTS.values(), alpha=0.1), [0], arms)
    return rounded(out["alarms"].where(F.col("arm").isin(arms)), 6, min_over_limit=5, max_over_limit=5)


SWEEP_SQL = f"""{PROTOCOL_SQL}, sw AS (SELECT arm, shift, day, median(score) AS score FROM (
  SELECT unnest(['raw_frequencies', 'temperature_normalized']) AS arm, unnest([abs(y * (1 + shift) - my) / sqrt(cyy), abs(y * (1 + shift) - my - bt * (t - mt) - bh * (h - mh)) / sqrt(cyy - bt * cty - bh * chy)]) AS score, shift, b.day
  FROM b CROSS JOIN (SELECT * FROM k WHERE day IS NULL) k CROSS JOIN (SELECT unnest([-0.05, -0.2, -0.5, -0.9]) AS shift) WHERE b.day >= DATE '2024-01-16' AND b.day < DATE '2024-01-23') GROUP BY 1, 2, 3 HAVING count(*) >= 6),
q AS (SELECT sw.arm, shift, sw.day, (1.0 + count(r.day)) / (1.0 + max(n)) AS p FROM sw JOIN (SELECT arm, count(*) AS n FROM d WHERE ref GROUP BY arm) USING (arm) LEFT JOIN d r ON r.arm = sw.arm AND r.ref AND r.score >= sw.score GROUP BY 1, 2, 3),
ra AS (SELECT arm, CAST(shift AS DOUBLE) AS shift, avg(CASE WHEN p <= 0.100000000001 THEN 1.0 ELSE 0.0 END) AS alarm_rate FROM q GROUP BY 1, 2)"""


def protocol_sweep(spark, sf_dir):
    from .protocol import Protocol, swept_rates

    arms = ["raw_frequencies", "temperature_normalized"]
    rates = swept_rates(*protocol_tables(spark, sf_dir), Protocol(*PROTOCOL_SEGMENTS.values(), alpha=0.1), [0], {"all": [0]}, [-0.05, -0.2, -0.5, -0.9], arms)
    return rates.where(F.col("arm").isin(arms))


@query(f"WITH {SWEEP_SQL} SELECT arm, shift, round(CAST(alarm_rate AS DOUBLE), 6) AS alarm_rate FROM ra")
def protocol_alarm_rates(spark, sf_dir):
    """Alarm rates of the holdout at four injected drops; every arm is fitted once."""
    return rounded(protocol_sweep(spark, sf_dir).drop("scenario"))


@query(f"WITH {SWEEP_SQL} SELECT arm, min(CASE WHEN alarm_rate >= 0.5 THEN abs(shift) END) AS detectable_shift FROM ra GROUP BY arm")
def detectable_shift(spark, sf_dir):
    """The smallest drop that half of the holdout's days detect."""
    from . import protocol

    return protocol.detectable_shift(protocol_sweep(spark, sf_dir), ["arm"], 0.5)


# --- labelled states --------------------------------------------------------------------------------


def states(spark, sf_dir, dims: int):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(dims)])


LW_SQL = """e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, count(*) AS n FROM e WHERE label = 0),
q AS (SELECT sum(((a - ma) * (a - ma) + (b - mb) * (b - mb)) ** 2) AS f FROM e CROSS JOIN m WHERE label = 0),
w AS (SELECT *, (aa + bb) / 2 AS mu, ((aa - (aa + bb) / 2) ** 2 + (bb - (aa + bb) / 2) ** 2 + 2 * ab * ab) / 2 AS delta, (f / n - (aa * aa + bb * bb + 2 * ab * ab)) / (n * 2) AS beta FROM m CROSS JOIN q),
s AS (SELECT *, CASE WHEN delta = 0 THEN 0 ELSE least(1, beta / delta) END AS k FROM w),
c AS (SELECT *, k * mu + (1 - k) * aa AS caa, k * mu + (1 - k) * bb AS cbb, (1 - k) * ab AS cab FROM s)"""


@query(f"WITH {LW_SQL} SELECT round(caa, 6) AS c00, round(cab, 6) AS c01, round(cbb, 6) AS c11 FROM c")
def ledoit_wolf_2d(spark, sf_dir):
    from ..functions.dense import shrunk_covariance

    m = statistics.moments(states(spark, sf_dir, 2).where("label = 0"), ["x0", "x1"])
    c = shrunk_covariance(m.n, m.covariance, m.fourth)
    return spark.createDataFrame([tuple(round(float(x), 6) for x in (c[0, 0], c[0, 1], c[1, 1]))], "c00 double, c01 double, c11 double")


@query(f"WITH {LW_SQL} SELECT vec_id, round(sqrt((cbb * (a - ma) ** 2 - 2 * cab * (a - ma) * (b - mb) + caa * (b - mb) ** 2) / (caa * cbb - cab * cab)), 6) AS score FROM e CROSS JOIN (SELECT ma AS ma, mb AS mb, caa, cbb, cab FROM c) c")
def mahalanobis_2d(spark, sf_dir):
    rows = states(spark, sf_dir, 2)
    return rounded(detectors.Mahalanobis.fit(rows.where("label = 0"), ["x0", "x1"]).score(rows).select("vec_id", "score"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, b) AS ab FROM e WHERE label = 0)
SELECT vec_id, round(abs((a - ma) / sa - CASE WHEN ab > 0 THEN 1 ELSE -1 END * (b - mb) / sb) / sqrt(2), 6) AS score FROM e CROSS JOIN m""")
def pca_residual(spark, sf_dir):
    rows = states(spark, sf_dir, 2)
    return rounded(detectors.PcaResidual.fit(rows.where("label = 0"), ["x0", "x1"]).score(rows).select("vec_id", "score"))


@query()
def pca_residual_8d(spark, sf_dir):
    rows = states(spark, sf_dir, 8)
    return rounded(detectors.PcaResidual.fit(rows.where("label = 0"), [f"x{i}" for i in range(8)]).score(rows).select("vec_id", "score"))


#: Places of the vectors in ``embeddings``.
DIMENSIONS = 64
UNPIVOT_SQL = "u AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS i))"


@query(f"""WITH {UNPIVOT_SQL}, m AS (SELECT i, avg(v) AS mean, stddev_pop(v) AS sd FROM u WHERE label = 0 GROUP BY i), z AS (SELECT vec_id, label, i, (v - mean) / sd AS z FROM u JOIN m USING (i)),
d AS (SELECT q.vec_id, ref.vec_id AS r, sqrt(sum((q.z - ref.z) ** 2)) AS d FROM z q JOIN z ref ON q.i = ref.i AND ref.label = 0 GROUP BY 1, 2),
k AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, r) AS rn FROM d)
SELECT vec_id, round(avg(d), 6) AS score FROM k WHERE rn <= 10 GROUP BY vec_id""")
def knn_score(spark, sf_dir):
    rows = states(spark, sf_dir, DIMENSIONS)
    return rounded(detectors.NearestNeighbours.fit(rows.where("label = 0"), [f"x{i}" for i in range(DIMENSIONS)]).score(rows).select("vec_id", "score"))


@query(f"""WITH {UNPIVOT_SQL}, c AS (SELECT i, median(v) AS centre FROM u WHERE label = 0 GROUP BY i), s AS (SELECT i, centre, 1.4826 * median(abs(v - centre)) AS scale FROM u JOIN c USING (i) WHERE label = 0 GROUP BY i, centre)
SELECT vec_id, round(max(abs((v - centre) / scale)), 6) AS score FROM u JOIN s USING (i) GROUP BY vec_id""")
def max_deviation(spark, sf_dir):
    rows = states(spark, sf_dir, DIMENSIONS)
    return rounded(detectors.MaxDeviation.fit(rows.where("label = 0"), [f"x{i}" for i in range(DIMENSIONS)]).score(rows).select("vec_id", "score"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a FROM embeddings WHERE label = 0), t AS (SELECT count(*) - 1 AS m, sum(a) AS s, sum(a * a) AS q FROM e)
SELECT vec_id, round(abs(a - (s - a) / m) / sqrt((q - a * a) / m - ((s - a) / m) ** 2), 5) AS score FROM e CROSS JOIN t""")
def loo_scores(spark, sf_dir):
    rows = states(spark, sf_dir, 1).where("label = 0")
    return rounded(detectors.leave_one_out(detectors.Mahalanobis, rows, "vec_id", ["x0"]), 5)


@query("""WITH e AS (SELECT CAST(l_shipdate AS DATE) AS day, l_quantity AS a FROM lineitem WHERE l_shipdate < DATE '1999-01-01'), d AS (SELECT day, count(*) AS n, sum(a) AS s, sum(a * a) AS q FROM e GROUP BY day),
t AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q FROM d), f AS (SELECT day, (t.s - d.s) / (t.n - d.n) AS mean, (t.q - d.q) / (t.n - d.n) - ((t.s - d.s) / (t.n - d.n)) ** 2 AS var FROM d CROSS JOIN t)
SELECT CAST(day AS VARCHAR) AS day, round(median(abs(a - mean) / sqrt(var)), 5) AS score FROM e JOIN f USING (day) GROUP BY day""")
def loo_day_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.col("l_quantity").cast("double").alias("a")).where(F.col("day") < F.to_date(F.lit("1999-01-01")))
    return rounded(detectors.leave_groups_out(rows, "day", ["a"]).groupBy("day").agg(F.median("score").alias("score")), 5)


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a FROM embeddings), m AS (SELECT count(*) AS n, avg(a) AS mean, stddev_pop(a) AS sd, sum(a) AS s, sum(a * a) AS q FROM e WHERE label = 0),
cal AS (SELECT abs(a - (s - a) / (n - 1)) / sqrt((q - a * a) / (n - 1) - ((s - a) / (n - 1)) ** 2) AS c FROM e CROSS JOIN m WHERE label = 0),
l AS (SELECT list(c ORDER BY c) AS cs FROM cal), x AS (SELECT e.label, e.vec_id, abs(a - mean) / sd AS score, n FROM e CROSS JOIN m WHERE e.label <> 0),
p AS (SELECT label, vec_id, score, (1.0 + count(c)) / (max(n) + 1) AS p, max(n) AS n FROM x LEFT JOIN cal ON c >= score - 1e-12 GROUP BY 1, 2, 3)
SELECT label, count(*) AS samples, CAST(sum(CASE WHEN p <= 0.100000000001 THEN 1 ELSE 0 END) AS BIGINT) AS alarmed, round(CAST(median(p) AS DOUBLE), 6) AS median_p_value,
round(median(score) / max(cs[CAST(ceil((n + 1) * 0.9 - 1e-9) AS BIGINT)]), 5) AS median_over_limit FROM p CROSS JOIN l GROUP BY label""")
def state_evaluation(spark, sf_dir):
    from .states import evaluate_states

    rows = states(spark, sf_dir, 1).withColumn("label", F.when(F.col("label") == 0, "reference").otherwise(F.col("label").cast("string")))
    out = evaluate_states(rows, "vec_id", ["x0"], 0.1, {"raw_frequencies": detectors.Mahalanobis})
    return rounded(out.select(F.col("label").cast("int").alias("label"), "samples", "alarmed", "median_p_value", "median_over_limit"), 6, median_over_limit=5)


@query()
def state_evaluation_arms(spark, sf_dir):
    from .states import evaluate_states

    rows = states(spark, sf_dir, 4).withColumn("label", F.when(F.col("label") == 0, "reference").otherwise(F.col("label").cast("string")))
    return rounded(evaluate_states(rows, "vec_id", [f"x{i}" for i in range(4)], 0.1, detectors.REGISTRY | {"max_deviation": detectors.MaxDeviation}))


#: From cal(c), the left-out scores of the reference, and x(label, vec_id, score), those of the others.
STATES_SQL = """l AS (SELECT list(c ORDER BY c) AS cs, count(*) AS n FROM cal),
p AS (SELECT label, vec_id, score, (1.0 + count(c)) / (max(n) + 1) AS p, max(n) AS n FROM x CROSS JOIN l LEFT JOIN cal ON c >= score - 1e-12 GROUP BY 1, 2, 3)
SELECT label, count(*) AS samples, CAST(sum(CASE WHEN p <= 0.100000000001 THEN 1 ELSE 0 END) AS BIGINT) AS alarmed, round(CAST(median(p) AS DOUBLE), 6) AS median_p_value,
round(median(score) / max(cs[CAST(ceil((n + 1) * 0.9 - 1e-9) AS BIGINT)]), 5) AS median_over_limit FROM p CROSS JOIN (SELECT cs FROM l) GROUP BY label"""


def evaluated(spark, sf_dir, arm):
    from .states import evaluate_states

    rows = states(spark, sf_dir, DIMENSIONS).withColumn("label", F.when(F.col("label") == 0, "reference").otherwise(F.col("label").cast("string")))
    out = evaluate_states(rows, "vec_id", [f"x{i}" for i in range(DIMENSIONS)], 0.1, {"arm": arm})
    return rounded(out.select(F.col("label").cast("int").alias("label"), "samples", "alarmed", "median_p_value", "median_over_limit"), 6, median_over_limit=5)


@query(f"""WITH {UNPIVOT_SQL}, t AS (SELECT i, count(*) AS n, sum(v) AS s, sum(v * v) AS q, avg(v) AS mean, stddev_pop(v) AS sd FROM u WHERE label = 0 GROUP BY i),
f AS (SELECT vec_id, i, v, (q - v * v) / (n - 1) - pow((s - v) / (n - 1), 2) AS var FROM u JOIN t USING (i) WHERE label = 0),
d AS (SELECT a.vec_id, r.vec_id AS r, sqrt(sum(pow(a.v - r.v, 2) / a.var)) AS d FROM f a JOIN u r ON r.i = a.i AND r.label = 0 AND r.vec_id <> a.vec_id GROUP BY 1, 2),
cal AS (SELECT avg(d) AS c FROM (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, r) AS k FROM d) WHERE k <= 10 GROUP BY vec_id),
y AS (SELECT a.vec_id, any_value(a.label) AS label, r.vec_id AS r, sqrt(sum(pow((a.v - r.v) / sd, 2))) AS d FROM u a JOIN u r ON r.i = a.i AND r.label = 0 AND a.label <> 0 JOIN t ON t.i = a.i GROUP BY 1, 3),
x AS (SELECT label, vec_id, avg(d) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, r) AS k FROM y) WHERE k <= 10 GROUP BY 1, 2), {STATES_SQL}""")
def state_evaluation_knn(spark, sf_dir):
    return evaluated(spark, sf_dir, detectors.NearestNeighbours)


@query(f"""WITH {UNPIVOT_SQL}, h AS (SELECT vec_id, i, v FROM u WHERE label = 0),
fc AS (SELECT a.vec_id, a.i, a.v, median(r.v) AS centre FROM h a JOIN h r ON r.i = a.i AND r.vec_id <> a.vec_id GROUP BY 1, 2, 3),
fs AS (SELECT a.vec_id, a.i, abs(a.v - a.centre) / (1.4826 * median(abs(r.v - a.centre))) AS z FROM fc a JOIN h r ON r.i = a.i AND r.vec_id <> a.vec_id GROUP BY a.vec_id, a.i, a.v, a.centre),
cal AS (SELECT max(z) AS c FROM fs GROUP BY vec_id),
c AS (SELECT i, median(v) AS centre FROM h GROUP BY i), s AS (SELECT i, centre, 1.4826 * median(abs(v - centre)) AS scale FROM h JOIN c USING (i) GROUP BY i, centre),
x AS (SELECT label, vec_id, max(abs((v - centre) / scale)) AS score FROM u JOIN s USING (i) WHERE label <> 0 GROUP BY 1, 2), {STATES_SQL}""")
def state_evaluation_deviation(spark, sf_dir):
    return evaluated(spark, sf_dir, detectors.MaxDeviation)


SHIFT_SQL = f"""{UNPIVOT_SQL}, b AS (SELECT i, median(v) AS base, stddev_samp(v) AS sd FROM u WHERE label = 0 GROUP BY i), s AS (SELECT label, i, median(v) AS med FROM u WHERE label <> 0 GROUP BY 1, 2),
x AS (SELECT label, i AS feature, (med - base) / base AS relative_shift, (med - base) / sd AS shift_over_sigma FROM s JOIN b USING (i))"""


def long_states(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label"), F.posexplode("embedding").alias("p", "v")).select("label", (F.col("p") + 1).cast("bigint").alias("feature"), F.col("v").cast("double").alias("value"))


@query(f"WITH {SHIFT_SQL} SELECT label, feature, round(relative_shift, 6) AS relative_shift, round(shift_over_sigma, 6) AS shift_over_sigma FROM x")
def shift_over_sigma(spark, sf_dir):
    return rounded(statistics.shifts_over_sigma(long_states(spark, sf_dir), 0))


@query(f"WITH {SHIFT_SQL} SELECT label, feature, round(shift_over_sigma, 6) AS shift_over_sigma, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY abs(shift_over_sigma) DESC, feature) AS INTEGER) AS rank FROM x) WHERE rank <= 2")
def top_shifts(spark, sf_dir):
    return rounded(statistics.top_shifts(statistics.shifts_over_sigma(long_states(spark, sf_dir), 0), 2).select("label", "feature", "shift_over_sigma", "rank"))


@query("""WITH g AS (SELECT l_returnflag AS unit, l_linestatus AS k, CASE WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN 1e9 ELSE l_extendedprice END AS v FROM lineitem),
c AS (SELECT unit, k, median(v) AS centre, stddev_samp(v) AS sd FROM g GROUP BY 1, 2), s AS (SELECT unit, k, sd, 1.4826 * median(abs(v - centre)) AS scale FROM g JOIN c USING (unit, k) GROUP BY 1, 2, 3)
SELECT unit FROM s GROUP BY unit HAVING bool_or(sd > 10 * scale)""")
def erratic_columns(spark, sf_dir):
    v = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 7), F.lit(1e9)).otherwise(F.col("l_extendedprice"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("unit"), F.col("l_linestatus").alias("k"), v.alias("v"))
    return statistics.erratic(rows, ["unit", "k"], "unit", "v")


@query("""WITH m AS (SELECT l_returnflag AS channel, strftime(l_shipdate, '%Y-%m') AS month, median(l_extendedprice) AS rms FROM lineitem GROUP BY 1, 2)
SELECT channel, round(max(rms) / greatest(min(rms), 1e-12), 6) AS ratio FROM m GROUP BY channel HAVING max(rms) / greatest(min(rms), 1e-12) <= 10""")
def stable_channels(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("channel"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("rms"))
    return rounded(statistics.stable_channels(rows))


@query("""WITH sc AS (SELECT unnest([0.0, 0.1, 0.2, 0.5, 1.0]) AS shift), d AS (SELECT shift, CAST(l_shipdate AS DATE) AS day, median(l_extendedprice * CASE WHEN l_shipdate >= DATE '1999-01-01' AND l_shipdate < DATE '2001-01-01' THEN 1 + shift ELSE 1 END) AS score FROM lineitem CROSS JOIN sc GROUP BY 1, 2 HAVING count(*) >= 6),
k AS (SELECT shift, day, (1.0 + sum(CASE WHEN day < DATE '1999-01-01' THEN 1 ELSE 0 END) OVER (PARTITION BY shift ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / (1.0 + sum(CASE WHEN day < DATE '1999-01-01' THEN 1 ELSE 0 END) OVER (PARTITION BY shift)) AS p FROM d)
SELECT CAST(shift AS DOUBLE) AS shift, round(avg(CASE WHEN p <= 0.010000000001 THEN 1.0 ELSE 0.0 END), 6) AS alarm_rate FROM k WHERE day >= DATE '1999-01-01' AND day < DATE '2001-01-01' GROUP BY shift""")
def sensitivity_sweep(spark, sf_dir):
    from .protocol import alarm_rates

    record = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ts"), F.lit(0).alias("mode"), F.col("l_extendedprice").alias("freq_hz"))
    rows = None
    for shift in (0.0, 0.1, 0.2, 0.5, 1.0):
        part = segments.inject_shift(record, *SEGMENTS["holdout"], [0], shift).select(F.lit(shift).alias("shift"), "ts", F.col("freq_hz").alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    return rounded(alarm_rates(rows, ["shift"], SEGMENTS["reference"], SEGMENTS["holdout"], ALPHA))


# --- spectra and modes ------------------------------------------------------------------------------


def series_by(spark, sf_dir, key: str, value: str = "l_quantity"):
    """All rows of ``lineitem`` as one series for each value of the key: about 30 samples a part, 600 a supplier, at any size of the table."""
    w = Window.partitionBy(key).orderBy(*ROW_ORDER)
    return by_key(read(spark, sf_dir, "lineitem"), key).select(F.col(key).alias("series"), (F.row_number().over(w) - 1).alias("idx"), F.col(value).cast("double").alias("value"))


DFT_SQL = """x AS (SELECT l_partkey AS series, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS idx, count(*) OVER (PARTITION BY l_partkey) AS n, CAST(l_quantity AS DOUBLE) AS value FROM lineitem),
y AS (SELECT series, idx, n, (value - avg(value) OVER (PARTITION BY series)) * CASE WHEN n < 2 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * idx / (n - 1)) END AS v FROM x),
sp AS (SELECT series, bin, n, bin * 100.0 / n AS freq_hz, (pow(sum(v * cos(2 * pi() * bin * idx / n)), 2) + pow(sum(v * sin(2 * pi() * bin * idx / n)), 2)) / n AS power FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS bin FROM y) GROUP BY 1, 2, 3),
nb AS (SELECT *, lag(power) OVER w AS l, lead(power) OVER w AS rr, max(power) OVER (PARTITION BY series) AS top FROM sp WINDOW w AS (PARTITION BY series ORDER BY bin))"""


@query(f"WITH {DFT_SQL} SELECT series, CAST(bin AS INTEGER) AS bin, round(CAST(freq_hz AS DOUBLE), 6) AS freq_hz, round(power, 4) AS power FROM sp")
def periodogram_dft(spark, sf_dir):
    return rounded(spectral.periodogram_dft(series_by(spark, sf_dir, "l_partkey"), 100.0), power=4)


@query(f"WITH {DFT_SQL} SELECT series, CAST(bin AS INTEGER) AS bin, round(CAST(freq_hz AS DOUBLE), 6) AS freq_hz, round(power, 4) AS power FROM sp")
def periodogram_fft(spark, sf_dir):
    return rounded(spectral.periodogram(series_by(spark, sf_dir, "l_partkey"), 100.0), power=4)


@query(f"WITH {DFT_SQL} SELECT series, CAST(bin AS INTEGER) AS bin, round(power, 4) AS power FROM nb WHERE power >= 0.15 * top AND power >= l AND power >= rr AND top > 0")
def peak_pick(spark, sf_dir):
    return spectral.peaks(spectral.periodogram_dft(series_by(spark, sf_dir, "l_partkey"), 100.0)).select("series", "bin", r("power", 4).alias("power"))


@query(f"""WITH {DFT_SQL}, b AS (SELECT CAST(m AS INTEGER) AS mode, 2.0 + 8 * m AS lo, 10.0 + 8 * m AS hi FROM (SELECT unnest(range(0, 5)) AS m)),
t AS (SELECT series, mode, n, freq_hz, l, power, rr, row_number() OVER (PARTITION BY series, mode ORDER BY power DESC, bin) AS k FROM nb JOIN b ON freq_hz >= lo AND freq_hz < hi)
SELECT series, mode, round(CAST(freq_hz + 100.0 / n * CASE WHEN l IS NULL OR rr IS NULL OR ln(l) - 2 * ln(power) + ln(rr) >= 0 THEN 0 ELSE 0.5 * (ln(l) - ln(rr)) / (ln(l) - 2 * ln(power) + ln(rr)) END AS DOUBLE), 5) AS freq_hz FROM t WHERE k = 1""")
def parabolic_peak(spark, sf_dir):
    of = spark.range(5).select(F.col("id").cast("int").alias("mode"), (2.0 + 8 * F.col("id")).alias("lo"), (10.0 + 8 * F.col("id")).alias("hi"))
    return rounded(modal.band_peaks(spectral.periodogram_dft(series_by(spark, sf_dir, "l_partkey"), 100.0), ["series"], of), 5)


@query()
def identified_modes(spark, sf_dir):
    return spectral.identify_modes(series_by(spark, sf_dir, "l_partkey"), 100.0)


PSD_SQL = """x AS (SELECT l_suppkey AS series, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS idx, count(*) OVER (PARTITION BY l_suppkey) AS n, CAST(l_quantity AS DOUBLE) AS v FROM lineitem),
l AS (SELECT *, CAST(pow(2, floor(log2(n / 4.5))) AS BIGINT) AS len FROM x WHERE n / 4.5 >= 64),
g AS (SELECT series, len, n, s, idx - s * (len // 2) AS j, v FROM (SELECT *, unnest([idx // (len // 2) - 1, idx // (len // 2)]) AS s FROM l) WHERE s >= 0 AND s * (len // 2) + len <= n),
w AS (SELECT series, len, s, j, (v - avg(v) OVER (PARTITION BY series, s)) * (0.5 - 0.5 * cos(2 * pi() * j / (len - 1))) AS w FROM g),
b AS (SELECT series, len, s, bin, pow(sum(w * cos(2 * pi() * bin * j / len)), 2) + pow(sum(w * sin(2 * pi() * bin * j / len)), 2) AS p FROM (SELECT *, unnest(range(0, len // 2 + 1)) AS bin FROM w) GROUP BY 1, 2, 3, 4),
psd AS (SELECT series, bin, bin * 100.0 / len AS freq_hz, avg(p) AS power FROM b GROUP BY series, len, bin)"""


@query(f"WITH {PSD_SQL} SELECT series, CAST(bin AS INTEGER) AS bin, round(CAST(freq_hz AS DOUBLE), 6) AS freq_hz, round(power, 2) AS power FROM psd")
def averaged_psd(spark, sf_dir):
    return rounded(spectral.averaged_psd(series_by(spark, sf_dir, "l_suppkey"), 100.0), power=2)


def two_channels(spark, sf_dir):
    """Records of two channels: quantities and prices of each supplier's lines."""
    w = Window.partitionBy("l_suppkey").orderBy(*ROW_ORDER)
    return by_key(read(spark, sf_dir, "lineitem"), "l_suppkey").select(F.col("l_suppkey").alias("record"), (F.row_number().over(w) - 1).alias("idx"), F.col("l_quantity").cast("double").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))


def segments_sql(length: int, centre: str, window: str) -> str:
    """Spectra of both channels: (record, s, bin, ar, ai, br, bi)."""
    return f"""x AS (SELECT l_suppkey AS record, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS idx, count(*) OVER (PARTITION BY l_suppkey) AS n, CAST(l_quantity AS DOUBLE) AS a, l_extendedprice / 1000 AS b FROM lineitem),
l AS (SELECT *, least(n, {length}) AS len, greatest(least(n, {length}) // 2, 1) AS half, avg(a) OVER (PARTITION BY record) AS ma, avg(b) OVER (PARTITION BY record) AS mb FROM x),
g AS (SELECT *, idx - s * half AS j, avg(a) OVER (PARTITION BY record, s) AS sa, avg(b) OVER (PARTITION BY record, s) AS sb FROM (SELECT *, unnest([idx // half - 1, idx // half]) AS s FROM l) WHERE s >= 0 AND idx < s * half + len AND s * half + len <= n),
w AS (SELECT record, s, j, len, {window} AS h, (a - {centre}a) * h AS wa, (b - {centre}b) * h AS wb FROM g),
t AS (SELECT record, s, len, bin, 2 * pi() * bin * j / len AS o, wa, wb FROM (SELECT *, unnest(range(0, len // 2 + 1)) AS bin FROM w)),
f AS (SELECT record, s, len, bin, sum(wa * cos(o)) AS ar, -sum(wa * sin(o)) AS ai, sum(wb * cos(o)) AS br, -sum(wb * sin(o)) AS bi FROM t GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {segments_sql(128, "m", "CASE WHEN len < 2 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * j / (len - 1)) END")},
c AS (SELECT record, bin, bin * 100.0 / len AS freq_hz, avg(ar * ar + ai * ai) AS aa, avg(br * br + bi * bi) AS bb, avg(ar * br + ai * bi) AS re, avg(ai * br - ar * bi) AS im FROM f WHERE bin * 100.0 / len BETWEEN 2 AND 14 GROUP BY record, len, bin),
e AS (SELECT *, (aa + bb) / 2 + sqrt(pow((aa - bb) / 2, 2) + re * re + im * im) AS s1 FROM c)
SELECT record, CAST(bin AS INTEGER) AS bin, round(CAST(freq_hz AS DOUBLE), 6) AS freq_hz, round(s1, 2) AS s1,
round((s1 - bb) / (2 * s1 - aa - bb), 5) AS first_share FROM e""")
def fdd(spark, sf_dir):
    """Singular values of the suppliers' records, and the first channel's share in the first singular vector."""
    rows = two_channels(spark, sf_dir).select("record", "idx", F.array("a", "b").alias("channels"))
    first = F.col("shape")[0]
    return rounded(modal.fdd(rows, 100.0, 128).select("record", "bin", "freq_hz", "s1", (first["re"] * first["re"] + first["im"] * first["im"]).alias("first_share")), 2, freq_hz=6, first_share=5)


TRACKED_SQL = f"""WITH {segments_sql(128, "m", "CASE WHEN len < 2 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * j / (len - 1)) END")},
c AS (SELECT record, bin, bin * 100.0 / len AS freq_hz, 100.0 / len AS step, avg(ar * ar + ai * ai) AS aa, avg(br * br + bi * bi) AS bb, avg(ar * br + ai * bi) AS re, avg(ai * br - ar * bi) AS im FROM f WHERE bin * 100.0 / len BETWEEN 2 AND 14 GROUP BY record, len, bin),
e AS (SELECT *, (aa + bb) / 2 + sqrt(pow((aa - bb) / 2, 2) + re * re + im * im) AS s1 FROM c),
o AS (SELECT *, (s1 - bb) / (2 * s1 - aa - bb) AS sim, lag(s1) OVER w AS l, lead(s1) OVER w AS rr FROM e WINDOW w AS (PARTITION BY record ORDER BY bin)),
md AS (SELECT * FROM (VALUES (0, 3.0), (1, 5.0), (2, 7.5), (3, 11.0)) t(mode, f0)),
k AS (SELECT o.*, mode, row_number() OVER (PARTITION BY record, mode ORDER BY CASE WHEN sim >= 0.6 THEN 0 ELSE 1 END, s1 DESC, bin) AS pick, max(sim) OVER (PARTITION BY record, mode) AS best
FROM o JOIN md ON abs(freq_hz - f0) <= 0.2 * f0 WHERE s1 > l AND s1 >= rr),
tr AS (SELECT a.record, md.mode, CASE WHEN sim >= 0.6 THEN freq_hz + step * CASE WHEN ln(l) - 2 * ln(s1) + ln(rr) >= 0 THEN 0 ELSE 0.5 * (ln(l) - ln(rr)) / (ln(l) - 2 * ln(s1) + ln(rr)) END END AS freq_hz, CASE WHEN sim >= 0.6 THEN sim ELSE best END AS similarity
FROM (SELECT DISTINCT record FROM e) a CROSS JOIN md LEFT JOIN k ON k.record = a.record AND k.mode = md.mode AND pick = 1)"""


def tracked(spark, sf_dir):
    """Modes that move the first channel, followed through the suppliers' decomposed spectra."""
    rows = two_channels(spark, sf_dir).select("record", "idx", F.array("a", "b").alias("channels"))
    one = F.array(*[F.struct(F.lit(x).alias("re"), F.lit(0.0).alias("im")) for x in (1.0, 0.0)])
    modes = spark.createDataFrame([(0, 3.0), (1, 5.0), (2, 7.5), (3, 11.0)], "mode int, freq_hz double").withColumn("shape", one)
    return modal.track_modes(written(modal.fdd(rows, 100.0, 128)), modes)  # read twice


@query(f"{TRACKED_SQL} SELECT record, mode, round(CAST(freq_hz AS DOUBLE), 5) AS freq_hz, round(similarity, 5) AS similarity FROM tr")
def tracked_modes(spark, sf_dir):
    return rounded(tracked(spark, sf_dir), 5)


@query(f"{TRACKED_SQL} SELECT mode, round(avg(CASE WHEN freq_hz IS NULL THEN 0.0 ELSE 1.0 END), 6) AS tracked_share FROM tr GROUP BY mode")
def tracked_share(spark, sf_dir):
    return rounded(modal.tracked_share(tracked(spark, sf_dir)))


@query("""SELECT l_suppkey AS record, CAST(c AS INTEGER) AS channel, round(stddev_pop(CASE WHEN c = 0 THEN CAST(l_quantity AS DOUBLE) ELSE l_extendedprice / 1000 END), 6) AS rms
FROM lineitem CROSS JOIN (SELECT unnest([0, 1]) AS c) GROUP BY 1, 2""")
def channel_rms(spark, sf_dir):
    return rounded(modal.channel_rms(two_channels(spark, sf_dir).select("record", F.array("a", "b").alias("channels"))))


@query(f"""WITH {segments_sql(64, "s", "CASE WHEN len < 2 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * j / len) END")}
SELECT record AS recording, CAST(bin AS INTEGER) AS bin, round(CAST(bin * 100.0 / len AS DOUBLE), 6) AS freq_hz, round((pow(sum(ar * br + ai * bi), 2) + pow(sum(ar * bi - ai * br), 2)) / pow(sum(ar * ar + ai * ai), 2), 5) AS power FROM f GROUP BY record, len, bin""")
def frf_indicator(spark, sf_dir):
    rows = two_channels(spark, sf_dir).select(F.col("record").alias("recording"), F.lit(0).alias("window"), "idx", F.col("a").alias("excitation"), F.array("b").alias("responses"))
    return rounded(modal.frf_indicator(rows, 100.0, 64).drop("window"), 5, freq_hz=6)


@query()
def half_power_damping(spark, sf_dir):
    psd = spectral.averaged_psd(series_by(spark, sf_dir, "l_suppkey"), 100.0)
    return rounded(spectral.half_power_damping(psd, spectral.peaks(psd, 0.9).select("series", F.col("freq_hz").alias("frequency_hz"))))


def mode_tables(spark, sf_dir):
    """For each part the rows of one flag as its reference modes and those of another as its observed ones."""
    w = Window.partitionBy("l_partkey", "l_returnflag").orderBy(*ROW_ORDER)
    rows = by_key(read(spark, sf_dir, "lineitem"), "l_partkey").select(F.col("l_partkey").alias("part"), "l_returnflag", F.row_number().over(w).alias("id"), (F.col("l_extendedprice") / 10000 + 0.5).alias("hz"))
    return tuple(rows.where(F.col("l_returnflag") == flag).select("part", F.col("id").alias(f"{x}_id"), F.col("hz").alias(f"{x}_hz")) for flag, x in (("A", "ref"), ("R", "obs")))


PAIR_SQL = """li AS (SELECT l_partkey AS part, l_returnflag AS flag, CAST(row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS id, l_extendedprice / 10000 + 0.5 AS hz FROM lineitem),
rf AS (SELECT part, id AS ref_id, hz AS ref_hz FROM li WHERE flag = 'A'), ob AS (SELECT part, id AS obs_id, hz AS obs_hz FROM li WHERE flag = 'R'),
pr AS (SELECT *, abs(ln(obs_hz / ref_hz)) AS d FROM ob JOIN rf USING (part)), p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part, obs_id ORDER BY d, ref_id) AS k FROM pr) WHERE k = 1),
pp AS (SELECT part, ref_id, obs_id, ref_hz, obs_hz FROM (SELECT *, row_number() OVER (PARTITION BY part, ref_id ORDER BY d, obs_id) AS j FROM p1) WHERE j = 1)"""


@query(f"WITH {PAIR_SQL} SELECT part, ref_id, obs_id FROM pp")
def mode_pairing(spark, sf_dir):
    return spectral.pair_modes(*mode_tables(spark, sf_dir), ["part"]).select("part", "ref_id", "obs_id")


DRIFT_SQL = f"""{PAIR_SQL}, n AS (SELECT rf.part, rf.ref_id, rf.ref_hz, CASE WHEN abs(pp.obs_hz - rf.ref_hz) <= 1.5 THEN pp.obs_hz END AS o FROM rf LEFT JOIN pp ON pp.part = rf.part AND pp.ref_id = rf.ref_id),
dr AS (SELECT part, ref_id, ref_hz, o AS obs_hz, 100 * (ref_hz - o) / ref_hz AS drop_percent, coalesce(abs(o - ref_hz) <= 0.05, false) AS resolution_limited FROM n),
sv AS (SELECT *, CASE WHEN obs_hz IS NULL THEN 'watch' WHEN resolution_limited THEN 'none' WHEN drop_percent >= 10 THEN 'alarm' WHEN drop_percent >= 5 THEN 'warn' WHEN drop_percent > 0 THEN 'watch' ELSE 'none' END AS severity FROM dr)"""


@query(f"WITH {DRIFT_SQL} SELECT part, ref_id, round(ref_hz, 6) AS ref_hz, round(obs_hz, 6) AS obs_hz, round(drop_percent, 6) AS drop_percent, resolution_limited, severity FROM sv")
def baseline_drift(spark, sf_dir):
    return rounded(spectral.baseline_drift(*mode_tables(spark, sf_dir), 0.05, keys=["part"]))


@query(f"WITH {DRIFT_SQL} SELECT part, CASE WHEN bool_or(severity = 'alarm') THEN 'alarm' WHEN bool_or(severity = 'warn') THEN 'warn' WHEN bool_or(severity = 'watch') THEN 'watch' ELSE 'none' END AS severity, round(max(CASE WHEN NOT resolution_limited THEN drop_percent END), 6) AS max_drop_percent FROM sv GROUP BY part")
def overall_drift(spark, sf_dir):
    return rounded(spectral.overall_drift(spectral.baseline_drift(*mode_tables(spark, sf_dir), 0.05, keys=["part"]), ["part"]))


@query("""WITH v AS (SELECT vec_id, label, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS re, CAST(embedding[2 * i + 2] AS DOUBLE) AS im FROM embeddings CROSS JOIN (SELECT unnest(range(0, 32)) AS i)),
f AS (SELECT v.* FROM v JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) USING (label, vec_id))
SELECT v.label, v.vec_id, round((pow(sum(v.re * f.re + v.im * f.im), 2) + pow(sum(v.re * f.im - v.im * f.re), 2)) / (sum(v.re * v.re + v.im * v.im) * sum(f.re * f.re + f.im * f.im)), 6) AS mac FROM v JOIN f ON v.label = f.label AND v.i = f.i GROUP BY 1, 2""")
def mac_matrix(spark, sf_dir):
    """Every shape against the first one of its label."""
    pair = lambda i: F.struct(F.col("embedding")[2 * i].cast("double").alias("re"), F.col("embedding")[2 * i + 1].cast("double").alias("im"))
    v = read(spark, sf_dir, "embeddings").select("label", "vec_id", F.array(*[pair(i) for i in range(DIMENSIONS // 2)]).alias("shape"))
    first = v.groupBy("label").agg(F.min_by("shape", "vec_id").alias("first"))
    return v.join(first, "label").select("label", "vec_id", r(C.mac("shape", "first")).alias("mac"))


@query()
def mode_tracking(spark, sf_dir):
    spectra = read(spark, sf_dir, "embeddings").select(F.col("label").alias("record"), F.col("vec_id").alias("bin"), (F.col("vec_id") / 50).alias("freq_hz"), (F.abs(F.col("embedding")[10].cast("double")) + 1e-3).alias("s1"), F.array(*[F.struct(F.col("embedding")[2 * i].cast("double").alias("re"), F.col("embedding")[2 * i + 1].cast("double").alias("im")) for i in range(3)]).alias("shape"))
    modes = spectra.where("bin in (100, 200, 300)").select((F.col("bin") / 100).cast("int").alias("mode"), "freq_hz", "shape")
    return rounded(modal.track_modes(spectra, modes, min_mac=0.3))


@query("""WITH s AS (SELECT l_suppkey AS record, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS idx, CAST(l_quantity AS DOUBLE) AS v FROM lineitem),
n AS (SELECT record, max(idx) + 1 AS n FROM s GROUP BY record), w AS (SELECT s.record, CAST(floor((idx - 20) / 100) AS BIGINT) AS win, v FROM s JOIN n USING (record) WHERE idx >= 20 AND (floor((idx - 20) / 100) + 1) * 100 + 20 <= n - 20),
d AS (SELECT record, win, stddev_pop(v) AS sd FROM w GROUP BY 1, 2), m AS (SELECT record, median(sd) AS med FROM d GROUP BY record)
SELECT record, win AS "window", round(sd, 6) AS sd FROM d JOIN m USING (record) WHERE sd >= 0.9 * med""")
def steady_windows(spark, sf_dir):
    rows = series_by(spark, sf_dir, "l_suppkey").withColumnsRenamed({"series": "record", "value": "v"})
    return rounded(segments.steady_windows(segments.tumbling(rows, ["record"], 100, 20), ["record"], "v"))


OPENING_SQL = """s AS (SELECT l_suppkey AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS idx, l_extendedprice AS value FROM lineitem),
p AS (SELECT file, idx, value, CASE WHEN idx < 200 THEN CAST(-1.1 AS DOUBLE) ELSE CAST(-1.1 AS DOUBLE) - CAST(idx - 200 AS DOUBLE) * CAST(0.2 AS DOUBLE) END AS inc FROM s),
c AS (SELECT file, median(inc) AS closed, median(value) AS base FROM p WHERE idx < 200 GROUP BY file), f AS (SELECT p.file, min(idx) AS f0 FROM p JOIN c USING (file) WHERE inc < closed - 1 GROUP BY p.file),
l AS (SELECT p.file, f0, min(struct_pack(a := inc, b := idx)).b AS t0 FROM p JOIN f USING (file) WHERE idx >= f0 GROUP BY 1, 2),
g AS (SELECT p.file, ang, median(value) AS v FROM p JOIN l USING (file) CROSS JOIN (SELECT unnest([CAST(-30 AS DOUBLE), CAST(-60 AS DOUBLE)]) AS ang) WHERE idx BETWEEN f0 AND t0 AND abs(inc - ang) <= 1 GROUP BY 1, 2)
SELECT g.file, CAST(ang AS DOUBLE) AS angle, round(v - base, 4) AS feature FROM g JOIN c ON c.file = g.file WHERE g.file IN (SELECT file FROM g GROUP BY file HAVING count(*) = 2)"""


@query(f"WITH {OPENING_SQL}")
def opening_features(spark, sf_dir):
    idx = F.col("idx")
    rows = series_by(spark, sf_dir, "l_suppkey", "l_extendedprice").withColumnRenamed("series", "file").withColumn("channel", F.lit("g1"))
    rows = rows.withColumn("inclination", F.when(idx < 200, F.lit(-1.1)).otherwise(F.lit(-1.1) - (idx - 200) * F.lit(0.2)))
    return events.opening_features(rows, closed_samples=200).select("file", "angle", r("feature", 4).alias("feature"))


@query("""WITH x AS (SELECT s_suppkey, 1.0 + s_suppkey AS m, 1000.0 * (1 + s_suppkey % 7) AS k FROM supplier)
SELECT s_suppkey, round(sqrt((3 - sqrt(5)) / 2 * k / m) / (2 * pi()), 6) AS f1, round(sqrt((3 + sqrt(5)) / 2 * k / m) / (2 * pi()), 6) AS f2 FROM x""")
def shear_frequencies(spark, sf_dir):
    m, k = 1.0 + F.col("s_suppkey"), 1000.0 * (1 + F.col("s_suppkey") % 7)
    models = read(spark, sf_dir, "supplier").select("s_suppkey", F.array(m, m).alias("masses"), F.array(k, k).alias("stiffness"))
    return physical.natural_frequencies(models).select("s_suppkey", r(F.col("frequencies_hz")[0]).alias("f1"), r(F.col("frequencies_hz")[1]).alias("f2"))


@query("SELECT s_suppkey, CAST(2 * (1 + s_suppkey % 7) AS DOUBLE) AS k00, CAST(-1 * (1 + s_suppkey % 7) AS DOUBLE) AS k01, CAST(1 + s_suppkey % 7 AS DOUBLE) AS k11 FROM supplier")
def stiffness_matrix(spark, sf_dir):
    k = (1 + F.col("s_suppkey") % 7).cast("double")
    out = physical.stiffness_matrix(read(spark, sf_dir, "supplier").select("s_suppkey", F.array(k, k).alias("stiffness")))
    return out.select("s_suppkey", F.col("matrix")[0][0].alias("k00"), F.col("matrix")[0][1].alias("k01"), F.col("matrix")[1][1].alias("k11"))


@query(f"""WITH {PAIR_SQL}, q AS (SELECT part, pow(obs_hz / ref_hz, 2) AS r FROM pp), m AS (SELECT part, median(r) AS med, count(*) AS n FROM q GROUP BY part)
SELECT part, round(med, 6) AS stiffness_ratio, n AS paired, round(100 * median(abs(r - med)) / med, 6) AS spread_percent FROM q JOIN m USING (part) GROUP BY part, med, n""")
def model_consistency(spark, sf_dir):
    return rounded(physical.model_consistency(*mode_tables(spark, sf_dir), ["part"]))


# --- times and labels -------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CAST(TIMESTAMP '1999-12-27 00:00:00' + to_days(CAST(7 * (o_orderkey % 50) + o_custkey % 7 AS INTEGER)) + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS VARCHAR) AS start FROM orders""")
def record_name_time(spark, sf_dir):
    name = F.concat(F.lpad((F.col("o_orderkey") % 50 + 1).cast("string"), 2, "0"), F.char(65 + F.col("o_custkey") % 7), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"))
    return read(spark, sf_dir, "orders").select("o_orderkey", C.record_time(name, "1999-12-27 00:00:00").cast("string").alias("start"))


@query("SELECT o_orderkey, CAST(TIMESTAMP '2018-10-01 00:00:00' + to_hours(CAST(o_orderkey AS BIGINT)) AS VARCHAR) AS ts FROM orders")
def datenum_time(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", C.datenum_time(F.lit(737334.0) + F.col("o_orderkey") / 24).cast("string").alias("ts"))


@query("""SELECT CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' THEN 'reference' WHEN l_shipdate = TIMESTAMP '2000-03-09' THEN 'event'
WHEN l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '2000-03-09' THEN 'holdout' ELSE 'changed' END AS label, count(*) AS n FROM lineitem GROUP BY 1""")
def route_labels(spark, sf_dir):
    label = segments.route_label("l_shipdate", ("1996-01-01", "1999-01-01"), "2000-03-09", "2000-03-09")
    return read(spark, sf_dir, "lineitem").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
