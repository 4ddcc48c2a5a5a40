"""Fleet reports (D1-D14): KPIs, counts, top-k, daily series, correlations,
descriptive and box statistics, histograms.

All are aggregates with map-side partial aggregation; the only row-order work
is the top-k (``TakeOrderedAndProject``, partial per task) and the day spine,
which is as long as the time span, not the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import ReadingSpec
from ..session import broadcast_if_small, cut_lineage
from .quantiles import percentiles


def fleet_kpis(df: DataFrame, spec: ReadingSpec) -> DataFrame:
    """Rows, machines, sites, failure rate, 24 h label rate, mean RUL."""
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.countDistinct(spec.machine).alias("n_machines"),
            F.countDistinct(spec.site).alias("n_sites"),
            F.avg(spec.failed).alias("failure_rate")]
    if spec.label24 in df.columns:
        aggs.append(F.avg(spec.label24).alias("label24_rate"))
    if spec.rul in df.columns:
        aggs.append(F.avg(spec.rul).alias("mean_rul"))
    return df.agg(*aggs)


def value_counts(df: DataFrame, *cols: str, name: str = "n") -> DataFrame:
    """Counts per key, descending, ties by key."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *cols)


def top_by_sum(df: DataFrame, key: str, col: str, n: int = 10, name: str = "total") -> DataFrame:
    """The n keys with the largest sum; ties broken by key."""
    return (df.groupBy(key).agg(F.sum(col).cast("long").alias(name))
              .orderBy(F.desc(name), F.asc(key)).limit(n))


def daily_sum(df: DataFrame, ts: str, col: str, name: str = "total") -> DataFrame:
    """Per calendar day sum of ``col``; days without rows appear with 0."""
    daily = df.groupBy(F.to_date(ts).alias("day")).agg(F.sum(col).cast("long").alias(name))
    spine = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")) \
                 .select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return spine.join(daily, "day", "left").select("day", F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name))


def means_by(df: DataFrame, group: str, cols, ascending: bool = False) -> DataFrame:
    """Mean of each column per group, long form (sensor, group, mean)."""
    wide = df.groupBy(group).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)])  # one pass
    parts = ", ".join(f"'{c}', _m{i}" for i, c in enumerate(cols))
    out = wide.select(F.col(group), F.expr(f"stack({len(cols)}, {parts}) AS (sensor, mean)")).select("sensor", group, "mean")
    return out.orderBy("sensor", F.asc("mean") if ascending else F.desc("mean"))


def _pearson(a: str, b: str, name: str) -> list:
    """Aggregates of Pearson's r over the rows where both values are present."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
    return [F.covar_pop(a, b).alias(f"{name}_c"), F.stddev_pop(x).alias(f"{name}_x"), F.stddev_pop(y).alias(f"{name}_y"), F.count(x).alias(f"{name}_n")]


def _r(name: str):
    """Null below two rows, NaN without spread (F.corr raises an error there)."""
    spread = F.col(f"{name}_x") * F.col(f"{name}_y")
    r = F.when(spread == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col(f"{name}_c"), spread))
    return F.when(F.col(f"{name}_n") < 2, F.lit(None).cast("double")).otherwise(r).alias(name)


def correlations(df: DataFrame, pairs) -> DataFrame:
    """Pearson r for each (a, b) pair in one aggregate, long output.
    Each r uses the rows where both values are non-null."""
    wide = df.agg(*[e for i, (a, b) in enumerate(pairs) for e in _pearson(a, b, f"c{i}")]).select(*[_r(f"c{i}") for i in range(len(pairs))])
    parts = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return wide.select(F.expr(f"stack({len(pairs)}, {parts}) AS (a, b, r)"))


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson r of all ordered pairs. Only distinct pairs are aggregated; a column with
    itself gives 1 (null below two values, NaN without spread), a turned pair the same r."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    at = {p: i for i, p in enumerate(pairs)}
    wide = df.agg(*[e for i, (a, b) in enumerate(pairs) for e in _pearson(a, b, f"c{i}")],
                  *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)])
    own = [F.when(F.col(f"n{i}") < 2, F.lit(None).cast("double")).when(F.col(f"s{i}") == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)).alias(f"d{i}")
           for i in range(len(cols))]
    wide = wide.select(*[_r(f"c{i}") for i in range(len(pairs))], *own)
    name = lambda i, j: f"d{i}" if i == j else f"c{at[(cols[min(i, j)], cols[max(i, j)])]}"
    parts = ", ".join(f"'{a}', '{b}', {name(i, j)}" for i, a in enumerate(cols) for j, b in enumerate(cols))
    return wide.select(F.expr(f"stack({len(cols) ** 2}, {parts}) AS (a, b, r)"))


def _long(df: DataFrame, cols, group=()) -> DataFrame:
    parts = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.select(*group, F.expr(f"stack({len(cols)}, {parts}) AS (sensor, x)"))


def describe(df: DataFrame, cols) -> DataFrame:
    """Count, mean, std, min, quartiles (exact, linear), max per column."""
    lg = _long(df, cols)
    base = lg.groupBy("sensor").agg(F.count("x").alias("n"), F.avg("x").alias("mean"),
                                    F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
                                    F.max("x").alias("max"))
    q = percentiles(lg, "x", (0.25, 0.5, 0.75), ["sensor"])
    return base.join(q, "sensor", "left")


def flag_rates(df: DataFrame, flags) -> DataFrame:
    """Per flag column, number of rows set and share."""
    lg = _long(df, flags).withColumnRenamed("sensor", "flag")
    return lg.groupBy("flag").agg(F.sum("x").cast("long").alias("n_set"), F.avg("x").alias("rate"))


def box_stats(df: DataFrame, group: str, col: str) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR) and outlier count per group."""
    data = df.select(group, F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    q = percentiles(data, "x", (0.25, 0.5, 0.75), [group]).select(
        group, F.col("p25").alias("q1"), F.col("p50").alias("median"), F.col("p75").alias("q3"))
    j = data.join(broadcast_if_small(cut_lineage(q)), group)  # q: one row per group
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - F.lit(1.5) * iqr, F.col("q3") + F.lit(1.5) * iqr
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(F.col("x") >= lo, F.col("x"))).alias("whisker_lo"),
        F.max(F.when(F.col("x") <= hi, F.col("x"))).alias("whisker_hi"),
        F.count(F.when((F.col("x") < lo) | (F.col("x") > hi), 1)).alias("n_outliers"))


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins between the global min and max; the top edge folds into
    the last bin. Returns (by, bin, n) with bin in 1..bins."""
    b = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()  # one aggregate row
    lo, hi = b["lo"], b["hi"]
    if lo is None:
        return df.select(*([by] if by else []), F.lit(None).cast("long").alias("bin"),
                         F.lit(None).cast("long").alias("n")).limit(0)
    if hi == lo:
        binc = F.lit(1).cast("long")
    else:
        binc = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))) + 1,
                       F.lit(bins)).cast("long")
    keys = ([by] if by else []) + [binc.alias("bin")]
    return df.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
