"""Interval and as-of operators between readings and event tables.

None of them is a range join: each is a union of the two sides followed by a
running aggregate in time order (a sweep), computed with the chunked two-level
scan of :mod:`series`, so no pair of rows is ever materialised and a hot
machine is spread over its time chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import ReadingSpec
from .series import START_COL, chunked, hours_between, scan


def inside_intervals(readings: DataFrame, intervals: DataFrame, spec: ReadingSpec,
                     start: str = "start", end: str = "end", name: str = "in_interval") -> DataFrame:
    """Flag readings with ``start <= ts < end`` for some interval of the same machine.

    Sweep: +1 at each start, -1 at each end, 0 at each reading; at equal times the
    interval edges go first (start inclusive, end exclusive); inside = running sum > 0.
    """
    m, ts = spec.machine, spec.ts
    readings = readings.drop(START_COL)  # the union of both sides is chunked anew
    tie = spec.tie or ts
    cols = readings.columns
    r = readings.select(*cols, F.lit(1).alias("_kind"), F.lit(0).alias("_delta"))
    iv = intervals.select(m, start, end)
    edges = (iv.select(m, F.col(start).alias(ts), F.lit(1).alias("_delta"))
             .unionByName(iv.select(m, F.col(end).alias(ts), F.lit(-1).alias("_delta")))
             .withColumn("_kind", F.lit(0)))
    for c in cols:
        if c not in (m, ts):
            edges = edges.withColumn(c, F.lit(None).cast(dict(readings.dtypes)[c]))
    u = chunked(r.unionByName(edges.select(*cols, "_kind", "_delta")), spec)
    order = [ts, "_kind", tie] if tie != ts else [ts, "_kind"]
    s = scan(u, spec, [("_delta", "sum", "_active")], order=order)
    return s.where(F.col("_kind") == 1).select(*cols, (F.col("_active") > 0).alias(name))


def last_event_before(readings: DataFrame, events: DataFrame, spec: ReadingSpec, kinds, kind_col: str,
                      prefix: str = "since_") -> DataFrame:
    """Per reading, hours since the latest event of each kind at or before it.

    ``events`` has machine, ts (and tie) and ``kind_col``. Readings and events are
    unioned; the latest time per kind is a running max.
    """
    m, ts = spec.machine, spec.ts
    readings = readings.drop(START_COL)  # the union of both sides is chunked anew
    cols = readings.columns
    r = readings.withColumn("_kind", F.lit(1))
    ev = events.select(m, ts, *( [spec.tie] if spec.tie else []), kind_col).withColumn("_kind", F.lit(0))
    for c in cols:
        if c not in ev.columns:
            ev = ev.withColumn(c, F.lit(None).cast(dict(readings.dtypes)[c]))
    if kind_col not in cols:
        r = r.withColumn(kind_col, F.lit(None).cast("string"))
    u = chunked(r.unionByName(ev.select(*cols, kind_col, "_kind")), spec)
    for kd in kinds:
        u = u.withColumn(f"_t_{kd}", F.when((F.col("_kind") == 0) & (F.col(kind_col) == kd), F.col(ts)))
    order = [ts, "_kind"] + ([spec.tie] if spec.tie else [])
    s = scan(u, spec, [(f"_t_{kd}", "max", f"_last_{kd}") for kd in kinds], order=order)
    out = s.where(F.col("_kind") == 1)
    return out.select(*cols, *[hours_between(f"_last_{kd}", ts).alias(f"{prefix}{kd}_h") for kd in kinds])


def counts_in_past(readings: DataFrame, events: DataFrame, spec: ReadingSpec, kinds, kind_col: str,
                   hours: int = 24, suffix: str = "_24h") -> DataFrame:
    """Per reading, number of events of each kind in ``[ts - hours, ts]`` (pivoted).

    A sweep: every event counts +1 from its time and -1 just after ``ts + hours``
    (readings at that very time still see it), and the running sums of each kind
    are carried over the chunks, so the work is linear however dense the rows are.
    """
    m, ts = spec.machine, spec.ts
    readings = readings.drop(START_COL)  # the union of both sides is chunked anew
    cols = readings.columns
    r = readings.withColumn("_kind", F.lit(1))
    ev = events.select(m, ts, kind_col)
    gone = ev.withColumn(ts, (F.col(ts) + F.expr(f"INTERVAL {int(hours)} HOURS")).cast(readings.schema[ts].dataType))
    ev = ev.withColumn("_kind", F.lit(0)).unionByName(gone.withColumn("_kind", F.lit(2)))
    for c in cols:
        if c not in ev.columns:
            ev = ev.withColumn(c, F.lit(None).cast(dict(readings.dtypes)[c]))
    if kind_col not in cols:
        r = r.withColumn(kind_col, F.lit(None).cast("string"))
    u = chunked(r.unionByName(ev.select(*cols, kind_col, "_kind")), spec)
    step = F.when(F.col("_kind") == 0, F.lit(1)).when(F.col("_kind") == 2, F.lit(-1)).otherwise(F.lit(0))
    for kd in kinds:
        u = u.withColumn(f"_d_{kd}", F.when(F.col(kind_col) == kd, step).otherwise(F.lit(0)).cast("long"))
    order = [ts, "_kind"] + ([spec.tie] if spec.tie else [])
    s = scan(u, spec, [(f"_d_{kd}", "sum", f"{kd}{suffix}") for kd in kinds], order=order)
    return s.where(F.col("_kind") == 1).select(*cols, *[F.col(f"{kd}{suffix}").cast("long").alias(f"{kd}{suffix}") for kd in kinds])


def next_event_after(readings: DataFrame, events: DataFrame, spec: ReadingSpec,
                     name: str = "next_event_ts") -> DataFrame:
    """C7 (and C3 on two tables): time of the first event strictly after each reading.

    ``events`` (machine, ts) should be de-duplicated; at equal times the event is
    ordered before the reading so it does not count as "after".
    """
    m, ts = spec.machine, spec.ts
    readings = readings.drop(START_COL)  # the union of both sides is chunked anew
    cols = readings.columns
    r = readings.withColumn("_kind", F.lit(1))
    ev = events.select(m, ts).withColumn("_kind", F.lit(0))
    for c in cols:
        if c not in ev.columns:
            ev = ev.withColumn(c, F.lit(None).cast(dict(readings.dtypes)[c]))
    u = chunked(r.unionByName(ev.select(*cols, "_kind")), spec) \
        .withColumn("_ev_ts", F.when(F.col("_kind") == 0, F.col(ts)))
    order = [ts, "_kind"] + ([spec.tie] if spec.tie else [])
    s = scan(u, spec, [("_ev_ts", "next_min", name)], order=order)
    return s.where(F.col("_kind") == 1).select(*cols, name)


def failure_horizon(readings: DataFrame, failures: DataFrame, spec: ReadingSpec, horizon_h: float = 24.0) -> DataFrame:
    """``hours_to_failure`` (null when none) and ``failure_within_24h``."""
    fl = failures.select(spec.machine, spec.ts).dropDuplicates([spec.machine, spec.ts])
    n = next_event_after(readings, fl, spec, "_next_fail")
    h = hours_between(spec.ts, "_next_fail")
    return n.select(*readings.columns, h.alias("hours_to_failure"),
                    F.coalesce((h <= horizon_h).cast("int"), F.lit(0)).alias("failure_within_24h"))
