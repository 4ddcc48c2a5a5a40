"""Per-machine time-series operators that stay balanced when one machine is hot.

A window ``PARTITION BY machine`` sends a machine's whole history to one task;
if one machine holds a third of the rows, that task holds a third of the data.
Every operator here therefore works on **(machine, time chunk)** partitions and
carries the little state that crosses a chunk boundary through a per-chunk
summary table (rows = machines x chunks, independent of the row count):

* bounded row frames (E1/E2) get a *halo*: the last ``k`` rows before each
  chunk, taken from per-chunk tails, re-keyed to the chunk they precede;
* running counts, row indexes and "last value" carries (E3, E4, E7, E8, C2, C5)
  are two-level scans: local window + offset from preceding chunk summaries;
* "next value" lookups (C3, C7) are the same scan in reverse.

With ``chunk_seconds`` larger than the time span the code degenerates to the
plain per-machine window, which is what the tests compare against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from ..functions.scalar import degradation_score, label_within, machine_state, sensor_prefix
from ..spec import RAW_SPEC, ROLLING_WINDOW, RUL_CAP_HOURS, ReadingSpec

CHUNK = "_chunk"
UNB_PRE, UNB_FOL = Window.unboundedPreceding, Window.unboundedFollowing


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def epoch_micros(c: str, dtype=None) -> Column:
    """Microseconds since 1970 of column ``c``: TIMESTAMP_NTZ (no zone) or TIMESTAMP."""
    if dtype is None or isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {_name(c)})")
    return F.unix_micros(F.col(c))


def hours_between(start: str, end: str) -> Column:
    """(end - start) in hours as a double, exact to the microsecond (column names)."""
    return F.expr(f"timestampdiff(MICROSECOND, {_name(start)}, {_name(end)})") / F.lit(3_600_000_000.0)


#: Start (microseconds) of the chunk of a *hot* machine's row; null for the rows of any other machine.
START_COL = "_cw_m"
#: Start of the rows of a hot machine that have no time: before all others.
NO_TIME = -(1 << 62)
MAX_LEVELS = 64


def _bins(level: DataFrame, lo: str, hi: str, n: str, spec: ReadingSpec, least: int) -> DataFrame:
    """Parent brackets with the bin width that gives ``chunk_rows`` rows a bin if they lay evenly."""
    even = F.floor((F.col(hi) - F.col(lo) + 1) * F.lit(float(spec.chunk_rows)) / F.col(n)).cast("long")
    return level.withColumn("_w", F.greatest(F.lit(max(least, 1)), F.least(F.lit(spec.chunk_seconds * 1_000_000), even)))


def chunk_levels(df: DataFrame, spec: ReadingSpec) -> list[DataFrame]:
    """Time histograms of the hot machines (more than ``spec.chunk_rows`` rows), coarse to fine.

    Level 0 divides a hot machine's span into equal bins and counts their rows; a bin that still holds
    too many is divided anew between its own first and last time, and so on, so a burst is cut as finely
    as it needs and quiet times stay whole. Rows of one and the same time are not divided. Every level has at most
    total_rows / chunk_rows rows, which bounds its broadcast. Empty without hot machines.
    """
    if not spec.chunk_rows:
        return []
    m, us = spec.machine, epoch_micros(spec.ts, df.schema[spec.ts].dataType)
    rows = df.select(m, us.alias("_us"))
    span = rows.groupBy(m).agg(F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    span = _bins(span.where((F.col("_n") > spec.chunk_rows) & F.col("_lo").isNotNull()), "_lo", "_hi", "_n", spec, spec.min_chunk_seconds * 1_000_000)
    level = cut_lineage(span.select(m, F.lit(None).cast("long").alias("_of"), "_lo", "_w"))
    levels: list[DataFrame] = []
    while not level.isEmpty():
        levels.append(level)
        if len(levels) == MAX_LEVELS:
            break
        rows = _in_level(rows, level, spec, len(levels) == 1).where(F.col(START_COL).isNotNull())  # only what was divided last
        full = rows.groupBy(m, START_COL).agg(F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
        full = _bins(full.where((F.col("_n") > spec.chunk_rows) & (F.col("_lo") < F.col("_hi"))), "_lo", "_hi", "_n", spec, 1)
        level = cut_lineage(full.select(m, F.col(START_COL).alias("_of"), "_lo", "_w"))
        if not level.isEmpty():  # the next round counts inside these bins alone
            rows = _nsjoin(rows, F.broadcast(level.select(m, F.col("_of").alias(START_COL))), [m, START_COL])
    return levels


def _in_level(rows: DataFrame, level: DataFrame, spec: ReadingSpec, first: bool) -> DataFrame:
    """``rows(..., _us)`` with the start of their bin in this level; rows of undivided bins keep theirs."""
    m = spec.machine
    if first:
        joined = _nsjoin(rows, F.broadcast(level.drop("_of")), [m], "left")
        old = F.lit(None).cast("long")
    else:
        joined = _nsjoin(rows, F.broadcast(level.withColumnRenamed("_of", START_COL)), [m, START_COL], "left")
        old = F.col(START_COL)
    start = F.col("_lo") + F.floor((F.col("_us") - F.col("_lo")) / F.col("_w")).cast("long") * F.col("_w")
    start = F.when(F.col("_us").isNull(), F.lit(NO_TIME)).otherwise(start)
    return joined.withColumn(START_COL, F.when(F.col("_w").isNull(), old).otherwise(start)).drop("_lo", "_w")


def attach_chunk_widths(df: DataFrame, spec: ReadingSpec) -> DataFrame:
    """Find the hot machines' chunks once, on the source, and carry each row's chunk start in a
    column; every later chunking of rows derived from it reuses them. The column's metadata
    tells whether there is a hot machine at all."""
    if not spec.chunk_rows:
        return df
    levels = chunk_levels(df, spec)
    out = df.withColumn(START_COL, F.lit(None).cast("long"))
    if levels:
        out = df.withColumn("_us", epoch_micros(spec.ts, df.schema[spec.ts].dataType))
        for i, level in enumerate(levels):
            out = _in_level(out, level, spec, i == 0)
        out = out.drop("_us")
    return out.withColumn(START_COL, F.col(START_COL).alias(START_COL, metadata={"hot": bool(levels)}))


def with_chunk(df: DataFrame, spec: ReadingSpec, name: str = CHUNK) -> DataFrame:
    """Add the time-chunk number (monotone in time within a machine) of each row.

    A hot machine's chunks are those of :func:`chunk_levels`, numbered by their start; any other
    machine is one chunk. With ``spec.chunk_rows`` unset every machine is cut into chunks of
    ``spec.chunk_seconds``.
    """
    attached = START_COL in df.columns  # once upstream: no second pass over the data
    if not attached and not spec.chunk_rows:
        us = epoch_micros(spec.ts, df.schema[spec.ts].dataType)
        return df.withColumn(name, F.floor(us / F.lit(spec.chunk_seconds * 1_000_000)).cast("long"))
    out = df if attached else attach_chunk_widths(df, spec)
    hot = out.schema[START_COL].metadata.get("hot", True)
    out = out.withColumn(name, F.coalesce(F.col(START_COL), F.lit(0)).alias(name, metadata={"hot": hot}))
    return out if attached else out.drop(START_COL)


def chunked(df: DataFrame, spec: ReadingSpec) -> DataFrame:
    """Add the chunk and hash-partition on (machine, chunk): the one shuffle of the data.
    A frame that already carries its chunk (``keep_chunk`` upstream) is reused as is."""
    if CHUNK in df.columns:
        return df
    out = with_chunk(df, spec)
    # without a hot machine the chunk is a constant, which windows leave out of their keys: so does the shuffle
    return out.repartition(spec.machine, CHUNK) if out.schema[CHUNK].metadata.get("hot", True) else out.repartition(spec.machine)


def _w_chunk(spec: ReadingSpec, desc: bool = False):
    order = [F.col(c).desc() for c in spec.order] if desc else [F.col(c) for c in spec.order]
    return Window.partitionBy(spec.machine, CHUNK).orderBy(*order)


def _w_summary(spec: ReadingSpec, desc: bool = False):
    return Window.partitionBy(spec.machine).orderBy(F.col(CHUNK).desc() if desc else F.col(CHUNK))


# "The next value" is read as a preceding frame over the reversed order: Spark updates such a
# frame row by row, whereas a frame up to the last row is computed anew for every row.


# ---------------------------------------------------------------------------
# Halo for bounded row frames
# ---------------------------------------------------------------------------

def _nsjoin(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` with ``<=>``: Spark infers no IsNotNull filter from it,
    so the shared (machine, chunk) shuffle below both sides stays reusable."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for c in keys:
        e = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in keys])


#: Summaries up to this size (rows x the width of a row) are broadcast; beyond, the join shuffles them to the rows.
BROADCAST_SUMMARY_BYTES = 64 << 20


def _join_summary(d: DataFrame, summ: DataFrame, keys: list[str]) -> DataFrame:
    """Left-join a materialised per-chunk summary back on (machine, chunk).

    Plain keys keep the rows' (machine, chunk) hash partitioning: a broadcast join
    (summary size checked, cheap since it is checkpointed) leaves partitioning and
    order untouched; a bigger summary is shuffled to the rows, which stay put and
    are only sorted. Rows without a machine match no summary and get no carry.
    """
    width = 16 * (len(summ.columns) + 1)
    if summ.count() * width <= BROADCAST_SUMMARY_BYTES:
        summ = F.broadcast(summ)
    return d.join(summ, keys, "left")


def halo_from_tails(tails: DataFrame, spec: ReadingSpec, k: int, cols: list[str]) -> DataFrame:
    """For every non-empty chunk, the ``k`` rows of the same machine just before it.

    ``tails`` holds, per (machine, chunk), its last <= k rows with ``_rd`` = 1 for the
    latest. Returns rows with ``cols`` and ``CHUNK`` re-keyed to the chunk they
    precede. Size <= k x chunks; everything here is per-chunk summary data.
    """
    m = spec.machine
    summ = tails.groupBy(m, CHUNK).agg(F.count(F.lit(1)).alias("_nt"))
    ws = _w_summary(spec)
    summ = summ.select(
        m, CHUNK, "_nt",
        F.row_number().over(ws).alias("_j"),
        F.coalesce(F.sum("_nt").over(ws.rowsBetween(UNB_PRE, -1)), F.lit(0)).alias("_C"))
    # position of each tail row among all tail rows of its machine
    pos = _nsjoin(tails, summ, [m, CHUNK]).withColumn("_p", F.col("_C") + F.col("_nt") - F.col("_rd") + 1)
    # a tail row can only be within k rows of the next k non-empty chunks
    cand = pos.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_dj")) \
              .withColumn("_jt", F.col("_j") + F.col("_dj"))
    target = summ.select(m, F.col("_j").alias("_jt"), F.col(CHUNK).alias("_tchunk"), F.col("_C").alias("_Ct"))
    halo = _nsjoin(cand, target, [m, "_jt"]).filter(F.col("_p") > F.col("_Ct") - k)
    return halo.select(*[F.col("_tchunk").alias(CHUNK) if c == CHUNK else F.col(c) for c in cols])


def rolling_features(df: DataFrame, spec: ReadingSpec = RAW_SPEC, window: int = ROLLING_WINDOW,
                     cols=None, split: bool = True) -> DataFrame:
    """Per machine, mean and sample std over the last ``window`` rows.

    Partial windows at the start are allowed; the std of a one-row window is 0.
    Output names: ``<prefix>_mean_<window>h`` / ``<prefix>_std_<window>h``.

    Plan: one shuffle on (machine, chunk); the window runs inside each chunk;
    rows past the first ``k = window-1`` of a chunk are final. The first k rows of
    each chunk are recomputed from themselves plus the k rows before the chunk
    (the halo, built from per-chunk tails), a set of <= 2k rows per chunk. Machines
    that are not hot are one chunk, all of whose rows are final.
    """
    cols = list(cols or spec.sensors)
    k = window - 1
    out_names = []
    for c in cols:
        p = sensor_prefix(c)
        out_names += [f"{p}_mean_{window}h", f"{p}_std_{window}h"]

    def exprs(w):
        e = []
        for c in cols:
            p = sensor_prefix(c)
            e.append(F.avg(c).over(w).alias(f"{p}_mean_{window}h"))
            e.append(F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0)).alias(f"{p}_std_{window}h"))
        return e

    if not split:
        w = Window.partitionBy(spec.machine).orderBy(*spec.order).rowsBetween(-k, 0)
        return df.select("*", *exprs(w))
    base_cols = [c for c in df.columns if c != CHUNK]
    if spec.chunk_rows and not {CHUNK, START_COL} & set(df.columns):
        df = attach_chunk_widths(df, spec)
    d = chunked(df, spec)
    cut = F.col(START_COL).isNotNull() if START_COL in d.columns else F.lit(True)  # machines of several chunks
    w = _w_chunk(spec)
    p1 = d.select("*", F.row_number().over(w).alias("_rn"), *exprs(w.rowsBetween(-k, 0)))
    none_hot = START_COL in d.columns and not d.schema[START_COL].metadata.get("hot", True)
    if k == 0 or none_hot:  # every machine is one chunk: all rows are final
        return p1.select(*base_cols, *out_names)
    done = p1.filter(~cut | (F.col("_rn") > k)).select(*base_cols, *out_names)
    # first and last k rows of every chunk of a hot machine: small (<= 2k per chunk), materialised
    # once in the shared checkpoint folder so the halo joins do not rescan the data; only the
    # hot machines' rows are read for it
    edges = cut_lineage(d.filter(cut).select(*base_cols, CHUNK, F.row_number().over(w).alias("_rn"),
                                             F.count(F.lit(1)).over(Window.partitionBy(spec.machine, CHUNK)).alias("_n"))
                        .filter((F.col("_rn") <= k) | (F.col("_rn") > F.col("_n") - k)))
    heads = edges.filter(F.col("_rn") <= k).select(*base_cols, CHUNK, F.lit(False).alias("_halo"))
    tails = edges.filter(F.col("_rn") > F.col("_n") - k) \
                 .select(*base_cols, CHUNK, (F.col("_n") - F.col("_rn") + 1).alias("_rd"))
    halo = halo_from_tails(tails, spec, k, base_cols + [CHUNK]).withColumn("_halo", F.lit(True))
    fixed = heads.unionByName(halo).select("*", *exprs(_w_chunk(spec).rowsBetween(-k, 0))) \
                 .filter(~F.col("_halo")).select(*base_cols, *out_names)
    return done.unionByName(fixed)


# ---------------------------------------------------------------------------
# Two-level scans
# ---------------------------------------------------------------------------

def row_index(df: DataFrame, spec: ReadingSpec = RAW_SPEC, name: str = "row_idx") -> DataFrame:
    """0-based position of each row in its machine's history."""
    d = chunked(df, spec)
    m = spec.machine
    d = d.withColumn("_rn", F.row_number().over(_w_chunk(spec)))
    summ = d.groupBy(m, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    summ = summ.select(m, CHUNK, F.coalesce(F.sum("_n").over(_w_summary(spec).rowsBetween(UNB_PRE, -1)),
                                            F.lit(0)).alias("_before"))
    summ = cut_lineage(summ)
    return (_join_summary(d, summ, [m, CHUNK])
            .withColumn(name, (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_rn") - 1).cast("long"))
            .drop("_rn", "_before", CHUNK))


def every_nth(df: DataFrame, spec: ReadingSpec = RAW_SPEC, n: int = 4) -> DataFrame:
    """Keep rows 0, n, 2n, ... of each machine's history."""
    return row_index(df, spec, "_i").filter(F.col("_i") % n == 0).drop("_i")


def lifecycle(df: DataFrame, spec: ReadingSpec = RAW_SPEC, initial_age: int | Column = 0,
              initial_since_maint: int | Column = 0, rul_cap: float = RUL_CAP_HOURS,
              keep_chunk: bool = False) -> DataFrame:
    """Failure episodes, maintenance counter, age and RUL from a 0/1 failure flag.

    Adds, per machine in time order:

    * ``fail_start`` (E3) 1 on the first row of a failure episode, ``n_failures`` running count;
    * ``maint_edge`` (E4) 1 on the first non-failed row after an episode (corrective
      maintenance), ``n_maint`` running count, ``since_maint_h`` rows since the last
      maintenance, counting the reset row as 1 (before any: initial + index + 1);
    * ``age_h`` (E8) initial age + row index;
    * ``next_fail_ts`` and ``spec.rul`` (C3): hours to the next episode start strictly
      after the row, 720 when none, capped at 720;
    * ``spec.state`` (B9), ``spec.label24`` (B1) and ``degradation`` (B12).
    """
    m, f = spec.machine, spec.failed
    ts_dt = df.schema[spec.ts].dataType
    d = chunked(df, spec).withColumn("_f", F.coalesce(F.col(f).cast("int"), F.lit(0)))
    w = _w_chunk(spec)
    d = (d.withColumn("_rn", F.row_number().over(w))
          .withColumn("_pf", F.lag("_f").over(w)))
    # rows 2..n of a chunk know their predecessor locally
    d = (d.withColumn("_st_in", F.coalesce(((F.col("_f") == 1) & (F.col("_pf") == 0)).cast("int"), F.lit(0)))
          .withColumn("_en_in", F.coalesce(((F.col("_f") == 0) & (F.col("_pf") == 1)).cast("int"), F.lit(0))))
    summ = d.groupBy(m, CHUNK).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("_f", "_rn").alias("_ff"),
        F.max_by("_f", "_rn").alias("_lf"),
        F.min(spec.ts).alias("_t0"),
        F.sum("_st_in").alias("_st_n"),
        F.sum("_en_in").alias("_en_n"),
        F.max(F.when(F.col("_en_in") == 1, F.col("_rn"))).alias("_en_last"),
        F.min(F.when(F.col("_st_in") == 1, F.col(spec.ts))).alias("_st_t"),
    )
    ws = _w_summary(spec)
    pre = ws.rowsBetween(UNB_PRE, -1)
    summ = summ.withColumn("_carry_f", F.lag("_lf").over(ws))
    summ = (summ
            .withColumn("_st0", ((F.col("_ff") == 1) & (F.coalesce(F.col("_carry_f"), F.lit(0)) == 0)).cast("int"))
            .withColumn("_en0", F.coalesce(((F.col("_ff") == 0) & (F.col("_carry_f") == 1)).cast("int"), F.lit(0))))
    summ = (summ
            .withColumn("_before", F.coalesce(F.sum("_n").over(pre), F.lit(0)))
            .withColumn("_st_tot", F.col("_st_n") + F.col("_st0"))
            .withColumn("_en_tot", F.col("_en_n") + F.col("_en0"))
            .withColumn("_en_last_all", F.coalesce(F.col("_en_last"), F.when(F.col("_en0") == 1, F.lit(1))))
            .withColumn("_st_first", F.when(F.col("_st0") == 1, F.col("_t0")).otherwise(F.col("_st_t"))))
    summ = cut_lineage(summ.select(
        m, CHUNK, "_carry_f", "_before",
        F.coalesce(F.sum("_st_tot").over(pre), F.lit(0)).alias("_st_before"),
        F.coalesce(F.sum("_en_tot").over(pre), F.lit(0)).alias("_en_before"),
        F.max(F.col("_before") + F.col("_en_last_all") - 1).over(pre).alias("_reset_before"),
        F.min("_st_first").over(_w_summary(spec, desc=True).rowsBetween(UNB_PRE, -1)).alias("_next_st_after"),
    ))
    d = _join_summary(d, summ, [m, CHUNK]).fillna(0, ["_before", "_st_before", "_en_before"])
    pf = F.coalesce(F.col("_pf"), F.col("_carry_f"))
    idx = (F.col("_before") + F.col("_rn") - 1).cast("long")
    d = (d.withColumn("row_idx", idx)
          .withColumn("fail_start", ((F.col("_f") == 1) & (F.coalesce(pf, F.lit(0)) == 0)).cast("int"))
          .withColumn("maint_edge", ((F.col("_f") == 0) & (pf == 1)).cast("int"))
          .withColumn("maint_edge", F.coalesce("maint_edge", F.lit(0))))
    run = w.rowsBetween(UNB_PRE, 0)
    d = (d.withColumn("n_failures", (F.col("_st_before") + F.sum("fail_start").over(run)).cast("long"))
          .withColumn("n_maint", (F.col("_en_before") + F.sum("maint_edge").over(run)).cast("long"))
          .withColumn("_reset", F.greatest(F.col("_reset_before"),
                                           F.max(F.when(F.col("maint_edge") == 1, F.col("row_idx"))).over(run)))
          .withColumn("_next_local", F.min(F.when(F.col("fail_start") == 1, F.col(spec.ts)))
                      .over(_w_chunk(spec, desc=True).rowsBetween(UNB_PRE, -1))))
    init_age = initial_age if isinstance(initial_age, Column) else F.lit(initial_age)
    init_sm = initial_since_maint if isinstance(initial_since_maint, Column) else F.lit(initial_since_maint)
    next_ts = F.coalesce(F.col("_next_local"), F.col("_next_st_after"))
    d = (d.withColumn("since_maint_h", F.when(F.col("_reset").isNull(), init_sm + F.col("row_idx") + 1)
                      .otherwise(F.col("row_idx") - F.col("_reset") + 1).cast("long"))
          .withColumn("age_h", (init_age + F.col("row_idx")).cast("long"))
          .withColumn("next_fail_ts", next_ts.cast(ts_dt))
          .withColumn(spec.rul, F.least(F.coalesce(hours_between(spec.ts, "next_fail_ts"), F.lit(rul_cap)),
                                        F.lit(rul_cap))))
    d = (d.withColumn(spec.state, machine_state(F.col("_f"), F.col(spec.rul)))
          .withColumn(spec.label24, label_within(F.col(spec.rul)))
          .withColumn("degradation", degradation_score(spec.rul, "since_maint_h", rul_cap)))
    keep = {START_COL} | ({CHUNK} if keep_chunk else set())
    return d.drop(*[c for c in d.columns if c.startswith("_") and c not in keep])


# ---------------------------------------------------------------------------
# Top-k per machine (E6), first/last per machine (E5)
# ---------------------------------------------------------------------------

def last_n(df: DataFrame, spec: ReadingSpec = RAW_SPEC, n: int = 500, name: str = "recent_rank") -> DataFrame:
    """The ``n`` latest rows of every machine, with rank 1 = latest.

    Two stages: top n per (machine, chunk), then top n over the survivors, so no
    task ever sorts more than n x chunks rows of one machine.
    """
    d = chunked(df, spec)
    d = d.withColumn("_r1", F.row_number().over(_w_chunk(spec, desc=True))).filter(F.col("_r1") <= n)
    w2 = Window.partitionBy(spec.machine).orderBy(*[F.col(c).desc() for c in spec.order])
    return d.withColumn(name, F.row_number().over(w2)).filter(F.col(name) <= n).drop("_r1", CHUNK)


def first_last(df: DataFrame, spec: ReadingSpec = RAW_SPEC, first_cols=(), last_cols=()) -> DataFrame:
    """E5: per machine, value at the first and at the last row (aggregate, map-side combined)."""
    key = F.struct(*[F.col(c) for c in spec.order])
    aggs = [F.min_by(c, key).alias(f"first_{c}") for c in first_cols]
    aggs += [F.max_by(c, key).alias(f"last_{c}") for c in last_cols]
    return df.groupBy(spec.machine).agg(*aggs)


# ---------------------------------------------------------------------------
# Generic two-level scans over (machine, chunk) partitions
# ---------------------------------------------------------------------------

def scan(d: DataFrame, spec: ReadingSpec, specs, order=None) -> DataFrame:
    """Running aggregates per machine across chunks; ``d`` must carry ``CHUNK``.

    ``specs``: list of (source column, how, output name) with ``how`` in
    ``sum`` (running sum, current row included), ``max`` (running max) or
    ``next_min`` (min over the rows strictly after). One summary per chunk, one
    join back.
    """
    m = spec.machine
    order = order or spec.order
    w = Window.partitionBy(m, CHUNK).orderBy(*order)
    w_back = Window.partitionBy(m, CHUNK).orderBy(*[F.col(c).desc() for c in order])
    ws = _w_summary(spec)
    aggs, carries, locals_ = [], [], []
    for i, (src, how, name) in enumerate(specs):
        if how == "sum":
            aggs.append(F.sum(src).alias(f"_a{i}"))
            carries.append(F.coalesce(F.sum(f"_a{i}").over(ws.rowsBetween(UNB_PRE, -1)), F.lit(0)).alias(f"_k{i}"))
            locals_.append((F.sum(src).over(w.rowsBetween(UNB_PRE, 0))
                            + F.coalesce(F.col(f"_k{i}"), F.lit(0))).alias(name))
        elif how == "max":
            aggs.append(F.max(src).alias(f"_a{i}"))
            carries.append(F.max(f"_a{i}").over(ws.rowsBetween(UNB_PRE, -1)).alias(f"_k{i}"))
            locals_.append(F.greatest(F.max(src).over(w.rowsBetween(UNB_PRE, 0)), F.col(f"_k{i}")).alias(name))
        elif how == "next_min":
            aggs.append(F.min(src).alias(f"_a{i}"))
            carries.append(F.min(f"_a{i}").over(_w_summary(spec, desc=True).rowsBetween(UNB_PRE, -1)).alias(f"_k{i}"))
            locals_.append(F.coalesce(F.min(src).over(w_back.rowsBetween(UNB_PRE, -1)), F.col(f"_k{i}")).alias(name))
        else:
            raise ValueError(how)
    summ = cut_lineage(d.groupBy(m, CHUNK).agg(*aggs).select(m, CHUNK, *carries))
    j = _join_summary(d, summ, [m, CHUNK])
    return j.select(*d.columns, *locals_)
