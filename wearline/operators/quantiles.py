"""Exact order statistics without sending a group to one task.

``kth_values`` finds, per group, the value of rank ``k`` (1-based, ascending)
by bracket refinement: each round counts rows per (group, target, bucket) with
an ordinary aggregate, keeps only the bucket that holds the wanted rank, and
repeats on the rows inside it. A bracket of one distinct value is the answer; one
of few rows is ranked with a window over those rows only. Every round is a
scan plus a small aggregate; memory never depends on the group size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage

BUCKETS = 4096
FINISH_ROWS = 200_000
MAX_ROUNDS = 200  # a bracket shrinks 4096-fold a round: the whole range of doubles takes 175


def kth_values(df: DataFrame, value: str, targets: DataFrame, group_cols=(), ) -> DataFrame:
    """``targets``: group cols + ``_t`` (target id) + ``_k`` (rank, 1-based).

    Returns group cols + ``_t`` + ``_v`` (the value of rank ``_k``); ``value`` must be
    numeric and non-null in ``df`` (filter first).
    """
    g = list(group_cols)
    added = not g
    if added:  # one constant group: an equi-join on it, never a cross join
        df, targets, g = df.withColumn("_all", F.lit(0)), targets.withColumn("_all", F.lit(0)), ["_all"]
    data = df.select(*g, F.col(value).cast("double").alias("_x"))
    # bracket per target: [lo, hi] with `_below` rows strictly under lo
    bounds = data.groupBy(*g).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
                                  F.count(F.lit(1)).alias("_cnt"))
    br = cut_lineage(targets.join(bounds, g, "inner").withColumn("_below", F.lit(0).cast("long")))
    closed = None
    for _ in range(MAX_ROUNDS):
        # one value left: that is the answer, however many rows share it
        done = br.where(F.col("_lo") == F.col("_hi")).select(*g, "_t", F.col("_lo").alias("_v"))
        closed = done if closed is None else closed.unionByName(done)
        br = br.where(F.col("_lo") < F.col("_hi"))
        if (br.agg(F.max("_cnt")).first()[0] or 0) <= FINISH_ROWS:
            break
        b = broadcast_if_small(br.drop("_cnt"))
        inside = data.join(b, g, "inner").where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
        width = F.col("_hi") - F.col("_lo")
        bucket = F.least(F.floor((F.col("_x") - F.col("_lo")) / width * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        cnt = inside.groupBy(*g, "_t", "_k", "_below", "_lo", "_hi", bucket.alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_bmin"), F.max("_x").alias("_bmax"))
        w = Window.partitionBy(*g, "_t").orderBy("_b")
        cnt = cnt.withColumn("_cum", F.col("_below") + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        pick = cnt.where((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_c") < F.col("_k")))
        br = cut_lineage(pick.select(*g, "_t", "_k", (F.col("_cum") - F.col("_c")).alias("_below"),
                                     F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi"), F.col("_c").alias("_cnt")))
    else:
        raise RuntimeError(f"kth_values: brackets still open after {MAX_ROUNDS} rounds")
    br = br.drop("_cnt")
    # finish: rank the rows inside each (small) bracket
    b = broadcast_if_small(br)
    inside = data.join(b, g, "inner").where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
    w = Window.partitionBy(*g, "_t").orderBy("_x")
    ranked = inside.withColumn("_r", F.col("_below") + F.row_number().over(w))
    out = ranked.where(F.col("_r") == F.col("_k")).select(*g, "_t", F.col("_x").alias("_v"))
    out = out.unionByName(closed)
    return out.drop("_all") if added else out


def percentiles(df: DataFrame, value: str, probs, group_cols=()) -> DataFrame:
    """Exact linear-interpolated percentiles (pandas / ``quantile_cont`` rule).

    Returns group cols + one column ``p<100*prob>`` per prob, nulls skipped.
    """
    g = list(group_cols)
    data = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if not g:
        data, g = data.withColumn("_all", F.lit(0)), ["_all"]
    data = cut_lineage(data.select(*g, value))  # read once more in every round
    n = data.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    rows = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        rows.append(F.struct(F.lit(i).alias("_i"), pos.alias("_pos")))
    t = n.select(*g, "_n", F.explode(F.array(*rows)).alias("_s")).select(*g, "_n", "_s._i", "_s._pos")
    t = t.select(*g, "_i", "_pos", F.floor("_pos").cast("long").alias("_lo_r"),
                 F.ceil("_pos").cast("long").alias("_hi_r"))
    targets = (t.select(*g, (F.col("_i") * 2).alias("_t"), (F.col("_lo_r") + 1).alias("_k"))
               .unionByName(t.select(*g, (F.col("_i") * 2 + 1).alias("_t"), (F.col("_hi_r") + 1).alias("_k"))))
    vals = kth_values(data, value, targets, g)
    lo = vals.where(F.col("_t") % 2 == 0).select(*g, (F.col("_t") / 2).cast("int").alias("_i"), F.col("_v").alias("_vlo"))
    hi = vals.where(F.col("_t") % 2 == 1).select(*g, ((F.col("_t") - 1) / 2).cast("int").alias("_i"), F.col("_v").alias("_vhi"))
    j = t.join(lo, g + ["_i"]).join(hi, g + ["_i"])
    frac = F.col("_pos") - F.col("_lo_r")
    j = j.withColumn("_q", F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac)
    names = {i: f"p{round(100 * p)}" for i, p in enumerate(probs)}
    out = j.groupBy(*g).pivot("_i", list(names)).agg(F.first("_q"))
    for i, nm in names.items():
        out = out.withColumnRenamed(str(i), nm)
    return out.drop("_all") if g == ["_all"] else out
