"""Reproducible splits and samples (H1-H6) by hash order.

Rows are ordered by ``md5('<seed>|' || key)``. "The k first rows of a class" is
decided against the exact k-th hash of the class, found by bracket refinement
on a 52-bit numeric prefix of the hash (uniform, so buckets stay balanced);
ties on the prefix are settled on the full hash. No window ever spans a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .quantiles import kth_values

SEED = 42


def hash_key(*cols, seed: int = SEED) -> Column:
    """md5 of ``'<seed>|' || key`` (several key columns joined by ``|``)."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return F.md5(F.concat(F.lit(f"{seed}|"), key))


def _num(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double")  # 52 bits: exact in a double


def boundary_keys(df: DataFrame, h: str, groups, targets: DataFrame) -> DataFrame:
    """Exact hash of rank ``_k`` per (groups, ``_t``): returns groups, _t, _k, _bn, _bh."""
    g = list(groups)
    data = df.select(*g, F.col(h).alias("_h"), _num(F.col(h)).alias("_hn"))
    v = kth_values(data, "_hn", targets, g)                       # groups, _t, _v
    v = cut_lineage(targets.join(v, g + ["_t"]))
    b = broadcast_if_small(v)
    below = data.join(b, g).groupBy(*g, "_t").agg(F.count(F.when(F.col("_hn") < F.col("_v"), 1)).alias("_below"))
    ties = data.join(b, g).where(F.col("_hn") == F.col("_v"))
    w = Window.partitionBy(*g, "_t").orderBy("_h")
    ties = ties.withColumn("_tr", F.row_number().over(w)).join(below, g + ["_t"])
    pick = ties.where(F.col("_below") + F.col("_tr") == F.col("_k"))
    return pick.select(*g, "_t", "_k", F.col("_v").alias("_bn"), F.col("_h").alias("_bh"))


def rank_bucket(df: DataFrame, h: str, groups, ks: DataFrame, name: str) -> DataFrame:
    """Number of targets ``_t`` whose rank ``_k`` the row's hash rank exceeds.

    ``ks``: groups, ``_t``, ``_k``. All boundaries are found in one selection; each
    group's boundaries travel as one small array, compared with a higher-order
    ``filter`` (no row multiplication).
    """
    g = list(groups)
    keys = boundary_keys(df, h, g, ks.where(F.col("_k") > 0))
    allk = ks.join(keys.drop("_k"), g + ["_t"], "left")
    arr = allk.groupBy(*g).agg(F.collect_list(F.struct("_k", "_bn", "_bh")).alias("_bounds"))
    b = broadcast_if_small(arr)
    hn, hv = _num(F.col(h)), F.col(h)
    passed = F.filter("_bounds", lambda x: (x["_k"] <= 0) | (x["_bn"].isNotNull() & (
        (hn > x["_bn"]) | ((hn == x["_bn"]) & (hv > x["_bh"])))))
    return df.join(b, g, "left").withColumn(name, F.coalesce(F.size(passed), F.lit(0))).drop("_bounds")


def rank_at_most(df: DataFrame, h: str, groups, ks: DataFrame, name: str) -> DataFrame:
    """Flag rows whose hash rank within their group is <= ``_k`` (ks: groups, _k)."""
    out = rank_bucket(df, h, groups, ks.withColumn("_t", F.lit(0)), "_nb")
    return out.withColumn(name, F.col("_nb") == 0).drop("_nb")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))


def stratified_split(df: DataFrame, label: str, key, test_size: float = 0.2, seed: int = SEED,
                     name: str = "is_test") -> DataFrame:
    """H1: per class, the round(test_size * n_class) first rows by hash go to test."""
    d = df.withColumn("_hk", hash_key(*([key] if isinstance(key, str) else key), seed=seed))
    ks = class_counts(d, label).select(label, F.round(F.col("_n") * F.lit(test_size)).cast("long").alias("_k"))
    return rank_at_most(d, "_hk", [label], ks, name).drop("_hk")


def plain_split(df: DataFrame, key, test_size: float = 0.2, seed: int = SEED, name: str = "is_test") -> DataFrame:
    """H2: the ceil(test_size * n) first rows by hash go to test."""
    d = df.withColumn("_hk", hash_key(*([key] if isinstance(key, str) else key), seed=seed)).withColumn("_g", F.lit(0))
    ks = d.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) * F.lit(test_size)).cast("long").alias("_k"))
    return rank_at_most(d, "_hk", ["_g"], ks, name).drop("_hk", "_g")


def balance(df: DataFrame, label: str, key, seed: int = SEED) -> DataFrame:
    """H3: all positives plus as many negatives, the first by hash; error when the
    positives outnumber the negatives."""
    cnt = {r[label]: r["_n"] for r in class_counts(df, label).collect()}  # two rows
    n_pos, n_neg = cnt.get(1, 0), cnt.get(0, 0)
    if n_pos > n_neg:
        raise ValueError(f"cannot balance: {n_pos} positives > {n_neg} negatives")
    d = df.withColumn("_hk", hash_key(*([key] if isinstance(key, str) else key), seed=seed))
    ks = class_counts(d, label).select(label, F.when(F.col(label) == 1, F.col("_n"))
                                       .otherwise(F.lit(n_pos)).cast("long").alias("_k"))
    return rank_at_most(d, "_hk", [label], ks, "_keep").where("_keep").drop("_keep", "_hk")


def cap_rows(df: DataFrame, key, cap: int = 10_000, seed: int = SEED) -> DataFrame:
    """H4: at most ``cap`` rows (the first by hash), only when there are more."""
    d = df.withColumn("_hk", hash_key(*([key] if isinstance(key, str) else key), seed=seed)).withColumn("_g", F.lit(0))
    ks = d.groupBy("_g").agg(F.least(F.count(F.lit(1)), F.lit(cap)).cast("long").alias("_k"))
    return rank_at_most(d, "_hk", ["_g"], ks, "_keep").where("_keep").drop("_keep", "_hk", "_g")


def first_by_hash(df: DataFrame, key, n: int, seed: int = SEED) -> DataFrame:
    """Up to ``n`` rows, the first by hash: a distributed top-k (TakeOrderedAndProject)."""
    h = hash_key(*([key] if isinstance(key, str) else key), seed=seed)
    return df.withColumn("_hk", h).orderBy("_hk").limit(n).drop("_hk")


def demo_export(df: DataFrame, label: str, key, n_pos: int = 50, n_neg: int = 50, seed: int = SEED) -> DataFrame:
    """H5 + G1: up to n_pos failed rows and n_neg normal rows stacked (duplicates kept)."""
    pos = first_by_hash(df.where(F.col(label) == 1), key, n_pos, seed)
    neg = first_by_hash(df.where(F.col(label) == 0), key, n_neg, seed)
    return pos.unionByName(neg)


def stratified_folds(df: DataFrame, label: str, key, n_folds: int = 5, seed: int = SEED,
                     name: str = "fold") -> DataFrame:
    """H6: unshuffled stratified k-fold. Rows of a class, in hash order, are cut into
    contiguous runs; run sizes follow the class allocation of an unshuffled
    stratified k-fold (labels sorted, fold i takes positions i, i+k, ...)."""
    cnt = sorted((r[label], r["_n"]) for r in class_counts(df, label).collect())  # one row per class
    rows, offset = [], 0
    for cls, n in cnt:
        cum = 0
        for i in range(n_folds - 1):
            # positions j in [offset, offset + n) with j % n_folds == i
            cum += (offset + n - 1 - i) // n_folds - (offset - 1 - i) // n_folds
            rows.append((cls, i, cum))
        offset += n
    d = df.withColumn("_hk", hash_key(*([key] if isinstance(key, str) else key), seed=seed))
    ktab = d.sparkSession.createDataFrame(rows, f"{label} {dict(d.dtypes)[label]}, _t int, _k long")
    return rank_bucket(d, "_hk", [label], ktab, name).drop("_hk")
