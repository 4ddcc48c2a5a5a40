"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.session import broadcast_if_small, cut_lineage, ensure_checkpoint_dir, table

__all__ = ["WORD", "SPACES", "broadcast_if_small", "connected_components", "cut_lineage", "numbered_within", "ranked", "row_keyed",
           "scratch_table", "table", "word_count"]

#: A word: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that ends a word.
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words of the whole text as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def scratch_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_keyed(df: DataFrame) -> DataFrame:
    """``__file, __place, _row``: each row of ``df`` as a struct, whatever its columns are called, with a key of two longs.

    The key is the Parquet file (hashed path) and the row's place in it, so the same
    row gets the same key in every pass and repeated rows stay apart. A frame that does
    not come straight from Parquet files, or has a column ``_metadata`` of its own, is written to the shared folder first.
    """
    def keyed(d: DataFrame) -> DataFrame:
        row = F.struct(*[F.col(_quoted(a)).alias(b) for a, b in zip(d.columns, df.columns, strict=True)])
        return d.select(F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"), row.alias("_row"))
    if "_metadata" not in (c.lower() for c in df.columns):
        try:
            out = keyed(df)
            out.schema
            return out
        except AnalysisException:
            pass
    return keyed(scratch_table(df.toDF(*[f"c{i}" for i in range(len(df.columns))])))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name`` = position (from 0) in the total order, without a one-task window.

    Rows are range-partitioned and materialised, numbered inside each partition, and
    shifted by the row counts of the partitions before (one number per partition).
    """
    from pyspark.sql import Window

    cols = df.columns
    placed = cut_lineage(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sizes = {r["_pid"]: r["count"] for r in placed.groupBy("_pid").count().collect()}  # a row per partition
    shift, total = [], 0
    for pid in sorted(sizes):
        shift.append((pid, total))
        total += sizes[pid]
    spark = df.sparkSession
    shifts = spark.createDataFrame(shift or [(0, 0)], "_pid int, _shift long")
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return (placed.withColumn("_local", local).join(F.broadcast(shifts), "_pid")
            .select(*cols, (F.col("_local") + F.col("_shift")).cast("long").alias(name)))


def numbered_within(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, the row's number (from 0) in its group by ``order``; ``group`` is a text column without nulls.

    Rows are range-partitioned by group and order and counted where they lie. What a group that began in
    an earlier partition brings along is one number per partition, so a group with a third of all rows is no single task.
    """
    kept = [group, *[c for c in rows.columns if c != group]]
    rows = cut_lineage(rows.select(*kept).withColumn("_uid", F.monotonically_increasing_id()))
    by = [group, *order, "_uid"]  # the row's number splits copies of one key
    placed = cut_lineage(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_uid").withColumn("_pid", F.spark_partition_id()))
    runs = placed.groupBy("_pid", group).agg(F.count(F.lit(1)).alias("n"))
    ends = runs.groupBy("_pid").agg(F.min(group).alias("first"), F.min_by("n", group).alias("n_first"),
                                    F.max(group).alias("last"), F.max_by("n", group).alias("n_last")).collect()  # a row per partition
    carried, open_group, n = {}, None, 0
    for e in sorted(ends, key=lambda r: r["_pid"]):
        carried[e["_pid"]] = n if e["first"] == open_group else 0
        n = e["n_last"] + (carried[e["_pid"]] if e["first"] == e["last"] else 0)
        open_group = e["last"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if here is None:
                at = carried[batch.column(batch.num_columns - 1)[0].as_py()]
            places = []
            for g in batch.column(0).to_pylist():
                if g != here:
                    at = at if here is None else 0
                    here = g
                places.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(places, pa.int64())], [*batch.schema.names[:-1], name])

    fields = ", ".join(f"{_quoted(c)} {placed.schema[c].dataType.simpleString()}" for c in kept)
    return placed.select(*kept, "_pid").mapInArrow(number, f"{fields}, {_quoted(name)} long")


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Components of an undirected graph: ``edges(a, b)`` of longs -> ``(node, root)``.

    Every round each node takes the least name (by that round's hash) within two steps and
    the graph is contracted to the names taken: stars vanish at once and long chains shrink
    by a constant share. Nothing but node and edge tables is ever moved, and minima are
    aggregated before the shuffle, so a hub with many edges is no single task.
    ``root`` is some node of the component.
    """
    edges = cut_lineage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root"))
    for i in range(max_rounds):
        if edges.isEmpty():
            return cut_lineage(labels)
        name = lambda c: F.struct(F.xxhash64(F.lit(i), F.col(c)).alias("h"), F.col(c).alias("v"))
        both = edges.union(edges.select("b", "a"))
        # written out, so that the join reads two plain shuffles and a hub's edges can be split
        near = cut_lineage(both.groupBy("a").agg(F.min(name("b")).alias("m")).select("a", F.least("m", name("a")).alias("m")))
        far = both.join(near.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b").groupBy("a").agg(F.min("mb").alias("mb"))
        step = cut_lineage(near.join(far, "a").select(F.col("a").alias("v"), F.least("m", "mb")["v"].alias("to")))
        labels = labels.join(step, labels["root"] == step["v"], "left").select("node", F.coalesce("to", "root").alias("root"))
        s1, s2 = step.select(F.col("v").alias("a"), F.col("to").alias("ta")), step.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        edges = cut_lineage(edges.join(s1, "a").join(s2, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
                            .where("a <> b").distinct())
    raise RuntimeError(f"connected_components: edges left after {max_rounds} rounds")
