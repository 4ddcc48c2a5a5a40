"""The driver's ``events`` table seen as machine readings.

Role mapping (see ``EVENTS_SPEC``): machine = ``user_id``, time = ``ts``,
tie-break = ``event_id``; sensors = ``value`` and ``props.k``; the failure
flag is ``event_type = 'error'``; site and machine type are derived from the
machine number. Every registered query starts from this projection, so Spark
prunes the scan to the columns each query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

N_SITES, N_TYPES = 5, 4


def readings_from_events(ev: DataFrame) -> DataFrame:
    return ev.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.when(F.col("event_type") == "error", F.lit(1)).otherwise(F.lit(0)).alias("failed"),
        F.concat(F.lit("S"), (F.col("user_id") % N_SITES).cast("string")).alias("site"),
        F.concat(F.lit("T"), (F.col("user_id") % N_TYPES).cast("string")).alias("mtype"),
    )


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_events(table(spark, sf_dir, "events"))


# The same projection in DuckDB SQL, used by the oracle queries.
READINGS_CTE = """r AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed,
         'S' || CAST(user_id % 5 AS VARCHAR) AS site,
         'T' || CAST(user_id % 4 AS VARCHAR) AS mtype
  FROM events)"""
