"""Column roles of a machine-reading table.

Every operator takes a :class:`ReadingSpec` instead of hard-coded names, so the
same code runs on the raw sensor schema (the defaults) and on any other table
mapped onto the roles (``EVENTS_SPEC`` for the driver's ``events`` table).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names, categories and ranges of the sensor data model.
# ---------------------------------------------------------------------------
SENSOR_COLS = ("temperature_C", "vibration_mm_s", "courant_A", "pression_bar", "vitesse_tr_min")
CONTEXT_COLS = ("age_machine_h", "h_depuis_maintenance")
ENCODED_COLS = ("type_machine_encoded", "usine_encoded")
# the nine model features, in this order (rolling features are not features)
FEATURE_COLS = SENSOR_COLS + CONTEXT_COLS + ENCODED_COLS
MACHINE_TYPES = ("CNC-Fraisage", "CNC-Tournage", "Découpe-Laser", "Centre-Usinage")
SITES = ("USN-FR-01", "USN-FR-02", "USN-FR-03", "USN-ES-01", "USN-ES-02")
DEFAULT_TYPE = "CNC-Fraisage"
DEFAULT_SITE = "USN-FR-01"
STATES = ("normal", "a_risque", "critique", "en_panne")
# category column -> column of its code
ENCODED = {"type_machine": "type_machine_encoded", "usine_id": "usine_encoded"}
ROLLING_WINDOW = 24
RUL_CAP_HOURS = 720.0


@dataclass(frozen=True)
class ReadingSpec:
    machine: str = "machine_id"
    ts: str = "timestamp"
    tie: str | None = None          # extra ordering key when ts can repeat
    sensors: tuple[str, ...] = SENSOR_COLS
    failed: str = "en_panne"        # 0/1 failure flag
    site: str = "usine_id"
    mtype: str = "type_machine"
    rul: str = "rul_heures"
    state: str = "etat_machine"
    label24: str = "panne_dans_24h"
    features: tuple[str, ...] = FEATURE_COLS
    # width of the time chunks that split one machine's history over tasks;
    # pick it so a chunk holds many more rows than the rolling window
    chunk_seconds: int = 30 * 86_400
    # a machine with more rows than this is cut into chunks of about this many rows
    chunk_rows: int | None = 5_000_000
    # least width of the bins in which its rows are counted first; crowded bins are divided further
    min_chunk_seconds: int = 3600
    extra: dict = field(default_factory=dict)

    @property
    def order(self) -> list[str]:
        return [self.ts] + ([self.tie] if self.tie else [])

    def with_(self, **kw) -> "ReadingSpec":
        return replace(self, **kw)


RAW_SPEC = ReadingSpec()

# The driver's ``events`` table mapped onto the roles: machine = user_id,
# time = ts, tie = event_id, sensors = value and props.k, failure = 'error'.
EVENTS_SPEC = ReadingSpec(
    machine="user_id", ts="ts", tie="event_id", sensors=("value", "k"),
    failed="failed", site="site", mtype="mtype", rul="rul", state="state",
    label24="fail_24h", chunk_seconds=7 * 86_400,
    features=("value", "k", "age_h", "since_maint_h", "mtype_code", "site_code"),
)

RAW_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("usine_id", T.StringType()),
    T.StructField("machine_id", T.StringType()),
    T.StructField("type_machine", T.StringType()),
    T.StructField("age_machine_h", T.IntegerType()),
    T.StructField("h_depuis_maintenance", T.IntegerType()),
    T.StructField("temperature_C", T.DoubleType()),
    T.StructField("vibration_mm_s", T.DoubleType()),
    T.StructField("courant_A", T.DoubleType()),
    T.StructField("pression_bar", T.DoubleType()),
    T.StructField("vitesse_tr_min", T.DoubleType()),
    T.StructField("score_degradation", T.DoubleType()),
    T.StructField("rul_heures", T.DoubleType()),
    T.StructField("etat_machine", T.StringType()),
    T.StructField("en_panne", T.IntegerType()),
    T.StructField("nb_pannes_total", T.IntegerType()),
    T.StructField("nb_maintenances_total", T.IntegerType()),
])

REQUEST_SCHEMA = T.StructType([
    T.StructField("temperature_C", T.DoubleType()),
    T.StructField("vibration_mm_s", T.DoubleType()),
    T.StructField("courant_A", T.DoubleType()),
    T.StructField("pression_bar", T.DoubleType()),
    T.StructField("vitesse_tr_min", T.DoubleType()),
    T.StructField("age_machine_h", T.LongType()),
    T.StructField("h_depuis_maintenance", T.LongType()),
    T.StructField("type_machine", T.StringType()),
    T.StructField("usine_id", T.StringType()),
])

# Failure-event tables (telemetry, errors, failures, machines, maint) and the
# single-table failure data, read by the exploration notebook.
TELEMETRY_SCHEMA = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("machineID", T.IntegerType()),
    T.StructField("volt", T.DoubleType()),
    T.StructField("rotate", T.DoubleType()),
    T.StructField("pressure", T.DoubleType()),
    T.StructField("vibration", T.DoubleType()),
])
ERRORS_SCHEMA = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("machineID", T.IntegerType()),
    T.StructField("errorID", T.StringType()),
])
FAILURES_SCHEMA = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("machineID", T.IntegerType()),
    T.StructField("failure", T.StringType()),
])
MACHINES_SCHEMA = T.StructType([
    T.StructField("machineID", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("age", T.IntegerType()),
])
MAINT_SCHEMA = T.StructType([
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("machineID", T.IntegerType()),
    T.StructField("comp", T.StringType()),
])
# one row per observation, with the failure flag and one flag per kind of failure
FAILURE_KINDS = ("TWF", "HDF", "PWF", "OSF", "RNF")
SINGLE_TABLE_SCHEMA = T.StructType([
    T.StructField("UDI", T.IntegerType()),
    T.StructField("Product ID", T.StringType()),
    T.StructField("Type", T.StringType()),
    T.StructField("Air temperature [K]", T.DoubleType()),
    T.StructField("Process temperature [K]", T.DoubleType()),
    T.StructField("Rotational speed [rpm]", T.IntegerType()),
    T.StructField("Torque [Nm]", T.DoubleType()),
    T.StructField("Tool wear [min]", T.IntegerType()),
    T.StructField("Machine failure", T.IntegerType()),
    *[T.StructField(k, T.IntegerType()) for k in FAILURE_KINDS],
])
EVENT_TABLE_SCHEMAS = {
    "telemetry": TELEMETRY_SCHEMA, "errors": ERRORS_SCHEMA, "failures": FAILURES_SCHEMA,
    "machines": MACHINES_SCHEMA, "maint": MAINT_SCHEMA, "single": SINGLE_TABLE_SCHEMA,
}
