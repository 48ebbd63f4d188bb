"""Layer schemas and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()
_MAP = T.MapType(_S, _S)


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns.items()])


VARIABLES = ("PRES", "TEMP", "PSAL")

CORE = _schema(
    profile_index=_L, platform_number=_L, juld=_TS, level_index=_L,
    PRES=_D, TEMP=_D, PSAL=_D,
    PRES_QC=_S, PRES_ADJUSTED=_D, TEMP_QC=_S, TEMP_ADJUSTED=_D, PSAL_QC=_S, PSAL_ADJUSTED=_D,
)
QC_PER_LEVEL = T.StructType(
    CORE.fields + [T.StructField(f"{v}_ADJUSTED_ERROR", _D, True) for v in VARIABLES]
)
QC_PROFILE = _schema(profile_index=_L, DATA_MODE=_S, DATA_STATE_INDICATOR=_S, profile_qc=_MAP)
CALIBRATION = _schema(profile_index=_L, variable=_S, value=_S)
HISTORY = _schema(
    profile_index=_L, history_index=_L, platform_number=_L, HISTORY_DATE=_TS,
    HISTORY_ACTION=_S, HISTORY_INSTITUTION=_S, HISTORY_SOFTWARE=_S, HISTORY_SOFTWARE_RELEASE=_S,
    HISTORY_REFERENCE=_S, HISTORY_PARAMETER=_S, HISTORY_QCTEST=_S,
    HISTORY_PREVIOUS_VALUE=_D, HISTORY_START_PRES=_D, HISTORY_STOP_PRES=_D, HISTORY_STEP=_S,
)
METADATA_CLEAN = _schema(
    PLATFORM_NUMBER=_L, FLOAT_SERIAL_NO=_S, PLATFORM_TYPE=_S, WMO_INST_TYPE=_L,
    PROJECT_NAME=_S, PI_NAME=_S, DATA_CENTRE=_S, FORMAT_VERSION=_D, HANDBOOK_VERSION=_D,
    FIRMWARE_VERSION=_S, CONFIG_MISSION_NUMBER=_L,
)
METADATA_FULL = T.StructType(
    METADATA_CLEAN.fields
    + [T.StructField("REFERENCE_DATE_TIME", _TS, True), T.StructField("extra", _MAP, True)]
)
TIME_LOCATION = _schema(
    profile_index=_L, LATITUDE=_D, LONGITUDE=_D, JULD=_TS, JULD_LOCATION=_TS,
    REFERENCE_DATE_TIME=_TS, POSITION_QC=_S, POSITIONING_SYSTEM=_S, DIRECTION=_S,
    PLATFORM_NUMBER=_L, PROJECT_NAME=_S, PI_NAME=_S,
)

LAYERS = {
    "core_measurements": CORE,
    "qc_per_level": QC_PER_LEVEL,
    "qc_profile": QC_PROFILE,
    "metadata_clean": METADATA_CLEAN,
    "metadata_full": METADATA_FULL,
    "time_location": TIME_LOCATION,
    "calibration": CALIBRATION,
    "history": HISTORY,
}

# Columns whose missing rate is reported per layer.
CRITICAL_COLUMNS = {
    "core_measurements": ("profile_index", "PRES", "TEMP", "PSAL"),
    "qc_per_level": ("profile_index", "PRES", "TEMP", "PSAL"),
    "time_location": ("profile_index", "LATITUDE", "LONGITUDE", "JULD"),
    "metadata_clean": ("PLATFORM_NUMBER",),
    "metadata_full": ("PLATFORM_NUMBER",),
    "qc_profile": ("profile_index", "DATA_MODE"),
    "calibration": ("profile_index", "variable", "value"),
    "history": ("profile_index", "HISTORY_ACTION", "HISTORY_DATE"),
}

# Layer file names are <prefix><layer>*.csv or .csv.gz.
LAYER_FILE_PREFIX = "argo_"

# Columns a measurement fetch returns, in this order, when the layer has them.
FETCH_COLUMNS = (
    "platform_number", "profile_index", "juld", "level_index",
    "PRES", "TEMP", "PSAL", "PRES_QC", "TEMP_QC", "PSAL_QC",
    "PRES_ADJUSTED", "TEMP_ADJUSTED", "PSAL_ADJUSTED",
)

# Canonical metadata column -> accepted spellings, best first (any case).
METADATA_ALIASES = {
    "platform_number": ("platform_number", "platform"),
    "project_name": ("project_name", "project"),
    "pi_name": ("pi_name", "pi", "investigator"),
    "wmo_inst_type": ("wmo_inst_type", "wmo"),
    "float_serial_no": ("float_serial_no", "float_serial", "serial_number"),
    "format_version": ("format_version",),
    "handbook_version": ("handbook_version",),
    "firmware_version": ("firmware_version",),
    "config_mission_number": ("config_mission_number",),
    "reference_date_time": ("reference_date_time", "ref_date"),
}

# Columns of the presentation subset of the metadata layer.
METADATA_CLEAN_COLUMNS = tuple(f.name for f in METADATA_CLEAN.fields)

# Variables unpivoted into the calibration layer.
CALIBRATION_VARIABLES = (
    "SCIENTIFIC_CALIB_EQUATION", "SCIENTIFIC_CALIB_COEFFICIENT",
    "SCIENTIFIC_CALIB_COMMENT", "SCIENTIFIC_CALIB_DATE",
)

# Output limits.
MAX_TABLE_ROWS = 200
MAX_CHART_POINTS = 200
FETCH_CAP = 500
CONTEXT_TOKENS = 12_000
