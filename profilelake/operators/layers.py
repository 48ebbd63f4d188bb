"""Profile arrays to flat layers.

Input: one row per (source_file, profile_index). Level variables are arrays
(or one value per profile, which then applies to every level); characters may
arrive as strings, byte strings or character arrays.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilelake.functions.text import number_column, number_value, text_column, text_value
from profilelake.functions.times import (
    history_timestamp,
    reference_timestamp,
    round_to_second,
    with_decoded_time,
)
from profilelake.schemas import CALIBRATION_VARIABLES, METADATA_CLEAN_COLUMNS, VARIABLES

LINEAGE = ("source_file", "profile_index")


POSITION_BLOCK = 65_536


def with_profile_index(df: DataFrame, position: str, file_column: str = "source_file") -> DataFrame:
    """Rank of each profile inside its file, from 0, by its whole-number record
    position, where the input lacks the index.

    Positions are counted per block first, so a file with very many profiles is
    numbered by many tasks.
    """
    if "profile_index" in df.columns:
        return df
    blocked = df.withColumn("_block", F.floor(F.col(position) / POSITION_BLOCK))
    counts = blocked.groupBy(file_column, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(file_column).orderBy("_block")
    counts = counts.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).drop("_n")
    inside = Window.partitionBy(file_column, "_block").orderBy(position)
    return (
        blocked.join(counts, [file_column, "_block"])
        .withColumn("profile_index", (F.col("_before") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("_before", "_block")
    )


def _is_array(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType)


def _level_names(with_errors: bool) -> list[str]:
    names = []
    for v in VARIABLES:
        names += [v, f"{v}_QC", f"{v}_ADJUSTED"] + ([f"{v}_ADJUSTED_ERROR"] if with_errors else [])
    return names


def _explode_levels(df: DataFrame, time_column: str, with_errors: bool) -> DataFrame:
    """One row per (profile, level). The zip pads short arrays with null; a
    profile without any array has one level."""
    names = _level_names(with_errors)
    arrays = [n for n in names if _is_array(df, n)]
    keep = [
        F.col("source_file"),
        F.col("profile_index").cast("bigint").alias("profile_index"),
        text_column(df, "PLATFORM_NUMBER").alias("platform_number"),
        F.col(time_column).alias("juld"),
    ]
    scalars = [n for n in names if n in df.columns and n not in arrays]
    if arrays:
        grid = df.select(*keep, *scalars, F.posexplode_outer(F.arrays_zip(*arrays)).alias("_pos", "_level"))
        level = F.coalesce(F.col("_pos"), F.lit(0))
    else:
        grid, level = df.select(*keep, *scalars), F.lit(0)

    def value(name: str) -> Column:
        is_text = name.endswith("_QC")
        if name not in df.columns:
            return F.lit("") if is_text else F.lit(None).cast("double")
        c = F.col(f"_level.{name}") if name in arrays else F.col(name)
        dtype = df.schema[name].dataType
        dtype = dtype.elementType if name in arrays else dtype
        return text_value(c, dtype) if is_text else number_value(c, dtype)

    return grid.select(
        "source_file", "profile_index", "platform_number", "juld",
        level.cast("bigint").alias("level_index"),
        *[value(n).alias(n) for n in names],
    )


def core_measurements(df: DataFrame, time_column: str = "juld") -> DataFrame:
    """Levels with at least one of PRES, TEMP, PSAL present."""
    levels = _explode_levels(df, time_column, with_errors=False)
    return levels.where(F.coalesce(*VARIABLES).isNotNull())


def qc_per_level(df: DataFrame, time_column: str = "juld") -> DataFrame:
    """All levels, with adjusted errors."""
    return _explode_levels(df, time_column, with_errors=True)


def profile_qc_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.fullmatch(r"PROFILE_.*_QC", c)]


def qc_profile(df: DataFrame) -> DataFrame:
    """Per-profile flags: every PROFILE_*_QC column plus the two data-state columns."""
    names = profile_qc_columns(df) + ["DATA_MODE", "DATA_STATE_INDICATOR"]
    return df.select(*LINEAGE, *[text_column(df, n).alias(n) for n in names])


def qc_profile_layer(df: DataFrame) -> DataFrame:
    """:func:`qc_profile` in the stored form, open-ended flags as a map."""
    flags = profile_qc_columns(df)
    entries = [x for n in flags for x in (F.lit(n), text_column(df, n))]
    profile_map = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return df.select(
        *LINEAGE, text_column(df, "DATA_MODE").alias("DATA_MODE"),
        text_column(df, "DATA_STATE_INDICATOR").alias("DATA_STATE_INDICATOR"),
        profile_map.alias("profile_qc"))


def calibration(df: DataFrame) -> DataFrame:
    """Calibration variables that exist, one row per (profile, variable)."""
    present = [v for v in CALIBRATION_VARIABLES if v in df.columns]
    texts = df.select(*LINEAGE, *[text_column(df, v).alias(v) for v in present])
    return texts.unpivot(list(LINEAGE), present, "variable", "value")


# Fields of a history record, and those holding numbers.
HISTORY_FIELDS = (
    "HISTORY_DATE", "HISTORY_ACTION", "HISTORY_INSTITUTION", "HISTORY_SOFTWARE",
    "HISTORY_SOFTWARE_RELEASE", "HISTORY_REFERENCE", "HISTORY_PARAMETER", "HISTORY_QCTEST",
    "HISTORY_PREVIOUS_VALUE", "HISTORY_START_PRES", "HISTORY_STOP_PRES", "HISTORY_STEP",
)
HISTORY_NUMBERS = ("HISTORY_PREVIOUS_VALUE", "HISTORY_START_PRES", "HISTORY_STOP_PRES")


def history(df: DataFrame) -> DataFrame:
    """History records times profiles.

    A field given as an array holds one value per history record; a field given
    as one value applies to every record of the profile; an absent field is ''.
    """
    arrays = [f for f in HISTORY_FIELDS if _is_array(df, f)]
    scalars = [f for f in HISTORY_FIELDS if f in df.columns and f not in arrays]
    grid = df.select(
        *LINEAGE, text_column(df, "PLATFORM_NUMBER").alias("platform_number"), *scalars,
        F.posexplode(F.arrays_zip(*arrays)).alias("history_index", "_record"))

    def value(name: str) -> Column:
        if name not in df.columns:
            if name in HISTORY_NUMBERS:
                return F.lit(None).cast("double")
            return F.lit(None).cast("timestamp") if name == "HISTORY_DATE" else F.lit("")
        c = F.col(f"_record.{name}") if name in arrays else F.col(name)
        dtype = df.schema[name].dataType
        dtype = dtype.elementType if name in arrays else dtype
        if name == "HISTORY_DATE":
            return history_timestamp(text_value(c, dtype))
        if name in HISTORY_NUMBERS:
            return number_value(c, dtype)
        return text_value(c, dtype)

    return grid.select(
        *LINEAGE, F.col("history_index").cast("bigint").alias("history_index"), "platform_number",
        *[value(f).alias(f) for f in HISTORY_FIELDS])


MAX_TEXT_WIDTH = 512
MAX_NUMBER_WIDTH = 8


def _width_limits(df: DataFrame) -> dict[str, int]:
    """Longest array that still counts as one value, of each array column of numbers or characters."""
    limits = {}
    for c in df.columns:
        if c not in LINEAGE and _is_array(df, c):
            element = df.schema[c].dataType.elementType
            if isinstance(element, (T.NumericType, T.StringType, T.BinaryType)):
                limits[c] = MAX_NUMBER_WIDTH if isinstance(element, T.NumericType) else MAX_TEXT_WIDTH
    return limits


def _narrow_files(df: DataFrame) -> DataFrame:
    """source_file and, for each array column of numbers or characters, whether all of the file's arrays are within the limit."""
    widths = [(F.coalesce(F.max(F.size(c)), F.lit(0)) <= limit).alias(c) for c, limit in _width_limits(df).items()]
    return df.groupBy("source_file").agg(*widths)


def metadata_columns(df: DataFrame) -> list[str]:
    """Columns with one value per profile in some file: scalars, character arrays
    up to 512 long and numeric arrays up to 8 long (widths from one aggregate)."""
    limits, fitting = _width_limits(df), {}
    if limits:
        fitting = _narrow_files(df).agg(*[F.max(c).alias(c) for c in limits]).first().asDict()
        fitting = {c: fits is not False for c, fits in fitting.items()}     # without files nothing is too wide

    def fits(name: str) -> bool:
        dtype = df.schema[name].dataType
        if isinstance(dtype, (T.MapType, T.StructType)):
            return False
        return fitting.get(name, False) if isinstance(dtype, T.ArrayType) else True

    return [n for n in df.columns if n not in LINEAGE and fits(n)]


def metadata_full(df: DataFrame, file_values: DataFrame | None = None) -> DataFrame:
    """Every per-profile variable as text. ``file_values`` holds variables with
    one value per file; they are repeated for the file's profiles by a join on
    source_file.

    Which arrays are per-profile values is decided file by file: a column that is
    too wide in one file has null there and its values in the others.
    """
    names = metadata_columns(df)
    arrays = [n for n in names if _is_array(df, n)]
    texts = {n: text_column(df, n) for n in names}
    if arrays:
        # only files with a column too wide are joined
        wide = _narrow_files(df).select(F.col("source_file").alias("_file"), F.struct(*arrays).alias("_narrow")).where(
            ~F.least(*[F.col(f"_narrow.{n}") for n in arrays], F.lit(True)))
        df = df.join(wide, F.col("source_file").eqNullSafe(F.col("_file")), "left")
        texts |= {n: F.when(F.coalesce(F.col(f"_narrow.{n}"), F.lit(True)), texts[n]) for n in arrays}
    full = df.select(*LINEAGE, *[t.alias(n) for n, t in texts.items()])
    if file_values is None:
        return full
    extra = [c for c in file_values.columns if c != "source_file" and c not in names]
    texts = file_values.select("source_file", *[text_column(file_values, c).alias(c) for c in extra])
    filled = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in extra]
    return full.join(texts, "source_file", "left").select(*full.columns, *filled)


def metadata_clean(full: DataFrame) -> DataFrame:
    """The presentation columns that exist, in their fixed order."""
    return full.select(*[c for c in METADATA_CLEAN_COLUMNS if c in full.columns])


def time_location(df: DataFrame, *, units: str | None = None, reference: str | None = "REFERENCE_DATE_TIME") -> DataFrame:
    """Position, decoded times to the second, and identifying texts."""
    reference = reference if reference in df.columns else None
    for name in ("JULD", "JULD_LOCATION"):
        if name in df.columns:
            df = with_decoded_time(df, name, f"_{name}", units=units, reference=reference)
        else:
            df = df.withColumn(f"_{name}", F.lit(None).cast("timestamp"))
    ref = reference_timestamp(F.col(reference)) if reference else F.lit(None).cast("timestamp")
    texts = ("POSITION_QC", "POSITIONING_SYSTEM", "DIRECTION", "PLATFORM_NUMBER", "PROJECT_NAME", "PI_NAME")
    return df.select(
        *LINEAGE,
        number_column(df, "LATITUDE").alias("LATITUDE"),
        number_column(df, "LONGITUDE").alias("LONGITUDE"),
        round_to_second(F.col("_JULD")).alias("JULD"),
        round_to_second(F.col("_JULD_LOCATION")).alias("JULD_LOCATION"),
        ref.alias("REFERENCE_DATE_TIME"),
        *[text_column(df, t).alias(t) for t in texts],
    )
