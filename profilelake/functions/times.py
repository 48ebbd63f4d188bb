"""Column expressions for timestamps. All results are UTC (see ``session.configure``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilelake.functions.text import matched, strip

DAY_MICROS = 86_400_000_000
EPOCH_1950 = "1950-01-01 00:00:00"


def _format(s: Column, fmt: str) -> Column:
    return F.try_to_timestamp(s, F.lit(fmt))


def generic_timestamp(s: Column) -> Column:
    """ISO-like text, with or without zone (+0200 or +02:00); anything else null."""
    colon = F.regexp_replace(strip(s), r"(:[0-9]{2}(?:\.[0-9]+)?[+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return colon.try_cast("timestamp")


def _digits(s: Column) -> Column:
    # Padding 8 and 12 digits to 14 leaves one unambiguous format.
    return F.when(s.rlike("^([0-9]{8}|[0-9]{12}|[0-9]{14})$"), _format(F.rpad(s, 14, "0"), "yyyyMMddHHmmss"))


def reference_timestamp(c: Column) -> Column:
    """yyyyMMdd[HHmm[ss]] digits, else ISO text; blank or unreadable gives null."""
    s = strip(c.cast("string"))
    return F.when(s.rlike("^[0-9]+$"), _digits(s)).otherwise(generic_timestamp(s))


# History dates follow the same rule: 14, 12 or 8 digits, else ISO text.
history_timestamp = reference_timestamp


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def add_days(base: Column, days: Column) -> Column:
    return F.timestamp_micros(_micros(base) + F.round(days * F.lit(float(DAY_MICROS))).cast("bigint"))


def add_seconds(base: Column, seconds: Column) -> Column:
    return F.timestamp_micros(_micros(base) + F.round(seconds * F.lit(1e6)).cast("bigint"))


def numeric_timestamp(value: Column, units: Column, reference: Column, mean_abs: Column) -> Column:
    """Timestamp of a numeric time variable.

    ``units`` ("days since ..." / "seconds since ...") wins; else ``reference``
    plus days, or epoch seconds when the mean magnitude of the file's values
    exceeds 1e6; else days since 1950-01-01.
    """
    value = F.nullif(value.cast("double"), F.lit(float("nan")))
    base = generic_timestamp(matched(units, r"since\s*(.*)$", 1))
    lower = F.lower(units)
    by_units = (
        F.when(base.isNotNull() & lower.contains("day"), add_days(base, value))
        .when(base.isNotNull() & lower.contains("sec"), add_seconds(base, value))
    )
    epoch = F.timestamp_micros(F.round(value * F.lit(1e6)).cast("bigint"))
    by_reference = (
        F.when(reference.isNotNull() & (mean_abs > 1e6), epoch)
        .when(reference.isNotNull(), add_days(reference, value))
    )
    by_units_known = base.isNotNull() & (lower.contains("day") | lower.contains("sec"))
    return (
        F.when(F.coalesce(by_units_known, F.lit(False)), by_units)
        .when(reference.isNotNull(), by_reference)
        .otherwise(add_days(F.lit(EPOCH_1950).cast("timestamp"), value))
    )


def with_decoded_time(df: DataFrame, column: str, out: str, *, units: str | None = None,
                      reference: str | None = None, file_column: str = "source_file") -> DataFrame:
    """Add ``out``: the decoded form of time column ``column`` (numeric or text).

    The epoch-seconds rule looks at a whole file, so a per-file mean is joined
    back; it is a partial aggregate, and AQE splits a file that dominates. When
    there is no reference column the mean cannot matter and no join is planned.
    """
    dtype = df.schema[column].dataType.simpleString()
    if dtype in ("timestamp", "timestamp_ntz"):
        return df.withColumn(out, F.col(column).cast("timestamp"))
    if dtype == "string":
        return df.withColumn(out, generic_timestamp(F.translate(F.col(column), "\x00", "")))
    units_col = F.col(units) if units else F.lit(None).cast("string")
    if reference is None:
        none = F.lit(None)
        return df.withColumn(out, numeric_timestamp(
            F.col(column), units_col, none.cast("timestamp"), none.cast("double")))
    magnitude = F.abs(F.nullif(F.col(column).cast("double"), F.lit(float("nan"))))
    means = df.groupBy(file_column).agg(F.avg(magnitude).alias("_mean_abs"))
    return (
        df.join(means, file_column, "left")
        .withColumn(out, numeric_timestamp(
            F.col(column), units_col, reference_timestamp(F.col(reference)), F.col("_mean_abs")))
        .drop("_mean_abs")
    )


def round_to_second(ts: Column) -> Column:
    """Nearest second, halves to even."""
    return F.timestamp_seconds(F.bround(_micros(ts.cast("timestamp")) / F.lit(1e6)).cast("bigint"))
