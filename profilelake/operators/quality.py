"""Counts, coverage, missing rates and source-to-table reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilelake.operators.fetch import in_box
from profilelake.operators.ranking import salts_for


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of every table. Each branch is a column-free scan."""
    return _union([
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ])


def partition_counts(layer: DataFrame, name: str) -> DataFrame:
    return layer.groupBy("year", "month").agg(F.count(F.lit(1)).alias("row_count")).withColumn("layer", F.lit(name))


def time_coverage(df: DataFrame, column: str = "juld") -> DataFrame:
    return df.where(F.col(column).isNotNull()).agg(F.min(column).alias("min_juld"), F.max(column).alias("max_juld"))


def region_counts(tables: Mapping[str, DataFrame], lat_min, lat_max, lon_min, lon_max) -> DataFrame:
    """Positions inside the box per table; tables without positions are left out."""
    parts = []
    for name, df in tables.items():
        if {"LATITUDE", "LONGITUDE"} <= set(df.columns):
            hits = df.where(in_box(lat_min, lat_max, lon_min, lon_max))
            parts.append(hits.agg(F.count(F.lit(1)).alias("hits")).select(F.lit(name).alias("table_name"), "hits"))
    return _union(parts)


def region_sample(df: DataFrame, lat_min, lat_max, lon_min, lon_max, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in the box (each task keeps n rows)."""
    return df.where(in_box(lat_min, lat_max, lon_min, lon_max)).orderBy(*order).limit(n)


def regional_average(df: DataFrame, value: str, lat_min, lat_max, lon_min, lon_max) -> DataFrame:
    inside = df.where(in_box(lat_min, lat_max, lon_min, lon_max) & F.col(value).isNotNull())
    return inside.agg(F.avg(value).alias("avg_value"), F.count(F.lit(1)).alias("num_records"))


def null_rates(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Total, non-null and missing rate of each variable, from one scan."""
    present = [v for v in variables if v in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(v).alias(v) for v in present])
    long = counts.unpivot(["total"], present, "variable", "non_null")
    return long.withColumn("null_rate", 1 - F.try_divide(F.col("non_null"), F.col("total")))


def null_summary(layers: Mapping[str, DataFrame], critical: Mapping[str, Sequence[str]]) -> DataFrame:
    """Non-null and total count of the critical columns; 0 of 0 for an absent column."""
    parts = []
    for name, df in layers.items():
        counts = []
        for c in critical[name]:
            there = c in df.columns
            counts.append(F.struct(
                F.lit(c).alias("column_name"),
                (F.count(c) if there else F.lit(0)).cast("bigint").alias("non_null"),
                (F.count(F.lit(1)) if there else F.lit(0)).cast("bigint").alias("total")))
        row = df.agg(F.count(F.lit(1)).alias("_n"), F.array(*counts).alias("_c"))
        parts.append(row.select(F.lit(name).alias("layer"), F.inline("_c")))
    return _union(parts)


def flag_distribution(df: DataFrame, column: str = "PSAL_QC") -> DataFrame:
    """Rows per flag, null included, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), F.col(column))


ROWS_PER_TASK = 1 << 20


def profile_exists(requests: DataFrame, core: DataFrame) -> DataFrame:
    """``found`` for each request (platform_number, profile_index or null).

    Without a profile any non-null one of the platform counts. The profiles are
    dealt over as many parts as the table's row count asks for, so that a task's
    share does not grow with the table; what is not asked for goes no further.
    """
    spark = core.sparkSession
    keys = ["platform_number", "profile_index"]
    rows = core.select(*keys).where(F.col("platform_number").isNotNull() & F.col("profile_index").isNotNull())
    parts = salts_for(core.count(), ROWS_PER_TASK)
    dealt = rows.repartition(parts, *keys) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows
    asked = requests.select(*keys).where(F.col("platform_number").isNotNull())
    pairs = asked.where(F.col("profile_index").isNotNull()).distinct()
    alone = asked.where(F.col("profile_index").isNull()).select("platform_number").distinct()
    exact = pairs.join(dealt.distinct(), keys, "left_semi")
    whole = alone.join(rows.select("platform_number").distinct(), "platform_number", "left_semi")
    known = exact.select(F.col("platform_number").alias("_platform"), F.col("profile_index").alias("_profile")).unionByName(
        whole.select(F.col("platform_number").alias("_platform"), F.lit(None).cast(requests.schema["profile_index"].dataType).alias("_profile")))
    known = known.withColumn("_hit", F.lit(True))
    same = (F.col("platform_number") == F.col("_platform")) & F.col("profile_index").eqNullSafe(F.col("_profile"))
    return requests.join(known, same, "left").select(
        *[requests[c] for c in requests.columns], F.coalesce(F.col("_hit"), F.lit(False)).alias("found"))


def schema_rows(tables: Mapping[str, DataFrame], expected: Mapping[str, T.StructType] | None = None) -> DataFrame:
    """Column names and types of the given tables, with a check against the expected schema."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        types = {f.name: f.dataType for f in expected[name].fields} if expected and name in expected else None
        for position, field in enumerate(df.schema.fields):
            ok = None if types is None else types.get(field.name) == field.dataType
            rows.append((name, position, field.name, field.dataType.simpleString(), ok))
    return spark.createDataFrame(
        rows, "table_name string, position int, column_name string, data_type string, as_expected boolean")


def _issue(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text))


def reconcile(source_counts: DataFrame, table_counts: DataFrame) -> DataFrame:
    """Source rows against loaded rows per (layer, year, month).

    Inputs are counts (columns layer, year, month, and csv_rows / parquet_rows;
    the source also carries ``rejected_rows`` where its reader counts them and
    ``bad_files``, the files it could not load). The issues name each bad file.
    """
    keys = ["layer", "year", "month"]
    if "rejected_rows" not in source_counts.columns:
        source_counts = source_counts.withColumn("rejected_rows", F.lit(0).cast("bigint"))
    if "bad_files" not in source_counts.columns:
        source_counts = source_counts.withColumn("bad_files", F.array().cast("array<string>"))
    both = source_counts.join(table_counts, keys, "full_outer")
    no_source, no_table = F.col("csv_rows").isNull(), F.col("parquet_rows").isNull()
    matches = F.coalesce(F.col("csv_rows") == F.col("parquet_rows"), F.lit(False))
    issues = F.array_compact(F.array(
        _issue(no_source, "month_dir_missing"),
        _issue(no_table, "parquet_missing"),
        _issue(F.coalesce(F.col("rejected_rows"), F.lit(0)) > 0, "rows_rejected"),
        _issue(~no_source & ~no_table & ~matches, "row_count_differs"),
    ))
    bad = F.coalesce("bad_files", F.array().cast("array<string>"))
    matches = matches & (F.size(bad) == 0)
    issues = F.concat(issues, bad)
    return both.select(
        *keys, F.coalesce("csv_rows", F.lit(0)).cast("bigint").alias("csv_rows"), "parquet_rows",
        matches.alias("matches"), issues.alias("issues"))


def head_rows(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """First rows in a fixed order, as one JSON text per row."""
    first = df.orderBy(*order).limit(n)
    return first.select(F.to_json(F.struct(*first.columns)).alias("row_json"))
