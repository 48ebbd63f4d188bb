"""Summaries and representative samples of measurement rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilelake.operators.fetch import find_column
from profilelake.operators.ranking import bracket, exact_quantile, merged_row
from profilelake.session import materialized

# Variables summarised, in this order.
STAT_VARIABLES = ("TEMP", "PSAL", "PRES", "TEMP_ADJUSTED", "PSAL_ADJUSTED", "PRES_ADJUSTED")
# Variables tried for the aggregate table, in this order.
AGGREGATE_VARIABLES = ("PSAL_ADJUSTED", "PSAL", "TEMP_ADJUSTED", "TEMP", "PRES")

PROFILE = ("platform_number", "profile_index")


def six_statistics(df: DataFrame, variables: Sequence[str] = STAT_VARIABLES, groups: Sequence[str] = (),
                   digits: int = 6) -> DataFrame:
    """Count, mean, exact median, min, max and sample deviation per variable
    (and group), rounded; missing values are skipped."""
    present = [v for v in variables if v in df.columns]
    values = df.select(*groups, *[F.col(v).cast("double").alias(v) for v in present])
    values = values.withColumns({v: F.nullif(v, F.lit(float("nan"))) for v in present})
    long = values.unpivot(list(groups), present, "variable", "value")
    keys = [*groups, "variable"]
    # all variables of a row at once: with many groups the rows are sorted for the sketches
    wide = values.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"), *[F.struct(
        F.lit(v).alias("variable"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.stddev_samp(v).alias("std"), bracket(v, 0.5).alias("bracket")).alias(f"_{i}") for i, v in enumerate(present)])
    stats = materialized(wide.where("_rows > 0").select(*groups, F.inline(F.array(*[f"_{i}" for i in range(len(present))]))))
    medians = exact_quantile(long, keys, "value", 0.5, out="median", brackets=stats).select(
        *[F.col(k).alias(f"_m_{k}") for k in keys], "median")
    same = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_m_{k}"))
        same = eq if same is None else same & eq
    rounded = [F.round(c, digits).alias(c) for c in ("mean", "median", "min", "max", "std")]
    return stats.join(medians, same, "left").select(*keys, "count", *rounded)


def profile_summary(df: DataFrame, keys: Sequence[str] = PROFILE) -> DataFrame:
    """Latest time and number of levels per profile; rows without a key are left out."""
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.max("juld").alias("latest_juld"), F.count("level_index").alias("n_levels"))


def sampled_profile_count(total: int, max_rows: int) -> int:
    """Profiles to sample for a row budget: three rows each, never more than max(10, budget)."""
    return min(total, max(1, max_rows // 3), max(10, max_rows))


def latest_profiles(df: DataFrame, max_rows: int, keys: Sequence[str] = PROFILE) -> DataFrame:
    """The most recent profiles that a budget of ``max_rows`` rows has room for."""
    bound = sampled_profile_count(2**31, max_rows)
    return profile_summary(df, keys).orderBy(F.col("latest_juld").desc_nulls_last(), *keys).limit(bound)


def coverage_summary(df: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Distinct platforms and profiles (of the rows and the retrieved hits),
    first and last time, and the position range where there are positions."""
    ids = df.select("platform_number", "profile_index")
    if hits is not None:
        ids = ids.unionByName(hits.select("platform_number", "profile_index"))
    distinct = ids.agg(
        F.countDistinct("platform_number").alias("platforms"), F.countDistinct("profile_index").alias("profiles"))
    ranges = [F.count(F.lit(1)).alias("numeric_rows"), F.min("juld").alias("juld_min"), F.max("juld").alias("juld_max")]
    for short, names in (("lat", ("LATITUDE", "LAT")), ("lon", ("LONGITUDE", "LON"))):
        column = next((c for n in names if (c := find_column(df, n, contains=False))), None)
        if column:
            ranges += [F.min(column).alias(f"{short}_min"), F.max(column).alias(f"{short}_max")]
    return merged_row(distinct, df.agg(*ranges))


def first_variable(df: DataFrame, names: Sequence[str] = AGGREGATE_VARIABLES) -> str | None:
    """First of the names the frame has, else its first numeric column."""
    hit = next((c for n in names if (c := find_column(df, n))), None)
    if hit:
        return hit
    return next((f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)), None)


def aggregate_table(df: DataFrame, column: str | None = None) -> DataFrame:
    """Count, mean, min and max of one variable."""
    c = column or first_variable(df)
    return df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))


def row_budget(rows: Column) -> Column:
    """Context rows allowed for a fetch of that size."""
    return (
        F.when(rows <= 50, 50).when(rows <= 1_000, 200).when(rows <= 10_000, 500).otherwise(200)
    )


def surface_median_deep(df: DataFrame, keys: Sequence[str] = PROFILE, value: str = "PRES",
                        level: str = "level_index", tie: Sequence[str] = ()) -> DataFrame:
    """Per profile the rows with the smallest, most central and largest value.

    Ties go to the lowest level. A profile without any value gives its first
    and last level. A row picked twice appears once. Picks are partial
    aggregates; a profile's median joins its rows as one value.
    """
    known = df.where(F.col(value).isNotNull())
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    order = [F.col(level), *[F.col(t) for t in tie]]
    med = exact_quantile(known, keys, value, 0.5, out="_median", sketch=False).select(
        *[F.col(k).alias(f"_m_{k}") for k in keys], "_median")
    same = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_m_{k}"))
        same = eq if same is None else same & eq
    with_median = df.join(med, same, "left")
    has = F.col(value).isNotNull()
    # two middle values are equally far from their mean: do not let rounding noise choose
    gap = F.round(F.abs(F.col(value) - F.col("_median")), 9)
    # min_by skips null orderings: rows without a value never win the first three
    picks = with_median.groupBy(*keys).agg(
        F.min_by(row, F.when(has, F.struct(F.col(value).alias("_v"), *order))).alias("_surface"),
        F.min_by(row, F.when(has, F.struct(gap.alias("_v"), *order))).alias("_median_row"),
        F.min_by(row, F.when(has, F.struct((-F.col(value)).alias("_v"), *order))).alias("_deep"),
        F.min_by(row, F.struct(*order)).alias("_first"),
        F.max_by(row, F.struct(*order)).alias("_last"),
    )
    chosen = F.when(F.col("_surface").isNotNull(), F.array("_surface", "_median_row", "_deep")).otherwise(
        F.array("_first", "_last"))
    return picks.select(*keys, F.inline(F.array_distinct(chosen))).select(*df.columns)
