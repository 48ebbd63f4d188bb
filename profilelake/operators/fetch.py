"""Reading measurements and metadata for a set of candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilelake.functions.text import integer, text_number
from profilelake.operators.ranking import first_per_key, salts_for, top_n_per_key
from profilelake.schemas import FETCH_CAP, FETCH_COLUMNS, METADATA_ALIASES
from profilelake.session import materialized


# --- columns ---------------------------------------------------------------

def find_column(df: DataFrame, wanted: str, *, contains: bool = True) -> str | None:
    """Column of that name in any case, else the first whose name contains it."""
    low = wanted.lower()
    exact = [c for c in df.columns if c.lower() == low]
    partial = [c for c in df.columns if low in c.lower()] if contains else []
    return next(iter(exact + partial), None)


def available(df: DataFrame, wanted: Sequence[str] = FETCH_COLUMNS) -> DataFrame:
    """The wanted columns the frame has, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def canonical(df: DataFrame, aliases: dict[str, Sequence[str]] = METADATA_ALIASES,
              extra: Sequence[Column] = ()) -> DataFrame:
    """One column per canonical name: the first spelling present, else null."""
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    columns = []
    for name, spellings in aliases.items():
        source = next((by_lower[s.lower()] for s in spellings if s.lower() in by_lower), None)
        columns.append((F.col(source) if source else F.lit(None)).alias(name))
    return df.select(*columns, *extra)


# --- filters ---------------------------------------------------------------

def in_months(df: DataFrame, months: Sequence[str] | None, year: str | None = None) -> DataFrame:
    """Keep the given months ('MM' or 'YYYY_MM'); equality on the partition
    columns, so only their folders are read. No match gives an empty result."""
    if year:
        df = df.where(F.col("year") == year)
    if not months:
        return df
    keep = F.lit(False)
    for m in (str(m).strip() for m in months):
        y, _, mm = m.rpartition("_")
        keep = keep | ((F.col("month") == mm) & (F.col("year") == y if y else F.lit(True)))
    return df.where(keep)


def in_dates(df: DataFrame, date_from: str | None, date_to: str | None, column: str = "juld") -> DataFrame:
    """Inclusive range, applied only when both ends are given. The upper bound
    is the literal itself: '2025-03-31' means midnight at its start."""
    if not (date_from and date_to):
        return df
    dtype = df.schema[column].dataType.simpleString()
    low, high = (F.lit(x).cast(dtype) for x in (date_from, date_to))
    return df.where((F.col(column) >= low) & (F.col(column) <= high))


def in_box(lat_min, lat_max, lon_min, lon_max, lat: str = "LATITUDE", lon: str = "LONGITUDE") -> Column:
    """Non-null position inside the inclusive box."""
    inside = F.col(lat).between(lat_min, lat_max) & F.col(lon).between(lon_min, lon_max)
    return F.col(lat).isNotNull() & F.col(lon).isNotNull() & inside


# --- joins -----------------------------------------------------------------

def for_platforms(df: DataFrame, candidates: DataFrame, column: str = "platform_number") -> DataFrame:
    """Semi-join on the platform. No hint: the planner broadcasts the candidates
    when their size allows it and shuffles otherwise."""
    platforms = candidates.select(F.col("platform_number").alias(column)).where(F.col(column).isNotNull())
    return df.join(platforms, column, "left_semi")


def with_resolved_platforms(candidates: DataFrame, metadata: DataFrame) -> DataFrame:
    """Distinct platforms of the candidates: their own, plus those found through
    the serial number for candidates without one."""
    own = candidates.where(F.col("platform_number").isNotNull()).select(F.col("platform_number").cast("bigint"))
    serials = (
        candidates.where(F.col("platform_number").isNull() & (F.col("float_serial_no") != ""))
        .select("float_serial_no").distinct()
    )
    known = metadata.select(
        F.col("platform_number").cast("bigint").alias("platform_number"), "float_serial_no"
    ).where(F.col("platform_number").isNotNull()).distinct()
    found = known.join(serials, "float_serial_no", "left_semi").select("platform_number")
    return own.unionByName(found).distinct()


def hottest_for_project(measurements: DataFrame, metadata: DataFrame, pattern: str, value: str = "TEMP") -> DataFrame:
    """The measurement with the largest value among platforms of matching projects."""
    projects = metadata.where(F.col("project_name").ilike(pattern)).select(
        "platform_number", "project_name", "pi_name").distinct()
    columns = ["platform_number", "profile_index", "juld", "PRES", value]
    joined = measurements.select(*columns).join(projects, "platform_number")
    order = [F.col(value).desc_nulls_last()]
    order += [F.col(c).asc_nulls_last() for c in joined.columns if c != value]
    return joined.orderBy(*order).limit(1).withColumnRenamed(value, "max_value")


def unprocessed(files: DataFrame, log: DataFrame, *, skip_errors: bool = False) -> DataFrame:
    """Files without a successful entry in the run log (with ``skip_errors``:
    without any entry)."""
    done = log if skip_errors else log.where(F.col("status") == "OK")
    return files.join(done.select("filename"), "filename", "left_anti")


# --- the two candidate fetches ----------------------------------------------

def fetch_measurements(core: DataFrame, platforms: DataFrame, *, months: Sequence[str] | None = None,
                       date_from: str | None = None, date_to: str | None = None,
                       cap: int = FETCH_CAP) -> DataFrame:
    """Latest ``cap`` rows per (year, month, platform, profile).

    Month and date filters and the semi-join come before the ranking, and only
    the fetched columns are read. Equal times are ordered by level, then by the
    remaining columns, so the kept rows are always the same.
    """
    rows = in_dates(in_months(core, months), date_from, date_to)
    keys = ["year", "month", "platform_number", "profile_index"]
    extra = [c for c in ("row_ordinal",) if c in rows.columns]
    rows = rows.select(*dict.fromkeys(
        ["year", "month", *extra, *[c for c in FETCH_COLUMNS if c in rows.columns]]))
    rows = for_platforms(rows, platforms)
    first = [c for c in ("level_index", "row_ordinal") if c in rows.columns]
    rest = [c for c in rows.columns if c not in keys and c not in first and c != "juld"]
    order = [F.col("juld").desc_nulls_last()] + [F.col(c).asc_nulls_first() for c in first + rest]
    return top_n_per_key(rows, keys, order, cap)


LIMITS = ("year", "months", "date_from", "date_to")
WIDEST = 240        # months of a date range that is cut into monthly keys


def with_window(questions: DataFrame, name: str = "window") -> DataFrame:
    """Add the question's limits as one text; equal limits give equal texts. Absent columns set no limit."""
    given = [(F.array_sort(F.transform("months", lambda m: F.trim(m))) if c == "months" else F.col(c)).cast("string").alias(c)
             for c in LIMITS if c in questions.columns]
    return questions.withColumn(name, F.to_json(F.struct(*given)) if given else F.lit("{}"))


def fetch_in_windows(core: DataFrame, asked: DataFrame, *, cap: int = FETCH_CAP) -> DataFrame:
    """Latest ``cap`` rows per (window, year, month, platform, profile), each window with limits of its own.

    ``asked``: window, platform_number and the limits year, months ('MM' or
    'YYYY_MM'), date_from and date_to, null or absent where there is none. As in
    :func:`fetch_measurements`, a date range counts only with both ends, and its
    end is the instant itself.

    Equal windows share their rows. The interval join is one by equality: a date
    range becomes one key per calendar month, matched with the month of the
    row's time; other limits (and ranges of over WIDEST months) become the month
    folders they allow, so that folders no window asks for are not read. The
    exact limits are compared after that. A row meets each window at most once.
    """
    dtype = core.schema["juld"].dataType.simpleString()
    limits = [F.col(c).cast(t) if c in asked.columns else F.lit(None).cast(t)
              for c, t in zip(LIMITS, ("string", "array<string>", dtype, dtype))]
    asked = asked.where("platform_number IS NOT NULL").select(
        F.col("window"), F.col("platform_number").cast(core.schema["platform_number"].dataType).alias("platform_number"),
        *[x.alias(f"_{c}") for x, c in zip(limits, LIMITS)]).dropDuplicates(["window", "platform_number"])
    asked = materialized(asked, plain=True)
    dated = F.col("_date_from").isNotNull() & F.col("_date_to").isNotNull()
    month_of = lambda c: F.year(c) * 12 + F.month(c)
    short = F.coalesce(dated & (month_of("_date_to") - month_of("_date_from") < WIDEST), F.lit(False))

    # the month folders of the table: a list as long as its months
    folders = sorted({(r["year"], r["month"]) for r in core.select("year", "month").distinct().collect() if r["month"] is not None and r["year"] is not None})
    listed = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(m).alias("m")) for y, m in folders]) if folders else F.array().cast("array<struct<y:string,m:string>>")

    def allowed(y, m):
        named = F.exists("_months", lambda x: (F.trim(x) == m) | (F.trim(x) == F.concat(y, F.lit("_"), m)))
        return (F.col("_year").isNull() | (F.col("_year") == y)) & (F.col("_months").isNull() | (F.size("_months") == 0) | named)

    rows = core.select(*dict.fromkeys(["year", "month", *[c for c in ("row_ordinal",) if c in core.columns],
                                       *[c for c in FETCH_COLUMNS if c in core.columns]]))
    # written, so that their size decides whether the table's rows are shuffled to them
    by_month = materialized(asked.where(short & (F.col("_date_from") <= F.col("_date_to"))).withColumn(
        "_key", F.explode(F.sequence(month_of("_date_from"), month_of("_date_to")))), plain=True)
    first = rows.withColumn("_key", month_of("juld")).join(by_month, ["platform_number", "_key"]).where(
        F.col("juld").between(F.col("_date_from"), F.col("_date_to")) & allowed(F.col("year"), F.col("month")))
    by_folder = materialized(asked.where(~short).withColumn("_f", F.explode(F.filter(listed, lambda f: allowed(f["y"], f["m"])))).withColumns(
        {"year": F.col("_f.y"), "month": F.col("_f.m")}).drop("_f"), plain=True)
    second = rows.join(by_folder, ["platform_number", "year", "month"]).where(
        ~dated | F.col("juld").between(F.col("_date_from"), F.col("_date_to")))
    names = ["window", *rows.columns]
    found = first.select(*names).unionByName(second.select(*names))
    keys = ["window", "year", "month", "platform_number", "profile_index"]
    lead = [c for c in ("level_index", "row_ordinal") if c in rows.columns]
    rest = [c for c in rows.columns if c not in keys and c not in lead and c != "juld"]
    return top_n_per_key(found, keys, [F.col("juld").desc_nulls_last()] + [F.col(c).asc_nulls_first() for c in lead + rest], cap)


ROWS_PER_FILE = 1 << 18


def rows_of_questions(capped: DataFrame, asked: DataFrame, on: Sequence[str], key: str = "query_id", *,
                      per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Fetched rows joined with the questions (``asked``: key and the columns ``on``, distinct), written.

    Few fetched rows may become very many, since questions share them, and they
    pack so well that one file, and so one task, would hold them all. Their
    number is counted beforehand: the join and the files written are dealt over
    as many parts. A question lies in one file, so that a task's partial
    aggregates meet it once; one of more than ``per_file`` rows is cut into pieces.
    """
    capped, spark = materialized(capped), capped.sparkSession
    shares = capped.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    sizes = materialized(asked.join(shares, list(on)).groupBy(F.col(key).alias("_key")).agg(F.sum("_n").alias("_n")))
    total, fetched = sizes.agg(F.sum("_n")).first()[0] or 0, capped.count()
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(few, salts_for(total, per_file))
    # every fetched row is repeated at most as often as questions take it on average
    copies = max(1, min(parts, total // max(1, fetched)))
    copied = capped.repartition(few, "platform_number", "profile_index").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    taken = asked.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_copy", F.pmod(F.xxhash64(key), F.lit(copies)).cast("int"))
    joined = copied.repartition(parts, *on, "_copy").join(taken.repartition(parts, *on, "_copy"), [*on, "_copy"])
    piece = F.pmod(F.xxhash64("platform_number", "profile_index"), F.ceil(F.col("_n") / per_file)).alias("_piece")
    return materialized(joined.repartition(parts, F.col(key), piece).drop("_copy", "_key", "_n"))


def choose_metadata(full: DataFrame, clean: DataFrame, year: str) -> DataFrame:
    """Metadata rows to read for a year: full of that year, else clean of that
    year, else any full, else any clean. Each probe reads one row."""
    for source, wanted in ((full, year), (clean, year), (full, None), (clean, None)):
        rows = source.where(F.col("year") == wanted) if wanted else source
        if not rows.isEmpty():
            return rows
    return clean


def fetch_metadata(sources: Sequence[DataFrame], platforms: DataFrame) -> DataFrame:
    """One canonical row per platform: the first in source order, then by
    year, month, file and row position."""
    parts = []
    for priority, source in enumerate(sources):
        by_lower = {c.lower(): c for c in source.columns}
        position = [F.col(c).alias(f"_{c}") if c in by_lower else F.lit(None).alias(f"_{c}")
                    for c in ("year", "month", "source_file", "row_ordinal")]
        named = canonical(source, extra=position)
        typed = named.select(
            integer(F.col("platform_number")).alias("platform_number"),
            *[F.col(c).cast("string").alias(c) for c in ("project_name", "pi_name", "float_serial_no", "firmware_version")],
            *[text_number(F.col(c)).alias(c) for c in ("wmo_inst_type", "format_version", "handbook_version", "config_mission_number")],
            F.col("reference_date_time").cast("string").try_cast("timestamp").alias("reference_date_time"),
            F.col("_year").cast("string").alias("_year"), F.col("_month").cast("string").alias("_month"),
            F.col("_source_file").cast("string").alias("_source_file"),
            F.col("_row_ordinal").cast("bigint").alias("_row_ordinal"),
        ).withColumn("_priority", F.lit(priority))
        parts.append(typed)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = for_platforms(rows, platforms)
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("_year", "_month", "_source_file")]
    tie = [F.coalesce(F.col(c), F.lit("")) for c in ("project_name", "pi_name", "float_serial_no")]
    order = [F.col("_priority"), *text, F.coalesce(F.col("_row_ordinal"), F.lit(-1)), *tie]
    return first_per_key(rows, ["platform_number"], order).select(*METADATA_ALIASES)
