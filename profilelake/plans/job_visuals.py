"""The visuals of all questions of a job, as one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilelake.functions.text import json_cell
from profilelake.operators.fetch import find_column
from profilelake.operators.ranking import salts_for, top_n_per_key
from profilelake.operators.shares import PER_TASK, Shares
from profilelake.operators.stats import first_variable
from profilelake.plans.context import KEY
from profilelake.plans.retrieval import Retrieval
from profilelake.plans.triage import visual_intent
from profilelake.schemas import MAX_CHART_POINTS, MAX_TABLE_ROWS
from profilelake.session import materialized

KEEP_NULLS = {"ignoreNullFields": "false"}
TIES = ("platform_number", "profile_index", "level_index")
OUT = (KEY, "visual_kind", "visual_json")


def _named(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((c for n in names if (c := find_column(df, n))), None)


def _cell(df: DataFrame, name: str) -> Column:
    return json_cell(F.col(name), df.schema[name].dataType)


def _payload(kind: str, title: str, *fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), F.lit(title).alias("title"), *fields), KEEP_NULLS)


def _gathered(rows: DataFrame, place: str, cell: Column, out: str) -> DataFrame:
    """Each question's cells in order; at most as many as a visual shows."""
    both = rows.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("_o"), cell.alias("_c")))).alias("_a"))
    return both.select(KEY, F.transform("_a", lambda x: x["_c"]).alias(out))


def charts(shares: Shares, x: str, y: str, title: str, ties: Sequence[str] = TIES, points: int = MAX_CHART_POINTS) -> DataFrame:
    """A chart for each question of ``shares`` (rows with x, y, ties): evenly spaced points, ranges, row count."""
    ties = [t for t in ties if t in shares.columns]
    order = [F.col(c).asc_nulls_last() for c in dict.fromkeys([x, *ties, y])]
    picked = shares.evenly(order, [x, y, *ties], points)
    data = _gathered(picked, "ordinal", F.struct(_cell(picked, x).alias(x), _cell(picked, y).alias(y)), "data")
    ranges = shares.ranges(x, y).select(KEY, "row_count", *[F.col(f"{c}_{end}").alias(f"{a}_{end}") for a, c in (("x", x), ("y", y)) for end in ("min", "max")])
    limits = [_cell(ranges, c).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")]
    return data.join(ranges, KEY).select(KEY, F.lit("chart").alias("visual_kind"), _payload(
        "chart", title, F.lit("line").alias("chartType"), F.lit(x).alias("xKey"), F.lit(y).alias("yKey"), "data", *limits, "row_count",
        (F.col("row_count") > points).alias("downsampled")).alias("visual_json"))


def _sorting(df: DataFrame, shown: Sequence[str], order: Sequence[str] = ()) -> list[Column]:
    sortable = [f.name for f in df.schema.fields if f.name in shown and f.dataType.typeName() not in ("map", "variant")]
    return [F.col(c).asc_nulls_last() for c in dict.fromkeys([*order, *sortable])]


def tables(rows: DataFrame, title: str, order: Sequence[str] = (), n: int = MAX_TABLE_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """A table for each question of ``rows``: its first ``n`` rows by ``order``, then all columns.

    ``counts`` (query_id, row_count): the questions' rows, where ``rows`` are not all of them.
    """
    shown = [f.name for f in rows.schema.fields if f.name != KEY]
    first = top_n_per_key(rows, [KEY], _sorting(rows, shown, order), n, rank="_nth")
    line = F.array(*[_cell(rows, c).cast("variant") for c in shown])
    counts = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("row_count")) if counts is None else counts
    return _gathered(first, "_nth", F.to_json(line), "_lines").join(counts, KEY).select(KEY, F.lit("table").alias("visual_kind"), _with_lines(
        _payload("table", title, F.array(*[F.lit(c) for c in shown]).alias("headers"), "row_count")).alias("visual_json"))


def _with_lines(payload: Column) -> Column:
    """``payload`` with the written rows in ``_lines`` as its field ``rows``: cells of a row have different types."""
    return F.concat(F.substring(payload, F.lit(1), F.length(payload) - 1), F.lit(',"rows":['), F.array_join("_lines", ","), F.lit("]}"))


def samples(shares: Shares, title: str, n: int = MAX_TABLE_ROWS) -> DataFrame:
    """A table of each question's first rows: they are among the first of each of its shares."""
    return tables(shares.first_rows(_sorting(shares.rows, shares.columns), n), title, n=n, counts=shares.ranges())


def aggregates(shares: Shares, column: str) -> DataFrame:
    """One line with count, mean, min and max of a variable for each question."""
    return tables(shares.averages(column), f"Aggregates for {column}")


def maps(places: DataFrame, title: str, label: str | None = "PLATFORM_NUMBER", n: int = MAX_TABLE_ROWS,
         asked: DataFrame | None = None, by: str | None = None) -> DataFrame | None:
    """Valid positions among each question's first ``n`` places, and why the others are left out; None without position columns.

    With ``asked`` (query_id, _p) the places are those whose column ``by`` is a
    question's ``_p``, distinct. A question's first places are among the first of
    each of its ``_p``, so only these meet the questions, however many places there are.
    """
    lat, lon = find_column(places, "LATITUDE"), find_column(places, "LONGITUDE")
    named = find_column(places, label) if label else None
    if lat is None or lon is None:
        return None
    stored = [c for c in ("year", "month", "source_file", "row_ordinal") if c in places.columns]
    kept = list(dict.fromkeys([*stored, lat, lon, *([named] if named else [])]))
    order = [F.col(c).asc_nulls_last() for c in kept] if stored else [F.xxhash64(*kept), *[F.col(c).asc_nulls_last() for c in kept]]
    if asked is None:
        narrow, counts = places.select(KEY, *kept), places.groupBy(KEY).agg(F.count(F.lit(1)).alias("row_count"))
    else:
        asked = materialized(asked, plain=True)
        parts = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), salts_for(asked.count() * n, PER_TASK))
        met = F.col("_by") == F.col("_p")
        own = places.select(*kept, F.col(by).alias("_by")).join(asked.select("_p").distinct(), met, "left_semi")
        best = materialized(top_n_per_key(own, ["_by"], order, n, rank="_nth").drop("_nth"))
        narrow = best.join(asked.repartition(parts, KEY), met).select(KEY, *kept)     # a question's places meet in one task
        sizes = own.groupBy("_by").agg(F.count(F.lit(1)).alias("_n"))
        counts = sizes.join(asked, met).groupBy(KEY).agg(F.sum("_n").alias("row_count"))
    first = top_n_per_key(narrow, [KEY], order, n, rank="_nth")

    def absent(c):
        return F.col(c).isNull() | F.coalesce(F.isnan(F.col(c).try_cast("double")), F.lit(False))

    y, x = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    reason = F.when(absent(lat) | absent(lon), "missing lat or lon").when(y.isNull() | x.isNull(), "non-numeric lat/lon")
    first = first.withColumn("reason", reason)
    point = F.when(F.col("reason").isNull(), F.struct(y.alias("lat"), x.alias("lon"), (F.col(named).cast("string") if named else F.lit(None).cast("string")).alias("label")))
    omitted = F.when(F.col("reason").isNotNull(), F.struct((F.col("_nth") - 1).alias("row_index"), "reason"))
    both = _gathered(first, "_nth", F.struct(point.alias("p"), omitted.alias("o")), "_all")
    points = F.array_compact(F.transform("_all", lambda c: c["p"]))
    left_out = F.array_compact(F.transform("_all", lambda c: c["o"]))
    return both.join(counts, KEY).select(KEY, F.lit("map").alias("visual_kind"), _payload(
        "map", title, points.alias("points"), "row_count", F.size(points).alias("returned_count"), F.size(left_out).alias("omitted_count"),
        left_out.alias("omitted_reasons")).alias("visual_json"))


def job_visuals(run: Retrieval, questions: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """(query_id, visual_kind, visual_json) of every question (query_id, text), at most 200 rows each.

    The kind follows from the text and from what the question has rows of, as
    for :func:`profilelake.plans.visuals.build_visual`: map, chart over time or
    pressure, aggregate; else its metadata, else its measurements as a table.
    ``positions`` feed the maps, limited to the question's platforms. Each kind
    is one plan over all questions that want it; a question without rows of any
    kind has the kind ``none``.
    """
    shares = run.shares or Shares.of(run.rows, KEY)
    has = shares.ranges().select(KEY).withColumn("_rows", F.lit(True))
    told = run.metadata.select(KEY).distinct().withColumn("_about", F.lit(True))
    asked = questions.select(KEY, visual_intent(F.coalesce("text", F.lit(""))).alias("_intent")).join(has, KEY, "left").join(told, KEY, "left")
    rows, about = F.col("_rows").isNotNull(), F.col("_about").isNotNull()
    shares = replace(shares, rows=shares.rows.drop("rank"))
    numeric = shares.rows.select(*shares.columns)
    columns = {"time_series": (_named(numeric, ("juld", "date", "time")), _named(numeric, ("TEMP", "PSAL", "PRES", "TEMP_ADJUSTED", "PSAL_ADJUSTED"))),
               "profile": (_named(numeric, ("PRES", "pressure", "depth")), _named(numeric, ("TEMP", "TEMP_ADJUSTED", "temperature"))
                           or _named(numeric, ("PSAL", "PSAL_ADJUSTED", "salinity")))}
    variable = first_variable(numeric)
    plan = F.when((F.col("_intent") == "map") & (F.lit(positions is not None) | about), "map")
    for kind, (x, y) in columns.items():
        if x and y:
            plan = plan.when((F.col("_intent") == kind) & rows, kind)
    if variable:
        plan = plan.when((F.col("_intent") == "aggregate") & rows, "aggregate")
    # written, since each kind reads it and its size decides how its questions' rows are found
    asked = materialized(asked.withColumn("_plan", plan.when(about, "metadata").when(rows, "numeric").otherwise("none")), plain=True)

    def wanting(df: DataFrame, kind: str) -> DataFrame:
        return df.join(asked.where(F.col("_plan") == kind).select(KEY), KEY, "left_semi")

    def taking(kind: str) -> Shares:
        return shares.of_questions(asked.where(F.col("_plan") == kind))

    parts = [tables(wanting(run.metadata, "metadata"), "Metadata sample"), samples(taking("numeric"), "Numeric sample")]
    for kind, title in (("time_series", "{} over time"), ("profile", "{} profile (sample)")):
        x, y = columns[kind]
        if x and y:
            name = y if kind == "time_series" else ("Salinity" if "SAL" in y.upper() else "Temperature")
            parts.append(charts(taking(kind), x, y, title.format(name)))
    if variable:
        parts.append(aggregates(taking("aggregate"), variable))
    if positions is not None:
        column = find_column(positions, "platform_number")
        own = run.metadata.select(KEY, F.col("platform_number").alias("_p")).distinct()
        drawn = maps(positions, "Profiles: geographic sample", asked=wanting(own, "map"), by=column)
    else:
        drawn = maps(wanting(run.metadata, "map"), "Profiles: geographic sample")
    if drawn is not None:
        parts.append(drawn)
    made = parts[0].select(*OUT)
    for p in parts[1:]:
        made = made.unionByName(p.select(*OUT))
    return asked.join(made, KEY, "left").select(
        KEY, F.coalesce("visual_kind", F.when(F.col("_plan") == "map", "unavailable").otherwise("none")).alias("visual_kind"),
        F.coalesce("visual_json", F.lit('{"type":"none","reason":"nothing to show"}')).alias("visual_json"))
