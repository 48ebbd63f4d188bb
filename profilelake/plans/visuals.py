"""Bounded table, chart and map datasets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelake.functions.text import json_cell
from profilelake.operators.fetch import find_column
from profilelake.operators.ranking import merged_row, pick_evenly
from profilelake.operators.stats import aggregate_table, first_variable
from profilelake.plans.triage import visual_intent
from profilelake.schemas import MAX_CHART_POINTS, MAX_TABLE_ROWS


@dataclass
class Visual:
    """``data`` holds at most 200 rows; ``summary`` is one row (``omitted`` a short list)."""

    kind: str
    title: str = ""
    reason: str = ""
    data: DataFrame | None = None
    summary: DataFrame | None = None
    omitted: DataFrame | None = None
    options: dict = field(default_factory=dict)


def _ordered(df: DataFrame, first: Sequence[str] = ()) -> list:
    """Sort expressions: the given columns ascending with nulls last, then all others."""
    rest = [f.name for f in df.schema.fields if f.name not in first and f.dataType.typeName() not in ("map", "variant")]
    return [F.col(c).asc_nulls_last() for c in (*first, *rest)]


def table_preview(df: DataFrame, title: str = "", order: Sequence[str] = (), n: int = MAX_TABLE_ROWS) -> Visual:
    """First ``n`` rows in order, every cell fit for JSON, and the row count."""
    cells = [json_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    data = df.orderBy(*_ordered(df, order)).limit(n).select(*cells)
    return Visual("table", title, data=data, summary=df.agg(F.count(F.lit(1)).alias("row_count")),
                  options={"headers": df.columns})


def chart_series(df: DataFrame | None, x: str, y: str, title: str = "", *, chart_type: str = "line",
                 color: str | None = None, ties: Sequence[str] = (), points: int = MAX_CHART_POINTS) -> Visual:
    """Evenly spaced points of the frame sorted by ``x``, with ranges and row count.

    Rows with equal x are ordered by ``ties``, then y.
    """
    if df is None:
        return Visual("unavailable", title, reason="No numeric data available.")
    if x not in df.columns or y not in df.columns:
        return Visual("unavailable", title, reason=f"Missing columns for chart: need {x} and {y}.")
    color = color if color in df.columns else None
    shown = list(dict.fromkeys([x, y, *([color] if color else [])]))
    narrow = df.select(*dict.fromkeys([*shown, *ties]))
    picked, total = pick_evenly(narrow, [F.col(c).asc_nulls_last() for c in dict.fromkeys([x, *ties, *shown])], points)
    if total == 0:
        return Visual("unavailable", title, reason="No numeric data available.")
    summary = df.agg(
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"),
        F.count(F.lit(1)).alias("row_count")).withColumn("downsampled", F.col("row_count") > points)
    return Visual("chart", title, data=picked.select("ordinal", *shown), summary=summary,
                  options={"chartType": chart_type, "xKey": x, "yKey": y, **({"color": color} if color else {})})


def map_points(df: DataFrame | None, title: str = "", *, lat: str = "LATITUDE", lon: str = "LONGITUDE",
               label: str | None = None, order: Sequence[str] = (), n: int = MAX_TABLE_ROWS) -> Visual:
    """Valid positions among the first ``n`` rows; the others with their reason.

    Without an order, rows stand by file and position where the frame has them,
    else by a hash, so that the sample is not one edge of the map.
    """
    if df is None:
        return Visual("unavailable", title, reason="Missing time_location/metadata data.")
    lat_c, lon_c = find_column(df, lat), find_column(df, lon)
    label_c = find_column(df, label) if label else None
    if lat_c is None or lon_c is None:
        return Visual("unavailable", title, reason="Missing lat/lon columns.")
    order = order or [c for c in ("year", "month", "source_file", "row_ordinal") if c in df.columns]
    keep = list(dict.fromkeys([*order, lat_c, lon_c, *([label_c] if label_c else [])]))
    narrow = df.select(*keep)
    # at most n rows are numbered, so one task is enough
    spread = [] if order else [F.xxhash64(*narrow.columns)]
    first = narrow.orderBy(*spread, *_ordered(narrow, order)).limit(n).coalesce(1).select(
        F.monotonically_increasing_id().alias("row_index"),
        F.col(lat_c).alias("_lat"), F.col(lon_c).alias("_lon"),
        (F.col(label_c).cast("string") if label_c else F.lit(None).cast("string")).alias("label"))

    def absent(c):
        return F.col(c).isNull() | F.coalesce(F.isnan(F.col(c).try_cast("double")), F.lit(False))

    checked = first.withColumns({"lat": F.col("_lat").try_cast("double"), "lon": F.col("_lon").try_cast("double")})
    reason = (
        F.when(absent("_lat") | absent("_lon"), "missing lat or lon")
        .when(F.col("lat").isNull() | F.col("lon").isNull(), "non-numeric lat/lon")
    )
    checked = checked.withColumn("reason", reason)
    data = checked.where(F.col("reason").isNull()).select("row_index", "lat", "lon", "label")
    omitted = checked.where(F.col("reason").isNotNull()).select("row_index", "reason")
    total = df.agg(F.count(F.lit(1)).alias("row_count"))
    counts = checked.agg(
        F.count(F.when(F.col("reason").isNull(), 1)).alias("returned_count"), F.count("reason").alias("omitted_count"))
    return Visual("map", title, data=data, summary=merged_row(total, counts), omitted=omitted)


def _first_column(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((c for n in names if (c := find_column(df, n))), None)


def resolve_intent(spark, question: str) -> str:
    """:func:`visual_intent` of one text."""
    return spark.createDataFrame([(question or "",)], "q string").select(visual_intent(F.col("q"))).first()[0]


def build_visual(intent: str, numeric: DataFrame | None, metadata: DataFrame | None,
                 positions: DataFrame | None = None, aggregate_column: str | None = None,
                 ties: Sequence[str] = ()) -> Visual:
    """The visual for an intent, chosen from the columns at hand.

    ``positions`` (time and place rows) feed the map; without them the metadata
    frame is tried. An intent whose columns are absent falls back to a table of
    metadata, then of measurements. Pass None for a frame without rows.
    """
    place = positions if positions is not None else metadata
    if intent == "map" and place is not None:
        return map_points(place, "Profiles: geographic sample", label="PLATFORM_NUMBER")
    if numeric is not None:
        if intent == "time_series":
            x = _first_column(numeric, ("juld", "date", "time"))
            y = _first_column(numeric, ("TEMP", "PSAL", "PRES", "TEMP_ADJUSTED", "PSAL_ADJUSTED"))
            if x and y:
                return chart_series(numeric, x, y, f"{y} over time", ties=ties)
        if intent == "profile":
            x = _first_column(numeric, ("PRES", "pressure", "depth"))
            y = _first_column(numeric, ("TEMP", "TEMP_ADJUSTED", "temperature"))
            z = _first_column(numeric, ("PSAL", "PSAL_ADJUSTED", "salinity"))
            if x and (y or z):
                return chart_series(numeric, x, y or z, f"{'Temperature' if y else 'Salinity'} profile (sample)", ties=ties)
        if intent == "aggregate":
            c = aggregate_column or first_variable(numeric)
            if c:
                return table_preview(aggregate_table(numeric, c), f"Aggregates for {c}")
    if metadata is not None:
        return table_preview(metadata, "Metadata sample")
    if numeric is not None:
        return table_preview(numeric, "Numeric sample")
    return Visual("none", reason="No suitable data for visualization.")


def payload_json(visual: Visual) -> str:
    """JSON text of a visual for the result sink (at most 200 rows are collected)."""
    import json

    payload = {"type": visual.kind, "title": visual.title, **visual.options}
    if visual.reason:
        return json.dumps({"type": "visualization_unavailable" if visual.kind == "unavailable" else visual.kind,
                           "reason": visual.reason})
    rows = visual.data
    if "ordinal" in rows.columns:
        rows = rows.orderBy("ordinal").drop("ordinal")
    elif "row_index" in rows.columns:
        rows = rows.orderBy("row_index").drop("row_index")
    cells = rows.select(*[json_cell(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields])
    records = [r.asDict() for r in cells.collect()]
    totals = [json_cell(F.col(f.name), f.dataType).alias(f.name) for f in visual.summary.schema.fields]
    summary = json.loads(visual.summary.select(F.to_json(F.struct(*totals))).first()[0])
    if visual.kind == "table":
        payload["rows"] = [list(r.values()) for r in records]
    else:
        payload["points" if visual.kind == "map" else "data"] = records
    payload.update(summary)
    if visual.omitted is not None:
        payload["omitted_reasons"] = [r.asDict() for r in visual.omitted.collect()]
    return json.dumps(payload)
