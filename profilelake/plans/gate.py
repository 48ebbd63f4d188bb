"""Data gate: can a question be answered from the data at hand?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilelake.operators.quality import null_rates, profile_exists
from profilelake.session import materialized

# Intents whose region and platform are checked, and the missing-rate limit.
CHECKED_INTENTS = ("measurement", "compare", "nearest", "qc_query")
MAX_NULL_RATE = 0.8


# Cells beyond the globe gather whatever lies outside it. They are never inside
# a box as a whole, so odd positions are still compared exactly.
LAT_CELLS, LON_CELLS = (-91, 91), (-361, 361)
FINE = 16           # parts of a cell's side, where a border crosses it


def _cell(c: Column, limits: tuple[int, int]) -> Column:
    low, high = limits
    return F.floor(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))).cast("int")


def summed_area(cells: DataFrame) -> DataFrame:
    """(_lat_cell, _lon_cell, _sum) of the whole grid: positions in all cells that lie no higher in either direction.

    ``cells``: _lat_cell, _lon_cell, _n. Prefix sums along each row of cells,
    then along each column: 183 x 723 rows, whatever the data.
    """
    (y0, y1), (x0, x1) = LAT_CELLS, LON_CELLS
    wide = x1 - x0 + 1
    grid = cells.sparkSession.range((y1 - y0 + 1) * wide).select(
        (F.floor(F.col("id") / wide) + y0).cast("int").alias("_lat_cell"), (F.col("id") % wide + x0).cast("int").alias("_lon_cell"))
    full = grid.join(cells.select("_lat_cell", "_lon_cell", "_n"), ["_lat_cell", "_lon_cell"], "left")
    along = full.withColumn("_row", F.sum(F.coalesce("_n", F.lit(0))).over(Window.partitionBy("_lat_cell").orderBy("_lon_cell")))
    return along.select("_lat_cell", "_lon_cell", F.sum("_row").over(Window.partitionBy("_lon_cell").orderBy("_lat_cell")).alias("_sum"))


BOX = ("lat_min", "lat_max", "lon_min", "lon_max")


def _touched(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inside, crossed) of boxes met with places of tight bounds."""
    met = met.where((F.col("_y1") >= F.col("lat_min")) & (F.col("_y0") <= F.col("lat_max"))
                    & (F.col("_x1") >= F.col("lon_min")) & (F.col("_x0") <= F.col("lon_max")))
    inside = ((F.col("_y0") >= F.col("lat_min")) & (F.col("_y1") <= F.col("lat_max"))
              & (F.col("_x0") >= F.col("lon_min")) & (F.col("_x1") <= F.col("lon_max")))
    return met.where(inside), met.where(~inside)


def region_hits(boxes: DataFrame, positions: DataFrame, key: str = "query_id") -> DataFrame:
    """Positions inside each box (columns key, bbox), zero included; rows without a box are left out.

    Equal boxes are counted once. Positions are reduced to whole degrees; the
    cells between a box's border cells come from a summed-area table by four
    lookups, however large the box. Of the cells on its border only those that
    hold positions are met, by row and by column; where the border parts a cell's
    positions, its FINE x FINE parts are looked up, and single positions only in
    the parts it still crosses. No box is compared with every position or cell.
    """
    # written, since both ends read them; filtered after that, so that a filter does not search the texts once more
    boxes = materialized(boxes.select(key, "bbox")).where("bbox IS NOT NULL")
    lat, lon = F.col("LATITUDE").cast("double"), F.col("LONGITUDE").cast("double")
    known = positions.select(lat.alias("LATITUDE"), lon.alias("LONGITUDE")).where(
        F.col("LATITUDE").isNotNull() & F.col("LONGITUDE").isNotNull()
        & ~F.isnan("LATITUDE") & ~F.isnan("LONGITUDE"))
    known = known.withColumns({
        "_lat_cell": _cell(F.col("LATITUDE"), LAT_CELLS), "_lon_cell": _cell(F.col("LONGITUDE"), LON_CELLS)})
    part = lambda c, cell: F.pmod(F.floor((F.col(c) - F.col(cell)) * FINE), F.lit(FINE)).cast("int")
    known = known.withColumn("_part", part("LATITUDE", "_lat_cell") * FINE + part("LONGITUDE", "_lon_cell"))
    place = ["_lat_cell", "_lon_cell"]
    parts = materialized(known.groupBy(*place, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("LATITUDE").alias("_y0"), F.max("LATITUDE").alias("_y1"),
        F.min("LONGITUDE").alias("_x0"), F.max("LONGITUDE").alias("_x1")))
    cells = materialized(parts.groupBy(*place).agg(
        F.sum("_n").alias("_n"), F.min("_y0").alias("_y0"), F.max("_y1").alias("_y1"), F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1")))

    real = boxes.select("bbox").distinct().select("bbox", "bbox.*").where(F.col("lat_min") <= F.col("lat_max")).where(
        ~F.isnan("lat_max") & ~F.isnan("lon_max") & (F.col("lon_min") <= F.col("lon_max")))
    real = materialized(real.withColumns({
        "_a0": _cell(F.col("lat_min"), LAT_CELLS), "_a1": _cell(F.col("lat_max"), LAT_CELLS),
        "_o0": _cell(F.col("lon_min"), LON_CELLS), "_o1": _cell(F.col("lon_max"), LON_CELLS)}))

    # cells between the border cells: inclusion and exclusion of four corners
    corner = lambda y, x, sign: F.struct(y.alias("_lat_cell"), x.alias("_lon_cell"), F.lit(sign).alias("_sign"))     # noqa: E731
    top, bottom, right, left = F.col("_a1") - 1, F.col("_a0"), F.col("_o1") - 1, F.col("_o0")
    corners = real.where((top > bottom) & (right > left)).select("bbox", F.inline(F.array(
        corner(top, right, 1), corner(bottom, right, -1), corner(top, left, -1), corner(bottom, left, 1))))
    between = corners.join(summed_area(cells), place).select("bbox", (F.col("_sign") * F.col("_sum")).alias("_n"))

    # border cells that hold positions: the two rows at full width, the two columns between them
    rows = real.withColumn("_lat_cell", F.explode(F.array_distinct(F.array("_a0", "_a1")))).join(cells, "_lat_cell").where(
        F.col("_lon_cell").between(F.col("_o0"), F.col("_o1")))
    columns = real.withColumn("_lon_cell", F.explode(F.array_distinct(F.array("_o0", "_o1")))).join(cells, "_lon_cell").where(
        (F.col("_lat_cell") > F.col("_a0")) & (F.col("_lat_cell") < F.col("_a1")))
    names = ["bbox", *BOX, *place]
    whole, crossed = _touched(rows.select(*names, "_n", "_y0", "_y1", "_x0", "_x1").unionByName(
        columns.select(*names, "_n", "_y0", "_y1", "_x0", "_x1")))
    fine, crossed = _touched(crossed.select(*names).join(parts, place))
    points = known.groupBy(*place, "_part", "LATITUDE", "LONGITUDE").agg(F.count(F.lit(1)).alias("_n"))
    single = points.join(crossed.select(*names, "_part"), [*place, "_part"]).where(
        F.col("LATITUDE").between(F.col("lat_min"), F.col("lat_max")) & F.col("LONGITUDE").between(F.col("lon_min"), F.col("lon_max")))
    found = between
    for p in (whole, fine, single):
        found = found.unionByName(p.select("bbox", "_n"))
    hits = found.groupBy("bbox").agg(F.sum("_n").alias("hits")).withColumnRenamed("bbox", "_box")
    return boxes.join(hits, F.col("bbox").eqNullSafe(F.col("_box")), "left").select(
        key, F.coalesce("hits", F.lit(0)).cast("bigint").alias("region_hits"))


def gate(questions: DataFrame, positions: DataFrame, core: DataFrame, key: str = "query_id") -> DataFrame:
    """Decision per analysed question; the first failing check wins.

    Coverage and missing rates are computed once for the whole batch.
    """
    questions = materialized(questions)   # read by every check
    checked = F.col("intent").isin(*CHECKED_INTENTS)
    boxes = questions.where(checked & F.col("bbox").isNotNull()).select(key, "bbox")
    regions = region_hits(boxes, positions, key)

    asked = questions.where(checked & (F.coalesce("platform_number", F.lit(0)) != 0))
    requests = asked.select("platform_number", "profile_index").distinct()
    found = profile_exists(requests, core).select(
        F.col("platform_number").alias("_p"), F.col("profile_index").alias("_i"), F.col("found").alias("platform_found"))
    platforms = asked.join(
        found, F.col("platform_number").eqNullSafe(F.col("_p")) & F.col("profile_index").eqNullSafe(F.col("_i"))
    ).select(key, "platform_found")

    rates = null_rates(core, ["TEMP", "PSAL", "PRES", "DOXY", "CHLA", "NITRATE"])
    bad = rates.where(F.col("null_rate") > MAX_NULL_RATE).select("variable")
    sparse = questions.select(key, F.explode("variables").alias("variable")).join(bad, "variable")
    sparse = sparse.groupBy(key).agg(F.min("variable").alias("sparse_variable"))

    out = questions.join(regions, key, "left").join(platforms, key, "left").join(sparse, key, "left")
    decision = (
        F.when(F.col("region_hits") == 0, "INSUFFICIENT_DATA_REGION")
        .when(~F.col("platform_found"), "INSUFFICIENT_DATA_PLATFORM")
        .when(F.col("sparse_variable").isNotNull(), F.concat(F.lit("INSUFFICIENT_DATA_NULLRATE_"), "sparse_variable"))
        .otherwise("PROCEED_RAG")
    )
    return out.withColumn("decision", decision)
