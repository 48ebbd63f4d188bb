"""Counts, coverage, missing rates, statistics and reconciliation."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.inputs import M, P, measurements, ntz, positions, table
from catalog.registry import query
from profilelake.operators import quality, stats
from profilelake.schemas import LAYER_FILE_PREFIX
from profilelake.session import scratch_path
from profilelake.sources import layer_csv, tables

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


@query("layer_rowcounts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def rowcounts(spark, d):
    return quality.row_counts({t: table(spark, d, t) for t in TABLES})


@query("month_rowcounts", f"WITH {M} SELECT 'core_measurements' AS layer, year, month, count(*) AS row_count FROM m GROUP BY ALL")
def month_rowcounts(spark, d):
    return quality.partition_counts(measurements(spark, d), "core_measurements")


@query("time_coverage", """SELECT 'events' AS table_name, min(ts) AS min_juld, max(ts) AS max_juld FROM events
UNION ALL SELECT 'orders', min(o_orderdate), max(o_orderdate) FROM orders
UNION ALL SELECT 'lineitem', min(l_shipdate), max(l_shipdate) FROM lineitem""")
def coverage(spark, d):
    parts = [quality.time_coverage(table(spark, d, t), c).withColumn("table_name", F.lit(t))
             for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_BOX = "LATITUDE BETWEEN -10 AND 40 AND LONGITUDE BETWEEN 20 AND 120.5"


@query("region_coverage", f"WITH {P} SELECT 'time_location' AS table_name, count(*) AS hits FROM p WHERE {_BOX}")
def region(spark, d):
    tables_ = {"time_location": positions(spark, d), "core_measurements": measurements(spark, d)}
    return quality.region_counts(tables_, -10, 40, 20, 120.5)


@query("region_sample", f"WITH {P} SELECT * FROM p WHERE {_BOX} ORDER BY PLATFORM_NUMBER LIMIT 10")
def region_sample(spark, d):
    return quality.region_sample(positions(spark, d), -10, 40, 20, 120.5, ["PLATFORM_NUMBER"])


@query("regional_average", f"WITH {P} SELECT round(avg(value), 6) AS avg_value, count(*) AS num_records FROM p WHERE {_BOX} AND value IS NOT NULL")
def regional_average(spark, d):
    return quality.regional_average(positions(spark, d), "value", -10, 40, 20, 120.5).withColumn("avg_value", F.round("avg_value", 6))


@query("null_rate", f"""WITH {M}, c AS (SELECT count(*) AS total, count(TEMP) AS a, count(TEMP_ADJUSTED) AS b, count(PSAL_ADJUSTED) AS c FROM m)
SELECT 'TEMP' AS variable, total, a AS non_null, round(1 - a / total, 9) AS null_rate FROM c
UNION ALL SELECT 'TEMP_ADJUSTED', total, b, round(1 - b / total, 9) FROM c
UNION ALL SELECT 'PSAL_ADJUSTED', total, c, round(1 - c / total, 9) FROM c""")
def null_rate(spark, d):
    rates = quality.null_rates(measurements(spark, d), ["TEMP", "TEMP_ADJUSTED", "PSAL_ADJUSTED", "DOXY"])
    return rates.withColumn("null_rate", F.round("null_rate", 9))


@query("null_summary", f"""WITH {M}, {P}
SELECT 'core_measurements' AS layer, 'profile_index' AS column_name, count(profile_index) AS non_null, count(*) AS total FROM m
UNION ALL SELECT 'core_measurements', 'TEMP_ADJUSTED', count(TEMP_ADJUSTED), count(*) FROM m
UNION ALL SELECT 'core_measurements', 'DOXY', 0, 0
UNION ALL SELECT 'time_location', 'LATITUDE', count(LATITUDE), count(*) FROM p
UNION ALL SELECT 'time_location', 'LONGITUDE', count(LONGITUDE), count(*) FROM p""")
def null_summary(spark, d):
    return quality.null_summary(
        {"core_measurements": measurements(spark, d), "time_location": positions(spark, d)},
        {"core_measurements": ("profile_index", "TEMP_ADJUSTED", "DOXY"), "time_location": ("LATITUDE", "LONGITUDE")})


@query("qc_distribution", "SELECT CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS PSAL_QC, count(*) AS cnt FROM lineitem GROUP BY 1")
def qc_distribution(spark, d):
    flags = measurements(spark, d).select(F.when(F.col("PSAL_QC") != "A", F.col("PSAL_QC")).alias("PSAL_QC"))
    return quality.flag_distribution(flags)


@query("profile_exists_batch", f"""WITH {M}, r AS (SELECT c_custkey AS platform_number,
 CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey AS BIGINT) * 5 END AS profile_index FROM customer)
SELECT *, CASE WHEN profile_index IS NULL THEN platform_number IN (SELECT platform_number FROM m)
 ELSE EXISTS (SELECT 1 FROM m WHERE m.platform_number = r.platform_number AND m.profile_index = r.profile_index) END AS found FROM r""")
def exists(spark, d):
    requests = table(spark, d, "customer").select(
        F.col("c_custkey").alias("platform_number"),
        F.expr("CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey AS BIGINT) * 5 END").alias("profile_index"))
    return quality.profile_exists(requests, measurements(spark, d))


@query("schema_listing", """SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name,
 CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS data_type,
 CASE WHEN table_name = 'supplier' THEN column_name <> 's_name' END AS as_expected
FROM information_schema.columns WHERE table_name IN ('lineitem', 'supplier', 'embeddings')""")
def schema_listing(spark, d):
    """Types of three tables; one is checked against a schema that differs in a column."""
    found = {t: table(spark, d, t) for t in ("lineitem", "supplier", "embeddings")}
    expected = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "s_name" else f.dataType) for f in found["supplier"].schema.fields])
    return quality.schema_rows(found, {"supplier": expected})


@query("sample_heads", """SELECT 'orders' AS table_name, o_orderkey AS key FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= 3
UNION ALL SELECT 'part', p_partkey FROM part QUALIFY row_number() OVER (ORDER BY p_partkey) <= 3""")
def sample_heads(spark, d):
    def head(name, key):
        first = quality.head_rows(table(spark, d, name), [key])
        return first.select(F.lit(name).alias("table_name"), F.get_json_object("row_json", f"$.{key}").cast("bigint").alias("key"))

    return head("orders", "o_orderkey").unionByName(head("part", "p_partkey"))


_STATS = ("TEMP", "PSAL", "PRES", "TEMP_ADJUSTED", "PSAL_ADJUSTED")


@query("six_stat_summary", f"WITH {M} " + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, count({v}) AS count, round(avg({v}), 4) AS mean, round(median({v}), 4) AS median, "
    f"round(min({v}), 4) AS min, round(max({v}), 4) AS max, round(stddev_samp({v}), 4) AS std FROM m" for v in _STATS))
def six_stats(spark, d):
    return stats.six_statistics(measurements(spark, d), digits=4)


@query("six_stat_by_platform", f"WITH {M} " + " UNION ALL ".join(
    f"SELECT platform_number, '{v}' AS variable, count({v}) AS count, round(avg({v}), 4) AS mean, round(median({v}), 4) AS median, "
    f"round(min({v}), 4) AS min, round(max({v}), 4) AS max, round(stddev_samp({v}), 4) AS std FROM m GROUP BY platform_number"
    for v in ("TEMP", "PSAL_ADJUSTED")))
def six_stats_platform(spark, d):
    return stats.six_statistics(measurements(spark, d), ("TEMP", "PSAL_ADJUSTED"), ["platform_number"], digits=4)


@query("profile_summary", f"""WITH {M} SELECT platform_number, profile_index, max(juld) AS latest_juld, count(level_index) AS n_levels
FROM m WHERE platform_number IS NOT NULL AND profile_index IS NOT NULL GROUP BY ALL""")
def profile_summary(spark, d):
    return stats.profile_summary(measurements(spark, d))


@query("latest_profiles", f"""WITH {M} SELECT platform_number, profile_index, max(juld) AS latest_juld, count(level_index) AS n_levels
FROM m GROUP BY ALL ORDER BY latest_juld DESC, platform_number, profile_index LIMIT 66""")
def latest(spark, d):
    return stats.latest_profiles(measurements(spark, d), 200)


@query("coverage_summary", f"""WITH {M}, ids AS (SELECT platform_number, profile_index FROM m UNION ALL SELECT c_custkey, c_nationkey FROM customer)
SELECT (SELECT count(DISTINCT platform_number) FROM ids) AS platforms, (SELECT count(DISTINCT profile_index) FROM ids) AS profiles,
 count(*) AS numeric_rows, min(juld) AS juld_min, max(juld) AS juld_max FROM m""")
def coverage_summary(spark, d):
    hits = table(spark, d, "customer").select(
        F.col("c_custkey").alias("platform_number"), F.col("c_nationkey").cast("bigint").alias("profile_index"))
    return stats.coverage_summary(measurements(spark, d), hits)


@query("aggregate_table", f"WITH {M} SELECT count(PSAL_ADJUSTED) AS count, round(avg(PSAL_ADJUSTED), 9) AS mean, min(PSAL_ADJUSTED) AS min, max(PSAL_ADJUSTED) AS max FROM m")
def aggregates(spark, d):
    return stats.aggregate_table(measurements(spark, d)).withColumn("mean", F.round("mean", 9))


@query("row_budget", f"""WITH {M} SELECT platform_number, count(*) AS n_rows,
 CAST(CASE WHEN count(*) <= 50 THEN 50 WHEN count(*) <= 1000 THEN 200 WHEN count(*) <= 10000 THEN 500 ELSE 200 END AS INTEGER) AS budget
FROM m GROUP BY platform_number""")
def budgets(spark, d):
    counts = measurements(spark, d).groupBy("platform_number").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("budget", stats.row_budget(F.col("n_rows")))


_SMD_COLUMNS = "platform_number, profile_index, level_index, PRES"


@query("surface_median_deep", f"""WITH e AS (SELECT user_id AS platform_number, event_type AS profile_index, event_id AS level_index,
 CASE WHEN event_type <> 'error' OR value > 50 THEN value END AS PRES FROM events),
k AS (SELECT *, median(PRES) OVER (PARTITION BY platform_number, profile_index) AS med,
 count(PRES) OVER (PARTITION BY platform_number, profile_index) AS n FROM e),
r AS (SELECT *,
 row_number() OVER (PARTITION BY platform_number, profile_index ORDER BY PRES NULLS LAST, level_index) AS a,
 row_number() OVER (PARTITION BY platform_number, profile_index ORDER BY round(abs(PRES - med), 9) NULLS LAST, level_index) AS b,
 row_number() OVER (PARTITION BY platform_number, profile_index ORDER BY PRES DESC NULLS LAST, level_index) AS c,
 row_number() OVER (PARTITION BY platform_number, profile_index ORDER BY level_index) AS f,
 row_number() OVER (PARTITION BY platform_number, profile_index ORDER BY level_index DESC) AS l FROM k)
SELECT {_SMD_COLUMNS} FROM r WHERE (n > 0 AND (a = 1 OR b = 1 OR c = 1)) OR (n = 0 AND (f = 1 OR l = 1))""")
def smd(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").alias("platform_number"), F.col("event_type").alias("profile_index"),
        F.col("event_id").alias("level_index"),
        F.expr("CASE WHEN event_type <> 'error' OR value > 50 THEN value END").alias("PRES"))
    return stats.surface_median_deep(e)


# --- through files: CSV written from the tables, loaded and compared -------------

def _csv_rows(spark, d):
    """Position layer of the customers, spread over the months of a year."""
    return positions(spark, d).select(
        (F.col("PLATFORM_NUMBER") % 50).alias("profile_index"), "LATITUDE", "LONGITUDE",
        F.timestamp_seconds(F.col("PLATFORM_NUMBER") * 3600).alias("JULD"), F.lit(None).cast("string").alias("JULD_LOCATION"),
        F.lit("19500101000000").alias("REFERENCE_DATE_TIME"), F.lit("1").alias("POSITION_QC"), F.lit("GPS").alias("POSITIONING_SYSTEM"),
        F.lit("A").alias("DIRECTION"), "PLATFORM_NUMBER", F.lit(" nan ").alias("PROJECT_NAME"), F.lit("x, \"y\"").alias("PI_NAME"),
        F.format_string("%02d", (F.col("PLATFORM_NUMBER") % 12 + 1).cast("int")).alias("mm"))


def place_files(spark, rows, staged, root, layer):
    """Write rows (column ``month``) as CSV files named like layer files under <root>/2025/<month>/.

    One write makes all months; only the files' names are then changed, as the
    writer has no option for them.
    """
    rows.hint("rebalance", "month").write.partitionBy("month").option("header", True).csv(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(path(staged)):
        month = folder.getPath().getName().removeprefix("month=")
        if folder.isDirectory():
            fs.mkdirs(path(f"{root}/2025/{month}"))
            for i, status in enumerate(fs.listStatus(folder.getPath())):
                fs.rename(status.getPath(), path(f"{root}/2025/{month}/{LAYER_FILE_PREFIX}{layer}_{i}.csv"))


def _store_months(spark, d):
    root, rows = scratch_path(spark, "layer-csv"), _csv_rows(spark, d)
    place_files(spark, rows.withColumnRenamed("mm", "month"), f"{root}/staged", f"{root}/csv", "time_location")
    return f"{root}/csv", f"{root}/tables"


def _converted(outcome):
    failed = [o for o in outcome if o[1] != "OK"]
    if failed:
        raise RuntimeError(f"layers not converted: {failed}")


@query("layer_ingest", """WITH p AS (SELECT c_custkey AS PLATFORM_NUMBER,
 c_custkey % 50 AS profile_index,
 CASE WHEN c_mktsegment <> 'BUILDING' THEN (c_custkey * 37 % 18000) / 100E0 - 90E0 END AS LATITUDE,
 CASE WHEN c_nationkey <> 7 THEN (c_custkey * 53 % 36000) / 100E0 - 180E0 END AS LONGITUDE,
 make_timestamp(c_custkey * 3600000000) AS JULD, TIMESTAMP '1950-01-01' AS REFERENCE_DATE_TIME,
 CAST(NULL AS VARCHAR) AS PROJECT_NAME, 'x, "y"' AS PI_NAME, '2025' AS year, printf('%02d', c_custkey % 12 + 1) AS month FROM customer)
SELECT * FROM p""")
def layer_ingest(spark, d):
    csv_root, table_root = _store_months(spark, d)
    _converted(tables.convert_layers(spark, csv_root, table_root, ["time_location"]))
    rows = tables.read_table(spark, f"{table_root}/time_location", "time_location")
    return ntz(rows.select("profile_index", "LATITUDE", "LONGITUDE", "JULD", "REFERENCE_DATE_TIME", "PLATFORM_NUMBER",
                           "PROJECT_NAME", "PI_NAME", "year", "month"))


@query("reconcile_layers", """SELECT 'time_location' AS layer, '2025' AS year, printf('%02d', c_custkey % 12 + 1) AS month,
 count(*) AS csv_rows, count(*) AS parquet_rows, true AS matches, '' AS issues FROM customer GROUP BY ALL""")
def reconcile(spark, d):
    csv_root, table_root = _store_months(spark, d)
    layer = "time_location"
    _converted(tables.convert_layers(spark, csv_root, table_root, [layer]))
    loaded = tables.read_table(spark, f"{table_root}/{layer}", layer)
    counted = quality.partition_counts(loaded, layer).withColumnRenamed("row_count", "parquet_rows")
    report = quality.reconcile(layer_csv.source_counts(spark, csv_root, layer), counted)
    return report.withColumn("issues", F.array_join("issues", ","))

