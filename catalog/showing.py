"""Bounded visuals, contexts, and incremental ingest."""

from pyspark.sql import functions as F

from catalog.inputs import M, MD, P, measurements, metadata, ntz, positions, table
from catalog.registry import query
from profilelake.functions.text import csv_line, shorten, tokens_estimate
from profilelake.operators.ranking import pick_evenly
from profilelake.plans import context, visuals
from profilelake.session import scratch_path
from profilelake.streaming import ingest

_TARGETS = "t AS (SELECT DISTINCT CASE WHEN n <= 200 THEN i ELSE i * (n - 1) // 199 END AS ordinal FROM range(200) r(i), (SELECT count(*) AS n FROM events) WHERE i < n)"


@query("chart_downsample", f"""WITH {_TARGETS}, e AS (SELECT ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS ordinal FROM events)
SELECT e.ordinal, ts, value FROM e JOIN t ON e.ordinal = t.ordinal""")
def downsample(spark, d):
    e = table(spark, d, "events").select("ts", "value", "event_id")
    return visuals.chart_series(e, "ts", "value", ties=["event_id"]).data


@query("chart_downsample_skewed", """WITH e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, event_id) - 1 AS ordinal, count(*) OVER () AS n FROM events)
SELECT event_id, event_type, ordinal FROM e WHERE ordinal IN (SELECT i * (n - 1) // 49 FROM range(50) r(i))""")
def downsample_skewed(spark, d):
    """Few sort values, so that equal ones span several tasks."""
    picked, _ = pick_evenly(table(spark, d, "events").select("event_id", "event_type"), [F.col("event_type"), F.col("event_id")], 50)
    return picked


@query("chart_summary", "SELECT min(ts) AS x_min, max(ts) AS x_max, min(value) AS y_min, max(value) AS y_max, count(*) AS row_count, count(*) > 200 AS downsampled FROM events")
def chart_summary(spark, d):
    return visuals.chart_series(table(spark, d, "events"), "ts", "value", ties=["event_id"]).summary


@query("map_points", f"""WITH {P}, f AS (SELECT *, row_number() OVER (ORDER BY PLATFORM_NUMBER) - 1 AS row_index FROM p)
SELECT row_index, LATITUDE AS lat, LONGITUDE AS lon, CAST(PLATFORM_NUMBER AS VARCHAR) AS label FROM f
WHERE row_index < 200 AND LATITUDE IS NOT NULL AND LONGITUDE IS NOT NULL""")
def map_points(spark, d):
    return visuals.map_points(positions(spark, d), label="platform_number", order=["PLATFORM_NUMBER"]).data


@query("map_omitted", f"""WITH {P}, f AS (SELECT *, row_number() OVER (ORDER BY PLATFORM_NUMBER) - 1 AS row_index FROM p)
SELECT row_index, 'missing lat or lon' AS reason FROM f WHERE row_index < 200 AND (LATITUDE IS NULL OR LONGITUDE IS NULL)""")
def map_omitted(spark, d):
    return visuals.map_points(positions(spark, d), order=["PLATFORM_NUMBER"]).omitted


@query("map_summary", f"""WITH {P}, f AS (SELECT *, row_number() OVER (ORDER BY PLATFORM_NUMBER) AS r FROM p)
SELECT count(*) AS row_count, count(CASE WHEN r <= 200 AND LATITUDE IS NOT NULL AND LONGITUDE IS NOT NULL THEN 1 END) AS returned_count,
 count(CASE WHEN r <= 200 AND (LATITUDE IS NULL OR LONGITUDE IS NULL) THEN 1 END) AS omitted_count FROM f""")
def map_summary(spark, d):
    return visuals.map_points(positions(spark, d), order=["PLATFORM_NUMBER"]).summary


@query("table_preview", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderstatus
FROM orders ORDER BY orders.o_orderkey LIMIT 200""")
def table_preview(spark, d):
    return visuals.table_preview(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), order=["o_orderkey"]).data


@query("table_preview_summary", "SELECT count(*) AS row_count FROM orders")
def table_preview_summary(spark, d):
    return visuals.table_preview(table(spark, d, "orders"), order=["o_orderkey"]).summary


_CASES = ("map", "time_series", "profile", "aggregate", "table")


@query("visual_routing", f"""WITH {M}, {P} SELECT 'map' AS intent, 'map' AS kind, 'Profiles: geographic sample' AS title, (SELECT count(*) FROM p) AS row_count
UNION ALL SELECT 'time_series', 'chart', 'TEMP over time', (SELECT count(*) FROM m)
UNION ALL SELECT 'profile', 'chart', 'Temperature profile (sample)', (SELECT count(*) FROM m)
UNION ALL SELECT 'aggregate', 'table', 'Aggregates for PSAL_ADJUSTED', 1
UNION ALL SELECT 'table', 'table', 'Metadata sample', (SELECT count(*) FROM supplier)""")
def visual_routing(spark, d):
    parts = []
    for intent in _CASES:
        v = visuals.build_visual(intent, measurements(spark, d), metadata(spark, d), positions(spark, d), ties=("row_ordinal", "level_index"))
        parts.append(v.summary.select(F.lit(intent).alias("intent"), F.lit(v.kind).alias("kind"), F.lit(v.title).alias("title"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("csv_snippets", """SELECT o_orderkey, o_orderkey || ',' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ',"' || o_orderstatus || ', x"' AS line FROM orders""")
def csv_snippets(spark, d):
    o = table(spark, d, "orders").withColumn("note", F.concat("o_orderstatus", F.lit(", x")))
    return o.select("o_orderkey", csv_line(o, ["o_orderkey", "o_orderdate", "note"]).alias("line"))


@query("token_estimates", """WITH f AS (SELECT doc_id, text, regexp_replace(trim(text, E' \\t\\n\\r\\x0b\\x0c'), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g') AS flat FROM documents)
SELECT doc_id, greatest(1, length(text) // 4) AS tokens,
 CASE WHEN length(flat) <= 200 THEN flat ELSE rtrim(regexp_extract(substring(flat, 1, 198), '^(.{0,197})(?:\\s|$)', 1)) || '...' END AS shown FROM f""")
def token_estimates(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", tokens_estimate(F.length("text")).alias("tokens"), shorten(F.col("text")).alias("shown"))


# --- contexts: every platform's project asks for its measurements -----------------------

def _project_inputs(spark, d):
    about = metadata(spark, d)
    region = table(spark, d, "region").select(F.col("r_name").alias("query_id"), F.concat(F.lit("Show me "), "r_name").alias("text"))
    wanted = about.select(F.col("project_name").alias("query_id"), "platform_number")
    rows = measurements(spark, d).join(wanted, "platform_number")
    hits = about.select(
        F.col("project_name").alias("query_id"), F.col("platform_number").alias("id"),
        F.create_map(F.lit("PLATFORM_NUMBER"), F.col("platform_number").cast("string")).alias("metadata"),
        (1 / (1 + F.col("platform_number"))).alias("score"), "platform_number", F.lit(None).cast("bigint").alias("profile_index"))
    from pyspark.sql import Window
    hits = hits.withColumn("hit_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    return region, hits, rows, about.withColumn("query_id", F.col("project_name"))


@query("context_rows", f"""WITH {M}, {MD}, r AS (SELECT project_name AS query_id, m.* FROM m JOIN md USING (platform_number)),
b AS (SELECT query_id, CASE WHEN count(*) <= 50 THEN 50 WHEN count(*) <= 1000 THEN 200 WHEN count(*) <= 10000 THEN 500 ELSE 200 END AS budget FROM r GROUP BY query_id),
pr AS (SELECT query_id, platform_number, profile_index, row_number() OVER (PARTITION BY query_id ORDER BY max(juld) DESC, platform_number, profile_index) AS k
 FROM r GROUP BY query_id, platform_number, profile_index),
s AS (SELECT r.*, median(PRES) OVER w AS med FROM r JOIN pr USING (query_id, platform_number, profile_index) JOIN b USING (query_id)
 WHERE k <= budget // 3 WINDOW w AS (PARTITION BY query_id, platform_number, profile_index)),
picked AS (SELECT query_id, count(*) AS sample_rows FROM (SELECT query_id,
 row_number() OVER (PARTITION BY query_id, platform_number, profile_index ORDER BY PRES, level_index) AS a,
 row_number() OVER (PARTITION BY query_id, platform_number, profile_index ORDER BY round(abs(PRES - med), 9), level_index) AS m_,
 row_number() OVER (PARTITION BY query_id, platform_number, profile_index ORDER BY PRES DESC, level_index) AS z FROM s) WHERE a = 1 OR m_ = 1 OR z = 1 GROUP BY query_id)
SELECT query_id, (SELECT count(*) FROM md WHERE project_name = query_id) AS retrieved_count, count(*) AS numeric_rows,
 count(DISTINCT platform_number) AS platforms, count(DISTINCT profile_index) AS profiles, min(juld) AS juld_min, max(juld) AS juld_max,
 any_value(CAST(sample_rows AS INTEGER)) AS sample_rows, round(avg(TEMP), 4) AS mean_temp, round(median(TEMP), 4) AS median_temp, true AS within_limit
FROM r JOIN picked USING (query_id) GROUP BY query_id""")
def context_rows(spark, d):
    rows = context.assemble(*_project_inputs(spark, d))

    def stat(name):
        return F.round(F.get_json_object("stats_json", f"$.TEMP.{name}").cast("double"), 4).alias(f"{name}_temp")

    return rows.where("numeric_rows > 0").select(
        "query_id", "retrieved_count", "numeric_rows", "platforms", "profiles", "juld_min", "juld_max", "sample_rows",
        stat("mean"), stat("median"), (F.col("tokens") <= 12000).alias("within_limit"))


@query("metadata_only_contexts", f"""WITH {MD} SELECT r_name AS query_id, least(10, (SELECT count(*) FROM md WHERE project_name = r_name)) AS n_lines
FROM region WHERE r_name NOT IN (SELECT project_name FROM md WHERE platform_number IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3))""")
def metadata_only(spark, d):
    asked, hits, _, _ = _project_inputs(spark, d)
    marked = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_nationkey = 3").select(F.col("c_custkey").alias("platform_number"))
    cand = hits.select("query_id", "platform_number").join(marked, "platform_number", "left_semi")
    alone = context.metadata_only_context(asked, hits, cand)
    return alone.select("query_id", (F.size(F.split("context", "DOC_ID=")) - 1).cast("bigint").alias("n_lines"))


# --- streams ------------------------------------------------------------------

_CORE_COLUMNS = ["profile_index", "platform_number", "juld", "level_index", "PRES", "TEMP", "PSAL",
                 "PRES_QC", "PRES_ADJUSTED", "TEMP_QC", "TEMP_ADJUSTED", "PSAL_QC", "PSAL_ADJUSTED"]


@query("incremental_ingest", f"""WITH {M} SELECT '2025' AS year, month, count(*) AS row_count, round(sum(TEMP), 2) AS sum_temp, count(TEMP_ADJUSTED) AS n_adjusted FROM m GROUP BY month""")
def incremental(spark, d):
    """Two deliveries of half a year's files and repeated runs; each file counts once."""
    from catalog.checking import place_files

    root = scratch_path(spark, "stream")
    rows = measurements(spark, d).withColumns({
        "PRES_ADJUSTED": F.lit(None).cast("double"), "TEMP_QC": F.lit("1")})
    out, checkpoint = f"{root}/core", f"{root}/log"
    for part, half in enumerate((F.col("month") <= "06", F.col("month") > "06")):
        place_files(spark, rows.where(half).select(*_CORE_COLUMNS, "month"), f"{root}/{part}", f"{root}/csv", "core_measurements")
        for _ in range(2):
            ingest.ingest_new_files(ingest.layer_stream(spark, f"{root}/csv", "core_measurements"), out, checkpoint).awaitTermination()
    stored = spark.read.parquet(out)
    return stored.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("TEMP"), 2).alias("sum_temp"), F.count("TEMP_ADJUSTED").alias("n_adjusted"))


@query("redelivered_rows", "SELECT event_id, ts, event_type FROM events")
def redelivered(spark, d):
    """The event table delivered twice to a stream; every event is kept once."""
    root = scratch_path(spark, "redelivered")
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    for _ in range(2):
        events.write.mode("append").parquet(f"{root}/in")
    stream = ingest.drop_redelivered(ingest.table_stream(spark, f"{root}/in", events.schema), ["event_id"], "ts", "400 days")
    run = (stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    return ntz(spark.read.parquet(f"{root}/out"))
