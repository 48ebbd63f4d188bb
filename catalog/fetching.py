"""Projection, joins, capped fetch, metadata, set operations."""

from pyspark.sql import functions as F

from catalog.inputs import M, MD, measurements, metadata, ntz, table
from catalog.registry import query
from profilelake.operators import fetch
from profilelake.operators.ranking import top_n_per_key


@query("top1_value_by_project", f"""WITH {M}, {MD}
SELECT m.platform_number, profile_index, juld, PRES, TEMP AS max_value, project_name, pi_name
FROM m JOIN (SELECT DISTINCT platform_number, project_name, pi_name FROM md) d ON m.platform_number = d.platform_number
WHERE project_name ILIKE '%asia%'
ORDER BY TEMP DESC NULLS LAST, m.platform_number, profile_index, juld, PRES LIMIT 1""")
def top1(spark, d):
    return fetch.hottest_for_project(measurements(spark, d), metadata(spark, d), "%asia%")


_CAPPED_SQL = """WITH {M}, {MD}
SELECT platform_number, profile_index, juld, level_index, PRES, TEMP, PSAL, PRES_QC, PSAL_QC, TEMP_ADJUSTED, PSAL_ADJUSTED,
 year, month, row_ordinal, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY year, month, platform_number, profile_index
  ORDER BY juld DESC NULLS LAST, level_index, row_ordinal, PRES, TEMP, PSAL, PRES_QC, PSAL_QC,
  TEMP_ADJUSTED NULLS FIRST, PSAL_ADJUSTED NULLS FIRST) AS rank
 FROM m WHERE platform_number IN (SELECT platform_number FROM md WHERE project_name = 'ASIA') {where})
WHERE rank <= {cap}"""


@query("capped_fetch", _CAPPED_SQL.format(M=M, MD=MD, cap=1, where="""AND month IN ('01', '02', '03')
 AND juld >= TIMESTAMP '1994-01-01' AND juld <= TIMESTAMP '1999-12-31'"""))
def capped(spark, d):
    wanted = metadata(spark, d).where("project_name = 'ASIA'")
    return fetch.fetch_measurements(measurements(spark, d), wanted, months=["01", "02", "03"],
                                    date_from="1994-01-01", date_to="1999-12-31", cap=1)


@query("capped_fetch_all_months", _CAPPED_SQL.format(M=M, MD=MD, cap=500, where=""))
def capped_all(spark, d):
    wanted = metadata(spark, d).where("project_name = 'ASIA'")
    return fetch.fetch_measurements(measurements(spark, d), wanted)


@query("capped_fetch_events", """SELECT event_id, ts, user_id, event_type, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 5""")
def capped_events(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return top_n_per_key(e, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id")], 5)


# the salted route for hot keys, forced by a low threshold
@query("capped_fetch_hot_keys", """SELECT event_id, ts, event_type, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 50""")
def capped_hot(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    return top_n_per_key(e, ["event_type"], [F.col("ts").desc(), F.col("event_id")], 50)


@query("pruned_projection", """SELECT l_suppkey AS platform_number, l_partkey AS profile_index, l_shipdate AS juld, l_quantity AS PRES
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate <= TIMESTAMP '1995-03-31'""")
def pruned(spark, d):
    rows = measurements(spark, d)
    names = ("platform_number", "profile_index", "juld", "PRES", "OXYGEN")
    return fetch.available(fetch.in_dates(rows, "1995-03-01", "1995-03-31"), names)


@query("metadata_first_per_platform", """WITH a AS (
 SELECT s_suppkey AS platform_number, n_name AS project_name, CAST(NULL AS VARCHAR) AS pi_name, s_name AS float_serial_no,
  CAST(s_nationkey AS DOUBLE) AS wmo_inst_type, 0 AS pr FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT c_custkey, c_mktsegment, c_name, NULL, NULL, 1 FROM customer)
SELECT platform_number, project_name, pi_name, float_serial_no, wmo_inst_type FROM a
WHERE platform_number IN (SELECT o_custkey FROM orders)
QUALIFY row_number() OVER (PARTITION BY platform_number ORDER BY pr, project_name, pi_name, float_serial_no) = 1""")
def metadata_first(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    full = s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("PLATFORM"), F.col("n_name").alias("PROJECT_NAME"),
        F.col("s_name").alias("serial_number"), F.col("s_nationkey").alias("WMO"))
    clean = table(spark, d, "customer").select(
        F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("platform_number"),
        F.col("c_mktsegment").alias("project"), F.col("c_name").alias("investigator"))
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("platform_number"))
    return fetch.fetch_metadata([full, clean], wanted).select(
        "platform_number", "project_name", "pi_name", "float_serial_no", "wmo_inst_type")


@query("serial_lookup", """WITH cand AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END AS platform_number,
 replace(c_name, 'Customer', 'Supplier') AS serial FROM customer)
SELECT platform_number FROM cand WHERE platform_number IS NOT NULL
UNION SELECT s_suppkey FROM supplier JOIN cand ON s_name = serial WHERE platform_number IS NULL""")
def serial_lookup(spark, d):
    cand = table(spark, d, "customer").select(
        F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END").alias("platform_number"),
        F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("float_serial_no"))
    return fetch.with_resolved_platforms(cand, metadata(spark, d))


@query("resume_anti_join", """SELECT 'file_' || o_orderkey AS filename, o_orderdate FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""")
def resume(spark, d):
    def named(key):
        return F.concat(F.lit("file_"), F.col(key).cast("string")).alias("filename")

    files = table(spark, d, "orders").select(named("o_orderkey"), "o_orderdate")
    log = table(spark, d, "lineitem").select(
        named("l_orderkey"), F.when(F.col("l_linestatus") == "F", "OK").otherwise("ERROR").alias("status"))
    return fetch.unprocessed(files, log)


@query("union_all_months", f"""WITH {M} SELECT month, count(*) AS n_rows, round(sum(PRES), 2) AS sum_pres FROM (
 SELECT month, PRES FROM m WHERE month = '01' UNION ALL SELECT month, PRES FROM m WHERE month = '02'
 UNION ALL SELECT month, PRES FROM m WHERE month = '11') GROUP BY month""")
def union_months(spark, d):
    rows = fetch.in_months(measurements(spark, d), ["01", "02", "11"])
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("PRES"), 2).alias("sum_pres"))


@query("union_distinct_meta", """SELECT n_name AS project_name, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION SELECT n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def union_meta(spark, d):
    n = table(spark, d, "nation")
    parts = [table(spark, d, t).join(n, F.col(k) == n.n_nationkey).select(
        F.col("n_name").alias("project_name"), F.col("n_regionkey").alias("region"))
        for t, k in (("supplier", "s_nationkey"), ("customer", "c_nationkey"))]
    return parts[0].unionByName(parts[1]).distinct()


@query("platform_project", f"""WITH {MD} SELECT DISTINCT d.platform_number, project_name, pi_name FROM md d
JOIN (SELECT DISTINCT l_suppkey FROM lineitem) ON l_suppkey = d.platform_number""")
def platform_project(spark, d):
    """Project of every platform that has measurements."""
    about = metadata(spark, d).select("platform_number", "project_name", "pi_name").distinct()
    return fetch.for_platforms(about, measurements(spark, d))


@query("concat_uneven_frames", """SELECT s_suppkey AS platform_number, s_name AS float_serial_no, CAST(NULL AS VARCHAR) AS segment FROM supplier
UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer""")
def concat_frames(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("platform_number"), F.col("s_name").alias("float_serial_no"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("platform_number"), F.col("c_mktsegment").alias("segment"))
    return ntz(a.unionByName(b, allowMissingColumns=True))
