"""The given tables in the shape of float layers, for Spark and for the oracle.

Column expressions are SQL texts that both engines read, so that inputs agree
and only the operators differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(df: DataFrame) -> DataFrame:
    """Zoned timestamps as UTC wall time, the oracle's type."""
    zoned = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def _exprs(columns: dict[str, str]) -> list:
    return [F.expr(e).alias(n) for n, e in columns.items()]


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


MEASUREMENT = {
    "platform_number": "l_suppkey",
    "profile_index": "l_partkey",
    "juld": "l_shipdate",
    "level_index": "CAST(l_linenumber AS BIGINT)",
    "PRES": "l_quantity",
    "TEMP": "l_extendedprice",
    "PSAL": "l_discount",
    "PRES_QC": "l_linestatus",
    "PSAL_QC": "l_returnflag",
    "TEMP_ADJUSTED": "CASE WHEN l_linestatus = 'F' THEN l_extendedprice END",
    "PSAL_ADJUSTED": "CASE WHEN l_returnflag = 'N' THEN l_tax END",
    "row_ordinal": "l_orderkey",
}


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*_exprs(MEASUREMENT))
    return rows.withColumns({"year": F.date_format("juld", "yyyy"), "month": F.date_format("juld", "MM")})


M = (f"m AS (SELECT *, strftime(juld, '%Y') AS year, strftime(juld, '%m') AS month "
     f"FROM (SELECT {_sql(MEASUREMENT)} FROM lineitem))")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(
        F.col("s_suppkey").alias("platform_number"), F.col("r_name").alias("project_name"),
        F.col("n_name").alias("pi_name"), F.col("s_name").alias("float_serial_no"))


MD = ("md AS (SELECT s_suppkey AS platform_number, r_name AS project_name, n_name AS pi_name, "
      "s_name AS float_serial_no FROM supplier JOIN nation ON s_nationkey = n_nationkey "
      "JOIN region ON n_regionkey = r_regionkey)")

POSITION = {
    "PLATFORM_NUMBER": "c_custkey",
    "LATITUDE": "CASE WHEN c_mktsegment <> 'BUILDING' THEN (c_custkey * 37 % 18000) / 100E0 - 90E0 END",
    "LONGITUDE": "CASE WHEN c_nationkey <> 7 THEN (c_custkey * 53 % 36000) / 100E0 - 180E0 END",
    "value": "c_acctbal",
}


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(*_exprs(POSITION))


P = f"p AS (SELECT {_sql(POSITION)} FROM customer)"

# Questions in the words of the triage rules, one per order.
QUESTION_TEXT = """CASE o_orderpriority
 WHEN '1-URGENT' THEN CASE o_orderstatus
  WHEN 'F' THEN 'Show me salinity profiles near ' || CAST(o_custkey % 90 AS STRING) || ', ' || CAST(o_orderkey % 180 AS STRING) || ' in March 2025'
  WHEN 'O' THEN 'Compare temperature vs salinity in the gulf for the last ' || CAST(o_custkey % 24 + 1 AS STRING) || ' months'
  ELSE 'What are the nearest floats to this place?' END
 WHEN '2-HIGH' THEN CASE o_orderstatus
  WHEN 'F' THEN 'Give float details for platform ' || CAST(1000 + o_custkey AS STRING)
  WHEN 'O' THEN 'Display oxygen and pressure of WMO number: ' || CAST(1000 + o_custkey AS STRING) || ' from 2024-01-15 to 2024-02-20'
  ELSE 'Summarize all available floats for January 2025' END
 WHEN '3-MEDIUM' THEN CASE o_orderstatus
  WHEN 'F' THEN 'plot temp lat -' || CAST(o_custkey % 60 AS STRING) || ' to ' || CAST(o_orderkey % 60 AS STRING) || ' lon ' || CAST(o_custkey % 170 AS STRING) || ' to 70.5'
  WHEN 'O' THEN 'Who is the PI of the project?'
  ELSE 'List nitrate QC flags of profile ' || CAST(o_custkey % 300 AS STRING) END
 WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus
  WHEN 'F' THEN 'Was the record processed or adjusted since last 3 months'
  WHEN 'O' THEN 'average chlorophyll of all floats'
  ELSE 'compare' END
 ELSE CASE o_orderstatus
  WHEN 'F' THEN 'What was the trend of oxygen?'
  WHEN 'O' THEN 'closest'
  ELSE 'quality flag of platform ' || CAST(1000 + o_custkey AS STRING) || ' latitude 1.5 to 2..5 longitude 3 to 4' END
END"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation log's user turns and one composed question per order."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("query_id"), "text")
    asked = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("query_id"), F.expr(QUESTION_TEXT).alias("text"))
    return turns.unionByName(asked)


QS = (f"qs AS (SELECT 'c' || conv_id || '-' || turn AS query_id, text FROM conversations WHERE role = 'user' "
      f"UNION ALL SELECT 'o' || o_orderkey, {QUESTION_TEXT} FROM orders)")


def profile_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per vector: its numbers are the levels."""
    e = table(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))

    def levels(limit, factor=1.0):
        return F.transform("x", lambda v: F.when(v > limit, v * factor))

    return e.select(
        F.concat(F.lit("file_"), F.col("label").cast("string")).alias("source_file"),
        F.col("vec_id").alias("profile_index"), (F.col("label") + 1000).alias("PLATFORM_NUMBER"),
        (F.col("vec_id") + F.lit(0.25)).alias("JULD"), F.lit("days since 1950-01-01 00:00:00 UTC").alias("JULD_UNITS"),
        levels(-0.1).alias("PRES"), levels(0.0, 2.0).alias("TEMP"), levels(0.1).alias("PSAL"),
        F.transform("x", lambda v: F.when(v > 0, " 1 ").otherwise("4")).alias("PRES_QC"),
        F.col("label").cast("string").alias("TEMP_QC"),
        levels(0.2, 4.0).alias("PRES_ADJUSTED"), F.col("label").cast("double").alias("TEMP_ADJUSTED"),
        levels(0.15).alias("PRES_ADJUSTED_ERROR"))


LV = """lv AS (SELECT 'file_' || label AS source_file, vec_id AS profile_index, CAST(label + 1000 AS VARCHAR) AS platform_number,
 TIMESTAMP '1950-01-01' + to_microseconds(CAST(round((vec_id + 0.25) * 86400e6) AS BIGINT)) AS juld,
 pos - 1 AS level_index,
 CASE WHEN v > -0.1 THEN v END AS PRES, CASE WHEN v > 0 THEN v * 2 END AS TEMP, CASE WHEN v > 0.1 THEN v END AS PSAL,
 CASE WHEN v > 0 THEN '1' ELSE '4' END AS PRES_QC, CAST(label AS VARCHAR) AS TEMP_QC, '' AS PSAL_QC,
 CASE WHEN v > 0.2 THEN v * 4 END AS PRES_ADJUSTED, CAST(label AS DOUBLE) AS TEMP_ADJUSTED, CAST(NULL AS DOUBLE) AS PSAL_ADJUSTED,
 CASE WHEN v > 0.15 THEN v END AS PRES_ADJUSTED_ERROR, CAST(NULL AS DOUBLE) AS TEMP_ADJUSTED_ERROR, CAST(NULL AS DOUBLE) AS PSAL_ADJUSTED_ERROR
 FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings))"""


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label, the query vectors of the search."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # one number per vector dimension and label
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("a"))
    return vectors.select(F.col("label").cast("bigint").alias("query_id"), F.transform("a", lambda s: s["x"]).alias("embedding"))


def vector_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    platform, profile = F.col("vec_id") % 10, F.col("label")
    return e.select(
        F.col("vec_id").alias("id"), F.col("embedding"),
        F.concat(F.lit("platform "), platform.cast("string"), F.lit(" profile "), profile.cast("string")).alias("document"),
        F.create_map(F.lit("Platform_Number"), platform.cast("string"), F.lit("PROFILE_INDEX"), profile.cast("string"),
                     F.lit("project_name"), F.when(F.col("label") > 4, " East ").otherwise("West")).alias("metadata"),
        platform.alias("platform_number"))


DIST = """dim AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label AS query_id, pos, avg(x) AS y FROM dim GROUP BY ALL),
dist AS (SELECT CAST(query_id AS BIGINT) AS query_id, vec_id AS id, any_value(label) AS label, sum((x - y) * (x - y)) AS distance
 FROM dim JOIN c USING (pos) GROUP BY query_id, vec_id)"""
