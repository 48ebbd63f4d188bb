"""Profile arrays to layers, decoded times, unpivoted and typed columns."""

from pyspark.sql import functions as F

from catalog.inputs import LV, ntz, profile_arrays, table
from catalog.registry import query
from profilelake.functions.text import text_column
from profilelake.functions.times import history_timestamp, reference_timestamp, round_to_second, with_decoded_time
from profilelake.operators import layers
from profilelake.sources.layer_csv import normalize_types

_CORE = ("source_file, profile_index, platform_number, juld, level_index, PRES, PRES_QC, PRES_ADJUSTED, "
         "TEMP, TEMP_QC, TEMP_ADJUSTED, PSAL, PSAL_QC, PSAL_ADJUSTED")


def _decoded(spark, d):
    return with_decoded_time(profile_arrays(spark, d), "JULD", "juld_ts", units="JULD_UNITS").drop("JULD")


@query("array_levels_drop_missing", f"WITH {LV} SELECT {_CORE} FROM lv WHERE coalesce(PRES, TEMP, PSAL) IS NOT NULL")
def core(spark, d):
    return ntz(layers.core_measurements(_decoded(spark, d), "juld_ts"))


@query("array_levels_keep", f"WITH {LV} SELECT {_CORE}, PRES_ADJUSTED_ERROR, TEMP_ADJUSTED_ERROR, PSAL_ADJUSTED_ERROR FROM lv")
def per_level(spark, d):
    return ntz(layers.qc_per_level(_decoded(spark, d), "juld_ts"))


@query("array_level_stats", f"""WITH {LV} SELECT platform_number, count(*) AS n_levels, count(PRES) AS n_pres,
 round(avg(TEMP), 9) AS mean_temp, max(juld) AS latest FROM lv WHERE coalesce(PRES, TEMP, PSAL) IS NOT NULL GROUP BY ALL""")
def level_stats(spark, d):
    rows = layers.core_measurements(_decoded(spark, d), "juld_ts")
    return ntz(rows.groupBy("platform_number").agg(
        F.count(F.lit(1)).alias("n_levels"), F.count("PRES").alias("n_pres"),
        F.round(F.avg("TEMP"), 9).alias("mean_temp"), F.max("juld").alias("latest")))


def _part_profiles(spark, d):
    return table(spark, d, "part").select(
        F.col("p_brand").alias("source_file"), F.col("p_partkey").alias("profile_index"),
        F.concat(F.lit(" "), "p_type").alias("PROFILE_TEMP_QC"), F.split("p_name", "").alias("PROFILE_PRES_QC"),
        F.encode("p_brand", "UTF-8").alias("PROFILE_PSAL_QC"), F.when(F.col("p_size") > 25, "R").alias("DATA_MODE"),
        F.col("p_name").alias("SCIENTIFIC_CALIB_EQUATION"), F.col("p_size").alias("SCIENTIFIC_CALIB_COEFFICIENT"),
        F.concat("p_brand", F.lit("\x00 ")).alias("SCIENTIFIC_CALIB_COMMENT"))


@query("qc_profile_columns", """SELECT p_brand AS source_file, p_partkey AS profile_index, p_type AS PROFILE_TEMP_QC, p_name AS PROFILE_PRES_QC,
 p_brand AS PROFILE_PSAL_QC, CASE WHEN p_size > 25 THEN 'R' ELSE '' END AS DATA_MODE, '' AS DATA_STATE_INDICATOR FROM part""")
def qc_profile(spark, d):
    return layers.qc_profile(_part_profiles(spark, d))


@query("qc_profile_map", """SELECT p_partkey AS profile_index, 3 AS n_flags, p_type AS temp_flag FROM part""")
def qc_profile_map(spark, d):
    stored = layers.qc_profile_layer(_part_profiles(spark, d))
    return stored.select("profile_index", F.size("profile_qc").alias("n_flags"), F.col("profile_qc")["PROFILE_TEMP_QC"].alias("temp_flag"))


@query("calibration_unpivot", """SELECT p_brand AS source_file, p_partkey AS profile_index, 'SCIENTIFIC_CALIB_EQUATION' AS variable, p_name AS value FROM part
UNION ALL SELECT p_brand, p_partkey, 'SCIENTIFIC_CALIB_COEFFICIENT', CAST(p_size AS VARCHAR) FROM part
UNION ALL SELECT p_brand, p_partkey, 'SCIENTIFIC_CALIB_COMMENT', p_brand FROM part""")
def calibration(spark, d):
    return layers.calibration(_part_profiles(spark, d))


@query("history_grid", """WITH h AS (SELECT o_orderpriority AS source_file, o_orderkey AS profile_index, CAST(o_custkey AS VARCHAR) AS platform_number,
 o_orderstatus, o_orderdate, o_totalprice FROM orders)
SELECT source_file, profile_index, 0 AS history_index, platform_number, o_orderdate AS HISTORY_DATE, o_orderstatus AS HISTORY_ACTION,
 o_totalprice AS HISTORY_PREVIOUS_VALUE, 'AO' AS HISTORY_INSTITUTION, '' AS HISTORY_STEP FROM h
UNION ALL SELECT source_file, profile_index, 1, platform_number, TIMESTAMP '2024-05-06 07:08:00', 'QC', NULL, 'AO', '' FROM h
UNION ALL SELECT source_file, profile_index, 2, platform_number, NULL, '', 0.5, 'AO', '' FROM h""")
def history(spark, d):
    profiles = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("source_file"), F.col("o_orderkey").alias("profile_index"),
        F.col("o_custkey").alias("PLATFORM_NUMBER"),
        F.array(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("202405060708"), F.lit("no date")).alias("HISTORY_DATE"),
        F.array(F.col("o_orderstatus"), F.lit(" QC ")).alias("HISTORY_ACTION"),
        F.array(F.col("o_totalprice"), F.lit(float("nan")), F.lit(0.5)).alias("HISTORY_PREVIOUS_VALUE"),
        F.lit("AO").alias("HISTORY_INSTITUTION"))
    rows = layers.history(profiles).withColumn("history_index", F.col("history_index").cast("int"))
    return ntz(rows.select("source_file", "profile_index", "history_index", "platform_number", "HISTORY_DATE", "HISTORY_ACTION",
                           "HISTORY_PREVIOUS_VALUE", "HISTORY_INSTITUTION", "HISTORY_STEP"))


def _supplier_profiles(spark, d):
    s = table(spark, d, "supplier")
    return s.select(
        F.concat(F.lit("file_"), F.col("s_nationkey").cast("string")).alias("source_file"), F.col("s_suppkey").alias("profile_index"),
        F.col("s_suppkey").alias("PLATFORM_NUMBER"), F.split("s_name", "").alias("FLOAT_SERIAL_NO"),
        F.array(F.col("s_suppkey"), F.col("s_nationkey").cast("bigint")).alias("CYCLE"),
        F.sequence(F.lit(1), F.lit(9)).alias("PRES"))


_META_SQL = """SELECT 'file_' || s_nationkey AS source_file, s_suppkey AS profile_index, CAST(s_suppkey AS VARCHAR) AS PLATFORM_NUMBER,
 s_name AS FLOAT_SERIAL_NO, CAST(s_suppkey AS VARCHAR) || CAST(s_nationkey AS VARCHAR) AS CYCLE, n_name AS PROJECT_NAME
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _metadata(spark, d):
    per_file = table(spark, d, "nation").select(
        F.concat(F.lit("file_"), F.col("n_nationkey").cast("string")).alias("source_file"), F.col("n_name").alias("PROJECT_NAME"))
    return layers.metadata_full(_supplier_profiles(spark, d), per_file)


@query("metadata_full", _META_SQL)
def metadata_full(spark, d):
    return _metadata(spark, d)


@query("metadata_clean", f"SELECT PLATFORM_NUMBER, FLOAT_SERIAL_NO, PROJECT_NAME FROM ({_META_SQL})")
def metadata_clean(spark, d):
    return layers.metadata_clean(_metadata(spark, d))


@query("profile_numbering", """SELECT c_mktsegment AS source_file, c_custkey AS position,
 row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS profile_index FROM customer""")
def numbering(spark, d):
    profiles = table(spark, d, "customer").select(F.col("c_mktsegment").alias("source_file"), F.col("c_custkey").alias("position"))
    return layers.with_profile_index(profiles, "position")


@query("time_location", """SELECT c_mktsegment AS source_file, c_custkey AS profile_index,
 c_acctbal AS LATITUDE, CAST(c_nationkey AS DOUBLE) AS LONGITUDE,
 make_timestamp(CAST(round_even(epoch_us(TIMESTAMP '1950-01-01' + to_microseconds(CAST(round(c_custkey * 1.37 * 86400e6) AS BIGINT))) / 1e6, 0) AS BIGINT) * 1000000) AS JULD,
 CAST(NULL AS TIMESTAMP) AS JULD_LOCATION, TIMESTAMP '1950-01-01' AS REFERENCE_DATE_TIME, '1' AS POSITION_QC,
 '' AS POSITIONING_SYSTEM, '' AS DIRECTION, CAST(c_custkey AS VARCHAR) AS PLATFORM_NUMBER, c_mktsegment AS PROJECT_NAME, c_name AS PI_NAME FROM customer""")
def time_location(spark, d):
    profiles = table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("source_file"), F.col("c_custkey").alias("profile_index"),
        F.col("c_acctbal").cast("string").alias("LATITUDE"), F.array(F.col("c_nationkey")).alias("LONGITUDE"),
        (F.col("c_custkey") * 1.37).alias("JULD"), F.lit("19500101000000").alias("REFERENCE_DATE_TIME"),
        F.lit(b"1 ").alias("POSITION_QC"), F.col("c_custkey").alias("PLATFORM_NUMBER"),
        F.col("c_mktsegment").alias("PROJECT_NAME"), F.col("c_name").alias("PI_NAME"))
    return ntz(layers.time_location(profiles))


# one file holds days, the others epoch seconds: told apart by the mean of the file
@query("juld_decode", """WITH o AS (SELECT o_orderpriority AS source_file, o_orderkey, o_orderdate,
 date_diff('day', DATE '1950-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders)
SELECT o_orderkey, o_orderdate AS juld, o_orderdate AS history_date, CAST(o_orderdate AS DATE)::TIMESTAMP AS reference_date,
 date_trunc('second', o_orderdate) + INTERVAL 2 SECOND AS rounded FROM o""")
def juld_decode(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("source_file"), "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"),
        F.lit("1950-01-01 00:00:00").alias("REFERENCE_DATE_TIME"))
    micros = F.unix_micros("t")
    days = (micros - F.unix_micros(F.lit("1950-01-01").cast("timestamp"))) / F.lit(86400e6)
    value = F.when(F.col("source_file") == "1-URGENT", days).otherwise(micros / F.lit(1e6))
    decoded = with_decoded_time(o.withColumn("JULD", value), "JULD", "juld", reference="REFERENCE_DATE_TIME")
    return ntz(decoded.select(
        "o_orderkey", "juld", history_timestamp(F.date_format("t", "yyyyMMddHHmm")).alias("history_date"),
        reference_timestamp(F.concat(F.lit(" "), F.date_format("t", "yyyyMMdd"))).alias("reference_date"),
        round_to_second(F.timestamp_micros(micros + 1_500_000)).alias("rounded")))


@query("normalize_types", """SELECT l_orderkey, l_quantity::BIGINT AS l_quantity, l_extendedprice, nullif(l_returnflag, 'A') AS l_returnflag,
 l_shipdate AS ship_date, CASE WHEN l_linenumber > 1 THEN l_linenumber::BIGINT END AS l_linenumber FROM lineitem""")
def normalized(spark, d):
    text = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"),
        F.when(F.col("l_returnflag") == "A", " nan ").otherwise(F.concat("l_returnflag", F.lit(" "))).alias("l_returnflag"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ship_date"),
        F.when(F.col("l_linenumber") > 1, F.concat(F.col("l_linenumber").cast("string"), F.lit(".0"))).otherwise("").alias("l_linenumber"))
    return ntz(normalize_types(text))


@query("clean_text", """SELECT doc_id, md5(trim(text, E' \\t\\n\\r\\x0b\\x0c')) AS text_md5 FROM documents""")
def clean(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "").alias("text"))
    return docs.select("doc_id", F.md5(text_column(docs, "text").cast("binary")).alias("text_md5"))
