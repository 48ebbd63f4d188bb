"""Damaged files, repeated ingest, and the small sinks."""

from pyspark.sql import functions as F

from catalog.checking import place_files
from catalog.inputs import table
from catalog.registry import ORACLES, query
from catalog.searching import event_candidates
from profilelake.operators import quality, vectors
from profilelake.operators.candidates import ranked_candidates
from profilelake.session import materialized, scratch_path
from profilelake.sources import layer_csv, tables


def _place_text(spark, header, lines, staged, target, *, last="", one=False, **options):
    """Lines below ``header`` as text files that tasks write; ``target`` has a place for their numbers.

    Each partition is a file with the header before its first line, beside a
    file with the header and ``last``. With ``one``, a single file holds it all.
    """
    ends = spark.range(0, 1, 1, 1)
    if one:
        rows = lines.select(F.lit(1).alias("_o"), "value").unionByName(ends.select(F.lit(0).alias("_o"), F.lit(header).alias("value")))
        if last:
            rows = rows.unionByName(ends.select(F.lit(2).alias("_o"), F.lit(last).alias("value")))
        rows = rows.repartition(1).sortWithinPartitions("_o").select("value")
    else:
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        rows = lines.select(F.when(first, F.concat(F.lit(f"{header}\n"), "value")).otherwise(F.col("value")).alias("value"))
        rows = rows.unionByName(ends.select(F.lit(f"{header}\n{last}" if last else header).alias("value")))
    rows.write.options(**options).text(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    for i, status in enumerate(s for s in fs.listStatus(path(staged)) if s.getPath().getName().startswith("part-")):
        fs.rename(status.getPath(), path(target.format(i)))


def _place_half(spark, source, target):
    """The first half of a file, copied piece by piece."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    half, piece = fs.getFileStatus(path(source)).getLen() // 2, 1 << 20
    fs.mkdirs(path(target).getParent())
    read, written = fs.open(path(source)), fs.create(path(target))
    for at in range(0, half, piece):
        written.write(read.readNBytes(min(piece, half - at)))
    read.close()
    written.close()


@query("reconcile_bad_files", """WITH n AS (SELECT count(*) AS n FROM supplier)
SELECT * FROM (SELECT 'calibration' AS layer, '2025' AS year, '01' AS month, n AS csv_rows, n AS parquet_rows, false AS matches, 'argo_calibration_cut.csv.gz: read_error' AS issues FROM n
UNION ALL SELECT 'calibration', '2025', '02', n, n, true, '' FROM n
UNION ALL SELECT 'calibration', '2025', '03', n + 1, n, false, 'rows_rejected,row_count_differs' FROM n
UNION ALL SELECT 'metadata_clean', '2025', '01', n, n, true, '' FROM n
UNION ALL SELECT 'qc_profile', '2025', '04', 0, NULL, false, 'parquet_missing,argo_qc_profile.csv: quoted_line_break' FROM n
UNION ALL SELECT 'qc_profile', '2025', '05', n, n, true, '' FROM n)""")
def reconcile_bad_files(spark, d):
    """Files of three layers, sound ones and one of each fault; every fault is named and nothing else is lost."""
    root = scratch_path(spark, "bad-files")
    csv_root, table_root = f"{root}/csv", f"{root}/tables"
    suppliers = table(spark, d, "supplier")
    key, name = (F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("s_suppkey", "s_name"))
    texts = {
        "calibration": ("profile_index,variable,value", F.concat(key, F.lit(",TEMP,"), name)),
        "qc_profile": ("profile_index,DATA_MODE,DATA_STATE_INDICATOR,EXTRA", F.concat(key, F.lit(",R,2B,"), name)),
        "metadata_clean": (",".join(f.name for f in layer_csv.LAYERS["metadata_clean"].fields), F.concat(key, F.lit(",,,,"), name, F.lit(",,,,,,")))}

    def place(layer, month, ending, **how):
        header, line = texts[layer]
        target = f"{csv_root}/2025/{month}/argo_{layer}{ending}"
        _place_text(spark, header, suppliers.select(line.alias("value")), f"{root}/staged/{layer}-{month}", target, **how)

    place("calibration", "01", "_{}.csv")
    place("calibration", "02", "_{}.csv.gz")        # plain text under a .gz name
    place("calibration", "03", "_{}.csv", last="1,2")
    place("metadata_clean", "01", "_{}.csv")
    place("qc_profile", "04", ".csv", last='9,R,"2\nB",x', one=True)
    place("qc_profile", "05", "_{}.csv")
    header, line = texts["calibration"]
    _place_text(spark, header, suppliers.select(line.alias("value")), f"{root}/staged/cut", f"{root}/whole.gz", one=True, compression="gzip")
    _place_half(spark, f"{root}/whole.gz", f"{csv_root}/2025/01/argo_calibration_cut.csv.gz")
    layers = ("calibration", "metadata_clean", "qc_profile")
    tables.convert_layers(spark, csv_root, table_root, layers)
    report = None
    for layer in layers:
        counted = quality.partition_counts(tables.read_table(spark, f"{table_root}/{layer}", layer), layer).withColumnRenamed("row_count", "parquet_rows")
        part = quality.reconcile(layer_csv.source_counts(spark, csv_root, layer), counted)
        report = part if report is None else report.unionByName(part)
    return report.withColumn("issues", F.array_join("issues", ","))


@query("vector_reingest", """SELECT '02' AS month, s_suppkey AS platform, 1 AS documents, 1 AS newest FROM supplier
UNION ALL SELECT '01', s_suppkey, 1, 1 FROM supplier WHERE s_suppkey % 2 = 0""")
def vector_reingest(spark, d):
    """Documents of a month stay the same rows when a file of an earlier month comes and all is ingested again."""
    root = scratch_path(spark, "reingest")
    rows = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("PLATFORM_NUMBER"), *[F.lit(None).cast("string").alias(c) for c in ("FLOAT_SERIAL_NO", "PLATFORM_TYPE", "WMO_INST_TYPE")],
        F.col("s_name").alias("PROJECT_NAME"), *[F.lit(None).cast("string").alias(c) for c in (
            "PI_NAME", "DATA_CENTRE", "FORMAT_VERSION", "HANDBOOK_VERSION", "FIRMWARE_VERSION", "CONFIG_MISSION_NUMBER")])

    def ingested(version):
        layer = layer_csv.read_layer(spark, f"{root}/csv", "metadata_clean")
        return materialized(vectors.layer_documents(layer, "metadata_clean").withColumn("version", F.lit(version)))

    place_files(spark, rows.withColumn("month", F.lit("02")), f"{root}/a", f"{root}/csv", "metadata_clean")
    first = ingested(1)
    place_files(spark, rows.where("PLATFORM_NUMBER % 2 = 0").withColumn("month", F.lit("01")), f"{root}/b", f"{root}/csv", "metadata_clean")
    stored = vectors.upsert(first, ingested(2))
    return stored.groupBy("month", F.col("metadata")["PLATFORM_NUMBER"].cast("bigint").alias("platform")).agg(
        F.count_distinct("id").cast("int").alias("documents"), F.count_if(F.col("version") == 2).cast("int").alias("newest"))


@query("candidate_ranks", f"""WITH c AS ({ORACLES["candidates"]}) SELECT id, CAST(row_number() OVER (PARTITION BY id % 1000
 ORDER BY nullif(score, 0) DESC NULLS LAST, juld ASC NULLS FIRST, id) AS INTEGER) AS candidate_rank FROM c""")
def candidate_ranks(spark, d):
    found = event_candidates(spark, d).withColumn("query_id", F.col("id") % 1000)
    return ranked_candidates(found, ["query_id"]).select("id", "candidate_rank")


@query("sample_csv", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 200")
def sample_csv(spark, d):
    path = scratch_path(spark, "sample")
    tables.write_sample_csv(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, ["o_orderkey"])
    return spark.read.schema("o_orderkey bigint, o_orderstatus string").option("header", True).csv(path)


@query("run_log", """SELECT 'part_' || p_partkey AS filename, CASE WHEN p_partkey % 3 = 0 THEN 'ERROR' ELSE 'OK' END AS status,
 CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END AS message FROM part UNION ALL SELECT 'part_' || p_partkey, 'OK', '' FROM part WHERE p_partkey % 3 = 0""")
def run_log(spark, d):
    """A run over all parts, then one over those that failed."""
    path, failed = scratch_path(spark, "log"), F.col("p_partkey") % 3 == 0
    parts = table(spark, d, "part").withColumn("filename", F.concat(F.lit("part_"), F.col("p_partkey").cast("string")))
    tables.append_run_log(spark, path, parts.select(
        "filename", F.when(failed, "ERROR").otherwise("OK").alias("status"), F.when(failed, F.col("p_name")).alias("message")))
    tables.append_run_log(spark, path, parts.where(failed).select("filename", F.lit("OK").alias("status"), F.lit(None).cast("string").alias("message")))
    return tables.read_run_log(spark, path).select("filename", "status", "message")


@query("manifest", """SELECT 'orders' AS layer, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, count(*) AS csv_rows,
 count(*) AS parquet_rows, true AS matches FROM orders GROUP BY ALL""")
def manifest(spark, d):
    """The orders of each month held against themselves, as manifest files per month."""
    path = scratch_path(spark, "manifest")
    counts = table(spark, d, "orders").groupBy(F.lit("orders").alias("layer"), F.date_format("o_orderdate", "yyyy").alias("year"), F.date_format("o_orderdate", "MM").alias("month"))
    report = quality.reconcile(counts.agg(F.count(F.lit(1)).alias("csv_rows")), counts.agg(F.count(F.lit(1)).alias("parquet_rows")))
    tables.write_manifest(report, path)
    return spark.read.schema("layer string, csv_rows bigint, parquet_rows bigint, matches boolean, year string, month string").json(path).select(
        "layer", "year", "month", "csv_rows", "parquet_rows", "matches")


@query("result_sink", "SELECT o_orderkey, o_totalprice FROM orders")
def result_sink(spark, d):
    path, o = scratch_path(spark, "results"), table(spark, d, "orders")
    tables.write_results(o.select(F.to_json(F.struct("o_orderkey", "o_totalprice")).alias("value")), path)
    back = spark.read.text(path)
    return back.select(F.get_json_object("value", "$.o_orderkey").cast("bigint").alias("o_orderkey"),
                       F.get_json_object("value", "$.o_totalprice").cast("double").alias("o_totalprice"))
