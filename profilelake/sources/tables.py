"""Layer tables: month-partitioned Parquet, views, and small result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilelake.schemas import LAYERS
from profilelake.sources.layer_csv import OPEN_LAYERS, file_issues, read_layer

LINEAGE = [T.StructField("source_file", T.StringType()), T.StructField("row_ordinal", T.LongType())]
MONTH = [T.StructField("year", T.StringType()), T.StructField("month", T.StringType())]

RUN_LOG = "timestamp timestamp, filename string, status string, message string"


def stored_schema(layer: str) -> T.StructType:
    return T.StructType(LAYERS[layer].fields + LINEAGE + MONTH)


def write_layer(df: DataFrame, path: str) -> None:
    """Replace the months present in ``df``; other months stay.

    The rebalance hint gathers each month into few files and lets AQE split a
    month that is too large for one task.
    """
    df.hint("rebalance", "year", "month").write.partitionBy("year", "month").mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").option("compression", "snappy").parquet(path)


def read_table(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """Stored layer under its explicit schema, so '01' stays text."""
    return spark.read.schema(stored_schema(layer)).parquet(path)


def load_view(spark: SparkSession, path: str, layer: str) -> DataFrame:
    df = read_table(spark, path, layer)
    df.createOrReplaceTempView(layer)
    return df


def convert_layers(spark: SparkSession, csv_root: str, table_root: str,
                   layers: Sequence[str] = tuple(LAYERS)) -> list[tuple[str, str, str]]:
    """CSV layers to Parquet, one job per layer over all months. A failing
    layer is reported and the others go on.

    Files are read once, strictly. Only where that fails, or a layer holds files
    that must be left out, are they examined one by one; what is left out is in
    the outcome's message, file by file, and the layer counts as PARTIAL.
    """
    outcome = []
    for layer in layers:
        target = f"{table_root}/{layer}"
        try:
            try:
                write_layer(read_layer(spark, csv_root, layer, probe=False), target)
                issues = file_issues(spark, csv_root, layer).collect() if layer in OPEN_LAYERS else []
            except Exception:  # noqa: BLE001 - a damaged or mislabelled file; the second reading tells which
                write_layer(read_layer(spark, csv_root, layer), target)
                issues = file_issues(spark, csv_root, layer).collect()      # one row per bad file
            message = "; ".join(sorted(f"{r['source_file'].rsplit('/', 1)[-1]}: {r['issue']}" for r in issues))
            outcome.append((layer, "PARTIAL" if issues else "OK", message))
        except Exception as error:  # noqa: BLE001 - reported to the caller
            outcome.append((layer, "ERROR", str(error).splitlines()[0]))
    return outcome


def append_run_log(spark: SparkSession, path: str, entries: DataFrame) -> None:
    """Append (filename, status, message) rows with the time of writing."""
    stamped = entries.select(
        F.current_timestamp().alias("timestamp"), "filename", "status", F.coalesce("message", F.lit("")).alias("message"))
    stamped.write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).parquet(path)


def write_manifest(report: DataFrame, path: str) -> None:
    """Reconciliation report as JSON per month."""
    report.write.partitionBy("year", "month").mode("overwrite").json(path)


def write_sample_csv(df: DataFrame, path: str, order: Sequence[str], n: int = 200) -> None:
    """The first ``n`` rows in order, in one CSV file."""
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON text per question (column ``value``)."""
    results.select("value").write.mode("overwrite").text(path)
