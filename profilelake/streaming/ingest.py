"""Incremental ingest of layer files, and rows delivered twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from profilelake.schemas import LAYER_FILE_PREFIX, LAYERS
from profilelake.sources.layer_csv import CORRUPT, OPEN_LAYERS, path_columns, text_schema, wanted_file, typed_layer


def layer_stream(spark: SparkSession, root: str, layer: str) -> DataFrame:
    """Rows of new files of a fixed-column layer."""
    if layer in OPEN_LAYERS:
        raise ValueError(f"{layer} has no fixed header; load it with read_layer")
    path = F.col("_metadata.file_path")
    raw = (
        spark.readStream.schema(text_schema(layer)).option("header", True)
        .option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{LAYER_FILE_PREFIX}{layer}*.csv*").csv(root)
        .where(wanted_file(path)).withColumns(path_columns(path))
    )
    known = [f.name for f in LAYERS[layer].fields]
    return typed_layer(raw.select(*known, CORRUPT, "source_file", "year", "month"), layer, ordinal=False)


def ingest_new_files(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append every file once. The file sink's commit log makes a restarted
    batch harmless, so nothing is written twice."""
    return (
        stream.writeStream.format("parquet").partitionBy("year", "month")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def drop_redelivered(stream: DataFrame, keys: Sequence[str], time_column: str = "juld", delay: str = "30 days") -> DataFrame:
    """Keep the first of the rows with equal keys that arrive within ``delay``;
    the state of older keys is dropped."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(list(keys))


def table_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*") -> DataFrame:
    """Parquet files as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)
