"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    # Literal dates and parsed texts are UTC, whatever the machine says.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # '01' must stay '01' when a year/month folder is read back.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master gets a temporary folder of its own; on a cluster a
    missing setting is an error, since a machine-local path would lose data
    together with the machine.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="profilelake-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, *, plain: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Several consumers then share one computation, read only the columns they
    need, and a lost executor costs nothing upstream. The planner takes the size
    of the files for that of the table when it decides what the driver builds
    and broadcasts. Keys pack to a small part of that, so tables with rows for
    each question are written ``plain``: their size is then that of their values.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    writer = df.write
    if plain:
        writer = writer.option("compression", "uncompressed").option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
