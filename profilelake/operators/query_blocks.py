"""Tables of query vectors that tasks read in blocks, so that neither the driver nor a broadcast holds them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelake.session import scratch_path

ROW_GROUP_BYTES = 16 << 20


def written_blocks(queries: DataFrame, vec: str) -> dict[int, list[str]]:
    """Write the queries to the shared folder by vector length: the files of each length.

    Queries without a vector are left out. The driver sees file names only; a
    file is about one advisory partition (64 MB), so their number follows the
    size of the query table.
    """
    spark, path = queries.sparkSession, scratch_path(queries.sparkSession, "queries")
    sized = queries.where(F.col(vec).isNotNull()).withColumn("length__", F.size(vec))
    sized.hint("rebalance", "length__").write.partitionBy("length__").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    files: dict[int, list[str]] = {}
    for file in sorted(spark.read.schema(sized.schema).parquet(path).inputFiles()):
        files.setdefault(int(re.search(r"length__=(\d+)/", file)[1]), []).append(file)
    return files


def block_reader(files: dict[int, list[str]], values: int, most: int | None = None) -> Callable:
    """A function for tasks: the Arrow tables of the queries of one length, in turn.

    A table holds at most ``values`` numbers (but one query at least) and at most
    ``most`` queries; small files go into one. What fits one table is kept for
    the next call, more is read again. The shared folder must be one that
    pyarrow opens by its URI (local or mounted, HDFS, S3, GCS).
    It is an inner function, so that it reaches the workers by value.
    """
    kept: dict = {}

    def blocks(length):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        if length in kept:
            yield kept[length]
            return
        rows = max(1, min(values // max(1, length), most or values))
        held, n, given = [], 0, 0
        for uri in files.get(length, ()):
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=rows):
                    if n + batch.num_rows > rows:
                        yield pa.Table.from_batches(held)
                        held, n, given = [], 0, given + 1
                    held.append(batch)
                    n += batch.num_rows
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if not given:
                kept.clear()
                kept[length] = table
            yield table

    return blocks
