"""Documents, exact nearest-neighbour search and the hit list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilelake.functions.text import integer, lookup, metadata_matches, row_map, row_text
from profilelake.operators.query_blocks import block_reader, written_blocks
from profilelake.operators.ranking import first_per_key, ranked_top_n, top_n_per_key

LOCAL_QUERIES = 4_096        # queries one task may hold as a matrix ...
LOCAL_VALUES = 8_000_000     # ... and the numbers in it, in a block of documents, or in the distances (64 MB)
DOCS_PER_BLOCK = 50_000

# Metadata keys naming a hit's platform and profile.
HIT_PLATFORM_KEYS = ("PLATFORM_NUMBER", "platform", "wmo")
HIT_PROFILE_KEYS = ("PROFILE_INDEX", "profile")

LINEAGE = ("source_file", "row_ordinal", "year", "month")


def layer_documents(layer: DataFrame, name: str) -> DataFrame:
    """One document per row of a layer: id, text, metadata, and its partition.

    The id holds the row's place: month, a hash of the file and the position in
    it. It stays the same when other files come or splits change.
    """
    columns = [c for c in layer.columns if c not in LINEAGE]
    file = [F.hex(F.xxhash64("source_file"))] if "source_file" in layer.columns else []
    return layer.select(
        F.concat_ws("-", F.lit(f"{name}.parquet"), "year", "month", *file, F.col("row_ordinal").cast("string")).alias("id"),
        row_text(layer, columns).alias("document"),
        row_map(layer, columns).alias("metadata"),
        "year", "month",
    )


def documents(metadata_clean: DataFrame, time_location: DataFrame) -> DataFrame:
    """Documents of the two layers that are searched."""
    return layer_documents(metadata_clean, "metadata_clean").unionByName(
        layer_documents(time_location, "time_location"))


def upsert(stored: DataFrame, incoming: DataFrame, id_col: str = "id", version: str = "version") -> DataFrame:
    """Stored rows with the incoming ones inserted or put in their place.

    Of several incoming rows with one id the highest version stays. Applying
    the same batch twice gives the same rows.
    """
    others = [c for c in incoming.columns if c not in (id_col, version)]
    newest = first_per_key(incoming, [id_col], [-F.col(version), F.xxhash64(*[F.col(c).cast("string") for c in others])])
    kept = stored.join(newest.select(id_col), id_col, "left_anti")
    return kept.unionByName(newest.drop(version) if version not in stored.columns else newest)


def upsert_partitions(path: str, incoming: DataFrame, id_col: str = "id", version: str = "version") -> None:
    """Upsert into a (year, month) Parquet store, rewriting only touched months.

    A document keeps its month (it is part of the id), so other folders cannot
    hold the same id. The list of months is as long as the batch's calendar; as
    literals they prune the folders read.
    """
    months = incoming.select("year", "month").distinct().collect()
    touched = F.lit(False)
    for m in months:
        touched = touched | ((F.col("year") == m["year"]) & (F.col("month") == m["month"]))
    stored = incoming.sparkSession.read.schema(incoming.schema).parquet(path).where(touched)
    merged = upsert(stored.select(*incoming.columns), incoming, id_col, version)
    merged.hint("rebalance", "year", "month").write.partitionBy("year", "month").mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").parquet(path)


def store_check(docs: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Document count, and the first 200 characters and metadata of ``n`` documents."""
    count = docs.agg(F.count(F.lit(1)).alias("documents"))
    peek = docs.orderBy("id").limit(n).select("id", F.substring("document", 1, 200).alias("document"), "metadata")
    return count, peek


def _kernel():
    """The scan state as an inner function, so that it reaches the workers by value."""
    def matrix_top_k(query_ids, matrix, wanted, k):
        """Running exact top-k of every query over batches of document vectors."""
        import numpy as np

        best = {}
        limit = np.full(len(query_ids), np.inf)
        norms = (matrix ** 2).sum(axis=1)

        def absorb(ids, vectors, tags):
            own = (vectors ** 2).sum(axis=1)
            # Fast form of the squared distance finds who can still be among the
            # best k; those few are then measured by direct differences.
            rough = own[:, None] + norms[None, :] - 2.0 * vectors @ matrix.T
            slack = 1e-9 * (1.0 + own.max(initial=0.0) + norms.max(initial=0.0))
            if wanted is not None:
                open_to_all = np.isnan(wanted)[None, :]
                rough[~(open_to_all | (tags[:, None] == wanted[None, :]))] = np.inf
            bound = limit
            if len(ids) > k:
                bound = np.minimum(bound, np.partition(rough, k - 1, axis=0)[k - 1])
            rows, cols = np.nonzero((rough <= bound[None, :] + slack) & np.isfinite(rough))
            if not len(rows):
                return
            exact = np.empty(len(rows))
            for start in range(0, len(rows), 100_000):
                part = slice(start, start + 100_000)
                exact[part] = ((vectors[rows[part]] - matrix[cols[part]]) ** 2).sum(axis=1)
            order = np.lexsort((ids[rows], exact, cols))
            rows, cols, exact = rows[order], cols[order], exact[order]
            starts = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]])
            for begin, end in zip(starts, np.r_[starts[1:], len(cols)]):
                j, end = cols[begin], min(end, begin + k)
                near, names = exact[begin:end], ids[rows[begin:end]]
                if j in best:
                    near, names = np.r_[best[j][0], near], np.r_[best[j][1], names]
                    keep = np.lexsort((names, near))[:k]
                    near, names = near[keep], names[keep]
                best[j] = (near, names)
                if len(near) >= k:
                    limit[j] = near[k - 1]

        def result():
            qs, ids, ds = [], [], []
            for j, (near, names) in best.items():
                qs += [query_ids[j]] * len(near)
                ids += names.tolist()
                ds += near.tolist()
            return qs, ids, ds

        return absorb, result

    return matrix_top_k


def nearest_documents(docs: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id",
                      vector_col: str = "embedding", query_id: str = "query_id",
                      query_vector: str = "embedding", match: tuple[str, str] | None = None,
                      local_queries: int = LOCAL_QUERIES, docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """Exact k nearest documents (squared L2) of every query.

    ``match`` = (document column, query column) restricts a query to documents
    with that number; a null query value restricts nothing. Result: query id,
    document id, distance, rank; ties go to the smaller id. A vector with a null
    or non-finite component is compared with nothing.

    A query is compared with the documents of its own vector length;
    :func:`vector_lengths` counts what has no counterpart. Queries are written
    to the shared folder by length. Documents are scanned once, where they lie:
    a task takes at most ``docs_per_block`` of them at once, reads the queries
    in blocks of at most ``local_queries`` against them, and emits at most k
    rows per query and block of documents. Neither side is shuffled, broadcast
    or brought to the driver.
    """
    doc_tag, query_tag = match or (None, None)
    d = docs.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
        (F.col(doc_tag).cast("double") if match else F.lit(None).cast("double")).alias("tag"))
    q = queries.where(F.col(query_vector).isNotNull()).select(
        F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v"),
        (F.col(query_tag).cast("double") if match else F.lit(None).cast("double")).alias("tag"))
    schema = T.StructType([
        T.StructField("q", q.schema["q"].dataType), T.StructField("id", d.schema["id"].dataType),
        T.StructField("distance", T.DoubleType())])
    found = _scan_blocks(d, written_blocks(q, "v"), k, schema, match is not None, local_queries, docs_per_block)
    ranked = top_n_per_key(found, ["q"], [F.col("distance"), F.col("id")], k)
    return ranked.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "distance", "rank")


def vector_lengths(docs: DataFrame, queries: DataFrame, *, vector_col: str = "embedding", query_vector: str = "embedding") -> DataFrame:
    """Documents and queries of each vector length (null where there is no vector), and whether they can be compared."""
    sizes = [x.select(F.when(F.col(c).isNotNull(), F.size(c)).alias("length"), F.lit(a).alias("documents"), F.lit(b).alias("queries"))
             for x, c, a, b in ((docs, vector_col, 1, 0), (queries, query_vector, 0, 1))]
    counts = sizes[0].unionByName(sizes[1]).groupBy("length").agg(F.sum("documents").alias("documents"), F.sum("queries").alias("queries"))
    return counts.withColumn("compared", F.col("length").isNotNull() & (F.col("documents") > 0) & (F.col("queries") > 0))


def _scan_blocks(d: DataFrame, files: dict[int, list[str]], k: int, schema: T.StructType, use_tags: bool,
                 local_queries: int, docs_at_once: int) -> DataFrame:
    """Best k of every query in each block of documents of a task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema, top_k = to_arrow_schema(schema), _kernel()
    read, most_values, lengths = block_reader(files, LOCAL_VALUES, local_queries), LOCAL_VALUES, set(files)

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def compared(docs):
            """Results of one block of documents, length by length."""
            size = pc.list_value_length(docs.column("v"))
            for dim in sorted(set(pc.unique(size).to_pylist()) & lengths):
                own = docs.filter(pc.equal(size, dim)).combine_chunks()
                ids, tags = np.array(own.column("id").to_pylist()), own.column("tag").to_numpy()
                vectors = pc.list_flatten(own.column("v")).to_numpy().reshape(len(ids), dim)
                ok = np.isfinite(vectors).all(axis=1)
                ids, tags, vectors = ids[ok], tags[ok], vectors[ok]
                for asked in read(dim):
                    matrix = pc.list_flatten(asked.column("v")).to_numpy().reshape(asked.num_rows, dim)
                    ok = np.isfinite(matrix).all(axis=1)
                    names, matrix = [x for x, fine in zip(asked.column("q").to_pylist(), ok) if fine], matrix[ok]
                    if not len(names) or not len(ids):
                        continue
                    wanted = asked.column("tag").cast(pa.float64()).to_numpy()[ok] if use_tags else None
                    absorb, result = top_k(names, matrix, wanted, k)
                    step = max(1, most_values // len(names))        # bounds the distances in memory
                    for s in range(0, len(ids), step):
                        absorb(ids[s:s + step], vectors[s:s + step], tags[s:s + step])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, type=f.type) for x, f in zip(result(), arrow_schema)], schema=arrow_schema)

        held, rows, values = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, docs_at_once):
                part = batch.slice(start, docs_at_once)
                more = len(part.column("v").flatten())
                if held and (rows + part.num_rows > docs_at_once or values + more > most_values):
                    yield from compared(pa.Table.from_batches(held))
                    held, rows, values = [], 0, 0
                held.append(part)
                rows, values = rows + part.num_rows, values + more
        if held:
            yield from compared(pa.Table.from_batches(held))

    return d.mapInArrow(scan, schema)


def score(distance):
    """1 / (1 + d); a negative distance has no score."""
    return F.when(distance >= 0, 1 / (1 + distance))


def hit_list(near: DataFrame, docs: DataFrame, top_k: int, *, query_id: str = "query_id",
             metadata_filter: dict[str, object] | None = None) -> DataFrame:
    """Scored hits of each query: filtered, best one per (platform, profile),
    best score first, at most ``top_k``.

    ``near`` is the result of :func:`nearest_documents`; the documents are
    joined only to it, so their texts never travel with the distance scan.
    """
    hits = near.drop("rank").join(docs.select("id", "document", "metadata"), "id")
    if metadata_filter:
        hits = hits.where(metadata_matches(F.col("metadata"), metadata_filter))
    hits = hits.select(
        query_id, "id", "metadata", "document", "distance", score(F.col("distance")).alias("score"),
        integer(lookup(F.col("metadata"), HIT_PLATFORM_KEYS)).alias("platform_number"),
        integer(lookup(F.col("metadata"), HIT_PROFILE_KEYS)).alias("profile_index"))
    far = F.coalesce(F.col("distance"), F.lit(float("inf")))
    best = first_per_key(hits, [query_id, "platform_number", "profile_index"],
                         [-F.coalesce(F.col("score"), F.lit(-1.0)), far, F.col("id")])
    order = [F.col("score").desc_nulls_last(), F.col("distance").asc_nulls_last(), F.col("id")]
    return ranked_top_n(best, [query_id], order, top_k, "hit_rank")   # at most k rows per query


def retrieve(docs: DataFrame, queries: DataFrame, top_k: int, *, metadata_filter: dict[str, object] | None = None,
             match: tuple[str, str] | None = None, query_id: str = "query_id") -> DataFrame:
    """Filter, search, score, deduplicate, order and trim.

    A metadata filter and an explicit platform (``match``) are applied before
    distances are computed, so each query still gets its k nearest matches.
    """
    if metadata_filter:
        docs = docs.where(metadata_matches(F.col("metadata"), metadata_filter))
    near = nearest_documents(docs, queries, top_k, query_id=query_id, match=match)
    return hit_list(near, docs, top_k, query_id=query_id)
