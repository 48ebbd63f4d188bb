"""Reading layer CSV files below <root>/<year>/<month>/."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilelake.functions.text import integer, strip, text_number, utf8
from profilelake.functions.times import reference_timestamp
from profilelake.schemas import LAYER_FILE_PREFIX, LAYERS
from profilelake.session import materialized

# Layers whose columns differ from file to file; they are read by header name.
OPEN_LAYERS = {"qc_profile": "profile_qc", "metadata_full": "extra"}
CORRUPT = "_corrupt"

# File names that are never layer data.
SKIPPED = ("process_log", ".ipynb_checkpoints")


def path_columns(path: Column) -> dict[str, Column]:
    month_folder = r"^.*/(\d{4})/(\d{2})/"
    return {"source_file": path, "year": F.regexp_extract(path, month_folder, 1),
            "month": F.regexp_extract(path, month_folder, 2)}


def wanted_file(path: Column) -> Column:
    low = F.lower(path)
    return ~(low.contains(SKIPPED[0]) | low.contains(SKIPPED[1])) & path.rlike(r"/\d{4}/\d{2}/")


def _reader(spark: SparkSession, layer: str):
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{LAYER_FILE_PREFIX}{layer}*.csv*")
    )


def text_schema(layer: str) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in LAYERS[layer].fields]
                        + [T.StructField(CORRUPT, T.StringType())])


# One field after its comma, plain or quoted with doubled inner quotes.
FIELD_PATTERN = r',("(?:[^"]++|"")*+"|[^,]*+)'


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line as an array of texts."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD_PATTERN), F.lit(1))
    inner = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.transform(fields, lambda x: F.when(x.startswith('"') & (F.length(x) > 1), inner(x)).otherwise(x))


def _named_values(lines: DataFrame) -> DataFrame:
    """(…, line, header) to a map column ``values`` by header name."""
    split = lines.withColumns({"_names": csv_fields(F.col("header")), "_cells": csv_fields(F.col("line"))})
    width = F.least(F.size("_names"), F.size("_cells"))
    values = F.map_from_arrays(
        F.slice(F.transform("_names", strip), F.lit(1), width), F.slice("_cells", F.lit(1), width))
    return split.withColumn("values", values).drop("_names", "_cells", "line", "header")


# What can be wrong with a file as a whole.
MISLABELLED, UNREADABLE, QUOTED_BREAK = "mislabelled_gzip", "read_error", "quoted_line_break"


def listed_files(spark: SparkSession, root: str, layer: str) -> DataFrame:
    """(path) of every file of a layer, from the folder listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", f"*{LAYER_FILE_PREFIX}{layer}*.csv*").load(root)
    return files.where(wanted_file(F.col("path"))).select("path")


# The codec that hands on all bytes takes the place of gzip; its setting has another name where Hadoop is shaded.
PASS_THROUGH = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
                "io.compress.passthrough.extension": ".gz", "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".gz"}


def _packed_lines(spark: SparkSession, files: list[str] | str, layer: str) -> DataFrame:
    """(uri, size, value) of files named .gz as they are stored, not unpacked, cut at each \\n.

    A file is in one task, in order, and only some of it at a time: the text
    reader streams what a codec hands on, and this one hands on all bytes.
    """
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{LAYER_FILE_PREFIX}{layer}*.csv.gz")
        .options(**PASS_THROUGH).option("lineSep", "\n").text(files)
        .select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("size"), "value"))


def probe_gzip(spark: SparkSession, root: str, layer: str) -> DataFrame:
    """(path, kind, records) of the files named .gz.

    ``kind`` is null for a sound file, else what is wrong: content that is not
    gzip, a truncated or damaged stream, or (in text that must be split into
    lines here) line breaks inside quotes. Every file is unpacked to its end by
    the task that reads it; only a full pass can tell a truncated one. A task
    holds a batch of a file's bytes, never the file.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = "uri string, kind string, records bigint"
    out = to_arrow_schema(T._parse_datatype_string(schema))
    by_lines = layer in OPEN_LAYERS
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", f"*{LAYER_FILE_PREFIX}{layer}*.csv.gz").load(root).where(wanted_file(F.col("path"))).select(
        "path", F.col("_metadata.file_path").alias("uri"))
    stored = _packed_lines(spark, root, layer).where(wanted_file(F.col("uri")))

    def probe(batches):
        import zlib
        from itertools import chain, groupby

        import pyarrow as pa

        def chunks():
            seen = {}       # of the file at hand
            for batch in batches:
                names = batch.column(0).to_pylist()
                sizes, values = batch.column(1), batch.column(2)
                edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
                for s, e in zip(edges[:-1], edges[1:]):
                    if s == e:
                        continue
                    data = b"\n".join(values[s:e].to_pylist()) + b"\n"
                    seen = {names[s]: seen.get(names[s], 0) + len(data)}
                    # no line break at the end of the file
                    yield names[s], data[:-1] if seen[names[s]] > sizes[s].as_py() else data

        def unpacked(parts):
            unpack, tail = zlib.decompressobj(31), b""
            for rest in parts:
                while rest:
                    if unpack.eof:
                        unpack = zlib.decompressobj(31)
                    piece = unpack.decompress(rest, 1 << 20)
                    *whole, tail = (tail + piece).split(b"\n")
                    yield from whole
                    rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if not unpack.eof:
                raise zlib.error("truncated")
            yield tail

        for uri, parts in groupby(chunks(), key=lambda c: c[0]):
            data = (c for _, c in parts)
            first, records, broken = next(data), 0, False
            plain, data = first[:2] != b"\x1f\x8b", chain([first], data)
            try:
                for line in (x for c in data for x in c.split(b"\n")) if plain else unpacked(data):
                    records += bool(line.strip(b"\r"))
                    broken |= line.count(b'"') % 2 == 1
                kind = QUOTED_BREAK if broken and (plain or by_lines) else MISLABELLED if plain else None
            except zlib.error:
                kind, records = UNREADABLE, None
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([kind], pa.string()), pa.array([records], pa.int64())], schema=out)

    found = stored.select("uri", "size", F.col("value").cast("binary")).mapInArrow(probe, schema)
    return listed.join(found, "uri").select("path", "kind", "records")


def mislabelled_lines(spark: SparkSession, root: str, layer: str, probed: DataFrame) -> DataFrame:
    """Lines of files named .gz whose content is plain text: (path, header, line, _block, _seq)."""
    plain = probed.where((F.col("kind") == MISLABELLED) & (F.col("records") > 0)).select("path")
    paths = sorted(r["path"] for r in plain.collect())     # names only
    if not paths:
        return spark.createDataFrame([], "path string, header string, line string, _block bigint, _seq bigint")
    names = spark.read.format("binaryFile").load(paths).select("path", F.col("_metadata.file_path").alias("uri"))
    line = F.regexp_replace(utf8(F.col("value")), r"\r\z", "")
    lines = _packed_lines(spark, paths, layer).select("uri", line.alias("line"), F.monotonically_increasing_id().alias("_seq"))
    headers = materialized(lines.groupBy("uri").agg(F.min_by("line", "_seq").alias("header"), F.min("_seq").alias("_first")).join(names, "uri"))
    return lines.join(headers, "uri").where((F.col("_seq") > F.col("_first")) & (F.col("line") != "")).select(
        "path", "header", "line", F.lit(0).cast("bigint").alias("_block"), "_seq")


def _odd_quotes(line: Column) -> Column:
    """An odd number of quotes on a line means that a quoted value goes on after it."""
    return (F.length(line) - F.length(F.replace(line, F.lit('"')))) % 2 == 1


def sound_files(spark: SparkSession, root: str, layer: str, probed: DataFrame) -> list[str]:
    """Paths of a layer's files without those that a probe found wrong: names only, as many as the listing has."""
    bad = probed.where("kind IS NOT NULL").select("path")
    return sorted(r["path"] for r in listed_files(spark, root, layer).join(bad, "path", "left_anti").collect())


def _text_lines(spark: SparkSession, root: str, layer: str, sound: list[str] | None) -> DataFrame:
    """(path, _block, line, _seq) of all files below ``root``, or of the ``sound`` ones. A file that cannot be read fails the job."""
    path = F.col("_metadata.file_path")
    if sound == []:
        return spark.createDataFrame([], "path string, _block bigint, line string, _seq bigint")
    return _reader(spark, layer).text(root if sound is None else sound).where(wanted_file(path)).select(
        path.alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line"),
        F.monotonically_increasing_id().alias("_seq"))


def _open_layer_values(spark: SparkSession, root: str, layer: str, sound: list[str] | None) -> DataFrame:
    """Lines of a layer with differing headers: (path, header, line, _block, _seq).

    Files with line breaks inside quotes cannot be split into lines: they are
    left out as a whole and reported by :func:`file_issues`.
    """
    lines = _text_lines(spark, root, layer, sound)
    first = F.col("_block") == 0
    headers = lines.groupBy("path").agg(
        F.min_by("line", F.when(first, F.col("_seq"))).alias("header"), F.min(F.when(first, F.col("_seq"))).alias("_first"),
        F.max(_odd_quotes(F.col("line"))).alias("_broken"))
    body = lines.join(headers.where("NOT _broken"), "path").where(
        ~(first & (F.col("_seq") == F.col("_first"))) & (F.col("line") != ""))
    return body.select("path", "header", "line", "_block", "_seq")


def raw_layer(spark: SparkSession, root: str, layer: str, *, probe: bool = True) -> DataFrame:
    """All rows of a layer as text, with source_file, year, month and the row's
    place (_block, _seq); a row that does not fit the header is kept whole in
    the corrupt column.

    With ``probe``, files named .gz are examined first: mislabelled ones are
    read as text, damaged ones left out as a whole (:func:`file_issues` names
    them). The others are read strictly, with or without it: whatever else
    fails while reading fails the job, so nothing is lost unseen.
    """
    probed = materialized(probe_gzip(spark, root, layer)) if probe else None
    sound = sound_files(spark, root, layer, probed) if probe else None
    if layer in OPEN_LAYERS:
        lines = _open_layer_values(spark, root, layer, sound)
        if probe:
            lines = lines.unionByName(mislabelled_lines(spark, root, layer, probed))
        named = _named_values(lines)
        return named.withColumn(CORRUPT, F.lit(None).cast("string")).withColumns(path_columns(F.col("path"))).drop("path")
    schema = text_schema(layer)
    path = F.col("_metadata.file_path")
    reader = _reader(spark, layer).schema(schema).option("header", True).option("enforceSchema", False).option(
        "columnNameOfCorruptRecord", CORRUPT)
    regular = None if sound == [] else (
        reader.csv(root if sound is None else sound)
        .where(wanted_file(path)).withColumns(path_columns(path))
        .withColumns({"_block": F.col("_metadata.file_block_start"), "_seq": F.monotonically_increasing_id()})
    )
    if not probe:
        return regular
    named = _named_values(mislabelled_lines(spark, root, layer, probed))
    fields = [F.col("values")[f.name].alias(f.name) for f in LAYERS[layer].fields]
    rest = named.select(*fields, F.lit(None).cast("string").alias(CORRUPT), "path", "_block", "_seq").withColumns(
        path_columns(F.col("path"))).drop("path")
    return rest if regular is None else regular.unionByName(rest)


def file_issues(spark: SparkSession, root: str, layer: str) -> DataFrame:
    """(layer, year, month, source_file, issue) of files that could not be loaded as a whole."""
    probed = materialized(probe_gzip(spark, root, layer))
    issues = probed.where(F.col("kind").isin(UNREADABLE, QUOTED_BREAK)).select("path", F.col("kind").alias("issue"))
    if layer in OPEN_LAYERS:
        lines = _text_lines(spark, root, layer, sound_files(spark, root, layer, probed))
        broken = lines.where(_odd_quotes(F.col("line"))).select("path").distinct()
        issues = issues.unionByName(broken.withColumn("issue", F.lit(QUOTED_BREAK)))
    return issues.withColumns(path_columns(F.col("path"))).select(F.lit(layer).alias("layer"), "year", "month", "source_file", "issue")


def with_row_position(raw: DataFrame) -> DataFrame:
    """``row_ordinal``: the row's place in its file, from 0, whatever the splits.

    Rows are counted per block of a file; the sums before each block are joined back.
    """
    blocks = raw.groupBy("source_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = raw.join(starts, ["source_file", "_block"])
    return placed.withColumn("row_ordinal", F.col("_before") + F.col("_seq") - F.col("_first")).drop("_block", "_seq", "_before", "_first")


def _text(c: Column) -> Column:
    """Trimmed text; blank and the written-out missing value are null."""
    return F.nullif(F.nullif(strip(c), F.lit("")), F.lit("nan"))


def _typed(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DoubleType):
        return text_number(c)
    if isinstance(dtype, T.LongType):
        return integer(c)
    if isinstance(dtype, T.TimestampType):
        return reference_timestamp(c)
    return _text(c)


def _fully_read(raw: DataFrame) -> Column:
    """Always true, but reads every field: the parser judges a row only by the
    fields that are asked for."""
    fields = [c for c in raw.columns if c not in (CORRUPT, "source_file", "year", "month", "_block", "_seq", "row_ordinal")]
    return F.hash(*[F.size(c) if c == "values" else F.col(c) for c in fields]) >= F.lit(-(2**31))


def typed_layer(raw: DataFrame, layer: str, *, ordinal: bool = True) -> DataFrame:
    """Raw text rows in the layer's schema, with lineage and partition columns.
    Rejected rows are left out (see :func:`rejected_rows`). Streams have no
    row ordinal."""
    schema, open_column = LAYERS[layer], OPEN_LAYERS.get(layer)
    known = [f.name for f in schema.fields if f.name != open_column]
    columns = []
    for f in schema.fields:
        if f.name == open_column:
            others = F.map_filter("values", lambda k, v: ~k.isin(known) & _text(v).isNotNull())
            columns.append(F.transform_values(others, lambda k, v: _text(v)).alias(f.name))
        else:
            source = F.col("values")[f.name] if open_column else F.col(f.name)
            columns.append(_typed(source, f.dataType).alias(f.name))
    if ordinal:
        raw = with_row_position(raw)
    position = ["row_ordinal"] if ordinal else []
    return raw.where(F.col(CORRUPT).isNull() & _fully_read(raw)).select(*columns, "source_file", *position, "year", "month")


def read_layer(spark: SparkSession, root: str, layer: str, *, probe: bool = True) -> DataFrame:
    return typed_layer(raw_layer(spark, root, layer, probe=probe), layer)


def rejected_rows(spark: SparkSession, root: str, layer: str) -> DataFrame:
    raw = raw_layer(spark, root, layer)
    return raw.where(F.col(CORRUPT).isNotNull() & _fully_read(raw)).select("source_file", "year", "month", F.col(CORRUPT).alias("line"))


def source_counts(spark: SparkSession, root: str, layer: str) -> DataFrame:
    """What the folders hold per month, independent of the CSV parser that loads them.

    ``files`` come from the listing. ``csv_rows`` counts lines below the header
    that are not empty, in files that can be read; ``rejected_rows`` is what the
    parser turns away, and ``bad_files`` names each file that is not loaded,
    with its issue.
    """
    months = ["year", "month"]
    listed = listed_files(spark, root, layer).withColumns(path_columns(F.col("path")))
    files = listed.groupBy(*months).agg(F.count(F.lit(1)).alias("files"))
    probed = materialized(probe_gzip(spark, root, layer))
    lines = _text_lines(spark, root, layer, sound_files(spark, root, layer, probed)).where("line <> ''")
    issues = file_issues(spark, root, layer)
    sound = lines.groupBy("path").agg(F.count(F.lit(1)).alias("records")).unionByName(
        probed.where(F.col("kind") == MISLABELLED).select("path", "records"))
    sound = sound.join(issues.select(F.col("source_file").alias("path")), "path", "left_anti").withColumns(path_columns(F.col("path")))
    rows = sound.groupBy(*months).agg(F.sum(F.greatest(F.col("records") - 1, F.lit(0))).alias("csv_rows"))
    rejected = rejected_rows(spark, root, layer).groupBy(*months).agg(F.count(F.lit(1)).alias("rejected_rows"))
    bad = issues.groupBy(*months).agg(F.array_sort(F.collect_list(F.concat_ws(
        ": ", F.element_at(F.split("source_file", "/"), -1), "issue"))).alias("bad_files"))     # a month's files, not its rows
    both = files.join(rows, months, "left").join(rejected, months, "left").join(bad, months, "left")
    return both.select(
        F.lit(layer).alias("layer"), *months, "files", F.coalesce("csv_rows", F.lit(0).cast("bigint")).alias("csv_rows"),
        F.coalesce("rejected_rows", F.lit(0).cast("bigint")).alias("rejected_rows"),
        F.coalesce("bad_files", F.array().cast("array<string>")).alias("bad_files"))


# --- files of unknown layout ---------------------------------------------------

# Parts of a column name that mark a time.
TIME_WORDS = ("JULD", "DATE", "TIME", "REFERENCE", "TIMESTAMP")


def is_time_name(name: str) -> bool:
    """Flags of a time column (…_QC) are not times."""
    upper = name.upper()
    return any(w in upper for w in TIME_WORDS) and not upper.endswith("_QC")


def normalize_types(df: DataFrame) -> DataFrame:
    """Types for all-text columns: times by name, whole numbers as BIGINT, other
    numbers as DOUBLE, the rest trimmed text. One aggregate looks at all columns."""
    names = [c for c in df.columns if not is_time_name(c)]
    clean = df.select(*[_text(F.col(c).cast("string")).alias(c) for c in df.columns])
    profile = {}
    if names:
        checks = []
        values = clean.select(*names, *[text_number(F.col(c)).alias(f"{c}#") for c in names])
        for i, name in enumerate(names):
            value = F.col(f"{name}#")
            checks += [
                F.count(name).alias(f"n{i}"), F.count(value).alias(f"d{i}"),
                F.coalesce(F.bool_and(value == F.floor(value)), F.lit(False)).alias(f"w{i}")]
        profile = values.agg(*checks).first().asDict()
    columns = []
    for name in df.columns:
        c = F.col(name)
        if is_time_name(name):
            c = reference_timestamp(c)
        else:
            i = names.index(name)
            if profile[f"n{i}"] and profile[f"n{i}"] == profile[f"d{i}"]:
                c = integer(c) if profile[f"w{i}"] else text_number(c)
        columns.append(c.alias(name))
    return clean.select(*columns)
