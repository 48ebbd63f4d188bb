"""Jobs over files, skewed keys and small fixtures checked by brute force."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilelake.operators import fetch, layers, quality, query_blocks, ranking, stats, vectors
from profilelake.plans import context, visuals
from profilelake.plans.gate import region_hits
from profilelake.plans.retrieval import visual_for
from profilelake.schemas import CRITICAL_COLUMNS, LAYERS
from profilelake.sources import layer_csv, tables
from profilelake.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- ranking -------------------------------------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(40), i) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, v int, i int").repartition(8)


@pytest.mark.parametrize("salts", [1, 64])
def test_top_n_with_hot_and_null_keys(skewed, salts):
    got = ranking.top_n_per_key(skewed, ["k"], [F.col("v").desc(), F.col("i")], 7, salts=salts).collect()
    rows = skewed.collect()
    for key in (1, 2, 3, None):
        want = sorted((r for r in rows if r["k"] == key), key=lambda r: (-r["v"], r["i"]))[:7]
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: r["rank"])
        assert [r["i"] for r in mine] == [r["i"] for r in want]
        assert [r["rank"] for r in mine] == list(range(1, 8))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile(skewed, q):
    got = {r["k"]: r["quantile"] for r in ranking.exact_quantile(skewed, ["k"], "v", q).collect()}
    values = {}
    for r in skewed.collect():
        values.setdefault(r["k"], []).append(r["v"])
    assert got == {k: pytest.approx(np.quantile(v, q)) for k, v in values.items()}


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantile_with_sketched_brackets(spark, q):
    """A hot group, ties, small groups, a null group; and brackets that miss are noticed and made good."""
    rng = np.random.default_rng(11)
    groups = {"hot": rng.normal(size=30_000).round(4), "ties": np.repeat([1.0, 2.0, 3.0], [5000, 1, 5000]), "one": np.array([4.0]),
              "few": np.array([1.0, 9.0, 10.0]), None: np.array([5.0, -5.0])}
    frame = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("nulls", None)], "g string, v double").repartition(6)
    wrong = spark.createDataFrame([(g, [-1e9, -1e8] if i % 2 else [1e8, 1e9]) for i, g in enumerate(groups)], "g string, bracket array<double>")
    for options in ({}, {"brackets": wrong}, {"sketch": False}):
        got = {r["g"]: r["quantile"] for r in ranking.exact_quantile(frame, ["g"], "v", q, **options).collect()}
        assert got == pytest.approx({g: float(np.quantile(v, q)) for g, v in groups.items()})
    assert ranking.exact_quantile(frame.limit(0), ["g"], "v", q).count() == 0
    whole = ranking.exact_quantile(frame, [], "v", q).collect()
    assert [r["quantile"] for r in whole] == pytest.approx([float(np.quantile(np.concatenate(list(groups.values())), q))])


def test_bracketed_values_are_few(spark):
    """Only values inside the bracket reach the sort; all others are two counts."""
    frame = spark.range(200_000).select(F.lit(0).alias("g"), F.xxhash64("id").cast("double").alias("v"))
    low, high = frame.agg(ranking.bracket("v", 0.5)).first()[0]
    inside = frame.where((F.col("v") >= low) & (F.col("v") <= high)).count()
    below = frame.where(F.col("v") < low).count()
    assert inside < 0.01 * 200_000 and below <= 99_999 and 100_000 < below + inside



@pytest.mark.parametrize("points", [1, 2, 200, 5000])
def test_pick_evenly(skewed, points):
    picked, total = ranking.pick_evenly(skewed, [F.col("v"), F.col("i")], points)
    rows = sorted(skewed.collect(), key=lambda r: (r["v"], r["i"]))
    where = np.linspace(0, total - 1, points, dtype=int) if points < total else range(total)
    assert [r["i"] for r in picked.orderBy("ordinal").collect()] == [rows[j]["i"] for j in where]


def test_plans_keep_pushdown_and_stay_distributed(spark):
    core = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.col("l_suppkey").alias("platform_number"), F.col("l_partkey").alias("profile_index"),
        F.col("l_shipdate").alias("juld"), F.col("l_quantity").alias("PRES"), F.col("l_tax").alias("unused"),
        F.lit("1995").alias("year"), F.date_format("l_shipdate", "MM").alias("month"))
    wanted = spark.read.parquet(f"{SF}/supplier.parquet").select(F.col("s_suppkey").alias("platform_number"))
    text = plan(fetch.fetch_measurements(core, wanted, date_from="1995-01-01", date_to="1995-12-31"))
    assert "WindowGroupLimit" in text and "LeftSemi" in text
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert "l_tax" not in text and "SinglePartition" not in text


def test_metadata_width_is_decided_file_by_file(spark):
    rows = [("a", i, [1, 2], list("ab"), [0] * 9) for i in range(3)] + [("wide", 0, [7] * 9, list("cd"), [0] * 9), ("wide", 1, [8], ["x"] * 513, [0] * 9)]
    rows += [("b", 0, None, None, None), ("b", 1, [5] * 8, ["y"] * 512, None), (None, 0, [6], ["z"], [0] * 9)]
    df = spark.createDataFrame(rows, "source_file string, profile_index long, CYCLE array<int>, NAME array<string>, PRES array<int>").repartition(4)
    full = layers.metadata_full(df.where("source_file != 'b' OR source_file IS NULL"))
    assert full.columns == ["source_file", "profile_index", "CYCLE", "NAME"]    # PRES is too wide in every file
    got = {(r["source_file"], r["profile_index"]): (r["CYCLE"], r["NAME"]) for r in layers.metadata_full(df).collect()}
    assert len(got) == len(rows) and all(got["a", i] == ("12", "ab") for i in range(3))
    assert got["wide", 0] == got["wide", 1] == (None, None)
    assert got["b", 1] == ("5" * 8, "y" * 512) and got[None, 0] == ("6", "z")
    extra = spark.createDataFrame([("a", "p1"), ("b", "p2")], "source_file string, PROJECT_NAME string")
    assert {(r["source_file"], r["PROJECT_NAME"]) for r in layers.metadata_full(df, extra).collect()} == {("a", "p1"), ("b", "p2"), ("wide", ""), (None, "")}


# --- vectors -------------------------------------------------------------------

@pytest.mark.parametrize("local", [100, 3])
def test_nearest_documents_against_brute_force(spark, local):
    rng = np.random.default_rng(3)
    docs, queries = rng.normal(size=(500, 8)).round(1), rng.normal(size=(11, 8)).round(1)
    docs[100:160] = docs[0]   # many copies of one document
    tags = [int(x) for x in rng.integers(0, 3, 500)]
    d = spark.createDataFrame([(f"d{i:03d}", v.tolist(), tags[i]) for i, v in enumerate(docs)], "id string, embedding array<double>, tag long").repartition(5)
    wanted = [None if j % 2 else j % 3 for j in range(11)]
    q = spark.createDataFrame([(j, v.tolist(), wanted[j]) for j, v in enumerate(queries)], "query_id int, embedding array<double>, want long")
    got = vectors.nearest_documents(d, q, 9, match=("tag", "want"), local_queries=local, docs_per_block=60).orderBy("query_id", "rank").collect()
    for j in range(11):
        allowed = [i for i in range(500) if wanted[j] is None or tags[i] == wanted[j]]
        want = sorted((((docs[i] - queries[j]) ** 2).sum(), f"d{i:03d}") for i in allowed)[:9]
        mine = [(r["distance"], r["id"]) for r in got if r["query_id"] == j]
        assert [m[1] for m in mine] == [w[1] for w in want]
        assert np.allclose([m[0] for m in mine], [w[0] for w in want])


@pytest.mark.parametrize("local", [100, 2])
def test_nearest_documents_of_mixed_lengths(spark, local):
    rng = np.random.default_rng(5)
    docs = [rng.normal(size=n).round(1) for n in [4] * 60 + [7] * 50 + [3] * 5]
    queries = [rng.normal(size=n).round(1) for n in [7, 4, 4, 7, 4, 9, 7, 4]]
    d = spark.createDataFrame([(f"d{i:03d}", v.tolist()) for i, v in enumerate(docs)] + [("none", None)], "id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(queries)], "query_id int, embedding array<double>")
    got = vectors.nearest_documents(d, q, 5, local_queries=local, docs_per_block=20).orderBy("query_id", "rank").collect()
    for j, v in enumerate(queries):
        want = sorted((((x - v) ** 2).sum(), f"d{i:03d}") for i, x in enumerate(docs) if len(x) == len(v))[:5]
        assert [r["id"] for r in got if r["query_id"] == j] == [w[1] for w in want]
    lengths = {r["length"]: tuple(r)[1:] for r in vectors.vector_lengths(d, q).collect()}
    assert lengths == {4: (60, 4, True), 7: (50, 3, True), 3: (5, 0, False), 9: (0, 1, False), None: (1, 0, False)}


def test_nearest_documents_without_usable_vectors(spark):
    docs = [("a", [1.0, 2.0]), ("b", [float("nan"), 2.0]), ("c", [None, 1.0]), ("d", [float("inf"), 0.0]), ("e", []), ("f", None), ("g", [3.0, 2.0])]
    d = spark.createDataFrame(docs, "id string, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan"), 0.0]), (3, None), (4, [])], "query_id int, embedding array<double>")
    got = vectors.nearest_documents(d, q, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["distance"]) for r in got] == [(1, "a", 0.0), (1, "g", 4.0), (4, "e", 0.0)]
    assert vectors.nearest_documents(d, q.limit(0), 5).count() == 0
    assert vectors.nearest_documents(d.limit(0), q, 5).count() == 0


def test_query_blocks_hold_every_query_once(spark):
    q = spark.createDataFrame([(i, [float(i)] * (2 + i % 3)) for i in range(200)], "q long, v array<double>").repartition(7)
    files = query_blocks.written_blocks(q, "v")
    assert set(files) == {2, 3, 4}
    for values, most in ((40, None), (40, 3), (1, None), (10 ** 6, None)):
        read = query_blocks.block_reader(files, values, most)
        for length in (2, 3, 4, 2):
            tables = list(read(length))
            assert all(t.num_rows <= max(1, min(values // length, most or values)) for t in tables)
            assert sorted(x for t in tables for x in t.column("q").to_pylist()) == [i for i in range(200) if 2 + i % 3 == length]
        assert list(read(9)) == []


def test_upsert_partitions_twice_is_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    schema = "id string, document string, version int, year string, month string"
    spark.createDataFrame([("a", "old", 1, "2025", "01"), ("b", "old", 1, "2025", "01"), ("c", "old", 1, "2025", "02")], schema).write.partitionBy("year", "month").parquet(path)
    batch = spark.createDataFrame([("a", "new", 3, "2025", "01"), ("a", "mid", 2, "2025", "01"), ("d", "new", 1, "2025", "03")], schema)
    for _ in range(2):
        vectors.upsert_partitions(path, batch)
    rows = sorted((r["id"], r["document"], r["month"]) for r in spark.read.schema(schema).parquet(path).collect())
    assert rows == [("a", "new", "01"), ("b", "old", "01"), ("c", "old", "02"), ("d", "new", "03")]


# --- files ---------------------------------------------------------------------

CORE_HEADER = ",".join(f.name for f in LAYERS["core_measurements"].fields)


@pytest.fixture
def csv_root(tmp_path):
    def put(month, name, content):
        folder = tmp_path / "csv" / "2025" / month / "file1"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())

    core = f"{CORE_HEADER}\n0,5906527,2025-01-02 03:04:05.5,0,4.1,21.2,35.6,1,,1,,1,\n0,5906527.0,2025-01-02,1,nan,,,4,,9,,9,\n"
    put("01", "argo_core_measurements.csv", core)
    put("01", "argo_core_measurements_b.csv.gz", gzip.compress(core.encode()))
    put("02", "argo_core_measurements.csv.gz", core)                      # plain text under a .gz name
    put("02", "argo_core_measurements_bad.csv.gz", b"\x1f\x8bbroken")     # unreadable
    put("02", "argo_core_measurements_process_log.csv", "x\n1\n")
    put("03", "argo_core_measurements.csv", core + "1,2\n")               # a row that does not fit
    put("01", "argo_metadata_full.csv", "PLATFORM_NUMBER,PROJECT_NAME,ODD\n5906527, P1 ,\"a, \"\"b\"\"\"\n5906528,nan,\n")
    put("02", "argo_metadata_full.csv", "ODD,EXTRA,PLATFORM_NUMBER\nx,y,5906527\n")
    return str(tmp_path / "csv")


def test_csv_layers(spark, csv_root, tmp_path):
    out = str(tmp_path / "tables")
    outcome = tables.convert_layers(spark, csv_root, out, ["core_measurements", "metadata_full", "history"])
    assert outcome[0] == ("core_measurements", "PARTIAL", "argo_core_measurements_bad.csv.gz: read_error")
    assert outcome[1] == ("metadata_full", "OK", "")
    core = tables.read_table(spark, f"{out}/core_measurements", "core_measurements")
    assert {(r["month"], r["count"]) for r in core.groupBy("month").count().collect()} == {("01", 4), ("02", 2), ("03", 2)}
    assert core.where("platform_number = 5906527").count() == 8
    assert core.where("level_index = 1 AND PRES IS NULL AND TEMP IS NULL").count() == 4
    assert "PartitionFilters: [isnotnull(month" in plan(fetch.in_months(core, ["01"]))
    meta = {(r["month"], r["PLATFORM_NUMBER"]): r for r in tables.read_table(spark, f"{out}/metadata_full", "metadata_full").collect()}
    assert meta["01", 5906527]["PROJECT_NAME"] == "P1" and meta["01", 5906527]["extra"] == {"ODD": 'a, "b"'}
    assert meta["01", 5906528]["PROJECT_NAME"] is None
    assert meta["02", 5906527]["extra"] == {"ODD": "x", "EXTRA": "y"}

    counted = quality.partition_counts(core, "core_measurements").withColumnRenamed("row_count", "parquet_rows")
    report = {r["month"]: r for r in quality.reconcile(layer_csv.source_counts(spark, csv_root, "core_measurements"), counted).collect()}
    assert report["01"]["matches"] and not report["02"]["matches"] and not report["03"]["matches"]
    assert report["02"]["issues"] == ["argo_core_measurements_bad.csv.gz: read_error"] and report["02"]["csv_rows"] == 2
    assert report["03"]["issues"] == ["rows_rejected", "row_count_differs"]
    assert layer_csv.rejected_rows(spark, csv_root, "core_measurements").count() == 1
    tables.write_manifest(quality.reconcile(layer_csv.source_counts(spark, csv_root, "core_measurements"), counted), f"{out}/manifest")
    assert spark.read.json(f"{out}/manifest").count() == 3
    # a second run replaces months instead of adding to them
    tables.convert_layers(spark, csv_root, out, ["core_measurements"])
    assert tables.load_view(spark, f"{out}/core_measurements", "core_measurements").count() == 8


def test_damaged_files_are_named_and_left_out(spark, csv_root, tmp_path):
    folder = tmp_path / "csv" / "2025" / "04"
    folder.mkdir(parents=True)
    lines = "\n".join(f"{i},59,2025-01-02,0,1,2,3,1,,1,,1," for i in range(5000))
    (folder / "argo_core_measurements.csv.gz").write_bytes(gzip.compress(f"{CORE_HEADER}\n{lines}\n".encode())[:-400])
    (folder / "argo_core_measurements_q.csv.gz").write_bytes(f'{CORE_HEADER}\n1,59,"2025\n-01-02",0,1,2,3,1,,1,,1,\n'.encode())
    (folder / "argo_metadata_full.csv").write_text('PLATFORM_NUMBER,PROJECT_NAME\n1,"a\nb"\n2,c\n')
    out = str(tmp_path / "tables")
    outcome = dict((o[0], o[1:]) for o in tables.convert_layers(spark, csv_root, out, ["core_measurements", "metadata_full"]))
    assert outcome["core_measurements"][0] == "PARTIAL" and outcome["core_measurements"][1].count(";") == 2
    assert outcome["metadata_full"] == ("PARTIAL", "argo_metadata_full.csv: quoted_line_break")
    core = tables.read_table(spark, f"{out}/core_measurements", "core_measurements")
    assert core.where("month = '04'").count() == 0 and core.count() == 8
    counted = quality.partition_counts(core, "core_measurements").withColumnRenamed("row_count", "parquet_rows")
    report = {r["month"]: r for r in quality.reconcile(layer_csv.source_counts(spark, csv_root, "core_measurements"), counted).collect()}
    assert not report["04"]["matches"] and report["04"]["issues"] == [
        "parquet_missing", "argo_core_measurements.csv.gz: read_error", "argo_core_measurements_q.csv.gz: quoted_line_break"]


def test_packed_files_are_read_in_pieces(spark, tmp_path):
    """No row of the probe or of a mislabelled file's lines holds a file or all of its lines."""
    folder = tmp_path / "csv" / "2025" / "01"
    folder.mkdir(parents=True)
    text = "profile_index,variable,value\n" + "".join(f"{i},TEMP,{i * 7919 % 10007}\n" for i in range(30_000))
    packed = gzip.compress(text.encode(), mtime=0)
    breaks = [i + 1 for i, b in enumerate(packed) if b == 10]
    files = {"a": text.encode(), "b": packed, "c": packed[:breaks[3]], "d": packed[:-1], "e": packed + packed, "f": b"x,y\r\n1,2\r\n\r\n3,4"}
    for name, data in files.items():
        (folder / f"argo_calibration_{name}.csv.gz").write_bytes(data)
    root = str(tmp_path / "csv")
    probed = layer_csv.probe_gzip(spark, root, "calibration")
    got = {r["path"][-8]: (r["kind"], r["records"]) for r in probed.collect()}
    assert got == {"a": ("mislabelled_gzip", 30_001), "b": (None, 30_001), "c": ("read_error", None), "d": ("read_error", None),
                   "e": (None, 60_002), "f": ("mislabelled_gzip", 3)}
    lines = layer_csv.mislabelled_lines(spark, root, "calibration", probed)
    assert [r["line"] for r in lines.where("path like '%_f.csv.gz'").orderBy("_seq").collect()] == ["1,2", "3,4"]
    assert lines.where("path like '%_a.csv.gz' and header = 'profile_index,variable,value'").count() == 30_000
    for df in (probed, lines):
        assert "content" not in plan(df) and "posexplode" not in plan(df)


def test_row_positions_do_not_depend_on_splits_or_other_files(spark, tmp_path):
    def put(month, rows):
        folder = tmp_path / "csv" / "2025" / month
        folder.mkdir(parents=True, exist_ok=True)
        text = "\n".join(f"{i},59,2025-01-02,{i},1,2,3,1,,1,,1," for i in range(rows))
        (folder / "argo_core_measurements.csv").write_text(f"{CORE_HEADER}\n{text}\n")

    def places():
        rows = layer_csv.read_layer(spark, str(tmp_path / "csv"), "core_measurements")
        return {(r["month"], r["level_index"]): r["row_ordinal"] for r in rows.where("month <> '00'").collect()}

    for month, n in (("02", 900), ("03", 40)):
        put(month, n)
    first = places()
    assert all(k[1] == v for k, v in first.items())
    put("00", 500)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert places() == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_incremental_ingest(spark, csv_root, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    root = f"{csv_root}/2025/01"
    for _ in range(2):
        ingest.ingest_new_files(ingest.layer_stream(spark, root, "core_measurements"), out, log).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_choose_metadata(spark):
    schema = "platform_number long, year string"
    full = spark.createDataFrame([(1, "2024")], schema)
    clean = spark.createDataFrame([(2, "2025")], schema)
    empty = spark.createDataFrame([], schema)
    pick = lambda *a: [r[0] for r in fetch.choose_metadata(*a).collect()]
    assert pick(full, clean, "2024") == [1] and pick(full, clean, "2025") == [2]
    assert pick(full, clean, "2020") == [1] and pick(empty, clean, "2020") == [2] and pick(empty, empty, "2020") == []


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    entries = spark.createDataFrame([("a", "OK", None), ("b", "ERROR", "x")], "filename string, status string, message string")
    tables.append_run_log(spark, path, entries)
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "filename string")
    log = tables.read_run_log(spark, path)
    assert sorted(r[0] for r in fetch.unprocessed(files, log).collect()) == ["b", "c"]
    assert sorted(r[0] for r in fetch.unprocessed(files, log, skip_errors=True).collect()) == ["c"]


def test_profile_exists_deals_a_large_table_over_more_parts(spark, monkeypatch):
    rng = random.Random(3)
    some = lambda n: rng.choice([None, *range(n)])      # noqa: E731
    have = [(some(40), some(9)) for _ in range(300)]
    asked = [(some(50), some(12)) for _ in range(200)]
    schema = "platform_number long, profile_index long"
    monkeypatch.setattr(quality, "ROWS_PER_TASK", 300 // 29, raising=False)
    found = quality.profile_exists(spark.createDataFrame(asked, schema), spark.createDataFrame(have, schema))
    assert ", REPARTITION_BY_NUM" in plan(found) and "30), REPARTITION_BY_NUM" in plan(found)
    want = [(p, i, p is not None and any(p == q and j is not None and i in (None, j) for q, j in have)) for p, i in asked]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_null_summary_covers_all_layers(spark):
    layers = {n: spark.createDataFrame([], s) for n, s in LAYERS.items()}
    rows = quality.null_summary(layers, CRITICAL_COLUMNS).collect()
    assert len(rows) == sum(len(c) for c in CRITICAL_COLUMNS.values())
    assert quality.schema_rows(layers, LAYERS).where("NOT as_expected").count() == 0


# --- statistics, visuals, contexts ------------------------------------------------

def test_statistics_skip_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,), (10.0,)], "TEMP double")
    r = stats.six_statistics(df).first()
    assert (r["count"], r["mean"], r["median"], r["min"], r["max"], r["std"]) == (3, 4.333333, 2.0, 1.0, 10.0, 4.932883)


def test_visual_fallbacks(spark):
    numeric = spark.createDataFrame([(1, 2.0), (2, None)], "platform_number long, PRES double")
    assert visuals.build_visual("time_series", numeric, None).title == "Numeric sample"
    assert visuals.build_visual("map", None, numeric).reason == "Missing lat/lon columns."
    assert visuals.build_visual("profile", None, None).kind == "none"
    assert visuals.chart_series(numeric, "PRES", "TEMP").reason == "Missing columns for chart: need PRES and TEMP."
    assert visuals.resolve_intent(spark, "average of all") == "aggregate"
    places = spark.createDataFrame([(1, "10.5", "20"), (2, "x", "1"), (3, None, "1")], "platform_number long, latitude string, longitude string")
    payload = json.loads(visuals.payload_json(visuals.map_points(places, label="platform_number", order=["platform_number"])))
    assert payload["points"] == [{"lat": 10.5, "lon": 20.0, "label": "1"}]
    assert [o["reason"] for o in payload["omitted_reasons"]] == ["non-numeric lat/lon", "missing lat or lon"]
    table = json.loads(visuals.payload_json(visuals.table_preview(numeric, "t", ["platform_number"])))
    assert table["rows"] == [[1, 2.0], [2, None]] and table["row_count"] == 2


@pytest.mark.parametrize("limit,mark,lines", [(12_000, "METADATA", None), (700, "SAMPLE (shortened)", 25), (120, "HITS", 0)])
def test_context_limits(spark, limit, mark, lines):
    ask = spark.createDataFrame([("q", "how warm")], "query_id string, text string")
    rows = spark.range(1, 61).select(
        F.lit("q").alias("query_id"), F.lit(7).cast("long").alias("platform_number"), (F.col("id") % 20).alias("profile_index"),
        F.timestamp_seconds(F.col("id") * 86400).alias("juld"), F.col("id").alias("level_index"),
        F.col("id").cast("double").alias("PRES"), (F.col("id") * 2.0).alias("TEMP"))
    hits = spark.createDataFrame([("q", f"d{i}", {"PLATFORM_NUMBER": "7", "PROJECT_NAME": "p" * 20}, 0.5, 7, i, i + 1) for i in range(12)],
                                 "query_id string, id string, metadata map<string,string>, score double, platform_number long, profile_index long, hit_rank int")
    about = spark.createDataFrame([("q", 7, "P")], "query_id string, platform_number long, project_name string")
    r = context.assemble(ask, hits, rows, about, token_limit=limit).first()
    assert (r["retrieved_count"], r["numeric_rows"], r["platforms"], r["sample_rows"]) == (12, 60, 1, 60)
    assert mark in r["context"]
    if lines is not None:
        assert r["tokens"] <= max(limit, 250)


def test_run_questions(spark):
    from catalog import searching
    run = searching._run(spark, SF)
    assert run.contexts.count() == searching._questions(spark, SF).count()
    caps = run.rows.groupBy("query_id", "year", "month", "platform_number", "profile_index").count()
    assert caps.where("count > 500").count() == 0
    asked = run.rows.first()["query_id"]
    chart = visual_for(run, asked, "temperature over time")
    assert chart.kind == "chart" and chart.data.count() == min(200, run.rows.where(F.col("query_id") == asked).count())
    assert visual_for(run, -1, "temperature over time").kind == "none"


def test_region_hits_against_brute_force(spark):
    rng = random.Random(5)
    points = [(rng.choice([rng.uniform(-90, 90), 10.0, 95.0, None, float("nan"), float("inf")]),
               rng.choice([rng.uniform(-180, 180), 20.0, 500.0])) for _ in range(800)]
    boxes = [(i, (a := rng.uniform(-100, 90), a + rng.choice([0, 1, 30, 1e9]), b := rng.uniform(-200, 180), b + rng.choice([0, 1, 90, 1e9])))
             for i in range(60)] + [(60, (10.0, 10.0, 20.0, 20.0)), (61, (5.0, -5.0, 0.0, 1.0))]
    p = spark.createDataFrame(points, "LATITUDE double, LONGITUDE double")
    q = spark.createDataFrame(boxes, "query_id int, bbox struct<lat_min double, lat_max double, lon_min double, lon_max double>")
    got = {r["query_id"]: r["region_hits"] for r in region_hits(q, p).collect()}
    want = {i: sum(1 for y, x in points if y is not None and a <= y <= b and c <= x <= d) for i, (a, b, c, d) in boxes}
    assert got == want
