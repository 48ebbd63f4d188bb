"""Rows that questions share: nothing is written for each question, results as from the questions' own rows."""

import json
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from profilelake.operators import shares as shares_module
from profilelake.operators.ranking import evenly_spaced
from profilelake.operators.shares import Shares
from profilelake.operators.stats import six_statistics
from profilelake.plans import context
from profilelake.plans.job_visuals import job_visuals
from profilelake.plans.retrieval import run_questions, visual_for
from profilelake.plans.visuals import payload_json
from profilelake.session import materialized, shared_dir

NAN = float("nan")


def _steps(spark):
    return set(Path(shared_dir(spark).removeprefix("file:")).glob("step-*"))


@pytest.fixture(scope="module")
def measured(spark):
    rnd = random.Random(8)
    rows = [(p, i % 9, i, rnd.choice([None, NAN, 1.0, 2.5, rnd.random() * 90, float("inf")]), rnd.choice([None, float(p)]), float(rnd.randrange(40))) for p in range(6) for i in range(150 + 40 * p)]
    df = spark.createDataFrame(rows, "platform_number bigint, profile_index bigint, level_index bigint, TEMP double, PSAL double, PRES double").repartition(3)
    return df.withColumn("juld", F.timestamp_seconds(F.col("level_index") * 3600 + F.col("platform_number")))


@pytest.fixture(scope="module")
def asked(spark):
    pairs = [(q, p) for q in range(12) for p in random.Random(q).sample(range(7), 1 + q % 5)] + [(3, 4), (3, 4), (20, 99), (None, 1), (21, None)]
    return spark.createDataFrame(pairs, "query_id bigint, platform_number bigint")


def test_a_job_writes_no_rows_for_each_question(spark):
    core = spark.range(900).select(F.lit("2024").alias("year"), F.lit("01").alias("month"), (F.col("id") % 4).alias("platform_number"), (F.col("id") % 12).alias("profile_index"),
                                   F.col("id").alias("level_index"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("juld"),
                                   (F.col("id") * 7 % 500).cast("double").alias("PRES"), F.col("id").cast("double").alias("TEMP"))
    docs = spark.range(4).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"), F.lit("text").alias("document"),
                                 F.create_map(F.lit("PLATFORM_NUMBER"), F.col("id").cast("string")).alias("metadata"))
    about = spark.range(4).select(F.col("id").alias("platform_number"), F.lit("P").alias("project_name"), F.lit("I").alias("pi_name"), F.lit("S").alias("float_serial_no"))
    texts = ["temperature trend", "vertical profile of temperature", "average values", "list projects"]
    questions = spark.createDataFrame([(q, texts[q % 4], [0.1, 0.2]) for q in range(60)], "query_id bigint, text string, embedding array<double>")
    before = _steps(spark)
    run = run_questions(questions, docs, core, [about], top_k=4)
    got = {r["query_id"]: json.loads(r["visual_json"]) for r in job_visuals(run, questions).collect()}
    assert run.rows.count() == 60 * 900
    written = {d.name: sum(pq.ParquetFile(f).metadata.num_rows for f in d.glob("*.parquet")) for d in _steps(spark) - before}
    assert max(written.values()) <= 900 * 4
    assert int(str(run.shares.asked._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 60 * 4 * 16
    for q in range(3):
        assert got[q] == json.loads(payload_json(visual_for(run, q, texts[q])))
    assert run.contexts.select("numeric_rows").distinct().collect() == [(900,)]


@pytest.mark.parametrize("blocks", [1 << 16, 16])
def test_even_picks_of_shares(spark, measured, asked, monkeypatch, blocks):
    monkeypatch.setattr(shares_module, "SORTED_BLOCKS", blocks)
    monkeypatch.setattr(shares_module, "PER_TASK", 500)
    shares = Shares(measured, asked, ("platform_number",))
    names = ["PRES", "platform_number", "level_index"]
    got = {}
    for r in shares.evenly([F.col(c) for c in names], names, 20).collect():
        got.setdefault(r["query_id"], []).append((r["ordinal"], *[r[c] for c in names]))
    own = {}
    for r in shares.joined().where("query_id IS NOT NULL").collect():
        own.setdefault(r["query_id"], []).append(tuple(r[c] for c in names))
    assert set(got) == set(own) and len(own) > 9
    for q, rows in own.items():
        assert sorted(got[q]) == [(o, *sorted(rows)[o]) for o in evenly_spaced(len(rows), 20)]


def test_statistics_of_shares(spark, measured, asked):
    shares = Shares(measured, asked, ("platform_number",))
    variables = ("TEMP", "PSAL", "PRES", "DOXY")
    finite = measured.withColumn("TEMP", F.when(F.col("TEMP") < 1e9, F.col("TEMP")))
    for rows, names in ((finite, variables), (measured, ("PRES",))):
        shares = Shares(rows, asked, ("platform_number",))
        want = six_statistics(shares.joined().where("query_id IS NOT NULL"), names, ["query_id"])
        got = shares.statistics(names)
        assert got.columns == want.columns
        rounded = [F.round(c, 5).alias(c) if c in ("mean", "std", "median") else F.col(c) for c in want.columns]
        assert sorted(map(str, got.select(*rounded).collect())) == sorted(map(str, want.select(*rounded).collect()))
    middle = {(r["query_id"], r["variable"]): r["median"] for r in Shares(measured, asked, ("platform_number",)).statistics(("TEMP",)).collect()}
    for r in six_statistics(Shares(measured, asked, ("platform_number",)).joined().where("query_id IS NOT NULL"), ("TEMP",), ["query_id"]).collect():
        assert str(middle[(r["query_id"], r["variable"])]) == str(r["median"])
    assert Shares(measured.limit(0), asked, ("platform_number",)).statistics(variables).count() == 0
    assert Shares(measured, asked.limit(0), ("platform_number",)).statistics(variables).count() == 0


def test_samples_of_shares_are_those_of_the_rows(spark, measured):
    windowed = measured.crossJoin(spark.createDataFrame([("a", 0), ("b", 60), ("c", 1 << 20)], "window string, _from int")).where("level_index >= _from").drop("_from")
    pairs = [(1, "a", 0), (1, "a", 2), (2, "b", 0), (2, "a", 3), (3, "a", 1), (3, "b", 1), (3, "b", 2), (4, "c", 1), (5, "a", 5), (5, "a", 5)]
    asked = spark.createDataFrame(pairs, "query_id bigint, window string, platform_number bigint")
    shares = Shares(windowed, asked, ("window", "platform_number"), hidden=("window",))
    rows = shares.joined()
    got, want = context.sample_rows(rows, shares), context.sample_rows(rows)
    assert "window" not in got.columns
    # a sample row that is taken twice shows once
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))
    assert {r["query_id"] for r in got.collect()} == {1, 2, 3, 5}


def test_the_planner_sees_the_size_of_tables_with_rows_for_each_question(spark):
    keys = spark.range(0, 300_000, 1, 2).select((F.col("id") % 7).alias("query_id"), F.lit(3).cast("bigint").alias("platform_number"))

    def size(df):
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    assert size(materialized(keys)) < 1e6 and size(materialized(keys, plain=True)) > 300_000 * 16
    assert materialized(keys, plain=True).groupBy("query_id").count().count() == 7
