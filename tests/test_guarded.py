"""Region counts, windows per question and the visuals of a job, against brute force."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from profilelake.operators.fetch import fetch_in_windows, rows_of_questions, with_window
from profilelake.operators.ranking import evenly_spaced, pick_evenly_per_group
from profilelake.operators.stats import six_statistics
from profilelake.plans import context
from profilelake.plans import job_visuals as visuals_module
from profilelake.plans.gate import region_hits, summed_area
from profilelake.plans.job_visuals import job_visuals
from profilelake.plans.retrieval import Retrieval, result_rows, visual_for
from profilelake.plans.visuals import payload_json

NAN = float("nan")


def test_region_hits_on_dense_cells_and_equal_boxes(spark):
    rnd = random.Random(4)
    points = [(rnd.choice([rnd.uniform(-95, 95), rnd.randint(-90, 90)]), rnd.choice([rnd.uniform(-370, 370), rnd.randint(-180, 180)])) for _ in range(800)]
    points += [(10 + rnd.random(), 20 + rnd.random()) for _ in range(2000)] + [(10.5, 20.5)] * 500 + [(None, 1.0), (1.0, None), (NAN, 1.0), (91.0, 361.0), (-200.0, 999.0)]
    boxes = [(10.2, 10.8, 20.1, 20.9), (10.5, 10.5, 20.5, 20.5), (-90, 90, -180, 180), (-90, 90, -180, 180), (-999, 999, -9999, 9999), (5, 4, 1, 2),
             (-10, 30, 15, 15.5), (91, 95, 361, 400), (0, 1, 180, -180), (NAN, 1, 1, 2), None]
    boxes += [tuple(rnd.uniform(-100, 100) for _ in range(4)) for _ in range(30)]
    boxes = [b if b is None or b[0] > b[1] or i < 11 else (b[0], b[1], min(b[2:]), max(b[2:])) for i, b in enumerate(boxes)]
    points = [tuple(p if p is None else float(p) for p in q) for q in points]
    rows = [(i, b and tuple(map(float, b))) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "query_id bigint, bbox struct<lat_min:double,lat_max:double,lon_min:double,lon_max:double>")
    places = spark.createDataFrame(points, "LATITUDE double, LONGITUDE double").repartition(5)
    got = {r["query_id"]: r["region_hits"] for r in region_hits(df, places).collect()}
    known = [p for p in points if None not in p and p[0] == p[0]]
    want = {i: sum(b[0] <= y <= b[1] and b[2] <= x <= b[3] for y, x in known) for i, b in rows if b}
    assert got == want
    assert region_hits(df.where("bbox IS NOT NULL"), places.limit(0)).agg(F.sum("region_hits")).first()[0] == 0


def test_summed_area(spark):
    cells = spark.createDataFrame([(-91, -361, 2), (0, 0, 3), (91, 361, 5)], "_lat_cell int, _lon_cell int, _n bigint")
    sums = {(r[0], r[1]): r[2] for r in summed_area(cells).collect()}
    assert len(sums) == 183 * 723
    assert [sums[c] for c in ((-91, -361), (-91, 361), (0, -1), (0, 0), (50, 0), (91, 360), (91, 361))] == [2, 2, 2, 5, 5, 5, 10]


CORE = "year string, month string, platform_number bigint, profile_index bigint, level_index bigint, juld timestamp, PRES double, TEMP double"


@pytest.fixture(scope="module")
def core(spark):
    days = spark.range(0, 900, 1, 4).withColumn("juld", F.expr("TIMESTAMP '2024-01-01 12:00:00' + make_interval(0, 0, 0, cast(id as int))"))
    return days.select(F.date_format("juld", "yyyy").alias("year"), F.date_format("juld", "MM").alias("month"), (F.col("id") % 4).alias("platform_number"),
                       (F.col("id") % 3).alias("profile_index"), F.col("id").alias("level_index"), "juld", (F.col("id") * 7 % 500).cast("double").alias("PRES"),
                       F.col("id").cast("double").alias("TEMP")).cache()


@pytest.mark.parametrize("cap", [1, 500])
def test_windows_of_their_own(spark, core, cap):
    import datetime

    def day(y, m, d):
        return datetime.datetime(y, m, d)

    limits = [(None, None, None, None), ("2025", None, None, None), (None, ["03", " 2024_07"], None, None), (None, [], day(2024, 2, 10), day(2024, 3, 5)),
              ("2024", ["02"], day(2024, 2, 10), day(2025, 3, 5)), (None, None, day(2024, 5, 1), None), (None, None, day(2024, 5, 2), day(2024, 5, 1)),
              (None, None, day(1900, 1, 1), day(2024, 1, 20)), ("2031", ["03"], None, None), (None, ["07", "2024_07"], None, None)]
    asked = [(i, p, *x) for i, x in enumerate(limits) for p in (0, 1, 3, 77)] + [(0, None, *limits[0]), (0, 1, *limits[0])]
    df = with_window(spark.createDataFrame(asked, "query_id bigint, platform_number bigint, year string, months array<string>, date_from timestamp, date_to timestamp"))
    names = {r["query_id"]: r["window"] for r in df.collect()}
    assert len(set(names.values())) == len(limits)
    got = sorted((r["window"], r["level_index"]) for r in fetch_in_windows(core, df, cap=cap).collect())
    want, rows = [], core.collect()
    for i, (year, months, start, end) in enumerate(limits):
        groups = {}
        for r in rows:
            fits = (r["platform_number"] in (0, 1, 3) and (year is None or r["year"] == year)
                    and (not months or r["month"] in months or any(m.strip() == f"{r['year']}_{r['month']}" for m in months))
                    and (start is None or end is None or start <= r["juld"] <= end))
            if fits:
                groups.setdefault((r["year"], r["month"], r["platform_number"], r["profile_index"]), []).append(r)
        want += [(names[i], r["level_index"]) for g in groups.values() for r in sorted(g, key=lambda r: r["juld"], reverse=True)[:cap]]
    assert got == sorted(want)


def test_even_picks_per_group(spark):
    sizes = {1: 1, 2: 2, 3: 50, 4: 1000, None: 7}
    rows = [(g, x % 5, x) for g, n in sizes.items() for x in range(n)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "g bigint, v bigint, id bigint").repartition(7)
    got = {}
    for r in pick_evenly_per_group(df, ["g"], [F.col("v"), F.col("id")], 20).collect():
        assert r["row_count"] == sizes[r["g"]]
        got.setdefault(r["g"], []).append((r["ordinal"], r["v"], r["id"]))
    for g, n in sizes.items():
        ordered = sorted((x % 5, x) for x in range(n))
        assert sorted(got[g]) == [(o, *ordered[o]) for o in evenly_spaced(n, 20)]
    assert pick_evenly_per_group(df.limit(0), ["g"], [F.col("v")], 20).count() == 0


def test_job_visuals_agree_with_those_of_single_questions(spark, core):
    texts = ["temperature trend", "vertical profile of temperature", "average values", "map near the equator", "list projects", "trend of nothing", "who"]
    questions = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")
    rows = core.join(spark.createDataFrame([(q, p) for q in (0, 1, 2, 3, 6) for p in (q % 4, 1)], "query_id bigint, platform_number bigint").distinct(), "platform_number")
    about = spark.createDataFrame([(q, p, f"P{p}") for q in (0, 3, 4) for p in (3, 1, 0)], "query_id bigint, platform_number bigint, project_name string")
    places = spark.createDataFrame([("2025", i, i % 4, None if i % 5 == 0 else i / 10, float(i)) for i in range(400)],
                                   "year string, row_ordinal bigint, platform_number bigint, LATITUDE double, LONGITUDE double")
    none = spark.createDataFrame([], "query_id bigint, x int")
    contexts = questions.withColumn("tokens", F.lit(1))
    run = Retrieval(none, none, rows, about, contexts)
    got = {r["query_id"]: (r["visual_kind"], json.loads(r["visual_json"])) for r in job_visuals(run, questions, places).collect()}
    assert {q: k for q, (k, _) in got.items()} == {0: "chart", 1: "chart", 2: "table", 3: "map", 4: "table", 5: "none", 6: "chart"}
    for q, text in enumerate(texts):
        one = visual_for(run, q, text, places)
        if one.kind != "none":
            want = json.loads(payload_json(one))
            if one.kind == "map":
                assert got[q][1].pop("omitted_count") == len(want["omitted_reasons"]) == want.pop("omitted_count")
            assert got[q][1] == want
    filled = {r["query_id"]: json.loads(r["value"]) for r in result_rows(run, job_visuals(run, questions, places)).collect()}
    assert json.loads(filled[0]["visual_json"])["xKey"] == "juld" and len(filled) == len(texts)


def test_maps_meet_questions_with_the_first_places_only(spark, core, monkeypatch):
    rnd = random.Random(5)
    spots = [(rnd.choice([None, *range(300)]), rnd.randrange(3), rnd.choice([None, 1.5, NAN, 2.5]), float(rnd.randrange(5))) for _ in range(3000)]
    places = spark.createDataFrame(spots, "row_ordinal bigint, PLATFORM_NUMBER int, LATITUDE double, LONGITUDE double").repartition(3)
    wants = {q: rnd.sample([0, 1, 2, 9], rnd.randint(1, 4)) for q in range(12)}
    about = spark.createDataFrame([(q, p) for q, ps in wants.items() for p in ps + ps[:1]], "query_id bigint, platform_number bigint")
    questions = spark.createDataFrame([(q, "map near the equator") for q in wants], "query_id bigint, text string")
    met, real = [], visuals_module.top_n_per_key

    def counted(df, keys, *rest, **named):
        met.append((keys, df.count()))
        return real(df, keys, *rest, **named)

    monkeypatch.setattr(visuals_module, "top_n_per_key", counted)
    run = Retrieval(None, None, core.limit(0).withColumn("query_id", F.lit(0).cast("bigint")), about, None)
    got = {r["query_id"]: json.loads(r["visual_json"]) for r in job_visuals(run, questions, places).collect() if r["visual_kind"] == "map"}
    assert 0 < max(n for keys, n in met if keys == ["query_id"]) <= sum(len(ps) for ps in wants.values()) * 200
    assert set(got) == {q for q, ps in wants.items() if ps != [9]}
    for q, v in got.items():
        own = sorted((s for s in spots if s[1] in wants[q]), key=lambda s: (s[0] is None, s[0] or 0, s[2] is None, s[2] != s[2], s[2] or 0, s[3], s[1]))
        shown = [(s[2], s[3], str(s[1])) for s in own[:200] if s[2] is not None and s[2] == s[2]]
        assert v["row_count"] == len(own) and v["returned_count"] == len(shown) and v["omitted_count"] == len(own[:200]) - len(shown)
        assert [(p["lat"], p["lon"], p["label"]) for p in v["points"]] == shown


def test_rows_of_questions_are_dealt_over_files(spark):
    rows = spark.range(3000).select((F.col("id") % 10).alias("platform_number"), (F.col("id") % 7).alias("profile_index"), "id").union(
        spark.sql("SELECT CAST(NULL AS BIGINT), 1L, 5000L UNION ALL SELECT 3L, NULL, 5001L UNION ALL SELECT 3L, NULL, 5001L")).coalesce(1)
    pairs = [(q, p) for q in range(60) for p in {q % 10, (q + 3) % 10}] + [(q, 77) for q in (1, 500)] + [(99, p) for p in range(10)] + [(None, 1), (None, None)]
    asked = spark.createDataFrame(pairs, "query_id bigint, platform_number bigint").coalesce(1)
    got = rows_of_questions(rows, asked, ["platform_number"], per_file=700)
    want = rows.join(asked, "platform_number")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    dealt = got.groupBy("query_id", F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(sum(r["n"] for r in dealt if r["f"] == f) for f in {r["f"] for r in dealt}) <= 5 * 700      # 39,000 rows
    files = {q: sum(r["query_id"] == q for r in dealt) for q in (*range(60), 99)}
    assert all(files[q] == 1 for q in range(60)) and files[99] > 1
    assert rows_of_questions(rows, asked.limit(0), ["platform_number"]).count() == rows_of_questions(rows.limit(0), asked, ["platform_number"]).count() == 0


def test_six_statistics_sort_each_row_once_for_all_variables(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 3.0, NAN), (1, None, 6.0), (None, NAN, 2.0)], "query_id bigint, TEMP double, PSAL double")
    made = []
    monkeypatch.setattr("profilelake.operators.stats.materialized", lambda d: made.append(d) or d)
    got = {(r["query_id"], r["variable"]): tuple(r)[2:6] for r in six_statistics(df, ("TEMP", "PSAL"), ["query_id"]).collect()}
    assert got == {(1, "TEMP"): (2, 2.0, 2.0, 1.0), (1, "PSAL"): (2, 5.5, 5.5, 5.0), (None, "TEMP"): (0, None, None, None), (None, "PSAL"): (1, 2.0, 2.0, 2.0)}
    assert "Expand" not in made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert six_statistics(df.limit(0), ("TEMP", "PSAL")).count() == 0


def test_sample_rows_are_dealt_by_the_number_of_rows(spark, core, monkeypatch):
    rows = core.join(spark.createDataFrame([(q, p) for q in range(5) for p in range(4) if q % 2 or p == q], "query_id bigint, platform_number bigint"), "platform_number")
    rows = rows.unionByName(rows.where("query_id = 1").withColumns({"profile_index": F.col("level_index") + 10, "query_id": F.lit(7).cast("bigint")}))
    whole = sorted(map(str, context.sample_rows(rows).collect()))
    monkeypatch.setattr(context, "ROWS_PER_TASK", 100)
    picked = context.sample_rows(rows)
    assert sorted(map(str, picked.collect())) == whole
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    parts = -(-rows.count() // 100)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions")) and re.search(rf"RepartitionByExpression \[query_id[^]]*\], {parts}", plan)
    profiles = {}
    for r in rows.where("query_id = 7").collect():
        profiles[(r["platform_number"], r["profile_index"])] = r["juld"]
    latest = sorted(profiles, key=lambda k: (-profiles[k].timestamp(), k))[:200 // 3]
    got = {(r["platform_number"], r["profile_index"]): r["profile_rank"] for r in picked.where("query_id = 7").collect()}
    assert got == {k: i for i, k in enumerate(latest, 1)}
