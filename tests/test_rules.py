"""Rules on hand-written rows: texts, times, questions, answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from profilelake.functions import text, times
from profilelake.operators.candidates import build_candidates, ranked_candidates
from profilelake.plans import triage


def one(spark, column, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("value,expected", [
    ("20250131235621", dt.datetime(2025, 1, 31, 23, 56, 21)), ("202501312356", dt.datetime(2025, 1, 31, 23, 56)),
    (" 20250131 ", dt.datetime(2025, 1, 31)), ("2025-01-31T23:56:21Z", dt.datetime(2025, 1, 31, 23, 56, 21)),
    ("2025-01-31 23:56:21+0200", dt.datetime(2025, 1, 31, 21, 56, 21)), ("", None), ("soon", None), ("20251301", None)])
def test_reference_timestamp(spark, value, expected):
    got = one(spark, lambda c: times.reference_timestamp(c).cast("timestamp_ntz"), value)
    assert got == expected


@pytest.mark.parametrize("value,units,reference,mean,expected", [
    (1.5, "days since 1950-01-01 00:00:00 UTC", None, None, "1950-01-02 12:00:00"),
    (90.0, "seconds since 2000-01-01", None, None, "2000-01-01 00:01:30"),
    (2.0, None, "2020-01-01 00:00:00", 100.0, "2020-01-03 00:00:00"),
    (1.7e9, None, "2020-01-01 00:00:00", 1.7e9, "2023-11-14 22:13:20"),
    (1.0, "hours since 1950-01-01", None, None, "1950-01-02 00:00:00"),
    (float("nan"), "days since 1950-01-01", None, None, None)])
def test_numeric_timestamp(spark, value, units, reference, mean, expected):
    df = spark.createDataFrame([(value, units, reference, mean)], "x double, u string, r string, m double")
    got = df.select(times.numeric_timestamp(F.col("x"), F.col("u"), F.col("r").cast("timestamp"), F.col("m")).cast("string")).first()[0]
    assert got == expected


def test_round_to_second_is_half_even(spark):
    rows = spark.sql("SELECT timestamp_micros(v) t FROM VALUES (500000L), (1500000L), (2500001L) AS x(v)")
    got = [r[0] for r in rows.select(F.unix_seconds(times.round_to_second(F.col("t")))).collect()]
    assert got == [0, 2, 3]


@pytest.mark.parametrize("value,expected", [("5906527", 5906527), (" 5906527.0 ", 5906527), ("12.9", 12), ("abc", None), ("", None), ("1e3", 1000)])
def test_integer(spark, value, expected):
    assert one(spark, text.integer, value) == expected


def test_text_value(spark):
    df = spark.createDataFrame([(["A", None, "\x00", " "], bytearray(b" x\x00"), None)], "a array<string>, b binary, c string")
    row = df.select(*[text.text_column(df, n).alias(n) for n in ("a", "b", "c", "absent")]).first()
    assert tuple(row) == ("A", "x", "", "")


def test_metadata_filter(spark):
    df = spark.createDataFrame([({"Platform_Number": "12.0", "project": " ABC "},), ({"platform_number": ""},), ({"other": "12"},)], "m map<string,string>")
    got = [r[0] for r in df.select(text.metadata_matches(F.col("m"), {"PLATFORM_NUMBER": 12, "PROJECT": "abc"})).collect()]
    assert got == [True, False, False]


def test_shorten(spark):
    import textwrap
    for value in ("a  b\tc", "word " * 60, "x" * 300, "ab " * 66 + "end of it"):
        assert one(spark, text.shorten, value) == textwrap.shorten(value, 200, placeholder="...")


QUESTIONS = [
    # text, intent, variables, bbox, dates, platform, visual
    ("Show me salinity profiles near the equator in March 2025", "measurement", ["PSAL"], None, ("2025-03-01", "2025-03-31"), None, "map"),
    ("Compare salinity trends in the Arabian Sea last 6 months", "compare", ["PSAL"], None, ("2024-12-30", "2025-06-30"), None, "time_series"),
    ("Compare temperature vs salinity in the Arabian Sea for the last 6 months", "compare", ["PSAL", "TEMP"], None, ("2024-12-30", "2025-06-30"), None, "time_series"),
    ("What are the nearest floats to 10.5, 75.3?", "nearest", [], None, None, None, "map"),
    ("Give float details for platform 5906527", "float_detail", [], None, None, 5906527, "map"),
    ("Give details of platform 9999999", "float_detail", [], None, None, 9999999, "map"),
    ("Summarize all available floats for January 2025", "unknown", [], None, ("2025-01-01", "2025-01-31"), None, "time_series"),
    ("Fetch all profiles", "measurement", [], None, None, None, "profile"),
    ("List all available variables", "unknown", [], None, None, None, "table"),
    ("What is the average temperature near indian region in march", "measurement", ["TEMP"], None, None, None, "map"),
    ("What is the minimum pressure recorded by floats in 2025?", "measurement", ["PRES"], None, None, None, "profile"),
    ("plot temp lat 10 to -10 and lon 80 - 70.5", "measurement", ["TEMP"], (-10, 10, 70.5, 80), None, None, "map"),
    ("near 10,20 please", "unknown", [], (9, 11, 19, 21), None, None, "map"),
    ("near 10..5,20", "unknown", [], None, None, None, "map"),
    ("Who is the PI", "unknown", [], None, None, None, "table"),
    ("", "unknown", [], None, None, None, "time_series"),
]


def test_questions(spark):
    df = spark.createDataFrame([(i, q[0]) for i, q in enumerate(QUESTIONS)], "id int, text string")
    rows = triage.analyze(df, as_of=F.lit("2025-06-30").cast("date")).withColumn(
        "visual", triage.visual_intent(F.col("text"))).orderBy("id").collect()
    for r, (question, intent, variables, box, dates, platform, visual) in zip(rows, QUESTIONS):
        assert (r["intent"], r["variables"], r["platform_number"], r["visual"]) == (intent, variables, platform, visual), question
        assert (tuple(r["bbox"]) if r["bbox"] else None) == box, question
        got = (str(r["date_from"]), str(r["date_to"])) if r["date_from"] else None
        assert got == dates, question


def test_missing_fields(spark):
    texts = ["plot something", "compare temp", "closest", "serial", "quality flag", "profile 7 temp on 2024-01-01 to 2024-02-01"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = triage.analyze(df).orderBy("id").collect()
    assert [len(r["missing"]) for r in rows] == [2, 1, 1, 1, 1, 0]
    assert rows[5]["profile_index"] == 7


def test_fix_case(spark):
    assert one(spark, lambda c: triage.intent(F.lower(c), fix_case=True), "Who is the PI") == "project_info"


def test_answers(spark):
    texts = [
        ('x ===STRUCTURED_JSON_START=== {"type":"text","content":"c"} ===STRUCTURED_JSON_END===', None),
        ('```json\n{"type":"table","headers":[],"rows":[]}\n```', None),
        ('so {"type":"table","headers":["a"]} end', "table_missing_rows"),
        ('{"type":"text"}', "text_missing_content"),
        ('{"type":"map","points":{}}', "map_missing_points"),
        ('{"type":"chart","chartType":"line","xKey":"a","yKey":"b"}', "chart_missing_data"),
        ('{"type":"pie"}', "unknown_type:pie"),
        ("} {", "no_json_found"), ("{bad}", "fallback_json_parse_error"), (None, "answer_not_string"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "id int, answer string")
    rows = triage.with_structured(df).orderBy("id").collect()
    assert [r["structured_error"] for r in rows] == [e for _, e in texts]


def test_candidates(spark):
    hits = spark.createDataFrame([
        ("a", {"PLATFORM_NUMBER": "12.0", "profile_index": "3", "JULD": "2025-01-02T03:04:05+00:00"}, "", 0.5),
        ("b", {"platform": "12"}, "cycle_number: 3 at 2024-05-06", 0.9),
        ("c", {}, "wmo = X-7 and profile 4", None),
        ("d", {"FLOAT_SERIAL_NO": "S1"}, "nothing", 0.1),
        ("e", {"juld": "2025-01-01"}, "nothing", 0.8),
        ("f", {"wmo_inst_type": "846"}, "", 0.7),
    ], "id string, metadata map<string,string>, document string, score double").withColumn("query_id", F.lit(1))
    rows = ranked_candidates(build_candidates(hits, ["query_id"]), ["query_id"]).orderBy("candidate_rank").collect()
    # (12, 3) is named twice, the better hit stays; e and f name neither platform nor serial
    assert [r["id"] for r in rows] == ["b", "d", "c"]
    assert (rows[0]["platform_number"], rows[0]["profile_index"]) == (12, 3)
    assert (rows[2]["platform_number"], rows[2]["platform_number_raw"], rows[2]["profile_index"]) == (None, "X-7", 4)
