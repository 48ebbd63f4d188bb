"""Documents, nearest neighbours, upsert, candidates and the whole retrieval job."""

from pyspark.sql import functions as F

from catalog.inputs import DIST, M, MD, P, QS, centroids, measurements, metadata, ntz, positions, table, vector_documents
from catalog.registry import query
from catalog.triaging import ANALYZED, AS_OF
from profilelake.functions.text import row_map, row_text
from profilelake.operators import candidates, vectors
from profilelake.plans.context import KEY
from profilelake.plans.guarded import guarded_run
from profilelake.plans.job_visuals import job_visuals
from profilelake.plans.retrieval import result_rows, run_questions
from profilelake.session import materialized


@query("row_documents", """SELECT 'metadata_clean.parquet-2025-' || printf('%02d', s_nationkey % 12 + 1) || '-' || s_suppkey AS id,
 'PLATFORM_NUMBER:' || s_suppkey || ' PROJECT_NAME:' || s_name AS document, CAST(s_suppkey AS VARCHAR) AS platform, 2 AS n_keys FROM supplier
UNION ALL SELECT 'time_location.parquet-2025-' || printf('%02d', c_nationkey % 12 + 1) || '-' || c_custkey,
 'PLATFORM_NUMBER:' || c_custkey || ' JULD:' || strftime(make_timestamp(c_custkey * 3600000000), '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN c_mktsegment <> 'BUILDING' THEN ' DIRECTION:' || c_mktsegment ELSE '' END, CAST(c_custkey AS VARCHAR),
 CASE WHEN c_mktsegment <> 'BUILDING' THEN 3 ELSE 2 END FROM customer""")
def row_documents(spark, d):
    def month(key):
        return F.format_string("%02d", F.col(key) % 12 + 1).alias("month")

    year = F.lit("2025").alias("year")
    clean = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("PLATFORM_NUMBER"), F.col("s_name").alias("PROJECT_NAME"), F.lit(None).cast("string").alias("PI_NAME"),
        F.col("s_suppkey").alias("row_ordinal"), year, month("s_nationkey"))
    places = table(spark, d, "customer").select(
        F.col("c_custkey").alias("PLATFORM_NUMBER"), F.timestamp_seconds(F.col("c_custkey") * 3600).alias("JULD"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("DIRECTION"),
        F.col("c_custkey").alias("row_ordinal"), year, month("c_nationkey"))
    docs = vectors.documents(clean, places)
    return docs.select("id", "document", F.col("metadata")["PLATFORM_NUMBER"].alias("platform"), F.size("metadata").alias("n_keys"))


@query("knn_exact", f"""WITH {DIST} SELECT query_id, id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist) WHERE rank <= 20""")
def knn(spark, d):
    near = vectors.nearest_documents(vector_documents(spark, d), centroids(spark, d), 20)
    return near.withColumn("distance", F.round("distance", 6))


# the same search in many small blocks of queries and documents
@query("knn_exact_blocks", f"""WITH {DIST} SELECT query_id, id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist) WHERE rank <= 20""")
def knn_blocks(spark, d):
    near = vectors.nearest_documents(
        vector_documents(spark, d), centroids(spark, d), 20, local_queries=4, docs_per_block=200)
    return near.withColumn("distance", F.round("distance", 6))


@query("knn_filtered", f"""WITH {DIST} SELECT query_id, id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist
 WHERE label > 4 AND (query_id < 3 OR id % 10 = query_id)) WHERE rank <= 20""")
def knn_filtered(spark, d):
    docs = vector_documents(spark, d).where(
        vectors.metadata_matches(F.col("metadata"), {"PROJECT_NAME": "east"}))
    queries = centroids(spark, d).withColumn("wanted", F.when(F.col("query_id") >= 3, F.col("query_id")))
    near = vectors.nearest_documents(docs, queries, 20, match=("platform_number", "wanted"))
    return near.withColumn("distance", F.round("distance", 6))


_HITS = f"""{DIST}, near AS (SELECT *, id % 10 AS platform_number, CAST(label AS BIGINT) AS profile_index,
 row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM dist QUALIFY r <= 40),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS hit_rank FROM
 (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id, platform_number, profile_index ORDER BY distance, id) = 1))"""


@query("hit_list", f"""WITH {_HITS} SELECT query_id, id, platform_number, profile_index, round(1 / (1 + distance), 6) AS score,
 CAST(hit_rank AS INTEGER) AS hit_rank FROM hits""")
def hit_list(spark, d):
    hits = vectors.retrieve(vector_documents(spark, d), centroids(spark, d), 40)
    return hits.select("query_id", "id", "platform_number", "profile_index", F.round("score", 6).alias("score"), "hit_rank")


@query("vector_upsert", """WITH new AS (SELECT d.doc_id AS id, md5(d.text) AS document, 'labelled ' || quality AS origin FROM labels l JOIN documents d ON d.doc_id = l.doc_id
 UNION ALL SELECT 1000000000 + item_id, md5(text), 'benchmark' FROM benchmark)
SELECT * FROM new UNION ALL SELECT doc_id, md5(text), 'stored' FROM documents WHERE doc_id NOT IN (SELECT id FROM new)""")
def upsert(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("document"))
    stored = docs.select(F.col("doc_id").alias("id"), "document", F.lit("stored").alias("origin"))
    labelled = table(spark, d, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), "document", F.concat(F.lit("labelled "), F.col("quality").cast("string")).alias("origin"),
        F.lit(2).alias("version"))
    outdated = labelled.withColumns({"origin": F.lit("outdated"), "version": F.lit(1)})
    added = table(spark, d, "benchmark").select(
        (F.col("item_id") + 1_000_000_000).alias("id"), F.md5(F.col("text").cast("binary")).alias("document"),
        F.lit("benchmark").alias("origin"), F.lit(1).alias("version"))
    batch = labelled.unionByName(outdated).unionByName(added)
    return vectors.upsert(vectors.upsert(stored, batch), batch)


def _stored(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("document"), F.create_map(F.lit("lang"), "lang").alias("metadata"))


@query("store_check", "SELECT doc_id AS id, substring(text, 1, 200) AS document, lang FROM documents ORDER BY doc_id LIMIT 5")
def store_check(spark, d):
    return vectors.store_check(_stored(spark, d))[1].select("id", "document", F.col("metadata")["lang"].alias("lang"))


@query("store_count", "SELECT count(*) AS documents FROM documents")
def store_count(spark, d):
    return vectors.store_check(_stored(spark, d))[0]


# hits of every event: metadata in the even rows' spelling, text in the others'
_EVENT_DOC = """CASE event_type WHEN 'click' THEN 'platform: ' || user_id || ' cycle ' || (event_id % 7) || ' on 2024-03-05 10:11:12'
 WHEN 'view' THEN 'WMO=' || user_id || ' profile_index:' || (event_id % 5) || ' dated 2024-02-01'
 WHEN 'error' THEN 'no ids here' ELSE 'platform_number abc-' || (user_id % 4) END"""


@query("candidates", f"""WITH h AS (SELECT event_id AS id, CASE WHEN event_type = 'signup' THEN user_id END AS p, {_EVENT_DOC} AS doc,
 CASE WHEN value > 1 THEN round(1 / (1 + value), 6) END AS score, CASE WHEN event_type = 'error' AND user_id > 5 THEN 'S' || user_id % 9 END AS serial,
 event_type, event_id, user_id FROM events),
f AS (SELECT id, score, serial AS float_serial_no,
 coalesce(CAST(p AS VARCHAR), nullif(regexp_extract(doc, '(?i)\\b(?:platform(?:_)?number|platform|wmo)\\s*[:=]?\\s*([A-Za-z0-9\\-_]+)\\b', 1), '')) AS praw,
 nullif(regexp_extract(doc, '(?i)\\b(?:profile|profile_index|cycle|cycle_number)\\s*[:=]?\\s*(\\d+)\\b', 1), '') AS iraw,
 coalesce(try_cast(nullif(regexp_extract(doc, '\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}'), '') AS TIMESTAMP),
  try_cast(nullif(regexp_extract(doc, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS TIMESTAMP)) AS juld FROM h),
g AS (SELECT *, try_cast(praw AS BIGINT) AS platform_number, try_cast(iraw AS BIGINT) AS profile_index FROM f WHERE praw IS NOT NULL OR float_serial_no IS NOT NULL)
SELECT id, score, float_serial_no, praw AS platform_number_raw, platform_number, profile_index, juld FROM g
QUALIFY row_number() OVER (PARTITION BY praw, iraw ORDER BY coalesce(score, -9999) DESC, id) = 1""")
def event_candidates(spark, d):
    e = table(spark, d, "events")
    entries = F.create_map(
        F.lit("platform_Number"), F.when(F.col("event_type") == "signup", F.concat(F.col("user_id").cast("string"), F.lit(""))),
        F.lit("FLOAT_SERIAL_NO"), F.when((F.col("event_type") == "error") & (F.col("user_id") > 5),
                                         F.concat(F.lit("S"), (F.col("user_id") % 9).cast("string"))))
    hits = e.select(
        F.col("event_id").alias("id"), F.map_filter(entries, lambda k, v: v.isNotNull()).alias("metadata"),
        F.expr(_EVENT_DOC).alias("document"), F.when(F.col("value") > 1, F.round(1 / (1 + F.col("value")), 6)).alias("score"))
    found = candidates.build_candidates(hits)
    return ntz(found.select("id", "score", "float_serial_no", "platform_number_raw", "platform_number", "profile_index", "juld"))


def _questions(spark, d):
    c = centroids(spark, d)
    return c.select("query_id", "embedding", F.concat(F.lit("Show me profiles of group "), F.col("query_id").cast("string")).alias("text"))


def _run(spark, d):
    return run_questions(_questions(spark, d), vector_documents(spark, d), measurements(spark, d), [metadata(spark, d)],
                         top_k=40)


_CAPPED = f"""{M}, capped AS (SELECT * FROM m QUALIFY row_number() OVER (
 PARTITION BY year, month, platform_number, profile_index ORDER BY juld DESC, level_index, row_ordinal, PRES, TEMP, PSAL, PRES_QC, PSAL_QC) <= 500)"""


@query("retrieval_job", f"""WITH {_HITS}, {_CAPPED},
w AS (SELECT DISTINCT query_id, platform_number FROM hits),
r AS (SELECT query_id, capped.* FROM w JOIN capped USING (platform_number)),
ids AS (SELECT query_id, platform_number, profile_index FROM r UNION ALL SELECT query_id, platform_number, profile_index FROM hits)
SELECT query_id, (SELECT count(*) FROM hits h WHERE h.query_id = q.query_id) AS retrieved_count, count(*) AS numeric_rows,
 (SELECT count(DISTINCT platform_number) FROM ids WHERE ids.query_id = q.query_id) AS platforms,
 (SELECT count(DISTINCT profile_index) FROM ids WHERE ids.query_id = q.query_id) AS profiles,
 min(juld) AS juld_min, max(juld) AS juld_max FROM r q GROUP BY query_id""")
def retrieval(spark, d):
    return _run(spark, d).contexts.select(
        KEY, "retrieved_count", "numeric_rows", "platforms", "profiles", "juld_min", "juld_max")


@query("retrieval_results", f"""WITH {_HITS}, {_CAPPED} SELECT query_id,
 (SELECT count(*) FROM hits h WHERE h.query_id = w.query_id) AS candidates_count, count(*) AS numeric_rows, true AS within_limit
FROM (SELECT DISTINCT query_id, platform_number FROM hits) w JOIN capped USING (platform_number) GROUP BY query_id""")
def results(spark, d):
    value = result_rows(_run(spark, d))
    return value.select(
        KEY, F.get_json_object("value", "$.candidates_count").cast("bigint").alias("candidates_count"),
        F.get_json_object("value", "$.numeric_rows").cast("bigint").alias("numeric_rows"),
        ((F.get_json_object("value", "$.tokens").cast("bigint") <= 12000) & (F.length(F.get_json_object("value", "$.context")) > 100)).alias("within_limit"))


@query("document_maps", """SELECT o_orderkey, 'o_orderkey:' || o_orderkey || ' o_orderdate:' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
 || ' o_orderstatus:' || o_orderstatus AS document, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date_text FROM orders""")
def document_maps(spark, d):
    o = table(spark, d, "orders")
    names = ["o_orderkey", "o_orderdate", "o_orderstatus"]
    return o.select("o_orderkey", row_text(o, names).alias("document"), row_map(o, names)["o_orderdate"].alias("date_text"))


# One question per supplier, some with a region, a platform or limits of its own.
_ASKED = """CASE s_suppkey % 6
 WHEN 0 THEN 'Show me temperature profiles near ' || CAST(s_suppkey % 80 AS STRING) || ', ' || CAST(s_nationkey * 7 % 170 AS STRING)
 WHEN 1 THEN 'Compare temperature vs salinity at lat 10 to 20 lon 30 to 60'
 WHEN 2 THEN 'Show me the temperature of platform ' || CAST(1000 + s_suppkey % 20 AS STRING)
 WHEN 3 THEN 'Give float details for platform 1003'
 WHEN 4 THEN 'What is the average temperature of all floats?'
 ELSE 'Show me pressure profiles near 89.9, 179.9' END"""
_LIMITS = {
    "year": "CASE WHEN s_suppkey % 5 = 3 THEN '1996' END",
    "months": "CASE s_suppkey % 5 WHEN 1 THEN {0}('03', '1995_07') WHEN 3 THEN {0}('01', '12') WHEN 4 THEN {0}('06') END",
    "date_from": "CASE s_suppkey % 5 WHEN 2 THEN TIMESTAMP '1994-01-15' WHEN 4 THEN TIMESTAMP '1992-06-01' END",
    "date_to": "CASE s_suppkey % 5 WHEN 2 THEN TIMESTAMP '1994-03-10' WHEN 4 THEN TIMESTAMP '1998-12-31' END",
}


def _guarded(spark, d):
    centres = materialized(centroids(spark, d).withColumnRenamed("query_id", "label"), plain=True)     # so that not the questions are broadcast
    asked = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("query_id"), F.expr(_ASKED).alias("text"), (F.col("s_suppkey") % 10).cast("bigint").alias("label"),
        *[F.expr(e.format("array")).alias(c) for c, e in _LIMITS.items()]).join(centres, "label").drop("label")
    core = measurements(spark, d).withColumns({
        "platform_number": F.col("platform_number") + 1000, "PSAL": F.when(F.col("PRES") > 45, F.col("PSAL"))})
    docs = vector_documents(spark, d).withColumn(
        "metadata", F.map_concat(F.create_map(F.lit("PLATFORM"), (F.col("platform_number") + 1000).cast("string")),
                                 F.map_filter("metadata", lambda k, v: k != "Platform_Number")))
    about = metadata(spark, d).withColumn("platform_number", F.col("platform_number") + 1000)
    return guarded_run(asked, docs, core, [about], positions(spark, d), top_k=40, as_of=F.lit(AS_OF).cast("date"))


_GUARDED = ANALYZED.replace(QS, f"qs AS (SELECT CAST(s_suppkey AS BIGINT) AS query_id, {_ASKED} AS text FROM supplier)")


@query("guarded_job", f"""WITH {_GUARDED}, {P}, {_HITS.replace("id % 10 AS platform_number", "1000 + id % 10 AS platform_number")}, {M},
rate AS (SELECT 1 - avg(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS psal FROM lineitem),
b AS (SELECT query_id, count(p.PLATFORM_NUMBER) AS region_hits FROM (SELECT * FROM an WHERE lat_min IS NOT NULL AND intent IN ('measurement', 'compare', 'nearest', 'qc_query'))
 LEFT JOIN p ON LATITUDE BETWEEN lat_min AND lat_max AND LONGITUDE BETWEEN lon_min AND lon_max GROUP BY query_id),
g AS (SELECT an.query_id, intent, region_hits, CASE
 WHEN region_hits = 0 THEN 'INSUFFICIENT_DATA_REGION'
 WHEN intent IN ('measurement', 'compare', 'nearest', 'qc_query') AND coalesce(an.platform_number, 0) <> 0
  AND an.platform_number NOT IN (SELECT platform_number + 1000 FROM m) THEN 'INSUFFICIENT_DATA_PLATFORM'
 WHEN contains(variables, 'PSAL') AND (SELECT psal FROM rate) > 0.8 THEN 'INSUFFICIENT_DATA_NULLRATE_PSAL'
 ELSE 'PROCEED_RAG' END AS decision FROM an LEFT JOIN b USING (query_id)),
s AS (SELECT CAST(s_suppkey AS BIGINT) AS query_id, s_suppkey % 10 AS label, {", ".join(f"{e.format('list_value')} AS {c}" for c, e in _LIMITS.items())}
 FROM supplier SEMI JOIN (SELECT * FROM g WHERE decision = 'PROCEED_RAG') x ON x.query_id = s_suppkey),
h AS (SELECT s.query_id, hits.platform_number, hits.profile_index FROM s JOIN hits ON hits.query_id = s.label),
w AS (SELECT DISTINCT s.*, h.platform_number FROM s JOIN h USING (query_id)),
r AS (SELECT w.query_id, m.* FROM w JOIN m ON m.platform_number + 1000 = w.platform_number
 WHERE (w.year IS NULL OR m.year = w.year) AND (months IS NULL OR list_contains(months, m.month) OR list_contains(months, m.year || '_' || m.month))
  AND (date_from IS NULL OR juld BETWEEN date_from AND date_to)
 QUALIFY row_number() OVER (PARTITION BY w.query_id, m.year, m.month, m.platform_number, profile_index ORDER BY juld DESC, level_index, row_ordinal) <= 500),
n AS (SELECT query_id, count(*) AS numeric_rows, min(juld) AS juld_min, max(juld) AS juld_max FROM r GROUP BY query_id)
SELECT g.query_id, intent, decision, CASE WHEN decision = 'PROCEED_RAG' THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS status, region_hits,
 CASE WHEN decision = 'PROCEED_RAG' THEN (SELECT count(*) FROM h WHERE h.query_id = g.query_id) END AS retrieved_count,
 CASE WHEN decision = 'PROCEED_RAG' THEN coalesce(numeric_rows, 0) END AS numeric_rows, juld_min, juld_max FROM g LEFT JOIN n USING (query_id)""")
def guarded_job(spark, d):
    return ntz(_guarded(spark, d).audit.select(
        "query_id", "intent", "decision", "status", "region_hits", "retrieved_count", "numeric_rows", "juld_min", "juld_max"))


_WISHES = """CASE s_suppkey % 5 WHEN 0 THEN 'temperature trend over time' WHEN 1 THEN 'vertical temperature profile'
 WHEN 2 THEN 'average salinity' WHEN 3 THEN 'where are these floats, near the equator' ELSE 'list the projects' END"""


def _drawn(spark, d):
    """The retrieval job over one question per supplier, its questions and visuals."""
    centres = materialized(centroids(spark, d).withColumnRenamed("query_id", "label"), plain=True)     # so that not the questions are broadcast
    asked = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("query_id"), F.expr(_WISHES).alias("text"),
        (F.col("s_suppkey") % 10).cast("bigint").alias("label")).join(centres, "label").drop("label")
    run = run_questions(asked, vector_documents(spark, d), measurements(spark, d), [metadata(spark, d)], top_k=40)
    places = positions(spark, d).withColumn("PLATFORM_NUMBER", F.col("PLATFORM_NUMBER") % 10).withColumn("row_ordinal", F.col("value"))
    return run, job_visuals(run, asked, places)


_DRAWN = f"""{_HITS}, {_CAPPED}, {P}, {MD},
w AS (SELECT DISTINCT CAST(s_suppkey AS BIGINT) AS query_id, s_suppkey % 5 AS wish, platform_number FROM supplier JOIN hits ON hits.query_id = s_suppkey % 10),
r AS (SELECT w.query_id, w.wish, c.* FROM w JOIN capped c USING (platform_number)),
x AS (SELECT query_id, wish, 'chart' AS visual_kind, strftime(juld, '%Y-%m-%dT%H:%M:%S') AS text, CAST(NULL AS DOUBLE) AS first, CAST(TEMP AS DOUBLE) AS second,
  row_number() OVER (PARTITION BY query_id ORDER BY juld, platform_number, profile_index, level_index, TEMP) - 1 AS nth, count(*) OVER (PARTITION BY query_id) AS row_count FROM r WHERE wish = 0
 UNION ALL SELECT query_id, wish, 'chart', NULL, CAST(PRES AS DOUBLE), CAST(TEMP AS DOUBLE),
  row_number() OVER (PARTITION BY query_id ORDER BY PRES, platform_number, profile_index, level_index, TEMP) - 1, count(*) OVER (PARTITION BY query_id) FROM r WHERE wish = 1),
t AS (SELECT * FROM x WHERE row_count <= 200 OR nth IN (SELECT i * (x.row_count - 1) // 199 FROM range(200) s(i))),
vc AS (SELECT query_id, visual_kind, row_count, row_number() OVER (PARTITION BY query_id ORDER BY nth) - 1 AS nth, text, first, second FROM t),
va AS (SELECT query_id, 'table' AS visual_kind, CAST(1 AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS nth, CAST(NULL AS VARCHAR) AS text, CAST(count(PSAL_ADJUSTED) AS DOUBLE) AS first,
  round(avg(PSAL_ADJUSTED), 9) AS second FROM r WHERE wish = 2 GROUP BY query_id),
vf AS (SELECT query_id, count(*) OVER (PARTITION BY query_id) AS row_count, p.*, row_number() OVER (PARTITION BY query_id ORDER BY value, LATITUDE, LONGITUDE, p.PLATFORM_NUMBER) AS n
 FROM (SELECT w.* FROM w JOIN md ON md.platform_number = w.platform_number) w JOIN (SELECT * REPLACE (PLATFORM_NUMBER % 10 AS PLATFORM_NUMBER) FROM p) p ON p.PLATFORM_NUMBER = w.platform_number WHERE wish = 3),
vm AS (SELECT query_id, 'map' AS visual_kind, row_count, row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 AS nth, CAST(PLATFORM_NUMBER AS VARCHAR) AS text, LATITUDE AS first, LONGITUDE AS second
 FROM vf WHERE n <= 200 AND LATITUDE IS NOT NULL AND LONGITUDE IS NOT NULL),
vl AS (SELECT query_id, 'table' AS visual_kind, count(*) OVER (PARTITION BY query_id) AS row_count, row_number() OVER (PARTITION BY query_id ORDER BY w.platform_number) - 1 AS nth,
  project_name AS text, CAST(w.platform_number AS DOUBLE) AS first, CAST(NULL AS DOUBLE) AS second FROM w JOIN md ON md.platform_number = w.platform_number WHERE wish = 4)"""


@query("job_visuals", f"""WITH {_DRAWN} SELECT * FROM vc UNION ALL SELECT * FROM va UNION ALL SELECT * FROM vm UNION ALL SELECT * FROM vl""")
def drawn(spark, d):
    """Every point, place and line that the visuals of all questions hold, read back from their JSON."""
    v = F.try_parse_json("visual_json")
    seen = _drawn(spark, d)[1].select("query_id", "visual_kind", v.alias("v"), F.try_variant_get(v, "$.row_count", "bigint").alias("row_count"))
    cells = F.coalesce(*[F.try_variant_get("v", f"$.{name}", "array<variant>") for name in ("data", "points", "rows")])
    one = seen.select("query_id", "visual_kind", "row_count", F.try_variant_get("v", "$.xKey", "string").alias("x"), F.posexplode(cells).alias("nth", "c"))

    def text(path):
        return F.try_variant_get("c", path, "string")

    def number(path):
        return F.try_variant_get("c", path, "double")

    table_ = F.col("visual_kind") == "table"
    aggregate = F.schema_of_variant("c").isNotNull() & table_ & text("$[1]").rlike("^[0-9.]+$")
    return one.select(
        "query_id", "visual_kind", "row_count", F.col("nth").cast("bigint").alias("nth"),
        F.when(F.col("visual_kind") == "map", text("$.label")).when(table_ & ~aggregate, text("$[1]")).when(F.col("x") == "juld", text("$.juld")).alias("text"),
        F.when(F.col("visual_kind") == "map", number("$.lat")).when(table_, number("$[0]")).when(F.col("x") == "PRES", number("$.PRES")).alias("first"),
        F.when(F.col("visual_kind") == "map", number("$.lon")).when(aggregate, F.round(number("$[1]"), 9)).when(~table_, number("$.TEMP")).alias("second"))
