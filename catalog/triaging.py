"""Question and answer logs, the data gate, and contexts."""

from pyspark.sql import functions as F

from catalog.inputs import P, QS, measurements, ntz, positions, questions, table
from catalog.registry import query
from profilelake.plans import gate, triage

AS_OF = "2025-06-30"

# --- oracle pieces, written against the rules rather than the Spark code ---------

_LOW = "lower(text)"


def _has(*words):
    return "(" + " OR ".join(f"contains({_LOW}, '{w}')" for w in words) + ")"


_INTENT = f"""CASE WHEN regexp_matches({_LOW}, '\\b(compare|vs|versus)\\b') THEN 'compare'
 WHEN regexp_matches({_LOW}, '\\b(show me|plot|display|profile|time series)\\b') THEN 'measurement'
 WHEN regexp_matches({_LOW}, '\\b(nearest|closest|near this location)\\b') THEN 'nearest'
 WHEN regexp_matches({_LOW}, '\\b(float|serial|platform|float number)\\b') THEN 'float_detail'
 WHEN regexp_matches({_LOW}, '\\b(project|principal investigator|researcher)\\b') THEN 'project_info'
 WHEN regexp_matches({_LOW}, '\\b(quality flag|quality flags|profile quality)\\b') THEN 'qc_query'
 WHEN regexp_matches({_LOW}, '\\b(history|processed|adjusted)\\b') THEN 'history'
 WHEN {_has('where', 'lat', 'lon')} THEN 'nearest' WHEN {_has('temp', 'salin', 'pres', 'profile')} THEN 'measurement' ELSE 'unknown' END"""
_VARIABLES = "concat_ws(',', " + ", ".join(f"CASE WHEN {_has(*w)} THEN '{v}' END" for v, w in (
    ("CHLA", ("chl",)), ("DOXY", ("doxy", "oxygen", "o2")), ("NITRATE", ("nitrate", "no3")),
    ("PRES", ("pres", "depth", "db")), ("PSAL", ("salinity", "psal", "psu")), ("TEMP", ("temp", "°c", "deg c")))) + ")"
_BOX_RE = "(?i)lat(?:itude)?\\s*([-\\d.]+)\\s*(?:to|-)\\s*([-\\d.]+).*?lon(?:gitude)?\\s*([-\\d.]+)\\s*(?:to|-)\\s*([-\\d.]+)"
_NEAR_RE = "(?i)near\\s*([-\\d.]+)\\s*,\\s*([-\\d.]+)"


def _num(pattern, i):
    return f"try_cast(nullif(regexp_extract(text, '{pattern}', {i}), '') AS DOUBLE)"


_MONTH_RE = "(?i)(january|february|march|april|may|june|july|august|september|october|november|december)\\s+(\\d{4})"
_ISO_RE = "(\\d{4}-\\d{2}-\\d{2})\\s*(?:to|-)\\s*(\\d{4}-\\d{2}-\\d{2})"
ANALYZED = f"""{QS},
fields AS (SELECT query_id, text, {_INTENT} AS intent, {_VARIABLES} AS variables, regexp_matches(text, '{_BOX_RE}') AS boxed,
 {_num(_BOX_RE, 1)} AS a, {_num(_BOX_RE, 2)} AS b, {_num(_BOX_RE, 3)} AS c, {_num(_BOX_RE, 4)} AS e, {_num(_NEAR_RE, 1)} AS x, {_num(_NEAR_RE, 2)} AS y,
 nullif(regexp_extract(text, '{_ISO_RE}', 1), '') AS d1, nullif(regexp_extract(text, '{_ISO_RE}', 2), '') AS d2,
 strptime(nullif(regexp_extract(text, '{_MONTH_RE}', 1) || ' ' || regexp_extract(text, '{_MONTH_RE}', 2), ' '), '%B %Y') AS m1,
 try_cast(nullif(regexp_extract(text, '(?i)last\\s+(\\d+)\\s+months?', 1), '') AS INTEGER) AS n,
 try_cast(nullif(regexp_extract(text, '(?i)(?:platform|float|wmo)\\s*(?:number)?\\s*[:#]?\\s*(\\d{{4,8}})', 1), '') AS BIGINT) AS platform_number,
 try_cast(nullif(regexp_extract(text, '(?i)profile\\s*(\\d+)', 1), '') AS BIGINT) AS pr FROM qs),
an AS (SELECT query_id, text, intent, variables,
 CASE WHEN boxed THEN CASE WHEN a + b + c + e IS NOT NULL THEN least(a, b) END ELSE x - 1 END AS lat_min,
 CASE WHEN boxed THEN CASE WHEN a + b + c + e IS NOT NULL THEN greatest(a, b) END ELSE x + 1 END AS lat_max,
 CASE WHEN boxed THEN CASE WHEN a + b + c + e IS NOT NULL THEN least(c, e) END ELSE y - 1 END AS lon_min,
 CASE WHEN boxed THEN CASE WHEN a + b + c + e IS NOT NULL THEN greatest(c, e) END ELSE y + 1 END AS lon_max,
 CASE WHEN d1 IS NOT NULL THEN try_cast(d1 AS DATE) WHEN m1 IS NOT NULL THEN CAST(m1 AS DATE)
  WHEN n IS NOT NULL THEN CAST(DATE '{AS_OF}' - to_months(n) AS DATE) END AS date_from,
 CASE WHEN d1 IS NOT NULL THEN try_cast(d2 AS DATE) WHEN m1 IS NOT NULL THEN CAST(last_day(m1) AS DATE)
  WHEN n IS NOT NULL THEN DATE '{AS_OF}' END AS date_to,
 platform_number, CASE WHEN platform_number IS NULL THEN pr END AS profile_index FROM fields)"""


def _analyzed(spark, d):
    # the texts are two small files, so two tasks; the patterns are dear
    spread = questions(spark, d).repartition(spark.sparkContext.defaultParallelism)
    return triage.analyze(spread, as_of=F.lit(AS_OF).cast("date"))


@query("intent_triage", f"WITH {ANALYZED} SELECT * FROM an")
def intents(spark, d):
    a = _analyzed(spark, d)
    return a.select("query_id", "text", "intent", F.array_join("variables", ",").alias("variables"),
                    "bbox.lat_min", "bbox.lat_max", "bbox.lon_min", "bbox.lon_max",
                    "date_from", "date_to", "platform_number", "profile_index")


@query("intent_counts", f"WITH {ANALYZED} SELECT intent, count(*) AS questions FROM an GROUP BY intent")
def intent_counts(spark, d):
    return _analyzed(spark, d).groupBy("intent").agg(F.count(F.lit(1)).alias("questions"))


@query("variable_demand", f"WITH {ANALYZED} SELECT variable, count(*) AS questions FROM (SELECT unnest(string_split(variables, ',')) AS variable FROM an) WHERE variable <> '' GROUP BY variable")
def variable_demand(spark, d):
    return triage.demand(_analyzed(spark, d), "variables", "variable")


_NOWHERE = "(lat_min IS NULL AND date_from IS NULL AND coalesce(platform_number, 0) = 0)"
_MISSING = f"""SELECT query_id, concat_ws('|',
 CASE WHEN intent = 'measurement' AND variables = '' THEN 'variable (e.g., TEMP or PSAL)' END,
 CASE WHEN intent = 'measurement' AND {_NOWHERE} THEN 'spatial or temporal constraint (lat/lon or date range or platform)' END,
 CASE WHEN intent = 'compare' AND variables = '' THEN 'variables to compare (e.g., TEMP, PSAL)' END,
 CASE WHEN intent = 'compare' AND {_NOWHERE} THEN 'time range or region' END,
 CASE WHEN intent = 'nearest' AND lat_min IS NULL AND NOT contains(lower(text), 'near') THEN 'a location (lat,lon) or bounding box' END,
 CASE WHEN intent = 'float_detail' AND coalesce(platform_number, 0) = 0 THEN 'platform number or float identifier' END,
 CASE WHEN intent = 'qc_query' AND coalesce(platform_number, 0) = 0 AND lat_min IS NULL THEN 'platform number or region' END) AS missing FROM an"""


@query("missing_fields", f"WITH {ANALYZED} {_MISSING}")
def missing(spark, d):
    return _analyzed(spark, d).select("query_id", F.array_join("missing", "|").alias("missing"))


@query("missing_counts", f"WITH {ANALYZED} SELECT reason, count(*) AS questions FROM (SELECT unnest(string_split(missing, '|')) AS reason FROM ({_MISSING})) WHERE reason <> '' GROUP BY reason")
def missing_counts(spark, d):
    return triage.demand(_analyzed(spark, d), "missing", "reason")


@query("visual_intent", f"""WITH {QS} SELECT query_id, CASE
 WHEN {_has('near', 'map', 'location', 'lat', 'lon', 'equator')} THEN 'map' WHEN {_has('profile', 'depth', 'vertical', 'pres')} THEN 'profile'
 WHEN {_has('time', 'trend', 'change', 'temporal', 'date', 'juld')} THEN 'time_series'
 WHEN {_has('average', 'mean', 'min', 'max', 'median', 'count', 'how many', 'number of', 'total')} THEN 'aggregate'
 WHEN {_has('project', 'pi', 'principal', 'platform', 'list', 'show me', 'details')} THEN 'table' ELSE 'time_series' END AS visual FROM qs""")
def visual_intents(spark, d):
    return questions(spark, d).select("query_id", triage.visual_intent(F.col("text")).alias("visual"))


@query("platform_filter", f"""WITH {QS} SELECT query_id,
 try_cast(nullif(regexp_extract(text, '(?i)\\bplatform\\s*(number\\s*)?[:=]?\\s*(\\d{{3,10}})\\b', 2), '') AS BIGINT) AS platform_filter FROM qs""")
def platform_filters(spark, d):
    return questions(spark, d).select("query_id", triage.platform_filter(F.col("text")).alias("platform_filter"))


# --- answers: JSON of the event log in every wrapping ------------------------------

_ANSWER = """CASE event_id % 12
 WHEN 0 THEN 'Text {x} ===STRUCTURED_JSON_START=== {"type": "table", "headers": ["k"], "rows": [' || props || ']} ===STRUCTURED_JSON_END=== end'
 WHEN 1 THEN 'See ```json {"type": "chart", "chartType": "line", "xKey": "t", "yKey": "v", "data": [' || props || ']} ```'
 WHEN 2 THEN 'Plain {"type": "map", "points": [' || props || ']} done'
 WHEN 3 THEN '===STRUCTURED_JSON_START=== {"type": "table", ===STRUCTURED_JSON_END==='
 WHEN 4 THEN '``` {"type": "chart", "chartType": "pie", "xKey": "t", "yKey": "v", "data": []} ```'
 WHEN 5 THEN 'none at all'
 WHEN 6 THEN '{"type": "chart", "chartType": "bar", "xKey": "", "yKey": "v", "data": []}'
 WHEN 7 THEN '{"type": "text", "content": null}'
 WHEN 8 THEN '===STRUCTURED_JSON_START===[1, 2]===STRUCTURED_JSON_END==='
 WHEN 9 THEN '{"type": "multi", "visuals": ' || props || '}'
 WHEN 10 THEN props
 ELSE NULL END"""


def _answers(spark, d):
    return table(spark, d, "events").select("event_id", F.expr(_ANSWER).alias("answer"))


_ERROR = """CASE event_id % 12 WHEN 3 THEN 'marker_json_parse_error' WHEN 4 THEN 'chart_invalid_chartType' WHEN 5 THEN 'no_json_found'
 WHEN 6 THEN 'chart_missing_keys' WHEN 8 THEN 'not_object' WHEN 9 THEN 'multi_missing_visuals' WHEN 10 THEN 'unknown_type:None'
 WHEN 11 THEN 'answer_not_string' END"""


@query("answer_extract_validate", f"""SELECT event_id, {_ERROR} AS structured_error, {_ERROR} IS NULL AS structured_valid,
 CASE WHEN event_id % 12 IN (0, 1, 2) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def answers(spark, d):
    checked = triage.with_structured(_answers(spark, d))
    k = F.coalesce(*[F.try_variant_get("structured", f"$.{p}[0].k", "bigint") for p in ("rows", "data", "points")])
    return checked.select("event_id", "structured_error", "structured_valid", k.alias("k"))


@query("answer_error_counts", f"SELECT structured_error, count(*) AS answers FROM (SELECT {_ERROR} AS structured_error FROM events) GROUP BY 1")
def answer_errors(spark, d):
    return triage.with_structured(_answers(spark, d)).groupBy("structured_error").agg(F.count(F.lit(1)).alias("answers"))


@query("final_payload", """SELECT event_id, CASE WHEN event_id % 12 = 7 THEN 'text' WHEN event_id % 12 IN (0, 1, 2) THEN ['table', 'chart', 'map'][event_id % 12 + 1]
 ELSE 'fallback' END AS payload_type FROM events""")
def final(spark, d):
    checked = triage.with_structured(_answers(spark, d)).withColumn("visual_json", F.lit('{"type": "fallback"}'))
    return checked.select("event_id", F.get_json_object(triage.final_payload(), "$.type").alias("payload_type"))


# --- gate -----------------------------------------------------------------------

@query("region_hits", f"""WITH {ANALYZED}, {P} SELECT query_id, count(p.PLATFORM_NUMBER) AS region_hits
FROM (SELECT * FROM an WHERE lat_min IS NOT NULL) LEFT JOIN p ON LATITUDE BETWEEN lat_min AND lat_max AND LONGITUDE BETWEEN lon_min AND lon_max GROUP BY query_id""")
def region_hits(spark, d):
    return gate.region_hits(_analyzed(spark, d), positions(spark, d))


def _core(spark, d):
    # platforms are named by four digits in questions; most salinities are missing
    return measurements(spark, d).withColumns({
        "platform_number": F.col("platform_number") * 10 + 1000,
        "PSAL": F.when(F.col("PRES") > 45, F.col("PSAL"))})


@query("data_gate", f"""WITH {ANALYZED}, {P}, core AS (SELECT l_suppkey * 10 + 1000 AS platform_number, l_partkey AS profile_index FROM lineitem),
rate AS (SELECT 1 - avg(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS psal FROM lineitem),
h AS (SELECT query_id, count(p.PLATFORM_NUMBER) AS hits FROM (SELECT * FROM an WHERE lat_min IS NOT NULL)
 LEFT JOIN p ON LATITUDE BETWEEN lat_min AND lat_max AND LONGITUDE BETWEEN lon_min AND lon_max GROUP BY query_id)
SELECT an.query_id, intent, CASE
 WHEN intent IN ('measurement', 'compare', 'nearest', 'qc_query') AND h.hits = 0 THEN 'INSUFFICIENT_DATA_REGION'
 WHEN intent IN ('measurement', 'compare', 'nearest', 'qc_query') AND coalesce(platform_number, 0) <> 0
  AND platform_number NOT IN (SELECT platform_number FROM core) THEN 'INSUFFICIENT_DATA_PLATFORM'
 WHEN contains(variables, 'PSAL') AND (SELECT psal FROM rate) > 0.8 THEN 'INSUFFICIENT_DATA_NULLRATE_PSAL'
 ELSE 'PROCEED_RAG' END AS decision FROM an LEFT JOIN h USING (query_id)""")
def data_gate(spark, d):
    decided = gate.gate(_analyzed(spark, d), positions(spark, d), _core(spark, d))
    return ntz(decided.select("query_id", "intent", "decision"))
