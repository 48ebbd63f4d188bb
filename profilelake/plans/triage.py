"""Rules over logs of questions and answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilelake.functions.text import contains_any, matched

# Variable -> words that ask for it (substrings of the lower-cased text).
VARIABLE_WORDS = {
    "TEMP": ("temp", "temperature", "°c", "deg c"),
    "PSAL": ("salinity", "psal", "psu"),
    "PRES": ("pressure", "pres", "depth", "db", "dbar"),
    "DOXY": ("doxy", "oxygen", "o2"),
    "CHLA": ("chl", "chla", "chlorophyll"),
    "NITRATE": ("nitrate", "no3"),
}

# Intent -> whole words or phrases, tried in this order on the lower-cased text.
INTENT_PHRASES = {
    "compare": ("compare", "vs", "versus"),
    "measurement": ("show me", "plot", "display", "profile", "time series"),
    "nearest": ("nearest", "closest", "near this location"),
    "float_detail": ("float", "serial", "platform", "float number"),
    "project_info": ("project", "PI", "principal investigator", "researcher"),
    "qc_query": ("QC", "quality flag", "quality flags", "profile quality"),
    "history": ("history", "processed", "adjusted"),
}
NEAREST_WORDS = ("where", "lat", "lon", "nearest")
MEASUREMENT_WORDS = ("temp", "salin", "pres", "profile")

# Patterns of the fields.
BOX_PATTERN = (r"(?i)lat(?:itude)?\s*([-\d\.]+)\s*(?:to|-)\s*([-\d\.]+)"
               r".*?lon(?:gitude)?\s*([-\d\.]+)\s*(?:to|-)\s*([-\d\.]+)")
NEAR_PATTERN = r"(?i)near\s*([-\d\.]+)\s*,\s*([-\d\.]+)"
DATES_PATTERN = r"(\d{4}-\d{2}-\d{2})\s*(?:to|-)\s*(\d{4}-\d{2}-\d{2})"
MONTHS = ("january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december")
MONTH_PATTERN = rf"(?i)({'|'.join(MONTHS)})\s+(\d{{4}})"
LAST_MONTHS_PATTERN = r"(?i)last\s+(\d+)\s+months?"
PLATFORM_PATTERN = r"(?i)(?:platform|float|wmo)\s*(?:number)?\s*[:#]?\s*(\d{4,8})"
PROFILE_PATTERN = r"(?i)profile\s*(\d+)"
PLATFORM_FILTER_PATTERN = r"(?i)\bplatform\s*(number\s*)?[:=]?\s*(\d{3,10})\b"

# Visual -> words, tried in this order.
VISUAL_WORDS = {
    "map": ("near", "nearest", "map", "location", "lat", "lon", "latitude", "longitude", "equator", "nearby"),
    "profile": ("profile", "depth", "vertical", "pres", "pressure"),
    "time_series": ("time", "trend", "over time", "change", "temporal", "date", "juld", "time series", "timeseries"),
    "aggregate": ("average", "mean", "min", "max", "median", "count", "how many", "number of", "total"),
    "table": ("project", "pi", "principal", "platform", "list", "show me", "details"),
}


def intent(low: Column, *, fix_case: bool = False) -> Column:
    """First intent with a phrase in the lower-cased text, then two word rules, else unknown.

    Two phrases hold capitals and so never match; ``fix_case`` lower-cases them.
    A plain substring test comes first: few texts then need the dearer search
    for word boundaries.
    """
    result = None
    for name, phrases in INTENT_PHRASES.items():
        known = [p.lower() if fix_case else p for p in phrases]
        hit = contains_any(low, known) & low.rlike(rf"(?U)\b(?:{'|'.join(known)})\b")
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return (
        result.when(contains_any(low, NEAREST_WORDS), "nearest")
        .when(contains_any(low, MEASUREMENT_WORDS), "measurement")
        .otherwise("unknown")
    )


def variables(low: Column) -> Column:
    """Sorted names of the variables mentioned in the lower-cased text."""
    return F.array_compact(F.array(*[
        F.when(contains_any(low, VARIABLE_WORDS[name]), F.lit(name)) for name in sorted(VARIABLE_WORDS)
    ]))


def _groups(df: DataFrame, text: str, pattern: str, names: dict[str, int], dtype: str,
            word: str | None = None) -> DataFrame:
    """Typed groups of a pattern. The match is cut out in a step of its own, so
    that the text is searched once and groups are read from a short string; a
    text without ``word``, which every match holds, is not searched at all."""
    match = F.regexp_substr(F.col(text), F.lit(pattern))
    found = df.withColumn("_found", F.when(F.col("_low").contains(word), match) if word else match)
    parts = {n: matched(F.col("_found"), pattern, i).try_cast(dtype) for n, i in names.items()}
    return found.withColumns(parts)


def with_bounding_box(df: DataFrame, text: str) -> DataFrame:
    """Add ``bbox`` (reads ``_low``, the lower-cased text): "lat a to b ... lon c to d", or one degree around "near x, y"; else null."""
    df = _groups(df, text, BOX_PATTERN, {"_a": 1, "_b": 2, "_c": 3, "_d": 4}, "double", "lat").withColumnRenamed("_found", "_boxed")
    df = _groups(df, text, NEAR_PATTERN, {"_x": 1, "_y": 2}, "double", "near").drop("_found")
    a, b, c, d, x, y = (F.col(n) for n in ("_a", "_b", "_c", "_d", "_x", "_y"))

    def box(lat_min, lat_max, lon_min, lon_max):
        return F.struct(lat_min.alias("lat_min"), lat_max.alias("lat_max"),
                        lon_min.alias("lon_min"), lon_max.alias("lon_max"))

    whole = a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    bbox = (
        F.when(whole, box(F.least(a, b), F.greatest(a, b), F.least(c, d), F.greatest(c, d)))
        .when(F.col("_boxed").isNotNull(), F.lit(None))
        .when(x.isNotNull() & y.isNotNull(), box(x - 1, x + 1, y - 1, y + 1))
    )
    return df.withColumn("bbox", bbox).drop("_a", "_b", "_c", "_d", "_x", "_y", "_boxed")


def with_date_range(df: DataFrame, text: str, as_of: Column) -> DataFrame:
    """Add ``date_from``, ``date_to`` and ``date_given`` of an ISO pair, a named month, or "last n
    months" before ``as_of``."""
    df = _groups(df, text, DATES_PATTERN, {"_from": 1, "_to": 2}, "date").withColumnRenamed("_found", "_iso")
    df = _groups(df, text, MONTH_PATTERN, {"_month": 1, "_year": 2}, "string").drop("_found")
    last = F.when(F.col("_low").contains("last"), matched(F.col(text), LAST_MONTHS_PATTERN, 1))
    df = df.withColumn("_n", last.try_cast("int"))
    number_of = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower("_month"))
    first = F.concat_ws("-", "_year", F.lpad(number_of.cast("string"), 2, "0"), F.lit("01")).try_cast("date")
    df = df.withColumn("_first", F.when(F.col("_month").isNotNull(), first))
    iso, named, n = F.col("_iso").isNotNull(), F.col("_month").isNotNull(), F.col("_n")
    return df.withColumns({
        "date_from": F.when(iso, F.col("_from")).when(named, F.col("_first")).when(n.isNotNull(), F.add_months(as_of, -n)),
        "date_given": iso | named | n.isNotNull(),
        "date_to": F.when(iso, F.col("_to")).when(named, F.last_day("_first")).when(n.isNotNull(), as_of),
    }).drop("_from", "_to", "_iso", "_month", "_year", "_n", "_first")


def platform_number(text: Column) -> Column:
    return matched(text, PLATFORM_PATTERN, 1).try_cast("bigint")


def platform_filter(text: Column) -> Column:
    """Platform number that restricts the search itself."""
    return matched(text, PLATFORM_FILTER_PATTERN, 2).try_cast("bigint")


def missing_fields(low: Column) -> Column:
    """Texts naming what the question lacks; reads the columns of :func:`analyze`."""
    no_vars = F.size("variables") == 0
    no_box = F.col("bbox").isNull()
    no_dates = ~F.col("date_given")
    no_platform = F.coalesce(F.col("platform_number"), F.lit(0)) == 0
    nowhere = no_box & no_dates & no_platform
    kind = F.col("intent")

    def reason(intent_name, condition, message):
        return F.when((kind == intent_name) & condition, F.lit(message))

    return F.array_compact(F.array(
        reason("measurement", no_vars, "variable (e.g., TEMP or PSAL)"),
        reason("measurement", nowhere, "spatial or temporal constraint (lat/lon or date range or platform)"),
        reason("compare", no_vars, "variables to compare (e.g., TEMP, PSAL)"),
        reason("compare", nowhere, "time range or region"),
        reason("nearest", no_box & ~low.contains("near"), "a location (lat,lon) or bounding box"),
        reason("float_detail", no_platform, "platform number or float identifier"),
        reason("qc_query", no_platform & no_box, "platform number or region"),
    ))


def analyze(questions: DataFrame, text: str = "text", *, as_of: Column | None = None,
            fix_case: bool = False) -> DataFrame:
    """Question log with intent, variables, box, dates, ids and missing fields.

    Built in steps: a step read more than once stays a projection of its own,
    so no pattern runs twice over a text.
    """
    low = F.col("_low")
    df = questions.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_low", F.lower("_text"))
    df = with_date_range(with_bounding_box(df, "_text"), "_text", F.current_date() if as_of is None else as_of)
    t = F.col("_text")
    df = df.withColumns({"intent": intent(low, fix_case=fix_case), "variables": variables(low),
                         "platform_number": platform_number(t), "platform_filter": platform_filter(t)})
    df = df.withColumn("profile_index", F.when(
        F.col("platform_number").isNull(), matched(t, PROFILE_PATTERN, 1).try_cast("bigint")))
    return df.withColumn("missing", missing_fields(low)).drop("_text", "_low", "date_given")


def demand(analyzed: DataFrame, column: str, name: str) -> DataFrame:
    """How many questions hold each element of an array column."""
    # the outer form keeps the optimizer from testing the array in a filter first
    elements = analyzed.select(F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())
    return elements.groupBy(name).agg(F.count(F.lit(1)).alias("questions"))


def visual_intent(text: Column) -> Column:
    """Kind of visual asked for, by the first word group that occurs."""
    low, result = F.lower(text), None
    for name, words in VISUAL_WORDS.items():
        hit = contains_any(low, words)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise("time_series")


# --- structured answers ------------------------------------------------------

# Markers around the structured block of an answer.
START_MARK = "===STRUCTURED_JSON_START==="
END_MARK = "===STRUCTURED_JSON_END==="
FENCE_PATTERN = r"(?is)```(?:json)?\s*(\{.*\})\s*```"


def extract_structured(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Add ``structured`` (VARIANT) and ``extract_error``: marker block, else
    fenced block, else outermost braces."""
    t = F.col(text)
    after = F.substring(t, F.instr(t, START_MARK) + len(START_MARK), F.length(t))
    marked = F.when(t.contains(START_MARK) & t.contains(END_MARK), F.substring_index(after, END_MARK, 1))
    fenced = matched(t, FENCE_PATTERN, 1)
    first = F.instr(t, "{")
    last = F.length(t) - F.instr(F.reverse(t), "}") + 1
    braces = F.when((first > 0) & t.contains("}") & (last > first), F.substring(t, first, last - first + 1))
    source = (
        F.when(marked.isNotNull(), "marker").when(fenced.isNotNull(), "fenced").when(braces.isNotNull(), "fallback")
    )
    body = F.when(F.col("_source") == "marker", marked).when(F.col("_source") == "fenced", fenced).otherwise(braces)
    parsed = answers.withColumn("_source", source).withColumn("structured", F.try_parse_json(body))
    error = (
        F.when(t.isNull(), "answer_not_string")
        .when(F.col("_source").isNull(), "no_json_found")
        .when(F.col("structured").isNull(), F.concat(F.col("_source"), F.lit("_json_parse_error")))
    )
    return parsed.withColumn("extract_error", error).drop("_source")


def validate_structured(payload: Column) -> Column:
    """Null for a payload a viewer can show, else the reason code."""
    def field(name, dtype):
        return F.try_variant_get(payload, f"$.{name}", dtype)

    def no_list(name):
        return field(name, "array<variant>").isNull()

    def falsy(name):
        """Missing, null, zero, false or empty; the texts "0" and "false" are names like others."""
        kind_of = F.schema_of_variant(field(name, "variant"))
        empty = (F.when(kind_of == "STRING", field(name, "string") == "").when(kind_of == "BOOLEAN", field(name, "string") == "false")
                 .when(kind_of.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), field(name, "double") == 0)
                 .otherwise(kind_of.isin("VOID", "OBJECT<>", "ARRAY<>")))
        return F.coalesce(empty, F.lit(True))

    obj = F.try_variant_get(payload, "$", "map<string,variant>")
    kind = field("type", "string")

    def rule(type_name, condition, code):
        return F.when((kind == type_name) & condition, F.lit(code))

    known = kind.isin("table", "chart", "map", "text", "multi")
    return F.when(obj.isNull(), F.lit("not_object")).otherwise(F.coalesce(
        rule("table", no_list("headers"), "table_missing_headers"),
        rule("table", no_list("rows"), "table_missing_rows"),
        rule("chart", ~F.coalesce(field("chartType", "string").isin("line", "bar", "area"), F.lit(False)),
             "chart_invalid_chartType"),
        rule("chart", falsy("xKey") | falsy("yKey"), "chart_missing_keys"),
        rule("chart", no_list("data"), "chart_missing_data"),
        rule("map", no_list("points"), "map_missing_points"),
        rule("text", ~F.map_contains_key(obj, "content"), "text_missing_content"),
        rule("multi", no_list("visuals"), "multi_missing_visuals"),
        F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown_type:"), F.coalesce(kind, F.lit("None")))),
    ))


def with_structured(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Extraction and validation: ``structured``, ``structured_valid``, ``structured_error``."""
    out = extract_structured(answers, text)
    reason = F.when(F.col("extract_error").isNull(), validate_structured(F.col("structured")))
    error = F.coalesce("extract_error", reason)
    return out.withColumn("structured_error", error).withColumn("structured_valid", error.isNull()).drop("extract_error")


def final_payload(structured: str = "structured", valid: str = "structured_valid", visual: str = "visual_json") -> Column:
    """JSON of the answer's own block when valid, else of the computed visual."""
    return F.when(F.col(valid), F.to_json(F.col(structured))).otherwise(
        F.coalesce(F.col(visual), F.lit('{"type":"text","content":"INSUFFICIENT_CONTEXT"}')))
