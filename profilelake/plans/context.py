"""One context row per question: retrieval summary, samples and statistics as text."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilelake.functions.text import csv_line, json_safe, lookup, shorten, tokens_estimate
from profilelake.operators.ranking import ranked_top_n, salts_for, top_n_per_key
from profilelake.operators.shares import Shares
from profilelake.operators.stats import PROFILE, STAT_VARIABLES, row_budget, surface_median_deep
from profilelake.schemas import CONTEXT_TOKENS
from profilelake.session import materialized

KEY = "query_id"
TOP_HITS = 10
COMPACT_HITS = 5
METADATA_ROWS = 20
ROWS_PER_TASK = 1 << 18     # of all questions, where a task's memory grows with its rows

# Columns of a sample line and metadata of a hit line, in order.
SAMPLE_COLUMNS = ("platform_number", "profile_index", "juld", "level_index", "PRES", "TEMP", "PSAL",
                  "PRES_ADJUSTED", "TEMP_ADJUSTED", "PSAL_ADJUSTED", "PRES_QC", "TEMP_QC", "PSAL_QC")
HIT_FIELDS = ("PLATFORM_NUMBER", "PROJECT_NAME", "PI_NAME", "FLOAT_SERIAL_NO", "JULD", "LATITUDE", "LONGITUDE")


def _lines(df: DataFrame, order: Column, line: Column, out: str) -> DataFrame:
    """Array of a question's lines in order. Only for frames bounded per question."""
    gathered = df.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))).alias("_a"))
    return gathered.select(KEY, F.transform("_a", lambda x: x["l"]).alias(out))


def _hit_text(md: Column) -> Column:
    parts = [F.when(lookup(md, [f]).isNotNull(), F.concat(F.lit(f"{f}="), lookup(md, [f]))) for f in HIT_FIELDS]
    return F.concat_ws("; ", *parts)


def hit_lines(hits: DataFrame, limit: int = TOP_HITS) -> DataFrame:
    """Numbered lines of the best hits."""
    top = hits.where(F.col("hit_rank") <= limit)
    line = F.concat_ws(" ", F.concat(F.col("hit_rank").cast("string"), F.lit(".")),
                       F.concat(F.lit("id="), F.col("id").cast("string")),
                       F.concat(F.lit("score="), F.coalesce(F.round("score", 6).cast("string"), F.lit("none"))),
                       _hit_text(F.col("metadata")))
    return _lines(top, F.col("hit_rank"), line, "hit_lines")


def metadata_only_context(questions: DataFrame, hits: DataFrame, candidates: DataFrame) -> DataFrame:
    """Questions without any candidate: their ten best hits as text."""
    alone = questions.join(candidates.select(KEY).distinct(), KEY, "left_anti")
    top = hits.where(F.col("hit_rank") <= TOP_HITS).join(alone.select(KEY), KEY, "left_semi")
    line = F.concat_ws(" ", F.concat(F.lit("DOC_ID="), F.col("id").cast("string")),
                       F.concat(F.lit("SCORE="), F.round("score", 6).cast("string")),
                       F.concat(F.lit("METADATA="), F.to_json("metadata")))
    lines = _lines(top, F.col("hit_rank"), line, "_lines")
    text = F.coalesce(F.array_join("_lines", "\n"), F.lit(""))
    return alone.join(lines, KEY, "left").select(*questions.columns, text.alias("context"))


def sample_rows(rows: DataFrame, shares: Shares | None = None) -> DataFrame:
    """Surface, median and deep rows of each question's latest profiles, as many
    as its row budget has room for. Adds ``budget`` and ``profile_rank``.

    A question's latest profiles are among the latest of each of its shares, so
    the rows of these are picked once for all questions. The work is dealt over
    as many parts as the rows ask for. ``shares``: the same rows as questions share them.
    """
    if shares is None:
        return sample_of_rows(rows)
    if {"platform_number"} < set(shares.on):
        # a profile that a question takes from several shares is one profile with the rows of all
        twice = shares.asked.distinct().groupBy(KEY, "platform_number").count().where("count > 1").select(KEY).distinct()
        if not twice.isEmpty():
            alone = replace(shares, asked=shares.asked.join(twice, KEY, "left_anti"))
            return sample_of(alone).unionByName(sample_of_rows(shares.of_questions(twice).joined()))
    return sample_of(shares)


def sample_of_rows(rows: DataFrame) -> DataFrame:
    """Surface, median and deep rows of each question's latest profiles, as many
    as its row budget has room for. Adds ``budget`` and ``profile_rank``.

    The work is dealt over as many parts as the rows ask for.
    """
    counts = materialized(rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                salts_for(counts.agg(F.sum("_n")).first()[0] or 0, ROWS_PER_TASK))
    known = rows.where(F.col("platform_number").isNotNull() & F.col("profile_index").isNotNull())
    # a question's profiles meet in one task, those of a question of over ROWS_PER_TASK rows in several
    piece = F.pmod(F.xxhash64(*PROFILE), F.ceil(F.col("_n") / ROWS_PER_TASK)).alias("_piece")
    dealt = known.select(KEY, *PROFILE, "juld").join(counts, KEY).select(KEY, *PROFILE, "juld", piece).repartition(parts, KEY, "_piece")
    profiles = dealt.groupBy(KEY, "_piece", *PROFILE).agg(F.max("juld").alias("latest_juld"))
    order = [F.col("latest_juld").desc_nulls_last(), *[F.col(p) for p in PROFILE]]
    # the largest budget is 500 rows, three per profile
    most = 500 // 3
    local = ranked_top_n(profiles, [KEY, "_piece"], order, most, "profile_rank").drop("_piece", "profile_rank")
    budgets = counts.select(KEY, row_budget(F.col("_n")).alias("budget"))
    latest = ranked_top_n(local.repartition(parts, KEY), [KEY], order, most, "profile_rank").join(budgets, KEY)
    latest = latest.where(F.col("profile_rank") <= F.floor(F.col("budget") / 3)).drop("latest_juld")
    place = [KEY, *PROFILE]
    chosen = known.repartition(parts, *place).join(latest.repartition(parts, *place), place)
    return surface_median_deep(chosen, (KEY, *PROFILE))


def sample_of(shares: Shares) -> DataFrame:
    """:func:`sample_rows` of questions that take each of their profiles from one share."""
    on, most = list(shares.on), 500 // 3        # the largest budget is 500 rows, three per profile
    counts = materialized(shares.ranges(count="_n"), plain=True)
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                salts_for(counts.agg(F.sum("_n")).first()[0] or 0, ROWS_PER_TASK))
    known = shares.rows.where(F.col("platform_number").isNotNull() & F.col("profile_index").isNotNull())
    place = list(dict.fromkeys([*on, *PROFILE]))
    order = [F.col("latest_juld").desc_nulls_last(), *[F.col(p) for p in PROFILE]]
    profiles = top_n_per_key(known.groupBy(*place).agg(F.max("juld").alias("latest_juld")), on, order, most, rank="_nth").drop("_nth")
    # rows alike in value and level are told apart by all their columns, so that one of them is picked
    chosen = known.join(profiles.select(*place), place, "left_semi").repartition(parts, *place)
    ties = [f.name for f in chosen.schema.fields if f.name not in (*place, "level_index") and f.dataType.typeName() not in ("map", "variant")]
    picked = surface_median_deep(chosen, place, tie=ties)
    budgets = counts.select(KEY, row_budget(F.col("_n")).alias("budget"))
    met = shares.asked.distinct().repartition(parts, KEY).join(profiles, on)
    latest = ranked_top_n(met, [KEY], order, most, "profile_rank").join(budgets, KEY)
    latest = latest.where(F.col("profile_rank") <= F.floor(F.col("budget") / 3)).drop("latest_juld")
    return picked.join(latest, place).select(KEY, *shares.columns, "profile_rank", "budget")


def sample_lines(rows: DataFrame, shares: Shares | None = None) -> DataFrame:
    picked = sample_rows(rows, shares)
    shown = [c for c in SAMPLE_COLUMNS if c in picked.columns]
    order = F.struct("profile_rank", F.coalesce(F.col("PRES"), F.lit(0.0)), "level_index")
    header = F.lit(",".join(shown))
    lines = _lines(picked, order, csv_line(picked, shown), "_body")
    return lines.select(KEY, F.concat(F.array(header), "_body").alias("sample_lines"))


def statistics_text(shares: Shares, variables=STAT_VARIABLES) -> DataFrame:
    """JSON of the six statistics per variable (at most six small rows per question)."""
    stats = shares.statistics(variables)
    values = F.struct("count", "mean", "median", "min", "max", "std")
    return stats.groupBy(KEY).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable", values.alias("v")))))).alias("stats_json"))


def metadata_lines(metadata: DataFrame) -> DataFrame:
    """Header and up to twenty metadata rows per question (columns KEY + canonical)."""
    shown = [c for c in metadata.columns if c != KEY]
    top = ranked_top_n(metadata, [KEY], [F.col("platform_number")], METADATA_ROWS, "_r")   # one row per candidate
    lines = _lines(top, F.col("_r"), csv_line(top, shown), "_body")
    return lines.select(KEY, F.concat(F.array(F.lit(",".join(shown))), "_body").alias("metadata_lines"))


def _budget_steps(start: Column) -> Column:
    """Row budgets tried while the text is too long: halves down to two."""
    def halves(n):
        steps = []
        while n > 2:
            n = max(2, n // 2)
            steps.append(n)
        return F.array(*[F.lit(s) for s in steps])

    return F.when(start == 50, halves(50)).when(start == 200, halves(200)).otherwise(halves(500))


def assemble(questions: DataFrame, hits: DataFrame, rows: DataFrame, metadata: DataFrame, *,
             token_limit: int = CONTEXT_TOKENS, shares: Shares | None = None) -> DataFrame:
    """Context of each question (query_id, text), within the token limit.

    Too long a text first loses its metadata and shrinks its sample, then falls
    back to hit ids and statistics. Everything gathered into one text is bounded
    per question: ten hits, twenty metadata rows, at most 500 sample rows.
    ``shares``: the same rows as questions share them.
    """
    sample = sample_lines(rows, shares)
    shares = shares or Shares.of(rows, KEY)
    n_hits = hits.groupBy(KEY).agg(F.count(F.lit(1)).alias("retrieved_count"))
    ids = shares.distinct(*PROFILE).unionByName(hits.select(KEY, *PROFILE))
    distinct = ids.groupBy(KEY).agg(
        F.countDistinct("platform_number").alias("platforms"), F.countDistinct("profile_index").alias("profiles"))
    ranges = shares.ranges("juld", count="numeric_rows")
    joined = questions
    for part in (n_hits, distinct, ranges, hit_lines(hits), sample, metadata_lines(metadata), statistics_text(shares)):
        joined = joined.join(part, KEY, "left")
    for name in ("retrieved_count", "platforms", "profiles", "numeric_rows"):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))

    def block(title, body, empty="(empty)"):
        return F.concat(F.lit(title + "\n"), F.coalesce(body, F.lit(empty)))

    def joined_lines(name):
        return F.array_join(F.col(name), "\n")

    juld_type = rows.schema["juld"].dataType
    question = block("QUESTION", F.trim("text"))
    counts = F.concat_ws("\n", F.lit("SUMMARY"), *[
        F.concat(F.lit(f"{label}: "), F.col(name).cast("string"))
        for label, name in (("hits", "retrieved_count"), ("rows", "numeric_rows"))])
    coverage = F.concat_ws("\n", *[
        F.concat(F.lit(f"{label}: "), F.col(name).cast("string"))
        for label, name in (("platforms", "platforms"), ("profiles", "profiles"))],
        F.concat(F.lit("time: "), json_safe(F.col("juld_min"), juld_type), F.lit(" .. "), json_safe(F.col("juld_max"), juld_type)))
    stats = block("STATISTICS", F.col("stats_json"))
    full = F.concat_ws("\n", question, counts, coverage, block("HITS", joined_lines("hit_lines")),
                       block("METADATA", joined_lines("metadata_lines")),
                       block("SAMPLE", joined_lines("sample_lines")), stats)

    def shrunk(budget):
        kept = F.slice(F.coalesce("sample_lines", F.array().cast("array<string>")), F.lit(1), F.greatest(F.lit(10), budget))
        return F.concat_ws("\n", question, counts, block("SAMPLE (shortened)", F.array_join(kept, "\n")), stats)

    def fits(text):
        return tokens_estimate(F.length(text)) <= token_limit

    steps = _budget_steps(row_budget(F.col("numeric_rows")))
    fitting = F.filter(steps, lambda b: fits(shrunk(b)))
    short = shrunk(F.coalesce(F.get(fitting, F.lit(0)), F.lit(2)))
    compact = F.concat_ws(
        "\n", block("QUESTION", shorten(F.col("text"))), counts,
        block("HITS", F.array_join(F.slice(F.coalesce("hit_lines", F.array().cast("array<string>")), 1, COMPACT_HITS), "\n")), stats)
    out = joined.withColumns({"_full": full}).withColumn(
        "_short", F.when(~fits(F.col("_full")), short))
    context = F.when(F.col("_short").isNull(), F.col("_full")).when(fits(F.col("_short")), F.col("_short")).otherwise(compact)
    return out.withColumn("context", context).select(
        *questions.columns, "retrieved_count", "numeric_rows", "platforms", "profiles", "juld_min", "juld_max",
        F.coalesce(F.size("sample_lines") - 1, F.lit(0)).alias("sample_rows"), "stats_json", "context",
        tokens_estimate(F.length("context")).alias("tokens"))
