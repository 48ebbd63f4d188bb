"""Questions to answer contexts, as one batch job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelake.operators.candidates import build_candidates, ranked_candidates
from profilelake.operators.fetch import LIMITS, fetch_in_windows, fetch_measurements, fetch_metadata, find_column, for_platforms, with_window
from profilelake.operators.shares import Shares
from profilelake.operators.vectors import retrieve
from profilelake.plans.context import KEY, assemble, metadata_only_context
from profilelake.plans.triage import platform_filter
from profilelake.plans.visuals import Visual, build_visual, resolve_intent
from profilelake.schemas import FETCH_CAP
from profilelake.session import materialized


@dataclass
class Retrieval:
    """``rows``: the fetched rows of every question; ``shares``: the same, each row once for all questions that take it."""

    hits: DataFrame
    candidates: DataFrame
    rows: DataFrame
    metadata: DataFrame
    contexts: DataFrame
    shares: Shares | None = None


def question_platforms(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (query_id, platform_number), serial numbers resolved."""
    own = candidates.where(F.col("platform_number").isNotNull()).select(KEY, F.col("platform_number").cast("bigint"))
    lacking = candidates.where(F.col("platform_number").isNull() & (F.col("float_serial_no") != ""))
    serials = known.select(F.col("platform_number").cast("bigint"), "float_serial_no").where(
        F.col("platform_number").isNotNull()).distinct()
    found = lacking.select(KEY, "float_serial_no").distinct().join(serials, "float_serial_no").select(KEY, "platform_number")
    return own.unionByName(found).distinct()


def run_questions(questions: DataFrame, docs: DataFrame, core: DataFrame, metadata: Sequence[DataFrame], *,
                  top_k: int = 20, months: Sequence[str] | None = None, date_from: str | None = None,
                  date_to: str | None = None, cap: int = FETCH_CAP, doc_platform: str | None = None,
                  own_windows: bool = False) -> Retrieval:
    """Search, candidates, capped fetch and context for a table of questions
    (query_id, text, embedding).

    Measurements are filtered and capped once for the platforms of all
    questions together, then written once for all questions that asked for
    them; a question's rows are joined, counted and ranked from there.
    A question that names a platform searches only that platform's documents
    (``doc_platform``: the documents' numeric platform column). With
    ``own_windows`` each question has limits of its own in the columns year,
    months, date_from and date_to, and they are joined, not filtered one by one.
    """
    queries = questions.withColumn("_platform", platform_filter(F.col("text")))
    # hits, candidates and fetched rows each feed several branches below
    hits = materialized(retrieve(docs, queries, top_k, match=(doc_platform, "_platform") if doc_platform else None))
    candidates = materialized(ranked_candidates(build_candidates(hits, [KEY]), [KEY]))
    serials = metadata[0]
    for m in metadata[1:]:
        serials = serials.unionByName(m, allowMissingColumns=True)
    wanted = materialized(question_platforms(candidates, serials), plain=True)
    platforms = wanted.select("platform_number").distinct()
    if own_windows:
        limited = with_window(questions.select(KEY, *[c for c in LIMITS if c in questions.columns]))
        asked = wanted.join(limited, KEY)
        capped = fetch_in_windows(core, asked, cap=cap).drop("rank")
        taken = materialized(asked.select(KEY, "window", "platform_number"), plain=True)
        shares = Shares(materialized(capped), taken, ("window", "platform_number"), KEY, ("window",))
    else:
        capped = fetch_measurements(core, platforms, months=months, date_from=date_from, date_to=date_to, cap=cap).drop("rank")
        shares = Shares(materialized(capped), wanted, ("platform_number",), KEY)
    rows = shares.joined()
    about = fetch_metadata(metadata, platforms).join(wanted, "platform_number")
    texts = questions.select(KEY, "text")
    full = assemble(texts.join(candidates.select(KEY).distinct(), KEY, "left_semi"), hits, rows, about, shares=shares)
    alone = metadata_only_context(texts, hits, candidates)
    contexts = full.unionByName(alone, allowMissingColumns=True)
    return Retrieval(hits, candidates, rows, about, contexts, shares)


def visual_for(run: Retrieval, query_id, text: str, positions: DataFrame | None = None) -> Visual:
    """The visual of one question of the batch, from its own rows and metadata."""
    def own(df):
        part = df.where(F.col(KEY) == query_id).drop(KEY)
        return None if part.isEmpty() else part

    if positions is not None:       # places of the question's own platforms
        asked = run.metadata.where(F.col(KEY) == query_id).select("platform_number")
        positions = for_platforms(positions, asked, find_column(positions, "platform_number"))
    return build_visual(resolve_intent(run.rows.sparkSession, text), own(run.rows), own(run.metadata), positions,
                        ties=("platform_number", "profile_index", "level_index"))


def result_rows(run: Retrieval, visuals: DataFrame | None = None) -> DataFrame:
    """One JSON document per question for the result sink, with its visual from ``visuals`` (query_id, visual_json)."""
    counts = run.candidates.groupBy(KEY).agg(F.count(F.lit(1)).alias("candidates_count"))
    joined = run.contexts.join(counts, KEY, "left").withColumn(
        "candidates_count", F.coalesce("candidates_count", F.lit(0)))
    if visuals is not None:
        joined = joined.join(visuals.select(KEY, "visual_json"), KEY, "left")
    return joined.select(KEY, F.to_json(F.struct(*joined.columns)).alias("value"))
