"""Questions behind the gate: what can be answered is answered, all of it is accounted for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilelake.operators.fetch import LIMITS
from profilelake.plans.context import KEY
from profilelake.plans.gate import gate
from profilelake.plans.retrieval import Retrieval, run_questions
from profilelake.plans.triage import analyze
from profilelake.schemas import FETCH_CAP
from profilelake.session import materialized

PROCEED = "PROCEED_RAG"


@dataclass
class Guarded:
    """``decisions``: every question as analysed, with its decision; ``run``: the job over those that proceed;
    ``audit``: one row per question."""

    decisions: DataFrame
    run: Retrieval
    audit: DataFrame


def guarded_run(questions: DataFrame, docs: DataFrame, core: DataFrame, metadata: Sequence[DataFrame], positions: DataFrame, *,
                top_k: int = 30, cap: int = FETCH_CAP, as_of: Column | None = None, doc_platform: str | None = None) -> Guarded:
    """Gate a table of questions and run the retrieval job over those that pass.

    Questions (query_id, text, embedding) may have limits of their own in the
    columns year, months, date_from and date_to. Refused questions reach
    neither the search nor the measurements; in the audit they have their
    decision and no counts.
    """
    given = [KEY, "text", "embedding", *[c for c in LIMITS if c in questions.columns]]
    questions = materialized(questions.select(*given), plain=True)
    decisions = materialized(gate(analyze(questions.select(KEY, "text"), as_of=as_of), positions, core), plain=True)
    passed = questions.join(decisions.where(F.col("decision") == PROCEED).select(KEY), KEY, "left_semi")
    run = run_questions(materialized(passed, plain=True), docs, core, metadata, top_k=top_k, cap=cap, doc_platform=doc_platform, own_windows=True)
    candidates = run.candidates.groupBy(KEY).agg(F.count(F.lit(1)).alias("candidates_count"))
    found = run.contexts.select(KEY, "retrieved_count", "numeric_rows", "juld_min", "juld_max", "tokens")
    proceeds = F.col("decision") == PROCEED
    counts = {c: F.when(proceeds, F.coalesce(c, F.lit(0).cast("bigint"))) for c in ("retrieved_count", "candidates_count", "numeric_rows")}
    audit = decisions.join(found, KEY, "left").join(candidates, KEY, "left").withColumns(counts).select(
        KEY, "intent", "decision", F.when(proceeds, "OK").otherwise("INSUFFICIENT_DATA").alias("status"), "region_hits", "platform_found",
        "sparse_variable", *counts, "juld_min", "juld_max", "tokens")
    return Guarded(decisions, run, audit)
