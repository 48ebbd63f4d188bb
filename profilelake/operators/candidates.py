"""Platform/profile candidates named by retrieved documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilelake.functions.text import integer, lookup, matched
from profilelake.functions.times import generic_timestamp
from profilelake.operators.ranking import first_per_key

# Metadata keys, best first (any case).
PLATFORM_KEYS = ("PLATFORM_NUMBER", "platform", "WMO")
SERIAL_KEYS = ("FLOAT_SERIAL_NO", "float_serial", "serial_no")
PROFILE_KEYS = ("PROFILE_INDEX", "profile", "cycle_number")
TIME_KEYS = ("JULD", "JULD_LOCATION", "REFERENCE_DATE_TIME")

# Patterns read from the document text.
PLATFORM_TEXT = r"(?i)\b(?:platform(?:_)?number|platform|wmo)\s*[:=]?\s*([A-Za-z0-9\-\_]+)\b"
PROFILE_TEXT = r"(?i)\b(?:profile|profile_index|cycle|cycle_number)\s*[:=]?\s*(\d+)\b"
TIME_TEXT = r"(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2})?)"
DATE_TEXT = r"(\d{4}-\d{2}-\d{2})"

NO_SCORE = -9999.0


def build_candidates(hits: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Resolve every hit (id, metadata, document, score) to a candidate; drop
    those naming neither platform nor serial; keep the best per (platform,
    profile) and rank them by score, then time.

    ``groups`` are the columns naming the question in a batch.
    """
    md, doc = F.col("metadata"), F.coalesce(F.col("document"), F.lit(""))
    raw = lookup(md, PLATFORM_KEYS)
    from_text = F.when(F.coalesce(raw, F.lit("")) == "", matched(doc, PLATFORM_TEXT, 1))
    platform_raw = F.coalesce(from_text, raw)
    profile_raw = lookup(md, PROFILE_KEYS)
    profile_text = F.when(integer(profile_raw).isNull(), matched(doc, PROFILE_TEXT, 1))
    time_text = F.coalesce(matched(doc, TIME_TEXT, 1), matched(doc, DATE_TEXT, 1))
    found = hits.select(
        *groups,
        integer(platform_raw).alias("platform_number"), platform_raw.alias("platform_number_raw"),
        lookup(md, SERIAL_KEYS).alias("float_serial_no"),
        integer(F.coalesce(profile_text, profile_raw)).alias("profile_index"),
        F.coalesce(profile_text, profile_raw).alias("profile_index_raw"),
        F.coalesce(generic_timestamp(lookup(md, TIME_KEYS)), generic_timestamp(time_text)).alias("juld"),
        "metadata", "document", "id", "score")
    named = found.where(
        F.col("platform_number").isNotNull()
        | (F.coalesce("float_serial_no", F.lit("")) != "")
        | (F.coalesce("platform_number_raw", F.lit("")) != ""))
    keyed = named.withColumns({
        "_platform": F.coalesce(F.col("platform_number").cast("string"), "platform_number_raw"),
        "_profile": F.coalesce(F.col("profile_index").cast("string"), "profile_index_raw")})
    best = first_per_key(keyed, [*groups, "_platform", "_profile"],
                         [-F.coalesce(F.col("score"), F.lit(NO_SCORE)), F.col("id")]).drop("_platform", "_profile")
    return best


def ranked_candidates(candidates: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add ``candidate_rank``: score first, missing last, then time, missing
    first. A question has at most top_k candidates, so its window is small."""
    # a score of zero sorts with the missing ones
    known = F.when(F.col("score") != 0, F.col("score"))
    w = Window.partitionBy(*groups).orderBy(
        known.desc_nulls_last(), F.col("juld").asc_nulls_first(), F.col("id"))
    return candidates.withColumn("candidate_rank", F.row_number().over(w))
