"""Mixing sources to target weights along a training run, by a time-varying curriculum.

Each source has a weight schedule over the run, time 0 to 1. Its integral is the
cumulative demand of tokens from that source; inverting it turns a place in the
source's token stream into a training position, and the mix is range-sorted by
that position. All of it is column expressions; no source is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilelake.llm.common import BLANKS
from profilelake.session import materialized

WEIGHTS = (1, 2, 3)         # by code point of the source name, repeating
MOST_PASSES = 3             # a document's words at most so often
ROWS_PER_RUN = 100_000      # rows of one source that one ordered run may hold
LEVEL = ((0.0, 1.0), (1.0, 1.0))    # a schedule that never changes
RISING = ((0.0, 0.5), (1.0, 1.5))
FALLING = ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))
#: Schedules by code point of the source name, repeating. Each integrates to 1, so that weights mean the same.
CURRICULUM = (FALLING, LEVEL, RISING)

PLAN = ("doc_id", "source", "size", "source_size", "target", "taken", "position")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{BLANKS}]+")).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Rank, weight and target of every row (source, source_size).

    Targets share the sum of all sizes by weight. A source stops at ``most``
    times its size, and what it cannot give is shared again by weight among the
    others until none is above. In closed form: with sources ordered by
    size per weight, those before the first one whose share is not above its
    limit are limited, and the rest shares what they leave. One row per source.
    """
    from pyspark.sql import Window

    one = Window.partitionBy("g")       # a row per source, never per document
    by_name = one.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    by_ratio = one.orderBy("ratio", F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("g", F.lit(0)).withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * float(most)
    ranked = ranked.withColumn("ratio", limit / F.col("weight"))
    before = {"limit_before": F.coalesce(F.sum(limit).over(by_ratio), F.lit(0.0)),
              "weight_before": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))}
    ranked = ranked.withColumns(before | {"total": F.sum(F.col("source_size").cast("double")).over(one),
                                          "weights": F.sum("weight").over(one)})
    # The share per unit of weight if exactly the sources before this one are limited.
    ranked = ranked.withColumn("unit", (F.col("total") - F.col("limit_before")) / (F.col("weights") - F.col("weight_before")))
    # the first such source; of equal ratios the one with fewest before it, whose unit is largest
    free = F.min(F.when(F.col("ratio") >= F.col("unit"), F.struct(F.col("ratio"), (-F.col("unit")).alias("less")))).over(one)
    ranked = ranked.withColumn("level", -free["less"])
    target = F.when(F.col("ratio") < F.col("level"), limit).otherwise(F.col("weight") * F.col("level"))
    return ranked.select(*sizes.columns, "rank", "weight", F.coalesce(F.least(target, limit), limit).alias("target"))


def training_position(share: Column, schedule) -> Column:
    """The time at which a piecewise linear schedule has asked for ``share`` (0 to 1) of its tokens."""
    knots = sorted((float(t), float(w)) for t, w in schedule)
    if len(knots) < 2 or knots[0][0] != 0.0 or knots[-1][0] != 1.0 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule runs from time 0 to 1 with weights of at least 0")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total = sum(areas)
    if total <= 0:
        raise ValueError("a schedule needs a positive weight somewhere")
    wanted, position, below = share * total, F.lit(1.0), total
    for (t0, w0), (t1, w1), area in reversed(list(zip(knots, knots[1:], areas))):
        below -= area
        if area <= 0:
            continue
        rest, slope = F.greatest(wanted - F.lit(below), F.lit(0.0)), (w1 - w0) / (t1 - t0)
        # rest = w0 x + slope x^2 / 2, in the form that is stable for small slopes
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0)))
        x = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (F.lit(w0) + root))
        position = F.when(wanted < F.lit(below + area), F.least(F.lit(t0) + x, F.lit(t1))).otherwise(position)
    return position


def plan(docs: DataFrame, *, weights=WEIGHTS, most: int = MOST_PASSES, schedules: dict | tuple | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7,
         keep: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of every document: one row each, the ``keep`` columns last.

    Within a source, documents stand in a random order fixed by ``seed`` (id,
    then size, break ties). A source whose target is p times its size is passed
    floor(p) times whole, and once more up to the word where the target is
    reached: the document at that place gives its first words only. ``position``
    is when training first meets the document (null: never). ``schedules`` maps
    a source to its (time, weight) points, others stay level; or it is a tuple
    of schedules dealt to the sources by rank, repeating. Only the order depends
    on it: a source's demand is its target, spread as its schedule's integral.

    Order sums are taken in two steps, per run of a source's order and over the
    runs' totals, so the largest source is spread like any other.

    Null text: size 0, takes nothing. A null source is a source of its own, last
    by name. Repeated rows are separate documents. No rows give no rows.
    """
    from pyspark.sql import Window

    name = F.concat(F.when(F.col(source_col).isNull(), "n").otherwise("v"), F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    sized = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), name.alias("key"), word_count(F.col(text_col)).alias("size"),
        *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    if not keep:
        sized = materialized(sized)     # three narrow columns: the texts are read once
    # Runs are equal slices of the order's range, the same for every source.
    n = sized.count() if not keep else docs.count()
    runs = 4 * -(-n // ROWS_PER_RUN) if n else 1
    sized = sized.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "size"))
    sized = sized.withColumn("run", F.floor((F.col("place") / F.lit(2.0 ** 64) + 0.5) * runs).cast("int"))
    totals = materialized(sized.groupBy("key", "run").agg(F.sum("size").alias("run_size")))
    sources = totals.groupBy("key").agg(F.sum("run_size").alias("source_size")).withColumn(
        "source", F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)))
    goals = source_targets(sources, weights, most).select("key", "source", "rank", "source_size", "target")
    over_runs = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("key", "run", F.coalesce(F.sum("run_size").over(over_runs), F.lit(0)).alias("run_start"))
    starts = materialized(starts.join(goals, "key"))
    mixed = sized.join(starts, ["key", "run"])
    within = Window.partitionBy("key", "run").orderBy("place", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    mixed = mixed.withColumn("before", F.col("run_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))

    goal = F.round("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = goal - F.col("passes") * F.col("source_size")
    partial = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - F.col("before")))
    mixed = mixed.withColumn("passes", whole).withColumn("partial", F.when(F.col("passes") >= most, 0).otherwise(partial).cast("bigint"))
    mixed = mixed.withColumn("taken", F.col("passes") * F.col("size") + F.col("partial"))
    position = F.when(F.col("taken") > 0, stream_position(F.col("source"), F.col("rank"), F.col("before") / goal, schedules))
    return mixed.withColumn("position", position).select(
        *PLAN, "passes", "partial", "before", "rank", *[F.col(f"kept_{i}") for i in range(len(keep))])


def stream_position(source: Column, rank: Column, share: Column, schedules: dict | tuple | None) -> Column:
    """Training position of a share of a source's token stream, by the source's own schedule."""
    if isinstance(schedules, tuple):
        own = [(rank % len(schedules) == i, s) for i, s in enumerate(schedules)]
    else:
        own = [(source.eqNullSafe(F.lit(name)), s) for name, s in (schedules or {}).items()]
    position = training_position(share, LEVEL)
    for mine, schedule in own:
        position = F.when(mine, training_position(share, schedule)).otherwise(position)
    return position


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space kept as it is."""
    parts = F.split(text, rf"(?<=[^{BLANKS}])(?=[{BLANKS}])")
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` repeated and cut as the plan says, in training order.

    Columns are those of ``docs``. Every pass over a document is a row; a cut
    document ends after its last word taken. Rows are range-sorted by training
    position, so files hold consecutive stretches of the run.
    """
    columns, id_col, text_col = docs.columns, options.get("id_col", "doc_id"), options.get("text_col", "text")
    planned = plan(docs, keep=tuple(columns), **options).where("taken > 0")
    every = planned.withColumn("pass", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("passes") - 1 + (F.col("partial") > 0).cast("bigint"))))
    words = F.when(F.col("pass") < F.col("passes"), F.col("size")).otherwise(F.col("partial"))
    share = (F.col("before") + F.col("pass") * F.col("source_size")) / F.round("target").cast("bigint")
    at = columns.index(text_col)
    cut = F.when(words < F.col("size"), first_words(F.col(f"kept_{at}"), words)).otherwise(F.col(f"kept_{at}"))
    rows = every.select(
        stream_position(F.col("source"), F.col("rank"), share, options.get("schedules")).alias("mix_position"),
        *[(cut if i == at else F.col(f"kept_{i}")).alias(f"kept_{i}") for i in range(len(columns))])
    ordered = rows.repartitionByRange("mix_position", F.xxhash64(f"kept_{columns.index(id_col)}"))
    return ordered.sortWithinPartitions("mix_position").select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(columns)])
