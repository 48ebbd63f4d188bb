"""Top-n per key, global ordinals and exact quantiles that survive hot keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilelake.session import materialized

SALTS = 64                 # parts of a key in the first step
ACCURACY = 1_000           # of quantile sketches: ranks are right to a thousandth of the rows


def first_per_key(df: DataFrame, keys: Sequence[str], ascending: Sequence[Column]) -> DataFrame:
    """The row of each key with the smallest ``ascending`` tuple.

    ``min_by`` aggregates partially before the shuffle, so a hot key sends one
    row per task. The expressions must not be null.
    """
    values = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*values), F.struct(*[a.alias(f"_o{i}") for i, a in enumerate(ascending)])).alias("_row")
    )
    return best.select(*keys, "_row.*").select(*df.columns)


def ranked_top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Top n per key with one shuffle, for keys known to have few rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, *,
                  rank: str = "rank", salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, with their rank.

    Two steps over one scan, for every key alike. The salt is the id of the
    task's partition, the same for every retry of the task, so the limit before
    the first shuffle keeps n rows per key and task; the second step sees at
    most ``salts`` times n rows of a key, however many it has.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    local = ranked_top_n(salted, [*keys, "_salt"], order, n, rank).drop("_salt", rank)
    return ranked_top_n(local, keys, order, n, rank)


def evenly_spaced(total: int, points: int) -> list[int]:
    """Ordinals of at most ``points`` rows spread over 0..total-1, both ends included."""
    if total <= points:
        return list(range(total))
    if points == 1:
        return [0]
    return [i * (total - 1) // (points - 1) for i in range(points)]


def pick_evenly(df: DataFrame, order: Sequence[Column], points: int, *, ordinal: str = "ordinal") -> tuple[DataFrame, int]:
    """At most ``points`` evenly spaced rows of the ordered frame, and its row count.

    The sorted frame is written once. Row ids then hold (partition, offset),
    and the driver only sees one count per partition to place the ordinals.
    """
    ordered = materialized(df.orderBy(*order).withColumn("_rid", F.monotonically_increasing_id()))
    sizes = sorted(
        (r["_pid"], r["_n"])
        for r in ordered.groupBy(F.shiftright("_rid", 33).alias("_pid")).agg(F.count(F.lit(1)).alias("_n")).collect()
    )
    total = sum(n for _, n in sizes)
    picks, start, wanted = [], 0, evenly_spaced(total, points)
    position = 0
    for pid, n in sizes:
        while position < len(wanted) and wanted[position] < start + n:
            picks.append(((pid << 33) + wanted[position] - start, wanted[position]))
            position += 1
        start += n
    spark = df.sparkSession
    targets = spark.createDataFrame(picks, f"_rid bigint, {ordinal} bigint")   # at most `points` rows
    return ordered.join(F.broadcast(targets), "_rid").drop("_rid"), total


def pick_evenly_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], points: int, *,
                          ordinal: str = "ordinal", total: str = "row_count") -> DataFrame:
    """At most ``points`` evenly spaced rows of every group, with their ordinal in it and the group's size.

    One sort by group and order is written once. A row's id then holds its task
    and its place there; prefix sums over (group, task) say which ordinals lie in
    which task, so the wanted rows are found by their ids. A group may span any
    number of tasks, and nothing passes through the driver. Null keys form a group.
    """
    ordered = materialized(materialized(df).orderBy(*keys, *order).withColumn("_rid", F.monotonically_increasing_id()))
    runs = ordered.groupBy(*keys, F.shiftright("_rid", 33).alias("_run")).agg(F.count(F.lit(1)).alias("_n"), F.min("_rid").alias("_first"))
    group = Window.partitionBy(*keys)
    runs = runs.withColumns({total: F.sum("_n").over(group), "_before": F.sum("_n").over(group.orderBy("_run")) - F.col("_n")})
    wanted = F.sequence(F.lit(0).cast("bigint"), F.least(F.col(total), F.lit(points)) - 1)
    if points > 1:
        wanted = F.transform(wanted, lambda i: F.when(F.col(total) <= points, i).otherwise(F.floor(i * (F.col(total) - 1) / (points - 1))))
    here = F.filter(wanted, lambda o: (o >= F.col("_before")) & (o < F.col("_before") + F.col("_n")))
    picks = runs.select(F.explode(here).alias(ordinal), "_first", "_before", total).select(
        (F.col("_first") + F.col(ordinal) - F.col("_before")).alias("_rid"), ordinal, total)
    return ordered.join(picks, "_rid").drop("_rid")


def bracket(value: str, q: float, accuracy: int = ACCURACY) -> Column:
    """Aggregate: two values of a mergeable quantile sketch between which the exact quantile should lie.

    The sketch errs by 1 / ``accuracy`` of the rows at most; the bracket is twice
    that to each side. Whoever uses it checks that the quantile is inside.
    """
    ends = [max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)]
    return F.percentile_approx(value, ends, accuracy)


def exact_quantile(df: DataFrame, groups: Sequence[str], value: str, q: float = 0.5, *,
                   out: str = "quantile", brackets: DataFrame | None = None, sketch: bool = True) -> DataFrame:
    """Exact linearly interpolated quantile of ``value`` per group.

    ``percentile`` gathers all distinct values of a group in one buffer. Here a
    sketch gives a bracket per group, the values below and above it are only
    counted, and those inside (some thousandths of a large group) are counted by
    value, range-sorted and written. Block totals locate the one or two sorted
    blocks that hold the wanted ranks. A group whose rank turns out to lie
    outside its bracket is done again with all its values, so the result never
    rests on the sketch. ``brackets`` are the groups with a column ``bracket``,
    for callers that aggregate anyway. With very many small groups a sketch of
    each costs more than it saves: ``sketch=False`` counts and sorts all their
    values, the result is the same. Null groups are groups; null values are left
    out, and a group of nulls has no row.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    named = [F.col(g).alias(k) for g, k in zip(groups, keys)]
    values = df.where(F.col(value).isNotNull()).select(*named, F.col(value).alias("_v"))
    if brackets is not None:
        brackets = brackets.select(*named, F.col("bracket").alias("_bracket"))
    if not keys:
        keys, values = ["_g"], values.withColumn("_g", F.lit(0))
        brackets = brackets.withColumn("_g", F.lit(0)) if brackets is not None else None
    if brackets is None and not sketch:
        return _named(_at_rank(values.withColumn("_side", F.lit(1)), keys, q), groups, keys, out)
    if brackets is None:
        # written, so that the join knows the size of this table
        brackets = materialized(values.groupBy(*keys).agg(bracket("_v", q).alias("_bracket")))
    low, high = F.col("_bracket")[0], F.col("_bracket")[1]
    side = F.when(F.col("_v") < low, 0).when(F.col("_v") > high, 2).otherwise(1)
    sided = _same_group(values, brackets, keys, "inner").withColumn("_side", side)
    found = materialized(_at_rank(sided, keys, q))
    missed = found.where("NOT _inside").select(*keys)
    if not missed.isEmpty():
        again = _same_group(values, missed, keys, "left_semi").withColumn("_side", F.lit(1))
        found = found.where("_inside").unionByName(_at_rank(again, keys, q))
    return _named(found, groups, keys, out)


def _named(found: DataFrame, groups: Sequence[str], keys: Sequence[str], out: str) -> DataFrame:
    """The quantile between the two values found, under the caller's names."""
    result = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_w")
    return found.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], result.alias(out))


def _same_group(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``left`` joined with a row per group; null groups meet."""
    right = right.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    return left.join(right, same, how).drop(*[f"_r{k}" for k in keys])


def _at_rank(sided: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """The values around rank q * (n - 1) of each group, and whether they were inside (side 1).

    Values of sides 0 and 2 are below and above all others and only counted.
    """
    kept = F.when(F.col("_side") == 1, F.col("_v")).alias("_v")
    counted = sided.groupBy(*keys, "_side", kept).agg(F.count(F.lit(1)).alias("_n"))
    ordered = materialized(counted.orderBy(*keys, "_side", "_v").withColumn("_pid", F.spark_partition_id()))

    per_group = Window.partitionBy(*keys)
    blocks = ordered.groupBy(*keys, "_pid").agg(F.sum("_n").alias("_size"))
    blocks = (
        blocks.withColumn("_before", F.sum("_size").over(per_group.orderBy("_pid")) - F.col("_size"))
        .withColumn("_pos", (F.sum("_size").over(per_group) - 1) * F.lit(float(q)))
        .withColumn("_lo", F.floor("_pos"))
        .withColumn("_hi", F.ceil("_pos"))
    )
    end = F.col("_before") + F.col("_size")
    holds = lambda r: (F.col(r) >= F.col("_before")) & (F.col(r) < end)
    blocks = blocks.where(holds("_lo") | holds("_hi")).drop("_size")

    rows = _same_group(ordered, blocks, [*keys, "_pid"], "inner")
    in_block = Window.partitionBy(*keys, "_pid").orderBy("_side", "_v")
    rows = rows.withColumn("_end", F.col("_before") + F.sum("_n").over(in_block))
    covers = lambda r: (F.col(r) >= F.col("_end") - F.col("_n")) & (F.col(r) < F.col("_end"))
    return rows.where(covers("_lo") | covers("_hi")).groupBy(*keys).agg(
        F.max(F.when(covers("_lo"), F.col("_v"))).alias("_vlo"),
        F.max(F.when(covers("_hi"), F.col("_v"))).alias("_vhi"),
        F.first(F.col("_pos") - F.col("_lo")).alias("_w"),
        F.every(F.col("_side") == 1).alias("_inside"),
    )


def merged_row(*rows: DataFrame) -> DataFrame:
    """One row with the columns of several one-row frames (no cross join)."""
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def salts_for(rows: int, per_task: int) -> int:
    """Number of blocks that keeps each below ``per_task`` rows."""
    return max(1, math.ceil(rows / per_task))
