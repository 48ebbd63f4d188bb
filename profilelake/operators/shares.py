"""Rows that questions share: kept once, and counted, ranked and summed up per question without a copy for each."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilelake.operators.ranking import salts_for, top_n_per_key
from profilelake.session import materialized

BLOCKS = 64                 # of a variable's values, where a median is looked for
SORTED_BLOCKS = 1 << 16     # of sorted rows, where evenly spaced ones are looked for
PER_TASK = 1 << 20          # narrow rows that a task sorts


@dataclass
class Shares:
    """``rows`` stand once in each share (columns ``on``); ``asked`` (key, on) says which shares a question takes.

    A question's rows are those of its shares; a share asked for twice counts
    twice. Whatever can be merged is found per share and merged per question.
    ``hidden``: columns of ``on`` that are no columns of the rows as a question sees them.
    """

    rows: DataFrame
    asked: DataFrame
    on: tuple[str, ...]
    key: str = "query_id"
    hidden: tuple[str, ...] = ()

    @classmethod
    def of(cls, rows: DataFrame, key: str = "query_id") -> Shares:
        """Rows that already stand with their question: its only share."""
        own = rows.withColumnRenamed(key, "_share").where("_share IS NOT NULL")
        return cls(own, own.select(F.col("_share").alias(key), "_share").distinct(), ("_share",), key, ("_share",))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c not in self.hidden]

    def joined(self) -> DataFrame:
        """Every question's rows. Not written: each use joins them anew."""
        return self.rows.join(self.asked, list(self.on)).select(*self.columns, self.key)

    def distinct(self, *columns: str) -> DataFrame:
        """Every question's distinct values of the columns (of several shares: more than once)."""
        few = self.rows.select(*dict.fromkeys([*self.on, *columns])).distinct()
        return few.join(self.asked, list(self.on)).select(self.key, *columns)

    def of_questions(self, questions: DataFrame) -> Shares:
        """The shares of the questions (key) given."""
        asked = self.asked.join(questions.select(self.key), self.key, "left_semi")
        return replace(self, asked=asked, rows=self.rows.join(asked.select(*self.on).distinct(), list(self.on), "left_semi"))

    def first_rows(self, order: Sequence[Column], n: int) -> DataFrame:
        """Rows among which are the first ``n`` of every question: the first of each share."""
        best = top_n_per_key(self.rows, list(self.on), order, n, rank="_nth").drop("_nth")
        return replace(self, rows=best).joined()

    def ranges(self, *columns: str, count: str = "row_count") -> DataFrame:
        """(key, row count, c_min and c_max of the columns) of every question that has rows."""
        ends = [(c, f"{c}_{name}", f) for c in dict.fromkeys(columns) for name, f in (("min", F.min), ("max", F.max))]
        each = self.rows.groupBy(*self.on).agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(out) for c, out, f in ends])
        return each.join(self.asked, list(self.on)).groupBy(self.key).agg(F.sum("_n").alias(count), *[f(out).alias(out) for _, out, f in ends])

    def averages(self, column: str) -> DataFrame:
        """(key, count, mean, min, max) of a column."""
        dtype = self.rows.schema[column].dataType
        value = F.col(column) if isinstance(dtype, T.DecimalType) else F.col(column).cast("double")
        each = self.rows.groupBy(*self.on).agg(F.count(column).alias("_c"), F.sum(value).alias("_s"), F.min(column).alias("_a"), F.max(column).alias("_z"))
        kind = self.rows.select(F.avg(column)).schema[0].dataType
        return each.join(self.asked, list(self.on)).groupBy(self.key).agg(
            F.sum("_c").alias("count"), (F.sum("_s") / F.nullif(F.sum("_c"), F.lit(0))).cast(kind).alias("mean"), F.min("_a").alias("min"), F.max("_z").alias("max"))

    def evenly(self, order: Sequence[Column], columns: Sequence[str], points: int) -> DataFrame:
        """(key, columns, ordinal): at most ``points`` evenly spaced rows of every question's sorted rows.

        Rows are sorted and written once for all questions. A row's id then stands
        for its place, so a question ranks ids; with many rows, blocks of ids
        first, and then the ids in the blocks that hold a wanted place.
        """
        names = list(dict.fromkeys(columns))
        ordered = materialized(self.rows.select(*dict.fromkeys([*self.on, *names])).orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
        bits = max(0, math.ceil(math.log2(max(1, ordered.count()) / SORTED_BLOCKS)))
        places = ordered.select(*self.on, F.shiftright("_place", bits).alias("_block"), "_place")
        found = self._at_ranks(places, (), _evenly(points), single=bits == 0)
        return found.join(ordered.select("_place", *names), "_place").select(self.key, *names, F.col("_at").alias("ordinal"))

    def statistics(self, variables: Sequence[str], digits: int = 6) -> DataFrame:
        """Six statistics per question and variable, as :func:`profilelake.operators.stats.six_statistics` has them.

        Those of the shares are merged. For the median, values are counted by
        share and block; only those of the block that holds a question's middle
        meet the question. The bounds of the blocks come from a sketch of all
        rows and decide how much that is, never the result. Questions without a key have none.
        """
        present = [v for v in variables if v in self.rows.columns]
        on, key = list(self.on), self.key
        values = self.rows.select(*on, *[F.nullif(F.col(v).cast("double"), F.lit(float("nan"))).alias(f"_v{i}") for i, v in enumerate(present)])
        each = values.groupBy(*on).agg(*[F.struct(F.lit(i).alias("_i"), F.count(c).alias("_n"), F.avg(c).alias("_mean"), F.min(c).alias("_min"), F.max(c).alias("_max"),
                                                  (F.var_pop(c) * F.count(c)).alias("_m2")).alias(c) for i, c in enumerate(values.columns[len(on):])])
        each = materialized(each.select(*on, F.inline(F.array(*[f"_v{i}" for i in range(len(present))]))))
        group = [key, "_i"]
        mean = F.sum(F.col("_n") * F.col("_mean")) / F.nullif(F.sum("_n"), F.lit(0))
        own = Window.partitionBy(*group)
        told = self.asked.where(F.col(key).isNotNull()).join(each, on).withColumn(
            "mean", F.sum(F.col("_n") * F.col("_mean")).over(own) / F.nullif(F.sum("_n").over(own), F.lit(0)))
        spread = F.sum(F.col("_m2") + F.col("_n") * F.pow(F.col("_mean") - F.col("mean"), F.lit(2)))
        n = F.sum("_n")
        stats = told.groupBy(*group).agg(n.alias("count"), mean.alias("mean"), F.min("_min").alias("min"), F.max("_max").alias("max"),
                                         F.when(n > 1, F.sqrt(spread / F.nullif(n - 1, F.lit(0)))).alias("std"))
        medians = materialized(self._medians(values, len(present)), plain=True)
        names = F.array(*[F.lit(v) for v in present])
        rounded = [F.round(c, digits).alias(c) for c in ("mean", "median", "min", "max", "std")]
        return materialized(stats, plain=True).join(medians, group, "left").select(key, F.get(names, F.col("_i")).alias("variable"), "count", *rounded)

    def _medians(self, values: DataFrame, n: int) -> DataFrame:
        """(key, _i, median) of the columns _v0, _v1, ... of ``values``."""
        probabilities = [(b + 1) / BLOCKS for b in range(BLOCKS - 1)]
        cuts = values.agg(*[F.percentile_approx(f"_v{i}", probabilities, 10 * BLOCKS).alias(f"_v{i}") for i in range(n)]).first()
        of = F.array(*[F.struct(F.col(f"_v{i}").alias("_v"), _block(F.col(f"_v{i}"), sorted(set(cuts[i] or ()))).alias("_block")) for i in range(n)])
        long = values.select(*self.on, F.posexplode(of).alias("_i", "_s")).where("_s._v IS NOT NULL").select(*self.on, "_i", F.col("_s._block").alias("_block"), F.col("_s._v").alias("_place"))
        found = self._at_ranks(long, ("_i",), _middle)
        at, total = F.col("_at"), F.col("_total")
        low, high = (F.max(F.when(at == F.floor((total - d) / 2), F.col("_place"))) for d in (1, 0))
        return found.groupBy(self.key, "_i").agg((low + (high - low) * F.when(F.max("_total") % 2 == 0, 0.5).otherwise(0.0)).alias("median"))

    def _at_ranks(self, rows: DataFrame, within: Sequence[str], wanted: Callable, *, single: bool = False) -> DataFrame:
        """(key, within, _place, _at, _total): of each question's ``rows`` (on, within, _block, _place), sorted by block
        and place, those at the wanted ranks.

        ``wanted(begin, end, total)``: whether a wanted rank lies in begin..end-1.
        Blocks are counted by share and added up by question; only rows of blocks
        that hold a wanted rank are ranked one by one. ``single``: blocks of one
        row, which are ranked at once. A question's rows meet in one task, where
        the planner broadcasts what stands by share, else after a shuffle of what
        is narrow here.
        """
        spark, on, key, within = rows.sparkSession, list(self.on), self.key, list(within)
        asked = self.asked.where(F.col(key).isNotNull())
        counts = materialized(rows.groupBy(*on, *within, "_block").agg(F.count(F.lit(1)).alias("_n")))
        sizes = materialized(counts.groupBy(*on, *within).agg(F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_blocks")), plain=True)
        met = asked.join(sizes, on).agg(F.sum("_blocks")).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), salts_for(met, PER_TASK))
        group = Window.partitionBy(key, *within)
        pairs = asked.repartition(parts, key).join(sizes, on).withColumn("_total", F.sum("_size").over(group)).drop("_size", "_blocks")
        if single:
            ranked = pairs.join(rows.drop("_block"), [*on, *within]).select(key, *within, "_place", "_total").withColumn(
                "_at", F.row_number().over(group.orderBy("_place")).cast("bigint") - 1)
        else:
            blocks = pairs.join(counts, [*on, *within]).groupBy(key, *within, "_block").agg(F.sum("_n").alias("_n"), F.max("_total").alias("_total"))
            blocks = blocks.withColumn("_end", F.sum("_n").over(group.orderBy("_block"))).withColumn("_begin", F.col("_end") - F.col("_n"))
            hit = blocks.where(wanted(F.col("_begin"), F.col("_end"), F.col("_total"))).select(key, *within, "_block", "_begin")
            inside = pairs.join(hit, [key, *within]).join(rows, [*on, *within, "_block"]).select(key, *within, "_block", "_begin", "_place", "_total")
            ranked = inside.withColumn("_at", F.col("_begin") + F.row_number().over(Window.partitionBy(key, *within, "_block").orderBy("_place")) - 1)
        return ranked.where(wanted(F.col("_at"), F.col("_at") + 1, F.col("_total"))).select(key, *within, "_place", "_at", "_total")


def _block(value: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """Number of ``cuts`` (ascending) that are not above the value, plus ``first``, by halving."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(value < F.lit(cuts[half]), _block(value, cuts[:half], first)).otherwise(_block(value, cuts[half + 1:], first + half + 1))


def _evenly(points: int) -> Callable:
    """Ranks of at most ``points`` rows spread over 0..total-1, both ends included, as :func:`evenly_spaced` has them."""
    def wanted(begin: Column, end: Column, total: Column) -> Column:
        if points == 1:
            return begin == 0
        last = F.greatest(total - 1, F.lit(1))
        below = lambda x: F.call_function("div", x * F.lit(points - 1) + last - 1, last)    # noqa: E731  wanted ranks below x
        return (total <= points) | (below(end) > below(begin))

    return wanted


def _middle(begin: Column, end: Column, total: Column) -> Column:
    return (begin <= F.floor(total / 2)) & (end > F.floor((total - 1) / 2))
