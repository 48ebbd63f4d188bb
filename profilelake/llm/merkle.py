"""Merkle manifest of a dataset: one root, and for every row a proof that leads to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilelake.session import materialized

ARITY = 2               # children of a node, at most
BLOCK_LEVELS = 8        # levels that are nested in one row: ARITY ** BLOCK_LEVELS leaves at most
STEP = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text."""
    return F.sha2(text, 256)


def written_field(value: Column) -> Column:
    """A field as text that no other field can be mistaken for: ``-`` if null, else its UTF-8 length, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return digest(F.concat(*[written_field(f) for f in fields]))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and the digests beside its path lead to."""
    return F.aggregate(proof, leaf, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def siblings(proof: Column) -> Column:
    """All digests beside a leaf's path, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def ranked(rows: DataFrame, group: str, order: Sequence[str], *, name: str = "nth", total: str = "total") -> DataFrame:
    """``rows``, written once, with their place from 0 in their ``group`` (nulls form one) and the group's size.

    Rows are range-sorted by group and order; a row's id then holds its task and
    its place there, and one sum per group and task turns it into the place in
    the group. No task sees a whole group. Rows equal in all of ``order`` have
    any order among themselves.
    """
    tied = rows.withColumn("_row", F.monotonically_increasing_id())
    ordered = tied.orderBy(group, *order, "_row").drop("_row")
    ordered = materialized(ordered.withColumn("_at", F.monotonically_increasing_id()))
    runs = ordered.groupBy(group, F.shiftright("_at", 33).alias("_run")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    runs = runs.select(F.col(group).alias("_group"), "_run", F.sum("_n").over(whole).alias(total),
                       (F.sum("_n").over(whole.orderBy("_run")) - F.col("_n") - F.col("_first")).alias("_shift"))
    met = ordered.join(runs, F.col(group).eqNullSafe(F.col("_group")) & (F.shiftright("_at", 33) == F.col("_run")))
    return met.select(*[c for c in ordered.columns if c != "_at"], (F.col("_at") + F.col("_shift")).alias(name), total)


def levels_over(total: Column, arity: int) -> Column:
    """How often ``total`` nodes are grouped until one remains."""
    steps = F.sequence(F.lit(1), F.lit(63 // (arity.bit_length() - 1)))
    power = lambda k: F.pow(F.lit(float(arity)), k).cast("decimal(38,0)")
    return F.when(total <= 1, 0).otherwise(F.array_min(F.filter(steps, lambda k: power(k) >= total)))


def _rolled_up(nodes: DataFrame, payload: Sequence[str], arity: int, depth: int) -> DataFrame:
    """One row per (g, block) with the nested ``children`` and the ``hash`` of a block of ``arity ** depth`` nodes.

    ``nodes``: g, nth, levels (still to go), hash, and the payload. One shuffle by
    (g, block); each digit of the rank is then grouped away in place, since
    rows that share it are in one task already.
    """
    width = arity ** depth
    block = F.floor(F.col("nth") / F.lit(width)).cast("bigint")
    rows = nodes.select("g", block.alias("block"), F.pmod("nth", F.lit(width)).cast("int").alias("rest"), "levels", "hash",
                        F.struct(*payload).alias("children"))
    rows = rows.repartition("g", "block")
    for k in range(depth):
        child = F.struct(F.pmod("rest", F.lit(arity)).alias("digit"), "hash", "children")
        rows = rows.groupBy("g", "block", F.floor(F.col("rest") / F.lit(arity)).cast("int").alias("rest"), "levels").agg(
            F.sort_array(F.collect_list(child)).alias("children"))
        joined = F.array_join(F.transform("children", lambda c: c["hash"]), "")
        rows = rows.withColumn("hash", F.when(F.col("levels") > k, digest(joined)).otherwise(F.col("children")[0]["hash"]))
    return rows.drop("rest")


def _handed_down(children: Column, levels: Column, path: Column, depth: int) -> Column:
    """Payload and path of every node nested below ``children``, as one array.

    ``path``: the steps from the block's own node upward.
    """
    if depth == 0:
        return F.array(F.struct(children.alias("payload"), path.alias("path")))
    hashes = F.transform(children, lambda c: c["hash"])

    def below(child: Column, i: Column) -> Column:
        before, after = F.slice(hashes, F.lit(1), i), F.slice(hashes, i + 2, F.size(hashes))
        step = F.array(F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after")))
        own = F.when(levels > depth - 1, step).otherwise(F.array().cast(STEP))
        return _handed_down(child["children"], levels, F.concat(own, path), depth - 1)

    return F.flatten(F.transform(children, below))


def _tree(nodes: DataFrame, payload: Sequence[str], arity: int, depth: int) -> tuple[DataFrame, list[DataFrame], int]:
    """(roots, tiers, depth): one row (g, hash) per group, the blocks of every tier from the leaves up, and their levels.

    The blocks of a tier are the nodes of the next, with ``depth`` levels fewer
    to go, until each group is one block.
    """
    most = nodes.agg(F.max("levels")).first()[0] or 0
    depth = max(1, min(depth, most))        # no groupings for levels that no group has
    tiers = []
    while True:
        tiers.append(materialized(_rolled_up(nodes, payload, arity, depth)))
        if most <= depth * len(tiers):
            return tiers[-1].select("g", "hash"), tiers, depth
        nodes = tiers[-1].select("g", F.col("block").alias("nth"), F.greatest(F.col("levels") - depth, F.lit(0)).alias("levels"),
                                 "hash", F.col("block").alias("own"))
        payload = ["own"]


def _proofs(tiers: list[DataFrame], tops: DataFrame, depth: int) -> DataFrame:
    """(g, payload, path, tag) of every leaf, from the top tier down.

    ``tops``: g, path and tag of each group's root. A block and the path that
    leads on from it meet in a grouping by the block's place, one row of each;
    nothing is joined and leaves are not shuffled again.
    """
    paths = tops.withColumn("block", F.lit(0).cast("bigint"))
    for at in reversed(range(len(tiers))):
        blocks = tiers[at].select("g", "block", F.struct("levels", "children").alias("nest"))
        met = blocks.unionByName(paths, allowMissingColumns=True).groupBy("g", "block").agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("nest", "path", "tag")])
        found = _handed_down(F.col("nest.children"), F.col("nest.levels"), F.col("path"), depth)
        leaves = met.select("g", "tag", F.explode(found).alias("leaf")).select("g", "tag", "leaf.payload", "leaf.path")
        paths = leaves.select("g", "tag", F.col("payload.own").alias("block"), "path") if at else leaves
    return paths


def manifest(leaves: DataFrame, group: str, order: Sequence[str], *, leaf: str = "leaf", keep: Sequence[str] = (),
             arity: int = ARITY, depth: int = BLOCK_LEVELS) -> DataFrame:
    """(group, leaf, keep..., subroot, root, proof) of every row.

    Rows of one ``group`` are leaves of one subtree, ascending by ``order`` and
    then by ``leaf``; while several nodes remain, every ``arity`` consecutive ones
    become the digest of their joined digests (the last of fewer, even of one).
    Subroots, ascending by group, null first, become the root alike. ``proof`` is
    the list of digests (before, after) beside the leaf's path, for ``folded``.

    Ranks are taken by a range sort; blocks of ``arity ** depth`` leaves are rolled
    up into one nested struct, their roots likewise, tier by tier, and proofs come
    out of the nested structs by transform and explode, without joining leaves.
    A hot group is many blocks like any other. Repeated rows are leaves of their
    own; an empty table has an empty manifest.
    """
    inner = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([group, *order, leaf, *keep]))}
    rows = materialized(leaves.select(*[F.col(c).alias(n) for c, n in inner.items()]))     # digests once, not again for the sort's sample
    rows = ranked(rows, inner[group], list(dict.fromkeys([*(inner[c] for c in order), inner[leaf]])))
    names = rows.select(F.col(inner[group]).alias("name")).distinct().withColumn("all", F.lit(0))
    names = ranked(names, "all", ["name"], name="place", total="groups").select(
        F.col("place").alias("g"), "name", "groups")
    rows = rows.join(names.select("g", "name"), F.col(inner[group]).eqNullSafe(F.col("name")))
    payload = list(inner.values())
    nodes = materialized(rows.select("g", "nth", levels_over(F.col("total"), arity).alias("levels"), F.col(inner[leaf]).alias("hash"), *payload))
    roots, tiers, low = _tree(nodes, payload, arity, depth)

    # the tree of the subroots has one group, and the places of the first tree's groups as leaves
    upper = roots.join(names, "g").select(
        F.lit(0).cast("bigint").alias("g"), F.col("g").alias("nth"), levels_over(F.col("groups"), arity).alias("levels"), "hash", F.col("g").alias("own"))
    top, upper_tiers, high = _tree(materialized(upper), ["own", "hash"], arity, depth)
    tops = top.select("g", F.array().cast(STEP).alias("path"), F.struct(F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root")).alias("tag"))
    found = _proofs(upper_tiers, tops, high)
    tops = found.select(F.col("payload.own").alias("g"), "path", F.struct(F.col("payload.hash").alias("subroot"), F.col("tag.root").alias("root")).alias("tag"))
    proofs = _proofs(tiers, tops, low)
    wanted = list(dict.fromkeys([group, leaf, *keep]))
    return proofs.select(*[F.col(f"payload.{inner[c]}").alias(c) for c in wanted], "tag.subroot", "tag.root", F.col("path").alias("proof"))
