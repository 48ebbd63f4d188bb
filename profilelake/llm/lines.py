"""Line dedup by minimal perfect hashing: documents ask compact arrays which of their lines recur."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilelake.llm.common import mixed, sorted_groups
from profilelake.session import materialized

SHORTEST = 20               # code points of a line's key
MIN_DOCS = 3
SHARD_KEYS = 1 << 16        # keys of a shard's arrays (about 1.4 MB)
PROBES_EACH = 1 << 17       # lines that one copy of a shard's arrays answers
ROOM = 1.6                  # bits of a level for each key still without a place
BLANK_SIGNS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------- minimal perfect hash

def _slot(h, f, level: int, size: int):
    import numpy as np

    return mixed(h ^ mixed(f + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) % np.uint64(size)


def build(h, f):
    """(sizes, bits) of a minimal perfect hash of the distinct pairs (h, f) of 64-bit numbers.

    A level is a bit array; a key that meets no other there owns its bit, the
    rest go on to the next, smaller one. A key's index is the number of bits
    set before its own.
    """
    import numpy as np

    sizes, bits = [], []
    while len(h):
        size = max(64, -(-int(ROOM * len(h)) // 8) * 8)
        at = _slot(h, f, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little"))
        left = ~alone[at]
        h, f = h[left], f[left]
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint8)


class Shard:
    """A shard's hash with its arrays: fingerprint, number of documents and largest document of each key."""

    def __init__(self, sizes, bits, prints=None, docs=None, largest=None):
        import numpy as np

        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bits = np.unpackbits(bits, bitorder="little").astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32) - 1
        self.prints, self.docs, self.largest = prints, docs, largest

    def index(self, h, f):
        """The index of each key; of a pair that is no key, -1 or that of some key."""
        import numpy as np

        found = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.starts[level] + _slot(h[open_], f[open_], level, int(size)).astype(np.int64)
            hit = self.bits[at]
            found[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return found

    def ask(self, h, f):
        """(found, index): whether a pair is a key, by the stored fingerprint, and its index."""
        at = self.index(h, f)
        return (at >= 0) & (self.prints[at] == f) if len(self.prints) else at >= 0, at


# ------------------------------------------------------------------- the job

def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK_SIGNS)), UPPER, LOWER)


def _hashes() -> list[Column]:
    return [F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), "key").alias("f")]


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _arrays(batches: Iterator) -> Iterator:
    """One row of arrays per shard, from its keys in order of the shard."""
    import numpy as np
    import pyarrow as pa

    for t, bounds in sorted_groups(batches, ["shard"]):
        column = {c: t.column(c).to_numpy() for c in ("shard", "h", "f", "docs", "largest")}
        for a, b in zip(bounds[:-1], bounds[1:]):
            h, f = (column[c][a:b].view(np.uint64) for c in ("h", "f"))
            sizes, bits = build(h, f)
            order = np.argsort(Shard(sizes, bits).index(h, f))
            yield pa.RecordBatch.from_arrays([
                pa.array([column["shard"][a]], pa.int32()), pa.array([int(column["docs"][a:b].sum())], pa.int64()),
                *[pa.array([x.tobytes()], pa.binary()) for x in
                  (sizes, bits, f[order], column["docs"][a:b][order], column["largest"][a:b][order])]], names=_ARRAYS_NAMES)


_ARRAYS = "shard int, held bigint, sizes binary, bits binary, prints binary, docs binary, largest binary"
_ARRAYS_NAMES = [c.split()[0] for c in _ARRAYS.split(", ")]


def _answers(batches: Iterator) -> Iterator:
    """(doc, ref, at) of the lines that go, from a shard's arrays (kind 0) and the lines that ask them (kind 1) after it."""
    import numpy as np
    import pyarrow as pa

    shard, of = None, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        key = (batch.column("shard").to_numpy().astype(np.int64) << 32) | batch.column("part").to_numpy()
        kind = batch.column("kind").to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(key)]):
            if kind[a] == 0:
                kept = {c: batch.column(c)[a].as_py() for c in ("sizes", "bits", "prints", "docs", "largest")}
                shard, of = Shard(np.frombuffer(kept["sizes"], np.int64), np.frombuffer(kept["bits"], np.uint8), np.frombuffer(kept["prints"], np.uint64),
                                  np.frombuffer(kept["docs"], np.int64), np.frombuffer(kept["largest"], np.int64)), key[a]
            elif key[a] == of:
                part = batch.slice(a, b - a)
                h, f = (part.column(c).to_numpy().view(np.uint64) for c in ("h", "f"))
                found, at = shard.ask(h, f)
                doc = part.column("doc").fill_null(_NO_ID).to_numpy()
                found[found] = shard.largest[at[found]] != doc[found]
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(found)) for c in ("doc", "ref", "at")], names=["doc", "ref", "at"])


_NO_ID = -(1 << 63)         # orders a document without an id below all others


def drop_recurring_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS,
                         shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``: lines that recur stay in one document only.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys
    of at least ``shortest`` code points found in at least ``min_docs`` rows lose
    all lines except those of the rows with the largest id that holds them. Null
    and empty texts have one empty line. Repeated rows count as documents of
    their own and are treated alike; a null id is below all others. ``docs`` may
    have any other columns; an empty table stays one.

    Keys are 128-bit hashes. Those that recur are indexed by shard in a minimal
    perfect hash with arrays of fingerprint, number of documents and largest id.
    A shard's arrays go, as often as its lines need, to the lines that ask them;
    a line in very many documents is so asked for in many tasks. Only the numbers
    of lines to drop come back to the documents.
    """
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped", "kept_text")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    # rows of one id and one text are alike, so the pair stands for the row
    whole = whole.withColumn("ref", F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length("text")))
    shards = _indexed(whole, min_docs, shortest)
    gone = _asked(whole, shards, shortest).groupBy("doc", "ref").agg(F.collect_set("at").alias("gone"))
    gone = gone.select(F.col("doc").alias("its_doc"), F.col("ref").alias("its_ref"), "gone")
    met = whole.join(gone, F.col("doc").eqNullSafe(F.col("its_doc")) & (F.col("ref") == F.col("its_ref")), "left").withColumn("parts", _split(F.col("text")))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(numbers, lambda i: F.get(F.col("parts"), i)), "\n"))
    new = met.select("row", "text", F.size("parts").cast("bigint").alias("n_lines"),
                     F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept_text"))
    given = [F.col("text").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c == text or c in rest]
    return new.select(*given, "n_lines", "n_dropped", "kept_text")


def _indexed(whole: DataFrame, min_docs: int, shortest: int) -> DataFrame:
    """The shards' arrays, written: one row for about SHARD_KEYS keys that lie in ``min_docs`` documents.

    A document's own repeats count once, and counts are added up before the shuffle.
    """
    long_lines = F.filter(_split(F.col("text")), lambda x: F.length(x) >= shortest)
    keys = F.array_distinct(F.filter(F.transform(long_lines, line_key), lambda k: F.length(k) >= shortest))
    hashed = whole.select("doc", F.explode(keys).alias("key")).select("doc", *_hashes())
    found = materialized(hashed.groupBy("h", "f").agg(
        F.count(F.lit(1)).alias("docs"), F.max(F.coalesce("doc", F.lit(_NO_ID))).alias("largest")).where(F.col("docs") >= min_docs))
    n = max(1, -(-found.count() // SHARD_KEYS))
    sharded = found.withColumn("shard", F.pmod("h", F.lit(n)).cast("int")).repartition("shard").sortWithinPartitions("shard")
    return materialized(sharded.mapInArrow(_arrays, _ARRAYS).withColumn("shards", F.lit(n)))


def _asked(whole: DataFrame, shards: DataFrame, shortest: int) -> DataFrame:
    """(doc, ref, at) of the lines to drop: each shard's arrays answer the lines of its hashes.

    A shard has as many copies as its lines fill parts: an even share of all
    lines, and those known to hold one of its keys.
    """
    n = (shards.agg(F.max("shards")).first()[0]) or 1
    lines = whole.agg(F.sum(F.size(_split(F.col("text"))))).first()[0] or 0
    sized = shards.withColumn("parts", (1 + (F.col("held") + F.lit(lines // n)) / PROBES_EACH).cast("int"))
    at = whole.select("doc", "ref", F.posexplode(_split(F.col("text"))).alias("at", "line")).where(F.length("line") >= shortest)
    at = at.select("doc", "ref", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= shortest)
    probes = at.select("doc", "ref", "at", *_hashes()).withColumn("shard", F.pmod("h", F.lit(n)).cast("int")).join(sized.select("shard", "parts"), "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("doc", "ref", "at"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"),
                           "doc", "ref", "at", "h", "f")
    arrays = sized.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"),
                          "sizes", "bits", "prints", "docs", "largest")
    both = probes.unionByName(arrays, allowMissingColumns=True)
    return both.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind").mapInArrow(_answers, "doc bigint, ref bigint, at int")
