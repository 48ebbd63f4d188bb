"""Near-duplicate vectors by randomly rotated binary codes with correction factors.

A unit vector is rotated at random and stored once as its signs, a correction
factor (the inner product of the vector with its own code) and its rotated
coordinates in four bits. From the signs of one vector and the bits of another
their inner product is estimated without bias by counting bits, and the
estimate's spread is known, so a confidence bound tells which pairs can reach
the threshold. Only codes go through the buckets of vectors that share the
signs of a band; whole vectors are fetched for members of pairs inside the
bound, which are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelake.llm.common import arrow_schema, least_labels, shards, sorted_groups
from profilelake.llm.components import components
from profilelake.llm.topk import clean
from profilelake.session import materialized

THRESHOLD = 0.98
BANDS, BITS = 10, 12        # a pair at cosine 0.98 shares a band with probability 0.998
PLANES = 4                  # bits of a stored rotated coordinate
SPREADS = 5.0               # half width of the confidence bound, in standard deviations
BLOCK = 2048                # vectors of one bucket that meet at once
STRETCH = 512               # vectors of a block whose estimates are held at once
SHARD_ROWS = 50_000
SEED = 20_240

CODES = "grp bigint, dim int, node bigint, keys array<int>, code binary"
PLACE = ["grp", "dim", "slot", "p", "q"]
LIKELY = "grp bigint, dim int, slot bigint, p int, q int, own int, node bigint, code binary"
FOUND = "node bigint, id bigint, other bigint, links bigint"


@lru_cache(maxsize=8)
def rotations(dim: int, count: int):
    """``count`` random rotations of the space, the same in every task."""
    import numpy as np

    rng = np.random.default_rng((SEED, dim))
    return [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)]


def band_keys(unit, bands: int, bits: int):
    """vectors x bands: the signs of each band's rotated coordinates as a number."""
    import numpy as np

    dim = unit.shape[1]
    turns = rotations(dim, -(-bands * bits // dim))
    signs = np.hstack([unit @ r for r in turns])[:, :bands * bits] > 0
    return signs.reshape(len(unit), bands, bits) @ (1 << np.arange(bits))


def units(vectors, dim: int):
    """The rows of an Arrow list array as unit vectors."""
    import numpy as np

    v = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    unit = v / np.abs(v).max(axis=1, keepdims=True)     # first, so that no square overflows
    return unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))


def code_type(dim: int, bands: int):
    """The stored form of a vector: band keys, factor, range of its coordinates, signs and bit planes."""
    import numpy as np

    words = -(-dim // 64)
    return np.dtype([("keys", "<u2", (bands,)), ("factor", "<f4"), ("low", "<f4"), ("step", "<f4"),
                     ("signs", "<u8", (words,)), ("planes", "<u8", (PLANES, words))])


def encode(unit, bands: int, bits: int):
    """Codes of unit vectors. Coordinates are rounded by a fixed random dither, so without bias."""
    import numpy as np

    def packed(flags):
        out = np.zeros((len(flags), 8 * -(-flags.shape[1] // 64)), np.uint8)
        some = np.packbits(flags, axis=1, bitorder="little")
        out[:, :some.shape[1]] = some
        return out.view("<u8")

    dim = unit.shape[1]
    turned = unit @ rotations(dim, 1)[0]
    low, high, top = turned.min(axis=1), turned.max(axis=1), 2 ** PLANES - 1
    step = np.where(high > low, (high - low) / top, 1.0)
    dither = np.random.default_rng((SEED, dim, 1)).random(dim)
    level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, top).astype(np.uint8)
    codes = np.zeros(len(unit), code_type(dim, bands))
    codes["keys"] = band_keys(unit, bands, bits)
    codes["factor"], codes["low"], codes["step"] = np.abs(turned).sum(axis=1) / np.sqrt(dim), low, step
    codes["signs"] = packed(turned > 0)
    for bit in range(PLANES):
        codes["planes"][:, bit] = packed(level >> bit & 1)
    return codes


def estimates(a, b, dim: int):
    """Unbiased estimates of the inner products of vectors, from the signs of ``a`` and the bit planes of ``b``."""
    import numpy as np

    inside, total = np.zeros((len(a), len(b)), np.int32), np.zeros(len(b), np.int32)
    for bit in range(PLANES):
        for word in range(a["signs"].shape[1]):
            plane = b["planes"][:, bit, word]
            inside += np.bitwise_count(a["signs"][:, word, None] & plane).astype(np.int32) << bit
            total += np.bitwise_count(plane).astype(np.int32) << bit
    ones = np.bitwise_count(a["signs"]).sum(axis=1, dtype=np.int32)
    product = b["low"] * (2 * ones - dim)[:, None] + b["step"] * (2 * inside - total)
    return product / (np.sqrt(dim) * a["factor"])[:, None]


def least_estimates(a, b, dim: int, threshold: float):
    """For each of ``a`` the lowest estimate at which an inner product with one of ``b`` can reach the threshold.

    The estimate errs by sqrt(1 - f^2) / f times the part of the other vector
    across this one, in a random direction, and by the rounding of coordinates.
    """
    import numpy as np

    f = a["factor"].astype(float)
    across = np.sqrt(max(0.0, 1 - threshold ** 2))
    turned = np.sqrt(np.maximum(0, 1 - f * f)) / f * across / np.sqrt(max(1, dim - 1))
    rounded = float(b["step"].max()) / f / np.sqrt(6)
    return threshold - SPREADS * np.sqrt(turned ** 2 + rounded ** 2) - 1e-5


def likely_pairs(codes, own, dim: int, band: int, threshold: float) -> Iterator[tuple]:
    """(i, j) of the pairs inside the bound, some rows at a time.

    ``own``: block of each row; with two blocks, only pairs across them count.
    A pair belongs to the first band it shares and is left out of later ones.
    """
    import numpy as np

    low, high = own.min(), own.max()
    first, second = np.flatnonzero(own == low), np.flatnonzero(own == high)
    for s in range(0, len(first), STRETCH):
        a, b = first[s:s + STRETCH], second[s:] if low == high else second
        near = estimates(codes[a], codes[b], dim) >= least_estimates(codes[a], codes[b], dim, threshold)[:, None]
        if low == high:
            near &= b > a[:, None]
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        fresh = ~(codes["keys"][i, :band] == codes["keys"][j, :band]).any(axis=1)
        yield i[fresh], j[fresh]


def link(rows: DataFrame, *, id_col: str = "vec_id", vec: str = "embedding", group: str = "label",
         threshold: float = THRESHOLD, bands: int = BANDS, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link when their groups are equal and not null and their cosine, in
    double precision, is at least ``threshold``. ``n_links`` counts the other
    rows linked directly, copies included; ``component_id`` is the smallest id
    reachable. Null, empty or zero vectors, non-finite or null components, null
    groups and null ids link with nothing: such a row is its own component.
    Vectors of unequal length never link. Repeated rows are separate vectors.

    Equal vectors of a group are first merged to one with a number of copies,
    and each of these is encoded once. Buckets above ``block`` vectors are cut
    into blocks that meet in pairs, so no task holds more than two blocks. No
    pairs are written: codes name the vectors with a pair inside the bound, and
    with these a bucket gives counts and a spanning forest; a pair that shares
    several bands counts in the first. Pairs that share no band are missed
    (about 0.2 % of those at 0.98, fewer above). A band has 16 bits at most.
    """
    if bits > 16:
        raise ValueError("a band has 16 bits at most")
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(group).cast("bigint").alias("grp"),
                       F.transform(vec, lambda x: x.cast("double") + F.lit(0.0)).alias("v"), F.col(vec).alias("raw"))
    fine = clean(base.where(F.col("id").isNotNull() & F.col("grp").isNotNull()), "v").where(
        F.exists("v", lambda x: x != 0))
    print_ = F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary"))
    fine = fine.withColumn("print", print_)
    # vectors travel as they came; a class gets a number once written
    classes = materialized(fine.groupBy("grp", "print").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw")).select(
        "*", F.monotonically_increasing_id().alias("node")))
    found = materialized(_found(classes, threshold, bands, bits, block))
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL"), "id", "other").withColumnRenamed("node", "rep")
    # ids may repeat in several groups or vectors: a class is counted by its number, hung by its representative
    result = classes.select("grp", "print", "rep", "copies", "node").join(counts, "node", "left").join(roots, "rep", "left").select(
        "grp", "print", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    linked = fine.select("id", "grp", "print").join(result, ["grp", "print"]).select("id", "n_links", "component_id")
    outside = base.where(~_takes_part()).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.unionByName(outside)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id",
                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _takes_part():
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("id").isNotNull() & F.col("grp").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))


def _found(classes: DataFrame, threshold: float, bands: int, bits: int, block: int) -> DataFrame:
    """Rows (node, links) of counted links and rows (id, other) of a spanning forest."""
    codes_schema, likely_schema, found_schema = arrow_schema(CODES), arrow_schema(LIKELY), arrow_schema(FOUND)
    vectors = classes.select("grp", "node", "rep", "copies", F.transform("raw", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))

    def to_codes(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            by_dim: dict[int, list[int]] = {}
            for i, n in enumerate(b.column("v").value_lengths().to_pylist()):
                by_dim.setdefault(n, []).append(i)
            for dim, index in by_dim.items():
                part = b.take(pa.array(index))
                codes = encode(units(part.column("v"), dim), bands, bits)
                n, ends = len(codes), np.arange(len(codes) + 1, dtype=np.int32)
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends * codes.itemsize), pa.py_buffer(codes)])
                keys = pa.ListArray.from_arrays(pa.array(ends * bands), pa.array(codes["keys"].ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("grp"), pa.array(np.full(n, dim, np.int32)), part.column("node"), keys.cast(codes_schema.field("keys").type), packed],
                    schema=codes_schema)

    def stored(table, s, e):
        import numpy as np

        dim = table.column("dim")[s].as_py()
        data = b"".join(table.column("code").slice(s, e - s).to_pylist())
        return dim, np.frombuffer(data, code_type(dim, bands)), table.column("own").to_numpy()[s:e], table.column("slot")[s].as_py() >> bits

    def name_likely(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for table, bounds in sorted_groups(batches, PLACE):
            named = np.zeros(table.num_rows, bool)
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s < 2:
                    continue
                dim, codes, own, band = stored(table, s, e)
                for i, j in likely_pairs(codes, own, dim, band, threshold):
                    named[s + i] = named[s + j] = True
            yield from table.select(likely_schema.names).filter(pa.array(named)).cast(likely_schema).to_batches()

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for table, bounds in sorted_groups(batches, PLACE):
            nodes, ids, copies = (table.column(c).to_numpy() for c in ("node", "id", "copies"))
            out: list[tuple] = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                dim, codes, own, band = stored(table, s, e)
                unit = units(table.column("v").slice(s, e - s).combine_chunks(), dim)
                links, a, b = np.zeros(e - s, np.int64), [], []
                for i, j in likely_pairs(codes, own, dim, band, threshold):
                    for at in range(0, len(i), 65_536):
                        x, y = i[at:at + 65_536], j[at:at + 65_536]
                        true = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                        x, y = x[true], y[true]
                        links += np.bincount(x, copies[s:e][y], e - s).astype(np.int64) + np.bincount(y, copies[s:e][x], e - s).astype(np.int64)
                        a.append(x)
                        b.append(y)
                if not links.any():
                    continue
                label = least_labels(e - s, np.concatenate(a), np.concatenate(b))
                hit, hung = np.flatnonzero(links), np.flatnonzero(label != np.arange(e - s))
                none = np.full(max(len(hit), len(hung)), -1)
                out.append((nodes[s:e][hit], none[:len(hit)], none[:len(hit)], links[hit]))
                out.append((none[:len(hung)], ids[s:e][hung], ids[s:e][label[hung]], none[:len(hung)]))
            if out:
                node, one, other, count = (np.concatenate(x) for x in zip(*out))
                tree = count < 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, mask=tree), pa.array(one, mask=~tree), pa.array(other, mask=~tree), pa.array(count, mask=tree)],
                    schema=found_schema)

    codes = materialized(vectors.select("grp", "node", "v").mapInArrow(to_codes, CODES))
    slot = (F.col("band") * (1 << bits) + F.col("key")).cast("bigint").alias("slot")
    banded = codes.select("grp", "dim", "node", "code", F.posexplode("keys").alias("band", "key")).select("grp", "dim", slot, "node", "code")
    place = ["grp", "dim", "slot"]
    heavy = materialized(banded.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block))
    blocks = F.coalesce(F.ceil(F.col("n") / block).cast("int"), F.lit(1))
    met = banded.join(heavy, place, "left").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns(
        {"p": F.least("own", "with"), "q": F.greatest("own", "with")}).drop("n", "with")
    n = shards(codes, SHARD_ROWS) * bands
    # pairs are judged the same way in both passes, since the number of a vector orders them
    likely = materialized(met.repartition(n, *PLACE).sortWithinPartitions(*PLACE, "node").mapInArrow(name_likely, LIKELY))
    fetched = likely.join(vectors.select("node", F.col("rep").alias("id"), "copies", "v"), "node")
    return fetched.repartition(shards(likely, SHARD_ROWS), *PLACE).sortWithinPartitions(*PLACE, "node").mapInArrow(compare, FOUND)
