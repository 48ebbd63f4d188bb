"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF word shingles.

A text is a bag of five-word shingles, each weighted by its count and the
rarity of its hash bucket in the whole corpus. Rarity is damped: a large group
of copies makes its own shingles frequent, and full weights would tear it apart
by its few edits. Every hash function draws one
shingle of the bag so that two bags draw the same with the probability of their
weighted Jaccard similarity. Texts that agree in all samples of a band are
compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelake.llm.common import arrow_schema, mixed, shards, sorted_groups, text_bytes, words
from profilelake.llm.components import components
from profilelake.llm.langid import row_slices
from profilelake.session import materialized

WORDS = 5                   # of a shingle
THRESHOLD = 0.8
BANDS, ROWS = 9, 4          # at similarity 0.8 a pair meets with probability 0.991, at 0.85 with 0.999
BUCKETS = 1 << 15           # of the document frequency table, which is broadcast
DRAWS = 1 << 16             # random triples of a hash function
RARITY_SHARE = 0.1          # of a weight that inverse document frequency decides
SEED = 77
SLICE_BYTES = 1 << 20
LEADERS = 2                 # texts of a bucket that all its others are compared with first
BLOCK = 256                 # texts of a crowded bucket that meet at once
SHARD_ROWS = 2_000


def shingle_bags(values, offsets):
    """(row, hash, count) of the distinct shingles of each row, rows in order, hashes rising within one.

    Words end at ASCII white space. A text of one to four words is one shingle.
    """
    import numpy as np

    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word, row = words(values, offsets)
    if not len(word):
        return empty
    # shingles start at each word with four more in its row, or at a short row's first word
    count = np.bincount(row, minlength=len(offsets) - 1)
    at = np.cumsum(count) - count
    nth = np.arange(len(word)) - at[row]
    start = np.flatnonzero((nth + WORDS <= count[row]) | ((nth == 0) & (count[row] < WORDS)))
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    total = np.zeros(len(start), np.uint64)
    size = np.minimum(count[row[start]], WORDS)
    for k in range(WORDS):
        total = total * np.uint64(0xD6E8FEB86659FD93) + np.where(k < size, padded[start + k], np.uint64(k + 1))
    shingle, owner = mixed(total), row[start]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.append(True, (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1]))
    index = np.flatnonzero(new)
    return owner[index], shingle[index], np.diff(np.append(index, len(shingle)))


def bucket_of(shingle):
    import numpy as np

    return (shingle >> np.uint64(49)).astype(np.int64)


def rarity(docs: DataFrame, text_col: str = "text"):
    """Weight of a shingle by hash bucket, over all rows: an array of BUCKETS numbers up to 1.

    It is 1 - RARITY_SHARE and RARITY_SHARE times the inverse document frequency
    as a share of its largest value.
    A bucket's frequency is the number of (document, shingle) pairs in it. Each
    task sends at most one row per bucket; the result is a bounded table.
    """
    import numpy as np

    schema = "bucket int, n bigint"
    out = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total, rows = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            values, offsets = text_bytes(b)
            rows += len(offsets) - 1
            for lo, hi in row_slices(offsets, SLICE_BYTES):
                _, shingle, _ = shingle_bags(values[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                total += np.bincount(bucket_of(shingle), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(total[used], rows))], schema=out)

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = sum(r["n"] for r in counts if r["bucket"] < 0)
    df = np.zeros(BUCKETS)
    for r in counts:
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["n"]
    idf = np.log1p(n / (1 + df)) / np.log1p(max(n, 1))
    return (1 - RARITY_SHARE + RARITY_SHARE * idf).astype(np.float32)


class Sampler:
    """The random triples of the hash functions, and bags to samples."""

    def __init__(self, hashes: int):
        import numpy as np

        rng = np.random.default_rng(SEED)
        shape = (hashes, DRAWS)
        r = rng.gamma(2.0, 1.0, shape)
        self.inverse, self.r = (1 / r).astype(np.float32), r.astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)
        self.odd = rng.integers(1, 2 ** 63, hashes, dtype=np.uint64) | np.uint64(1)

    def samples(self, owner, shingle, weight, n: int):
        """n x hashes: what each hash function draws from each row's bag (rows without one: 0)."""
        import numpy as np

        drawn = np.zeros((n, len(self.odd)), np.uint64)
        if not len(owner):
            return drawn
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes, rows = np.diff(np.append(starts, len(owner))), owner[starts]
        log_w = np.log(weight).astype(np.float32)
        for k, odd in enumerate(self.odd):
            slot = ((shingle * odd) >> np.uint64(48)).astype(np.int64)
            step = np.floor(log_w * self.inverse[k][slot] + self.beta[k][slot])
            log_a = self.log_c[k][slot] - self.r[k][slot] * (step - self.beta[k][slot] + 1)
            hit = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, starts), sizes))
            value = mixed(shingle[hit] ^ (step[hit].astype(np.int64).view(np.uint64) << np.uint64(1)))
            drawn[owner[hit[::-1]], k] = value[::-1]        # of equals the smallest shingle
        del rows
        return drawn


def similarity(a, b) -> float:
    """Weighted Jaccard of two bags (hash, weight), hashes rising."""
    import numpy as np

    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - common
    return common / total if total > 0 else 0.0


def bags(values, offsets, idf) -> list:
    """The weighted bag (hash, weight) of each row."""
    import numpy as np

    owner, shingle, count = shingle_bags(values, offsets)
    weight = count * idf[bucket_of(shingle)].astype(np.float64)
    cut = np.searchsorted(owner, np.arange(len(offsets)))
    return [(shingle[s:e], weight[s:e]) for s, e in zip(cut[:-1], cut[1:])]


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per document: id, copies (rows with its text), component_id, kept.

    Two texts link when the weighted Jaccard similarity of their shingle bags is
    at least ``threshold``; ``component_id`` is the smallest id reachable over
    links and equal texts, and ``kept`` marks that document. Null, empty and
    blank texts and null ids link with nothing: each is its own component.
    Rows that share an id are one document to the links.

    Equal texts count once. In each bucket every text is first compared with
    the bucket's smallest id, then what is not connected yet with a text chosen
    by hash; buckets that hold more than one component after that are compared
    in pairs of blocks, skipping what is connected already.
    So no link between components is lost, and a large group of copies makes
    one comparison per member. The texts of candidates travel once; no task
    holds more than two blocks.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    idf = spark.sparkContext.broadcast(rarity(base))
    signed = materialized(_signatures(base.withColumn("print", F.md5(F.col("text"))), idf, bands, rows))
    takes_part = F.col("id").isNotNull() & (F.size("keys") > 0)
    classes = materialized(signed.where(takes_part).groupBy("print").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    bands_of = signed.where(takes_part).join(classes, "print").where("id = rep").select("id", F.explode("keys").alias("key")).distinct()
    bands_of = materialized(bands_of)
    crowded = bands_of.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")
    members = materialized(bands_of.join(crowded, "key"))
    wanted = members.select("id").distinct()
    # joins with texts are merge joins at every size: no plan that only a small table allows
    texts = materialized(base.hint("merge").join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))

    pairs = members.where("id <> first").select("id", "first").distinct()
    links = materialized(_linked(pairs, texts, idf, threshold))
    for leader in range(LEADERS):
        found = materialized(components(links))
        placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        split = placed.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"),
            F.min_by(F.struct(F.col("id").alias("first"), F.col("component").alias("of")), F.xxhash64("id", F.lit(leader))).alias("l")).where("low < high")
        if leader == LEADERS - 1:
            break
        pairs = placed.drop("first").join(split.select("key", "l.*"), "key").where("component <> of").select("id", "first").distinct()
        # what is found so far goes on as stars
        links = materialized(_stars(found).unionByName(_linked(pairs, texts, idf, threshold)))
    rest = placed.join(split.select("key", "m", F.col("l.of").alias("main")), "key").select("key", "id", "first", "component", "m", "main")
    more = _linked_in_blocks(rest, texts, idf, threshold, block)
    found = components(_stars(found).unionByName(more)).withColumnRenamed("node", "rep")

    result = classes.join(found, "rep", "left").select("print", "copies", F.coalesce("component", "rep").alias("component_id"))
    linked = signed.where(takes_part).select("id", "print").join(result, "print").select("id", "copies", "component_id")
    alone = signed.where(~takes_part).select("id", F.lit(1).cast("bigint").alias("copies"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "copies", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _stars(found: DataFrame) -> DataFrame:
    return found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _signatures(base: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    schema = "id bigint, print string, keys array<bigint>"
    out = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sampler = Sampler(bands * rows)
        for b in batches:
            values, offsets = text_bytes(b)
            keys, sizes = [], []
            for lo, hi in row_slices(offsets, SLICE_BYTES):
                owner, shingle, count = shingle_bags(values[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                drawn = sampler.samples(owner, shingle, count * idf.value[bucket_of(shingle)], hi - lo)
                key = np.zeros((hi - lo, bands), np.uint64)
                for r in range(rows):
                    key = mixed(key * np.uint64(31) + drawn[:, r::rows])
                key = mixed(key + np.arange(bands, dtype=np.uint64))
                full = np.isin(np.arange(hi - lo), owner)
                keys.append(key[full].view(np.int64).ravel())
                sizes.append(full * bands)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            ends = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("print"), lists.cast(out.field("keys").type)], schema=out)

    return base.select("id", "print", "text").mapInArrow(run, schema)


def _linked(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b) of those pairs (id, first) that reach the threshold."""
    schema = "a bigint, b bigint"
    out = arrow_schema(schema)
    both = pairs.hint("merge").join(texts, "id").hint("merge").join(texts.select(F.col("id").alias("first"), F.col("text").alias("first_text")), "first")
    both = both.select("id", "first", "text", "first_text").sortWithinPartitions("first")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, last_bag = None, None
        for b in batches:
            ids, firsts = b.column("id").to_numpy(), b.column("first").to_numpy()
            values, offsets = text_bytes(b)
            keep = []
            for lo, hi in row_slices(offsets, SLICE_BYTES):
                own = bags(values[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], idf.value)
                for i in range(lo, hi):
                    if firsts[i] != last:
                        data = np.frombuffer(b.column("first_text")[i].as_py().encode(), np.uint8)
                        last, last_bag = firsts[i], bags(data, np.array([0, len(data)]), idf.value)[0]
                    if similarity(own[i - lo], last_bag) >= threshold:
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(firsts[keep])], schema=out)

    return both.mapInArrow(run, schema)


def _linked_in_blocks(rest: DataFrame, texts: DataFrame, idf, threshold: float, block: int) -> DataFrame:
    """Links between the components of each bucket, from exact comparison in pairs of blocks.

    ``main`` is one component of the bucket, as a rule its largest: its texts
    meet the others only. A pair whose weights differ too much to reach the
    threshold is not intersected.
    """
    schema = "a bigint, b bigint"
    out = arrow_schema(schema)
    rest = materialized(rest)
    in_main = F.col("component") == F.col("main")
    met = rest.join(rest.where(~in_main).groupBy("key").agg(F.count(F.lit(1)).alias("others")), "key")
    inner, outer = (F.greatest(F.ceil(n / block), F.lit(1)).cast("int") for n in (F.col("m") - F.col("others"), F.col("others")))
    # the chosen component has blocks of its own, numbered first; no two of them meet
    met = met.withColumn("own", F.when(in_main, F.pmod(F.xxhash64("id"), inner)).otherwise(inner + F.pmod(F.xxhash64("id"), outer)).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.when(in_main, inner).otherwise(F.lit(0)), inner + outer - 1)))
    met = met.withColumns({"p": F.least("own", "with"), "q": F.greatest("own", "with")}).drop("with", "m", "main", "others")
    keys = ["key", "p", "q"]
    n = shards(rest, SHARD_ROWS)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for table, bounds in sorted_groups(batches, keys):
            ids, first = table.column("id").to_numpy(), table.column("first").to_numpy()
            placed, own = table.column("component").to_numpy(), table.column("own").to_numpy()
            p, q = table.column("p").to_numpy(), table.column("q").to_numpy()
            data, pairs = table.column("text"), []
            for s, e in zip(bounds[:-1], bounds[1:]):
                parent: dict = {}

                def root(x, parent=parent):
                    while parent.get(x, x) != x:
                        x = parent[x]
                    return x

                if len(np.unique(placed[s:e])) < 2:
                    continue
                marks = np.append(0, np.cumsum([len(x.as_py().encode()) for x in data.slice(int(s), int(e - s))]))
                bag = bags(np.frombuffer("".join(data.slice(int(s), int(e - s)).to_pylist()).encode(), np.uint8), marks, idf.value)
                total = np.array([x[1].sum() for x in bag])
                for i in range(s, e):
                    near = np.minimum(total, total[i - s]) >= (threshold - 1e-9) * np.maximum(total, total[i - s])
                    near &= (own[s:e] != own[i]) | (p[s] == q[s])
                    for j in i + 1 + np.flatnonzero(near[i - s + 1:]):
                        if ids[i] == first[i] or ids[j] == first[j]:
                            continue        # compared in the first step
                        a, b = root(placed[i]), root(placed[j])
                        if a != b and similarity(bag[i - s], bag[j - s]) >= threshold:
                            parent[max(a, b)] = min(a, b)
                            pairs.append((ids[i], ids[j]))
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    cols = [*keys, "id", "first", "component", "own", "text"]
    return met.hint("merge").join(texts, "id").select(*cols).repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
