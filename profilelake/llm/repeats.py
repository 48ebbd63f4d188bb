"""Repeated passages of at least 200 bytes, by suffix arrays over shards of candidate text.

Every 200-byte string has one anchor: the k-gram with the smallest hash among
those inside it. Equal strings have equal anchors at the same place, so an
anchor that occurs once rules out all strings around it. Strings around an
anchor that occurs again are kept as a snippet. Equal snippets are merged and
counted; where an anchor has several different snippets, they go to a shard
whose suffix array, built by induced sorting, and permuted common prefixes say
which of their strings occur twice.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelake.llm.common import KeyFilter, arrow_schema, mixed, sorted_groups, text_bytes
from profilelake.llm.langid import row_slices
from profilelake.session import materialized

LENGTH = 200                # bytes of a string that must not repeat
GRAM = 32                   # bytes of an anchor
SLICE_BYTES = 1 << 19
GROUP_BYTES = 256 << 10     # snippets of one anchor that a shard takes; larger groups are halved
SHARD_BYTES = 1 << 20
BASE = 0x5851F42D4C957F2D


# ---------------------------------------------------------------- suffix arrays

def suffix_array(text):
    """Suffix array of a sequence of non-negative integers, by induced sorting.

    Suffixes are smaller (S) or larger (L) than the next one. The substrings
    between leftmost-smaller positions are sorted by inducing from their ends,
    named, and, while names repeat, sorted by the suffix array of the names;
    from their order all other suffixes follow by two more inducing scans.
    """
    import numpy as np

    text = np.asarray(text)
    n = len(text)
    if n < 2:
        return np.arange(n)
    # S where the next different value is larger; the end of the text counts as smallest
    change = np.flatnonzero(text[1:] != text[:-1])
    smaller = np.zeros(n, bool)
    if len(change):
        run_end = np.append(change, n - 1)
        rises = np.append(text[change] < text[change + 1], False)
        smaller = np.repeat(rises, np.diff(np.append(-1, run_end)))
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = _induce_wide if int(text.max()) < 512 else _induce_narrow
    if len(lms) == 0:
        return induce(text, smaller, lms)
    order = induce(text, smaller, lms[np.argsort(text[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sorted_lms = order[is_lms[order]]
    # name the substrings: equal neighbours share a name
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.append(lms, n)) + 1
    name_of = np.zeros(n, np.int64)
    same = _equal_neighbours(text, sorted_lms, length)
    name_of[sorted_lms] = np.cumsum(~same) - 1
    names = name_of[lms]
    if names.max() + 1 < len(lms):
        sorted_lms = lms[suffix_array(names)]
    return induce(text, smaller, sorted_lms)


def _equal_neighbours(text, starts, length):
    """For each start whether its substring equals that of the start before it."""
    import numpy as np

    n = len(text)
    same = np.zeros(len(starts), bool)
    a, b = starts[:-1], starts[1:]
    # a substring that runs to the end of the text is like no other
    live = np.flatnonzero((length[a] == length[b]) & (a + length[a] <= n) & (b + length[b] <= n)) + 1
    k = 0
    while len(live):
        ended = length[starts[live]] <= k
        same[live[ended]] = True
        live = live[~ended]
        if len(live):
            live = live[text[starts[live - 1] + k] == text[starts[live] + k]]
        k += 1
    return same


def _induce_wide(text, smaller, lms):
    """Inducing scans for few values: a bucket is scanned in rounds of whole arrays."""
    import numpy as np

    n, top = len(text), int(text.max()) + 1
    count = np.bincount(text, minlength=top)
    end = np.cumsum(count)
    begin = end - count
    out = np.full(n, -1, np.int64)

    def scatter(found, heads, step):
        """Appends positions to their buckets in the order given."""
        value = text[found]
        by = np.argsort(value, kind="stable")
        value, found = value[by], found[by]
        if not len(value):
            return
        at = np.append(0, np.flatnonzero(value[1:] != value[:-1]) + 1)
        kinds, size = value[at], np.diff(np.append(at, len(value)))
        nth = np.arange(len(found)) - np.repeat(at, size)
        if step > 0:
            out[heads[value] + nth] = found
            heads[kinds] += size
        else:
            out[heads[value] - 1 - nth] = found
            heads[kinds] -= size

    # larger suffixes, from small buckets to large ones
    heads = begin.copy()
    by_value = np.searchsorted(text[lms], np.arange(top + 1)) if len(lms) else np.zeros(top + 1, np.int64)
    scatter(np.array([n - 1]), heads, 1) if not smaller[n - 1] else None
    for c in range(top):
        done = begin[c]
        while done < heads[c]:
            part = out[done:heads[c]]
            done = heads[c]
            part = part[part > 0] - 1
            scatter(part[~smaller[part]], heads, 1)
        part = lms[by_value[c]:by_value[c + 1]]
        part = part[part > 0] - 1
        scatter(part[~smaller[part]], heads, 1)
    # smaller suffixes, from large buckets to small ones
    heads = end.copy()
    large_end = begin + np.bincount(text[~smaller], minlength=top)
    for c in range(top - 1, -1, -1):
        done = end[c]
        while done > heads[c]:
            part = out[heads[c]:done][::-1]
            done = heads[c]
            part = part[part > 0] - 1
            scatter(part[smaller[part]], heads, -1)
        part = out[begin[c]:large_end[c]][::-1]
        part = part[part > 0] - 1
        scatter(part[smaller[part]], heads, -1)
    return out


def _induce_narrow(text, smaller, lms):
    """The same scans for many values, one suffix at a time."""
    import numpy as np

    n = len(text)
    count = np.bincount(text)
    end = np.cumsum(count)
    values, small = text.tolist(), smaller.tolist()
    out = [-1] * n
    tails = end.tolist()
    for p in lms[::-1].tolist():
        tails[values[p]] -= 1
        out[tails[values[p]]] = p
    heads = (end - count).tolist()
    last = n - 1
    if not small[last]:
        out[heads[values[last]]] = last
        heads[values[last]] += 1
    for i in range(n):
        p = out[i] - 1
        if p >= 0 and not small[p]:
            v = values[p]
            out[heads[v]] = p
            heads[v] += 1
    tails = end.tolist()
    for i in range(n - 1, -1, -1):
        p = out[i] - 1
        if p >= 0 and small[p]:
            v = values[p]
            tails[v] -= 1
            out[tails[v]] = p
    return np.array(out, np.int64)


def permuted_prefixes(text, order, most: int):
    """Common prefix of each suffix with the one before it in ``order``, by text position (values from 1).

    Cut at ``most`` and rounded down to whole steps of four values; pairs are
    compared a step at a time in whole arrays, and those that differ fall out.
    """
    import numpy as np

    n = len(text)
    before = np.full(n, n, np.int64)
    before[order[1:]] = order[:-1]
    wide = np.concatenate([np.asarray(text), np.zeros(most + 4, np.int64)]).astype(np.uint64)
    four = wide[:-3] | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(32) | wide[3:] << np.uint64(48)
    common = np.zeros(n, np.int64)
    live = np.flatnonzero(before < n)
    for k in [*range(0, most - 3, 4), *([most - 4] if most % 4 else [])]:
        equal = four[live + k] == four[before[live] + k]
        common[live[~equal]] = k
        live = live[equal]
        if not len(live):
            break
    common[live] = most
    return common


# ---------------------------------------------------------------- anchors

def anchors(values, offsets, length: int, gram: int):
    """(row, anchor position, anchor hash, first start, starts) of every row's strings.

    Each run of consecutive ``length``-byte strings with the same anchor is one row of the result.
    """
    import numpy as np

    n = len(values)
    none = tuple(np.zeros(0, np.int64) for _ in range(2)) + (np.zeros(0, np.uint64),) + tuple(np.zeros(0, np.int64) for _ in range(2))
    if n < length:
        return none
    # hash of each gram by doubling: gram is a power of two
    h = mixed(values.astype(np.uint64) + np.uint64(BASE))
    size = 1
    while size < gram:
        h = h[:-size] * np.uint64(BASE | 1) + h[size:]
        h ^= h >> np.uint64(32)
        size *= 2
    h = mixed(h)
    # minimum over the grams of a string, leftmost of equals: position packed below the hash
    width = length - gram + 1
    low = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
    best, span = low, 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    best = np.minimum(best[:len(best) - (width - span)], best[width - span:])
    place = (best & np.uint64(0xFFFFF)).astype(np.int64)
    start = np.arange(len(place))
    row = np.searchsorted(offsets, start, side="right") - 1
    inside = start + length <= offsets[row + 1]
    start, place, row = start[inside], place[inside], row[inside]
    if not len(start):
        return none
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    runs = np.diff(np.append(new, len(start)))
    first = start[new]
    return row[new], place[new], h[place[new]], first, runs


ANCHOR = "doc bigint, print bigint, anchor bigint, snippet bigint, place bigint"
PLACE = 10                  # bits of the number of strings and of the anchor's place in a snippet; the rest is its start
NO_ID = -(1 << 63)          # stands for a null id inside; such rows differ by their text


def _anchor_rows(base: DataFrame, length: int, gram: int) -> DataFrame:
    out = arrow_schema(ANCHOR)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for b in batches:
            values, offsets = text_bytes(b)
            docs, prints = b.column("doc"), b.column("print")
            for lo, hi in row_slices(offsets, SLICE_BYTES):
                if hi - lo == 1:    # a long text in pieces that share length - 1 bytes
                    whole = values[offsets[lo]:offsets[hi]]
                    pieces = [(s, whole[s:s + SLICE_BYTES + length - 1]) for s in range(0, max(1, len(whole) - length + 1), SLICE_BYTES)]
                else:
                    pieces = [(0, values[offsets[lo]:offsets[hi]])]
                for shift, part in pieces:
                    marks = np.array([0, len(part)]) if hi - lo == 1 else offsets[lo:hi + 1] - offsets[lo]
                    row, place, anchor, first, starts = anchors(part, marks, length, gram)
                    if not len(row):
                        continue
                    data = part.tobytes()
                    # the snippet is told apart by its bytes and by where the anchor stands in it
                    snippet = np.fromiter(
                        (xxh3_64_intdigest(data[f:f + c + length - 1], p - f) for f, c, p in zip(first.tolist(), starts.tolist(), place.tolist())),
                        np.uint64, len(row))
                    take = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays(
                        [docs.take(take), prints.take(take), pa.array(anchor.view(np.int64)), pa.array(snippet.view(np.int64)),
                         pa.array((first - marks[row] + shift) << 2 * PLACE | starts << PLACE | (place - first))], schema=out)

    return base.mapInArrow(run, ANCHOR)


def repeated_starts(bag: list[tuple[bytes, int]], length: int):
    """For each (snippet, starts): a boolean array, which of its strings occur at another place of the bag."""
    import numpy as np

    sizes = np.array([len(s) for s, _ in bag])
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    text = np.zeros(ends[-1], np.int64)
    for (s, _), at in zip(bag, begins):
        text[at:at + len(s)] = np.frombuffer(s, np.uint8)
    text += 1
    text[ends - 1] = 0          # separators; no string reaches over one, see below
    order = suffix_array(text)
    common = permuted_prefixes(text, order, length)
    # a common prefix counts up to the end of its own snippet
    room = np.repeat(ends - 1, sizes + 1) - np.arange(len(text))
    whole = (common >= length) & (room >= length)
    twice = whole.copy()
    before = np.zeros(len(text), np.int64)
    before[order[1:]] = order[:-1]
    twice[before[whole]] = True
    return [twice[at:at + count] for (_, count), at in zip(bag, begins)]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM,
                   digest: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, spans, and the kept bytes as ``kept``.

    ``spans`` are the maximal byte ranges [start, end) that are covered by a
    ``length``-byte string which also starts anywhere else in the table, the
    same text included; ``kept`` is the rest, joined. Strings are judged on the
    input. Null and empty texts have no bytes; a text shorter than ``length``
    keeps all. With ``digest``, ``kept`` is the kept bytes' SHA-256, so that
    results are written without the texts. Repeated rows are separate documents, so they lose everything
    from ``length`` bytes on. A null id stays null.

    Anchors are counted with partial sums and joined back; that join may be
    split by the engine, so an anchor of very many documents fills no task.
    Snippet groups too large for a shard are halved, each half with a longer
    anchor, until they fit: what is common merges and what is not parts. Texts
    are shuffled once.
    """
    if not gram <= length < 1 << PLACE or gram & (gram - 1):
        raise ValueError("the anchor's length is a power of two, at most the string's, which is below 1024")
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(F.col(text_col)).alias("print"), F.col(text_col).alias("text"))
    found = materialized(_anchor_rows(base.select("doc", "print", "text"), length, gram))
    again = found.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("snippet").alias("low"), F.max("snippet").alias("high")).where("n > 1")
    # written, so that both sides of the join are plain shuffles, which the engine can split where an anchor is hot
    again = materialized(again.select("anchor", (F.col("low") != F.col("high")).alias("mixed")))
    low = (1 << PLACE) - 1
    # anchors that occur once hardly reach the join
    here = found.where(KeyFilter(again, "anchor").passes("anchor")).join(again, "anchor").select(
        "doc", "print", "anchor", "snippet", "mixed", F.shiftright("place", 2 * PLACE).cast("int").alias("start"),
        F.shiftright("place", PLACE).bitwiseAND(F.lit(low)).cast("int").alias("starts"), F.col("place").bitwiseAND(F.lit(low)).cast("int").alias("at"))
    # equal snippets only: all their strings repeat; otherwise the bytes decide
    marks = here.groupBy("doc", "print").agg(
        # sets, since repeated rows have the same marks
        F.collect_set(F.when(~F.col("mixed"), F.struct("start", "starts"))).alias("sure"),
        F.collect_set(F.when(F.col("mixed"), F.struct("anchor", "snippet", "start", "starts", "at"))).alias("open"))
    marked = base.join(marks, ["doc", "print"], "left").select("id", "doc", "print", "text", "sure", "open")
    state = materialized(_settle(marked, length, digest))
    unsettled = state.where("open IS NOT NULL")

    uses = unsettled.select("doc", "print", F.col("text").cast("binary").alias("data"), F.explode("open").alias("o")).select(
        "doc", "print", "o.*", F.substring("data", F.col("o.start") + 1, F.col("o.starts") + length - 1).alias("bytes"))
    snippets = materialized(uses.groupBy("anchor", "snippet").agg(
        F.count(F.lit(1)).alias("n"), F.min("starts").alias("starts"), F.min("at").alias("at"), F.min("bytes").alias("bytes")))
    repeats = _repeats(snippets, length, gram).where("count > 0")
    ranges = uses.drop("bytes", "starts").join(repeats, ["anchor", "snippet"]).groupBy("doc", "print").agg(
        F.collect_set(F.struct((F.col("start") + F.col("first")).alias("start"), F.col("count").alias("starts"))).alias("more"))
    rest = unsettled.join(ranges, ["doc", "print"], "left").select(
        "id", "doc", "print", "text", F.concat("sure", F.coalesce("more", F.array().cast(SURE_TYPE))).alias("sure"),
        F.lit(None).cast(OPEN_TYPE).alias("open"))
    columns = ["id", "n_bytes", "spans", "kept"]
    done = state.where("open IS NULL").select(*columns).unionByName(_settle(rest, length, digest).select(*columns))
    return done.withColumnRenamed("id", id_col)


SURE_TYPE = "array<struct<start:int,starts:int>>"
OPEN_TYPE = "array<struct<anchor:bigint,snippet:bigint,start:int,starts:int,at:int>>"


def _settle(marked: DataFrame, length: int, digest: bool) -> DataFrame:
    """Spans and kept bytes of rows without open snippets; the others go on with their text."""
    schema = ("id bigint, doc bigint, print bigint, n_bytes bigint, spans array<struct<start:bigint,`end`:bigint>>, "
              f"kept {'string' if digest else 'binary'}, text string, sure {SURE_TYPE}, open {OPEN_TYPE}")
    out = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            values, offsets = text_bytes(b)
            n = b.num_rows
            is_open = pc.fill_null(pc.greater(pc.list_value_length(b.column("open")), 0), False).to_numpy(zero_copy_only=False)
            sure, spans, kept = b.column("sure"), [None] * n, [None] * n
            for i in np.flatnonzero(~is_open).tolist():
                data = values[offsets[i]:offsets[i + 1]]
                spans[i], cuts = [], sure[i].as_py()
                if cuts:
                    first, last = None, None
                    for c in sorted((c["start"], c["start"] + c["starts"] - 1 + length) for c in cuts):
                        if first is None or c[0] > last:
                            if first is not None:
                                spans[i].append({"start": first, "end": last})
                            first, last = c
                        else:
                            last = max(last, c[1])
                    spans[i].append({"start": first, "end": last})
                    at, parts = 0, []
                    for x in spans[i]:
                        parts.append(data[at:x["start"]])
                        at = x["end"]
                    data = np.concatenate([*parts, data[at:]])
                kept[i] = hashlib.sha256(data).hexdigest() if digest else data.tobytes()
            only = pa.array([i if o else None for i, o in enumerate(is_open.tolist())], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("doc"), b.column("print"), pa.array(np.diff(offsets)), pa.array(spans, out.field("spans").type),
                 pa.array(kept, out.field("kept").type), b.column("text").take(only).cast(pa.string()),
                 sure.take(only).cast(out.field("sure").type), b.column("open").take(only).cast(out.field("open").type)], schema=out)

    return marked.mapInArrow(run, schema)


def _repeats(snippets: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, snippet, first, count): runs of strings of a snippet that occur at another place too."""
    result = ["anchor", "snippet", "first", "count"]
    copies = snippets.where("n > 1").select("anchor", "snippet", F.lit(0).alias("first"), F.col("starts").alias("count"))
    # A part holds the strings whose anchor lies lo to hi bytes after their start; its group has the range r0 to r1.
    parts = snippets.select(
        F.col("anchor").alias("key"), F.lit(0).alias("r0"), F.lit(length - gram + 1).alias("r1"), "anchor", "snippet", "at", "n",
        (F.col("at") - F.col("starts") + 1).alias("lo"), F.col("at").alias("hi"), "bytes")
    # Halved once before anything is compared: most snippets share no more than their anchor.
    parts = _halves(parts, length)
    out, shards = copies, []
    while True:
        size = materialized(parts.groupBy("key").agg(
            F.sum("n").alias("total"), F.min(F.xxhash64("bytes", "hi")).alias("low"), F.max(F.xxhash64("bytes", "hi")).alias("high"),
            F.sum(F.length("bytes")).alias("size")).where("total > 1"))
        met = parts.join(size, "key")
        equal, large = F.col("low") == F.col("high"), (F.col("size") > GROUP_BYTES) & (F.col("r1") - F.col("r0") > 1)
        met = materialized(met.select(      # equal parts need no bytes any more
            *[c for c in parts.columns if c != "bytes"], F.when(~equal, F.col("bytes")).alias("bytes"), equal.alias("equal"), (~equal & large).alias("large")))
        out = out.unionByName(met.where("equal").select(
            "anchor", "snippet", (F.col("at") - F.col("hi")).alias("first"), (F.col("hi") - F.col("lo") + 1).alias("count")))
        shards.append(met.where("NOT equal AND NOT large"))
        large = met.where("large")
        if large.isEmpty():
            break
        parts = _halves(large, length)
    todo = shards[0]
    for s in shards[1:]:
        todo = todo.unionByName(s)
    return out.unionByName(_by_suffix_array(todo, length).select(*result))


def _halves(parts: DataFrame, length: int) -> DataFrame:
    """Each part cut at the middle of its group's range; a half's key is a longer anchor, the bytes all its strings have."""
    middle = F.floor((F.col("r0") + F.col("r1")) / 2).cast("int")
    halves = parts.withColumn("half", F.explode(F.array(
        F.struct(F.col("r0").alias("from"), middle.alias("to")), F.struct(middle.alias("from"), F.col("r1").alias("to")))))
    halves = halves.withColumns({"low": F.greatest("lo", "half.from"), "high": F.least("hi", F.col("half.to") - 1)}).where("low <= high")
    halves = halves.withColumn("own", F.substring("bytes", F.col("hi") - F.col("high") + 1, F.col("high") - F.col("low") + length))
    core = F.substring("own", F.col("high") - F.col("half.from") + 1, F.col("half.from") - F.col("half.to") + 1 + length)
    return halves.select(
        F.xxhash64("key", "half.from", "half.to", core).alias("key"), F.col("half.from").alias("r0"), F.col("half.to").alias("r1"),
        "anchor", "snippet", "at", "n", F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("own").alias("bytes"))


def _by_suffix_array(parts: DataFrame, length: int) -> DataFrame:
    schema = "anchor bigint, snippet bigint, first int, count int"
    out = arrow_schema(schema)
    size = parts.agg(F.sum(F.length("bytes")).alias("n")).first()["n"] or 0
    rows = parts.select("key", "anchor", "snippet", "at", "lo", "hi", "bytes")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def solve(held):
            # equal parts are one string with several owners
            table = pa.concat_tables(held)
            data, lo, hi, at = (table.column(c).to_pylist() for c in ("bytes", "lo", "hi", "at"))
            keys = table.column("key").to_pylist()
            distinct: dict = {}
            which = [distinct.setdefault((k, x), len(distinct)) for k, x in zip(keys, data)]
            owners = np.bincount(which)
            bag = [(x, len(x) - length + 1) for _, x in distinct]
            twice = repeated_starts(bag, length)
            anchor, snippet, first, count = [], [], [], []
            owner_anchor, owner_snippet = table.column("anchor").to_pylist(), table.column("snippet").to_pylist()
            for i, w in enumerate(which):
                flags = np.ones(len(twice[w]), bool) if owners[w] > 1 else twice[w]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    anchor.append(owner_anchor[i])
                    snippet.append(owner_snippet[i])
                    first.append(at[i] - hi[i] + s)
                    count.append(e - s)
            return pa.RecordBatch.from_arrays(
                [pa.array(anchor, pa.int64()), pa.array(snippet, pa.int64()), pa.array(first, pa.int32()), pa.array(count, pa.int32())], schema=out)

        held, bytes_held = [], 0
        for table, bounds in sorted_groups(batches, ["key"]):
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                held.append(table.slice(s, e - s))
                bytes_held += (e - s) * 2 * length
                if bytes_held >= SHARD_BYTES:
                    yield solve(held)
                    held, bytes_held = [], 0
        if held:
            yield solve(held)

    n = max(1, -(-size // SHARD_BYTES))
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, schema)
