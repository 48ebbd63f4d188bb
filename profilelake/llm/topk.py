"""Exact top-k inner products over an impact-ordered index, score at a time.

A tile of candidates is indexed by dimension: its postings stand in segments of
falling quantised value. For a query, the segments of all dimensions are taken
by falling impact, the segment's bound times the query's weight. After some
segments every candidate has a score so far, and what the segments to come can
still add at most is known. Processing stops once it is proved that few
candidates can be among the best k; those are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilelake.llm.common import arrow_schema
from profilelake.operators.query_blocks import block_reader, written_blocks

TILE = 16_384               # candidates of one index in a task
TILES = 4                   # indexes a task holds while it goes through the queries
QUERY_BYTES = 32 << 20      # queries a task holds at once
LEVELS = 32                 # segments of a dimension, about
HITS = "query_id bigint, vec_id bigint, score bigint"


def clean(rows: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector exists and has only finite components."""
    return rows.where(F.col(vec).isNotNull() & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))


class ImpactIndex:
    """Postings of one tile by dimension, in segments of one quantised value each, falling."""

    def __init__(self, values, levels: int = LEVELS):
        import numpy as np

        n, self.dims = values.shape
        self.values = values
        if not values.size:
            return
        postings, dim, start, high, low = [], [], [], [], []
        for d in range(self.dims):
            own = np.argsort(-values[:, d], kind="stable")
            v = values[own, d]
            level = v // (int(v[0] - v[-1]) // levels + 1)
            first = np.append(0, np.flatnonzero(level[1:] != level[:-1]) + 1)
            postings.append(own)
            dim.append(np.full(len(first), d))
            start.append(first + d * n)
            high.append(v[first])
            low.append(v[np.append(first[1:], n) - 1])
        # one array of postings; a segment is a stretch of it
        self.postings, self.dim, self.start = (np.concatenate(x) for x in (postings, dim, start))
        self.high, self.low, self.end = np.concatenate(high), np.concatenate(low), np.append(self.start[1:], self.dims * n)

    def plan(self, query):
        """Segments of all dimensions by falling impact, with what is left to come after each."""
        import numpy as np

        weight = query[self.dim]
        a, b = weight * self.high, weight * self.low
        up, down = np.maximum(a, b), np.minimum(a, b)
        first = np.append(True, self.dim[1:] != self.dim[:-1])
        floor = np.minimum.reduceat(down, np.flatnonzero(first))
        gain = up - floor[self.dim]
        # the next segment of the same dimension, forwards or backwards by the sign of its weight
        zero = np.zeros(1, gain.dtype)
        after = np.where(np.append(first[1:], True), 0, np.append(gain[1:], zero))
        before = np.where(first, 0, np.append(zero, gain[:-1]))
        following = np.where(weight > 0, after, before)
        order = np.argsort(-gain, kind="stable")
        left = np.maximum.reduceat(gain, np.flatnonzero(first)).sum() - np.cumsum((gain - following)[order])
        return order, gain, up - down, left, floor.sum()

    def top(self, query, k: int, least=None):
        """(rows, scores): all candidates that can be among the best k, with exact scores.

        ``least``: a score that the best k of earlier tiles reach already.
        """
        import numpy as np

        n = len(self.values)
        if n < k and least is None or not self.values.size:
            return np.arange(n), self.values @ query
        order, gain, width, left, base = self.plan(query)
        score = np.full(n, base, gain.dtype)    # products seen so far, from above; the others at their least
        widest = np.zeros(self.dims, width.dtype)       # how far a seen product can lie below its segment's bound
        few, members, i = max(4 * k, n // 64), np.arange(n), 0
        starts, ends, dims, gains = (x[order].tolist() for x in (self.start, self.end, self.dim, gain))
        for stop in range(len(order) // 2, len(order) + len(order) // 16, max(1, len(order) // 16)):
            stop = min(stop, len(order))
            for j in range(i, stop):
                score[self.postings[starts[j]:ends[j]]] += gains[j]
            np.maximum.at(widest, self.dim[order[i:stop]], width[order[i:stop]])
            i = stop
            # a proved lower bound of the k-th best score
            proved = np.partition(score, n - k)[n - k] - widest.sum() if n >= k else least
            proved = proved if least is None else max(proved, least)
            members = np.flatnonzero(score + max(left[i - 1], 0) >= proved) if i else members
            if len(members) <= few or i == len(order):
                break
        return members, self.values[members] @ query


def top_k(rows: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec: str = "vector",
          tile: int = TILE, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Each query's k best candidates by integer inner product: query_id, rank, vec_id, score.

    Both tables hold integer vectors. Every row is a candidate of every query
    except those with the query's own id. Ties go to the smaller id, and rows
    with one id and score count once each. Of several query rows with one id,
    the one with the smallest vector asks. Fewer candidates give fewer rows;
    vectors of unequal length are compared over their common part; a null id
    takes no part, a null component counts as 0. Scores beyond 64 bits are cut
    to the ends of the range.

    Queries are written to the shared folder. A task indexes a few tiles of the
    candidates that lie in it, reads the queries in blocks of ``query_bytes``,
    and sends at most k rows of each for these tiles. Candidates are scanned
    once, without a shuffle; the driver and a broadcast hold no vector.
    """
    q = queries.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull())
    q = q.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(F.col(vec).cast("array<bigint>")).alias("v"))
    wanted = rows.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<bigint>").alias("v"))
    found = _scan(wanted, written_blocks(q, "v"), k, tile, query_bytes)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def integer_matrix(lists, width: int | None = None):
    """Rows of an Arrow list column as int64, cut or filled with zeros to ``width`` (the longest row's)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(pc.list_flatten(lists), 0).to_numpy(zero_copy_only=False)
    width = int(size.max(initial=0)) if width is None else width
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inside = column < width
    out[row[inside], column[inside]] = flat[inside]
    return out


def largest(values) -> float:
    """The largest magnitude in an integer matrix, 1 at least."""
    import numpy as np

    return float(max(1, np.abs(values.astype(np.float64)).max(initial=0)))


class Tile:
    """Some candidates, indexed when first asked: in 64 bits where no product or sum can pass them, else in exact Python numbers."""

    def __init__(self, ids, values):
        import numpy as np

        self.ids, self.values, self.most = ids, values, largest(values)
        self.sorted_ids, self.indexes = np.sort(ids), {}

    def index_for(self, asks):
        """(index, queries) in one kind of numbers."""
        import numpy as np

        kind = np.int64 if max(1, self.values.shape[1]) * self.most * largest(asks) < 2 ** 61 else object
        if kind not in self.indexes:
            self.indexes[kind] = ImpactIndex(self.values.astype(kind, copy=False))
        return self.indexes[kind], asks.astype(kind, copy=False)

    def rows_of(self, query_ids):
        """How many candidates have each query's own id."""
        import numpy as np

        return np.searchsorted(self.sorted_ids, query_ids, "right") - np.searchsorted(self.sorted_ids, query_ids, "left")


def best_of_tiles(tiles: list[Tile], query_ids, vectors, k: int):
    """(query, candidate, score) arrays: each query's k best among the candidates of some tiles."""
    import numpy as np

    best: dict[int, list] = {}          # place of the query -> (score, -id), best first, at most k
    for tile in tiles:
        index, asks = tile.index_for(integer_matrix(vectors, tile.values.shape[1]))
        own = tile.rows_of(query_ids).tolist()
        for i, query in enumerate(query_ids.tolist()):
            kept = best.get(i, [])
            # the query's own rows may stand among the best and fall out again
            members, scores = index.top(asks[i], k + own[i], kept[-1][0] if len(kept) == k else None)
            hits = [(min(max(int(s), -2 ** 63), 2 ** 63 - 1), -c) for c, s in zip(tile.ids[members].tolist(), scores.tolist()) if c != query]
            best[i] = sorted(kept + hits, reverse=True)[:k]
    counts = [len(best.get(i, ())) for i in range(len(query_ids))]
    flat = [x for hits in best.values() for x in hits]
    return (np.repeat(query_ids, counts), np.array([-c for _, c in flat], np.int64), np.array([s for s, _ in flat], np.int64))


def _scan(wanted: DataFrame, files: dict[int, list[str]], k: int, tile: int, query_bytes: int) -> DataFrame:
    schema = arrow_schema(HITS)
    read, lengths = block_reader(files, max(1, query_bytes // 8)), sorted(files)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def answered(tiles):
            for length in lengths:
                for asked in read(length):
                    columns = best_of_tiles(tiles, asked.column("id").to_numpy(), asked.column("v"), k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

        def made(parts):
            t = pa.Table.from_batches(parts)
            return Tile(t.column("id").to_numpy(), integer_matrix(t.column("v")))

        tiles, parts, n = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, tile - n)
                parts.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == tile:
                    tiles.append(made(parts))
                    parts, n = [], 0
                    if len(tiles) == TILES:
                        yield from answered(tiles)
                        tiles = []
        if parts:
            tiles.append(made(parts))
        if tiles:
            yield from answered(tiles)

    return wanted.mapInArrow(scan, HITS)
