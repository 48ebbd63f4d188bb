"""Text quality by similarity-weighted votes of labelled neighbours in a latent space."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelake.llm.common import arrow_schema, text_bytes, words
from profilelake.llm.langid import row_slices

PAIRS = 2048                # hashed byte pairs
SHAPES = 3                  # words like the one before, pairs of capitals, pairs of signs
FEATURES = PAIRS + SHAPES
SHAPE_WEIGHT = 9            # a shape counts as so many byte pairs
TOPICS = 48                 # dimensions of the latent space
ITERATIONS = 12             # of the search for them
NEIGHBOURS = 15
SHARPNESS = 8               # a neighbour's vote is its cosine to this power
SAMPLE_ROWS = 4_096         # labelled texts that are broadcast, at most (0.8 MB of vectors)
BLOCK_ROWS = 512            # documents whose products with all labelled vectors are in memory at once
SLICE_BYTES = 2 << 20


def text_counts(values, offsets):
    """rows x FEATURES: square roots of the counts of hashed byte pairs and of shapes, by row."""
    import numpy as np

    n = len(offsets) - 1
    if len(values) < 2:
        return np.zeros((n, FEATURES), np.float32)
    pair = (values[:-1].astype(np.uint32) << 8) | values[1:]
    # multiplicative hash of 16 bits to 11
    feature = ((pair * np.uint32(2654435769)) >> np.uint32(21)).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    inside = row[:-1] == row[1:]
    cell = (row[:-1] * PAIRS + feature)[inside]
    counts = np.zeros((n, FEATURES), np.float32)
    counts[:, :PAIRS] = np.bincount(cell, minlength=n * PAIRS).reshape(n, PAIRS)
    word, owner = words(values, offsets)
    again = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    capital = (values >= 65) & (values <= 90)
    sign = (values > 32) & (values < 127) & ~capital & ~((values >= 97) & (values <= 122)) & ~((values >= 48) & (values <= 57))
    counts[:, PAIRS] = np.bincount(owner[1:][again], minlength=n)
    for k, kind in enumerate((capital, sign), PAIRS + 1):
        counts[:, k] = np.bincount(row[:-1][kind[:-1] & kind[1:] & inside], minlength=n)
    counts[:, PAIRS:] *= SHAPE_WEIGHT
    return np.sqrt(counts)


def feature_blocks(batch, column: str) -> Iterator[tuple]:
    """(first, end, features) of a batch's rows; a longer text is counted piece by piece."""
    import numpy as np

    values, offsets = text_bytes(batch, column)
    for lo, hi in row_slices(offsets, SLICE_BYTES):
        for s in range(lo, hi, BLOCK_ROWS):
            e = min(hi, s + BLOCK_ROWS)
            part, marks = values[offsets[s]:offsets[e]], offsets[s:e + 1] - offsets[s]
            if e - s == 1 and len(part) > SLICE_BYTES:
                counts = np.zeros((1, FEATURES), np.float64)
                for begin in range(0, len(part), SLICE_BYTES):
                    piece = part[begin:begin + SLICE_BYTES + 1]     # one byte over, for the pair across the cut
                    counts += text_counts(piece, np.array([0, len(piece)])).astype(np.float64) ** 2
                yield s, e, np.sqrt(counts).astype(np.float32)
            else:
                yield s, e, text_counts(part, marks)


def leading(rows, topics: int):
    """The ``topics`` leading right singular vectors, by subspace iteration: no matrix of columns by columns is made."""
    import numpy as np

    width = min(topics + 16, rows.shape[1])
    basis = np.random.default_rng(0).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(ITERATIONS):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    inner = (rows @ basis).astype(np.float64)
    turn = np.linalg.eigh(inner.T @ inner)[1][:, ::-1][:, :topics]
    return (basis @ turn).astype(np.float32)


class NeighbourVote:
    """Latent-semantic vectors of labelled texts, and the vote over them."""

    def __init__(self, counts, labels):
        import numpy as np

        labels = np.asarray(labels, np.float32)
        df = (counts > 0).sum(axis=0)
        self.idf = np.log((1 + len(counts)) / (1 + df)).astype(np.float32) + 1
        weighted = np.empty_like(counts)
        for at in range(0, len(counts), BLOCK_ROWS):
            weighted[at:at + BLOCK_ROWS] = self.weigh(counts[at:at + BLOCK_ROWS])
        self.basis = leading(weighted, TOPICS)
        self.known = self.unit(weighted @ self.basis)
        self.labels, self.prior = labels, float(labels.mean())

    @staticmethod
    def unit(x):
        import numpy as np

        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def weigh(self, counts):
        return self.unit(counts * self.idf)

    def score(self, counts):
        """Weighted share of label 1 among the nearest; the prior where a text has no features."""
        import numpy as np

        latent = self.unit(self.weigh(counts) @ self.basis)
        cosine = latent @ self.known.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior).clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        rows: int = SAMPLE_ROWS, seed: int = 3) -> NeighbourVote | None:
    """A vote over at most ``rows`` labelled texts, chosen by a hash of the id; None without any.

    The sample is chosen on the narrow label table and broadcast (its bound is
    ``rows``); texts are turned to counts where they are read.
    """
    import numpy as np

    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(
        F.min(label_col).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(rows)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").join(F.broadcast(chosen), "i")
    schema = "i bigint, y double, counts binary"
    out = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for s, e, counts in feature_blocks(b, "t"):
                part = b.slice(s, e - s)
                yield pa.RecordBatch.from_arrays(
                    [part.column("i").cast(pa.int64()), part.column("y"), pa.array([c.tobytes() for c in counts], pa.binary())], schema=out)

    # one text per id, the first by its counts
    sample = texts.select("i", "y", "t").mapInArrow(run, schema).groupBy("i").agg(F.min("y").alias("y"), F.min("counts").alias("counts"))
    # the bound is ``rows``: 33 MB
    got = sample.orderBy("i").toArrow()
    if not got.num_rows:
        return None
    counts = np.empty((got.num_rows, FEATURES), np.float32)
    at = 0
    for chunk in got.column("counts").chunks:
        counts[at:at + len(chunk)] = np.frombuffer(chunk.buffers()[2], np.float32, len(chunk) * FEATURES, chunk.offset * FEATURES * 4).reshape(-1, FEATURES)
        at += len(chunk)
    labelled = got.column("y").to_numpy()
    del got, chunk
    return NeighbourVote(counts, labelled)


def score(docs: DataFrame, model: NeighbourVote | None, *, text_col: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with ``column``, 0 to 1: how likely label 1 is.

    Whole texts are read, in place, without a shuffle; the labelled vectors are
    broadcast. Null and empty texts, and all texts without a model, get the
    labels' mean (0.5 without a model). Rows and other columns stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    schema = ", ".join(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)) + ", score double"
    out = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        vote = shared.value
        for b in batches:
            scores = np.full(b.num_rows, 0.5)
            if vote is not None:
                for s, e, counts in feature_blocks(b, f"c{place}"):
                    scores[s:e] = vote.score(counts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], schema=out)

    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return named.mapInArrow(run, schema).toDF(*docs.columns, column)
