"""Language of a text by a small convolutional network over its bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelake.llm.common import arrow_schema, text_bytes

WINDOW = 128                # bytes the network sees at once
WIDTHS, FILTERS = (2, 3, 4), 8
EMBED = 6
SAMPLE_ROWS = 6_000         # labelled texts the network is fitted on, at most
SAMPLE_WINDOWS = 8          # of each such text, anywhere in it
DRAWN = 1 << 30             # parts of the hash by which texts are drawn
EPOCHS, BATCH, RATE = 4, 128, 0.004
UNDECIDED = "und"
PASS_WINDOWS = 2_048        # windows in memory at once


class ByteNet:
    """Byte embedding, filters of several widths, maximum over the window, softmax."""

    def __init__(self, languages: list[str], seed: int = 5):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                  "out": rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
                  "bias": np.zeros(len(languages), np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32)

    def hidden(self, windows):
        """windows x features, and for each the position of its maximum."""
        import numpy as np

        n, length = windows.shape
        features, places = [], []
        for w in WIDTHS:
            # each filter row applied to the embedding is a table by byte value
            tables = np.einsum("be,wef->wbf", self.p["embed"], self.p[f"f{w}"])
            size = length - w + 1
            total = tables[0][windows[:, :size]]
            for k in range(1, w):
                total += tables[k][windows[:, k:k + size]]
            places.append(total.argmax(axis=1))
            features.append(np.take_along_axis(total, places[-1][:, None, :], axis=1)[:, 0])
        return np.maximum(np.hstack(features), 0), places

    def features(self, windows):
        """As :meth:`hidden`, without the positions."""
        import numpy as np

        if not hasattr(self, "tables"):
            self.tables = {w: np.einsum("be,wef->wbf", self.p["embed"], self.p[f"f{w}"]).astype(np.float32) for w in WIDTHS}
        flat = np.ascontiguousarray(windows)
        out = []
        for w in WIDTHS:
            tables, size = self.tables[w], flat.shape[1] - w + 1
            total = np.take(tables[0], flat[:, :size], axis=0)
            for k in range(1, w):
                total += np.take(tables[k], flat[:, k:k + size], axis=0)
            out.append(total.max(axis=1))
        return np.maximum(np.hstack(out), 0)

    def logits(self, features):
        return features @ self.p["out"] + self.p["bias"]

    @staticmethod
    def softmax(x):
        import numpy as np

        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, windows, labels, epochs: int = EPOCHS, seed: int = 11):
        """Adam on cross entropy; the gradient flows to the bytes at each maximum."""
        import numpy as np

        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for s in range(0, len(order), BATCH):
                x, y = windows[order[s:s + BATCH]], labels[order[s:s + BATCH]]
                h, places = self.hidden(x)
                error = self.softmax(self.logits(h))
                error[np.arange(len(y)), y] -= 1
                error /= len(y)
                grad = {"out": h.T @ error, "bias": error.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
                back = (error @ self.p["out"].T) * (h > 0)
                rows = np.arange(len(x))[:, None]
                for i, w in enumerate(WIDTHS):
                    g, f = back[:, i * FILTERS:(i + 1) * FILTERS], np.zeros_like(self.p[f"f{w}"])
                    for k in range(w):
                        byte = x[rows, places[i] + k]                       # windows x filters
                        seen = self.p["embed"][byte]                        # windows x filters x embed
                        f[k] = np.einsum("nf,nfe->ef", g, seen)
                        np.add.at(grad["embed"], byte, g[:, :, None] * self.p[f"f{w}"][k].T[None])
                    grad[f"f{w}"] = f
                t += 1
                for k, g in grad.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    step = RATE * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
                    self.p[k] -= step.astype(np.float32)
        return self


def cut_windows(values, offsets, length: int = WINDOW):
    """(windows, row of each): every byte of every row, in windows of ``length``.

    A text's last window reaches back so that it is full; a shorter text is padded with zeros.
    """
    import numpy as np

    size = np.diff(offsets)
    count = -(-size // length)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = np.maximum(0, np.minimum(nth * length, size[row] - length))
    at = start[:, None] + np.arange(length)[None, :]
    inside = at < size[row][:, None]
    padded = np.append(values, np.zeros(1, np.uint8))
    return padded[np.where(inside, at + offsets[:-1][row][:, None], len(values))], row


def shares(counts: dict, total: int) -> dict:
    """How many of ``total`` each key gets: equal parts, but no more than it has; what it lacks goes to the others."""
    out, left = {}, total
    for i, (key, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[key] = min(n, -(-left // (len(counts) - i)))
        left -= out[key]
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        rows: int = SAMPLE_ROWS, seed: int = 3) -> ByteNet | None:
    """A network fitted on at most ``rows`` labelled texts, chosen by a hash; None without any.

    The bound is shared among the languages: those with few texts give all of
    them, the others as many each as are left. Of each text eight windows are
    learnt from, at places drawn by a hash over its whole length, or all of a
    text that is not longer. Predictions read whole texts.
    """
    import numpy as np

    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in known.groupBy(label_col).count().collect()}
    if not counts:
        return None
    quota = shares(counts, rows)
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    # tasks send about ``rows`` texts in all, however many tasks there are
    parts = {y: -(-q * DRAWN // counts[y]) for y, q in quota.items()}
    part = F.element_at(F.create_map(*[F.lit(v) for pair in parts.items() for v in pair]), F.col(label_col))
    data = F.encode(F.col(text_col), "UTF-8")
    drawn = known.where(F.pmod(order, F.lit(DRAWN)) < part).select(
        order.alias("o"), F.col(id_col).alias("i"), F.col(label_col).alias("y"), data.alias("data"), F.octet_length(data).alias("n"))
    places = [F.pmod(F.xxhash64(F.lit(j), "o"), F.col("n") - WINDOW + 1).cast("int") + 1 for j in range(SAMPLE_WINDOWS)]
    cuts = F.concat(*[F.substring(F.col("data"), p, WINDOW) for p in places])
    x = F.when(F.col("n") > WINDOW * SAMPLE_WINDOWS, cuts).otherwise(F.col("data"))
    sample = []
    for r in drawn.select("o", "i", "y", x.alias("x")).orderBy("o", "i", "x").limit(2 * rows).collect():
        if quota[r["y"]]:
            quota[r["y"]] -= 1
            sample.append(r)
    if not sample:
        return None
    languages = sorted({r["y"] for r in sample})
    values = np.frombuffer(b"".join(bytes(r["x"]) for r in sample), np.uint8)
    offsets = np.append(0, np.cumsum([len(r["x"]) for r in sample]))
    windows, row = cut_windows(values, offsets)
    labels = np.array([languages.index(r["y"]) for r in sample])[row]
    return ByteNet(languages).fit(windows, labels)


def predict(docs: DataFrame, net: ByteNet | None, *, id_col: str = "doc_id", text_col: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the ``keep`` columns, lang_pred and score for every row.

    All windows of a text are scored; the text's language is the one with the
    greatest mean probability, which is its score. Texts that are null or have
    no letter, and all texts when no network could be fitted, are ``und`` with
    score 0. The network is broadcast; its size does not depend on the data.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)
    kept = docs.select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).alias("text__"),
                       F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters__"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-2]) + ", lang_pred string, score double"
    out_schema = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = shared.value
        for b in batches:
            n = b.num_rows
            names, scores = np.full(n, UNDECIDED, object), np.zeros(n)
            letters = b.column("letters__").to_numpy(zero_copy_only=False).astype(bool)
            if model is not None and letters.any():
                values, offsets = text_bytes(b, "text__")
                total = np.zeros((n, len(model.languages)))
                count = np.zeros(n)
                for lo, hi in row_slices(offsets, PASS_WINDOWS * WINDOW):
                    part = values[offsets[lo]:offsets[hi]]
                    # a very long text is one slice of its own, cut into windows piece by piece
                    for begin in range(0, max(len(part), 1), PASS_WINDOWS * WINDOW):
                        piece = part[begin:begin + PASS_WINDOWS * WINDOW] if hi - lo == 1 else part
                        marks = np.array([0, len(piece)]) if hi - lo == 1 else offsets[lo:hi + 1] - offsets[lo]
                        windows, row = cut_windows(piece, marks)
                        if len(windows):
                            p = model.softmax(model.logits(model.features(windows)))
                            np.add.at(total, row + lo, p)
                            np.add.at(count, row + lo, 1)
                        if hi - lo > 1:
                            break
                mean = total / np.maximum(count, 1)[:, None]
                best = mean.argmax(axis=1)
                names = np.where(letters, np.array(model.languages, object)[best], UNDECIDED)
                scores = np.where(letters, mean[np.arange(n), best], 0.0)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array(names.tolist(), pa.string()), pa.array(scores)], schema=out_schema)

    return kept.mapInArrow(run, schema)


def row_slices(offsets, most_bytes: int):
    """(first, end) row ranges of at most ``most_bytes``; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = lo + 1
        while hi < n and offsets[hi + 1] - offsets[lo] <= most_bytes:
            hi += 1
        yield lo, hi
        lo = hi
