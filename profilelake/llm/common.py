"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contracts: space and the five ASCII control blanks.
BLANKS = r"\x20\x09-\x0D"


def arrow_schema(schema: str):
    """The Arrow form of a DDL schema, for functions that build record batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def crc_of_id(column: str):
    """crc32 of the id written as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_bytes(batch, column: str = "text"):
    """(values, offsets) of a text or binary column: all bytes, and where each row begins.

    Nulls are empty. No per-row Python objects are made.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    a = batch.column(column)
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type):
        wide, kind = np.int64, pa.large_binary()
    else:
        wide, kind = np.int32, pa.binary()
    if a.null_count:
        a = pc.fill_null(a, "" if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) else b"")
    a = a.cast(kind)
    _, offsets, data = a.buffers()
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    marks = np.frombuffer(offsets, dtype=wide)[a.offset:a.offset + len(a) + 1].astype(np.int64)
    values = np.frombuffer(data, dtype=np.uint8)[marks[0]:marks[-1]] if data is not None else np.zeros(0, np.uint8)
    return values, marks - marks[0]


def binary_array(data, offsets):
    """An Arrow binary array from one byte array and its row offsets."""
    import numpy as np
    import pyarrow as pa

    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def sorted_groups(batches: Iterator, keys: list[str]) -> Iterator[tuple]:
    """(table, bounds) of whole groups from batches sorted by ``keys``.

    A group that reaches into the next batch is held back until it is complete,
    so memory is one batch and one group. ``bounds`` has the first row of each
    group and the end.
    """
    import numpy as np
    import pyarrow as pa

    def bounds(table):
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held and all(held[0].column(k)[0] == t.column(k)[0] == t.column(k)[-1] for k in keys):
            held.append(t)      # still the same group
            continue
        t = pa.concat_tables([*held, t]).combine_chunks()
        b = bounds(t)
        held = [t.slice(int(b[-2]))]
        if len(b) > 2:
            yield t.slice(0, int(b[-2])), b[:-1]
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield t, bounds(t)


def least_labels(n: int, left, right):
    """For each of ``n`` nodes the smallest node reachable over the pairs (left, right)."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def shards(df: DataFrame, rows_each: int, least: int = 1) -> int:
    """How many shards of about ``rows_each`` rows ``df`` makes."""
    return max(least, -(-df.count() // rows_each))


def mixed(x):
    """64-bit numbers with their bits spread; distinct ones stay distinct."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BASE = 0x2545F4914F6CDD1D
_POWERS: list = []


def _powers(n: int):
    """Powers of the hash base and of its inverse modulo 2^64, kept for later calls."""
    import numpy as np

    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b))]))
                      for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def words(values, offsets):
    """(hash, row) of the words of each row, in order. Words end at ASCII white space and at their row's end."""
    import numpy as np

    n = len(values)
    blank = (values == 32) | ((values >= 9) & (values <= 13))
    first = np.zeros(n + 1, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    begins = np.flatnonzero(~blank & (np.append(True, blank[:-1])[:n] | first[:-1]))
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.flatnonzero(~blank & (np.append(blank[1:], True) | first[1:])) + 1
    # a word's hash: its bytes as a polynomial modulo 2^64, from prefix sums
    power, back = _powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power, out=prefix[1:])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(begins, offsets)))
    return mixed((prefix[ends] - prefix[begins]) * back[begins]), row


class KeyFilter:
    """Which 64-bit keys may be among those of a table: a Bloom filter of fixed size, whatever the table.

    It is built in tasks and broadcast (16 MB). With very many keys it lets
    more pass that are not in the table, never fewer that are.
    """

    BITS = 27
    PROBES = 4

    def __init__(self, keys: DataFrame, column: str, bits=None):
        """Over the keys of ``column``, and those of ``bits``, the words of another filter."""
        import numpy as np

        rows = keys.select(F.col(column).cast("bigint").alias("key")).mapInArrow(_set_words, "word int, bits bigint")
        rows = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words = np.zeros(1 << (self.BITS - 6), np.uint64) if bits is None else bits.copy()
        self.words[rows.column("word").to_numpy()] |= rows.column("bits").to_numpy().view(np.uint64)
        self.shared = keys.sparkSession.sparkContext.broadcast(self.words)

    @classmethod
    def places(cls, keys):
        import numpy as np

        for i in range(cls.PROBES):
            yield mixed(keys + np.uint64((i + 1) * 0xD1B54A32D192ED03 % (1 << 64))) >> np.uint64(64 - cls.BITS)

    @classmethod
    def test(cls, words, keys):
        """Whether each of ``keys`` passes, in a task."""
        import numpy as np

        ok = np.ones(len(keys), bool)
        for at in cls.places(keys):
            at = at[ok]
            ok[ok] = (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return ok

    def passes(self, column):
        """Whether a key passes, as a column."""
        shared = self.shared

        def inside(keys: pa.Array) -> pa.Array:
            return pa.array(KeyFilter.test(shared.value, keys.to_numpy(zero_copy_only=False).view("uint64")))

        inside = F.arrow_udf(inside, "boolean")
        return inside(column)


def _set_words(batches: Iterator) -> Iterator:
    """(word, bits) of the filter's 64-bit words that a batch of keys sets."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        at = np.unique(np.concatenate(list(KeyFilter.places(batch.column("key").drop_null().to_numpy().view(np.uint64)))))
        word, first = np.unique(at >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"])
