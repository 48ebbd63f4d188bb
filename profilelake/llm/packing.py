"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelake.llm.common import arrow_schema, binary_array

WINDOW = 2048
END_ID = 1              # follows every document
MAX_OPEN = 4096         # open windows a task holds before it closes them by cutting (32 MB of ids)
SPECIAL = "<|endoftext|>"
EMIT_BYTES = 4 << 20    # ids of one outgoing batch

PIECES = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
          "sequence_length bigint, ids binary")


class LevelPacker:
    """Windows that are being filled, counted by their fill level.

    A document's whole windows are closed at once. Its rest goes to the level
    (0: a new window) that keeps the sum of squared level counts smallest; of
    equal levels the fullest. ``close`` cuts what the emptiest windows hold to
    fill the fullest ones; the tokens left at the end become windows whose
    lengths are powers of two, which need no padding.
    """

    def __init__(self, first_sequence: int, window: int = WINDOW, max_open: int = MAX_OPEN):
        import numpy as np

        self.window, self.max_open, self.next = window, max_open, first_sequence
        self.count = np.zeros(window + 1, np.int64)     # open windows by level
        self.open: list[list] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.done: list[tuple] = []                     # (doc, start, ids, doc_tokens, sequence, offset, sequence length)
        self.done_ids = 0

    def _emit(self, pieces: list[tuple]) -> None:
        at, length = 0, sum(len(p[2]) for p in pieces)
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, ids, total, self.next, at, length))
            at += len(ids)
        self.done_ids += length
        self.next += 1

    def level_for(self, size: int) -> int:
        import numpy as np

        after = 2 * self.count + 1
        after[self.window] = 0
        top = self.window - size
        change = np.where(self.count[1:top + 1] > 0, after[1 + size:] - 2 * self.count[1:top + 1] + 1, np.iinfo(np.int64).max)
        if not len(change):
            return 0
        best = top - int(np.argmin(change[::-1]))
        return best if change[best - 1] <= after[size] else 0

    def add(self, doc, ids) -> None:
        total, whole = len(ids), len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self._emit([(doc, start, ids[start:start + self.window], total)])
        rest = ids[whole:]
        if not len(rest):
            return
        level = self.level_for(len(rest))
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        pieces.append((doc, whole, rest, total))
        self._put(level + len(rest), pieces)
        if self.n_open > self.max_open:
            self.close(last=False)

    def _put(self, level: int, pieces: list[tuple]) -> None:
        if level == self.window:
            self._emit(pieces)
            return
        self.open[level].append(pieces)
        self.count[level] += 1
        self.n_open += 1

    def close(self, last: bool = True) -> None:
        held = [pieces for level in range(self.window - 1, 0, -1) for pieces in self.open[level]]   # fullest first
        self.open = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        self.n_open = 0
        stream, room, target = [], 0, None
        front, back = 0, len(held) - 1
        while front <= back:
            if target is None:
                target, front = held[front], front + 1
                room = self.window - sum(len(p[2]) for p in target)
            if not stream and front <= back:
                stream, back = held[back], back - 1
            while room and stream:
                doc, start, ids, total = stream.pop(0)
                target.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    stream.insert(0, (doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            if not room:
                self._emit(target)
                target = None
        left = (target or []) + stream      # the stream is empty while a target has room
        size = sum(len(p[2]) for p in left)
        if not last:
            if left:
                self._put(size, left)
            return
        while left:
            take, part = 1 << (size.bit_length() - 1), []
            size -= take
            while take:
                doc, start, ids, total = left.pop(0)
                part.append((doc, start, ids[:take], total))
                if len(ids) > take:
                    left.insert(0, (doc, start + take, ids[take:], total))
                take -= min(take, len(ids))
            self._emit(part)


def tokenizer(vocabulary: str):
    """text -> ids, as the published tokenizer file gives them.

    The vocabulary's rank file beside it (same name, ``.tiktoken``) holds the
    same merges and is read where it exists, as that library is about four
    times faster; tests compare both. The one special token inside a text
    becomes its id, as the tokenizer file has it.
    """
    import base64
    from pathlib import Path

    ranks_file = Path(vocabulary).with_suffix(".tiktoken")
    if ranks_file.exists():
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.read_bytes().splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={SPECIAL: len(ranks)})
        return lambda text: (encoding.encode(text, allowed_special="all") if SPECIAL in text
                             else encoding.encode_ordinary(text))
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(vocabulary)
    return lambda text: loaded.encode(text, add_special_tokens=False).ids


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """Pieces of all documents in windows of at most ``window`` ids.

    One row per piece: document id, start in the document's ids, length, the
    document's number of ids (end id included), window (``sequence_id``), offset
    there, the window's length, and the ids as little-endian unsigned 32-bit
    integers. Each id lies in exactly one piece.

    Documents are tokenised and packed where they are read: no shuffle, and a
    rerun of a task on the same split gives the same rows. Each task closes its
    open windows by cutting, so windows are shorter than ``window`` only at a
    power of two, at most once per power and task.

    A null or empty text is one end id. Repeated rows are packed as often as
    they occur; a null document id stays null. An empty table gives no rows.
    """
    schema = arrow_schema(PIECES)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = tokenizer(vocabulary)
        packer = LevelPacker(TaskContext.get().partitionId() << 33, window, max_open)

        def batch():
            done, packer.done, packer.done_ids = packer.done, [], 0
            lengths = np.array([len(p[2]) for p in done], np.int64)
            column = list(zip(*done))
            ids = np.concatenate(column[2]).astype("<u4", copy=False)
            return pa.RecordBatch.from_arrays(
                [pa.array(column[0], pa.int64()), pa.array(column[1], pa.int64()), pa.array(lengths),
                 pa.array(column[3], pa.int64()), pa.array(column[4], pa.int64()), pa.array(column[5], pa.int64()),
                 pa.array(column[6], pa.int64()),
                 binary_array(ids.view(np.uint8), np.append(0, np.cumsum(lengths * 4)))], schema=schema)

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                packer.add(doc.as_py(), np.array(ids, np.uint32))
                if packer.done_ids * 4 >= EMIT_BYTES:
                    yield batch()
        packer.close()
        if packer.done:
            yield batch()

    return rows.mapInArrow(run, PIECES)
