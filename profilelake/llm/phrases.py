"""Phrase mining: frequent word sequences by mergeable Misra-Gries summaries, then counted exactly and scored."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelake.llm.common import KeyFilter, mixed
from profilelake.operators.ranking import top_n_per_key
from profilelake.session import materialized

LONGEST = 5                 # words of a phrase
LEAST = 100                 # occurrences of a phrase that counts
COVERED = 100               # a longer phrase with so many hundredths of a shorter one's occurrences covers it
SCALE = 1000                # of the score
FIRST = 2000                # phrases per language
COUNTERS = 1 << 20          # counters of a hash partition's summary (16 MB)
HEADROOM = 4                # counters there are for each that the guarantee needs
GATHERED = 1 << 22          # sequences a task counts before it sends them
SLICE_BYTES = 2 << 20       # text cut into words at a time
SURVIVORS_EACH = 1 << 18    # phrases whose exact counts one task adds up
END = b"."                  # stands for any sign that ends a piece

_TABLE = bytes(46 if c in b".,;:!?" or 10 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Hashes(dict):
    """64-bit hashes of words, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1 << 18:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def token_slices(texts: Iterator[bytes]) -> Iterator[tuple[list[bytes], int]]:
    """(tokens, lead): words and END signs of about SLICE_BYTES of text.

    Short texts share a slice, parted by END. A longer text is cut between words;
    the ``lead`` tokens of the slice before are repeated, so that sequences over
    the cut are seen: those whose last word lies after the lead are new.
    """
    held, size = [], 0
    for text in texts:
        if len(text) > SLICE_BYTES:
            carry: list[bytes] = []
            at, text = 0, text.translate(_TABLE)
            while at < len(text):
                cut = at + SLICE_BYTES
                ends = [x for x in (text.find(c, cut) for c in (b" ", b"\t", END)) if x >= 0] if cut < len(text) else []
                cut = min(ends) if ends else len(text)
                tokens = carry + text[at:cut].replace(END, b" . ").split()
                yield tokens, len(carry)
                carry, at = tokens[-(LONGEST - 1):], cut
            continue
        held.append(text)
        size += len(text)
        if size >= SLICE_BYTES:
            yield _joined(held), 0
            held, size = [], 0
    if held:
        yield _joined(held), 0


def _joined(texts: list[bytes]) -> list[bytes]:
    return END.join(texts).translate(_TABLE).replace(END, b" . ").split()


def by_language(batch) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """(language, texts) of a batch with the columns lang and text, neither null."""
    import numpy as np
    import pyarrow.compute as pc

    lang = pc.dictionary_encode(batch.column("lang"))
    codes, texts = lang.indices.to_numpy(), batch.column("text").cast("binary")
    for code, name in enumerate(lang.dictionary.to_pylist()):
        yield name, (texts[int(i)].as_py() for i in np.flatnonzero(codes == code))


def sequences(tokens: list[bytes], lead: int, lang: str, hashes: _Hashes, bits=None, tested: int = 0) -> Iterator[tuple[int, object, object]]:
    """(n, starts, keys): where sequences of n = 1 to LONGEST words start, and their 64-bit hashes with the language's.

    With a filter, sequences of up to ``tested`` words must pass it, longer ones
    be made of such: a frequent sequence has frequent parts.
    """
    import numpy as np
    import xxhash

    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    word = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    ends = word == np.uint64(hashes[END])
    here, n = np.flatnonzero(~ends), 1
    key = mixed(word[here] ^ seed)
    while len(here):
        if n <= tested:
            ok = KeyFilter.test(bits, key)
            here, key = here[ok], key[ok]
        new = here + n > lead           # the last word lies after the lead
        yield n, here[new], key[new]
        if n == LONGEST:
            return
        alive = np.zeros(len(word) + 1, bool)
        alive[here] = True
        longer = alive[here + 1]        # the rest is one of those found, too
        here, key = here[longer], key[longer]
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + word[here + n])
        n += 1


# ------------------------------------------------------------ first pass

def merged(left, right):
    """(keys, counts) of two summaries together."""
    import numpy as np

    keys, at = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([left[1], right[1]]), minlength=len(keys)).astype(np.int64)


def reduced(keys, counts, capacity: int, spent: int, least: int):
    """(keys, counts, spent) with at most ``capacity`` counters, unless ``spent`` would reach ``least``.

    The count of the first key beyond the capacity is taken from all; ``spent``
    is what all of them have lost so, the most that any true count can exceed its counter.
    """
    import numpy as np

    if len(keys) <= capacity:
        return keys, counts, spent
    cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    if spent + cut >= least:
        return keys, counts, spent
    kept = counts > cut
    return keys[kept], counts[kept] - cut, spent + cut


def _local_counts(parts: int, lengths: tuple[int, int], shared=None):
    """Task function: (part, keys, counts) of the sequences of each hash partition, counted in the task first.

    Sequences have between ``lengths`` words; what is shorter must pass the filter that is shared.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hashes, gathered, size = _Hashes(), [], 0

        def sent():
            keys, counts = np.unique(np.concatenate(gathered), return_counts=True)
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, keys[order[a:b]], counts[order[a:b]]) for p, a, b in zip(range(parts), bounds[:-1], bounds[1:]) if b > a]
            return pa.RecordBatch.from_arrays([
                pa.array([p for p, _, _ in rows], pa.int32()), pa.array([k.tobytes() for _, k, _ in rows], pa.binary()),
                pa.array([c.astype(np.int32).tobytes() for _, _, c in rows], pa.binary())], names=["part", "keys", "counts"])

        for batch in batches:
            for lang, texts in by_language(batch):
                for tokens, lead in token_slices(texts):
                    for n, _, keys in sequences(tokens, lead, lang, hashes, shared and shared.value, lengths[0] - 1):
                        if n > lengths[1]:
                            break
                        if n >= lengths[0]:
                            gathered.append(keys)
                            size += len(keys)
                    if size >= GATHERED:
                        yield sent()
                        gathered, size = [], 0
        if size:
            yield sent()

    return run


def _survivors(capacity: int, least: int):
    """Task function: keys of a hash partition that may have ``least`` occurrences, from summaries merged in turn."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def kept(part, summary, spent):
            keys = summary[0][summary[1] + spent >= least]
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        of, summary, spent, waiting, rows = None, none, 0, [], 0

        def taken():
            both = merged(summary, (np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))) if waiting else summary
            return reduced(*both, capacity, spent, least)

        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column("part")[i].as_py()
                if part != of:
                    if of is not None:
                        *summary, spent = taken()
                        yield kept(of, summary, spent)
                    of, summary, spent, waiting, rows = part, none, 0, [], 0
                keys = np.frombuffer(batch.column("keys")[i].as_buffer(), np.uint64)
                waiting.append((keys, np.frombuffer(batch.column("counts")[i].as_buffer(), np.int32)))
                rows += len(keys)
                if rows >= capacity:    # what waits is no larger than a summary
                    *summary, spent = taken()
                    waiting, rows = [], 0
        if of is not None:
            *summary, spent = taken()
            yield kept(of, summary, spent)

    return run


# ------------------------------------------------------------ second pass

def _exact_counts(shared, parts: int):
    """Task function: (part, lang, phrases, times), packed, of the sequences that pass the filter; an empty phrase: all words."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        bits, hashes = shared.value, _Hashes()
        gathered: dict[str, dict[bytes, int]] = {}

        def sent():
            rows = []
            for lang, found in gathered.items():
                dealt: dict[int, list] = {}
                for item in found.items():
                    dealt.setdefault(xxhash.xxh3_64_intdigest(item[0]) % parts, []).append(item)
                rows += [(part, lang, b"\n".join(p for p, _ in items), np.array([n for _, n in items], np.int64).tobytes()) for part, items in dealt.items()]
            gathered.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))],
                                              names=["part", "lang", "phrases", "times"])

        for batch in batches:
            for lang, texts in by_language(batch):
                found = gathered.setdefault(lang, {})
                for tokens, lead in token_slices(texts):
                    found[b""] = found.get(b"", 0) + len(tokens) - lead - tokens[lead:].count(END)
                    for n, starts, keys in sequences(tokens, lead, lang, hashes, bits, LONGEST):
                        _, first, times = np.unique(keys, return_index=True, return_counts=True)
                        for i, k in zip(starts[first].tolist(), times.tolist()):
                            phrase = b" ".join(tokens[i:i + n])
                            found[phrase] = found.get(phrase, 0) + k
                if sum(map(len, gathered.values())) >= GATHERED >> 4:
                    yield sent()
        if any(gathered.values()):
            yield sent()

    return run


def _added(least: int):
    """Task function: (lang, phrase, words, times) of a part's phrases with ``least`` occurrences, from its packed counts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        of, sums = None, {}

        def kept():
            rows = [(lang, phrase or None, phrase.count(b" ") + 1, n) for (lang, phrase), n in sums.items() if n >= least or not phrase]
            columns = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()).cast(pa.string()), pa.array(columns[2], pa.int32()),
                pa.array(columns[3], pa.int64())], names=["lang", "phrase", "words", "times"])

        for batch in batches:
            for i, part in enumerate(batch.column("part").to_pylist()):
                if part != of and of is not None:
                    yield kept()
                    sums.clear()
                of, lang = part, batch.column("lang")[i].as_py()
                times = np.frombuffer(batch.column("times")[i].as_buffer(), np.int64).tolist()
                for phrase, n in zip(batch.column("phrases")[i].as_py().split(b"\n"), times):
                    sums[lang, phrase] = sums.get((lang, phrase), 0) + n
        if sums:
            yield kept()

    return run


def frequent(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, times) of all sequences of 1 to LONGEST words with ``least`` occurrences; phrase null: all words.

    First pass: tasks count the hashes of all sequences and send them, packed, to
    their hash partition, which merges them into one Misra-Gries summary. It has
    HEADROOM times the counters that the partition's mass divided by ``least``
    asks for, so every sequence with ``least`` occurrences survives; should what
    counters have lost ever reach ``least``, the summary grows instead. Words and
    pairs come first; of longer sequences only those made of surviving pairs are
    sent. Second pass: survivors, as a filter of fixed size, choose the sequences
    that are counted exactly, as text. A false survivor only costs a row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a word and the blank after it have two bytes at least
    words = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    bits, shared, survived = None, None, 0
    for lengths in (1, 2), (3, LONGEST):
        mass = words * (lengths[1] - lengths[0] + 1)
        parts = max(spark.sparkContext.defaultParallelism * 2, -(-mass * HEADROOM // (COUNTERS * least)))
        capacity = max(1 << 12, -(-mass * HEADROOM // (parts * least)))
        counted = rows.mapInArrow(_local_counts(parts, lengths, shared), "part int, keys binary, counts binary")
        found = materialized(counted.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_survivors(capacity, least), "key bigint"))
        survived += found.count()
        if shared is not None:
            shared.unpersist()
        known = KeyFilter(found, "key", bits)
        bits, shared = known.words, known.shared
    parts = max(parts, -(-survived // SURVIVORS_EACH))
    exact = rows.mapInArrow(_exact_counts(shared, parts), "part int, lang string, phrases binary, times binary")
    counts = materialized(exact.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(
        _added(least), "lang string, phrase string, words int, times bigint"))
    shared.unpersist()
    return counts


# ------------------------------------------------------------ scores

def _part(start, length):
    return F.array_join(F.slice("list", start, length), " ")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, first: int = FIRST,
                 covered: int = COVERED, scale: int = SCALE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` collocations.

    Texts are split at ``.,;:!?`` and line ends into pieces and at blanks and tabs
    into words, A-Z lower-cased; null texts are empty, a null language is ``und``.
    Candidates are phrases of 2 to LONGEST words with ``least`` occurrences a. Of
    all cuts into a first part (l occurrences) and a rest (r) the one with the
    least floor(scale * a * n / (l * r)) counts, n being the language's words;
    equal ones: the first. A candidate inside a longer candidate that has
    ``covered`` hundredths of its occurrences or more is dropped. Ranked by
    score, a, phrase. Nothing is left of an empty table.
    """
    counts = frequent(docs, text=text, lang=lang, least=least)
    phrases = counts.where("phrase IS NOT NULL").select("lang", "phrase", "words", "times")
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("times").alias("a"), F.split("phrase", " ").alias("list"))

    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("list", i, m), " ")))))
    covers = candidates.where("words > 2").select("lang", "a", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(covers, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {int(covered)} * a")

    cuts = kept.select("lang", "phrase", "a", "words", "list", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    times = phrases.select("lang", F.col("phrase").alias("part"), "times")
    cuts = cuts.join(times.select("lang", F.col("part").alias("head"), F.col("times").alias("l")), ["lang", "head"])
    cuts = cuts.join(times.select("lang", F.col("part").alias("tail"), F.col("times").alias("r")), ["lang", "tail"])
    totals = counts.where("phrase IS NULL").select("lang", F.col("times").alias("n"))
    cuts = cuts.join(totals, "lang")
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    cuts = cuts.withColumn("up", (exact["a"] * scale).cast("decimal(19,0)") * exact["n"]).withColumn("down", exact["l"] * exact["r"])
    scored = cuts.withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("best"))
    ranked = top_n_per_key(best.select("lang", "phrase", "best.*"), ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], first)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
