"""Phrase mining, the manifest and line dedup: odd rows, plain versions, and their parts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from profilelake.llm import lines, merkle, phrases, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that are odd in one way each: nulls, blanks, ties, repeated rows, very long texts."""
    line = "The same line in many documents"
    long_text = " ".join(f"w{i % 97} x" for i in range(400_000))
    rows = [(i, f"{line}\nown {i}\n\t {line.upper()} \nshort", "en", "s", i) for i in range(1, 8)]
    rows += [(9, None, "en", "s", None), (10, "", None, None, 0), (11, " \n\x0b\n", None, "s", 3), (12, long_text, "fr", "s", 1), (None, line, "en", "s", 1),
             (None, line, "en", "s", 1), (3, rows[2][1], "en", "s", 3), (13, "é" * 20 + "\n" + "é" * 19, "de", "s", 2), (14, "é" * 20, "de", "s", 2),
             (15, "é" * 20, "de", "s", 2), (-4, "New York. new york! New\tYork, of the of the of the", "en", "s", 9), (16, "x" * 3_000_000, "fr", "s", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def run_query(fn, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return fn(docs.sparkSession, str(tmp_path))


# ---------------------------------------------------------------- phrases

def plain_counts(rows):
    counts = defaultdict(Counter)
    for r in rows:
        text = (r["text"] or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for n in range(1, 6):
                counts[r["lang"] or "und"].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    return counts


def plain_collocations(rows, least, first):
    out = []
    for lang, f in plain_counts(rows).items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            inside = (q for q in found if len(q) > len(p) and found[q] >= a)
            if any(q[i:i + len(p)] == p for q in inside for i in range(len(q))):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], score))
        out += [(lang, i + 1, p.decode(), a, l, r, n, s) for i, (_, _, p, a, l, r, s) in enumerate(sorted(best)[:first])]
    return out


@pytest.mark.parametrize("least, first", [(2, 2000), (3, 5)])
def test_collocations(spark, odd, least, first):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).select(*[c.split()[0] for c in DOCS.split(", ")])
    docs = docs.unionByName(odd).withColumns({c: F.lit("x") for c in ("phrase", "words", "part", "key", "rank")}).cache()
    rows = docs.collect()
    got = phrases.collocations(docs, least=least, first=first)
    assert sorted(map(tuple, got.collect())) == sorted(plain_collocations(rows, least, first))


def test_collocations_of_nothing(empty):
    assert phrases.collocations(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=8), st.integers(1, 20), st.integers(1, 12))
def test_summaries_keep_what_is_frequent(parts, capacity, least):
    summary, spent, true = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0, Counter()
    for part in parts:
        true.update(part)
        keys, counts = np.unique(np.array(part, np.uint64), return_counts=True)
        keys, counts, spent = phrases.reduced(*phrases.merged(summary, (keys, counts)), capacity, spent, least)
        summary = keys, counts
    kept = {int(k): int(c) for k, c in zip(*summary)}
    assert spent < least or spent == 0
    assert all(c <= true[k] <= c + spent for k, c in kept.items())
    assert all(k in kept and kept[k] + spent >= least for k, n in true.items() if n >= least)
    if sum(true.values()) < least * capacity:       # the classic guarantee holds the size
        assert len(kept) <= capacity


def test_slices_of_long_texts_lose_no_sequence(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 11)
    text = b"Aa bb cc. dd ee ff gg hh ii jj kk; ll mm nn oo"
    hashes, found = phrases._Hashes(), Counter()
    for tokens, lead in phrases.token_slices(iter([text, b"aa bb"])):
        for n, starts, _ in phrases.sequences(tokens, lead, "en", hashes):
            found.update(b" ".join(tokens[i:i + n]).decode() for i in starts)
    want = plain_counts([{"text": text.decode(), "lang": "en"}, {"text": "aa bb", "lang": "en"}])["en"]
    assert found == Counter({" ".join(k): v for k, v in want.items()})


# ---------------------------------------------------------------- manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(hashes, arity):
    """(root, siblings per leaf, per level)."""
    beside, places = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        groups = [list(range(i, min(i + arity, len(hashes)))) for i in range(0, len(hashes), arity)]
        for g in groups:
            for i in g:
                for leaf in places[i]:
                    beside[leaf] += [hashes[j] for j in g if j != i]
        places = [[leaf for i in g for leaf in places[i]] for g in groups]
        hashes = [sha("".join(hashes[i] for i in g)) for g in groups]
    return hashes[0], beside


@pytest.mark.parametrize("arity, depth", [(2, 8), (2, 2), (3, 1)])
def test_manifest(spark, arity, depth):
    rows = [(lang, i, sha(f"{lang}{i}")) for lang, n in ((None, 1), ("a", 13), ("b", 2), ("é", 30), ("z", 1)) for i in range(n)]
    rows += [("a", None, sha("no id")), ("b", 1, sha("tie")), ("b", 1, sha("tie"))]
    leaves = spark.createDataFrame(rows, "lang string, id bigint, leaf string").withColumns({c: F.lit(1) for c in ("g", "block", "children", "hash", "nth")})
    got = merkle.manifest(leaves, "lang", ["id"], keep=["id", "g"], arity=arity, depth=depth)
    got = got.withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof"))).withColumn("beside", merkle.siblings(F.col("proof"))).collect()
    langs = [None, "a", "b", "z", "é"]
    ordered = {x: sorted((r for r in rows if r[0] == x), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for x in langs}
    sub = {x: plain_tree([r[2] for r in ordered[x]], arity) for x in langs}
    root, above = plain_tree([sub[x][0] for x in langs], arity)
    want = [(x, r[1], r[2], sub[x][0], root, "".join(sub[x][1][i] + above[k]), root) for k, x in enumerate(langs) for i, r in enumerate(ordered[x])]
    assert sorted(map(str, want)) == sorted(str((r["lang"], r["id"], r["leaf"], r["subroot"], r["root"], r["beside"], r["folded"])) for r in got)


def test_manifest_query_on_odd_rows(odd, empty, tmp_path):
    got = run_query(queries.QUERIES["op12_merkle_manifest"], odd, tmp_path / "a").collect()
    assert len(got) == odd.count() and len({r["root"] for r in got}) == 1
    for r in got:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        assert r["verified"] == (r["folded_root"] == r["root"]) == (not hit or r["doc_id"] == 9)
    assert run_query(queries.QUERIES["op12_merkle_manifest"], empty, tmp_path / "b").count() == 0


def test_written_fields_differ(spark):
    row = spark.sql("SELECT 'é:1' AS a, CAST(NULL AS STRING) AS b, '-' AS c, 12L AS d, '' AS e")
    got = row.select(F.concat(*[merkle.written_field(F.col(c)) for c in "abcde"])).first()[0]
    assert got == "4:é:1-1:-2:120:"


# ---------------------------------------------------------------- lines

def plain_lines(rows):
    blanks = " \t\n\x0b\x0c\r"

    def key(line):
        return line.strip(blanks).translate({c: c + 32 for c in range(65, 91)})

    holders = defaultdict(list)
    for r in rows:
        for k in {key(x) for x in (r["text"] or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(r["doc_id"] if r["doc_id"] is not None else float("-inf"))
    out = []
    for r in rows:
        own = r["doc_id"] if r["doc_id"] is not None else float("-inf")
        all_lines = (r["text"] or "").split("\n")
        kept = [x for x in all_lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == own]
        out.append((r["doc_id"], len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split()[0] for c in DOCS.split(", ")]).unionByName(odd)
    docs = docs.withColumns({c: F.lit("x") for c in ("row", "doc", "ref", "gone", "parts", "h", "n_lines", "kept_text")})
    got = lines.drop_recurring_lines(docs)
    assert set(got.columns) == set(docs.columns) | {"n_dropped"}
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_lines(docs.collect())))
    assert lines.drop_recurring_lines(empty).count() == 0


def test_lines_in_many_shards(spark, odd, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 2)
    monkeypatch.setattr(lines, "PROBES_EACH", 3)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.drop_recurring_lines(odd).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_lines(odd.collect())))


@settings(max_examples=50, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=300))
def test_perfect_hash(pairs):
    pairs = sorted(pairs)
    h, f = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    at = lines.Shard(*lines.build(h, f)).index(h, f)
    assert sorted(at.tolist()) == list(range(len(pairs)))
    order = np.argsort(at)
    shard = lines.Shard(*lines.build(h, f), f[order])
    found, again = shard.ask(h, f)
    assert found.all() and (again == at).all()
    found, _ = shard.ask(h, f ^ np.uint64(1))
    assert all((int(a), int(b)) in pairs for a, b in zip(h[found], (f ^ np.uint64(1))[found]))


# ---------------------------------------------------------------- repeats and quality, again

def test_repeats_of_very_many_equal_rows(spark):
    """5000 rows of one text without an id: time and state grow with the rows, not with their square."""
    from profilelake.llm import repeats

    text = " ".join(f"word{i * 7919 % 1009}" for i in range(500))
    docs = spark.range(0, 5000, 1, 8).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    got = repeats.remove_repeats(docs, digest=True).groupBy("n_bytes", "kept").count().collect()
    assert got == [(len(text), hashlib.sha256(b"").hexdigest(), 5000)]


def test_leading_vectors():
    from profilelake.llm import quality

    rng = np.random.default_rng(1)
    rows = (rng.standard_normal((300, 20)) * np.linspace(9, 1, 20) ** 2) @ rng.standard_normal((20, 90))
    got = quality.leading(rows.astype(np.float32), 8)
    want = np.linalg.svd(rows, full_matrices=False)[2][:8]
    assert np.allclose(np.abs(np.sum(got.T * want, axis=1)), 1, atol=1e-3)


def test_vote_against_brute_force():
    """The vote equals one counted text by text over all labelled vectors."""
    from profilelake.llm import quality

    rng = np.random.default_rng(2)
    counts = rng.poisson(0.3, (80, quality.FEATURES)).astype(np.float32)
    model = quality.NeighbourVote(counts[:60], rng.integers(0, 2, 60))
    got = model.score(counts[60:])
    for row, score in zip(counts[60:], got):
        x = row * model.idf
        x = (x / np.linalg.norm(x)) @ model.basis
        x /= np.linalg.norm(x)
        near = sorted(((float(x @ k), float(y)) for k, y in zip(model.known, model.labels)), reverse=True)[:quality.NEIGHBOURS]
        votes = [(max(c, 0) ** quality.SHARPNESS, y) for c, y in near]
        assert abs(score - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 1e-3


def test_key_filter(spark):
    from profilelake.llm.common import KeyFilter

    keys = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("key"))
    kept = spark.range(5000).where(KeyFilter(keys, "key").passes(F.xxhash64("id"))).collect()
    assert {r["id"] for r in kept} >= set(range(0, 5000, 7)) and len(kept) < 730
    assert spark.range(50).where(KeyFilter(keys.limit(0), "key").passes(F.xxhash64("id"))).count() == 0


# ---------------------------------------------------------------- chat, ties

def test_tied_turns_stand_by_their_texts(spark):
    """Turns of one number stand by role and text as they are, not as they are escaped."""
    from profilelake.llm import chat

    texts = ["a$", "a#", "a<", "a\\", "a:", "a", "", "a~"]
    turns = spark.createDataFrame([(1, 0, "user", t) for t in texts] + [(1, 0, "assistant", "z#"), (1, 0, "assistant", "z$")],
                                  "c bigint, turn bigint, role string, text string")
    got = chat.format_turns(turns, conv="c", order=[F.col("turn")]).select(chat.read_turns(F.col("formatted"))).first()[0]
    assert [(r["role"], r["text"]) for r in got] == [("assistant", "z#"), ("assistant", "z$")] + [("user", t) for t in sorted(texts)]
