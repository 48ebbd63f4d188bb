"""The corpus operators on small tables: edge cases, and plain versions on the given tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from profilelake.llm import chat, common, components, langid, minhash, mixing, packing, pii, quality, queries, repeats, topk, vector_links
from tests.llm import plain

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest documents table with rows that are odd in one way each."""
    given_rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long_text = " ".join(f"word{i * 7919 % 4001}" for i in range(30_000))
    odd = [
        (900_001, None, "en", "src0", None), (900_002, "", "en", None, 0), (900_003, " \n\t ", None, "src1", 4),
        (900_004, long_text, "en", "", 1), (900_005, given_rows[3][1], None, None, None), given_rows[4], given_rows[4],
        (None, "a text without an id", "en", "src2", 1), (900_006, "é😀 x", "fr", "src0", 3), (900_007, "17 + 4", None, "src0", 6),
        (900_008, "<|endoftext|> ends", "en", "src0", 3), (None, None, None, None, None),
    ]
    return spark.createDataFrame(given_rows + odd, DOCS).repartition(4).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns with the names that operators use inside."""
    names = ["id", "key", "print", "size", "rank", "run", "place", "base", "spans", "score", "component", "text__", "c0", "kept_0", "target"]
    return docs.limit(20).withColumns({n: F.lit("x") for n in names})


# ---------------------------------------------------------------- packing

def check_packing(pieces, rows):
    encode = packing.tokenizer(VOCABULARY)
    expected = Counter()
    for r in rows:
        ids = encode(r["text"] or "") + [1]
        expected[(r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    windows, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        windows[p["sequence_id"]].append(p)
        parts[(p["doc_id"], p["doc_tokens"])].append(p)
    padding = total = 0
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == w[0]["sequence_length"] <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    for (doc, tokens), ps in parts.items():
        copies = sum(n for k, n in expected.items() if k[:2] == (doc, tokens))
        assert sum(p["length"] for p in ps) == copies * tokens
        if copies == 1:
            ps = sorted(ps, key=lambda p: p["start"])
            assert [p["start"] for p in ps] == [sum(q["length"] for q in ps[:i]) for i in range(len(ps))]
            assert (doc, tokens, zlib.crc32(b"".join(bytes(p["ids"]) for p in ps))) in expected
    assert {k[:2] for k in expected} == set(parts)


def test_packing(docs, rows, empty, clashing):
    check_packing(packing.pack(docs, VOCABULARY).collect(), rows)
    check_packing(packing.pack(clashing, VOCABULARY).collect(), clashing.collect())
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_tokenizers_agree(rows):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(VOCABULARY), packing.tokenizer(VOCABULARY)
    for r in rows:
        text = (r["text"] or "")[:20_000]
        assert slow.encode(text, add_special_tokens=False).ids == fast(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(2, 6))
def test_level_packer(sizes, max_open):
    packer = packing.LevelPacker(0, window=16, max_open=max_open)
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n))
    packer.close()
    seen, windows = Counter(), defaultdict(int)
    for doc, start, ids, total, sequence, offset, length in packer.done:
        assert list(ids) == list(range(start, start + len(ids)))
        seen[doc] += len(ids)
        assert windows[sequence] == offset
        windows[sequence] += len(ids)
        assert length <= 16 and (length & (length - 1)) == 0
    assert [seen[i] for i in range(len(sizes))] == sizes


def test_sum_of_squares_rule():
    packer = packing.LevelPacker(0, window=10)
    packer.add("a", np.arange(6))
    packer.add("b", np.arange(6))        # two windows at level 6
    packer.add("c", np.arange(3))        # 6 -> 9 lowers the sum of squares from 4 to 2; a new window would raise it to 5
    assert packer.count[6] == 1 and packer.count[9] == 1
    assert packer.level_for(1) == 9      # closes a window


# ---------------------------------------------------------------- top k

def brute_top(vectors, k):
    out = []
    for q, v in vectors:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.randint(-9, 9) for _ in range(6)]) for i in range(450)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(40)]       # ties
    frame = spark.createDataFrame(vectors + [(700, None), (None, [1] * 6)], "vec_id bigint, vector array<bigint>").withColumn("id", F.lit(1)).repartition(3)
    for tile, query_bytes in ((64, 1 << 20), (16, 300), (16_384, 100)):
        found = topk.top_k(frame, frame.where("vec_id % 100 = 0"), 10, tile=tile, query_bytes=query_bytes)
        assert sorted(map(tuple, found.collect())) == brute_top(vectors, 10)
    few = topk.top_k(frame.limit(0), frame.where("vec_id = 0"), 10)
    assert few.count() == 0
    two = frame.where("vec_id IN (0, 5)")
    assert [(r["vec_id"], r["rank"]) for r in topk.top_k(two, two.where("vec_id = 0"), 10).collect()] == [(5, 1)]


def test_top_k_large_values_and_lengths(spark):
    frame = spark.createDataFrame([(0, [2 ** 62, 1]), (1, [4, 1, 7]), (2, [-4]), (3, [])], "vec_id bigint, vector array<bigint>")
    found = {r["vec_id"]: r["score"] for r in topk.top_k(frame, frame.where("vec_id = 0"), 10).collect()}
    assert found == {1: 2 ** 63 - 1, 2: -2 ** 63, 3: 0}


def test_top_k_null_components_and_repeated_rows(spark):
    frame = spark.createDataFrame([(0, [2, None, 3]), (1, [5, 9, None]), (2, [1, 1, 1]), (2, [1, 1, 1]), (0, [2, None, 3]), (4, [None])],
                                  "vec_id bigint, vector array<bigint>").coalesce(1)
    found = topk.top_k(frame, frame.where("vec_id = 0"), 10).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, 10), (2, 5), (2, 5), (4, 0)]
    wide = topk.integer_matrix(pa.array([[1, None, 3], [], [4], [5, 6, 7, 8]], pa.list_(pa.int64())), 3)
    assert wide.tolist() == [[1, 0, 3], [0, 0, 0], [4, 0, 0], [5, 6, 7]]


def test_impact_index_stops_on_proof():
    rng = np.random.default_rng(0)
    values = rng.integers(-300, 300, (4000, 16))
    values[7] = 299
    index = topk.ImpactIndex(values)
    members, scores = index.top(np.full(16, 50), 3)
    assert len(members) < 4000 and 7 in members
    exact = values @ np.full(16, 50)
    assert set(np.argsort(-exact)[:3]) <= set(members) and (scores == exact[members]).all()


def test_clean_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, None]), (2, [float("nan")]), (3, [float("inf")]), (4, None), (5, [0.5])], "vec_id bigint, v array<double>")
    assert [r["vec_id"] for r in topk.clean(frame, "v").collect()] == [5]


# ---------------------------------------------------------------- vector links

def test_vector_links_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 24))
    vectors = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    vectors += [(100 + i, (base[i % 9] + 0.02 * rng.standard_normal(24)).tolist(), (i % 9) % 3) for i in range(60)]
    vectors += [(300 + i, base[0].tolist(), 0) for i in range(30)] + [(400, (base[0] * 3).tolist(), 0), (401, base[0].tolist(), 1)]
    odd = [(500, None, 0), (501, [0.0] * 24, 0), (502, [float("nan")] * 24, 0), (503, [None] * 24, 0), (504, base[0].tolist(), None),
           (505, [1.0], 0), (506, [1.0], 0), (507, [], 0), (None, base[0].tolist(), 0)]
    frame = spark.createDataFrame(vectors + odd, "vec_id bigint, embedding array<double>, label int").withColumn("id", F.lit("x")).repartition(3)
    v = {i: np.array(x) for i, x, _ in vectors} | {505: np.array([1.0]), 506: np.array([1.0])}
    label = {i: g for i, _, g in vectors} | {505: 0, 506: 0}
    links = [(a, b) for a in v for b in v if a < b and label[a] == label[b] and len(v[a]) == len(v[b])
             and v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= 0.98]
    root, count = plain.roots([*v, 500, 501, 502, 503, 504, 507], links), Counter(x for p in links for x in p)
    for block in (2048, 4):     # the small one cuts every bucket into blocks
        got = vector_links.link(frame, block=block).collect()
        assert len(got) == frame.count()
        for r in got:
            if r["vec_id"] is None:
                assert r["n_links"] == 0 and r["kept"]
                continue
            assert (r["n_links"], r["component_id"], r["kept"]) == (count[r["vec_id"]], root[r["vec_id"]], root[r["vec_id"]] == r["vec_id"])
    assert vector_links.link(frame.limit(0)).count() == 0


def test_vector_links_recall(spark):
    """Pairs at the threshold's edge: nearly all are found, none below."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((4000, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.975, 0.985, (4000, 1))
    b = cosine * a + np.sqrt(1 - cosine ** 2) * side
    frame = spark.createDataFrame([(int(i), x.tolist(), 1) for i, x in enumerate(np.vstack([a, b]))], "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"] for r in vector_links.link(frame).where("n_links > 0 AND vec_id < 4000").collect()}
    want = set(np.flatnonzero((a * b).sum(axis=1) >= 0.98).tolist())
    assert got <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("dim", [3, 24, 64, 100])
def test_stored_codes_estimate_without_bias_inside_their_bound(dim):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((600, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    near = a + 0.19 * rng.standard_normal(a.shape) / np.sqrt(dim)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    x, y = (vector_links.encode(v, 10, 12) for v in (a, near))
    estimate = vector_links.estimates(x, y, dim)
    if dim >= 24:
        assert abs((estimate - a @ near.T).mean()) < 0.003 and abs(np.diag(estimate - a @ near.T).mean()) < 0.01
    at_edge = np.flatnonzero((a * near).sum(axis=1) >= 0.98)
    lowest = vector_links.least_estimates(x, y, dim, 0.98)
    assert len(at_edge) > 100 and (np.diag(estimate)[at_edge] >= lowest[at_edge]).all()
    if dim >= 64:       # and the bound decides: most others stay below it
        assert (estimate >= lowest[:, None]).mean() < 0.02
    assert x.itemsize < a[0].nbytes or dim < 24


def test_likely_pairs_meet_once():
    """Within a block and across two, whatever the stretch; later bands leave out what an earlier one has."""
    rng = np.random.default_rng(5)
    unit = rng.standard_normal((1, 32)) + 0.1 * rng.standard_normal((700, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes = vector_links.encode(unit, 4, 6)
    own = np.arange(700) % 2

    def pairs(own, band):
        return [tuple(sorted(p)) for i, j in vector_links.likely_pairs(codes, own, 32, band, 0.98) for p in zip(i.tolist(), j.tolist())]

    within, across = pairs(np.zeros(700, int), 0), pairs(own, 0)
    assert len(set(within)) == len(within) and len(set(across)) == len(across)
    true = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.98, 1)))}
    assert true and true <= set(within) and {p for p in true if own[p[0]] != own[p[1]]} <= set(across)
    assert all(own[i] != own[j] for i, j in across)
    shared = (codes["keys"][:, None, :2] == codes["keys"][None, :, :2]).any(axis=2)
    assert set(pairs(np.zeros(700, int), 2)) == {p for p in within if not shared[p]}


# ---------------------------------------------------------------- components

@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    got = {r["node"]: r["component"] for r in components.components(
        spark.createDataFrame(pairs + [(None, 3)], "a bigint, b bigint")).collect()}
    links = [(a, b) for a, b in pairs if a != b]
    root = plain.roots({x for p in links for x in p}, links)
    assert got == root


def test_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.components(chain).where("component = 0").count() == 201


# ---------------------------------------------------------------- chat

texts = st.text(alphabet=st.sampled_from("\\#<>:hlc/turn \né😀a"), max_size=30)


def test_escapes_round_trip(spark):
    rng = random.Random(3)
    cases = ["", "\\", "\\\\", "\\h", "</turn>\n### user: x", "\\### Assistant: </turn> ok", "a\\"]
    cases += ["".join(rng.choice("\\#<:hlc\n é😀</turn>") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    frame = spark.createDataFrame([(c,) for c in cases], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in frame.withColumn("u", chat.unescaped(F.col("e"))).collect():
        assert r["u"] == r["t"] and not set(r["e"]) & set("#<:")


def test_format_and_read(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "a:b#", "x</turn>\n### user: y"), (1, 2, None, "z"), (1, 2, None, "z"),
             (None, 0, "assistant", "é😀\\"), (2, None, "assistant", ""), (2, 5, "assistant", "end")]
    frame = spark.createDataFrame(turns, "c bigint, turn int, role string, text string").withColumn("formatted", F.lit("x"))
    got = chat.format_turns(frame, conv="c", order=[F.col("turn")]).select(
        "c", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()
    by = {r["c"]: r for r in got}
    assert [tuple(t) for t in by[1]["turns"]] == [("user", "hi"), ("assistant", ""), ("", "z"), ("", "z"), ("a:b#", "x</turn>\n### user: y")]
    assert by[1]["learned"] == "" and by[None]["learned"] == "é😀\\" and by[2]["learned"] == "end"
    assert chat.format_turns(frame.limit(0), conv="c", order=[F.col("turn")]).count() == 0


def test_layouts(spark):
    records = {
        '{"prompt": "p", "completion": "c"}': [("user", "p"), ("assistant", "c")],
        '{"completion": null, "prompt": "p"}': [("user", "p"), ("assistant", "")],
        '{"instruction": "i", "input": "n", "output": "o"}': [("system", "i"), ("user", "n"), ("assistant", "o")],
        '{"messages": [{"role": "human", "content": "a"}, {"content": "b", "role": "gpt"}]}': [("user", "a"), ("assistant", "b")],
        '{"system": "s", "messages": [{"role": "user", "content": "a"}]}': [("system", "s"), ("user", "a")],
        '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": null}]}': [("user", "a"), ("assistant", "")],
        '{"role": "user", "text": "t"}': [("user", "t")],
        '{"unknown": 1}': None, "null": None,
    }
    frame = spark.createDataFrame([(k, 1) for k in records] + [(None, 1)], "raw string, layout int").withColumn("record", F.parse_json("raw"))
    got = {r["raw"]: r["turns"] for r in chat.canonical_turns(frame.drop("layout"), "record").collect()}
    for raw, turns in (records | {None: None}).items():
        assert (got[raw] and [tuple(t) for t in got[raw]]) == turns, raw


# ---------------------------------------------------------------- mixing

def check_mixture(planned, rows):
    size = Counter()
    for r in rows:
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    target = plain.targets(size)
    taken = Counter()
    assert len(planned) == len(rows)
    for r in planned:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 1


def test_mixing(docs, rows, empty, clashing):
    planned = mixing.plan(docs).collect()
    check_mixture(planned, rows)
    again = mixing.plan(docs.repartition(7)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in (r["doc_id"], r["size"], r["taken"]))
    assert sorted(map(key, planned)) == sorted(map(key, again))
    check_mixture(mixing.plan(clashing).collect(), clashing.collect())
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=7))
def test_plain_targets_stop(sizes):
    got = plain.targets({f"s{i}": n for i, n in enumerate(sizes)})
    assert all(got[f"s{i}"] <= 3 * n + 1e-6 for i, n in enumerate(sizes))


def test_targets_against_water_filling(spark):
    rng = random.Random(8)
    for case in range(8):
        sizes = {f"s{i}": rng.choice([100] if case < 2 else [0, 1, 5, 100, 1000, 100_000]) for i in range(rng.randint(1, 9))}
        if rng.random() < 0.5:
            sizes[None] = 50
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
        assert got == pytest.approx(plain.targets(sizes))


def test_mix_takes_what_the_plan_says(docs, rows):
    columns = docs.columns
    mixed = mixing.mix(docs).collect()
    assert list(mixed[0].asDict()) == columns
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    size = Counter()
    for r in rows:
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    for s, t in plain.targets(size).items():
        assert abs(taken[s] - t) <= 1
    whole = {r["doc_id"]: r["text"] for r in rows}
    assert all(whole[r["doc_id"]].startswith(r["text"]) for r in mixed if r["doc_id"] is not None)


def test_schedules(spark):
    rising = ((0.0, 0.0), (1.0, 2.0))
    step = ((0.0, 1.0), (0.5, 1.0), (0.5001, 3.0), (1.0, 3.0))
    shares = spark.createDataFrame([(x / 20,) for x in range(21)], "x double")
    got = shares.select("x", mixing.training_position(F.col("x"), rising).alias("r"), mixing.training_position(F.col("x"), step).alias("s"),
                        mixing.training_position(F.col("x"), mixing.LEVEL).alias("l")).collect()
    for r in got:
        assert r["r"] == pytest.approx(r["x"] ** 0.5) and r["l"] == pytest.approx(r["x"])
        assert r["s"] == pytest.approx(2 * r["x"] if r["x"] <= 0.25 else 0.5 + (r["x"] - 0.25) * 2 / 3, abs=1e-3)
    with pytest.raises(ValueError):
        mixing.training_position(F.lit(0.5), ((0.0, 1.0), (0.9, 1.0)))


def test_schedule_orders_the_mix(spark):
    frame = spark.createDataFrame([(i, "w " * 10, "late" if i % 2 else "even") for i in range(400)], "doc_id bigint, text string, source string")
    planned = mixing.plan(frame, weights=(1,), schedules={"late": ((0.0, 0.0), (1.0, 2.0))}).where("taken > 0").groupBy("source").agg(F.avg("position").alias("p")).collect()
    mean = {r["source"]: r["p"] for r in planned}
    assert mean["late"] == pytest.approx(2 / 3, abs=0.02) and mean["even"] == pytest.approx(0.5, abs=0.02)


def test_curriculum_is_the_inverse_of_the_demand(docs, rows):
    """Position and share of the stream agree with the numeric integral; targets stay; a late source comes late."""
    def integral(schedule, t):
        times = np.linspace(0, t, 2001)
        return np.trapezoid(np.interp(times, *zip(*schedule)), times)

    assert all(integral(s, 1.0) == pytest.approx(1) for s in mixing.CURRICULUM)
    planned = mixing.plan(docs, schedules=mixing.CURRICULUM).collect()
    check_mixture(planned, rows)
    names = sorted({r["source"] for r in planned}, key=lambda s: (s is None, (s or "").encode()))
    place = {s: i for i, s in enumerate(names)}
    seen = set()
    for r in planned:
        assert r["rank"] == place[r["source"]] and (r["position"] is None) == (r["taken"] == 0)
        if r["taken"]:
            schedule = mixing.CURRICULUM[place[r["source"]] % 3]
            assert integral(schedule, r["position"]) == pytest.approx(r["before"] / round(r["target"]), abs=1e-6)
            seen.add(place[r["source"]] % 3)
    assert seen == {0, 1, 2}
    mixed = mixing.mix(docs, schedules=mixing.CURRICULUM).collect()
    words = [(place[r["source"]] % 3, len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in mixed]
    half, total, early = sum(n for _, n in words) / 2, 0, Counter()
    for kind, n in words:
        early[kind] += n if total < half else 0
        total += n
    whole = Counter()
    for kind, n in words:
        whole[kind] += n
    assert early[0] / whole[0] > 0.55 and early[2] / whole[2] < 0.45


# ---------------------------------------------------------------- quality and language

def test_quality(spark, docs, rows, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels.where(common.crc_of_id("doc_id") % 5 != 0))
    got = quality.score(docs.withColumn("score", F.lit("x")), model, column="q").collect()
    assert len(got) == len(rows) and all(0 <= r["q"] <= 1 for r in got)
    assert {r["q"] for r in got if not r["text"]} == {model.prior}
    assert all(r["score"] == 0.5 for r in quality.score(docs, quality.fit(empty, labels)).limit(5).collect())
    assert quality.score(empty, model).count() == 0
    assert quality.fit(docs, labels.limit(0)) is None


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    q = {r["doc_id"]: r for r in queries.op6(spark, sf).where("held_out").collect()}
    known = [(q[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in q]
    assert np.mean([r["predicted"] == y for r, y in known]) >= 0.95


def test_counts_do_not_depend_on_slices(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    batch = pa.RecordBatch.from_pydict({"t": ["".join(map(chr, rng.integers(97, 105, n))) for n in (0, 1, 2, 700, 3)] + [None]})
    whole = np.vstack([x for _, _, x in quality.feature_blocks(batch, "t")])
    monkeypatch.setattr(quality, "SLICE_BYTES", 64)
    pieces = np.vstack([x for _, _, x in quality.feature_blocks(batch, "t")])
    assert np.allclose(whole[:, :quality.PAIRS], pieces[:, :quality.PAIRS])


def test_language(spark, docs, rows, empty):
    net = langid.fit(docs.where(common.crc_of_id("doc_id") % 4 != 2))
    got = langid.predict(docs.withColumn("score", F.lit(7)), net, keep=("text", "lang")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in got)
    assert langid.fit(empty) is None and langid.predict(empty, net).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = queries.op10(spark, sf).where("held_out").collect()
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held if lang[r["doc_id"]]]) >= 0.97


def test_language_is_learnt_from_whole_texts(spark):
    rng = random.Random(8)
    words = {"aa": "the and with that thing other", "bb": "der und mit dass ding zwölf", "cc": "que con para ñino cosa los"}
    header = "0123 header of a hot source " * 40       # longer than the windows of a sampled text

    def text(lang):
        return header + " ".join(rng.choice(words[lang].split()) for _ in range(600))

    rows_ = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    frame = spark.createDataFrame(rows_, "doc_id bigint, text string, lang string")
    net = langid.fit(frame.where("doc_id < 150"))
    got = langid.predict(frame.where("doc_id >= 150"), net, keep=("lang",)).collect()
    assert len(got) == 30 and all(r["lang_pred"] == r["lang"] for r in got)


def test_rare_languages_are_in_the_sample(spark):
    rows_ = [(i, f"a common text {i}", "en") for i in range(800)] + [(1000 + i, f"a rare text {i}", f"x{i}") for i in range(10)]
    net = langid.fit(spark.createDataFrame(rows_, "doc_id bigint, text string, lang string"), rows=40)
    assert net.languages == ["en", *[f"x{i}" for i in range(10)]]
    assert langid.shares({"a": 1, "b": 500, "c": 9000}, 601) == {"a": 1, "b": 300, "c": 300}


def test_windows_cover_every_byte():
    values = np.arange(1, 251, dtype=np.uint8)
    w, row = langid.cut_windows(values, np.array([0, 0, 5, 250]), length=16)
    assert set(row) == {1, 2} and set(w[row == 1].ravel()) == {0, 1, 2, 3, 4, 5} and set(w[row == 2].ravel()) == set(range(6, 251))


# ---------------------------------------------------------------- repeats

@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(values):
    n = len(values)
    order = repeats.suffix_array(np.array(values, np.int64))
    assert order.tolist() == sorted(range(n), key=lambda i: values[i:])
    if n > 1:
        common_prefix = repeats.permuted_prefixes(np.array(values) + 1, order, 8)
        for a, b in zip(order, order[1:]):
            true = next((k for k in range(8) if values[a + k:a + k + 1] != values[b + k:b + k + 1] or a + k >= n or b + k >= n), 8)
            assert common_prefix[b] in (true // 4 * 4, true)


def test_inducing_scans_agree():
    rng = np.random.default_rng(5)
    for n, k in ((400, 3), (900, 200), (50, 600)):
        text = rng.integers(0, k, n)
        assert repeats.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def test_repeats(spark, docs, rows, empty):
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, plain.repeats([r["text"] for r in rows], 200)))
    got = repeats.remove_repeats(docs.withColumn("print", F.lit(1)).withColumn("id", F.lit(1)), digest=True).collect()
    assert Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept"]) for r in got) == want
    assert repeats.remove_repeats(empty).count() == 0


def repeat_case(spark, texts_, length, gram):
    frame = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(frame, length=length, gram=gram).collect()}
    for i, (n, removed, spans, digest) in enumerate(plain.repeats(texts_, length)):
        r = got[i]
        assert (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"])) == (n, removed, spans), i
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == digest


def test_repeats_on_small_strings(spark, monkeypatch):
    """Overlaps, repeats inside a text, edits at every distance; small limits force halving and many shards."""
    rng = random.Random(6)
    stem = "".join(rng.choice("abcdef ") for _ in range(300))
    cases = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(25)] + ["a" * 70, "xy" * 40, "é😀" * 12, None, ""]
    for i in range(30):
        s = rng.randint(0, 200)
        piece = list(stem[s:s + rng.randint(10, 100)])
        for _ in range(rng.randint(0, 2)):
            piece[rng.randrange(len(piece))] = "#"
        cases.append("".join(rng.choice("uvwxyz") for _ in range(20)) + "".join(piece) + "".join(rng.choice("uvwxyz") for _ in range(20)))
    repeat_case(spark, cases, 20, 8)
    monkeypatch.setattr(repeats, "GROUP_BYTES", 60)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 400)
    repeat_case(spark, cases, 20, 8)


def test_repeats_across_slices(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE_BYTES", 64)     # reaches only in-process calls: anchors of pieces agree with those of the whole
    values = np.frombuffer(("abcdefghij" * 3 + "k" * 7 + "abcdefghij" * 9).encode(), np.uint8)
    whole = repeats.anchors(values, np.array([0, len(values)]), 20, 8)
    part = repeats.anchors(values[30:], np.array([0, len(values) - 30]), 20, 8)
    starts = {int(f) + k: int(h) for f, c, h in zip(whole[3], whole[4], whole[2]) for k in range(c)}
    for f, c, h in zip(part[3], part[4], part[2]):
        assert all(starts[int(f) + k + 30] == int(h) for k in range(c))


# ---------------------------------------------------------------- personal data

ODD_TEXTS = [
    None, "", "a@b.c", "x.a@b-c.d_e@f.g", "@@a@b..c d@e.f.", "a@b a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 and 0255.00.1.01 1.2.3",
    "4845 1681-1440 7329", "4845168114407329", "4845168114407328", "1" * 40, "49927398716 0 49927398716", "+1 (974) 555-3436.", "+1234567890123456",
    "+49 (0) 30 1234567 +", "é😀 a@b.de 😀 1.2.3.4", "a" * 5000 + "@b", "1 2 " * 6000, "a@" + "b." * 6000 + "c", "9." * 5000, "+" + "1 " * 8000 + "x",
    "4845-1681-1440-7329 4845  168114407329", "q@w.e+1 (12) 345-67890@x.y", "10.0.0.1:8080", "name (at) host [dot] com",
]


def test_rule_spans_match_the_patterns(spark, rows):
    rng = random.Random(2)
    cases = ODD_TEXTS + ["".join(rng.choice("a1@.+- 45") for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [r["text"] for r in rows]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "doc_id bigint, text string, value string")
    found = pii.find(frame, pii.Trees(0.0, [], float("inf"))).select("doc_id", pii.written(F.col("base")).alias("w")).collect()
    for r in found:
        assert r["w"] == plain.written(plain.base_spans(cases[r["doc_id"]])), cases[r["doc_id"]][:200]


def test_running_sums(spark):
    rng = random.Random(1)
    lists = [[], [5], [rng.randint(0, 9) for _ in range(256)], [rng.randint(0, 9) for _ in range(1000)]]
    got = spark.createDataFrame([(x,) for x in lists], "x array<int>").select("x", pii.running_sums(F.col("x")).alias("s")).collect()
    for r in got:
        assert r["s"] == [sum(r["x"][:i]) for i in range(len(r["x"]))]


def test_trees_learn_and_agree_with_their_expressions(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, (4000, len(pii.FEATURES)))
    y = ((x[:, 1] > 11) & (x[:, 4] < 7)).astype(int)
    model = pii.boost(x, y)
    assert model.threshold < float("inf") and ((model.odds_of(x) >= model.threshold) == y).mean() > 0.97
    frame = spark.createDataFrame([tuple(map(int, r)) for r in x[:200]], ", ".join(f"{n} int" for n in pii.FEATURES))
    got = [r["o"] for r in frame.coalesce(1).select(model.odds({n: F.col(n) for n in pii.FEATURES}).alias("o")).collect()]
    assert got == pytest.approx(model.odds_of(x[:200]).tolist())


def test_added_spans_keep_the_rules_spans(spark):
    texts_ = [f"write to me{i} [at] host{i % 5}.org or call 030 {i % 900 + 100} 4567 now, ip 10.0.0.{i % 200}" for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string")
    everything = pii.Trees(1.0, [], 0.0)        # takes all candidates
    for r in pii.find(frame, everything).collect():
        base, every = {tuple(s) for s in r["base"]}, [tuple(s) for s in r["spans"]]
        assert base <= set(every) and len(every) > len(base)
        assert all(a[1] <= b[0] for a, b in zip(every, every[1:]))
        assert any(k == "email" and "[at]" in r["text"][s:e] for s, e, k in every)


def test_fitted_trees_add_what_only_generators_know(spark):
    rng = random.Random(4)
    words = "the of on thether ining that was edand entio by hein ation with reer from ouso".split()

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    def number(form):
        return re.sub("#", lambda _: str(rng.randint(0, 9)), form)

    datum = [lambda: f"{rng.choice(words)}.{number('##')}@mail{number('#')}.example.com", lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)),
             lambda: f"+1 ({number('###')}) 555-{number('####')}"]
    known = [f"{prose(9)} {datum[i % 3]()} {prose(9)}" for i in range(240)]
    planted = [("email", "joe.{} (at) mail3.example.com"), ("email", "ann{} [at] host [dot] org"), ("ip", "2001:db8:12:af1:1:22f:3e:9{}"),
               ("phone", "1 (743) 555-38{}"), ("phone", "(743) 555-38{}")]
    clean = ["order 1234-5678-9{}", "look (at) this. Then {}", "2024-01-15 10 {}", "120 450 300 2{}", "00:1b:63:ff:fe:84:5e:{}", "version 10.20.3{}"]
    new = [(kind, form.format(20 + i)) for kind, form in planted for i in range(4)] + [("", form.format(20 + i)) for form in clean for i in range(4)]
    texts_ = known + [f"{prose(6)} {value} {prose(6)}" for _, value in new]
    frame = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in pii.find(frame, pii.fit(frame)).collect()}
    for i, (kind, value) in enumerate(new, len(known)):
        added = [(k, texts_[i][s:e]) for s, e, k in found[i]["spans"]]
        assert found[i]["base"] == [] and added == ([(kind, value)] if kind else []), value


def test_redaction(spark):
    frame = spark.createDataFrame([("é a@b.de, 1.2.3.4 end",), ("clean",), (None,), ("a.4845168114407329@b.de x",)], "text string")
    found = pii.find(frame, pii.Trees(0.0, [], float("inf")))
    got = [r["t"] for r in found.select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()]
    assert got == ["é [EMAIL], [IP] end", "clean", None, "[EMAIL] x"]


def test_pii_fit_and_edges(docs, rows, empty, clashing):
    model = pii.fit(docs)
    assert pii.find(docs, model, base_col="b", all_col="s").count() == len(rows)
    assert pii.find(empty, model).count() == 0 and pii.fit(empty).threshold == float("inf")
    assert pii.find(clashing, model, base_col="b__", all_col="s__").count() == 20


# ---------------------------------------------------------------- near duplicates

def test_near_duplicates(spark, docs, rows, empty):
    bags = {r["doc_id"]: plain.word_bags(r["text"]) for r in rows if r["doc_id"] is not None}
    links = []
    ids = [i for i in bags if bags[i]]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = sum((bags[a] & bags[b]).values())
            total = sum(bags[a].values()) + sum(bags[b].values()) - both
            if both / total >= 0.8:
                links.append((a, b))
    root = plain.roots(bags, links)
    got = minhash.near_duplicates(docs.withColumn("key", F.lit(1)).withColumn("id", F.lit(1)).withColumn("rep", F.lit(1))).collect()
    assert len(got) == len(rows)
    wrong = [r for r in got if r["doc_id"] is not None and r["component_id"] != root[r["doc_id"]]]
    assert len(wrong) <= 0.01 * len(rows)
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    assert minhash.near_duplicates(empty).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    """A large group whose members are not all close to its first one, cut into small blocks."""
    rng = random.Random(12)
    stem = [f"w{i}" for i in range(300)]
    cases = []
    for i in range(120):
        words = list(stem)
        for p in rng.sample(range(300), 3 if i % 3 else 6):
            words[p] = f"x{i}_{p}"
        cases.append((i, " ".join(words)))
    frame = spark.createDataFrame(cases, "doc_id bigint, text string")
    bags = {i: plain.word_bags(t) for i, t in cases}
    links = [(a, b) for a in bags for b in bags if a < b and sum((bags[a] & bags[b]).values()) / sum((bags[a] | bags[b]).values()) >= 0.8]
    root = plain.roots(bags, links)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, block=8).collect()}
    assert sum(got[i] != root[i] for i in bags) <= 2


def test_samples_follow_weighted_similarity():
    rng = np.random.default_rng(3)
    shingles = np.sort(rng.integers(0, 2 ** 63, 400, dtype=np.uint64))
    w1, w2 = rng.uniform(0.5, 3, 400), rng.uniform(0.5, 3, 400)
    w2[:300] = w1[:300]
    sampler = minhash.Sampler(600)
    drawn = sampler.samples(np.repeat([0, 1], 400), np.tile(shingles, 2), np.r_[w1, w2], 2)
    true = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((drawn[0] == drawn[1]).mean() - true) < 0.06
    assert minhash.similarity((shingles, w1), (shingles, w2)) == pytest.approx(true)


def test_shingles(spark):
    cases = ["a b c d e f", "a b", "", "  a\tb\u00a0c\n", "x", "é é é é é é é"]
    data = "".join(cases).encode()
    offsets = np.append(0, np.cumsum([len(c.encode()) for c in cases]))
    owner, shingle, count = minhash.shingle_bags(np.frombuffer(data, np.uint8), offsets)
    for i, c in enumerate(cases):
        assert sorted(count[owner == i]) == sorted(plain.word_bags(c).values())
    alone = minhash.shingle_bags(np.frombuffer(b"a b c d e", np.uint8), np.array([0, 9]))[1]
    assert alone[0] in shingle[owner == 0]


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, docs):
    columns, current = docs.columns, docs
    kept = corpus_pipeline.keep_good(spark, current, SF)
    assert kept.columns == columns and kept.count() <= docs.count()
    one = corpus_pipeline.keep_one_of_each(spark, kept, SF)
    assert one.columns == columns
    ids = [r["doc_id"] for r in one.select("doc_id").collect() if r["doc_id"] is not None]
    assert len(set(ids)) == len(ids)
    clean = corpus_pipeline.redact(spark, one, SF)
    assert clean.columns == columns
    for r in clean.collect():
        assert not plain.base_spans(r["text"]) and (r["text"] is None or r["n_chars"] == len(r["text"]))
    mixed = corpus_pipeline.mix(spark, clean, SF)
    assert mixed.columns == columns
    check_packing(corpus_pipeline.pack(spark, mixed, SF).collect(), mixed.collect())


def test_pipeline_on_an_empty_table(spark, empty):
    current = empty
    for _, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, SF)
    assert current.count() == 0


def test_each_operator_has_its_query():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] == [str(i) for i in range(1, 11)]
