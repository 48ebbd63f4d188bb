"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilelake.llm import chat, langid, lines, merkle, minhash, mixing, packing, phrases, pii, quality, repeats, topk, vector_links
from profilelake.llm.common import crc_of_id

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_sum_of_squares_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op2_impact_ordered_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.clean(table(spark, sf_dir, "embeddings"), "embedding").select(
        "vec_id", F.transform("embedding", lambda x: F.floor(1024 * x.cast("double"))).alias("vector"))
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"), 10)


@query("op3_rotated_code_links", """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
 WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
 AND list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT a AS vec_id, a AS other FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.link(table(spark, sf_dir, "embeddings"))


OWN_CASE = "\\### Assistant: </turn> ok"
OP4_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, 2 * length(text) - length(replace(replace(replace(replace(text, '#', ''), '<', ''), '\', ''), ':', '')) AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(4 + length(role) + 2 + escaped + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op4_schema_fingerprint_chat", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(OWN_CASE).alias("text"))
    records = rows.unionByName(own).select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    turns = chat.canonical_turns(records, "record").select("conv_id", "turn", F.posexplode("turns").alias("nth", "t")).select(
        "conv_id", "turn", "nth", "t.role", "t.text")
    formatted = chat.format_turns(turns, conv="conv_id", order=[F.col("turn"), F.col("nth")])
    read = formatted.select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"),
                            chat.read_turns(F.col("formatted")).alias("turns"),
                            chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


@query("op5_curriculum_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"), schedules=mixing.CURRICULUM)
    return planned.select("doc_id", "size", "source_size", "target", "taken", "position").repartitionByRange(
        F.col("position").asc_nulls_last(), F.xxhash64("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last())


@query("op6_neighbour_vote_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(crc_of_id("doc_id") % 5 != 0))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_of_id("doc_id") % 5 == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_suffix_array_repeats")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                        F.col("kept").alias("kept_sha256"))


@query("op8_boosted_candidate_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    count = [number(k) for k in pii.KINDS]
    return found.select("doc_id", *count, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
                        pii.written(F.col("spans")).alias("spans"))


@query("op9_weighted_minhash_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_byte_network_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = (crc_of_id("doc_id") % 4 == 2).alias("held_out")
    net = langid.fit(docs.where(crc_of_id("doc_id") % 4 != 2))
    return langid.predict(docs.select("doc_id", "text", held), net, keep=("held_out",))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase FROM w, range(1, 6) t(len) WHERE len(w) >= len),
f AS (SELECT lang, len, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE len > 1 AND f >= 100),
i AS (SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(a) AS longer FROM c, range(1, 6) s(i), range(1, 6) t(j) WHERE i < j AND j <= len AND j - i + 1 < len GROUP BY ALL),
k AS (SELECT c.*, k FROM c, range(1, 5) t(k) WHERE k < len),
s AS (SELECT k.lang, k.phrase, k.a, x.f AS l, y.f AS r, n.n, CAST(1000 * CAST(k.a AS HUGEINT) * CAST(n.n AS HUGEINT) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)) AS BIGINT) AS score,
 row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY 1000 * CAST(k.a AS HUGEINT) * CAST(n.n AS HUGEINT) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)), k) AS nth
 FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k + 1:], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT s.* FROM s LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 100 * a))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b) WHERE rank <= 2000"""


@query("op11_misra_gries_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


# crc32 bit by bit over the digits; levels, siblings and folding by recursion
OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, lang, n_chars, source, text,
 list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM documents),
f AS (SELECT *, (coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
 || coalesce(strlen(lang) || ':' || lang, '-')) AS head, coalesce(strlen(text) || ':' || text, '-') AS tail,
 coalesce(xor(crc, 4294967295) % 7 = 0, false) AS hit FROM d),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
 sha256(head || coalesce(strlen(CAST(n_chars + CAST(hit AS INTEGER) AS VARCHAR)) || ':' || (n_chars + CAST(hit AS INTEGER)), '-') || tail) AS shown FROM f),
r AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
sub(g, level, i, h, n) AS (SELECT g, 0, i, leaf, count(*) OVER (PARTITION BY g) FROM r
 UNION ALL SELECT g, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM sub WHERE n > 1 GROUP BY g, level, i // 2, n),
sr AS (SELECT g, h, level FROM sub WHERE n = 1),
top(level, i, h, n) AS (SELECT 0, g, h, count(*) OVER () FROM sr
 UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, i // 2, n),
root AS (SELECT h, level FROM top WHERE n = 1),
steps AS (SELECT r.g, r.i, s.level AS tier, (r.i >> s.level) & 1 AS bit, b.h FROM r JOIN (SELECT DISTINCT g, level, n FROM sub WHERE n > 1) s ON s.g = r.g
  LEFT JOIN sub b ON b.g = r.g AND b.level = s.level AND b.i = xor(r.i >> s.level, 1)
 UNION ALL SELECT r.g, r.i, 1000 + s.level, (r.g >> s.level) & 1, b.h FROM r, (SELECT DISTINCT level FROM top WHERE n > 1) s
  LEFT JOIN top b ON b.level = s.level AND b.i = xor(r.g >> s.level, 1)),
nth AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY tier) AS k FROM steps),
fold(g, i, k, h) AS (SELECT g, i, CAST(0 AS BIGINT), shown FROM r
 UNION ALL SELECT f.g, f.i, n.k, sha256(CASE WHEN n.bit = 1 THEN coalesce(n.h, '') || f.h ELSE f.h || coalesce(n.h, '') END) FROM fold f JOIN nth n ON n.g = f.g AND n.i = f.i AND n.k = f.k + 1),
p AS (SELECT r.g, r.i, coalesce(string_agg(n.h, '' ORDER BY n.k), '') AS proof, coalesce(max(n.k), 0) AS k FROM r LEFT JOIN nth n ON n.g = r.g AND n.i = r.i GROUP BY r.g, r.i)
SELECT r.doc_id, r.leaf, sr.h AS subroot, root.h AS root, sha256(p.proof) AS proof_sha256, fold.h AS folded_root, fold.h = root.h AS verified
FROM r JOIN sr ON sr.g = r.g JOIN p ON p.g = r.g AND p.i = r.i JOIN fold ON fold.g = r.g AND fold.i = r.i AND fold.k = p.k, root"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    tampered = F.when(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, merkle.leaf_digest([doc_id, source, lang, n_chars + 1, text]))
    leaves = docs.select("doc_id", "lang", merkle.leaf_digest([doc_id, source, lang, n_chars, text]).alias("leaf"), tampered.alias("tampered"))
    found = merkle.manifest(leaves, "lang", ["doc_id"], keep=("doc_id", "tampered"))
    folded = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("proof"))).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(range(len(lines))) AS nth, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.largest AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r"""


@query("op13_perfect_hash_line_dedup", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
