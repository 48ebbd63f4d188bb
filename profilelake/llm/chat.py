"""Chat formatting: schema fingerprints choose how a record becomes turns, turns become text.

Records of any layout arrive as variants. The fingerprint of a record is a hash
of its nested field paths; a table of declarative mappings, looked up by
fingerprint, says which paths hold the turns. Everything is column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template. A turn is "### <role>: <text></turn>\n".
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
MARK = "\\"                                             # escapes are a mark and one letter
ESCAPES = ((MARK, MARK), ("#", "h"), ("<", "l"), (":", "c"))
LEARNED_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """A mapping from one set of field paths to turns.

    ``paths``: the leaf paths of a record, such as ``$.messages[].role``; the
    order does not matter. ``turns``: (role, path) pairs with a fixed role and
    a text path each, in order. ``repeated``: (array path, role field, text
    field) for layouts with a list of messages. ``flat``: (role path, text
    path) for one message per record. ``roles`` renames role values.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    repeated: tuple[str, str, str] | None = None
    flat: tuple[str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()


HUMAN_GPT = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("message", ("$.role", "$.text"), flat=("$.role", "$.text")),
    Layout("message content", ("$.role", "$.content"), flat=("$.role", "$.content"), roles=HUMAN_GPT),
    Layout("prompt", ("$.prompt", "$.completion"), turns=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("prompt response", ("$.prompt", "$.response"), turns=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("instruction", ("$.instruction", "$.output"), turns=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction with input", ("$.instruction", "$.input", "$.output"),
           turns=(("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("messages", ("$.messages[].role", "$.messages[].content"), repeated=("$.messages", "role", "content"), roles=HUMAN_GPT),
    Layout("system and messages", ("$.system", "$.messages[].role", "$.messages[].content"),
           turns=(("system", "$.system"),), repeated=("$.messages", "role", "content"), roles=HUMAN_GPT),
    Layout("conversations", ("$.conversations[].from", "$.conversations[].value"),
           repeated=("$.conversations", "from", "value"), roles=HUMAN_GPT),
)


def _type_text(paths) -> str:
    """The nested field names of paths, written as the engine writes a variant's schema, without types."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.removeprefix("$.").split("."):
            node = node.setdefault(part, {})

    def written(node: dict) -> str:
        if not node:
            return ""
        fields = []
        for key in sorted(node):
            inner = written(node[key])
            fields.append(f"{key.removesuffix('[]')}: " + (f"ARRAY<{inner}>" if key.endswith("[]") else inner))
        return "OBJECT<" + ", ".join(fields) + ">"

    return written(tree)


def field_paths(record: Column) -> Column:
    """Nested field names of a variant, sorted, in one text; leaf types and nulls do not show."""
    leaf = r"(?<=[:<] ?)(STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|BINARY|DATE|TIMESTAMP(_NTZ)?|UUID|VARIANT|DECIMAL\(\d+,\s*\d+\))(?=[,>])"
    return F.regexp_replace(F.schema_of_variant(record), leaf, "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def layout_fingerprint(layout: Layout) -> Column:
    return F.xxhash64(F.lit(_type_text(layout.paths)))


def canonical_turns(records: DataFrame, record: str, layouts=LAYOUTS) -> DataFrame:
    """``records`` with ``layout`` (name) and ``turns`` (array of role, text) in place of ``record``.

    A record whose fingerprint no layout has gets a null layout and null turns,
    for the caller to count or set aside; a null record likewise. A null text is
    empty. A layout's missing array gives its fixed turns only.
    """
    print_, r = F.col("record_fingerprint"), F.col(record)
    names, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")

    def text(path):
        return F.coalesce(F.try_variant_get(r, path, "string"), F.lit(""))

    def renamed(value, layout):
        for old, new in layout.roles:
            value = F.when(value == old, F.lit(new)).otherwise(value)
        return F.coalesce(value, F.lit(""))

    def message(layout, role, body):
        return lambda m: F.struct(renamed(m[role], layout).alias("role"), F.coalesce(m[body], F.lit("")).alias("text"))

    for layout in layouts:
        fixed = [F.struct(F.lit(role).alias("role"), text(path).alias("text")) for role, path in layout.turns]
        parts = [F.array(*fixed)] if fixed else []

        if layout.flat:
            role, body = layout.flat
            parts.append(F.array(F.struct(renamed(F.try_variant_get(r, role, "string"), layout).alias("role"), text(body).alias("text"))))
        if layout.repeated:
            path, role, body = layout.repeated
            kind = f"array<struct<{role}:string,{body}:string>>"
            parts.append(F.coalesce(F.transform(
                F.try_variant_get(r, path, kind), message(layout, role, body)),
                F.array().cast("array<struct<role:string,text:string>>")))
        hit = print_ == layout_fingerprint(layout)
        names = F.when(hit, F.lit(layout.name)).otherwise(names)
        turns = F.when(hit, F.concat(*parts)).otherwise(turns)
    printed = records.withColumn("record_fingerprint", fingerprint(r))
    return printed.withColumns({"layout": names, "turns": turns}).drop(record, "record_fingerprint")


def escaped(text: Column) -> Column:
    """The text without any character that begins a control string; see :func:`unescaped`."""
    for plain, letter in ESCAPES:       # the mark itself first
        text = F.replace(text, F.lit(plain), F.lit(MARK + letter))
    return text


def unescaped(text: Column) -> Column:
    """What :func:`escaped` was given: read from left to right, a doubled mark is a mark."""
    def part(p):
        for plain, letter in ESCAPES[1:]:
            p = F.replace(p, F.lit(MARK + letter), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), MARK)


def format_turns(turns: DataFrame, *, conv: str, order: list[Column], role: str = "role", text: str = "text",
                 learned: str = LEARNED_ROLE) -> DataFrame:
    """One row per conversation from one row per turn: ``formatted`` and ``loss_spans``.

    ``loss_spans`` are the code point ranges [start, end) of ``formatted`` that
    a model learns from: the escaped text of each turn of the ``learned`` role.
    Null roles and texts are empty; a null conversation is one of its own. Turns
    stand by ``order``, then role and text, so that equal orders give one result.

    A conversation becomes one text, so its turns meet in one row; turns are
    joined there by the engine's own list aggregate after a sort.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(
        F.col(conv).alias("conv"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], name.alias("role"), said.alias("said")).alias("t"))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # escaped after the sort: escapes would change the order of texts
    whole = whole.withColumn("ts", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), escaped(t["said"]).alias("body"))))
    head = F.transform("ts", lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(COLON)))
    whole = whole.withColumn("heads", head)
    pieces = F.zip_with("heads", "ts", lambda h, t: F.concat(h, t["body"], F.lit(CLOSE)))
    # running start of each turn: lengths are summed once, over numbers only
    lengths = F.zip_with("heads", "ts", lambda h, t: F.struct(
        F.length(h).alias("head"), F.length(t["body"]).alias("body"), (t["role"] == learned).alias("learned")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, x):
        begin = acc["at"] + x["head"]
        return F.struct(
            (begin + x["body"] + len(CLOSE)).alias("at"),
            F.when(x["learned"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), (begin + x["body"]).alias("end")))))
            .otherwise(acc["spans"]).alias("spans"))

    return whole.select(
        F.col("conv").alias(conv), F.array_join(pieces, "").alias("formatted"),
        F.aggregate(lengths, start, step)["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(p):
        inner = F.substring(p, len(OPEN) + 1, 1 << 30)
        at = F.locate(COLON, inner)
        return F.struct(unescaped(F.substring(inner, F.lit(1), at - 1)).alias("role"),
                        unescaped(F.substring(inner, at + len(COLON), F.lit(1 << 30))).alias("text"))

    return F.transform(parts, turn)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """Unescaped text under the loss spans, joined."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
