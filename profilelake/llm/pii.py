"""Personal data: rules find the certain spans, boosted trees decide on further candidates.

Everything that touches documents is column expressions. Generators propose
overlapping candidate spans; gradient-boosted trees, fitted in numpy on a bounded
sample of candidates, are written out as expressions over format and context
features; a threshold calibrated on held-out candidates selects what is added to
the spans of the rules. Fitted and calibrated is on what can be added: spans of
the rules rewritten, where they stand, into forms that no rule covers, against
look-alikes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rules' patterns, kinds in their order. Those used here match the same
# spans; possessive repeats and look-behinds keep long runs linear and off the stack.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text that lacks this has no match of the kind.
SEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: High-recall generators: (kind, seed, pattern); they overlap each other and the rules.
GENERATORS = (
    ("email", r"[(\[]\s?(?i:at)\s?[)\]]",
     r"[A-Za-z0-9._%+-]{1,64}\s?[(\[]\s?(?i:at)\s?[)\]]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[(\[]\s?(?i:dot)\s?[)\]])\s?[A-Za-z0-9-]{1,63}){1,4}"),
    ("email", "@", r"[A-Za-z0-9._%+-]{1,64}\s?@\s?(?:[A-Za-z0-9-]{1,63}\.){1,4}[A-Za-z]{2,12}"),
    ("ip", r"[0-9]\.[0-9]", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    ("ip", r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])"),
    ("card", r"[0-9]{3}[\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9]){12,18}"),
    ("phone", r"[0-9]{3}[\x20.)-]", r"\+?\(?[0-9]{1,4}\)?(?:[\x20.-]{1,2}\(?[0-9]{2,4}\)?){2,4}"),
)
BLOCK = 256                 # matches summed at once when places are computed
CONTEXT = 24                # code points looked at on either side
SAMPLE_DOCS, SAMPLE_ROWS = 20_000, 20_000       # bounds of the fitting sample
SAMPLE_SPANS = 400          # spans of each kind that are rewritten, at most
TREES, DEPTH, RATE, LEAST_LEAF = 24, 3, 0.3, 20
PRECISION = 0.99            # wanted of what is added, on held-out candidates

FEATURES = ("length", "digits", "letters", "spaces", "dots", "dashes", "brackets", "plus", "colons", "longest", "first_group",
            "word_before", "word_after", "says_phone", "says_card", "says_ip", "says_mail", "says_other", "kind_email", "kind_ip",
            "kind_card", "kind_phone", "quoted")
SPAN = "struct<start:int,end:int,kind:string>"


def bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Sums of an array's numbers before each place; blocks keep it near linear in the array's length."""
    zero = F.lit(0)

    def total(a):
        return F.aggregate(a, zero, lambda s, x: s + x)

    def inner(a, block, start):
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(F.slice(a, block * BLOCK + 1, F.lit(BLOCK)), state, lambda s, x: F.struct(
            (s["at"] + x).alias("at"), F.concat(s["sums"], F.array(s["at"])).alias("sums")))["sums"]

    def over(a):
        blocks = F.sequence(zero, F.floor((F.size(a) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: total(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
        return bound(totals, lambda t: F.flatten(F.transform(t, lambda x, b: inner(a, b, total(F.slice(t, F.lit(1), b))))))

    return bound(numbers, lambda a: F.when(F.size(a) > 0, over(a)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Matches of a pattern from left to right: array of (start, end, kind, value), in code points."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"),
                     F.transform(F.split(text, pattern), lambda g: F.length(g)).alias("gaps"))

    def placed(m):
        gaps = F.slice(m["gaps"], F.lit(1), F.size(m["values"]))
        before = running_sums(F.zip_with(gaps, m["values"], lambda g, v: g + F.length(v)))
        return F.transform(F.arrays_zip(before.alias("before"), gaps.alias("gap"), m["values"].alias("value")), lambda x: F.struct(
            (x["before"] + x["gap"]).alias("start"), (x["before"] + x["gap"] + F.length(x["value"])).alias("end"),
            F.lit(kind).alias("kind"), x["value"].alias("value")))

    return bound(found, placed)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda d: d != "")), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _spans(found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"], m["end"], m["kind"]))


def _if_seeded(text: Column, seed: str, then: Column, kind: str) -> Column:
    has = F.contains(text, F.lit(seed)) if seed == "@" else text.rlike(seed)
    return F.when(has, then).otherwise(F.array().cast(kind))


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one rule: leftmost, not overlapping; those that fail its check are left out."""
    found = F.filter(matches(text, PATTERNS[kind], kind), lambda m: _valid(kind, m["value"]))
    return _if_seeded(text, SEEDS[kind], _spans(found), f"array<{SPAN}>")


def in_order(spans: Column) -> Column:
    """By start, then kind in the order of KINDS, then end."""
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("rank"),
        s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"], s["end"], s["kind"]))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


# ---------------------------------------------------------------- candidates

CANDIDATE = "array<struct<start:int,end:int,kind:string,value:string>>"
SAYS = {"says_phone": "tel|phone|call|fax|mobil|cell|whatsapp|sms", "says_card": "card|visa|master|credit|amex|kredit|tarjeta|carte",
        "says_ip": r"\bip\b|host|server|addr", "says_mail": "mail|contact|write|kontakt", "says_other":
        "token|key|hash|version|licen[cs]e|isbn|order|invoice|serial|sha|uuid|doi|page"}


def candidates(text: Column) -> Column:
    """What the generators propose, except what a rule has found already."""
    return F.concat(*[_if_seeded(text, seed, matches(text, pattern, kind), CANDIDATE) for kind, seed, pattern in GENERATORS])


def features(text: Column, c: Column) -> dict[str, Column]:
    value, before = c["value"], F.lower(F.substring(text, F.greatest(c["start"] - CONTEXT, F.lit(0)) + 1, F.least(c["start"], F.lit(CONTEXT))))
    after = F.lower(F.substring(text, c["end"] + 1, F.lit(CONTEXT)))

    def count(pattern):
        return F.length(F.regexp_replace(value, f"[^{pattern}]", ""))

    groups = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    both = F.concat(before, F.lit(" "), after)
    out = {"length": F.length(value), "digits": count("0-9"), "letters": count("A-Za-z"), "spaces": count(r"\s"), "dots": count("."),
           "dashes": count(r"\-"), "brackets": count(r"()\[\]"), "plus": count("+"), "colons": count(":"),
           "longest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
           "first_group": F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)),
           "word_before": before.rlike(r"[\p{L}0-9.+-]$"), "word_after": after.rlike(r"^[\p{L}0-9]"),
           "quoted": before.rlike("[\"'=]\\s?$")}
    out |= {name: both.rlike(pattern) for name, pattern in SAYS.items()}
    out |= {f"kind_{k}": c["kind"] == k for k in KINDS}
    return {name: out[name].cast("int") for name in FEATURES}


@dataclass
class Trees:
    """Boosted regression trees on the log odds, as nested tuples (feature, limit, below, above), and a threshold."""

    base: float
    trees: list
    threshold: float
    of_kind: dict | None = None     # thresholds of single kinds, where they were calibrated

    def limit(self, kind: str) -> float:
        return self.threshold if self.of_kind is None else self.of_kind[kind]

    def odds(self, x: dict[str, Column]) -> Column:
        def value(node):
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, limit, below, above = node
            return F.when(x[name] <= limit, value(below)).otherwise(value(above))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + value(t)
        return total

    def odds_of(self, rows):
        """The same in numpy, rows x FEATURES."""
        import numpy as np

        def value(node, index):
            out = np.zeros(len(index))
            if not isinstance(node, tuple):
                return out + node
            below = rows[index, FEATURES.index(node[0])] <= node[1]
            out[below] = value(node[2], index[below])
            out[~below] = value(node[3], index[~below])
            return out

        return self.base + sum((value(t, np.arange(len(rows))) for t in self.trees), np.zeros(len(rows)))


def _grow(rows, gradient, weight, index, depth: int):
    """A tree that fits gradient / weight on the rows of ``index``."""
    import numpy as np

    g, h = gradient[index].sum(), weight[index].sum()
    best = (1e-6, None)
    if depth and len(index) >= 2 * LEAST_LEAF:
        for f in range(rows.shape[1]):
            x = rows[index, f]
            order = np.argsort(x, kind="stable")
            cut = np.flatnonzero(np.diff(x[order])) + 1
            cut = cut[(cut >= LEAST_LEAF) & (cut <= len(index) - LEAST_LEAF)]
            if not len(cut):
                continue
            gl, hl = np.cumsum(gradient[index][order])[cut - 1], np.cumsum(weight[index][order])[cut - 1]
            gain = gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, int(x[order][cut[k] - 1])))
    if best[1] is None:
        return float(RATE * g / (h + 1))
    f, limit = best[1]
    below = rows[index, f] <= limit
    return (FEATURES[f], limit, _grow(rows, gradient, weight, index[below], depth - 1), _grow(rows, gradient, weight, index[~below], depth - 1))


def _calibrated(score, truth) -> float:
    import numpy as np

    order = np.argsort(-score, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    last = np.append(np.diff(score[order]) != 0, True)[:len(order)]      # whole groups of equal scores
    good = np.flatnonzero((right >= PRECISION) & last & (np.arange(len(order)) >= 19))
    return float(score[order][good[-1]]) if len(good) else float("inf")


def boost(rows, labels, held=None) -> Trees:
    """Trees on three quarters of the rows; the threshold is calibrated on the others (``held``, or every fourth).

    It is the lowest score from which on the held-out rows keep PRECISION; none
    (nothing is added) where there is no such score or fewer than 20 rows above it.
    Each kind has one of its own as well, by which :func:`find` goes.
    """
    import numpy as np

    held = np.arange(len(rows)) % 4 == 3 if held is None else held
    x, y = rows[~held], labels[~held].astype(float)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    model = Trees(base, [], float("inf"))
    odds = np.full(len(x), base)
    for _ in range(TREES if len(x) else 0):
        p = 1 / (1 + np.exp(-odds))
        tree = _grow(x, y - p, p * (1 - p), np.arange(len(x)), DEPTH)
        model.trees.append(tree)
        odds += Trees(0.0, [tree], 0.0).odds_of(x)
    if held.any():
        score, truth, kind = model.odds_of(rows[held]), labels[held], rows[held]
        model.threshold = _calibrated(score, truth)
        of = {k: kind[:, FEATURES.index(f"kind_{k}")] == 1 for k in KINDS}
        model.of_kind = {k: _calibrated(score[i], truth[i]) for k, i in of.items()}
    return model


def _number(seed: Column, pattern: str) -> Column:
    """``pattern`` with each # replaced by a digit drawn from ``seed``."""
    drawn = F.translate(F.concat(F.md5(seed), F.md5(F.reverse(seed))), "abcdef", "012345")
    pieces, at = [], 1
    for run in re.findall("#+|[^#]+", pattern):
        pieces.append(F.substring(drawn, at, len(run)) if run[0] == "#" else F.lit(run))
        at += len(run) if run[0] == "#" else 0
    return F.concat(*pieces)


def rewritten(kind: str, value: Column) -> Column:
    """Forms of a rule's span: array of (lead, mark, tail, y).

    y is 1 where ``mark`` is the same datum in a form that only generators
    propose, 0 where it is a look-alike that is no personal data.
    """
    def form(y, mark, lead="", tail=""):
        return F.struct(F.lit(lead).alias("lead"), mark.alias("mark"), F.lit(tail).alias("tail"), F.lit(y).alias("y"))

    if kind == "email":
        name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)

        first, second = (F.coalesce(F.nullif(F.regexp_extract(x, "[A-Za-z]+", 0), F.lit("")), F.lit("look")) for x in (name, host))

        def mail(at, dot=".", name=name, host=host):
            return form(1, F.concat(name, F.lit(at), F.array_join(F.split(host, r"\."), dot)))

        def prose(at, dot, then):
            return form(0, F.concat(first, F.lit(at), second, F.lit(dot), F.lit(then)))

        return F.array(mail(" (at) "), mail("(at)"), mail(" [at] "), mail("[AT]"), mail(" @ "), mail(" (at) ", " (dot) "), mail(" [at] ", " [dot] "),
                       mail("(at)", "(dot)"),
                       *[mail(at, dot, first, F.substring_index(host, ".", -2)) for at, dot in ((" (at) ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."))],
                       prose(" (at) ", ". ", "Then"), prose(" [at] ", ". ", "We"), prose(" (at) ", " . ", "and"),
                       prose(" (at)", ". ", "It"), prose(" @", ".", "route"), prose(" @", ".", "setter"))
    if kind == "ip":
        digest = F.md5(value)

        def hexes(width, n):
            return F.array_join(F.array(*[F.regexp_replace(F.substring(digest, 4 * i + 1, width), "^0+(?=.)", "") for i in range(8 - n, 8)]), ":")

        widths = F.md5(F.reverse(value))

        def mixed(nth):
            width = [F.conv(F.substring(widths, 8 * nth + i + 1, 1), 16, 10).cast("int") % 4 + 1 for i in range(8)]
            return F.array_join(F.array(*[F.regexp_replace(F.substr(digest, F.lit(4 * i + 1), w), "^0+(?=.)", "") for i, w in enumerate(width)]), ":")

        pairs = F.array_join(F.array(*[F.substring(digest, 2 * i + 1, 2) for i in range(8)]), ":")
        return F.array(form(1, hexes(4, 8)), form(1, F.upper(hexes(4, 8))), form(1, F.concat(F.lit("2001:db8:0:"), hexes(4, 5))),
                       form(1, mixed(0)), form(1, mixed(1)), form(1, F.concat(F.lit("2001:db8:"), F.substring_index(mixed(2), ":", 6))), form(1, F.concat(F.lit("fe80:0:0:0:"), hexes(4, 4))), form(1, F.concat(F.lit("2001:0db8:0000:0000:"), hexes(3, 4))),
                       form(0, pairs), form(0, F.upper(pairs)), form(0, _number(value, "##:##:##:##:##:##:##:##")), form(0, _number(value, "#:#:#:#:#:#:#:#")),
                       form(0, F.regexp_replace(value, "^[0-9]+", "999")), form(0, _number(value, "9#.8#.3##.7##")), form(0, _number(value, "#.##.###"), "version "))
    if kind == "phone":
        bare = F.substring(value, 2, 1 << 20)
        home = F.regexp_replace(value, r"^\+[0-9]{1,3}[\x20.-]*", "")

        def parted(x, by):
            return F.array_join(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), by)

        meant = [form(1, bare), form(1, home), form(1, F.concat(F.lit("00"), bare))] + [form(1, parted(x, by)) for x in (bare, home) for by in "- ."]
        named = [form(0, parted(x, by), lead) for lead, x, by in (("order ", home, "-"), ("invoice ", home, " "), ("serial ", bare, "-"), ("version ", home, "."), ("isbn ", bare, "-"))]
        plain = [form(0, _number(value, x)) for x in ("20##-0#-1#", "20##-1#-2# 1# 3#", "2#.0#.20##", "1#.1#.20## 1#.4#", "####-####-####", "#### #### ####",
                                                      "### ### ### ###", "## ### ## ###", "#### ### ####", "##.###.###", "# ### ###", "## ## ## ## ##", "#### #### #### ####")]
        return F.array(*meant, *named, *plain)
    # a card with its month behind: the rule reads both as one number; and numbers with a wrong check digit
    wrong = F.concat(F.substring(value, 1, F.length(value) - 1), ((F.substring(value, -1, 1).cast("int") + 1) % 10).cast("string"))
    digits = F.regexp_replace(wrong, "[^0-9]", "")
    return F.array(form(1, value, "", " 12/27"), form(1, value, "", " 09-28"), form(0, wrong), form(0, wrong, "", " 12/27"), form(0, wrong, "", " 09-28"),
                   form(0, F.regexp_replace(digits, "(.{4})(?=.)", "$1 ")), form(0, F.regexp_replace(digits, "(.{4})(?=.)", "$1-")))


def free_of(found: Column, base: Column) -> Column:
    """Candidates that overlap no span of a rule: those that can be added."""
    return F.filter(found, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> Trees:
    """Trees fitted on candidates of at most about SAMPLE_DOCS documents, 2 * SAMPLE_ROWS candidates at most.

    All are candidates that could be added. Right ones are spans of the rules in
    other forms (:func:`rewritten`) in their own surroundings; wrong ones are
    rewritten look-alikes, and the documents' own candidates that fail the check
    of their kind. Own candidates that pass it may be either and are not learnt
    from. Rows of one value are held out together.
    """
    import numpy as np

    n = docs.count()
    one_in = max(1, -(-n // SAMPLE_DOCS))
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    some = docs.where(F.pmod(order, F.lit(one_in)) == 0).select(F.col(text_col).alias("text"), order.alias("o")).where(
        F.col("text").rlike(r"@|[0-9]|[(\[]\s?(?i:at)\s?[)\]]"))
    text, c = F.col("text"), F.col("c")

    def base():
        return F.concat(*[base_spans(text, k) for k in KINDS])

    def piece(a, b):
        return F.substring(text, a + 1, b - a)

    def valid():
        checks = F.lit(True)
        for k in KINDS:
            checks = F.when(c["kind"] == k, _valid(k, c["value"])).otherwise(checks)
        return checks

    spans = some.select("text", F.explode(base()).alias("s")).select(
        piece(F.greatest(F.col("s.start") - 2 * CONTEXT, F.lit(0)), F.col("s.start")).alias("before"), piece(F.col("s.start"), F.col("s.end")).alias("value"),
        piece(F.col("s.end"), F.col("s.end") + 2 * CONTEXT).alias("after"), F.col("s.kind").alias("kind"))
    spans = spans.distinct().withColumn("o", F.xxhash64(F.lit(seed), "value", "before"))
    first = Window.partitionBy("kind").orderBy("o", "before", "after")
    spans = spans.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE_SPANS)
    forms = F.array().cast("array<struct<lead:string,mark:string,tail:string,y:int>>")
    for k in KINDS:
        forms = F.when(F.col("kind") == k, bound(F.col("value"), partial(rewritten, k))).otherwise(forms)
    planted = spans.select("before", "after", "kind", F.xxhash64("value").alias("o"), F.explode(forms).alias("f")).select(
        F.col("kind").alias("of"), "o", F.col("f.y").alias("meant"), F.concat("before", "f.lead", "f.mark", "f.tail", "after").alias("text"),
        (F.length("before") + F.length("f.lead")).alias("start"), F.length("f.mark").alias("size"))
    planted = planted.select("*", F.explode(free_of(candidates(text), base())).alias("c")).where(
        (c["start"] < F.col("start") + F.col("size")) & (F.col("start") < c["end"]))
    # a part of the datum, under its own kind, is neither right nor wrong
    whole = (c["start"] <= F.col("start")) & (c["end"] >= F.col("start") + F.col("size"))
    own = (F.col("meant") == 1) & (c["kind"] == F.col("of"))
    planted = planted.where(~own | whole).withColumn("y", own.cast("int"))
    wrong = some.select("text", "o", F.explode(free_of(candidates(text), base())).alias("c")).where(~valid()).withColumn("y", F.lit(0))

    sample = []
    for rows in (planted, wrong):
        part = rows.select("o", "y", F.array(*features(text, c).values()).alias("x"), c["value"].alias("value"))
        sample += part.orderBy(F.xxhash64(F.lit(seed), "o", "value"), "o", "value", "x", "y").limit(SAMPLE_ROWS).collect()
    if not any(r["y"] for r in sample):
        return Trees(0.0, [], float("inf"))
    return boost(np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample]), np.array([r["o"] % 4 == 3 for r in sample]))


def find(docs: DataFrame, model: Trees, *, text_col: str = "text", base_col: str = "base", all_col: str = "spans") -> DataFrame:
    """``docs`` with two arrays of (start, end, kind), in code points, in order.

    ``base``: what the rules find. ``spans``: those and the added ones: the
    candidates of every generator that overlap no rule's span and reach the
    trees' threshold for their kind; of overlapping ones the likeliest, then the first. A null
    or empty text has none. Rows are neither dropped nor moved; no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = F.concat(*[base_spans(text, k) for k in KINDS])
    out = docs.withColumn(base_col, in_order(every))
    limits = {k: model.limit(k) for k in KINDS if model.limit(k) < float("inf")}
    if not limits:
        return out.withColumn(all_col, F.col(base_col))
    free = free_of(candidates(text), F.col(base_col))
    scored = F.filter(F.transform(free, lambda c: F.struct(
        (-model.odds(features(text, c))).alias("cost"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))),
        lambda c: reduce(or_, [(c["kind"] == k) & (c["cost"] <= -limit) for k, limit in limits.items()]))
    state = F.array().cast(f"array<{SPAN}>")
    chosen = F.aggregate(F.array_sort(scored), state, lambda kept, c: F.when(
        F.exists(kept, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"])), kept).otherwise(
        F.concat(kept, F.array(F.struct(c["start"], c["end"], c["kind"])))))
    return out.withColumn(all_col, in_order(F.concat(F.col(base_col), chosen)))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones together, replaced by the first one's kind in brackets."""
    state = F.array().cast(f"array<{SPAN}>")

    def absorb(kept, s):
        last = F.element_at(kept, -1)
        joined = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))))
        return F.when((F.size(kept) > 0) & (s["start"] < F.try_element_at(kept, F.lit(-1))["end"]), joined).otherwise(F.concat(kept, F.array(s)))

    merged = F.aggregate(spans, state, absorb)
    starts = F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["end"]))
    pieces = F.zip_with(starts, merged, lambda a, s: F.concat(
        F.substring(text, a + 1, F.coalesce(s["start"], F.lit(1 << 30)) - a),
        F.coalesce(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")), F.lit(""))))
    return F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(text)
