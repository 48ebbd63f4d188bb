"""Column expressions for cleaning, parsing and looking up text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def utf8(c: Column) -> Column:
    """Text of bytes; what is not UTF-8 is dropped."""
    return F.replace(F.make_valid_utf8(c.cast("string")), F.lit("\ufffd"), F.lit(""))


def text_value(c: Column, dtype: T.DataType) -> Column:
    """Readable string of a scalar, byte string or character array; null gives ''."""
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, T.BinaryType):
            c = F.transform(c, utf8)
        c = F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), "")
    elif isinstance(dtype, T.BinaryType):
        c = utf8(c)
    else:
        c = c.cast("string")
    return F.coalesce(strip(F.translate(c, "\x00", "")), F.lit(""))


def text_column(df: DataFrame, name: str) -> Column:
    """:func:`text_value` of a column, or '' when the frame lacks it."""
    if name not in df.columns:
        return F.lit("")
    return text_value(F.col(name), df.schema[name].dataType)


def number(c: Column) -> Column:
    """Numeric column as double, NaN as null."""
    return F.nullif(c.cast("double"), F.lit(float("nan")))


# Texts that are read as numbers.
NUMBER_PATTERN = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))$"
INTEGER_PATTERN = r"^[+-]?\d{1,19}$"


def text_number(c: Column) -> Column:
    """Number written in a text, else null. The pattern comes first because a
    failing cast is far dearer than a failing match."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def number_value(c: Column, dtype: T.DataType) -> Column:
    """Number of a scalar, of the first element of a numeric array, or of a character array."""
    if isinstance(dtype, T.NumericType):
        return number(c)
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.NumericType):
        return number(F.get(c, F.lit(0)))
    return text_number(text_value(c, dtype))


def number_column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    return number_value(F.col(name), df.schema[name].dataType)


def integer(c: Column) -> Column:
    """'5906527' and '5906527.0' both give 5906527; anything else null."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(INTEGER_PATTERN), s.try_cast("bigint")).otherwise(text_number(s).try_cast("bigint"))


def null_if_blank(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def matched(c: Column, pattern: str, group: int) -> Column:
    """Regex group, or null when the pattern does not match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _first_value(entries: Column) -> Column:
    return F.get(entries, F.lit(0)).getField("value")


def lookup(m: Column, names: Sequence[str]) -> Column:
    """Map value under the first of ``names`` that is present, ignoring case."""
    entries = F.map_entries(m)

    def under(name: str) -> Column:
        return _first_value(F.filter(entries, lambda e: F.lower(e["key"]) == name))

    return F.coalesce(*[under(n) for n in dict.fromkeys(name.lower() for name in names)])


def metadata_matches(m: Column, wanted: dict[str, object]) -> Column:
    """True where every wanted key is present and equal (numbers as numbers, text any case)."""
    result = F.lit(True)
    for key, value in wanted.items():
        found = strip(lookup(m, [key]))
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            same = text_number(found) == F.lit(float(value))
        else:
            same = (F.lower(found) == F.lower(strip(F.lit(str(value))))) & (found != "")
        result = result & F.coalesce(same, F.lit(False))
    return result


def contains_any(low: Column, words: Iterable[str]) -> Column:
    """Substring test of a lower-cased text against fixed words. One alternation
    keeps the generated code small."""
    return F.coalesce(low.rlike("|".join(rf"\Q{w}\E" for w in words)), F.lit(False))


def tokens_estimate(length: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(length / 4)).cast("bigint")


def shorten(c: Column, width: int = 200, mark: str = "...") -> Column:
    """Collapse white space; cut at a word boundary so that text and mark fit in ``width``."""
    flat = F.regexp_replace(strip(c), r"\s+", " ")
    room = width - len(mark)
    # room+1 characters hold the word that must end at the cut
    kept = F.regexp_extract(F.substring(flat, 1, room + 1), rf"^(.{{0,{room}}})(?:\s|$)", 1)
    cut = F.concat(F.rtrim(kept), F.lit(mark))
    return F.when(F.length(flat) <= width, flat).otherwise(cut)


def json_safe(c: Column, dtype: T.DataType) -> Column:
    """Text form used in previews: ISO timestamps, NaN and infinities as null."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        fraction = F.date_format(c, ".SSSSSS")
        return F.when(fraction == ".000000", whole).otherwise(F.concat(whole, fraction))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(~bad, c).cast("string")
    return c.cast("string")


def json_cell(c: Column, dtype: T.DataType) -> Column:
    """A cell of a JSON payload: numbers and flags stay what they are, NaN and
    infinities are null, everything else is its text form."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c
    return json_safe(c, dtype)


def row_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """``name:value`` pairs of the non-null columns joined by blanks."""
    parts = []
    for name in columns:
        value = json_safe(F.col(name), df.schema[name].dataType)
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}:"), value)))
    return F.concat_ws(" ", *parts)


def row_map(df: DataFrame, columns: Sequence[str]) -> Column:
    """Map of the non-null columns as text."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("key"), json_safe(F.col(name), df.schema[name].dataType).alias("value"))
        for name in columns
    ])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def csv_line(df: DataFrame, columns: Sequence[str]) -> Column:
    """One CSV line of the given columns, timestamps as text."""
    fields = [json_safe(F.col(c), df.schema[c].dataType).alias(c) for c in columns]
    return F.to_csv(F.struct(*fields))
