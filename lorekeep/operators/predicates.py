"""Predicates over fields whose type may differ from note to note (survey F2-F9, F11-F13, F16, F17).

A field is either a typed column or a JSON text (a value of the front-matter map).  Every predicate is
two-valued: it gives true or false, never null, so its negation holds for notes that lack the field.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fold import fold_text, nfc

Literal = str | float | int | bool | None


@dataclass(frozen=True)
class Field:
    """``kind``: string, number, boolean, strings (an array), time or json."""

    col: Column
    kind: str


def typed(df: DataFrame, name: str) -> Field:
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return Field(col, "string")
    if isinstance(kind, T.BooleanType):
        return Field(col, "boolean")
    if isinstance(kind, T.NumericType):
        return Field(col, "number")
    if isinstance(kind, T.ArrayType):
        return Field(col, "strings")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return Field(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "string")
    return Field(F.to_json(col), "json")


def map_value(df: DataFrame, map_column: str, key: str) -> Field:
    """Value of a front-matter key: the exact spelling first, else the first whose folded spelling is equal."""
    exact = F.col(map_column).getItem(nfc(key))
    folded = F.filter(F.map_entries(map_column), lambda e: F.lower(e["key"]) == fold_text(key))
    return Field(F.coalesce(exact, F.try_element_at(folded, F.lit(1))["value"]), "json")


def number_text(x: float | int) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e21 else repr(float(x))


def _scalar(j: Column) -> Column:
    """Content of a JSON scalar as text."""
    return F.get_json_object(F.concat(F.lit('{"v":'), j, F.lit("}")), "$.v")


def elements(field: Field) -> Column:
    """JSON texts of a list's members, or the value alone, of a JSON field; empty where it is absent."""
    j = field.col
    members = F.from_json(j, "array<variant>")
    listed = F.transform(members, lambda v: F.to_json(v))
    return F.when(j.isNull(), F.array().cast("array<string>")).when(j.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array(j))


def _kind(j: Column) -> Column:
    return F.substring(j, 1, 1)


def _two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def loose_equal(field: Field, value: Literal) -> Column:
    """Equality of the LIST/TABLE language: strings fold, different types compare by their text, null only equals an explicit null, lists match by any member."""
    if field.kind == "json":
        null = value is None

        def one(j: Column) -> Column:
            c = _kind(j)
            if null:
                return c == "n"
            if isinstance(value, bool):
                return (c != "n") & (_scalar(j) == str(value).lower())
            if isinstance(value, int | float):
                return F.when(c.isin(*"-0123456789"), j.cast("double") == float(value)).otherwise((c != "n") & (_scalar(j) == number_text(value)))
            return F.when(c == '"', F.lower(_scalar(j)) == fold_text(value)).otherwise((c != "n") & (_scalar(j) == nfc(value)))

        return _two_valued(F.exists(elements(field), one))
    if value is None:
        return F.lit(False)  # a typed column tells absent and null not apart: both are absent
    if field.kind == "strings":
        want = fold_text(value) if isinstance(value, str) else (str(value).lower() if isinstance(value, bool) else number_text(value))
        return _two_valued(F.exists(field.col, lambda x: (F.lower(x) if isinstance(value, str) else x) == want))
    if field.kind == "number":
        if isinstance(value, bool):
            return F.lit(False)
        if isinstance(value, int | float):
            return _two_valued(field.col == F.lit(value))
        return _two_valued(field.col == F.lit(float(value))) if re.fullmatch(r"-?\d+(\.\d+)?", value) and number_text(float(value)) == value else F.lit(False)
    if field.kind == "boolean":
        return _two_valued(field.col == F.lit(value)) if isinstance(value, bool) else (_two_valued(field.col == F.lit(value == "true")) if value in ("true", "false") else F.lit(False))
    if isinstance(value, str):
        return _two_valued(F.lower(field.col) == fold_text(value))
    return _two_valued(field.col == (str(value).lower() if isinstance(value, bool) else number_text(value)))


def loose_contains(field: Field, value: Literal) -> Column:
    """Lists by member equality, strings by folded part; anything else is false."""
    if field.kind == "strings":
        return loose_equal(field, value)
    if field.kind == "string":
        return _two_valued(F.lower(field.col).contains(fold_text(value))) if isinstance(value, str) else F.lit(False)
    if field.kind == "json":
        part = F.lower(_scalar(field.col)).contains(fold_text(value)) if isinstance(value, str) else F.lit(False)
        return _two_valued(F.when(field.col.startswith("["), loose_equal(field, value)).when(field.col.startswith('"'), part).otherwise(False))
    return F.lit(False)


def like_parts(pattern: str) -> list[str]:
    """The texts between the ``*`` of a pattern, lower-cased; a back-slash makes the next character literal."""
    if len(pattern) > 512:
        raise ValueError("LIKE pattern is longer than 512 characters")
    parts, literal = [""], False
    for k, c in enumerate(pattern):
        if not literal and c == "\\" and k + 1 < len(pattern):
            literal = True
        elif not literal and c == "*":
            parts.append("")
        else:
            parts[-1] += c
            literal = False
    return [x.lower() for x in parts]


def like_match(text: Column, parts: list[str]) -> Column:
    """Whole-value match: each part is looked for from the end of the one before on, so a value is read once a part and nothing is tried again."""
    low = F.lower(text)
    if len(parts) == 1:
        return low == parts[0]
    first, *inner, last = parts
    inner = [x for x in inner if x]
    place = F.lit(len(first) + 1)
    if inner:
        place = F.aggregate(F.array(*map(F.lit, inner)), place, lambda at, part: F.when((at > 0) & (F.call_function("locate", part, low, at) > 0), F.call_function("locate", part, low, at) + F.length(part)).otherwise(0))
    return low.startswith(first) & low.endswith(last) & (place > 0) & (place <= F.length(low) - len(last) + 1)


def like(field: Field, value: Literal) -> Column:
    """Whole-value match of any string, ignoring case."""
    if not isinstance(value, str):
        return F.lit(False)
    p = like_parts(value)
    if field.kind == "string":
        return _two_valued(like_match(field.col, p))
    if field.kind == "strings":
        return _two_valued(F.exists(field.col, lambda x: like_match(x, p)))
    if field.kind == "json":
        return _two_valued(F.exists(elements(field), lambda j: (_kind(j) == '"') & like_match(_scalar(j), p)))
    return F.lit(False)


def strict_equal(field: Field, value: Literal) -> Column:
    """Equality of filter trees: case counts, no types are converted, lists match by any member."""
    if field.kind == "json":

        def one(j: Column) -> Column:
            c = _kind(j)
            if value is None:
                return c == "n"
            if isinstance(value, bool):
                return j == str(value).lower()
            if isinstance(value, int | float):
                return c.isin(*"-0123456789") & (j.cast("double") == float(value))
            return (c == '"') & (_scalar(j) == nfc(value))

        return _two_valued(F.exists(elements(field), one))
    same = {"string": str, "strings": str, "boolean": bool}.get(field.kind)
    if value is None or (same and not isinstance(value, same)) or (field.kind == "number" and (isinstance(value, bool) or not isinstance(value, int | float))):
        return F.lit(False)
    if field.kind == "strings":
        return _two_valued(F.array_contains(field.col, nfc(value)))
    return _two_valued(field.col == F.lit(nfc(value) if isinstance(value, str) else value))


def strict_contains(field: Field, value: str) -> Column:
    """Part of a string, or of any string of a list."""
    want = nfc(value)
    if field.kind == "string":
        return _two_valued(field.col.contains(want))
    if field.kind == "strings":
        return _two_valued(F.exists(field.col, lambda x: x.contains(want)))
    if field.kind == "json":
        return _two_valued(F.exists(elements(field), lambda j: (_kind(j) == '"') & _scalar(j).contains(want)))
    return F.lit(False)


def json_search(field: Field, equals: str | None = None, exists: bool | None = None, contains: str | None = None) -> Column:
    """Exactly one of: equal JSON text, presence, a list member of equal JSON text (F16)."""
    if sum(x is not None for x in (equals, exists, contains)) != 1:
        raise ValueError("give exactly one of equals, exists and contains")
    if exists is not None:
        return field.col.isNotNull() if exists else field.col.isNull()
    if equals is not None:
        return _two_valued(field.col == equals)
    return _two_valued(field.col.startswith("[") & F.array_contains(elements(field), contains))


def hybrid_filter(field: Field, wanted: Literal | list) -> Column:
    """Any of the wanted values; strings are trimmed and folded, numbers and booleans strict (F17)."""

    def one(v: Literal) -> Column:
        if isinstance(v, str):
            want = fold_text(v).strip()
            if field.kind == "json":
                return _two_valued(F.exists(elements(field), lambda j: (_kind(j) == '"') & (F.trim(F.lower(_scalar(j))) == want)))
            if field.kind == "strings":
                return _two_valued(F.exists(field.col, lambda x: F.trim(F.lower(x)) == want))
            return _two_valued(F.trim(F.lower(field.col)) == want) if field.kind == "string" else F.lit(False)
        return strict_equal(field, v)

    out = F.lit(False)
    for v in wanted if isinstance(wanted, list) else [wanted]:
        out = out | one(v)
    return out
