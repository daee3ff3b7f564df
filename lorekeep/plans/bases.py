"""Filter trees of ``.base`` files compiled to columns (survey F10-F15, F24, T4, S14).

A filter is a predicate text, or a mapping with ``and``, ``or`` or ``not``.  A predicate that is not understood
excludes the row and is reported; ``not`` over a child that is not understood excludes the row too.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import fold_tag_text, fold_text, nfc
from ..operators import predicates as P
from ..sources.scans import in_folder

Tree = str | dict | list | None


@dataclass
class Compiled:
    column: Column
    evaluable: bool = True
    unknown: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)


class _Reader:
    """Reads a predicate text from left to right."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def blanks(self) -> int:
        begin = self.at
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.at - begin

    def name(self) -> str:
        """Letters, digits, underscores, dots and hyphens; the first is a letter or an underscore."""
        begin = self.at
        while self.at < len(self.text) and self.text[self.at].isascii() and (self.text[self.at].isalnum() or self.text[self.at] in "_.-"):
            self.at += 1
        found = self.text[begin : self.at]
        return found if found and (found[0].isalpha() or found[0] == "_") else ""

    def take(self, *marks: str) -> str:
        """The first of ``marks`` that stands here, which is passed."""
        for mark in marks:
            if self.text.startswith(mark, self.at):
                self.at += len(mark)
                return mark
        return ""

    def quoted(self) -> str | None:
        """A text in quotes without quotes inside, up to the end of the predicate or a closing parenthesis."""
        quote = self.take('"', "'")
        end = self.text.find(quote, self.at) if quote else -1
        inside = self.text[self.at : end] if end > self.at else ""
        if not inside or "'" in inside or '"' in inside:
            return None
        self.at = end + 1
        return inside

    def done(self) -> bool:
        return self.at == len(self.text)


@dataclass
class _Said:
    """What a predicate says: of which subject, by which operator, with which quoted text or what else."""

    subject: str
    operator: str
    want: str | None
    rest: str


def _read(expr: str) -> _Said | None:
    """``call(file.file, "text")``, ``subject == value`` or ``subject word "text"``; words stand between blanks."""
    r = _Reader(expr)
    subject = r.name()
    if not subject:
        return None
    if r.take("("):
        r.blanks()
        argument = r.name()
        r.blanks()
        comma = r.take(",")
        r.blanks()
        want = r.quoted()
        r.blanks()
        return _Said(subject, "()", want, "") if argument == "file.file" and comma and want is not None and r.take(")") and r.done() else None
    gap = r.blanks()
    operator = r.take("==", "!=")
    if not operator:
        operator = r.name() if gap else ""
        if operator not in ("contains", "startsWith") or not r.blanks():
            return None
    r.blanks()
    rest = r.text[r.at :]
    want = r.quoted()
    return _Said(subject, operator, want if r.done() else None, rest) if rest else None


_NONE = object()


def _value(text: str):
    if text in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text]
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return float(text)
    quoted = re.fullmatch(r"""(["'])(.*)\1""", text)
    return quoted[2] if quoted else _NONE


def compile_predicate(text: str, find: Callable[[str], P.Field | None]) -> Compiled:
    expr = text.strip()
    if expr in ("", "true", "false"):
        return Compiled(F.lit(expr != "false"))
    said = _read(expr)
    if said is None:
        return Compiled(F.lit(False), False, [expr])
    built_in = _built_in(said)
    if built_in is not None:
        c = F.coalesce(built_in, F.lit(False))
        return Compiled(~c if said.operator == "!=" else c)
    found = find(said.subject)
    if said.operator == "contains" and said.want is not None:
        return Compiled(P.strict_contains(found, said.want) if found else F.lit(False), keys=[said.subject])
    value = _value(said.rest.strip()) if said.operator in ("==", "!=") else _NONE
    if value is _NONE:
        return Compiled(F.lit(False), False, [expr], [said.subject] if said.operator in ("==", "!=") else [])
    equal = P.strict_equal(found, value) if found else F.lit(False)
    return Compiled(~equal if said.operator == "!=" else equal, keys=[said.subject])


def _built_in(said: _Said) -> Column | None:
    """The predicates on tags, links, path and name; null if this is none of them."""
    want = said.want
    if want is None:
        return None
    without_ending = lambda text: re.sub(r"(?i)\.md$", "", text)
    match said.subject, said.operator:
        case ("taggedWith", "()") | ("tag", "==" | "!="):
            return F.exists("tags", lambda t: F.lower(F.regexp_replace(t, "^#+", "")) == fold_tag_text(want))
        case ("linksTo", "()"):
            name = fold_text(without_ending(re.split(r"[#^]", want.strip().rsplit("/", 1)[-1])[0]))
            return F.exists("link_names", lambda t: t == name) if name else F.lit(False)
        case ("path" | "file.path", "startsWith"):
            return F.col("path").startswith(nfc(want))
        case ("path" | "file.path", "contains"):
            return F.col("path").contains(nfc(want))
        case ("file.name", "==" | "!="):
            return F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.md$", "")) == fold_text(without_ending(want))
    return None


def compile_filter(tree: Tree, find: Callable[[str], P.Field | None]) -> Compiled:
    if tree is None:
        return Compiled(F.lit(True))
    if isinstance(tree, str):
        return compile_predicate(tree, find)
    if isinstance(tree, list):
        return compile_filter({"and": tree}, find)
    if not isinstance(tree, dict) or len([k for k in tree if k in ("and", "or", "not")]) != 1:
        return Compiled(F.lit(False), False, [repr(tree)[:200]])
    op = next(k for k in tree if k in ("and", "or", "not"))
    below = tree[op] if isinstance(tree[op], list) else [tree[op]]
    parts = [compile_filter(x, find) for x in below]
    unknown, keys = [u for p in parts for u in p.unknown], [k for p in parts for k in p.keys]
    good = all(p.evaluable for p in parts)
    if op == "not":
        some = F.lit(False)
        for p in parts:
            some = some | p.column
        return Compiled(~some if good else F.lit(False), good, unknown, keys)
    total = F.lit(op == "and")
    for p in parts:
        total = total & p.column if op == "and" else total | p.column
    return Compiled(total, good, unknown, keys)


@dataclass
class BaseResult:
    matches: DataFrame
    total: DataFrame
    unevaluated: list[str]


def query(notes: DataFrame, base: dict, view: str | None = None, limit: int = 50, folder: str | None = None, find: Callable[[str], P.Field | None] | None = None) -> BaseResult:
    """First matches by path with the exact total; the base's filter and the view's are both needed.

    ``notes`` has path, tags, link_names (folded names of its link targets) and fields."""
    from .dql import resolver

    find = find or resolver(notes)
    chosen = next((v for v in base["views"] if v.get("name") == view), None) if view else (base["views"][0] if base["views"] else None)
    if view and chosen is None:
        raise ValueError(f"no such view: {view}")
    every, own = compile_filter(base.get("filters"), find), compile_filter((chosen or {}).get("filters"), find)
    rows = notes.where(in_folder(F.col("path"), folder)).where(every.column & own.column)
    referred = list(dict.fromkeys(["status", "type", *every.keys, *own.keys]))[:16]
    why = F.struct(F.col("tags").alias("tags"), *[(f.col.cast("string") if f.kind != "strings" else F.to_json(f.col)).alias(re.sub(r"\W", "_", k)) for k in referred if (f := find(k)) is not None])
    return BaseResult(rows.orderBy("path").limit(limit).select("path", why.alias("matched_on")), rows.agg(F.count(F.lit(1)).alias("total_matched")), list(dict.fromkeys([*every.unknown, *own.unknown])))
