"""Scalar expressions (survey X6-X31, A18, A22, U3, U4, U6)."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends: CRLF, LF, CR and the two Unicode separators.
LINE_END = "\\r\\n|[\\n\\r\\u2028\\u2029]"
DAY_MS = 86_400_000


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def line_breaks(text: Column) -> Column:
    return F.size(lines(text)) - 1


def word_count(text: Column) -> Column:
    """White-space separated words of the trimmed text; none in a blank one."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"(?U)\s+")))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^n + 0.5) / 10^n, also for negative halves."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def age_days(then: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_millis(now) - F.unix_millis(then)) / F.lit(DAY_MS))).cast("int")


def is_stale(then: Column, now: Column, days: int = 365) -> Column:
    return age_days(then, now) >= days


def recency_score(age: Column, half_life: float = 365.0) -> Column:
    return F.lit(half_life) / (F.lit(half_life) + age)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_date(text: Column) -> Column:
    """Stricter than a browser's date parser: ISO dates and times, else null."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy/MM/dd")))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_unit(a: Column, dim: int | None = None) -> Column:
    """Squared norm within 0.998..1.002 and, if given, the right dimension."""
    squared = dot(a, a)
    good = (squared >= 0.998) & (squared <= 1.002)
    return good & (F.size(a) == dim) if dim else good


def quantise(v: Column) -> Column:
    """One byte a dimension with minimum and scale: struct(q, vmin, scale)."""
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    scale = F.when(high > low, (high - low) / 255.0).otherwise(F.lit(0.0))
    q = F.transform(v, lambda x: F.when(scale > 0, F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((x.cast("double") - low) / scale + 0.5)))).otherwise(F.lit(0.0)).cast("smallint"))
    return F.struct(q.alias("q"), low.cast("float").alias("vmin"), scale.cast("float").alias("scale"))


def dequantise(e: Column) -> Column:
    return F.transform(e["q"], lambda x: (e["vmin"] + x.cast("float") * e["scale"]).cast("float"))


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def shared(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def missed(relevant: Column, found: Column) -> Column:
    return F.array_except(relevant, found)


def ngrams(text: Column, n: int) -> Column:
    """Set of character n-grams; a shorter text is its own."""
    return F.when(F.length(text) < n, F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: F.substring(text, i, F.lit(n)))))


def feedback_score(useful: Column, not_useful: Column) -> Column:
    return useful / (useful + not_useful + 1)


def json_kind(j: Column) -> Column:
    """Type name of a JSON text; null where it is absent."""
    c = F.substring(j, 1, 1)
    return F.when(j.isNull(), None).when(c == '"', "string").when(c == "[", "list").when(c == "{", "map").when(c.isin("t", "f"), "boolean").when(c == "n", "null").otherwise("number")


def note_uri(base: str, path: Column) -> Column:
    """Address of a note for an editor: ``base`` ends where the encoded path begins."""
    return F.concat(F.lit(base), F.regexp_replace(F.url_encode(path), r"\+", "%20"))


def page_range(first: Column, last: Column, pages: Column, most: int = 500) -> Column:
    """Clamped page range as struct(first, last)."""
    low = F.greatest(F.lit(1), F.least(first, pages))
    return F.struct(low.alias("first"), F.least(F.greatest(last, low), pages, low + (most - 1)).alias("last"))


def literal_count(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def overlapping_count(text: Column, needle: str) -> Column:
    """Occurrences that may overlap: matches of a look-ahead."""
    return F.regexp_count(text, F.lit("(?=" + java_quote(needle) + ")"))


def java_quote(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", text)


def snippet(text: Column, at: Column, size: Column, around: int = 60) -> Column:
    """±60 characters around a hit (``at`` from 1), white space collapsed, ellipsis where cut."""
    start = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(text), at + size - 1 + around)
    body = F.trim(F.regexp_replace(F.substring(text, start, end - start + 1), r"(?U)\s+", " "))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))


def hit_line(text: Column, at: Column) -> Column:
    return line_breaks(F.substring(text, F.lit(1), at - 1)) + 1


def normalise_query(text: str) -> str:
    return " ".join(text.split())


def truncate_day(now: datetime) -> datetime:
    return now.replace(hour=0, minute=0, second=0, microsecond=0)
