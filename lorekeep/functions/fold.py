"""Folding of names, tags and keys (survey 1.4, X1, X2, X5, X30, X31).

NFC is not a Spark function, so it is applied once at ingest by an Arrow UDF; afterwards ``lower`` folds.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def fold_text(text: str) -> str:
    return nfc(text).lower()


def fold_tag_text(tag: str) -> str:
    return fold_text(tag.lstrip("#"))


def normalised(col: Column) -> Column:
    """NFC of a text column; for ingest only."""
    from pyspark.sql.types import StringType

    @pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(nfc, na_action="ignore")

    return run(col)


def fold(col: Column | str) -> Column:
    """Lower case of text that ingest has brought to NFC."""
    return F.lower(F.col(col) if isinstance(col, str) else col)


def fold_tag(col: Column | str) -> Column:
    return fold(F.regexp_replace(col, "^#+", ""))


def strip_md(col: Column | str) -> Column:
    return F.regexp_replace(col, r"(?i)\.md$", "")


def strip_slashes(col: Column) -> Column:
    return F.regexp_replace(col, "^/+|/+$", "")


def first_non_null(*cols: Column) -> Column:
    return F.coalesce(*cols)


def tag_variants(tags: Column) -> Column:
    """Distinct folded spellings of an array of tags."""
    return F.array_distinct(F.transform(tags, fold_tag))
