"""Helpers for odd tables."""

from pyspark.sql import functions as F


def with_clashing_columns(df, *names):
    """Further columns whose names an operator uses itself."""
    return df.select("*", *[F.lit("clash").alias(n) for n in names if n not in df.columns])
