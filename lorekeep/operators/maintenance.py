"""Incremental maintenance of derived tables (survey J9-J12, J20, J22, K10-K14, U1, U5, Z2, Z4, Z5, Z8, Z9).

Tables are replaced as whole snapshots: changed paths are taken out by an anti-join and their new rows added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(live: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, change): added, updated, deleted or unchanged by modification time."""
    both = live.select("path", F.col("mtime").alias("now")).join(stored.select("path", F.col("mtime").alias("then")), "path", "full_outer")
    return both.select("path", F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "updated").otherwise("unchanged").alias("change"))


def upsert(table: DataFrame, fresh: DataFrame, gone: DataFrame, key: tuple[str, ...] = ("path",)) -> DataFrame:
    """``table`` without the paths of ``fresh`` and ``gone``, with the rows of ``fresh``."""
    out = fresh.select(*key).unionByName(gone.select(*key)).distinct()
    return table.join(out, list(key), "left_anti").unionByName(fresh)


def bump(state: DataFrame, changed: DataFrame) -> DataFrame:
    """Source state after a change: the changed paths' revisions go up by one.  ``changed``: path, kind, mtime, n_chunks."""
    old = state.select("path", "kind", F.col("revision").alias("before"))
    new = changed.join(old, ["path", "kind"], "left").select("path", "kind", "mtime", "n_chunks", (F.coalesce("before", F.lit(0)) + 1).cast("long").alias("revision"))
    return upsert(state, new, changed.limit(0).select("path", "kind"), ("path", "kind"))


def known_sources(state: DataFrame, quarantine: DataFrame) -> DataFrame:
    return state.select("path", "kind").union(quarantine.select("path", "kind")).distinct()


def usable(rows: DataFrame, state: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Index rows of sources that have a state and are not quarantined."""
    return rows.join(state.select("path", "kind"), ["path", "kind"], "left_semi").join(quarantine.select("path", "kind"), ["path", "kind"], "left_anti")


def still_current(hits: DataFrame, state: DataFrame) -> DataFrame:
    """Hits whose source is as it was when they were made."""
    return hits.join(state.select("path", "kind", "mtime", "revision"), ["path", "kind", "mtime", "revision"], "left_semi")


def latest_events(events: DataFrame, key: str = "path", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The last event of each path."""
    names = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("e")).select(key, "e.*")


def newer_only(events: DataFrame, state: DataFrame) -> DataFrame:
    """Events that are not older than what is stored."""
    return events.join(state.select("path", F.col("mtime").alias("known")), "path", "left").where(F.col("known").isNull() | (F.col("mtime") >= F.col("known"))).drop("known")
