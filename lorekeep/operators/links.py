"""Link resolution and link reports (survey J1-J8, J19, J21, G6-G9, U3, A17, R23, R24).

Tables: ``notes`` (path, title, ... with scan_ord), ``links`` (path, ord, kind, raw, target, ...).  All joins
are equi-joins on folded keys; Spark picks broadcast or shuffle by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, ngrams


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?i)\.md$", ""))


def normal_path(path: Column) -> Column:
    """Resolves ``.`` and ``..`` segments."""
    step = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda out, s: F.when(s.isin("", "."), out).when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s))))
    return F.array_join(step, "/")


def note_keys(notes: DataFrame) -> DataFrame:
    """(path, scan_ord, name, full, folder): folded base name and path of each note."""
    ordered = notes if "scan_ord" in notes.columns else notes.withColumn("scan_ord", F.col("path"))
    return ordered.select(F.col("path").alias("note"), "scan_ord", _key(F.element_at(F.split("path", "/"), -1)).alias("name"), _key(F.col("path")).alias("full"), _folder(F.col("path")).alias("folder"))


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``links`` with ``resolved`` (a path or null): the best of

    1 a relative path, 2 a note of that base name (in the link's own folder first, else the first in scan order),
    3 a note of that path, 4 the first note whose path ends in it."""
    keys = note_keys(notes)
    numbered = links.withColumn("link_id", F.struct("path", "ord"))
    want = numbered.select("path", "ord", "target", _folder(F.col("path")).alias("own_folder"), _key(F.col("target")).alias("want"))
    relative = want.where(F.col("target").startswith("./") | F.col("target").startswith("../") | F.col("target").contains("/../"))
    relative = relative.select("path", "ord", _key(normal_path(F.concat_ws("/", "own_folder", "target"))).alias("want"))
    # A key that many notes have is one row before any join: the first of them in scan order.
    first = lambda by, rows=keys: rows.groupBy(*by).agg(F.min_by("note", "scan_ord").alias("note"))
    found = lambda rows, stage: rows.select("path", "ord", "note", F.lit(stage).alias("stage"))
    by_full = first(["full"]).withColumnRenamed("full", "want")
    by_relative = found(relative.join(by_full, "want"), 1)
    near = first(["name", "folder"]).select(F.col("name").alias("want"), F.col("folder").alias("own_folder"), "note")
    by_name = found(want.join(near, ["want", "own_folder"]), 2).unionByName(found(want.join(first(["name"]).withColumnRenamed("name", "want"), "want"), 3))
    slashed = want.where(F.col("target").contains("/"))
    by_path = found(slashed.join(by_full, "want"), 4)
    parts = F.split("full", "/")
    suffixes = keys.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))).where("suffix <> ''")
    by_suffix = found(slashed.join(first(["suffix"], suffixes).withColumnRenamed("suffix", "want"), "want"), 5)
    every = by_relative.unionByName(by_name).unionByName(by_path).unionByName(by_suffix)
    best = every.groupBy("path", "ord").agg(F.min_by("note", "stage").alias("resolved"))
    return links.join(best, ["path", "ord"], "left")


def backlinks(resolved: DataFrame, target: str | None = None, limit: int = 50) -> DataFrame:
    """Notes that link to each note (or to one): count, kind and up to two raw links."""
    rows = resolved.where(F.col("resolved").isNotNull())
    if target:
        rows = rows.where(F.col("resolved") == target)
    grouped = rows.groupBy(F.col("resolved").alias("target_path"), "path").agg(
        F.count(F.lit(1)).alias("count"), F.when(F.count_distinct("kind") > 1, "mixed").otherwise(F.min("kind")).alias("kind"), F.slice(F.sort_array(F.collect_list(F.struct("ord", "raw"))), 1, 2)["raw"].alias("snippets"),
    )
    return grouped.orderBy("path").limit(limit) if target else grouped


def outbound(resolved: DataFrame, path: str, include_embeds: bool = True, include_unresolved: bool = True) -> DataFrame:
    rows = resolved.where(F.col("path") == path)
    if not include_embeds:
        rows = rows.where("kind <> 'embed'")
    return rows if include_unresolved else rows.where("resolved is not null")


def unresolved(resolved: DataFrame, limit: int = 200) -> DataFrame:
    return resolved.where("resolved is null").orderBy("path", "ord").limit(limit)


def edges(resolved: DataFrame, embeds: bool = True) -> DataFrame:
    rows = resolved.where("resolved is not null" if embeds else "resolved is not null and kind <> 'embed'")
    return rows.select(F.col("path").alias("src"), F.col("resolved").alias("dst"))


def orphans(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Notes nothing points to and that have no link of their own; a broken link counts as one."""
    pointed = resolved.where("resolved is not null and resolved <> path").select(F.col("resolved").alias("path"))
    return notes.select("path").join(pointed, "path", "left_anti").join(resolved.select("path"), "path", "left_anti")


def neighbours(path: str, resolved: DataFrame, tags: DataFrame, most: int = 20) -> DataFrame:
    """Outbound, inbound and tag siblings of a note; siblings leave out the other two."""
    links = edges(resolved)
    out = links.where((F.col("src") == path) & (F.col("dst") != path)).select(F.col("dst").alias("path")).distinct().withColumn("relation", F.lit("outbound"))
    into = links.where((F.col("dst") == path) & (F.col("src") != path)).select(F.col("src").alias("path")).distinct().withColumn("relation", F.lit("inbound"))
    own = tags.where(F.col("path") == path).select("tag_folded").distinct()
    near = tags.join(own, "tag_folded").where(F.col("path") != path).select("path").distinct().join(out, "path", "left_anti").join(into, "path", "left_anti").withColumn("relation", F.lit("tag"))
    every = out.unionByName(into).unionByName(near)
    return every.withColumn("n", F.row_number().over(Window.partitionBy("relation").orderBy("path"))).where(F.col("n") <= most).drop("n")


def similar(path: str, notes: DataFrame, resolved: DataFrame, limit: int = 10, min_score: float = 0.05) -> DataFrame:
    """3 x tag overlap + 1.5 x title 3-gram overlap + 2 x shared outbound share + 2 x common backlinks overlap."""
    link = edges(resolved).distinct()
    mine, theirs = link.where(F.col("src") == path).select("dst"), link.where(F.col("dst") == path).select("src")
    # Common elements are counted by equi-joins; the links of a note are never gathered in a row.
    count = F.count(F.lit(1))
    common_out = link.join(mine, "dst").groupBy(F.col("src").alias("path")).agg(count.alias("common_out"))
    common_in = link.join(theirs, "src").groupBy(F.col("dst").alias("path")).agg(count.alias("common_in"))
    n_in = link.groupBy(F.col("dst").alias("path")).agg(count.alias("n_in"))
    sizes = mine.agg(count.alias("my_out")).crossJoin(theirs.agg(count.alias("my_in")))  # one row
    full = notes.select("path", "title", F.array_distinct(F.transform("tags", F.lower)).alias("t"), ngrams(F.lower("title"), 3).alias("g"))
    me = full.where(F.col("path") == path).limit(1).select(F.col("t").alias("mt"), F.col("g").alias("mg")).crossJoin(sizes)
    both = full.where(F.col("path") != path).crossJoin(F.broadcast(me))
    for part in (common_out, common_in, n_in):
        both = both.join(part, "path", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = F.coalesce(F.try_divide(zero("common_out"), F.col("my_out")), F.lit(0.0))
    overlap = F.coalesce(F.try_divide(zero("common_in"), F.col("my_in") + zero("n_in") - zero("common_in")), F.lit(0.0))
    score = 3 * jaccard(F.col("mt"), F.col("t")) + 1.5 * jaccard(F.col("mg"), F.col("g")) + 2 * share + 2 * overlap
    return both.withColumn("score", F.floor(score * 1e4 + 0.5) / 1e4).where(F.col("score") >= min_score).orderBy(F.desc("score"), "path").limit(limit).select("path", "title", "score")


def suggestions(notes: DataFrame, want: str, most: int = 3) -> DataFrame:
    """Closest titles: equal 100, prefix either way 70, part either way 50, part of the path 30."""
    title, w = F.lower("title"), F.lit(want.lower().removesuffix(".md"))
    score = F.when(title == w, 100).when(title.startswith(w) | w.startswith(title), 70).when(title.contains(w) | w.contains(title), 50).when(F.lower("path").contains(w), 30)
    return notes.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "path").limit(most).select("path", "score")


def title_collisions(notes: DataFrame) -> DataFrame:
    """Titles that several notes bear."""
    return notes.groupBy(F.lower("title").alias("title")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("path")).alias("paths")).where("n > 1")


def validate_proposal(path: str, proposed_links: DataFrame, proposed_tags: list[str], notes: DataFrame, tags: DataFrame, mode: str = "create") -> dict[str, DataFrame]:
    """Checks of a proposed note: its links, tags new to the collection, and titles it collides with."""
    resolved = resolve(proposed_links, notes)
    spark = notes.sparkSession
    wanted = spark.createDataFrame([(t,) for t in proposed_tags], "tag string").withColumn("tag_folded", F.lower(F.regexp_replace("tag", "^#+", "")))
    known = tags.select("tag_folded").distinct().withColumn("known", F.lit(True))
    title = path.rsplit("/", 1)[-1].removesuffix(".md").lower()
    return {
        "broken_links": resolved.where("resolved is null"), "tags": wanted.join(known, "tag_folded", "left").select("tag", F.coalesce("known", F.lit(False)).alias("known")),
        "collisions": notes.where((F.lower("title") == title) & (F.col("path") != path)).select("path"), "exists": notes.where(F.lower("path") == path.lower()).select("path").withColumn("error", F.lit(mode == "create")),
    }
