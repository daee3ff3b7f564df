"""Chunk-level operators (survey K11-K13, P13, P18, R4, S17, W3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import java_quote


def chunk(chunks: DataFrame, path: str, index: int) -> DataFrame:
    """Point lookup of one chunk."""
    return chunks.where((F.col("path") == path) & (F.col("chunk_index") == index))


def page_text(pages: DataFrame) -> DataFrame:
    """One text a paged document, from (path, page_number, text, status): pages in order, each after its ``[page: n]`` line; failed ones left out."""
    good = pages.where("status = 'ok'").select("path", F.struct("page_number", F.concat(F.lit("[page: "), F.col("page_number").cast("string"), F.lit("]\n"), "text").alias("text")).alias("p"))
    return good.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("p"))["text"], "\n\n").alias("content")).withColumn("kind", F.lit("pdf"))


def embed_text(chunks: DataFrame, context: int = 200, key: str = "path", title: str | None = "breadcrumb") -> DataFrame:
    """Text to embed for each chunk: its heading trail, the tail of the chunk before and the head of the next, cut at word ends.

    The budget of a note's chunk is clamp(512000 / chunks, 512, 8000) characters; beyond it the chunk stands alone."""
    w = Window.partitionBy(key).orderBy("chunk_index")
    count = F.count(F.lit(1)).over(Window.partitionBy(key))
    budget = F.greatest(F.lit(512), F.least(F.lit(8000), F.floor(F.lit(512_000) / count)))
    tail = F.regexp_replace(F.substring(F.lag("text").over(w), -context, context), r"^\S*\s", "")
    head = F.regexp_replace(F.substring(F.lead("text").over(w), 1, context), r"\s\S*$", "")
    trail = F.when(F.length(title) <= budget / 2, F.nullif(F.col(title), F.lit(""))) if title else F.lit(None).cast("string")
    core = F.concat_ws("\n", trail, "text")
    full = F.concat_ws("\n", trail, tail, "text", head)
    return chunks.withColumn("embed_text", F.when(F.length(full) <= budget, full).when(F.length(core) <= budget, core).otherwise(F.substring(F.col("text"), F.lit(1), budget.cast("int"))))


def marked_snippet(text: Column, words: list[str], tokens: int = 25) -> Column:
    """About ``tokens`` words around the first hit, every hit between « and »."""
    pattern = "(?iu)(?<![\\p{L}\\p{N}])(" + "|".join(java_quote(w) for w in words) + ")(?![\\p{L}\\p{N}])"
    parts = F.split(F.regexp_replace(text, r"\s+", " "), " ")
    hit = F.array_position(F.transform(parts, lambda p: p.rlike(pattern)), True).cast("int")
    start = F.greatest(F.lit(1), F.least(hit - 5, F.size(parts) - (tokens - 1)))
    cut = F.array_join(F.slice(parts, start, F.lit(tokens)), " ")
    body = F.concat(F.when(start > 1, "…").otherwise(""), F.regexp_replace(cut, pattern, "«$1»"), F.when(start + (tokens - 1) < F.size(parts), "…").otherwise(""))
    return F.when(hit > 0, body).otherwise(F.lit(""))


def fold_with_map(text: str) -> tuple[str, list[int]]:
    """Lower-cased text and, for each of its characters, the place it comes from (lower case may be longer)."""
    out, places = [], []
    for i, c in enumerate(text):
        low = c.lower()
        out.append(low)
        places += [i] * len(low)
    return "".join(out), places


def replace_vectors(table: DataFrame, path: str, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New snapshot of a vector table after one note's rows are replaced, the ids taken out and the ids put in."""
    old = table.where(F.col("path") == path)
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = rows.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.row_number().over(Window.partitionBy("path").orderBy("chunk_index"))).drop("top").select(*table.columns)
    return table.where(F.col("path") != path).unionByName(fresh), old.select("id"), fresh.select("id")


def quarantine(state: DataFrame, bad: DataFrame, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Marks a source as unusable: its state goes, the mark stays until it is indexed again."""
    mark = state.sparkSession.createDataFrame([(path, kind)], "path string, kind string")
    return state.where(~((F.col("path") == path) & (F.col("kind") == kind))), bad.select("path", "kind").unionByName(mark).distinct()
