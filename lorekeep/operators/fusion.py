"""Fusion of ranked lists and re-ranking (survey A8, A9, A18, J15-J17, R11-R21, W1, W2, W7-W9, U8).

``ranked``: (query_id, signal, id, rank, score).  All queries of a batch are one plan keyed by query_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import feedback_score, recency_score

K = 60


def ranks(hits: DataFrame, signal: str, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds rank from the order by score, ties by id."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return hits.withColumn("signal", F.lit(signal)).withColumn("rank", F.row_number().over(w))


def best_per_note(ranked: DataFrame, note: Column) -> DataFrame:
    """First hit of each note, ranked anew."""
    first = ranked.withColumn("id", note).groupBy("query_id", "signal", "id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "signal").orderBy("rank", "id")))


def rrf(ranked: DataFrame, k: int = K) -> DataFrame:
    """Reciprocal-rank fusion: best rank of an id in each signal; (query_id, id, score, signals, per_signal)."""
    best = ranked.groupBy("query_id", "signal", "id").agg(F.min("rank").alias("rank"))
    return best.groupBy("query_id", "id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("signals"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("signal", "rank")))).alias("per_signal"),
    )


def overshoot(fused: DataFrame, limit: int) -> DataFrame:
    """The first max(4 x limit, 30) of each query: later filters see no more, so they may leave fewer than ``limit``."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < max(4 * limit, 30))


def in_degree_tie_break(fused: DataFrame, edges: DataFrame) -> DataFrame:
    """Among equal scores, more links from other candidates of the same query go first; scores stay."""
    pairs = fused.select("query_id", F.col("id").alias("src")).join(edges.distinct(), "src").join(fused.select("query_id", F.col("id").alias("dst")), ["query_id", "dst"])
    degree = pairs.where("src <> dst").groupBy("query_id", F.col("dst").alias("id")).agg(F.count_distinct("src").alias("in_degree"))
    joined = fused.join(degree, ["query_id", "id"], "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    return joined.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("in_degree"), "id")) - 1)


def rerank(fused: DataFrame, scorer, passages: DataFrame, top: int = 50) -> DataFrame:
    """``scorer(query_text, passage) -> Column`` orders the first ``top``; an empty passage comes last of them; the rest keep their places."""
    joined = fused.join(passages, ["query_id", "id"], "left")
    score = F.when(F.coalesce(F.col("passage"), F.lit("")) == "", F.lit(float("-inf"))).otherwise(scorer(F.col("query_text"), F.col("passage")))
    head = F.col("pos") < top
    w = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.when(head, -score).asc_nulls_last(), "pos")
    return joined.withColumn("rerank_score", F.when(head, score)).withColumn("pos", F.row_number().over(w) - 1).drop("passage", "query_text")


def blend(fused: DataFrame, value: Column, weight: float) -> DataFrame:
    """New order by (1 - w) / (1 + pos) + w x value; weight 0 leaves the order."""
    if weight <= 0:
        return fused
    key = (1 - weight) / (1 + F.col("pos")) + weight * value
    return fused.withColumn("key", key).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "pos")) - 1).drop("key")


def recency_blend(fused: DataFrame, ages: DataFrame, weight: float, half_life: float = 365.0) -> DataFrame:
    """``ages``: (id, age_days)."""
    return blend(fused.join(ages, "id", "left"), F.coalesce(recency_score(F.col("age_days"), half_life), F.lit(0.0)), weight)


def feedback_blend(fused: DataFrame, feedback: DataFrame, weight: float) -> DataFrame:
    """``feedback``: (id, useful, not_useful)."""
    return blend(fused.join(feedback, "id", "left"), F.coalesce(feedback_score(F.col("useful"), F.col("not_useful")), F.lit(0.0)), weight)


def explained(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("query_id", "id", (F.col("pos") + 1).alias("rank_before")).join(after.select("query_id", "id", (F.col("pos") + 1).alias("rank_after"), "score"), ["query_id", "id"])


def final(fused: DataFrame, limit: int, min_signals: int = 1) -> DataFrame:
    kept = fused.where(F.col("signals") >= min_signals)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("rank") <= limit)


def multi_query(lists: DataFrame, limit: int = 10, k: int = K) -> DataFrame:
    """One list from the lists of several queries (rank within each): fused by rank, best score kept."""
    fused = lists.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.max("score").alias("best_score"), F.count(F.lit(1)).alias("lists"))
    return fused.orderBy(F.desc("rrf"), "id").limit(limit)


def select_evidence(lists: list[list[str]], fused: list[str], limit: int) -> list[str]:
    """First hit of the main query, then one unseen hit of each other query, then the fused order (a few short lists, on the driver)."""
    out: list[str] = []
    for hits in lists:
        fresh = next((h for h in hits if h not in out), None)
        if fresh is not None and len(out) < limit:
            out.append(fresh)
    return [*out, *(h for h in fused if h not in out)][:limit]


def feedback_totals(marks: DataFrame) -> DataFrame:
    """Marks (path, useful boolean, at) added up for each path (K8)."""
    return marks.groupBy("path").agg(F.sum(F.col("useful").cast("long")).alias("useful"), F.sum((~F.col("useful")).cast("long")).alias("not_useful"), F.max("at").alias("last_marked"))
