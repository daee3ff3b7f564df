"""Graph operators (survey A10-A12, G1-G5, J3).

``find_path`` expands a frontier by joins, one job a hop.  ``communities_exact`` runs the sequential local
moving of a Louvain level in one task and is meant for graphs that fit one; ``communities_by_moves`` does the same moves
on tables, many at once, and comes near its modularity on any graph; ``communities`` spreads labels
and gives other, but reproducible, groups.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def graph_edges(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links as (src, dst): an exact, case-sensitive path first, else the first note of that base name in path order; no self-links (J3)."""
    strip = lambda c: F.regexp_replace(c, r"(?i)\.md$", "")
    paths = notes.select(F.col("path").alias("by_path"), strip(F.col("path")).alias("want"))
    names = notes.groupBy(F.lower(strip(F.element_at(F.split("path", "/"), -1))).alias("name")).agg(F.min("path").alias("by_name"))
    rows = links.select("path", strip(F.col("target")).alias("want")).withColumn("name", F.lower(F.element_at(F.split("want", "/"), -1)))
    qualified = rows.join(paths, "want", "left").join(names, "name", "left")
    chosen = qualified.select(F.col("path").alias("src"), F.when(F.col("want").contains("/"), F.col("by_path")).otherwise(F.coalesce("by_path", "by_name")).alias("exact"), "by_name")
    return chosen.select("src", F.coalesce("exact", "by_name").alias("dst")).where("dst is not null and src <> dst")


def undirected(edges: DataFrame) -> DataFrame:
    """Weighted edges in both directions: every link adds 1 to its pair."""
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def degrees(graph: DataFrame) -> DataFrame:
    return graph.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))


def modularity(graph: DataFrame, membership: DataFrame) -> DataFrame:
    """Sum over communities of inner weight / 2m - (degree / 2m)^2, as one row."""
    m = membership.select("node", "community")
    total = graph.agg(F.sum("weight").cast("double").alias("m2"))
    labelled = graph.join(m.withColumnRenamed("node", "src"), "src").withColumnRenamed("community", "cs").join(m.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    per = labelled.groupBy("cs").agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0)).alias("inner"), F.sum("weight").alias("degree"))
    return per.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("inner") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), F.lit(2.0))), F.lit(0.0)).alias("modularity"))


def communities_exact(graph: DataFrame, passes: int = 50, most_edges: int = 5_000_000) -> DataFrame:
    """(node, community) by one level of sequential local moving in path order, in one task; communities are numbered by their first node.

    The result does not depend on the order of the rows.  A graph of more than ``most_edges`` is refused: ``communities`` takes any size."""
    if graph.limit(most_edges + 1).count() > most_edges:
        raise ValueError(f"more than {most_edges} edges: use communities()")

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, dict[str, float]] = {}
        for s, d, w in sorted(zip(pdf["src"], pdf["dst"], pdf["weight"], strict=True)):
            near.setdefault(s, {})[d] = float(w)
        nodes = sorted(near)
        degree = {n: sum(near[n].values()) for n in nodes}
        m2 = sum(degree.values())
        home = {n: i for i, n in enumerate(nodes)}
        total = {i: degree[n] for i, n in enumerate(nodes)}
        for _ in range(passes):
            moved = False
            for n in nodes:
                own = home[n]
                total[own] -= degree[n]
                weight: dict[int, float] = {own: 0.0}
                for other, w in near[n].items():
                    if other != n:
                        weight[home[other]] = weight.get(home[other], 0.0) + w
                gain = {c: w - total[c] * degree[n] / m2 for c, w in weight.items()}
                best = own
                for c in gain:
                    if gain[c] > gain[best] + 1e-12:
                        best = c
                home[n] = best
                total[best] += degree[n]
                moved |= best != own
            if not moved:
                break
        number: dict[int, int] = {}
        return pd.DataFrame({"node": nodes, "community": [number.setdefault(home[n], len(number)) for n in nodes]}).astype({"community": "int64"})

    return graph.select("src", "dst", "weight").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(move, "node string, community long")


def communities_by_moves(graph: DataFrame, most_rounds: int = 20, patience: int = 3, most_levels: int = 4) -> DataFrame:
    """(node, community) by local moves on edge tables; a community's name is its least node.

    In each round every node looks for the neighbouring community with the greatest gain of modularity, from the weights
    of its own edges and one total a community.  Of the nodes that would gain, those move that come first among their
    neighbours that would move too, in an order that a hash of node and round gives, so no two neighbours move at once.
    When no node would gain, or modularity has not risen for ``patience`` rounds, each community becomes a node of the next level's graph (its inner
    weight a loop), until a level does not raise modularity.  Moves that are made at the same time see the totals of before, which costs some of the gain;
    the further levels make up for it.

    A round is a few equi-joins and grouped sums that combine before the shuffle; a hub is one row for each community around it.
    What ``graph`` is made of is read once: all rounds start from the stored edges."""
    level = stored(graph.select("src", "dst", "weight"), "moves-graph")
    home = stored(degrees(level).select("node", F.col("node").alias("community")), "moves-home")
    reached = -1.0
    for _ in range(most_levels):
        labels, value = _moves(level, most_rounds, patience)
        if value <= reached + 1e-9:
            break
        reached = value
        renamed = labels.select(F.col("node").alias("community"), F.col("community").alias("further"))
        home = stored(home.join(renamed, "community").select("node", F.col("further").alias("community")), "moves-home")
        to = lambda end: labels.select(F.col("node").alias(end), F.col("community").alias(f"{end}_of"))  # noqa: E731, B023
        joined = level.join(to("src"), "src").join(to("dst"), "dst")
        level = stored(joined.groupBy(F.col("src_of").alias("src"), F.col("dst_of").alias("dst")).agg(F.sum("weight").alias("weight")), "moves-level")
    names = home.groupBy("community").agg(F.min("node").alias("name"))
    return home.join(names, "community").select("node", F.col("name").alias("community"))


def _moves(graph: DataFrame, most_rounds: int, patience: int) -> tuple[DataFrame, float]:
    """The labels of the best round, and their modularity, which is summed up from what each round looks at anyway."""
    labels = stored(degrees(graph).select("node", F.col("node").alias("community"), "degree"), "moves-labels")
    m2 = float(labels.agg(F.sum("degree")).first()[0] or 1)
    loops = graph.where("src = dst").agg(F.sum("weight")).first()[0] or 0
    best, best_value, still = labels, 0.0, 0
    apart = graph.where("src <> dst")
    for number in range(most_rounds + 1):
        total = labels.groupBy("community").agg(F.sum("degree").alias("total"))
        around = apart.join(labels.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("w"))
        own = labels.select("node", "community", F.lit(0).cast("long").alias("w"))
        options = around.unionByName(own).groupBy("node", "community").agg(F.sum("w").alias("w")).join(total, "community").join(labels.withColumnRenamed("community", "home"), "node")
        stays = F.col("community") == F.col("home")
        gain = F.col("w") - (F.col("total") - F.when(stays, F.col("degree")).otherwise(0)) * F.col("degree") / m2
        judged = options.withColumn("gain", gain).groupBy("node").agg(
            F.max_by(F.struct("community", "gain"), F.struct("gain", stays, F.col("community"))).alias("to"), F.max(F.when(stays, F.col("gain"))).alias("now"),
            F.max("home").alias("home"), F.max("degree").alias("degree"), F.max(F.when(stays, F.col("w"))).alias("inner"),
        )
        judged = stored(judged.select("node", "home", "degree", "inner", F.when(F.col("to.gain") > F.col("now") + 1e-12, F.col("to.community")).alias("target")), "moves-judged")
        per = judged.groupBy("home").agg(F.sum("inner").alias("inner"), F.pow(F.sum("degree") / m2, F.lit(2.0)).alias("square"), F.count("target").alias("wishes"))
        inner, squares, wishes = per.agg(F.sum("inner"), F.sum("square"), F.sum("wishes")).first()
        value = ((inner or 0) + loops) / m2 - (squares or 0.0)
        still = 0 if not number or value > best_value + 1e-9 else still + 1
        if not still:
            best, best_value = labels, value
        if still >= max(1, patience) or not wishes or number == most_rounds:
            break
        wish = judged.where("target is not null").select("node", "target")
        place = lambda c: F.struct(F.xxhash64(c, F.lit(number)), c)  # noqa: E731, B023
        ahead = apart.join(wish.select(F.col("node").alias("src")), "src").join(wish.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.max(place(F.col("dst"))).alias("rival"))
        moves = wish.join(ahead, "node", "left").where(F.col("rival").isNull() | (place(F.col("node")) > F.col("rival"))).select("node", F.col("target").alias("moved"))
        labels = stored(judged.join(moves, "node", "left").select("node", F.coalesce("moved", "home").alias("community"), "degree"), "moves-labels")
    return best, best_value


def communities(graph: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, community): each node takes the label with most weight around it, smallest on ties; label names are node names.

    Without ``rounds`` it goes on until labels stop changing or come back after two rounds, as they do on any graph with equal weights both ways."""
    graph = stored(graph.select("src", "dst", "weight"), "graph")  # made once, not in each round
    labels = graph.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    past: list[DataFrame] = [labels]
    done = 0
    while rounds is None or done < rounds:
        votes = graph.join(labels.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        held = labels.select(F.col("node").alias("src"), "community", F.lit(0.5).alias("w"))
        total = votes.unionByName(held).groupBy("src", "community").agg(F.sum("w").alias("w"))
        labels = total.groupBy(F.col("src").alias("node")).agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("community"))
        labels = labels.checkpoint()
        if any(not _differ(labels, p) for p in past):
            break
        past = [past[-1], labels]
        done += 1
    return labels


def _differ(a: DataFrame, b: DataFrame) -> bool:
    return a.join(b.withColumnRenamed("community", "other"), "node").where("community <> other").limit(1).count() > 0


def community_table(graph: DataFrame, membership: DataFrame, most: int = 2048) -> DataFrame:
    """Size, members and representative (most inner degree, then path) of each community."""
    m = membership.select("node", "community")
    inner = graph.join(m.withColumnRenamed("node", "src"), "src").join(m.select(F.col("node").alias("dst"), F.col("community").alias("other")), "dst").where("community = other").groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("inner"))
    rows = m.join(inner, "node", "left").withColumn("inner", F.coalesce("inner", F.lit(0)))
    # The first members by a ranked window, which Spark cuts before the shuffle: a community is never collected as a whole.
    shown = rows.withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy("node"))).where(F.col("n") <= most).groupBy("community").agg(F.sort_array(F.collect_list("node")).alias("members"))
    return rows.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min_by("node", F.struct(-F.col("inner"), "node")).alias("representative")).join(shown, "community").select("community", "size", "members", "representative")


def find_path(edges: DataFrame, start: str, goal: str, max_depth: int = 5, alternatives: int = 10) -> tuple[bool, list[list[str]]]:
    """Shortest directed paths, the alphabetically first first; driver-side assembly of a few short paths."""
    if start == goal:
        return True, [[start]]
    spark = edges.sparkSession
    steps = edges.where("src <> dst").select("src", "dst").distinct()
    frontier = spark.createDataFrame([(start, [start])], "node string, route array<string>")
    seen = frontier.select("node")
    for _ in range(max_depth):
        following = frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node"), F.concat("route", F.array("dst")).alias("route")).join(seen, "node", "left_anti")
        hits = [r.route for r in following.where(F.col("node") == goal).orderBy("route").limit(alternatives).collect()]
        if hits:
            return True, hits
        # Up to ``alternatives`` routes of equal length stay for each node.
        ranked = following.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("route"))).where(F.col("n") <= alternatives).drop("n")
        seen = seen.unionByName(ranked.select("node")).distinct()
        frontier = ranked
    return False, []
