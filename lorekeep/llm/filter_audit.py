"""Audit of how quality filters interact, by a Walsh-Hadamard transform.

Each document has a mask: bit i is set if it fails filter i.  For every subset s of the k filters the
signed parity sum of a part and label class is the sum of (-1)^|mask & s| over its rows: 2^k sums, which
partial aggregation combines before anything is shuffled and which merge by addition.  The transform is
its own inverse up to the factor 2^k, so the number of rows of each mask comes back from the sums exactly.
All that is asked of the k! orders is read off these 2^k cells:

* a step keeps the cells that fail none of the filters up to it, and removes those that fail its filter
  and none before it;
* a filter's removals, summed over all orders, are k!/|mask| for each row that fails it: each of the
  filters that a row fails comes first in the same number of orders.

A text is never shuffled: the copies (filter E) are found by SHA-256 and doc_id.  Rows that repeat are
counted before they are joined, so a text, a doc_id or a row that makes up much of the table is one row
of each task by then.  Rows without a doc_id take no part in the join on doc_id.

Defined results: a null text is empty; a null lang is the part of the empty string; a row without a doc_id
fails no filter E and makes no other row fail it, and has no label; rows that repeat a doc_id count each, and do not fail E
for each other; a doc_id with several labels is good (toxic) if one of them says 1; null labels say nothing;
tables without documents give no rows, one without labels gives good_lost and toxic_lost of 0; columns of
other names are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, table

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
SYMBOLS = "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
#: The filter that a row fails if its text stands under a smaller doc_id.
COPIES = "E"


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions that look at one text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, good, toxic, mask, n): how many documents there are of each kind; bit i of mask is filter i of A to E."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(conditions(text).values())), F.lit(0))
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), bits.alias("mask"))
    counted = stored(own.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "audit-rows")
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    fails = F.col("doc_id").isNotNull() & F.col("first").isNull()
    marked = counted.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(fails, 16).otherwise(0))
    per_id = stored(marked.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")), "audit-ids")
    discard(counted)
    says = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    known = per_id.where("doc_id is not null").join(says, "doc_id", "left")
    unknown = per_id.where("doc_id is null").select("*", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    return known.unionByName(unknown).select("part", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "mask", "n")


def sign(a: Column, b: Column) -> Column:
    """(-1)^|a & b|"""
    return 1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(rows: DataFrame, filters: int = 5) -> DataFrame:
    """From (part, good, toxic, mask, n) the 2^filters signed sums of each part and label class, as an array."""
    named = [f"s{s}" for s in range(1 << filters)]
    summed = rows.groupBy("part", "good", "toxic").agg(*[F.sum(F.col("n") * sign(F.col("mask"), F.lit(s))).alias(c) for s, c in enumerate(named)])
    return summed.select("part", "good", "toxic", F.array(*named).alias("sums"))


def cells(sums: DataFrame, filters: int = 5) -> DataFrame:
    """The inverse: (part, good, toxic, mask, n) with a row for every mask."""
    every = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    back = F.transform(every, lambda m: F.shiftright(F.aggregate(every, F.lit(0).cast("long"), lambda a, s: a + F.get("sums", s) * sign(m, s)), filters))
    return sums.select("part", "good", "toxic", F.posexplode(back).alias("mask", "n"))


def evaluate(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """Every order of the filters and every step of it, from the cells."""
    k = len(letters)
    table = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    held = table.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))  # 2^k entries
    steps = [(order, i, f, 1 << letters.index(f), sum(1 << letters.index(x) for x in order[:i])) for order in map("".join, permutations(letters)) for i, f in enumerate(order)]
    plan = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(i + 1).alias("i"), F.lit(f).alias("f"), F.lit(bit).alias("bit"), F.lit(before).alias("before")) for o, i, f, bit, before in steps])
    each = held.withColumn("at", F.explode(plan)).select("part", "cells", "at.*")
    bit, before = F.col("bit"), F.col("before")

    def total(chosen, of: str = "n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(chosen(c["mask"]), c[of]).otherwise(0))

    fails = lambda m: m.bitwiseAND(bit) != 0
    left = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & left(m)
    # k! divided by a number up to k has no remainder
    shares = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(fails(c["mask"]), (F.lit(factorial(k)) / F.bit_count(c["mask"])).cast("long") * c["n"]).otherwise(0))
    return each.select(
        "part", F.col("o").alias("filter_order"), F.col("i").alias("step"), F.col("f").alias("filter"),
        total(lambda m: left(m) & ~fails(m)).alias("kept"), total(removed).alias("removed"), total(lambda m: fails(m) & ~left(m)).alias("redundant"), total(lambda m: m == bit).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), shares.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return evaluate(cells(parity_sums(masks(docs, labels))))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def oracle() -> str:
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
says AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
rows_ AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < {MIN_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) THEN 'B' ELSE '' END ||
  CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > {MAX_CAPITAL_PERCENT} * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 'D' ELSE '' END ||
  CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed FROM texts LEFT JOIN says USING (doc_id)),
counted AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM rows_ GROUP BY part, failed),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, i::INTEGER AS i, substr(o, i, 1) AS x, substr(o, 1, i - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS i)),
judged AS (SELECT part, o, i, x, n, good, toxic, failed, contains(failed, x) AS fails, earlier <> '' AND regexp_matches(failed, '[' || earlier || '_]') AS gone FROM counted, steps),
each AS (SELECT part, o AS filter_order, i AS step, x AS filter, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = x), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM judged GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM each"""
