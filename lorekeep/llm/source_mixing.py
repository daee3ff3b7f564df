"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order (by the MD5 of the doc_id's text), served
up to ``MAX_EPOCHS`` times over.  A served document gets a virtual finish time: the cumulative words of
its source up to and with it, divided by the source's target.  All queues thus reach their targets at
time 1.  The served documents are sorted by finish time across all sources and the sequence is cut
where the total budget is spent.

Targets: sources in order of code point, null last, weigh 1, 2, 3, 1, 2, 3, ...; they share all words
by weight; a target stops at ``MAX_EPOCHS`` times its source's words and the excess is reshared by
weight until none is above.

Both running sums are split so that no source and no stretch of time lands in one task: a source's
order is dealt by ranges of the hash, the finish times by equal slots of virtual
time (each slot takes about the same number of words from every source, whatever their sizes); sums
of the slots before come from small tables of one row per source and range, or per slot.  Ranges and slots grow with
the number of documents (one for each ``PER_PART``, at least ``PARTS``).  Rows that have the same place (no doc_id and equal texts, or a
doc_id and size twice) are one row with a count until they have been placed.  The only
unsplit windows run over the small tables.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its
own, last; a row with a null doc_id has its place by its text; rows that repeat a doc_id are served one after
the other; a source without words has target 0; an empty table gives no rows; columns of other names
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, table

MAX_EPOCHS = 3
PARTS = 4096
PER_PART = 1 << 16
WEIGHTS = (1, 2, 3)


def word_count(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``: the places where a word begins."""
    return F.size(F.expr(f"regexp_extract_all(coalesce({text}, ''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = MAX_EPOCHS) -> DataFrame:
    """From rows (source, size) one row per source: source, source_size, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))).withColumn("top", (limit * F.col("source_size")).cast("double"))
    # Sources reach their top in the order of top / weight; level: words per weight if exactly those before this one are at their top.
    order = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / share)
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("top"), F.struct(F.col("top") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    return level.select("source", "source_size", F.least("top", open_level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, size: Column) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken): one for each row of ``docs``; taken counts words, repeats included."""
    text = F.col("text") if "text" in docs.columns else F.lit("")
    own = stored(docs.select("doc_id", "source", size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), text, F.lit("")).cast("binary")).alias("h")), "mix-sizes")
    goal = targets(own)
    ways = max(PARTS, -(-own.count() // PER_PART))
    counted = own.groupBy("source", "h", "doc_id", "size").agg(F.count("*").alias("n"))
    prefix = counted.withColumn("part", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ways / 2**32))
    parts = prefix.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("n")).alias("part_size"))
    offsets = parts.select("source", "part", (F.sum("part_size").over(Window.partitionBy("source").orderBy("part")) - F.col("part_size")).alias("offset"))
    known = offsets.join(goal, offsets["source"].eqNullSafe(goal["source"])).select(offsets["source"].alias("s"), F.col("part").alias("p"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = prefix.withColumn("inside", F.sum(F.col("size") * F.col("n")).over(inside))
    queue = placed.join(known, placed["part"].eqNullSafe(known["p"]) & placed["source"].eqNullSafe(known["s"])).withColumn("later", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    queue = stored(queue.select("doc_id", "source", "size", "h", "source_size", "target", (F.col("offset") + F.col("inside") - F.col("later") * F.col("size")).alias("served")), "mix-queue")
    served = queue.where("size > 0 and target > 0")
    # One row: the budget, and a time by which it is surely spent (no queue lags its share by more than its largest document).
    budget, late = served.agg(F.sum("size"), 1 + F.max(F.col("size") / F.col("target"))).first()
    copies = served.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(MAX_EPOCHS)])))
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("served")) / F.col("target")).where(F.col("finish") <= F.lit((late or 0.0) + 1e-6))
    copies = copies.withColumn("slot", F.floor(F.col("finish") * ways))
    slots = copies.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    # A row a slot; all queues are near their targets at time 1, so there are some ``ways`` of them, not one a document.
    reached = slots.select("slot", (F.sum("slot_size").over(Window.orderBy("slot")) - F.col("slot_size")).alias("before")).where(F.col("before") < F.lit(budget or 0))
    ordered = Window.partitionBy("slot").orderBy("finish", F.col("source").asc_nulls_last(), "epoch", "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    taken = copies.join(reached, "slot").withColumn("total", F.col("before") + F.sum("size").over(ordered)).where(F.col("total") <= F.lit(budget or 0))
    rows = taken.select("doc_id", "source", "size", "source_size", "target", "served", F.col("size").alias("took")).unionByName(queue.select("doc_id", "source", "size", "source_size", "target", "served", F.lit(0).cast("long").alias("took")))
    # A place in a queue belongs to one document with words, and to any number without.
    with_words = rows.where("size > 0").groupBy("source", "served", "doc_id", "size", "source_size", "target").agg(F.sum("took").alias("taken"))
    without = queue.where("size = 0").select("source", "served", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return with_words.unionByName(without).select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "taken")


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), word_count()).select("doc_id", "size", "source_size", "target", "taken")


def stage_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it.

    Columns of any other name are kept as they are.  Null texts and texts without words take no words, so they go; rows that share a doc_id are
    documents of their own; rows that are equal in all columns are taken as often as all of them together; an empty table gives no rows."""
    columns = docs.columns
    others = [F.col(f"`{c}`") for c in columns if c not in ("doc_id", "text") and not docs.schema[c].dataType.simpleString().startswith("map")]
    key = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.hex(F.xxhash64(F.lit(1), *others)))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), key.alias("doc_id"), "source", "text")
    counts = stored(mix(named, word_count()).groupBy("doc_id").agg(F.try_divide(F.sum("taken"), F.max("size")).cast("int").alias("copies"), F.count("*").alias("n")).where("copies > 0"), "mix-copies")
    again = lambda rows: rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
    single = named.select("row", "doc_id").join(counts.where("n = 1"), "doc_id")
    equal = named.select("row", "doc_id").join(counts.where("n > 1"), "doc_id").groupBy("doc_id").agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    return again(single).unionByName(again(equal))


def oracle() -> str:
    return f"""
WITH own AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, [{', '.join(f'{w}.0' for w in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}]::DOUBLE AS weight FROM own GROUP BY source),
levels AS (SELECT *, {MAX_EPOCHS} * source_size::DOUBLE AS top,
  ((sum(source_size) OVER ())::DOUBLE - coalesce(sum({MAX_EPOCHS} * source_size::DOUBLE) OVER w, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM per WINDOW w AS (ORDER BY {MAX_EPOCHS} * source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, least(top, weight * (SELECT level FROM levels WHERE level * weight <= top ORDER BY top / weight, source NULLS LAST LIMIT 1)) AS target FROM levels),
queue AS (SELECT own.*, source_size, target, (sum(size) OVER (PARTITION BY own.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS served FROM own JOIN goal ON own.source IS NOT DISTINCT FROM goal.source),
copies AS (SELECT *, (epoch * source_size + served)::DOUBLE / target AS finish FROM queue, (SELECT unnest(range({MAX_EPOCHS})) AS epoch) WHERE size > 0 AND target > 0),
cut AS (SELECT doc_id, source, served, size, (sum(size) OVER (ORDER BY finish, source NULLS LAST, epoch, h, doc_id, size ROWS UNBOUNDED PRECEDING)) AS total FROM copies),
took AS (SELECT doc_id, source, served, sum(size)::BIGINT AS taken FROM cut WHERE total <= (SELECT sum(size) FROM own) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, coalesce(q.target, 0) AS target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queue q LEFT JOIN took t ON q.size > 0 AND q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.source IS NOT DISTINCT FROM t.source AND q.served = t.served"""
