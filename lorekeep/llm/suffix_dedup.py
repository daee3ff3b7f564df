"""Suffix-array dedup with sparse, minimiser-selected suffixes.

A suffix is retained where the hash of its first ``GRAM`` words is the smallest in some window of
``min_words`` words that holds it (its minimiser).  The choice depends on the window's words alone, so a
passage of ``min_words`` words that stands in two documents has a retained suffix at the same place in
both, while only about one suffix in twenty is kept.

The order of the retained suffixes is refined bucket by bucket, by longer and longer content to the right and to the left, as
sorting by prefix doubling does; buckets of one document are left behind at once:

1. by the first ``GRAM`` words;
2. extended left and right: by the words that ``STEP`` neighbouring frames of ``min_words`` words around the suffix have in common.
   If all members of a bucket are equal in all of the words of these frames, the frames are matched as one;
3. else by each of these frames.

Buckets are grouped aggregates on hashes, which combine before the shuffle and split hot values; no task gathers the suffixes
of one value, no pairs are formed.  A sorted array with a comparison of neighbours is not used on purpose: a neighbour
tells how far a suffix matches to one side of it, but not which document has a frame first, and a passage that all
documents share would be one long run of the order.  Step 1 is a prefilter by a bitmap of fixed size, the rest is exact (128 bits).

Result: one row for each maximal run of overlapping or touching frames of ``min_words`` words that each occur in two or more
documents (partners may differ from frame to frame, so the run need not occur as a whole elsewhere):
doc_id, start and end (code points), n_words, first_doc_id (smallest document with an equal frame of the
span), and is_first (this document is where every frame of the span occurs first).  Documents with equal
texts are one document until the end; then each has its whole text as one span, whose first_doc_id and is_first
tell of the whole text.  The first of them keeps its passages that other texts share: ``inside`` of its row lists
their spans (start, end, n_words, first_doc_id, is_first as above, in the order of start; empty if there are none)
and is null in all other rows, as a later copy is a repeat as a whole.

Defined results: null, empty and shorter texts have no spans; rows with a null doc_id are documents by their text, come
after all others (doc_ids from 2^62 on are reserved for this) and show null for their doc_id;
rows that share a doc_id are one document (its own repeats do not count), whose texts have spans of their own (``text_hash``, a 64-bit hash, tells which); an empty table gives no rows;
texts of any length are taken whole; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmaps
from . import kernels as K
from .shared import discard, stored, table

MIN_WORDS = 50
GRAM = 10
#: Frames of a class.
STEP = 10
#: Rows of a batch that are worked on at a time.
SLICE = 1024
#: Keys from here on stand for rows without a doc_id.
NAMELESS = 1 << 62
TAIL = np.zeros(256, dtype=bool)
TAIL[128:192] = True


def _slide(a: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The least (or greatest) of the ``width`` values from each place on."""
    done, size = a, 1
    while 2 * size <= width:
        done = best(done[: len(done) - size], done[size:])
        size *= 2
    rest = width - size
    return best(done[: len(done) - rest], done[rest:]) if rest else done


def minimisers(word: np.ndarray, ptr: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the retained suffixes and the hashes of their first words, mixed anew: as the least of their windows they are all small, and would share a small part of a bitmap."""
    width = min_words - GRAM + 1
    n = len(word)
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, K.U64)
    gram = K.runs(word, GRAM)
    row_end = np.repeat(ptr[1:], np.diff(ptr))  # of each word
    least = _slide(gram, width)
    whole = np.arange(len(least)) + min_words <= row_end[: len(least)]
    least = np.where(whole, least, K.U64(0))
    padded = np.concatenate([np.zeros(width - 1, K.U64), least, np.zeros(width - 1, K.U64)])
    places = np.flatnonzero(_slide(padded, width, np.maximum)[: len(gram)] == gram)
    return places, K.mix64(gram[places])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words of each text."""
    for b in batches:
        counts = []
        data, off = K.utf8(b.column("text"))
        for lo, hi in K.blocks(off):
            own = off[lo : hi + 1] - off[lo]
            starts, _ = K.word_spans(data[off[lo] : off[hi]], own)
            counts.append(np.diff(np.append(np.searchsorted(starts, own[:-1]), len(starts))))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h1"), b.column("h2"), b.column("n_chars"), pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=["doc_id", "h1", "h2", "n_chars", "n_words"])


def _prefix_hashes(word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Running sums of two hashes over words, and the inverse powers."""
    out = []
    for salt in (1, 3):
        x = K.mix64(word + K.U64(salt))
        up, down = K._powers.get(len(x) + 1)
        sums = np.zeros(len(x) + 1, dtype=K.U64)
        np.cumsum(x * up[: len(x)], out=sums[1:])
        out.append((sums, down))
    return out


def _between(hashes: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """Hash of the words a..b-1, wherever they stand."""
    sums, down = hashes
    return K.mix64((sums[b] - sums[a]) * down[a] + K.mix64(np.zeros(len(a), K.U64) + np.asarray(salt).astype(K.U64) + K.U64(1)))


class _Steps:
    """The classes of frames around the retained suffixes of a block of texts."""

    def __init__(self, word: np.ndarray, ptr: np.ndarray, wanted: np.ndarray, min_words: int) -> None:
        at, gram = minimisers(word, ptr, min_words)
        at = at[bitmaps.among(wanted, gram)]
        reach = min_words - GRAM
        begin, end = (ptr[:-1], ptr[1:]) if len(ptr) > 1 else (ptr, ptr)
        row = np.searchsorted(ptr, at, side="right") - 1
        steps = -(-(reach + 1) // STEP)
        self.row, self.first, self.last, low = np.repeat(row, steps), None, None, np.tile(np.arange(steps) * STEP, len(at))
        high = np.minimum(low + STEP - 1, reach)  # words before the suffix at which the frames of a class start
        p = np.repeat(at, steps)
        self.first, self.last = np.maximum(p - high, begin[self.row]), np.minimum(p - low, end[self.row] - min_words)
        some = self.first <= self.last
        self.row, self.first, self.last, p, low, high = [x[some] for x in (self.row, self.first, self.last, p, low, high)]
        self.hashes = _prefix_hashes(word)
        # A document that has any frame of the class has the words common to all of them.
        self.key = _between(self.hashes[0], p - low, p - high + min_words, low + 1)
        # All words of the frames there are, and which there are.
        self.content = _between(self.hashes[1], self.first, self.last + min_words, (p - self.first) * 4096 + (p - self.last) + 7)


def _texts(batch: pa.RecordBatch, keep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of the rows whose bit is in ``keep``: keys, text hashes, bytes, row offsets; word hashes, starts, ends and row pointers.  Of a text that a slice has twice only the least key."""
    for at in range(0, len(batch), SLICE):  # copied a slice at a time, not the batch
        part = batch.slice(at, SLICE)
        part = part.filter(pa.array(bitmaps.among(keep, part.column("row").to_numpy().view(K.U64))))
        key, t = part.column("key").to_numpy(), part.column("t").to_numpy()
        order = np.lexsort((key, t))
        _, first = np.unique(t[order], return_index=True)
        part = part.take(pa.array(np.sort(order[first])))
        key, t = part.column("key").to_numpy(), part.column("t").to_numpy()
        data, off = K.utf8(part.column("text"))
        for lo, hi in K.blocks(off):
            own, ends = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            yield key[lo:hi], t[lo:hi], own, ends, *K.words(own, ends)


def _grams(keep, min_words: int):
    """(page, bits) of the first words of the retained suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from bitmaps.paged(minimisers(word, ptr, min_words)[1] for b in batches for *_, word, _, _, ptr in _texts(b, keep.value))

    return run


def _classes(keep, wanted, min_words: int):
    """(k, content, key, t) of each class of frames of the retained suffixes whose first words may occur elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t, _, _, word, _, _, ptr in _texts(b, keep.value):
                x = _Steps(word, ptr, wanted.value, min_words)
                if len(x.row):
                    yield pa.RecordBatch.from_arrays([pa.array(x.key.view(np.int64)), pa.array(x.content.view(np.int64)), pa.array(key[x.row]), pa.array(t[x.row])], names=["k", "content", "key", "t"])

    return run


_MATCHED = "k long, content long, key long, t long, places long, bounds long, single boolean"


def _matches(keep, wanted, even, mixed, min_words: int):
    """Rows of ``_MATCHED``: classes that are matched as a whole, and the frames of the others; ``places`` packs the first and last frame, ``bounds`` where
    they begin and end (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _MATCHED.split(", ")]
        for b in batches:
            for key, t, data, off, word, ws, we, ptr in _texts(b, keep.value):
                x = _Steps(word, ptr, wanted.value, min_words)
                if not len(x.row):
                    continue
                whole = bitmaps.among(even.value, x.key)
                part = bitmaps.among(mixed.value, x.key)
                flags = np.zeros(len(word) + 1, dtype=np.int32)
                np.add.at(flags, x.first[part], 1)
                np.add.at(flags, x.last[part] + 1, -1)
                frame = np.flatnonzero(np.cumsum(flags) > 0)
                points = np.zeros(len(data) + 1, dtype=np.int32)
                np.cumsum(~TAIL[data], out=points[1:])
                for row, first, last, k, content, single in (
                    (x.row[whole], x.first[whole], x.last[whole], x.key[whole], x.content[whole], False),
                    (np.searchsorted(ptr, frame, side="right") - 1, frame, frame, *[_between(h, frame, frame + min_words) for h in x.hashes], True),
                ):
                    if len(row):
                        base, begin = points[off[row]].astype(np.int64), ptr[row]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(k.view(np.int64)), pa.array(content.view(np.int64)), pa.array(key[row]), pa.array(t[row]), pa.array(((first - begin) << 32) | (last - begin)),
                            pa.array(((points[ws[first]] - base) << 32) | (points[we[last + min_words - 1]] - base)), pa.array(np.full(len(row), single)),
                        ], names=names)

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    spark = docs.sparkSession
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    keyed = hashed.select(F.coalesce("doc_id", F.lit(NAMELESS).bitwiseOR(F.col("t").bitwiseAND(F.lit(NAMELESS - 1)))).alias("key"), "text", "t")
    sized = keyed.withColumns({"h2": F.xxhash64("text", F.lit(7)), "n_chars": F.length("text").cast("long")}).withColumnsRenamed({"key": "doc_id", "t": "h1"})
    survey = stored(sized.mapInArrow(_survey, "doc_id long, h1 long, h2 long, n_chars long, n_words long").where(F.col("n_words") >= min_words), "texts")
    groups = survey.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")).where("node < last").select("h1", "h2", "node")
    copies = stored(survey.join(groups, ["h1", "h2"]).select("doc_id", F.col("h1").alias("t"), "node", "n_chars", "n_words").distinct(), "copies")
    # The copies of a text but the first, and texts that are too short, are left out where no other row has their bit.
    row = F.xxhash64("t", "key").alias("row")
    others = copies.where("doc_id <> node").select(F.col("doc_id").alias("key"), "t").distinct()
    first = survey.select(F.col("doc_id").alias("key"), F.col("h1").alias("t")).join(others, ["key", "t"], "left_anti").select(row)
    keep = spark.sparkContext.broadcast(bitmaps.bitmap(first, "row"))
    discard(survey)
    keyed = keyed.select("key", "text", "t", row)

    # Two documents with different texts: both vary in a bucket (if no two rows differ in both, all rows agree in one).
    apart = [F.min("key").alias("first_doc"), F.max("key").alias("last_doc"), F.min("t").alias("first_t"), F.max("t").alias("last_t")]
    several = (F.col("first_doc") < F.col("last_doc")) & (F.col("first_t") < F.col("last_t"))
    wanted = spark.sparkContext.broadcast(bitmaps.twice(keyed.mapInArrow(_grams(keep, min_words), bitmaps.PAGED)))
    classes = keyed.mapInArrow(_classes(keep, wanted, min_words), "k long, content long, key long, t long")
    buckets = classes.groupBy("k").agg(*apart, F.min("content").alias("least"), F.max("content").alias("most")).where(several)
    buckets = stored(buckets.select("k", "first_doc", F.when(F.col("least") == F.col("most"), F.col("least")).alias("content")), "buckets")
    even, mixed = [spark.sparkContext.broadcast(bitmaps.bitmap(buckets.where(f"content is {x} null"), "k")) for x in ("not", "")]
    rows = stored(keyed.mapInArrow(_matches(keep, wanted, even, mixed, min_words), _MATCHED), "matches")
    whole = rows.where("not single").join(buckets.where("content is not null"), ["k", "content"])
    frames = rows.where("single")
    twice = frames.groupBy("k", "content").agg(*apart).where(several).select("k", "content", "first_doc")
    alone = frames.join(twice, ["k", "content"])
    hits = whole.select("key", "t", "places", "bounds", "first_doc").unionByName(alone.select("key", "t", "places", "bounds", "first_doc"))
    low = F.lit(0xFFFFFFFF)
    # Shipped packed; frames of a text in the order of their places; a frame that begins behind all before it opens a new span.
    hits = hits.select(F.col("key").alias("doc_id"), "t", "first_doc", "places", "bounds").repartition("doc_id", "t")
    hits = hits.withColumns({"word": F.shiftright("places", 32), "final": F.col("places").bitwiseAND(low), "begin": F.shiftright("bounds", 32), "finish": F.col("bounds").bitwiseAND(low)})
    order = Window.partitionBy("doc_id", "t").orderBy("word", "final", "finish")
    opened = hits.withColumn("reach", F.max("final").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    opened = opened.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("word") > F.col("reach") + min_words), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = stored(opened.groupBy("doc_id", "t", "island").agg(
        F.min("begin").alias("start"), F.max("finish").alias("end"), (F.max("final") - F.min("word") + min_words).cast("long").alias("n_words"), F.min("first_doc").alias("first_doc_id"),
        F.min(F.col("first_doc") == F.col("doc_id")).alias("is_first"),
    ), "spans")
    discard(rows, buckets)
    inside = F.sort_array(F.collect_list(F.struct("start", "end", "n_words", "first_doc_id", "is_first")))
    # Later copies that the bitmap let through have spans of no use: only those of the first copy and of texts without copies are taken.
    own = spans.join(copies.where("doc_id = node").select("doc_id", "t").distinct(), ["doc_id", "t"], "left_semi").groupBy("doc_id", "t").agg(inside.alias("own"))
    partial = spans.join(copies.select("doc_id", "t").distinct(), ["doc_id", "t"], "left_anti").select("doc_id", "start", "end", "n_words", "first_doc_id", "is_first", F.lit(None).cast(own.schema["own"].dataType).alias("inside"), F.col("t").alias("text_hash"))
    first_of = F.col("doc_id") == F.col("node")
    entire = copies.join(own, ["doc_id", "t"], "left").select(
        "doc_id", F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("end"), "n_words", F.col("node").alias("first_doc_id"), first_of.alias("is_first"), F.when(first_of, F.coalesce("own", F.array())).alias("inside"), F.col("t").alias("text_hash"),
    )
    return partial.unionByName(entire).withColumns({c: F.when(F.col(c) < NAMELESS, F.col(c)) for c in ("doc_id", "first_doc_id")})


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
