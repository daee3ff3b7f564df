"""Line dedup by a deletion-neighbourhood join.

Lines are the ``\\n``-separated parts of a text, compared without the white space at their ends.  In
the order of (doc_id, place in the text), a line goes when an equal line stands earlier, or an earlier
line lies within ``MAX_EDITS`` = 1 edit (insertion, deletion or substitution of a code point); the
earliest stays.  Lines of fewer than ``MIN_CHARS`` code points are compared for equality only; lines
without a word are kept as they are.

Equal lines are grouped by a 128-bit hash first, so one row stands for all copies of a line.  The
deletion neighbourhood of a line (itself, and itself without the code point at each place) is emitted as
hashed keys and joined: equal keys at the same place mean a substitution, a line that equals another's
variant means an insertion.  All lines of one key and place are within one edit of each other, so the
earliest of a group, found by a grouped minimum, settles all of its members and no pairs of a group are
formed; each line is then verified against that earliest line by its edit distance.

Emitting every variant of every line would multiply the input by the line length, so lines without a
possible partner are left out first, exactly: one edit leaves all but one of S stretches of a line
intact, so two lines within one edit agree on the hash of what precedes and what follows one of S gaps.
This is applied with two gaps to all distinct lines and with sixteen to those that remain, and variants
are emitted only for places inside a gap that was matched.

Defined results: a null text has no lines and stays null; an empty one is kept; rows with a null doc_id come
before all others, in the order of the hash of their text (doc_ids below -2^62 are reserved for this); rows that share
a doc_id, or have none and the same text, are one document in the order (each keeps the line); text is
rejoined with ``\\n``; an empty table gives no rows; all columns are kept, those named ``n_lines`` or
``n_dropped`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import discard, stored, table

MIN_CHARS = 20
MAX_EDITS = 1
LEAST = -(1 << 63)
COARSE, FINE, GRAIN = 2, 16, 8
TAIL = np.zeros(256, dtype=bool)
TAIL[128:192] = True


def _cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trimmed spans of the lines that have a word, their number in the row, and row pointers."""
    ws, we = K.word_spans(data, off)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1], breaks + 1]))
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    a, b = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    has = b > a
    starts, a, b = starts[has], a[has], b[has]
    ptr = np.searchsorted(starts, off)
    ptr[-1] = len(starts)
    row = np.searchsorted(off, starts, side="right") - 1
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, off[row])
    return ws[a], we[b - 1] if len(b) else we[:0], number, ptr


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.mix64(K.span_hasher(data)(start, end)), K.mix64(K.span_hasher(data, K.TABLE2)(start, end))


def _salt(width: np.ndarray, gap: int) -> np.ndarray:
    return K.mix64(width.astype(K.U64) * K.U64(64) + K.U64(gap + 1))


def _pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi in K.blocks(off):
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each distinct line of a document (key, h1, h2) and its coarse gap keys (null for a short line)."""
    names = ["key", "h1", "h2", "k0", "k1", "k2", "k3"]
    for b in batches:
        keys = b.column("key").to_numpy()
        for lo, _, data, off in _pieces(*K.utf8(b.column("text"))):
            start, end, _, ptr = _cut(data, off)
            if not len(start):
                continue
            hashed = K.span_hasher(data)
            h1, h2 = K.mix64(hashed(start, end)), K.mix64(K.span_hasher(data, K.TABLE2)(start, end))
            row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
            _, first = np.unique(np.stack([row.astype(K.U64), h1]), axis=1, return_index=True)
            first.sort()
            start, end, h1, h2, row = start[first], end[first], h1[first], h2[first], row[first]
            points = np.flatnonzero(~TAIL[data])
            c0 = np.searchsorted(points, start)
            n = np.searchsorted(points, end) - c0
            near = n >= MIN_CHARS
            out = [keys[lo + row], h1.view(np.int64), h2.view(np.int64)]
            columns = [pa.array(x) for x in out]
            width0 = n // COARSE // GRAIN * GRAIN
            for shift in (0, 1):
                width = (n - shift) // COARSE // GRAIN * GRAIN
                used = near & (width > 0) & ((width != width0) if shift else True)
                w = np.where(used, width, 1)
                at_front, at_back = points[np.minimum(c0 + w, len(points) - 1)], points[np.maximum(c0 + n - w, c0)]
                front = K.mix64(hashed(start, np.minimum(at_front, end)) ^ _salt(w, 1))
                back = K.mix64(hashed(at_back, end) ^ _salt(w, 0))
                columns += [pa.array(front.view(np.int64), mask=~used), pa.array(back.view(np.int64), mask=~used)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of each document, with their text and place."""
    for b in batches:
        keys, wanted = b.column("key").to_pylist(), b.column("wanted").to_pylist()
        raw = K.utf8(b.column("text"))
        for lo, hi, data, off in _pieces(*raw):
            start, end, number, ptr = _cut(data, off)
            if not len(start):
                continue
            h1, h2 = _hashes(data, start, end)
            rows: dict[str, list] = {"key": [], "line": [], "h1": [], "h2": [], "content": []}
            for d in range(hi - lo):
                want = set(wanted[lo + d])
                for i in range(ptr[d], ptr[d + 1]):
                    h = int(h1[i].view(np.int64))
                    if h in want:
                        want.discard(h)  # only the first of equal lines
                        for name, value in (("key", keys[lo + d]), ("line", int(number[i])), ("h1", h), ("h2", int(h2[i].view(np.int64))), ("content", data[start[i] : end[i]].tobytes().decode())):
                            rows[name].append(value)
            kinds = {"key": pa.int64(), "line": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "content": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in kinds.items()], names=list(kinds))


def _points(text: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Running hash sums over code points, and the inverse powers."""
    codes = K.mix64(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(K.U64) * K.U64(2) + K.U64(seed))
    up, down = K._powers.get(len(codes) + 2)
    sums = np.zeros(len(codes) + 1, dtype=K.U64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return sums, down


def _gaps(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(width, gap, start, end) of the fine gaps of a line of n code points."""
    for width in {n // FINE, (n - 1) // FINE}:
        if width:
            for g in range(FINE):
                yield width, g, g * width, n - (FINE - 1 - g) * width


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fine gap keys of the candidate lines."""
    for b in batches:
        keys, owner, gaps = [], [], []
        ids = b.column("id").to_pylist()
        for i, text in zip(ids, b.column("content").to_pylist(), strict=True):
            n = len(text)
            sums, down = _points(text, 1)
            own = list(_gaps(n))
            s, e = np.array([x[2] for x in own], dtype=int), np.array([x[3] for x in own], dtype=int)
            salt = np.array([x[0] * 64 + x[1] for x in own], dtype=K.U64)
            keys.append(K.mix64(K.mix64(sums[s] + K.U64(1)) ^ ((sums[n] - sums[e]) * down[e]) ^ K.mix64(salt)).view(np.int64))
            owner += [i] * len(own)
            gaps += [x[0] * FINE + x[1] for x in own]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(owner, pa.int64()), pa.array(gaps, pa.int64())], names=["gap_key", "id", "gap"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The line itself (place -1) and its deletion variants inside the matched gaps."""
    for whole in batches:
        for at in range(0, len(whole), 2048):
            b = whole.slice(at, 2048)
            v1, v2, place, owner = [], [], [], []
            for i, text, gaps in zip(b.column("id").to_pylist(), b.column("content").to_pylist(), b.column("gaps").to_pylist(), strict=True):
                n = len(text)
                wanted = np.zeros(n, dtype=bool)
                for g in gaps:
                    width, k = divmod(g, FINE)
                    wanted[k * width : n - (FINE - 1 - k) * width] = True
                p = np.flatnonzero(wanted)
                for seed, out in ((1, v1), (3, v2)):
                    sums, down = _points(text, seed)
                    out.append(np.concatenate([sums[n:], sums[p] + (sums[n] - sums[p + 1]) * down[1]]))
                place.append(np.concatenate([[-1], p]))
                owner.append(np.full(len(p) + 1, i, dtype=np.int64))
            if owner:
                yield pa.RecordBatch.from_arrays([pa.array(K.mix64(np.concatenate(v1)).view(np.int64)), pa.array(K.mix64(np.concatenate(v2)).view(np.int64)), pa.array(np.concatenate(place).astype(np.int64)), pa.array(np.concatenate(owner))], names=["v1", "v2", "place", "id"])


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2), stored, of the distinct lines whose first occurrence lies within one edit of an earlier line."""
    # Distinct lines (h1, h2, key of the earliest document, gap keys).
    keyed = lines.where("k0 is not null").select("h1", "h2", "key", F.explode(F.array_compact(F.array("k0", "k1", "k2", "k3"))).alias("gap_key"))
    twice = keyed.groupBy("gap_key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gap_key")
    wanted = keyed.join(twice, "gap_key", "left_semi").groupBy("key").agg(F.collect_set("h1").alias("wanted"))
    content = docs.join(wanted, "key").select("key", "text", "wanted").mapInArrow(_pick, "key long, line long, h1 long, h2 long, content string")
    # Rows that share a doc_id may hold a line twice: the first place counts.
    content = content.withColumn("order", F.expr("cast(key as decimal(38,0)) * 4294967296 + line"))
    content = stored(content.withColumn("id", F.xxhash64("h1", "h2")), "near-candidates")
    if not content.limit(1).count():
        return stored(content.select("h1", "h2"), "near-lines")
    fine = stored(content.select("id", "content").mapInArrow(_fine, "gap_key long, id long, gap long"), "gaps")
    twice = fine.groupBy("gap_key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("gap_key")
    gaps = fine.join(twice, "gap_key", "left_semi").groupBy("id").agg(F.collect_set("gap").alias("gaps"))
    variants = content.join(gaps, "id").select("id", "content", "gaps").mapInArrow(_variants, "v1 long, v2 long, place long, id long")
    placed = stored(variants.join(content.select("id", "order"), "id"), "variants")
    # The earliest line of each key and place, and of each key: the line itself (place -1), and all variants.
    at_place = placed.groupBy("v1", "v2", "place").agg(F.min("order").alias("first"))
    by_key = at_place.groupBy("v1", "v2").agg(F.min(F.when(F.col("place") < 0, F.col("first"))).alias("line"), F.min(F.when(F.col("place") >= 0, F.col("first"))).alias("variant"))
    rows = placed.join(at_place, ["v1", "v2", "place"]).join(by_key, ["v1", "v2"])
    other = F.when(F.col("place") < 0, F.col("variant")).otherwise(F.least("first", F.coalesce("line", "first")))
    # Each line against the earliest of every group it is in; equal pairs count once.
    pairs = rows.select("id", "order", other.alias("earlier")).where("earlier < order").distinct()
    own = content.select("id", "content", "h1", "h2", "order")
    first = content.select(F.col("order").alias("earlier"), F.col("content").alias("earlier_content"))
    checked = pairs.select("id", "earlier").join(own, "id").join(first, "earlier").where(F.levenshtein("content", "earlier_content", MAX_EDITS) >= 0)
    close = stored(checked.select("h1", "h2").distinct(), "near-lines")
    discard(content, fine, placed)
    return close


def _apply(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, dropped = [], [], []
            raw, gone_lists, given = K.utf8(b.column("text")), b.column("gone").to_pylist(), b.column("text").is_null().to_pylist()
            for lo, hi, data, off in _pieces(*raw):
                start, end, number, ptr = _cut(data, off)
                h1 = K.mix64(K.span_hasher(data)(start, end)).view(np.int64).tolist() if len(start) else []
                numbers = number.tolist()
                for d in range(hi - lo):
                    own = data[off[d] : off[d + 1]].tobytes()
                    parts = own.split(b"\n")
                    gone, out = set(gone_lists[lo + d] or ()), set()
                    for i in range(ptr[d], ptr[d + 1]):
                        h = h1[i]
                        if h in gone:
                            out.add(numbers[i])
                        else:
                            gone.add(h)  # a later equal line of this text goes too
                    counts.append(0 if given[lo + d] else len(parts))
                    dropped.append(len(out))
                    texts.append(None if given[lo + d] else (b"\n".join([p for i, p in enumerate(parts) if i not in out]) if out else own).decode())
            yield pa.RecordBatch.from_arrays([*[pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns], pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return run


def dedup(docs: DataFrame, near: bool = True) -> DataFrame:
    """All rows of ``docs`` with their text without repeated lines, ``n_lines`` (before) and ``n_dropped``."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "key", "gone")]
    # Without a doc_id the text tells rows apart: keys below all doc_ids from -2^62 on.
    nameless = F.lit(LEAST) + F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    docs = docs.select(*[F.col(f"`{c}`") for c in own]).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), nameless))
    texts = docs.select("key", "text")
    places = stored(texts.mapInArrow(_survey, "key long, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long"), "places")
    lines = stored(places.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.max("key").alias("last"), *[F.min(k).alias(k) for k in ("k0", "k1", "k2", "k3")]), "lines")
    repeated = lines.where("key < last").select("h1", "h2", F.col("key").alias("kept"))
    if near:
        close = near_lines(texts, lines)
        repeated = repeated.join(close, ["h1", "h2"], "left_anti").unionByName(close.withColumn("kept", F.lit(None).cast("long")))
    gone = stored(places.select("key", "h1", "h2").join(repeated, ["h1", "h2"]).where("kept is null or kept <> key").groupBy("key").agg(F.collect_set("h1").alias("gone")), "gone")
    discard(places, lines, *([close] if near else []))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own] + ["n_lines long, n_dropped long"])
    return docs.join(gone, "key", "left").drop("key").mapInArrow(_apply(own), schema)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their repeated lines; a document that loses all its words goes."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = dedup(packed).where(~((F.col("n_dropped") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")))
    own = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*[own.get(c, F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
