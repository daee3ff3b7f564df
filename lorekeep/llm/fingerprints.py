"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint keeps the ``k`` smallest distinct hashes of a text's five-word shingles (words are
``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a text of fewer words has its whole sequence as its one
shingle, one without words none).  Fingerprints of the parts of a text or of a collection merge into
that of the whole; two of them estimate resemblance, containment and the number of distinct
shingles.  Below ``k`` distinct shingles the estimates are exact up to hash collisions.

Written form: base64 of the ascending little-endian 64-bit hashes, so equal texts have equal
fingerprints and the empty text has the empty string.

The query also compares each document with an edited copy and with the next document in ascending
order of doc_id.  Documents are dealt into ranges of doc_id and text hash (boundaries from quantiles, two
a shuffle partition, one task a range) and sorted in each; the first document of every range is also sent to the
range before, so a neighbour never has to be looked up and no task sees more than one range.

Defined results: a null text is empty; two empty fingerprints have resemblance 1, an empty and a
non-empty one 0; a null doc_id comes first; rows that repeat a doc_id follow each other by the hash
of their text and each has the next row as its neighbour; the last document is followed by the first
(a single one by itself); an empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import partitions, table

K_SMALLEST = 256
SHINGLE = 5
WHOLE = 2.0**64
LEAST = -(1 << 63)


def bottom(hashes: np.ndarray, k: int = K_SMALLEST) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    if len(hashes) > 4 * k:  # a few repeats among the smallest must not cost any: take more, then look
        cut = np.partition(hashes, 2 * k)[: 2 * k + 1]
        own = np.unique(hashes[hashes <= cut.max()])
        if len(own) >= k:
            return own[:k]
    return np.unique(hashes)[:k]


def sketches(data: np.ndarray, off: np.ndarray, k: int = K_SMALLEST) -> Iterator[np.ndarray]:
    for lo, hi in K.blocks(off):
        word, _, _, ptr = K.words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower=True)
        for s in K.shingles(word, ptr, SHINGLE):
            yield bottom(s, k)


def write(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<u8")


def merge(parts: Iterable[np.ndarray], k: int = K_SMALLEST) -> np.ndarray:
    """The fingerprint of the union of what the parts stand for."""
    return np.unique(np.concatenate([np.zeros(0, K.U64), *parts]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K_SMALLEST) -> float:
    """Jaccard similarity of the shingle sets: the share of the union's smallest hashes that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    repeated = both[1:][same]
    first = np.concatenate([[True], ~same])
    union = both[first]
    if len(union) > k:
        repeated, union = repeated[repeated <= union[k - 1]], union[:k]
    return len(repeated) / len(union)


def distinct(a: np.ndarray, k: int = K_SMALLEST) -> float:
    """Number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * WHOLE / (float(a[k - 1]) + 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = K_SMALLEST) -> float:
    """Share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge([a, b], k), k) / distinct(a, k))


def fingerprint(docs: DataFrame, keep: list[str], k: int = K_SMALLEST) -> DataFrame:
    """The columns ``keep`` with ``fingerprint`` and ``distinct_shingles``, which replace columns of the same name."""
    keep = [c for c in dict.fromkeys(keep) if c not in ("fingerprint", "distinct_shingles")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["fingerprint string, distinct_shingles double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(sketches(*K.utf8(b.column("text")), k))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([write(s) for s in got], pa.string()), pa.array([distinct(s, k) for s in got], pa.float64())], names=[*keep, "fingerprint", "distinct_shingles"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def _numbers(values: list[int]) -> Column:
    """A literal array of whole numbers."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(key: Column, h: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of the range that (key, h) falls into: how many bounds are not above it, by bisection."""
    if not bounds:
        return F.lit(0)
    keys, hashes = _numbers([k for k, _ in bounds]), _numbers([x for _, x in bounds])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        at = ((s["lo"] + s["hi"]) / 2).cast("int")
        bound = F.get(keys, at)
        below = (bound < key) | ((bound == key) & (F.get(hashes, at) <= h))
        go = s["lo"] < s["hi"]
        return F.struct(F.when(go & below, at + 1).otherwise(s["lo"]).alias("lo"), F.when(go & ~below, at).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, step)["lo"]


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (part, guard, doc_id, text), dealt by part and sorted in it; the row after a part's last is its first ``guard``.

    Ranges follow quantiles of doc_id; a doc_id that takes several of them (null, or one that repeats) is cut by the hash of its texts."""
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(LEAST)).alias("key"), F.xxhash64("text").alias("h"))
    found = keyed.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    bounds: list[tuple[int, int]] = []
    for value, times in sorted(Counter(map(int, found)).items()):
        bounds += [(value, LEAST + (1 << 64) * k // times) for k in range(times)]
    keyed = keyed.withColumn("part", _range_of(F.col("key"), F.col("h"), bounds))
    firsts = sorted((r.part, r.least.key, r.least.h) for r in keyed.groupBy("part").agg(F.min(F.struct("key", "h")).alias("least")).collect())
    if not firsts:
        return keyed.select("part", F.lit(False).alias("guard"), "doc_id", "text")
    # By number of range: its first row, and the range before it that has rows.
    first, before = {p: (k, h) for p, k, h in firsts}, {firsts[i][0]: firsts[i - 1][0] for i in range(len(firsts))}
    numbers = range(len(bounds) + 1)
    column = lambda values: F.get(_numbers(values), F.col("part"))
    opens = (F.col("key") == column([first.get(p, (0, 0))[0] for p in numbers])) & (F.col("h") == column([first.get(p, (0, 0))[1] for p in numbers]))
    previous = column([before.get(p, 0) for p in numbers]).cast("int")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guard"))
    places = F.when(opens, F.array(own, F.struct(previous.alias("part"), F.lit(True).alias("guard")))).otherwise(F.array(own))
    rows = keyed.withColumn("place", F.explode(places)).select("place.part", "place.guard", "doc_id", "text", "key", "h")
    return rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "guard", "key", "h").select("part", "guard", "doc_id", "text")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its own fingerprint, that of its edited text and their likeness; one row is held back for the next batch."""
    held: list[tuple] = []
    for whole in batches:
        for at in range(0, len(whole), 1024):
            b = whole.slice(at, 1024)
            texts = b.column("text").fill_null("")
            got = list(sketches(*K.utf8(texts)))
            rows = held + list(zip(b.column("part").to_pylist(), b.column("guard").to_pylist(), b.column("doc_id").to_pylist(), texts.to_pylist(), got, strict=True))
            held = rows[-1:]
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
            edited = []
            for x, y in pairs:
                half = len(x[3]) // 2
                edited.append((x[3][: len(x[3]) - half] + y[3][:half]).encode())
            sketched = list(sketches(*K.pack(edited)))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([x[2] for x, _ in pairs], pa.int64()),
                "n_chars": pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                "fingerprint": pa.array([write(x[4]) for x, _ in pairs], pa.string()),
                "edited_fingerprint": pa.array([write(s) for s in sketched], pa.string()),
                "near_edited": pa.array([resemblance(x[4], s) for (x, _), s in zip(pairs, sketched, strict=True)], pa.float64()),
                "near_next": pa.array([resemblance(x[4], y[4]) for x, y in pairs], pa.float64()),
            })


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = in_ranges(docs, max(1, 2 * partitions(spark)))
    return rows.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
