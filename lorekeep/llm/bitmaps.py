"""Bitmaps of fixed size over the first bits of 64-bit hashes, built without one row a hash.

They order and prefilter: a hash whose bit another one has set costs work, never a result.  When an input has more
hashes than bits, nearly all bits are set and the exact joins that follow do all of the work.

Defined results: no hashes give a bitmap without a bit; repeated hashes set a bit once and count as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import partitions

#: A bitmap has PAGES pages of 2^16 bits: 16 MB.
PAGES = 2048
BITS = 16 + (PAGES - 1).bit_length()
#: Hashes that a task holds before it reports their places.
HELD = 4_000_000
PAGED = "page int, bits binary"
_CHUNK = 32768  # bits of Spark's bitmap functions


def among(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    bit = hashes >> K.U64(64 - (len(bitmap) * 8 - 1).bit_length())
    return (bitmap[bit >> K.U64(3)] >> (bit & K.U64(7)).astype(np.uint8)) & 1 == 1


def paged(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(page, bits): the places in their pages, two bytes each, of all hashes of a task, repeats included."""

    def report(held: list[np.ndarray]) -> pa.RecordBatch:
        places = np.sort(np.concatenate(held) >> K.U64(64 - BITS))
        page, start = np.unique(places >> K.U64(16), return_index=True)
        low = (places & K.U64(0xFFFF)).astype("<u2")
        return pa.RecordBatch.from_arrays([pa.array(page.astype(np.int32)), pa.array([low[a:z].tobytes() for a, z in zip(start, np.append(start[1:], len(low)), strict=True)], pa.binary())], names=["page", "bits"])

    held, n = [], 0
    for hashes in parts:
        held.append(hashes)
        n += len(hashes)
        if n > HELD:
            yield report(held)
            held, n = [], 0
    if n:
        yield report(held)


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, bits): a bitmap, packed by zlib, of the places that occur twice or more; pages without such a place have no row.  All rows of a page are in one partition, as counts of fixed size."""
    seen: dict[int, np.ndarray] = {}
    for b in batches:
        for page, bits in zip(b.column("page").to_pylist(), b.column("bits").to_pylist(), strict=True):
            own = seen.setdefault(page, np.zeros(1 << 16, dtype=np.uint8))
            own[:] = np.minimum(own + np.minimum(np.bincount(np.frombuffer(bits, "<u2"), minlength=1 << 16), 2).astype(np.uint8), 2)
    for page, own in seen.items():
        if (own == 2).any():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([zlib.compress(np.packbits(own == 2, bitorder="little").tobytes(), 1)], pa.binary())], names=["page", "bits"])


def twice(pages: DataFrame) -> np.ndarray:
    """The bitmap of what occurs twice, from rows of ``paged``."""
    out = np.zeros(PAGES << 13, dtype=np.uint8)
    for r in pages.repartition(min(PAGES, partitions(pages.sparkSession)), "page").mapInArrow(_twice, PAGED).collect():
        out[r.page << 13 : (r.page + 1) << 13] = np.frombuffer(zlib.decompress(r.bits), dtype=np.uint8)
    return out


def bitmap(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The bitmap of 2^bits bits of a column of signed hashes, by grouped aggregates."""
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    bit = hashes.select(F.shiftrightunsigned(column, 64 - bits).alias("bit"))
    pages = bit.groupBy((F.col("bit") / _CHUNK).cast("int").alias("page")).agg(F.bitmap_construct_agg((F.col("bit") % _CHUNK).cast("long")).alias("bits"))
    for r in pages.collect():
        out[r.page * _CHUNK // 8 : (r.page + 1) * _CHUNK // 8] = np.frombuffer(r.bits, dtype=np.uint8)
    return out
