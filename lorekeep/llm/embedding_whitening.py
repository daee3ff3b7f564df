"""Whitening of embeddings by a blockwise QR decomposition and a one-sided Jacobi SVD.

Every entry c becomes the whole number x = floor(64 * c) + 1000000, so that sums are exact.  Passes:

1. n and the sums S of each dimension, in whole numbers;
2. blockwise TSQR: each task folds its centred rows, a block at a time, into one triangle R; triangles are
   stacked and decomposed again, ``FAN`` at a time, until ``FAN`` are left, which is what the driver sees;
3. one-sided Jacobi on R at the driver (d x d, whatever the number of rows): plane rotations make R's columns
   orthogonal; their lengths are the standard deviations times sqrt(n), the accumulated rotations are the
   components.  The covariance matrix is never formed, so small deviations keep their digits;
4. the covariance of what comes out, summed like the triangles, gives ``identity_error``;
5. each row is projected.  Nothing is shuffled but the triangles and the sums.

The vectors' dimension is the length that most of them have (of equally frequent ones, the larger).

Defined results: a row is dropped if its vector is null, empty, of another length, or has an entry that is null, not
finite or of ``LIMIT`` and more (its x would not be exact); repeated rows count each; a null vec_id stays null; a component whose
deviation is less than ``TINY`` of the largest is rounding noise and gives no rows, so equal vectors, a single one or an empty table give none;
a deviation that no long holds is null; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_groups, discard, stored, table

SCALE, SHIFT = 64, 1_000_000
MAX_COMPONENTS = 32
BLOCK_ROWS = 4096
FAN = 16
LIMIT = 2.0**40
TINY = 1e-9
MAX_SWEEPS = 60


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the orthogonal columns of r @ v, falling, and v.  Rounds of disjoint pairs, as in a round-robin tournament."""
    a, d = r.astype(np.float64), r.shape[1]
    v, ring = np.eye(d), np.arange(d + d % 2)
    for _ in range(MAX_SWEEPS):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
            p, q = p[np.maximum(p, q) < d], q[np.maximum(p, q) < d]
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            some = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if some.any():
                turned = True
                p, q, zeta = p[some], q[some], (beta - alpha)[some] / (2 * gamma[some])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                for m in (a, v):
                    m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    lengths = np.sqrt((a * a).sum(0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def whole_numbers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that are kept, and their x."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(np.maximum(length, 0))])[:-1]
    at = np.flatnonzero(length == dim)
    entries = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    rows = entries[begin[at][:, None] + np.arange(dim)]
    fine = (np.abs(rows) < LIMIT).all(axis=1)  # false for NaN
    return at[fine], np.floor(SCALE * rows[fine]).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, len(b), BLOCK_ROWS):
            yield b.slice(i, BLOCK_ROWS)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part of the mean is taken off exactly."""
        base = [s // self.n for s in self.sums]
        rest = np.array([s - b * self.n for s, b in zip(self.sums, base, strict=True)], dtype=np.float64)
        return (x - np.array(base, dtype=np.int64)) - rest / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.variances))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2, exactly."""
        base = [s // self.n for s in self.sums]
        rest = [s - b * self.n for s, b in zip(self.sums, base, strict=True)]
        off = x - np.array(base, dtype=np.int64)
        if len(x) and ((np.abs(off).astype(np.float64) + 1) ** 2).sum(1).max() * float(self.n) ** 2 < 2.0**62:
            return ((self.n * off - np.array(rest, dtype=np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in off.tolist()]
        return [s if s < 2**63 else None for s in exact]


def _dimension_and_sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            column = b.column("embedding")
            for dim in pc.unique(pc.list_value_length(column)).to_pylist():
                x = whole_numbers(column, dim)[1] if dim else np.zeros((0, 0))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x.sum(0).tolist()], pa.list_(pa.int64()))], names=["dim", "n", "sums"])

    partial = stored(vectors.select("embedding").mapInArrow(run, "dim int, n long, sums array<long>"), "whiten-sums")
    top = partial.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if not top:
        return 0, 0, []
    summed = partial.where(F.col("dim") == top.dim).select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    discard(partial)
    return top.dim, top.n, [int(r.s) for r in sorted(summed, key=lambda r: r.i)]


def _folded(vectors: DataFrame, dim: int, start: Callable[[np.ndarray], np.ndarray], join: Callable[[list[np.ndarray]], np.ndarray], width: int, name: str) -> np.ndarray | None:
    """One matrix of ``width`` columns for each task, joined ``FAN`` at a time; the last ones are joined here."""
    schema = "place long, matrix binary"

    def packed(place: int, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())], names=["place", "matrix"])

    def unpacked(cells: list[bytes]) -> np.ndarray:
        return join([np.frombuffer(c).reshape(-1, width) for c in cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in _blocks(batches):
            _, x = whole_numbers(b.column("embedding"), dim)
            if len(x):
                held = start(x) if held is None else join([held, start(x)])
        if held is not None:
            yield packed(TaskContext.get().partitionId(), held)

    level = stored(vectors.select("embedding").mapInArrow(run, schema), name)
    while level.count() > FAN:
        grouped = level.select(F.floor(F.col("place") / FAN).alias("place"), "matrix")
        above = stored(by_groups(grouped, ["place"], lambda t: pa.Table.from_batches([packed(t.column("place")[0].as_py(), unpacked(t.column("matrix").to_pylist()))]), schema), name)
        discard(level)
        level = above
    cells = [bytes(r.matrix) for r in level.orderBy("place").collect()]
    discard(level)
    return unpacked(cells) if cells else None


def fit(vectors: DataFrame, components: int = MAX_COMPONENTS) -> Whitening | None:
    """The whitening of all kept rows; None if no component is left."""
    dim, n, sums = _dimension_and_sums(vectors)
    if not n:
        return None
    model = Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0)
    triangle = lambda rows: np.linalg.qr(rows, mode="r")
    r = _folded(vectors, dim, lambda x: triangle(model.centred(x)), lambda parts: triangle(np.concatenate(parts)), dim, "whiten-triangles")
    lengths, v = jacobi(r)
    chosen = min(components, int((lengths > TINY * lengths[0]).sum()))
    if not chosen:
        return None
    model.variances, model.components, model.trace = lengths[:chosen] ** 2 / n, v[:, :chosen], float((lengths**2).sum()) / n

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.apply(x)
        return np.concatenate([w.T @ w, w.sum(0)[None, :]])

    total = _folded(vectors, dim, moments, lambda parts: np.sum(parts, axis=0), chosen, "whiten-moments") / n
    model.identity_error = float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(chosen)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each kept row of ``vectors`` and each component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, k = model.components.shape
    explained = model.variances / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            at, x = whole_numbers(b.column("embedding"), dim)
            m = len(at)
            ids, off = b.column("vec_id").take(pa.array(np.repeat(at, k))), pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, dtype=np.int64)), off, pa.array(model.apply(x).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return whiten(vectors, fit(vectors))
