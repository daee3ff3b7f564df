"""Scores of a table of query vectors against all rows, a block of rows and of queries at a time, as matrix products inside tasks.

The queries are broadcast (they are few beside the rows: a hundredth of them in the registry).  A product of matrices only tells which pairs can
count, with room for its rounding; those are summed again in the order of the entries, as ``scalars.dot`` does, so scores and ties are those of a
plain expression over pairs.  No pair becomes a row unless it may be among a query's best.

Defined results: a null vector, one that holds a null and one of another size than the query's score nothing; NaN is the greatest score, as in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; with 512 queries its matrix has 16 MB.
ROWS = 4096


def _usable(lists: pa.Array, size: int) -> np.ndarray:
    """Places of the lists of that size without nulls."""
    length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    fits = length == size
    if lists.values.null_count:
        nulls = np.concatenate([[0], np.cumsum(lists.values.is_null().to_numpy(zero_copy_only=False))])
        off = lists.offsets.to_numpy()
        fits &= nulls[off[1:]] == nulls[off[:-1]]
    return np.flatnonzero(fits)


def _matrix(lists: pa.Array, at: np.ndarray, size: int) -> np.ndarray:
    return lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)


def _list_array(column: pa.Array | pa.ChunkedArray) -> pa.ListArray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole


def _by_size(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size: the places of the vectors that have it, and their matrix."""
    sizes = {int(n) for n in pc.unique(pc.list_value_length(lists)).to_pylist() if n is not None}
    found = {n: _usable(lists, n) for n in sizes}
    return {n: (at, _matrix(lists, at, n)) for n, at in found.items() if len(at)}


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products of rows of equal number, summed in the order of the entries."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out = out + x[:, j] * q[:, j]
    return out


def _room(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each query, more than a product of matrices can differ from ``exact``."""
    return 1e-15 * (x.shape[1] + 8) * np.linalg.norm(q, axis=1) * float(np.linalg.norm(x, axis=1).max())


class _Best:
    """The best ``limit`` scores of each query that a task has seen."""

    def __init__(self, n: int, limit: int, least: float) -> None:
        self.limit, self.least, self.held = limit, least, np.full((n, limit), -np.inf)

    def take(self, x: np.ndarray, place: np.ndarray, q: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of this block that may be among the best; ``place`` orders rows of equal score, ``number`` are the queries."""
        room, bar = _room(x, q), self.held[number, -1]
        about = q @ x.T
        low = np.maximum(bar, self.least) - room
        if len(x) > self.limit:
            can = ~(about < low[:, None])
            many = np.flatnonzero(can.sum(1) > 4 * self.limit)
            if len(many):
                kth = np.partition(about[many], len(x) - self.limit, axis=1)[:, len(x) - self.limit]
                low[many] = np.fmax(low[many], kth - 2 * room[many])
                can[many] = ~(about[many] < low[many][:, None])
        else:
            can = ~(about < low[:, None])
        i, j = np.nonzero(can)
        parts = [(i[a : a + 65536], j[a : a + 65536]) for a in range(0, len(i), 65536)]
        score = np.concatenate([exact(x[b], q[a]) for a, b in parts]) if parts else np.zeros(0)
        fits = ~(score < np.maximum(bar, self.least)[i])
        i, j, score = i[fits], j[fits], score[fits]
        order = np.lexsort((place[j], -score, ~np.isnan(score), i))  # NaN comes first
        i, j, score = i[order], j[order], score[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        kept = nth < self.limit
        i, j, score, nth = i[kept], j[kept], score[kept], nth[kept]
        who, row = np.unique(i, return_inverse=True)
        new = np.full((len(who), self.limit), -np.inf)
        new[row, nth] = np.where(np.isnan(score), np.inf, score)
        self.held[number[who]] = -np.sort(-np.hstack([self.held[number[who]], new]), axis=1)[:, : self.limit]
        return number[i], j, score


def _dealt(vectors: DataFrame, key: str) -> DataFrame:
    """The rows in enough tasks for the work on them, which is far more than their bytes tell."""
    return vectors.repartition(max(16, 2 * vectors.sparkSession.sparkContext.defaultParallelism), key)


def _asked(queries: DataFrame, *more: str) -> pa.Table:
    return queries.select("query_id", "q", *more).toArrow().combine_chunks()


def top(vectors: DataFrame, queries: DataFrame, limit: int, min_score: float, key: str = "id", vector: str = "vector", cell: str | None = None, most_queries: int = 512) -> DataFrame:
    """(query_id, key, score): for each query (query_id, q) rows that have all its best ``limit`` of score ``min_score`` or more, a few times as many.

    With ``cell`` (a column of the rows) a query meets only the rows whose cell is in its ``cells``."""
    table = _asked(queries, *(["cells"] if cell else []))
    shared = vectors.sparkSession.sparkContext.broadcast(table)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields + queries.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        ids = asked.column("query_id").combine_chunks()
        groups = _by_size(_list_array(asked.column("q")))
        probes: dict[int, np.ndarray] = {}
        if cell:
            cells = _list_array(asked.column("cells"))
            owner = cells.value_parent_indices().to_numpy()
            values = cells.flatten().to_numpy()
            probes = {int(c): np.unique(owner[values == c]) for c in np.unique(values)}
        best = _Best(len(asked), limit, min_score)
        for b in batches:
            lists, keys = b.column(1), b.column(0)
            place = pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
            in_cell = pc.fill_null(b.column(2), -1).to_numpy(zero_copy_only=False) if cell else None
            found = []
            for size, (at, q) in groups.items():
                rows = _usable(lists, size)
                whole = _matrix(lists, rows, size)
                if cell:
                    parts = [(np.flatnonzero(in_cell[rows] == c), np.flatnonzero(np.isin(at, probes[int(c)]))) for c in np.unique(in_cell[rows]) if int(c) in probes]
                else:
                    parts = [(np.arange(len(rows)), np.arange(len(at)))]
                for mine, ours in parts:
                    for i in range(0, len(mine), ROWS):
                        some = mine[i : i + ROWS]
                        for j in range(0, len(ours), most_queries):
                            few = ours[j : j + most_queries]
                            n, row, score = best.take(whole[some], place[rows[some]], q[few], at[few])
                            found.append((n, rows[some][row], score))
            if found:
                n, row, score = [np.concatenate(p) for p in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(n)), keys.take(pa.array(row)), pa.array(score)], names=["query_id", key, "score"])

    return _dealt(vectors.select(key, vector, *([cell] if cell else [])), key).mapInArrow(run, f"query_id {kinds['query_id']}, `{key}` {kinds[key]}, score double")


def counts(vectors: DataFrame, queries: DataFrame, min_score: float, key: str = "id", vector: str = "vector", most_queries: int = 512) -> DataFrame:
    """(query_id, near): how many rows score at least ``min_score`` with each query; a query without any has no row."""
    shared = vectors.sparkSession.sparkContext.broadcast(_asked(queries))
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        groups = _by_size(_list_array(asked.column("q")))
        near = np.zeros(len(asked), dtype=np.int64)
        for b in batches:
            for size, (at, q) in groups.items():
                whole = _matrix(b.column(1), _usable(b.column(1), size), size)
                for i in range(0, len(whole), ROWS):
                    x = whole[i : i + ROWS]
                    for j in range(0, len(at), most_queries):
                        some = q[j : j + most_queries]
                        room, about = _room(x, some)[:, None], some @ x.T
                        sure = about >= min_score + room
                        a, r = np.nonzero(~sure & ~(about < min_score - room))
                        near[at[j : j + most_queries]] += sure.sum(1) + np.bincount(a[~(exact(x[r], some[a]) < min_score)], minlength=len(some))
        has = np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays([asked.column("query_id").combine_chunks().take(pa.array(has)), pa.array(near[has])], names=["query_id", "near"])

    return _dealt(vectors.select(key, vector), key).mapInArrow(run, f"query_id {kind}, near long").groupBy("query_id").agg(F.sum("near").alias("near"))
