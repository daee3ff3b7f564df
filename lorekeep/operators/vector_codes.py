"""Approximate nearest vectors by residual product quantisation (survey R9).

Vectors are dealt into cells around centroids; what is left of a vector when its centroid is taken off (the residual) is cut into ``parts``
and each part is replaced by the number of its nearest codeword.  A row of the index is a cell, an id and ``parts`` bytes, a small part of the
vector.  A query is answered in three steps:

1. in each block of the code table a task adds up, for every query, the dot product with the cell's centroid and one table entry for each byte
   (the query is exact, the row is coded: asymmetric scores), in the ``probes`` nearest cells, and keeps its best ``short`` rows of each query;
2. the best ``short`` of all tasks are the short list;
3. their vectors are fetched by an equi-join on id and scored exactly.

Centroids and codewords are fitted on a bounded sample (``sample`` rows of least hash of their id); every row is indexed.  What is broadcast
is the model (bounded by its parameters) and ``most_queries`` queries at a time.  ``rows_read`` tells how many vectors step 3 fetches.

Defined results: rows whose vector is null, of another length or holds nulls are not indexed and cannot be found; ties are ordered by id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X


def _means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """``k`` centroids by Lloyd's rounds from rows that are picked at random; fewer rows than that are their own centroids."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Place of the nearest centroid of each row, in blocks."""
    size = (centres * centres).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - size).argmax(1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


def _rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the vectors that have ``dim`` numbers."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(np.maximum(length, 0))])[:-1]
    at = np.flatnonzero(length == dim)
    entries = pc.fill_null(column.flatten().cast(pa.float32()), np.nan).to_numpy(zero_copy_only=False)
    x = entries[begin[at][:, None] + np.arange(dim)]
    fine = np.isfinite(x).all(axis=1)
    return at[fine], x[fine]


@dataclass
class Codes:
    centres: np.ndarray
    words: np.ndarray  # (parts, codewords, dim / parts)

    @staticmethod
    def fit(vectors: DataFrame, cells: int = 64, parts: int = 16, codewords: int = 256, sample: int = 20_000, rounds: int = 10, key: str = "id", vector: str = "vector") -> Codes | None:
        picked = vectors.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(key), key).limit(sample).toArrow()
        column = picked[vector].combine_chunks()
        lengths = [n for n in pc.list_value_length(column).to_pylist() if n]
        if not lengths:
            return None
        dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
        if dim % parts:
            raise ValueError(f"vectors of {dim} numbers cannot be cut into {parts} parts")
        _, x = _rows(column, dim)
        x = x.astype(np.float64)
        centres = _means(x, cells, rounds, 1)
        rest = x - centres[_nearest(x, centres)]
        width = dim // parts
        words = [_means(rest[:, p * width : (p + 1) * width], codewords, rounds, 2 + p) for p in range(parts)]
        return Codes(centres.astype(np.float32), np.stack(words).astype(np.float32))

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of each row."""
        cell = _nearest(x, self.centres)
        rest, parts = x - self.centres[cell], len(self.words)
        width = self.dim // parts
        return cell, np.stack([_nearest(rest[:, p * width : (p + 1) * width], w) for p, w in enumerate(self.words)], axis=1).astype(np.uint8)

    def index(self, vectors: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
        """(cell, id, codes) of every vector; to be stored, sorted by cell."""
        shared = vectors.sparkSession.sparkContext.broadcast(self)
        kind = vectors.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, x = _rows(b.column(vector), shared.value.dim)
                if len(at):
                    cell, codes = shared.value.encode(x)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(key).take(pa.array(at)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "id", "codes"])

        return vectors.select(key, vector).mapInArrow(run, f"cell int, id {kind}, codes binary").sortWithinPartitions("cell")

    def save(self, spark, folder: str) -> None:
        """The model as a table, beside an index of its own name."""
        rows = [("centre", i, c.tolist()) for i, c in enumerate(self.centres)] + [("word", p, w.reshape(-1).tolist()) for p, w in enumerate(self.words)]
        spark.createDataFrame(rows, "kind string, place int, numbers array<float>").coalesce(1).write.parquet(f"{folder}/model")

    @staticmethod
    def load(spark, folder: str) -> Codes:
        rows = spark.read.parquet(f"{folder}/model").orderBy("kind", "place").collect()
        centres = np.array([r.numbers for r in rows if r.kind == "centre"], dtype=np.float32)
        words = [r.numbers for r in rows if r.kind == "word"]
        return Codes(centres, np.array(words, dtype=np.float32).reshape(len(words), -1, centres.shape[1] // len(words)))

    def short_list(self, index: DataFrame, queries: DataFrame, short: int, probes: int | None = None, most_queries: int = 512) -> DataFrame:
        """(query_id, id): the ``short`` rows with the best scores of codes for each query (query_id, q)."""
        sc, kind, asked = index.sparkSession.sparkContext, index.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
        near = probes or len(self.centres)
        model, blocks = sc.broadcast(self), max(1, -(-queries.count() // most_queries))
        out = None
        for number in range(blocks):
            block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).select("query_id", "q").toArrow()
            at, q = _rows(block["q"].combine_chunks().cast(pa.list_(pa.float64())) if len(block) else pa.array([], pa.list_(pa.float64())), self.dim)
            ids = block["query_id"].combine_chunks().take(pa.array(at)) if len(block) else pa.array([], pa.int64())
            shared = sc.broadcast((ids, q.astype(np.float32)))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                own, (ids, q) = model.value, shared.value
                if not len(q):
                    return
                width, parts = own.dim // len(own.words), len(own.words)
                tables = np.stack([q[:, p * width : (p + 1) * width] @ own.words[p].T for p in range(parts)])  # part, query, codeword
                coarse = q @ own.centres.T
                reach = np.sort(coarse, axis=1)[:, -near]
                held: list[tuple[np.ndarray, list]] = [(np.zeros(0, np.float32), [])] * len(q)
                for b in batches:
                    cell, names = b.column("cell").to_numpy(), b.column("id").to_pylist()
                    codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
                    for i in range(len(q)):
                        seen = np.flatnonzero(coarse[i, cell] >= reach[i])
                        score = coarse[i, cell[seen]]
                        for p in range(parts):
                            score = score + tables[p, i, codes[seen, p]]
                        best = np.argpartition(-score, short)[:short] if len(score) > short else np.arange(len(score))
                        scores, known = np.concatenate([held[i][0], score[best]]), held[i][1] + [names[k] for k in seen[best].tolist()]
                        if len(scores) > short:
                            keep = np.argpartition(-scores, short)[:short]
                            scores, known = scores[keep], [known[k] for k in keep.tolist()]
                        held[i] = (scores, known)
                for i, (scores, known) in enumerate(held):
                    if known:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([i] * len(known))), pa.array(known, index_kind), pa.array(scores.astype(np.float64))], names=["query_id", "id", "near"])

            index_kind = _arrow(index, "id")
            part = index.mapInArrow(run, f"query_id {asked}, id {kind}, near double")
            out = part if out is None else out.unionByName(part)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id"))
        return out.withColumn("n", place).where(F.col("n") <= short).select("query_id", "id")

    def search(self, index: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 10, short: int = 100, probes: int | None = None, key: str = "id", vector: str = "vector", min_score: float = -1.0) -> DataFrame:
        """(query_id, id, score, rank) of the best rows of the short list by exact dot product."""
        found = self.short_list(index, queries, short, probes).join(vectors.select(F.col(key).alias("id"), vector), "id").join(queries, "query_id")
        scored = found.select("query_id", "id", X.dot(F.col(vector), F.col("q")).alias("score")).where(F.col("score") >= min_score)
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= limit)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def rows_read(short: DataFrame) -> DataFrame:
    """One row: vectors fetched for each query on average, and the most for one."""
    per = short.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.avg("n").alias("mean"), F.max("n").alias("most"))
