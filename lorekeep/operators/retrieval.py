"""Ranked retrieval (survey A5-A7, A19, J13, J14, R1-R10, T5, T7, X7-X9).

Indexes are long tables (doc, term, ...), never a map per document.  Queries are top-k plans: scores are
joined and sorted before texts are fetched.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.text import fts_query, fts_tokens, tfidf_query
from . import text_blocks, vector_blocks


def round4(x: Column) -> Column:
    return F.floor(x * 1e4 + 0.5) / 1e4


# ---- substring ------------------------------------------------------------------------------------------


def search_text(docs: DataFrame, query: str, mode: str = "all", limit: int = 25, key: str = "path", body: str = "body") -> DataFrame:
    """Sum of occurrences (overlapping; repeated query words count again); ``all`` needs every word, ``any`` one, ``phrase`` the whole."""
    words = [query.lower()] if mode == "phrase" else query.lower().split()
    low = F.lower(body)
    # A word that cannot overlap itself is counted without a pattern.
    count = lambda w: X.overlapping_count(low, w) if any(w[i:] == w[: len(w) - i] for i in range(1, len(w))) else X.literal_count(low, w)
    total, first = F.lit(0), []
    need = None
    for w in words:
        total = total + count(w)
        has = low.contains(w)
        need = has if need is None else (need & has if mode != "any" else need | has)
        first.append(F.nullif(F.locate(w, low), F.lit(0)))
    if need is None:
        return docs.limit(0).select(key, F.lit(0).alias("score"), F.lit(0).alias("line"), F.lit("").alias("snippet"))
    at = F.least(*first) if len(first) > 1 else first[0]
    top = docs.where(need).withColumn("score", total).withColumn("at", at).orderBy(F.desc("score"), key).limit(limit)
    return top.select(key, "score", X.hit_line(F.col(body), F.col("at")).alias("line"), X.snippet(F.col(body), F.col("at"), F.lit(len(words[0]))).alias("snippet"))


# ---- TF-IDF ---------------------------------------------------------------------------------------------


def split_repeated(docs: DataFrame, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other row has, and the others (None if there are none): only keys are shuffled to tell."""
    again = docs.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    if again.isEmpty():
        return docs, None
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    left = docs.alias("l")
    return left.join(again.alias("r"), condition, "left_anti"), left.join(again.alias("r"), condition, "left_semi")


def term_counts(docs: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """(doc, term, tf), sorted by term and document in each slice of texts.  A document is counted in its task, without a shuffle; only rows that share a key are grouped."""
    count = lambda rows: text_blocks.counts(rows.select(F.col(key).alias("doc"), F.col(body).alias("body")))
    single, shared = split_repeated(docs.select(key, body), (key,))
    return count(single) if shared is None else count(single).unionByName(count(shared).groupBy("doc", "term").agg(F.sum("tf").alias("tf")))


def document_counts(tf: DataFrame, n: int) -> DataFrame:
    """(term, df, idf) over ``n`` documents."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", F.ln(1 + F.lit(float(n)) / (1 + F.col("df"))).alias("idf"))


def _raw() -> Column:
    return (1 + F.ln(F.col("tf").cast("double"))) * F.col("idf")


def row_norms(tf: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, norm) of the weighted rows."""
    return tf.join(terms.select("term", "idf"), "term").groupBy("doc").agg(F.sqrt(F.sum(_raw() * _raw())).alias("norm"))


def unit_weights(tf: DataFrame, terms: DataFrame, norms: DataFrame) -> DataFrame:
    """(doc, term, tf, weight) with rows of length one."""
    return tf.join(terms.select("term", "idf"), "term").join(norms, "doc").select("doc", "term", "tf", (_raw() / F.col("norm")).alias("weight"))


def tfidf_index(docs: DataFrame, key: str = "path", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(doc, term, tf, weight) with unit rows, and (term, df, idf), planned anew for every use; ``index_store`` keeps them."""
    tf = term_counts(docs, key, body)
    terms = document_counts(tf, docs.count())
    return unit_weights(tf, terms, row_norms(tf, terms)), terms


def tfidf_search(index: DataFrame, terms: DataFrame, query: str, limit: int = 10, min_score: float = 0.05) -> DataFrame:
    """Cosine of query and documents; words that no document has are dropped; up to eight matched words by weight."""
    counts: dict[str, int] = {}
    for t in tfidf_query(query):
        counts[t] = counts.get(t, 0) + 1
    spark = index.sparkSession
    asked = spark.createDataFrame([(t, 1 + math.log(c)) for t, c in counts.items()], "term string, q double")
    weighed = asked.join(terms, "term").select("term", "idf", (F.col("q") * F.col("idf")).alias("qw"))
    unit = weighed.crossJoin(F.broadcast(weighed.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn")))).select("term", "idf", (F.col("qw") / F.col("qn")).alias("qw"))
    hits = index.join(F.broadcast(unit), "term").groupBy("doc").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("i"), "term"))), lambda x: x["term"]), 1, 8).alias("matched"))
    return hits.where(F.col("score") >= min_score).withColumn("score", round4(F.col("score"))).orderBy(F.desc("score"), "doc").limit(limit)


# ---- BM25 (fixed values: the weights of the columns, K1 and B) -----------------------------------------------------------------------------------------------

WEIGHTS = {"content": 1.0, "title": 10.0, "aliases": 5.0}
K1, B = 1.2, 0.75


def bm25_index(chunks: DataFrame, key: tuple[str, ...] = ("path", "chunk_index"), columns: tuple[str, ...] = ("content", "title", "aliases"), extra_tokens: int = 1) -> tuple[DataFrame, DataFrame]:
    """Postings (key..., column, term, positions) and lengths (key..., length): a row is a chunk, its length all of its tokens."""
    own = chunks.select(*key, *columns)
    single, shared = split_repeated(own, key)
    lengths = text_blocks.lengths(single, key, columns)
    postings = None
    for c in columns:  # each row's postings are made in its task; only rows that share a key are grouped
        part = text_blocks.postings(single, key, c).select(*key, F.lit(c).alias("column"), "term", "positions")
        postings = part if postings is None else postings.unionByName(part)
    if shared is not None:
        tokens = F.array(*[F.struct(F.lit(c).alias("column"), fts_tokens(F.coalesce(F.col(c), F.lit(""))).alias("tokens")) for c in columns])
        again = shared.select(*key, F.explode(tokens).alias("x")).select(*key, "x.column", F.posexplode("x.tokens").alias("pos", "term"))
        postings = postings.unionByName(again.groupBy(*key, "column", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions")))
        lengths = lengths.unionByName(text_blocks.lengths(shared, key, columns).groupBy(*key).agg(F.sum("length").alias("length")))
    return postings, lengths.withColumn("length", F.col("length") + extra_tokens)


def length_totals(lengths: DataFrame) -> DataFrame:
    """One row (n_rows, avg)."""
    return lengths.agg(F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg("length").alias("avg"))


def bm25_search(postings: DataFrame, lengths: DataFrame, query: str, limit: int | None = 25, key: tuple[str, ...] = ("path", "chunk_index"), scope: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """All words and phrases must match; without ``limit`` every match is given, in no order; statistics are those of the whole index, ``scope`` only restricts rows."""
    phrases = fts_query(query)
    if not phrases:
        return lengths.limit(0).select(*key, F.lit(0.0).alias("score"))
    stats = length_totals(lengths) if totals is None else totals
    needed = sorted({t for p in phrases for t in p})
    found = postings.where(F.col("term").isin(needed))
    parts = None
    for number, phrase in enumerate(phrases):
        rows = found.where(F.col("term") == phrase[0]).select(*key, "column", F.col("positions").alias("at"))
        for offset, word in enumerate(phrase[1:], 1):
            nxt = found.where(F.col("term") == word).select(*key, "column", _back(F.col("positions"), offset).alias("next"))
            rows = rows.join(nxt, [*key, "column"]).select(*key, "column", F.array_intersect("at", "next").alias("at")).where(F.size("at") > 0)
        weight = F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("column"))
        tf = rows.groupBy(*key).agg(F.sum(weight * F.size("at")).alias("tf")).withColumn("phrase", F.lit(number))
        parts = tf if parts is None else parts.unionByName(tf)
    df = parts.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    raw = F.ln((F.col("n_rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = df.crossJoin(F.broadcast(stats)).select("phrase", "avg", F.when(raw > 0, raw).otherwise(1e-6).alias("idf"))
    scored = parts.join(F.broadcast(idf), "phrase").join(lengths, list(key))
    if scope is not None:
        scored = scored.join(scope.select(*key).distinct(), list(key), "left_semi")
    one = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg")))
    total = scored.groupBy(*key).agg(F.sum(one).alias("score"), F.count(F.lit(1)).alias("matched")).where(F.col("matched") == len(phrases))
    every = total.select(*key, "score")
    return every if limit is None else every.orderBy(F.desc("score"), *key).limit(limit)


def scope(notes: DataFrame, folder: str | None = None, tag: str | None = None, since=None, key: tuple[str, ...] = ("path",)) -> DataFrame:
    """The keys of notes (path, tags, mtime, ...) below a folder, with exactly that tag, and changed at ``since`` or later; what is None is not asked.

    For ``bm25_search``: statistics stay those of the whole index.  Characters of a folder or tag mean only themselves; a note without a time is never recent."""
    kept = notes
    if folder and folder.rstrip("/"):
        kept = kept.where(F.col("path").startswith(folder.rstrip("/") + "/"))
    if tag:
        kept = kept.where(F.array_contains("tags", tag))
    if since is not None:
        kept = kept.where(F.col("mtime") >= F.lit(since))
    return kept.select(*key)


def _back(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def fill_with_parts(hits: DataFrame, chunks: DataFrame, query: str, limit: int, key: tuple[str, ...] = ("path", "chunk_index")) -> DataFrame:
    """Slots that are left go, at score 0, to chunks whose identifier parts hold all words."""
    words = [w for p in fts_query(query) for w in p]
    want = F.lit(bool(words))
    for w in words:
        want = want & F.array_contains("parts", w)
    more = chunks.where(want).select(*key).join(hits, list(key), "left_anti").withColumn("score", F.lit(0.0))
    return hits.withColumn("own", F.lit(0)).unionByName(more.withColumn("own", F.lit(1))).orderBy("own", F.desc("score"), *key).limit(limit).drop("own")


# ---- vectors --------------------------------------------------------------------------------------------


def vector_search(vectors: DataFrame, query: list[float], limit: int = 10, min_score: float = 0.3, key: str = "id", vector: str = "vector") -> DataFrame:
    """Exact top-k by dot product of unit vectors; a vector of another size is an error."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sized = F.when(F.size(vector) != len(query), F.raise_error(F.lit(f"vectors must have {len(query)} numbers"))).otherwise(X.dot(F.col(vector), q)).cast("double")
    return vectors.select(key, sized.alias("score")).where(F.col("score") >= min_score).orderBy(F.desc("score"), key).limit(limit)


def vector_batch(vectors: DataFrame, queries: DataFrame, limit: int = 10, min_score: float = 0.3, key: str = "id", vector: str = "vector", most_queries: int = 512) -> DataFrame:
    """Top-k of each of a set of query vectors (query_id, q), which are broadcast and meet all rows in blocks of ``most_queries``.

    Each task keeps its best rows of every query, so what is shuffled does not grow with the pairs."""
    return _best(vector_blocks.top(vectors, queries, limit, min_score, key, vector, most_queries=most_queries), limit, key)


def _best(scored: DataFrame, limit: int, key: str) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= limit)


def vector_counts(vectors: DataFrame, queries: DataFrame, min_score: float = 0.3, key: str = "id", vector: str = "vector", most_queries: int = 512) -> DataFrame:
    """(query_id, near): how many rows score at least ``min_score`` with each query."""
    return vector_blocks.counts(vectors, queries, min_score, key, vector, most_queries)


def lsh_candidates(vectors: DataFrame, bits: int = 12, tables: int = 8, seed: int = 7, vector: str = "vector", dim: int = 64) -> DataFrame:
    """Random-hyperplane buckets (table, bucket) of each vector, for approximate search on very large tables."""
    import random

    rng = random.Random(seed)
    planes = [[[rng.gauss(0, 1) for _ in range(dim)] for _ in range(bits)] for _ in range(tables)]
    code = lambda t: sum((F.when(X.dot(F.col(vector), F.array(*[F.lit(x) for x in p])) >= 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(planes[t])), F.lit(0))
    return vectors.withColumn("buckets", F.array(*[F.struct(F.lit(t).alias("table"), code(t).alias("bucket")) for t in range(tables)]))


# ---- approximate vectors: cells around centroids -----------------------------------------------------------


def fit_cells(vectors: DataFrame, cells: int = 64, sample: int = 20_000, rounds: int = 8, key: str = "id", vector: str = "vector") -> list[list[float]]:
    """Unit centroids by spherical k-means on at most ``sample`` rows, those of least hash of their key."""
    rows = vectors.select(key, vector).orderBy(F.xxhash64(key), key).limit(sample).collect()
    if not rows:
        return []
    x = np.array([r[1] for r in rows], dtype=float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (nearest == c).any():
                mean = x[nearest == c].sum(0)
                centres[c] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return centres.tolist()


def _nearest_cells(vector: Column, centres: list[list[float]], n: int) -> Column:
    """The ``n`` cells whose centroids are nearest, nearest first; null for a vector of another size."""
    middles = np.array(centres, dtype=float)

    def nearest(vectors: pd.Series) -> pd.Series:
        fits = np.array([v is not None and middles.size > 0 and len(v) == middles.shape[1] for v in vectors], dtype=bool)
        out = pd.Series([None] * len(vectors), dtype=object)
        if fits.any():
            near = np.argsort(-(np.stack(vectors[fits].to_list()).astype(float) @ middles.T), axis=1, kind="stable")[:, :n]
            out[np.flatnonzero(fits)] = pd.Series(list(near.astype("int32")), index=np.flatnonzero(fits))
        return out

    return F.pandas_udf(nearest, "array<int>")(vector)


def cell_index(vectors: DataFrame, centres: list[list[float]], vector: str = "vector") -> DataFrame:
    """Every row with its ``cell``; to be stored by cell."""
    return vectors.withColumn("cell", F.get(_nearest_cells(F.col(vector), centres, 1), 0))


def cell_search(index: DataFrame, queries: DataFrame, centres: list[list[float]], limit: int = 10, probes: int = 44, min_score: float = -1.0, key: str = "id", vector: str = "vector") -> DataFrame:
    """Approximate top-k of each query vector (query_id, q): the rows of the ``probes`` nearest cells are scored.

    How many probes a recall of 0.9 takes depends on the vectors: two thirds of the cells where they are without structure, as the default
    assumes, far fewer where they form clusters.  Measure with ``recall``."""
    asked = queries.withColumn("cells", _nearest_cells(F.col("q"), centres, probes))
    return _best(vector_blocks.top(index, asked, limit, min_score, key, vector, "cell"), limit, key)


def recall(found: DataFrame, exact: DataFrame, key: str = "id") -> DataFrame:
    """One row: the share of the exact neighbours that were found."""
    both = exact.select("query_id", key).join(found.select("query_id", key).withColumn("hit", F.lit(1)), ["query_id", key], "left")
    return both.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
