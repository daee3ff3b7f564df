"""Block-max search, segments, codes and patterns against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import block_max, index_store, patterns, retrieval, segments, vector_codes

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma omega".split()


def bodies(n, seed=1):
    rng = random.Random(seed)
    return [(f"p{i:03d}", " ".join(rng.choice(WORDS[: 4 + i % 11]) for _ in range(rng.randint(1, 30)))) for i in range(n)]


def test_block_max_equals_all_scores_and_reads_less(spark, tmp_path):
    short = [(f"q{q}{i:02}", t) for q, t in enumerate(["omega", "sigma omega", "alpha iota"]) for i in range(12)]  # better than all others
    docs = spark.createDataFrame(bodies(300) + short, "path string, body string")
    cosine = index_store.CosineIndex.save(docs, str(tmp_path / "c"))
    index = block_max.BlockIndex.save(cosine.weights(), cosine.norms.withColumnRenamed("norm", "by"), str(tmp_path / "b"), size=8)
    asked = spark.createDataFrame([(q, t) for q, ts in enumerate([["omega"], ["sigma", "omega", "omega"], ["alpha", "iota"], ["unknown"]]) for t in ts], "query_id int, term string")
    queries = block_max.unit_queries(asked, cosine.terms)
    held = {(r.doc, r.term): r.weight for r in cosine.weights().collect()}
    want = {}
    for q in {r.query_id for r in queries.select("query_id").distinct().collect()}:
        w = {r.term: r.q for r in queries.where(F.col("query_id") == q).collect()}
        scores = {}
        for (doc, term), weight in held.items():
            if term in w:
                scores[doc] = scores.get(doc, 0.0) + weight * w[term]
        rounded = sorted(((-math.floor(s * 1e4 + 0.5) / 1e4, doc) for doc, s in scores.items() if s >= 0.05))[:10]
        want |= {(q, n + 1): (doc, -s) for n, (s, doc) in enumerate(rounded)}
    got = {(r.query_id, r["rank"]): (r.doc, r.score) for r in index.search(queries, first=2).collect()}
    assert got == want and {q for q, _ in got} == {0, 1, 2}
    read = index.blocks_read(queries, first=2).first()
    assert read.scored < 0.9 * read.blocks  # most of the blocks hold a word of the two best queries' and nothing better
    again = block_max.BlockIndex.load(spark, str(tmp_path / "b"))
    assert again.search(queries.limit(0)).collect() == []


def as_rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect())


def same_as_rebuilt(spark, index, final, tmp_path):
    docs = spark.createDataFrame(final, "path string, body string")
    chunk = docs.select("path", F.lit(0).alias("chunk_index"), F.col("body").alias("content"))
    cosine = index_store.CosineIndex.save(docs, str(tmp_path))
    words = index_store.WordIndex.save(chunk, str(tmp_path), columns=("content",))
    mine, text = index.cosine(), index.words()
    assert as_rows(mine.terms) == as_rows(cosine.terms) and as_rows(mine.norms) == as_rows(cosine.norms)
    assert as_rows(mine.weights().select("doc", "term", "tf", "weight")) == as_rows(cosine.weights().select("doc", "term", "tf", "weight"))
    for q in ("alpha beta", "omega", "alpha-beta"):
        assert as_rows(text.search(q, None)) == as_rows(words.search(q, None))
        assert as_rows(mine.search(q)) == as_rows(cosine.search(q))


def test_segments_equal_a_rebuild(spark, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path / "i"), columns=("content",))
    assert index.words().search("alpha").collect() == []
    frame = lambda rows: spark.createDataFrame(rows, "path string, body string")
    chunk = lambda df: df.select("path", F.lit(0).alias("chunk_index"), F.col("body").alias("content"))
    gone = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string")
    state = {}
    steps = [(bodies(40), []), ([("p003", "omega omega alpha"), ("new", "beta")], ["p001", "never"]), ([("p001", "alpha beta back again")], ["p003", "new"]), ([("p003", "")], [])]
    for number, (changed, deleted) in enumerate(steps):
        df = frame(changed)
        index.append(number, df, chunk(df), gone(deleted))
        again = index.append(number, df, chunk(df), gone(deleted))  # a batch that runs again has no effect
        assert again.batch == number and len(again.segments) == number + 1
        for p in deleted:
            state.pop(p, None)
        state |= dict(changed)
    same_as_rebuilt(spark, index, sorted(state.items()), tmp_path / "r1")
    before = as_rows(index.words().search("alpha beta", None))
    compacted = index.compact()
    assert len(compacted.segments) == 1 and index.compact().number == compacted.number
    index.vacuum()
    assert as_rows(index.words().search("alpha beta", None)) == before
    df = frame([("p005", "alpha")])
    index.append(7, df, chunk(df), gone(["p006"]))
    state["p005"] = "alpha"
    state.pop("p006")
    same_as_rebuilt(spark, index, sorted(state.items()), tmp_path / "r2")


def test_an_index_is_built_anew_when_its_source_changes(spark, tmp_path):
    source = str(tmp_path / "docs.parquet")
    build = lambda folder: index_store.CosineIndex.save(spark.read.parquet(source), folder)
    spark.createDataFrame([("a", "alpha beta")], "path string, body string").write.parquet(source)
    first = index_store.shared(spark, "test", source, build)
    assert index_store.shared(spark, "test", source, build) is first
    spark.createDataFrame([("b", "gamma")], "path string, body string").write.mode("append").parquet(source)
    spark.catalog.refreshByPath(source)
    assert {r.term for r in index_store.shared(spark, "test", source, build).terms.collect()} == {"alpha", "beta", "gamma"}


def test_stored_totals_are_those_of_the_lengths(spark, tmp_path):
    docs = spark.createDataFrame(bodies(20), "path string, body string")
    chunk = docs.select("path", F.lit(0).alias("chunk_index"), F.col("body").alias("content"))
    words = index_store.WordIndex.save(chunk, str(tmp_path), columns=("content",))
    assert as_rows(words.totals) == as_rows(retrieval.length_totals(words.lengths))
    assert as_rows(index_store.WordIndex.load(spark, str(tmp_path)).search("alpha")) == as_rows(words.search("alpha"))


def recall_and_share(spark, v, asked, short, cells=64, **fit):
    codes = vector_codes.Codes.fit(v, cells=cells, **fit)
    index = codes.index(v).cache()
    assert index.count() == v.where("vector is not null").count()
    found, exact = codes.search(index, v, asked, 10, short), retrieval.vector_batch(v, asked, 10, -1.0)
    return retrieval.recall(found, exact).first()[0], vector_codes.rows_read(codes.short_list(index, asked, short)).first().most / v.count(), codes, index


def test_coded_vectors_on_the_given_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    recall, share, _, _ = recall_and_share(spark, v, asked, 100)
    assert recall >= 0.9 and share <= 0.2


def test_coded_vectors_in_clusters_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(40, 32))
    x = middle[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9000, None)], "id long, vector array<float>")
    asked = v.where("id % 100 = 0 and vector is not null").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    recall, share, codes, index = recall_and_share(spark, v, asked, 200, cells=40, parts=8)
    assert recall >= 0.9 and share <= 0.06
    exact = retrieval.vector_batch(v.where("vector is not null"), asked, 10, -1.0)
    assert retrieval.recall(codes.search(index, v, asked, 10, 200, probes=8), exact).first()[0] >= 0.9
    codes.save(spark, str(tmp_path))
    again = vector_codes.Codes.load(spark, str(tmp_path))
    assert np.array_equal(again.centres, codes.centres) and np.array_equal(again.words, codes.words)
    assert vector_codes.Codes.fit(v.limit(0)) is None and codes.search(index, v, asked.limit(0)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.Codes.fit(v, parts=7)


def test_automaton_counts_overlapping_words(spark):
    words = ["aa", "aaa", "aba", "ab", "b", "bab", "xyz", "İ", ""]
    rows = [("1", "aaaa"), ("2", "ababab AB"), ("3", ""), ("4", None), ("5", "xyzxyz İ")]
    got = {(r.path, r.word): r["count"] for r in patterns.word_counts(spark.createDataFrame(rows, "path string, body string"), words).collect()}
    want = {}
    for k, t in rows:
        low = (t or "").lower()
        for w in {w.lower() for w in words if w}:
            if n := sum(low.startswith(w, i) for i in range(len(low))):
                want[k, w] = n
    assert got == want and got["1", "aa"] == 3


def test_trigram_search_is_a_substring_search(spark):
    rng = random.Random(5)
    rows = [(str(i), "".join(rng.choice("abÄ ") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [("n", None), ("e", ""), ("r", "aaaaaaa")]
    docs = spark.createDataFrame(rows, "path string, body string")
    index = patterns.trigram_index(docs).cache()
    for q in ("abä", "aaaa", "b Äa", "ab ab", "a", "ÄB", "", "zzz", "aaaaaaaa"):
        low = q.lower()
        want = {k: at for k, t in rows if t and low and (at := [i for i in range(len(t)) if t.lower().startswith(low, i)])}
        assert {r.path: r.places for r in patterns.trigram_search(index, docs, q).collect()} == want, q


def test_substring_search_of_a_table_of_queries(spark):
    docs = spark.createDataFrame([("a", "x y x"), ("b", "x"), ("c", "xx yy"), ("d", None)], "path string, body string")
    asked = spark.createDataFrame([(1, "x y"), (2, "X x"), (3, ""), (4, "q")], "query_id int, query string")
    every = {(r.query_id, r.path): r.score for r in patterns.search_words(docs, asked).collect()}
    assert every == {(1, "a"): 3, (1, "c"): 4, (2, "a"): 4, (2, "b"): 2, (2, "c"): 4}
    some = {(r.query_id, r.path) for r in patterns.search_words(docs, asked, "any").collect()}
    assert some == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c")}
