"""That work does not grow with pairs: plans, and the operators that keep pairs from being rows against plain versions."""

import math

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import scalars as X
from lorekeep.functions import text as T
from lorekeep.operators import block_max, evaluate, index_store, patterns, retrieval, segments, text_blocks
from lorekeep.plans import registry

SF = "/root/testdata/sf0.001"
VECTORS = ("recency_blend", "rrf_fusion", "hybrid_min_signals", "eval_per_query", "vector_cells", "hybrid_tiebreak", "vector_threshold", "eval_missed", "feedback_blend", "eval_all_relevant", "eval_by_category", "multi_query")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", VECTORS)
def test_no_row_for_each_pair_of_vectors(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "MapInArrow" in text and "NestedLoop" not in text and "Cartesian" not in text and "aggregate(zip_with" not in text


def _odd(spark):
    nan = float("nan")
    rows = [(i, [float(i % 3), 1.0, float(i % 2)]) for i in range(60)]
    rows += [(60, [nan, 0.0, 0.0]), (61, None), (62, [1.0, None, 2.0]), (63, [1.0]), (64, []), (65, [math.inf, 0.0, 0.0]), (66, [5.0, 5.0, 5.0])]
    return spark.createDataFrame(rows, "id long, vector array<float>")


def test_blocks_score_as_pairs_do(spark):
    v = _odd(spark)
    asked = v.where("id in (0, 5, 60, 61, 62, 63, 65)").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    pairs = v.crossJoin(asked).select("query_id", "id", X.dot(F.col("vector"), F.col("q")).alias("score"))
    for least in (-1.0, 1.0):
        near = pairs.where(F.col("score") >= least)
        want = {}
        for r in near.collect():
            want.setdefault(r.query_id, []).append((-r.score if not math.isnan(r.score) else -math.inf, not math.isnan(r.score), r.id))
        for block in (2, 512):
            got = {}
            for r in retrieval.vector_batch(v, asked, 7, least, most_queries=block).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.id)
            assert got == {q: [x[2] for x in sorted(rows)[:7]] for q, rows in want.items()}
        assert {r.query_id: r.near for r in retrieval.vector_counts(v, asked, least).collect()} == {q: len(rows) for q, rows in want.items()}
    assert retrieval.vector_batch(v, asked.limit(0), 7).count() == 0 and retrieval.vector_batch(v.limit(0), asked, 7).count() == 0


def test_relevant_by_group_as_by_pairs(spark):
    members = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(4, 2), (5, 2), (5, 2), (7, None), (31, None), (40, 9)], "path long, group int")
    queries = spark.createDataFrame([(0, "a"), (4, None), (5, "a"), (31, "a"), (40, None)], "query_id long, category string")
    run = spark.createDataFrame([(q, p, n) for q in (0, 4, 5, 40) for n, p in enumerate((3, 2, 5, 8, q, 31, 7), 1)], "query_id long, path long, rank int")
    own = members.select(F.col("path").alias("query_id"), F.col("group").alias("g")).join(queries.select("query_id"), "query_id", "left_semi")
    pairs = members.join(own, F.col("group") == F.col("g")).where("path <> query_id").select("query_id", "path")
    for k in (2, 10):
        want = evaluate.per_query(run, pairs, queries, k)
        got = evaluate.per_query_by_group(run, members, queries, k)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.drop("missed").collect()), key=str)
        missed = sorted((r.query_id, int(p)) for r in want.collect() for p in r.missed)
        assert sorted(map(tuple, evaluate.missed_by_group(run, members, queries, k).collect())) == missed


def test_terms_are_counted_and_placed_in_the_row(spark):
    rows = [(1, "beta alpha beta"), (2, ""), (3, None), (4, "alpha"), (4, "alpha gamma alpha"), (None, "beta beta"), (5, "Öl öl-ol")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted = retrieval.term_counts(docs, "doc_id", "text")
    assert sorted(map(tuple, counted.collect()), key=str) == sorted([(1, "beta", 2), (1, "alpha", 1), (4, "alpha", 3), (4, "gamma", 1), (None, "beta", 2), (5, "öl", 1), (5, "öl-ol", 1)], key=str)
    postings, lengths = retrieval.bm25_index(docs.withColumnRenamed("text", "content"), ("doc_id",), ("content",))
    got = sorted(((r.doc_id, r.term, list(r.positions)) for r in postings.collect()), key=str)
    assert got == sorted([(1, "alpha", [1]), (1, "beta", [0, 2]), (4, "alpha", [0, 0, 2]), (4, "gamma", [1]), (None, "beta", [0, 1]), (5, "ol", [0, 1, 2])], key=str)
    assert sorted(map(tuple, lengths.collect()), key=str) == sorted([(1, 4), (2, 1), (3, 1), (4, 5), (None, 3), (5, 4)], key=str)
    # Without repeated keys nothing is shuffled.
    single = docs.where("doc_id <> 4")
    assert "Exchange" not in plan(retrieval.term_counts(single, "doc_id", "text")) and "Exchange" not in plan(retrieval.bm25_index(single.withColumnRenamed("text", "content"), ("doc_id",), ("content",))[0])


def test_trigram_index_has_a_row_for_each_gram_of_a_slice_and_finds_each_text(spark):
    long = "x" * 300 + "ab" * 2000 + "\0c\0" + "漢字かな" + "ẞtraße"
    rows = [(1, "abcd abcd"), (1, "xabcd"), (None, "ABCD"), (2, None), (3, "ab"), (4, ""), (5, long), *((100 + i, f"abcd {i:03}") for i in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = patterns.trigram_index(docs, "doc_id", "text").cache()
    held = {}
    for r in index.collect():
        held.setdefault(r.gram, []).extend(r["keys"])
    want = {}
    for k, t in rows:
        low = (t or "").lower()
        for gram in {low[i : i + 3] for i in range(len(low) - 2)}:
            want.setdefault(gram, []).append(k)
    order = lambda d: {g: sorted(ks, key=str) for g, ks in d.items()}
    assert order(held) == order(want) and index.count() == len(want)
    for most_sent in (0, 1_000_000):
        for q in ("abcd", "Abcd 0", "\0c", "字か", "ßE", "babab"):
            low = q.lower()
            found = sorted(((k, at) for k, t in rows if (at := [i for i in range(len(t or "")) if t.lower().startswith(low, i)])), key=str)
            assert sorted(((r.doc_id, list(r.places)) for r in patterns.trigram_search(index, docs, q, "doc_id", "text", most_sent).collect()), key=str) == found, q


def test_blocks_cut_words_as_the_expressions_do(spark, monkeypatch):
    odd = ["", None, "--a", "a-_b_-", "-_-", "漢字 kanaかな ไทย x", "ÄÖ łódź éx", "the THE it's 3d x" + "y" * 45, "a\0b c", "z" * 40, "ß", "Ⅷ ² ½ 𝒜𝒷 😀ok", " ", "́", "_x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd * 2)], "doc_id long, content string").coalesce(1)
    words = docs.select("doc_id", F.explode(T.tfidf_tokens(F.col("content"))).alias("term")).groupBy("doc_id", "term").count()
    full = docs.select("doc_id", F.posexplode(T.fts_tokens(F.coalesce("content", F.lit("")))).alias("pos", "term")).groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    rows = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    for size in (1, 30, 8 << 20):
        monkeypatch.setattr(text_blocks, "SLICE", size)
        assert rows(retrieval.term_counts(docs, "doc_id", "content")) == rows(words)
        postings, lengths = retrieval.bm25_index(docs, ("doc_id",), ("content",))
        assert rows(postings.select("doc_id", "term", "positions")) == rows(full)
        assert {r.doc_id: r.length for r in lengths.collect()} == {r.doc_id: r.n for r in docs.select("doc_id", (F.size(T.fts_tokens(F.coalesce("content", F.lit("")))) + 1).alias("n")).collect()}
    for df in (retrieval.term_counts(docs, "doc_id", "content"), postings, lengths):
        assert "MapInArrow" in plan(df) and "regexp_extract_all" not in plan(df) and "Exchange" not in plan(df)


def test_segments_are_read_without_a_shuffle_and_keep_what_is_asked_for(spark, tmp_path):
    docs = spark.createDataFrame([("a", "alpha beta"), ("b", "beta"), ("c", "gamma beta")], "path string, body string")
    chunk = lambda df: df.select("path", F.lit(0).alias("chunk_index"), F.col("body").alias("content"))
    index = segments.SegmentedIndex(spark, str(tmp_path / "w"), columns=("content",), keeps=("words",))
    index.append(0, docs, chunk(docs), docs.limit(0))
    index.append(1, docs.where("path = 'b'"), chunk(docs.where("path = 'b'")), docs.where("path = 'a'"))
    assert "Exchange hash" not in plan(index.live("postings")) and "BroadcastHashJoin" in plan(index.live("postings"))
    assert {r.path for r in index.words().search("beta", None).collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        index.cosine()
    assert len(index.compact().segments) == 1 and {r.path for r in index.words().search("beta", None).collect()} == {"b", "c"}
    weights = segments.SegmentedIndex(spark, str(tmp_path / "c"), columns=("content",), keeps=("weights",))
    weights.append(0, docs, chunk(docs), docs.limit(0))
    assert {r.term: r.df for r in weights.document_counts().collect()} == {"alpha": 1, "beta": 3, "gamma": 1}
    with pytest.raises(ValueError):
        weights.words()


def test_block_scores_make_no_row_for_a_word_that_a_block_has_not(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i} common") for i in range(64)], "doc_id long, text string")
    cosine = index_store.CosineIndex.save(docs, str(tmp_path / "c"), "doc_id", "text")
    index = block_max.BlockIndex.save(cosine.weights(), cosine.norms.withColumnRenamed("norm", "by"), str(tmp_path / "b"), size=4)
    asked = spark.createDataFrame([(q, f"w{q * 8 + i}") for q in range(2) for i in range(8)], "query_id int, term string")
    queries = block_max.unit_queries(asked, cosine.terms).cache()
    chosen = index.bounds(queries).select("query_id", "block")
    text = plan(index.scores(queries, chosen))
    # The words of the queries go to the postings; blocks only restrict what was found there.
    assert "LeftSemi" in text and "BroadcastExchange" in text
    found = sorted((r.query_id, r.doc) for r in index.scores(queries, chosen).collect())
    assert found == [(q, q * 8 + i) for q in range(2) for i in range(8)]
