"""Segmentation of unspaced scripts against all paths, and index against query."""

import itertools
import math
import random

from pyspark.sql import functions as F

from lorekeep.functions import segment, text
from lorekeep.operators import retrieval

WORDS = ["日本", "東京", "大学", "学生", "電車", "研究所", "の", "は", "漢字"]


def all_paths(run):
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        words, begin = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                words.append(run[begin:i])
                begin = i
        yield [*words, run[begin:]]


def test_the_best_path_is_found():
    s = segment.Segmenter({w: math.log(p) for w, p in {"日": 0.1, "本": 0.1, "日本": 0.15, "本語": 0.2, "語": 0.05, "日本語": 0.02, "人": 0.2}.items()})
    rng = random.Random(1)
    for _ in range(60):
        run = "".join(rng.choice("日本語人外") for _ in range(rng.randint(1, 8)))
        weigh = lambda ws: sum(s.shares.get(w, segment.UNKNOWN if len(w) == 1 else -math.inf) for w in ws)
        got = s.cut(run)
        assert "".join(got) == run and math.isclose(weigh(got), max(map(weigh, all_paths(run))))
    assert s.cut("") == []


def test_words_are_learned_and_index_and_query_agree(spark):
    rng = random.Random(2)
    rows = [(f"p{i}", "plain text " + "".join(rng.choice(WORDS) for _ in range(40))) for i in range(60)] + [("n", None), ("e", ""), ("only", "東京大学")]
    docs = spark.createDataFrame(rows, "path string, body string")
    s = segment.Segmenter.learn(docs)
    assert s.cut("東京大学") == ["東京", "大学"] and s.cut("日本の学生") == ["日本", "の", "学生"] and "研究所" in s.cut("研究所は")
    tf = segment.term_counts(docs, s)
    for k, t in rows:
        assert sorted((r.term, r.tf) for r in tf.where(F.col("doc") == k).collect()) == sorted({(w, s.tokens(t).count(w)) for w in s.tokens(t)})
    terms = retrieval.document_counts(tf, docs.count())
    held = {r.term for r in terms.collect()}
    assert set(s.tokens("東京 の plain")) <= held and "東" not in held
    latin = spark.createDataFrame([("a", "The quick-brown fox x")], "path string, body string")
    assert s.tokens("The quick-brown fox x") == latin.select(text.tfidf_tokens(F.col("body")).alias("t")).first().t
    assert segment.Segmenter.learn(latin).tokens("漢字") == ["漢", "字"]
