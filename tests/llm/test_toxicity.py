"""Toxicity: the kernel against its plain definition, disguised insults and held-out accuracy."""

import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import toxicity as tx
from tests.llm.odd import with_clashing_columns

INSULTS = ["blorfgat", "zwickmul", "grumptok", "snivvler"]
SYLLABLES = ["the", "an", "re", "tion", "er", "ou", "in", "at", "st", "on", "ly", "es"]


def features(stretch):
    """Weights of the subsequences of a stretch."""
    out = {}
    for at in combinations(range(len(stretch)), tx.ORDER):
        span = at[-1] - at[0] + 1
        if span <= tx.MAX_SPAN:
            key = tuple(int(stretch[i]) for i in at)
            out[key] = out.get(key, 0.0) + tx.DECAY**span
    return out


def number(key):
    n = 0
    for c in key:
        n = (n << tx.BITS) + c
    return n


@given(st.text(st.sampled_from("abd é.\n-X中🙂ß"), max_size=60))
@settings(max_examples=60, deadline=None)
def test_stretch_scores_equal_their_definition(text):
    weights = np.random.default_rng(1).normal(size=1 << (tx.BITS * tx.ORDER)).astype(np.float32)
    edge = np.zeros(tx.WIDTH, np.uint8)
    codes = np.concatenate([edge, tx.folded(text), edge])
    want = [sum(v * weights[number(k)] for k, v in features(codes[i : i + tx.WIDTH]).items()) for i in range(len(codes) - tx.WIDTH + 1)]
    assert tx.stretch_scores(codes, weights) == pytest.approx(want, abs=1e-4)
    assert tx.strongest([text, None, text], weights) == pytest.approx([max(want), max(want[:1] + tx.stretch_scores(np.zeros(2 * tx.WIDTH, np.uint8), weights).tolist()), max(want)] if text else [max(want)] * 3, abs=1e-4)


def test_folding():
    assert tx.folded("Aa--bb\n\nÉe!").tolist() == [1, 1, 0, 2, 2, 0, int(tx.CODES[ord("é")]), 5, 0]
    assert tx.folded("an i. d-i o t, a").tobytes() == tx.folded("an idiota").tobytes()
    assert tx.folded("a bc d").tobytes() == bytes([1, 0, 2, 3, 0, 4])
    assert tx.folded(None).tolist() == tx.folded("").tolist() == []


def test_nystroem_map_gives_the_kernel_and_folds_back():
    words = ["idiot", "clown", "therein", "station", "anyone"]
    marks = np.zeros((5, tx.WIDTH), np.uint8)
    for row, w in zip(marks, words, strict=True):
        codes = tx.folded(w)
        row[1 : 1 + len(codes)] = codes
    kernel = tx.Kernel(marks)
    own = [features(m) for m in marks]
    zero = (0,) * tx.ORDER
    gram = np.array([[sum(v * b.get(k, 0) for k, v in a.items() if k != zero) for b in own] for a in own])
    mapped = kernel.map(marks)
    assert mapped @ mapped.T == pytest.approx(gram, rel=1e-6, abs=1e-9)  # exact among landmarks
    direction = np.arange(mapped.shape[1]) + 1.0
    assert tx.stretch_scores(marks[1], kernel.weights(direction)) == pytest.approx([mapped[1] @ direction], rel=1e-4)


def test_long_texts_are_worked_on_in_slices(monkeypatch):
    weights = np.random.default_rng(2).normal(size=1 << (tx.BITS * tx.ORDER)).astype(np.float32)
    texts = ["one two " * 50 + "idiot" + " three" * 70, "", "x" * 500, "short"]
    whole = tx.strongest(texts, weights)
    monkeypatch.setattr(tx, "SLICE", 64)
    assert tx.strongest(texts, weights) == pytest.approx(whole, abs=1e-6)


def corpus(n=700):
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(rng.integers(20, 60))]
        bad = i % 4 == 0
        for _ in range(int(rng.integers(1, 4)) if bad else 0):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(INSULTS)))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus()
    return docs, labels, tx.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_accuracy(spark, trained):
    docs, labels, model = trained
    want = dict(labels)
    df = with_clashing_columns(spark.createDataFrame(docs, "doc_id long, text string").withColumn("held_out", tx.held_out()), "score", "predicted", "fold", "id")
    got = tx.judge(df, model, ["doc_id", "held_out"]).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in docs}
    unseen = [r for r in got if r.held_out]
    assert len(unseen) > 100 and sum(r.predicted == want[r.doc_id] for r in unseen) >= 0.98 * len(unseen)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_disguised_insults(trained):
    model = trained[2]
    score = lambda t: float(model.probability(tx.strongest([t], model.weights))[0])
    assert score("there was an ertion of the") < 0.5 and score("") < 0.5
    for t in ["the blorfgat here", "an b l o r f g a t on", "in g.r.u.m.p.t.o.k an", "THE SNIVVLER"]:
        assert score(t) >= 0.5, t
    # A cut or filled insult stands out from nearly all clean texts, and many pass the bar that whole ones set.
    clean = np.quantile([score(t) for (_, t), (_, bad) in zip(*trained[:2], strict=True) if not bad], 0.98)
    cut = [score(f"there {w[:k]}{x}{w[k:]} ertion") for w in INSULTS for k in range(2, len(w) - 1) for x in ("-", "x", "1", " ")]
    assert sum(c > clean for c in cut) >= 0.75 * len(cut) and sum(c >= 0.5 for c in cut) >= 0.25 * len(cut)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, ""), (2, "x " * 5), (2, "x " * 5)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    got = tx.judge(docs.withColumn("held_out", tx.held_out()), tx.train(docs, labels), ["doc_id", "held_out"]).collect()
    assert len(got) == 5 and max(r.score for r in got) < 1e-9 and not any(r.held_out for r in got if r.doc_id is None)
    assert tx.judge(docs.limit(0), tx.train(docs.limit(0), labels), ["doc_id"]).collect() == []
    # both classes, one document each, and texts without letters
    two = spark.createDataFrame([(1, "..."), (4, "an odd idea"), (4, "an odd idea")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int")
    assert len(tx.judge(two, tx.train(two, marks), ["doc_id"]).collect()) == 3
