"""The audit against every order played through document by document."""

import re
from itertools import permutations

from lorekeep.llm import filter_audit as fa
from tests.compare import assert_same
from tests.llm import brute
from tests.llm.odd import with_clashing_columns

SF = "/root/testdata/sf0.001"


def fails(rows):
    """For (doc_id, text, lang) the letters of the filters that each row fails."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t, w = t or "", brute.words(t)
        failed = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        out.append(failed + "E" * (i is not None and i > first[t]))
    return out


def played(rows, labels):
    """{(part, order, step): the seven counts}"""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed, out = fails(rows), {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(i, f) for (i, _, lang), f in zip(rows, failed, strict=True) if (lang or "") == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                removed[x] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == x for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed[order[step - 1]])
    return out


def as_dict(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_query_equals_its_sql(spark):
    assert_same(fa.op12_filter_audit(spark, SF), fa.oracle(), SF)


def test_odd_tables_equal_every_order_played_through(spark):
    long = " ".join(f"w{i}" for i in range(210))
    rows = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (None, long, "en"), (None, long, None), (3, "", None), (4, None, ""), (5, "ABC DEF # x", "en"), (6, "ABC DEF # x", "fr"), (7, "x " * 300, "fr"), (8, long + " $", "fr"), (8, "x", "fr"), (2, "ABC DEF # x", "en")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (None, 1, 1), (5, None, 1), (6, 1, None), (8, 1, 1), (99, 1, 1)]
    docs = with_clashing_columns(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "part", "mask", "n", "good", "first", "digest", "cells")
    marks = with_clashing_columns(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "part", "mask", "n", "good")
    assert as_dict(fa.audit(docs, marks)) == played(rows, labels)
    assert fa.audit(docs.limit(0), marks).collect() == []
    assert as_dict(fa.audit(docs, marks.limit(0))) == played(rows, [])


def test_sums_invert_exactly(spark):
    rows = [("p", bool(m % 2), bool(m % 3), m, (m * 7919) % 101) for m in range(32)]
    df = spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, n long")
    got = fa.cells(fa.parity_sums(df)).groupBy("mask").sum("n").collect()
    assert {r[0]: r[1] for r in got} == {m: n for _, _, _, m, n in rows}
