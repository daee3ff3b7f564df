from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions.periodic import format_date, load_config, ordinal, resolve_alias
from lorekeep.operators.predicates import like_match, like_parts
from lorekeep.plans import bases, dql
from lorekeep.sources import markdown as M
from lorekeep.sources.scans import glob_regex, parse_base


def test_dql_clauses_in_any_order_and_quotes():
    q = dql.parse('table a, file.name limit 5 where a = "x AND y" or b != 2 and c like "z*" sort a desc from "f/g"')
    assert q.columns == ("a", "file.name") and q.limit == 5 and q.sort == ("a", False) and q.folder == "f/g"
    assert q.where == ((dql.Predicate("a", "=", "x AND y"),), (dql.Predicate("b", "!=", 2), dql.Predicate("c", "like", "z*")))


@pytest.mark.parametrize("text", ["", "SELECT 1", "LIST a", 'LIST FROM ""', "LIST FROM folder", "LIST WHERE a = 1 AND", "LIST WHERE a < 1", "LIST LIMIT 0", "LIST LIMIT 1001", "LIST LIMIT 05", "LIST FROM #", "TABLE a\nFROM #b", "LIST SORT a b"])
def test_dql_errors(text):
    with pytest.raises(dql.QueryError):
        dql.parse(text)


def test_literals():
    values = [p.value for g in dql.parse('LIST WHERE a = true AND b = null AND c = -1.5 AND d = word AND e = "1"').where for p in g]
    assert values == [True, None, -1.5, "word", "1"]


def test_like_matches_whole_values(spark):
    rows = spark.createDataFrame([("AxxB*_%",), ("ba",), ("a" * 3000 + "b",), ("abcab",), ("ab",), ("",)], "v string")
    got = lambda p: [r.v[:7] for r in rows.where(like_match(F.col("v"), like_parts(p))).collect()]
    assert got("a**B\\*_%") == ["AxxB*_%"] and got("a*") == ["AxxB*_%", "aaaaaaa", "abcab", "ab"] and got("*a*a*a*a*a*c") == [] and got("ab*ab") == ["abcab"]
    assert got("*") == ["AxxB*_%", "ba", "aaaaaaa", "abcab", "ab", ""] and got("") == [""] and got("*c*b") == ["abcab"] and got("a*a*b") == ["aaaaaaa", "abcab"]
    with pytest.raises(ValueError):
        like_parts("x" * 513)


def test_front_matter_forms():
    assert M.split_front_matter("plain")[:2] == ({}, "plain")
    assert M.split_front_matter("﻿---\na: 1\n---\nb")[:2] == ({"a": 1}, "b")
    assert M.split_front_matter("---\na: 1\nrest: 2")[1] == ""
    data, body, coerced, _ = M.split_front_matter("---\n- x\n---\nb")
    assert data == {} and coerced and body == "b"
    source = "---\na: [1\n---\nb"
    assert M.split_front_matter(source)[1] == source
    assert M.split_front_matter("---\n---\nb")[:2] == ({}, "b")


def test_links_tags_and_code():
    n = M.parse_note("d/N.md", "[[A#s^b|al]] ![[e]] [[]] [[open\n#a (#b/c) x#no `#code [[z]]`\n~~~\n[[f]] #g\n~~~\n#9 {#ok}")
    assert [(x["kind"], x["target"], x["section"], x["block"], x["alias"]) for x in n["links"]] == [("wikilink", "A", "s", "b", "al"), ("embed", "e", None, None, None)]
    assert n["inline_tags"] == ["a", "b/c", "ok"]


def test_fence_rules():
    f = M.Fence()
    got = [f.step(x)[0] for x in ["```py", "x", "~~~", "``", "````", "out", "``` a`b", "    ```"]]
    assert got == [True, True, True, True, True, False, False, False]


def test_front_matter_tags_keep_duplicates():
    assert M.front_matter_tags({"Tags": "#x, y  x"}) == ["x", "y", "x"] and M.front_matter_tags({"tags": None, "tag": ["p", 3]}) == ["p"]


def test_chunks_pack_and_cut():
    long = "w" * 5000
    got = M.chunks("# H\npara\n\n\n" + "\n".join(["l" * 1000] * 6) + "\n\n" + long)
    assert [c["chunk_index"] for c in got] == list(range(len(got))) and all(len(c["text"]) <= 4096 for c in got)
    assert got[0]["text"] == "# H\npara" and got[0]["breadcrumb"] == "H" and "".join(c["text"] for c in got[-2:]) == long


def test_breadcrumbs_and_identifiers():
    rows = M.line_table("# A\n## B ##\n### C\n## D\n```\n# no\n```")
    assert rows[2]["breadcrumb"] == ["A", "B", "C"] and rows[3]["breadcrumb"] == ["A", "D"] and rows[5]["heading_level"] is None and rows[1]["heading_text"] == "B"
    assert M.identifier_parts("camelCase HTTPServer plain v2") == ["camel", "case", "http", "server"]


def test_periodic_names():
    assert format_date("YYYY-[W]ww Do [a]", datetime(2024, 12, 30)) == "2024-W01 30th a"
    assert [ordinal(n) for n in (1, 2, 3, 11, 21)] == ["1st", "2nd", "3rd", "11th", "21st"]
    config = load_config('{"folder": "days/"}', "not json")
    assert resolve_alias("Today", datetime(2024, 1, 2), config) == ("daily", "days/2024-01-02") and resolve_alias("other", datetime(2024, 1, 2)) is None


def test_globs():
    import re

    assert re.match(glob_regex("a/**/b?.md"), "a/x/y/b1.md") and not re.match(glob_regex("a/*.md"), "a/b/c.md")


def test_base_files_and_literals():
    b = parse_base("filters:\n  and:\n    - tag == 'x'\nviews:\n  - name: v\n")
    assert b["views"][0]["name"] == "v" and b["formulas"] == {}
    with pytest.raises(ValueError):
        parse_base("- a")
    assert bases._value("'q'") == "q" and bases._value("word") is bases._NONE


@given(st.text(st.sampled_from("[]!a#^| \n\r\u2028"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_links_are_found_as_a_plain_machine_finds_them(text):
    want, i = [], 0
    while i + 1 < len(text):
        if text[i : i + 2] != "[[":
            i += 1
            continue
        j = i + 2
        while j < len(text) and text[j] not in "]\n\r\u2028\u2029":
            j += 1
        if j == len(text):
            break
        if text[j] != "]":
            i = j + 1
        elif j == i + 2:
            i += 1
        elif text[j + 1 : j + 2] == "]":
            want.append((i, j))
            i = j + 2
        else:
            i = j + 1
    assert list(M.link_places(text)) == want
    assert [x["raw"].strip("!") for x in M.links(text)] == [text[a : b + 2] for a, b in want if text[a + 2 : b].strip()]


def test_open_links_and_back_ticks_take_linear_time():
    import time

    began = time.perf_counter()
    assert M.links("[[" * 200_000) == [] and M.links("[[a]" * 100_000) == []
    assert len(M.links("[[a#b^c|d]] ![[e]]\n[[open\n[[]] [[x]]")) == 3
    assert M.mask_code("`a` ``b`` " * 20_000).strip() == ""
    assert time.perf_counter() - began < 10
