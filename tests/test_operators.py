"""Operators on small notes written by hand."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import scalars as X
from lorekeep.functions import text
from lorekeep.operators import chunks, evaluate, fusion, graph, links, maintenance, mutate, reports, retrieval
from lorekeep.operators import predicates as P
from lorekeep.plans import bases, dql
from lorekeep.sources import markdown as M

NOTES = [
    ("a/One.md", datetime(2023, 1, 1), "---\nstatus: Open\npriority: 1\ntags: [Idea, x]\nlist: [a, B]\nnil: null\n---\nSee [[Two]] and [[b/Three|t]] and [[Nope]].\n\nQ: why so?\n"),
    ("a/Two.md", datetime(2024, 1, 1), "---\nstatus: done\npriority: '1'\ndone: true\n---\n# Head\n- Q: is it?\nBack to [[One]] ![[Three]] #idea\n"),
    ("b/Three.md", datetime(2024, 1, 2), "no front matter here\n\n## Chat: Talk\n### user · t1\nhello\n### assistant · t2\nworld\nmore\n"),
    ("b/Two.md", datetime(2024, 1, 3), "alone"),
]


@pytest.fixture(scope="module")
def notes(spark):
    return M.notes(spark.createDataFrame(NOTES, "path string, mtime timestamp, content string")).cache()


def paths(df, column="path"):
    return sorted(r[column] for r in df.collect())


@pytest.mark.parametrize("text,want", [
    ('LIST WHERE status = "OPEN"', ["a/One.md"]), ("LIST WHERE priority = 1", ["a/One.md", "a/Two.md"]), ('LIST WHERE status != "open"', ["a/Two.md", "b/Three.md", "b/Two.md"]), ("LIST WHERE nil = null", ["a/One.md"]),
    ("LIST WHERE missing = null", []), ('LIST WHERE list contains "b"', ["a/One.md"]), ('LIST WHERE status contains "ON"', ["a/Two.md"]), ('LIST WHERE status like "d*e"', ["a/Two.md"]), ("LIST FROM #IDEA", ["a/One.md", "a/Two.md"]),
    ('LIST FROM "a" WHERE done = true', ["a/Two.md"]), ('LIST WHERE done = "true"', ["a/Two.md"]), ('LIST WHERE Status = "open" OR file.name = "three"', ["a/One.md", "b/Three.md"]), ('LIST WHERE list = "c"', []),
])
def test_dql_semantics(notes, text, want):
    assert paths(dql.run(notes, text)) == want


@pytest.mark.parametrize("tree,want", [
    ('status == "Open"', ["a/One.md"]), ('status == "open"', []), ("priority == 1", ["a/One.md"]), ('status != "Open"', ["a/Two.md", "b/Three.md", "b/Two.md"]), ('list contains "B"', ["a/One.md"]), ('taggedWith(file.file, "#IDEA")', ["a/One.md", "a/Two.md"]),
    ('linksTo(file.file, "x/Three.md#s")', ["a/One.md", "a/Two.md"]), ({"not": "file.size > 1"}, []), ({"or": ["file.size > 1", 'file.name == "three"']}, ["b/Three.md"]), ({"not": 'path startsWith "a/"'}, ["b/Three.md", "b/Two.md"]), ("", ["a/One.md", "a/Two.md", "b/Three.md", "b/Two.md"]),
])
def test_bases_semantics(notes, tree, want):
    n = notes.withColumn("link_names", F.transform("links", lambda x: F.lower(F.element_at(F.split(x["target"], "/"), -1))))
    got = bases.query(n, {"filters": tree, "views": []})
    assert paths(got.matches) == want and got.total.first()[0] == len(want)


def test_json_and_hybrid_filters(notes):
    status, many = P.map_value(notes, "frontmatter", "STATUS"), P.map_value(notes, "frontmatter", "list")
    assert paths(notes.where(P.json_search(status, equals='"Open"'))) == ["a/One.md"] and paths(notes.where(P.json_search(many, contains='"B"'))) == ["a/One.md"]
    assert paths(notes.where(P.json_search(status, exists=False))) == ["b/Three.md", "b/Two.md"] and paths(notes.where(P.hybrid_filter(status, [" open ", "x"]))) == ["a/One.md"]
    with pytest.raises(ValueError):
        P.json_search(status)


def test_link_resolution_prefers_own_folder(notes):
    r = links.resolve(M.link_table(notes), notes)
    assert {(x.path, x.target): x.resolved for x in r.collect()} == {("a/One.md", "Two"): "a/Two.md", ("a/One.md", "b/Three"): "b/Three.md", ("a/One.md", "Nope"): None, ("a/Two.md", "One"): "a/One.md", ("a/Two.md", "Three"): "b/Three.md"}
    assert paths(links.orphans(notes, r)) == ["b/Two.md"]
    back = links.backlinks(r, "b/Three.md").collect()
    assert [(b.path, b["count"], b.kind) for b in back] == [("a/One.md", 1, "wikilink"), ("a/Two.md", 1, "embed")]
    near = {(x.path, x.relation) for x in links.neighbours("a/One.md", r, M.tag_table(notes)).collect()}
    assert near == {("a/Two.md", "outbound"), ("b/Three.md", "outbound"), ("a/Two.md", "inbound")}
    assert links.similar("a/One.md", notes, r).first().path == "a/Two.md"
    assert links.suggestions(notes, "thr").first().path == "b/Three.md"


def test_reports(notes):
    tags = {r.tag: (r["count"], r.frontmatter, r.inline_only) for r in reports.tag_counts(M.tag_table(notes)).collect()}
    assert tags == {"idea": (2, 1, 1), "x": (1, 1, 0)}
    keys = {r.key: r.types for r in reports.key_inventory(notes).collect()}
    assert keys["priority"] == ["number", "string"] and keys["nil"] == ["null"]
    now = F.lit("2024-01-04").cast("timestamp")
    asked = [(r.path, r.heading, r.question) for r in reports.open_questions(M.line_rows(notes), notes, now).collect()]
    assert asked == [("a/One.md", None, "why so?"), ("a/Two.md", "Head", "is it?")]
    found = reports.lint(notes, links.resolve(M.link_table(notes), notes), now)
    assert paths(found["stale"]) == ["a/One.md"] and len(paths(found["stubs"])) == 4 and [r.target for r in found["broken"].collect()] == ["Nope"]
    for bad in ("(a+)+", "(a|b)*c", "(x)\\1"):
        with pytest.raises(ValueError):
            reports.check_pattern(bad)


def test_chat_messages(notes):
    got = [(r.role, r.timestamp, r.content) for r in M.chat_messages(M.line_rows(notes)).orderBy("line_start").collect()]
    assert got == [("user", "t1", "hello"), ("assistant", "t2", "world\nmore")]


def test_graph(spark, notes):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "c"), ("d", "d")], "src string, dst string")
    assert graph.find_path(e, "a", "d") == (True, [["a", "b", "c", "d"], ["a", "x", "c", "d"]])
    assert graph.find_path(e, "d", "a") == (False, []) and graph.find_path(e, "a", "d", 2) == (False, []) and graph.find_path(e, "a", "a") == (True, [["a"]])
    two = spark.createDataFrame([(x, y) for g in ("abc", "xyz") for x in g for y in g if x < y] + [("c", "x")], "src string, dst string")
    g = graph.undirected(two)
    m = graph.communities_exact(g)
    assert {frozenset(r.members) for r in graph.community_table(g, m).collect()} == {frozenset("abc"), frozenset("xyz")}
    assert abs(graph.modularity(g, m).first()[0] - (12 / 14 - 0.5)) < 1e-9
    resolved = graph.graph_edges(M.link_table(notes), notes)
    assert ("a/One.md", "b/Three.md") in {tuple(r) for r in resolved.collect()}


def test_bm25_matches_the_closed_form(spark):
    import math

    rows = [(i, "apple pie" if i < 2 else "plain text words", "apple" if i == 0 else "") for i in range(6)]
    chunks = spark.createDataFrame(rows, "path int, content string, title string").withColumn("aliases", F.lit("")).withColumn("chunk_index", F.lit(0)).withColumn("parts", F.array().cast("array<string>"))
    postings, lengths = retrieval.bm25_index(chunks)
    got = {r.path: r.score for r in retrieval.bm25_search(postings, lengths, '"apple pie"').collect()}
    avg = (4 + 3 + 4 * 4) / 6
    idf = math.log((6 - 2 + 0.5) / 2.5)
    want = {p: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg)) for p, tf, n in ((0, 1, 4), (1, 1, 3))}
    # A quoted part is split at white space: two words that must both match.
    one = {p: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg)) for p, tf, n in ((0, 11, 4), (1, 1, 3))}
    assert all(abs(got[p] - (one[p] + want[p])) < 1e-9 for p in want) and set(got) == {0, 1}
    assert retrieval.bm25_search(postings, lengths, "").count() == 0


def test_fusion_and_blends(spark):
    ranked = spark.createDataFrame([("q", "s", "a", 1, 1.0), ("q", "s", "a", 3, 0.1), ("q", "s", "b", 2, 0.5), ("q", "t", "b", 1, 9.0)], "query_id string, signal string, id string, rank int, score double")
    got = {r.id: (round(r.score, 9), r.signals) for r in fusion.rrf(ranked).collect()}
    assert got == {"a": (round(1 / 61, 9), 1), "b": (round(1 / 62 + 1 / 61, 9), 2)}
    over = fusion.overshoot(fusion.rrf(ranked), 10)
    marks = spark.createDataFrame([("a", 3, 0)], "id string, useful int, not_useful int")
    assert [r.id for r in fusion.feedback_blend(over, marks, 1.0).orderBy("pos").collect()] == ["a", "b"] and [r.id for r in fusion.feedback_blend(over, marks, 0.0).orderBy("pos").collect()] == ["b", "a"]
    assert [r.id for r in fusion.final(over, 10, 2).collect()] == ["b"]
    assert fusion.select_evidence([["a", "b"], ["a", "c"]], ["b", "a", "c"], 3) == ["a", "c", "b"]


def test_metrics(spark):
    run = spark.createDataFrame([("1", "x", 1), ("1", "r", 2), ("1", "r", 3), ("2", "r", 1), ("3", "z", 1)], "query_id string, path string, rank int")
    qrels = spark.createDataFrame([("1", "r"), ("1", "s"), ("2", "r"), ("3", "r")], "query_id string, path string")
    asked = spark.createDataFrame([("1", None), ("2", "c"), ("3", "c"), ("4", "c")], "query_id string, category string")
    got = {r.query_id: r for r in evaluate.per_query(run, qrels, asked).collect()}
    assert (got["1"].ndcg, got["1"].recall, got["1"].mrr, got["1"].missed, got["1"].category) == (0.3869, 0.5, 0.5, ["s"], "uncategorized")
    assert [got[q].bucket for q in "1234"] == ["hit_top_k", "hit_rank_1", "miss", "no_labels"]
    total = evaluate.summary(evaluate.per_query(run, qrels, asked))
    assert evaluate.compare(total, total).first().ndcg_delta == 0.0
    one, other = evaluate.cohort(qrels, asked), evaluate.cohort(qrels.limit(1), asked)
    assert evaluate.compare(total, total, k=(10, 10), cohorts=(one, one)).count() == 1
    for wrong in ({"k": (10, 5)}, {"cohorts": (one, other)}):
        with pytest.raises(ValueError):
            evaluate.compare(total, total, **wrong)


def test_mutations(spark):
    n = spark.createDataFrame([("a/One.md", "[[Two]] [[a/Two#s|x]] ![[Two]]\n```\n[[Two]] foo\n```\nfoo Foo"), ("a/Two.md", "---\nk: 1\nz: 2\n---\nself [[Two]]")], "path string, content string")
    snapshot, report = mutate.rename(n, "a/Two.md", "b/New.md")
    got = {r.path: r.content for r in snapshot.collect()}
    assert got == {"a/One.md": "[[New]] [[b/New#s|x]] ![[New]]\n```\n[[Two]] foo\n```\nfoo Foo", "b/New.md": "---\nk: 1\nz: 2\n---\nself [[New]]"} and report.count() == 4
    snapshot, report = mutate.replace(n, "foo", "bar", case_sensitive=False)
    assert {r.path: r["count"] for r in report.collect()} == {"a/One.md": 2} and "[[Two]] foo" in {r.path: r.content for r in snapshot.collect()}["a/One.md"]
    snapshot, report = mutate.set_front_matter(n, "a/Two.md", {"k": 1, "z": None, "new": [1]})
    assert report.first().changed == ["-z", "+new"]
    for call, error in ((lambda: mutate.create(n, "a/One.md", "x"), FileExistsError), (lambda: mutate.rename(n, "a/Two.md", "a/One.md"), FileExistsError), (lambda: mutate.rename(n, "a/None.md", "x.md"), FileNotFoundError)):
        with pytest.raises(error):
            call()
    code = spark.createDataFrame([("a.md", "`[[b]]` and [[b]] `x` [[b|c]]"), ("b.md", "")], "path string, content string")
    snapshot, report = mutate.rename(code, "b.md", "c.md")
    assert {r.path: r.content for r in snapshot.collect()} == {"a.md": "`[[b]]` and [[c]] `x` [[c|c]]", "c.md": ""}
    assert {(r.raw, r.becomes) for r in report.collect()} == {("[[b]]", "[[c]]"), ("[[b|c]]", "[[c|c]]")}
    assert mutate.append(n, "a/One.md", "end").where("path = 'a/One.md'").first().content.endswith("foo Foo\n\nend")


def test_maintenance_and_streaming(spark, tmp_path):
    from lorekeep.streaming import upkeep

    events = spark.createDataFrame([("p", "add", 1, datetime(2024, 1, 1), "v1"), ("p", "change", 3, datetime(2024, 1, 3), "v3"), ("p", "change", 2, datetime(2024, 1, 2), "v2"), ("g", "add", 1, datetime(2024, 1, 1), "x")], "path string, kind string, seq int, mtime timestamp, content string")
    late = spark.createDataFrame([("p", "change", 9, datetime(2023, 1, 1), "old"), ("g", "unlink", 9, datetime(2024, 1, 5), None)], events.schema)
    source, folder = str(tmp_path / "in"), str(tmp_path / "index")
    for batch in (events, late):
        batch.coalesce(1).write.mode("append").parquet(source)
        upkeep.start(spark.readStream.schema(events.schema).parquet(source), folder, str(tmp_path / "check")).awaitTermination()
    assert [(r.path, r.content, r.revision) for r in upkeep.current(spark, folder).collect()] == [("p", "v3", 1)]
    live = spark.createDataFrame([("n", datetime(2024, 1, 1))], "path string, mtime timestamp")
    # A batch that runs again changes nothing, and what is broken is not taken for empty.
    before = upkeep.pointer(spark, folder)
    upkeep.batch_writer(folder)(events, before[0])
    assert upkeep.pointer(spark, folder) == before and upkeep.current(spark, folder).count() == 1
    (tmp_path / "odd" / "pointer").mkdir(parents=True)
    (tmp_path / "odd" / "pointer" / "x.json").write_text('{"batch": 1, "snapshot": "gone"}')
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        upkeep.current(spark, str(tmp_path / "odd")).count()
    assert {(r.path, r.change) for r in maintenance.diff(live, upkeep.current(spark, folder)).collect()} == {("n", "added"), ("p", "deleted")}


def test_scalars(spark):
    df = spark.createDataFrame([("aaa a\nb", [1.0, 0.0], [])], "t string, v array<double>, e array<double>")
    r = df.select(X.overlapping_count(F.col("t"), "aa").alias("o"), X.literal_count(F.col("t"), "aa").alias("l"), X.word_count(F.col("t")).alias("w"), X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j"), X.round_half_up(F.lit(-0.5), 0).alias("r"), X.dequantise(X.quantise(F.col("v"))).alias("d"), X.ngrams(F.lit("abcd"), 3).alias("g")).first()
    assert (r.o, r.l, r.w, r.j, r.r, r.d, r.g) == (2, 1, 3, 0.0, 0.0, [1.0, 0.0], ["abc", "bcd"])


def test_hybrid_search_and_context_pack(spark, notes):
    from lorekeep.plans import search

    vectors = spark.createDataFrame([(1, "a/One.md", 0, [1.0, 0.0]), (2, "b/Two.md", 0, [0.0, 1.0])], "id long, path string, chunk_index int, vector array<double>")
    resolved = links.resolve(M.link_table(notes), notes)
    corpus = search.Corpus(notes, links.edges(resolved), M.chunk_rows(notes), vectors=vectors, embed=lambda text: [0.0, 1.0] if "alone" in text else [1.0, 0.0]).with_indexes()
    for name in ("edges", "chunks", "postings", "lengths", "tfidf", "terms"):
        setattr(corpus, name, getattr(corpus, name).cache())
    got = search.hybrid(corpus, "alone", search.Options(limit=3, now=datetime(2024, 1, 4)))
    assert got.signals == ["bm25", "tfidf", "vector"] and got.hits.first().id == "b/Two.md" and not got.errors
    assert [r.id for r in search.hybrid(corpus, "alone", search.Options(fields={"status": "open"})).hits.collect()] == []
    assert search.hybrid_multi(corpus, ["alone", "hello world"], search.Options(limit=2)).hits.count() == 2
    pack = search.context_pack(corpus, "alone", budget_tokens=200, options=search.Options(limit=2))
    assert pack["notes"][0] == "b/Two.md" and "### b/Two.md" in pack["text"]
    assert search.resolve_target(notes, path="a/one") == {"path": "a/One.md"} and search.resolve_target(notes, title="Two")["path"] == "a/Two.md"
    assert search.resolve_target(notes, title="Thre")["suggestions"] == ["b/Three.md"]
    with pytest.raises(ValueError):
        search.resolve_target(notes, title="Two", strict=True)


def test_chunk_operators(spark):
    from lorekeep.operators import chunks

    c = spark.createDataFrame([("p", i, t, "H") for i, t in enumerate(["first words here", "the Licence text", "last part of it"])], "path string, chunk_index int, text string, breadcrumb string")
    got = [r.embed_text for r in chunks.embed_text(c, 8).orderBy("chunk_index").collect()]
    assert got[1] == "H\nhere\nthe Licence text\nlast" and chunks.chunk(c, "p", 2).first().text == "last part of it"
    assert c.select(chunks.marked_snippet(F.col("text"), ["licence"], 2).alias("s")).collect()[1].s == "…«Licence» text" or c.select(chunks.marked_snippet(F.col("text"), ["licence"], 3).alias("s")).collect()[1].s == "the «Licence» text"
    pages = spark.createDataFrame([("d", 2, "two", "ok"), ("d", 1, "one", "ok"), ("d", 3, "", "failed")], "path string, page_number int, text string, status string")
    assert chunks.page_text(pages).first().content == "[page: 1]\none\n\n[page: 2]\ntwo"
    vectors = spark.createDataFrame([(1, "p", 0), (2, "q", 0)], "id long, path string, chunk_index int")
    table, out, new = chunks.replace_vectors(vectors, "p", spark.createDataFrame([("p", 0), ("p", 1)], "path string, chunk_index int"))
    assert [r.id for r in out.collect()] == [1] and sorted(r.id for r in new.collect()) == [3, 4] and table.count() == 3
    assert chunks.fold_with_map("aİb") == ("ai̇b", [0, 1, 1, 2])


def test_vector_batch_in_blocks(spark):
    v = spark.createDataFrame([(i, [float((i * 7 + k) % 11) for k in range(4)]) for i in range(40)], "id long, vector array<double>")
    asked = v.select(F.col("id").alias("query_id"), F.col("vector").alias("q")).where("id < 9")
    whole, blocks = [sorted(tuple(r) for r in retrieval.vector_batch(v, asked, 3, -1.0, most_queries=m).collect()) for m in (1000, 2)]
    assert blocks == whole and len(whole) == 27


def test_bm25_without_limit(spark):
    chunks = spark.createDataFrame([(f"{i}.md", 0, "apple pie", "t", "") for i in range(40)], "path string, chunk_index int, content string, title string, aliases string")
    assert retrieval.bm25_search(*retrieval.bm25_index(chunks), "apple", None).count() == 40


def test_communities_until_labels_stand(spark):
    edges = [(f"n{i:02}", f"n{i + 1:02}", 1 + i % 3) for i in range(11)] + [("x", "y", 1)]
    g = spark.createDataFrame([e for a, b, w in edges for e in ((a, b, w), (b, a, w))], "src string, dst string, weight long")
    labels = {n: n for a, b, _ in edges for n in (a, b)}
    past = [dict(labels)]
    while True:  # the same rule on plain values
        weight = {n: {labels[n]: 0.5} for n in labels}
        for a, b, w in edges:
            weight[a][labels[b]] = weight[a].get(labels[b], 0) + w
            weight[b][labels[a]] = weight[b].get(labels[a], 0) + w
        labels = {n: min(x, key=lambda c: (-x[c], c)) for n, x in weight.items()}
        if labels in past[-2:]:
            break
        past.append(labels)
    assert len(past) > 3 and {r.node: r.community for r in graph.communities(g, None).collect()} == labels


def test_communities_do_not_depend_on_row_order(spark):
    edges = [(a, b) for g in ("abc", "def", "ghi") for a in g for b in g if a < b] + [("c", "d"), ("f", "g"), ("a", "i"), ("b", "e")]
    found = set()
    for parts in (1, 3, 7):
        g = graph.undirected(spark.createDataFrame(edges, "src string, dst string").repartition(parts, F.rand(parts)))
        found.add(tuple(sorted((r.node, r.community) for r in graph.communities_exact(g).collect())))
    assert len(found) == 1 and {c for _, c in next(iter(found))} == {0, 1, 2}
    with pytest.raises(ValueError):
        graph.communities_exact(g, most_edges=5)


def test_moves_on_tables_come_near_the_sequential_pass(spark):
    rng = random.Random(3)
    cliques = [(f"n{c:02}{a}", f"n{c:02}{b}") for c in range(6) for a in range(5) for b in range(a)] + [(f"n{c:02}0", f"n{(c + 1) % 6:02}1") for c in range(6)]
    planted = [(f"v{i:03}", f"v{j:03}") for i in range(120) for j in range(i) if rng.random() < (0.4 if i % 6 == j % 6 else 0.01)]
    for edges in (cliques, planted):
        g = graph.undirected(spark.createDataFrame(edges, "src string, dst string")).cache()
        members = graph.communities_by_moves(g)
        assert graph.modularity(g, members).first()[0] >= graph.modularity(g, graph.communities_exact(g)).first()[0] - 0.02
        rows = members.collect()
        assert len(rows) == len({n for e in edges for n in e}) and all(r.community <= r.node for r in rows)
    assert {r.community for r in graph.communities_by_moves(graph.undirected(spark.createDataFrame(cliques, "src string, dst string"))).collect()} == {f"n{c:02}0" for c in range(6)}
    assert graph.communities_by_moves(g.limit(0)).collect() == []


@pytest.mark.parametrize("spread", [graph.communities_by_moves, graph.communities])
def test_rounds_of_communities_read_the_source_once(spark, spread):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    edges = [(f"n{c:02}{a}", f"n{c:02}{b}") for c in range(6) for a in range(5) for b in range(a)] + [(f"n{c:02}0", f"n{(c + 1) % 6:02}1") for c in range(6)]
    g = graph.undirected(spark.createDataFrame(edges, "src string, dst string")).select("src", "dst", "weight").mapInPandas(count, "src string, dst string, weight long")
    assert spread(g).count() == 30 and read.value == 2 * len(edges)


def test_many_notes_of_one_name_are_resolved_without_their_product(spark):
    n = 3000
    notes = spark.range(n).select(F.format_string("d%04d/index.md", "id").alias("path"), F.col("id").alias("scan_ord"))
    found = links.resolve(notes.select("path", F.lit(0).alias("ord"), F.lit("index").alias("target")).unionByName(spark.createDataFrame([("x/a.md", 0, "index"), ("d0001/b.md", 0, "d0007/index"), ("q/b.md", 0, "./../d0002/index")], "path string, ord int, target string")), notes).collect()
    assert len(found) == n + 3 and {r.path: r.resolved for r in found if not r.path.endswith("index.md")} == {"x/a.md": "d0000/index.md", "d0001/b.md": "d0007/index.md", "q/b.md": "d0002/index.md"}
    assert all(r.resolved == r.path for r in found if r.path.endswith("index.md"))


def test_one_tokenizer_for_index_and_query(spark):
    texts = ["tiễn Άλφα Ñandú", "漢字かな text", "a (b) c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.fts_tokens(F.col("t")).alias("fts"), text.tfidf_tokens(F.col("t")).alias("tfidf"))
    for t, r in zip(texts, df.collect(), strict=True):
        assert [w for p in text.fts_query(t) for w in p] == r.fts and text.tfidf_query(t) == r.tfidf
    assert df.first().fts == ["tien", "αλφα", "nandu"]
    marked = spark.createDataFrame([("a (b) c",)], "t string").select(chunks.marked_snippet(F.col("t"), ["(", "b"])).first()[0]
    assert "«b»" in marked or "«(»" in marked


def test_patterns_that_may_backtrack_are_refused():
    for bad in ("((a+))+$", "(a|a)*", "(a*)*", "a*a*b", ".*x?.*", r"(a)\1", "(?:a{1,5}){20}"):
        with pytest.raises(ValueError):
            reports.check_pattern(bad)
    for good in ("a+b*", "(abc)+", "^x{2,3}$", "[a-z]+ [0-9]+"):
        assert reports.check_pattern(good) == good


def test_patterns_are_matched_in_linear_time(spark):
    import time

    rows = [("a", "word " * 20_000), ("b", "x" * 100_000 + "y"), ("c", None), ("d", "Ab x")]
    df = spark.createDataFrame(rows, "path string, text string")
    reports.matching(df, "text", "warm").count()
    began = time.perf_counter()
    assert [r.path for r in reports.matching(df, "text", r"\w+\s*\w+z").collect()] == []
    assert {r.path for r in reports.matching(df, "text", r"(x+x+)+y").collect()} == {"b"} and time.perf_counter() - began < 30
    assert {r.path for r in reports.matching(df, "text", r"^\p{Lu}\p{Ll} x$").collect()} == {"d"}
    for bad in (r"(a)\1", "(?=a)b", "(", "a{1,100000}"):
        with pytest.raises(ValueError):
            reports.linear_pattern(bad)


def test_bounded_listing_and_canvas_references(spark, tmp_path):
    from lorekeep.sources import scans

    (tmp_path / "sub").mkdir()
    for name in ("a.md", "b.MD", "sub/c.md", "d.txt", ".hidden.md", "plain"):
        (tmp_path / name).write_text("x")
    root = str(tmp_path)
    rows, receipt = scans.listing(spark, root, (".md",))
    assert [r.path for r in rows.collect()] == ["a.md", "b.MD", "sub/c.md"] and receipt == {"visited": 5, "complete": True}
    rows, receipt = scans.listing(spark, root, ("md", "txt"), max_files=2)
    assert [r.path for r in rows.collect()] == ["a.md", "b.MD"] and not receipt["complete"]
    assert scans.listing(spark, root, ("md",), max_visited=3)[1] == {"visited": 3, "complete": False}
    rows, receipt = scans.listing(spark, root, ("md",), folder="nowhere")
    assert rows.count() == 0 and receipt["complete"]
    with pytest.raises(ValueError):
        scans.listing(spark, root, ("m/d",))
    canvas = '{"nodes": [{"id": "1", "type": "file", "file": "/x/One.md"}, {"id": "2", "type": "file", "file": "one"}, {"id": "3", "type": "file", "file": "gone.md"}, {"id": "4", "type": "file"}, {"id": "5", "type": "text", "text": "t"}]}'
    boards = spark.createDataFrame([("b.canvas", canvas), ("bad.canvas", "{")], "path string, content string")
    notes = spark.createDataFrame([("x/One.md", 1), ("y/two.md", 2)], "path string, scan_ord int")
    assert {r.id: r.file_resolved for r in scans.file_nodes(boards, notes).collect()} == {"1": "x/One.md", "2": "x/One.md", "3": None, "4": None}
    assert [(r.id, r.file) for r in scans.broken_file_nodes(boards, notes).collect()] == [("3", "gone.md")]


def test_scope_and_append(spark):
    n = spark.createDataFrame([("a/x.md", ["t_1"], datetime(2024, 1, 2)), ("ab/y.md", ["tx1"], datetime(2024, 1, 1)), ("a/z.md", None, None)], "path string, tags array<string>, mtime timestamp")
    names = lambda **k: {r.path for r in retrieval.scope(n, **k).collect()}
    assert names(folder="a/") == {"a/x.md", "a/z.md"} and names(tag="t_1") == {"a/x.md"} and names(since=datetime(2024, 1, 2)) == {"a/x.md"} and len(names()) == 3
    content = spark.createDataFrame([("a", None), ("b", "x")], "path string, content string")
    assert mutate.append(content, "a", "new").where("path = 'a'").first().content == "new"


def test_replacement_leaves_fences_alone(spark):
    n = spark.createDataFrame([("a", "x y x"), ("b", "x\n```\nx\n```\nx"), ("c", "none"), ("d", None)], "path string, content string")
    snapshot, report = mutate.replace(n, "x", "zz")
    assert {r.path: r.content for r in snapshot.collect()} == {"a": "zz y zz", "b": "zz\n```\nx\n```\nzz", "c": "none", "d": None}
    assert {(r.path, r["count"]) for r in report.collect()} == {("a", 2), ("b", 2)}


def test_files_are_streamed_in_bounded_batches(spark, tmp_path):
    from lorekeep.streaming import upkeep

    (tmp_path / "in" / "sub").mkdir(parents=True)
    for k, name in enumerate(("a.md", "sub/b.md", "c.txt", "d.md")):
        (tmp_path / "in" / name).write_text(f"text é {k}", encoding="utf-8")
    seen = []
    query = upkeep.file_events(spark, str(tmp_path / "in"), max_files=2).writeStream.foreachBatch(lambda batch, _: seen.append(sorted(r.content for r in batch.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(len, seen)) == [1, 2] and sorted(sum(seen, [])) == ["text é 0", "text é 1", "text é 3"]


def test_recall_of_cells(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    centres = retrieval.fit_cells(v)
    index, exact = retrieval.cell_index(v, centres), retrieval.vector_batch(v, asked, 10, -1.0)
    assert index.where("cell is null").count() == 0 and retrieval.recall(retrieval.cell_search(index, asked, centres), exact).first()[0] >= 0.9
    assert retrieval.recall(retrieval.cell_search(index, asked, centres, probes=len(centres)), exact).first()[0] == 1.0
