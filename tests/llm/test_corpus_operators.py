"""Operators that compare documents with each other, and the pipeline."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import bitmaps, line_dedup, shingle_join, source_mixing, suffix_dedup
from lorekeep.llm.components import components
from tests.compare import assert_same
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def near_copies(seed=3, groups=6):
    """Groups of near copies, chains, shared passages, and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.choice([8, 40, 120, 200]))]
        if g % 2:
            base[5:5] = passage
        for _ in range(rng.choice([1, 2, 12])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own[: int(len(own) * rng.uniform(0.75, 1))]
            rows.append((n, " ".join(own)))
            n += 1
            if rng.random() < 0.2:
                rows.append((n, rows[-1][1].upper() if rng.random() < 0.5 else rows[-1][1]))
                n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One\ntwo"), (n + 4, "one two three four five"), (n + 5, "\t \n")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "blocks"), [(3, {}), (4, {"block": 3, "meta_block": 2})])  # families of one block, and of many
def test_jaccard_join(spark, seed, blocks):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "key", "t1", "h1", "token", "n", "label")}).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in shingle_join.join(df, **blocks)[0].collect()}
    links = link_numbers(rows)
    assert got == {i: (*x, links[i]) for i, x in brute.jaccard_components(rows).items()} and max(links.values()) > 2


def test_jaccard_of_texts_that_one_text_holds(spark):
    """Members of a family that have no shingle besides the reference's, and are too far from it for its answers to settle them."""
    rows = []
    for g in range(12):
        words = [f"w{g}x{i}" for i in range(44)]
        rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate((words, words[:34], words[4:38]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in shingle_join.join(df)[0].collect()}
    links = link_numbers(rows)
    assert got == {i: (*x, links[i]) for i, x in brute.jaccard_components(rows).items()} and set(links.values()) == {2}


def link_numbers(rows):
    sets = {i: brute.shingle_set(t) for i, t in rows}
    linked = lambda a, b: a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    return {a: sum(bool(linked(a, b)) for b in sets) for a in sets}


def test_jaccard_query(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in shingle_join.op10_ngram_jaccard_join(spark, SF).collect()}
    links = link_numbers(documents(spark))
    assert got == {i: (*x, links[i]) for i, x in brute.jaccard_components(documents(spark)).items()}


def test_jaccard_odd_rows(spark):
    def run(rows):
        return sorted((tuple(r)[:4] for r in shingle_join.join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()), key=str)

    text = "a b c d e f"
    # Equal texts without a doc_id are one document; it belongs to the least doc_id it links with.
    assert run([(None, text), (None, text), (2, text), (2, text), (3, "x"), (4, None), (5, text.upper()), (None, "lone words")]) == sorted(
        [(None, 2, 2, 2), (None, 2, 2, 2), (2, 2, 2, 2), (2, 2, 2, 2), (3, 1, 3, 0), (4, 0, 4, 0), (5, 2, 2, 2), (None, 1, None, 0)], key=str
    )
    # Rows of one doc_id with different texts connect what they link with; each row has its own number of links.
    assert run([(1, "p q r s t u"), (5, "p q r s t u"), (5, text), (7, text)]) == [(1, 2, 1, 1), (5, 2, 1, 1), (5, 2, 1, 1), (7, 2, 1, 1)]
    assert run([]) == [] and run([(1, None), (2, "")]) == [(1, 0, 1, 0), (2, 0, 2, 0)]


def test_near_duplicate_stage_without_ids(spark):
    rows = [(None, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, "g h i j k l", "s"), (3, "g h i j k l", "s"), (4, "G H i j k l", "s"), (None, None, "s"), (None, None, "s")]
    out = shingle_join.stage_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, label string"), SF)
    assert out.columns == ["doc_id", "text", "label"] and sorted((tuple(r) for r in out.collect()), key=str) == sorted([rows[0], rows[3], rows[5], rows[6]], key=str)


def test_jaccard_prefix_bounds():
    import numpy as np

    tokens = np.array([0, 255, 256, 2**40 + 7, 2**64 - 1], dtype=np.uint64)
    assert shingle_join._unpacked(shingle_join._packed(tokens)).tolist() == [t >> 8 << 8 for t in tokens.tolist()]
    for n in range(1, 60):
        assert len(shingle_join.prefix(np.arange(n, dtype=np.uint64), np.zeros(0, np.uint8))) == n - -(-75 * n // 100) + 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("seed", [5, 6])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(15, 60))).strip() or "x" for _ in range(30)]
    rows = []
    for d in range(50):
        parts = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                p = rng.randrange(len(line) + 1)
                line = rng.choice([line[:p] + rng.choice("abz") + line[p:], line[:p] + line[p + 1 :], line[:p] + rng.choice("abz") + line[p + 1 :]])
            parts.append(rng.choice(["", "  "]) + line + rng.choice(["", "\t"]))
        rows.append((None if d == 7 else d, None if d == 11 else "\n".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).repartition(3)
    assert {r.doc_id: r.text for r in line_dedup.dedup(df).collect()} == brute.line_dedup(rows)


def test_line_dedup_query(spark):
    got = {r.doc_id: r.text for r in line_dedup.op4_line_dedup(spark, SF).collect()}
    assert got == brute.line_dedup(documents(spark))
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_of_rows_without_ids(spark):
    rows = [(None, "one line here"), (None, "other words here\none line here"), (None, None), (3, "one line here\nown"), (3, "one line here\nown"), (4, "own")]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "gone", "n_dropped", "h1", "kept")})).collect()
    assert sum("one line here" in (r.text or "") for r in out) == 1 and [r.text for r in out if r.doc_id == 3] == ["own", "own"] and [r.text for r in out if r.doc_id == 4] == [""]
    assert all(r.h1 == "x" and r.kept == "x" for r in out) and sum(r.text is None for r in out) == 1


def test_repeated_spans(spark):
    rows = near_copies(9, 8)
    got = {(r.doc_id, r.start, r.end) for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(0)).repartition(3)).collect()}
    assert got == brute.repeated_spans(rows) and got


def test_repeated_spans_query(spark):
    rows = suffix_dedup.op2_suffix_array_dedup(spark, SF).collect()
    assert {(r.doc_id, r.start, r.end) for r in rows} == brute.repeated_spans(documents(spark))
    assert all(r.first_doc_id <= r.doc_id and r.n_words >= 50 for r in rows)
    assert suffix_dedup.repeated_spans(spark.createDataFrame([(1, None), (None, "a")], "doc_id long, text string")).count() == 0


def test_repeated_spans_of_odd_rows(spark):
    text = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    p = text("p", 60)
    rows = [(None, "x " + p), (5, text("a", 30) + " " + p), (5, "y " + p), (5, "y " + p), (6, text("b", 50)), (6, text("b", 50) + " z"), (7, p[:-1]), (8, None), (None, None), (9, "w " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "t", "h1", "node", "k", "content")})
    got = suffix_dedup.repeated_spans(df).collect()
    # The passage stands in 5 (two texts), in 7 without its last word, and in a row without a doc_id, which comes last; 6 and 9 only repeat themselves.
    assert {(r.doc_id, r.first_doc_id, r.is_first) for r in got} == {(None, 5, False), (5, 5, True), (7, 5, False)}
    assert {(r.start, r.end, r.n_words) for r in got if r.doc_id != 5} == {(2, 2 + len(p), 60), (0, len(" ".join(p.split()[:-1])), 59)}


def test_first_copy_keeps_its_shared_passages(spark):
    text = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    passage, node = text("p", 60), text("x", 70) + " " + text("p", 60) + " " + text("y", 70)
    rows = [(1, text("a", 80) + " " + passage), (10, node), (11, node), (20, text("z", 60)), (21, text("z", 60))]
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = node.index("p0")
    assert [tuple(s) for s in got[10].inside] == [(at, at + len(passage), 60, 1, False)]
    assert (got[10].start, got[10].end, got[10].first_doc_id, got[10].is_first) == (0, len(node), 10, True)
    assert got[20].inside == [] and all(got[k].inside is None for k in (1, 11, 21)) and got[1].is_first and not got[11].is_first


def test_mixing_query(spark):
    assert_same(source_mixing.op5_source_mixing(spark, SF), source_mixing.oracle(), SF)


def test_mixing_reaches_targets(spark):
    rng = random.Random(1)
    rows = [(i, None if rng.random() < 0.2 else rng.choice("abcdef" if i % 5 else "a"), "w " * rng.randint(0, 40)) for i in range(600)] + [(None, "a", "x"), (3, "a", None), (3, "a", "y z"), (3, "a", "y z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit("clash") for c in ("size", "h", "target", "taken", "copies")})
    out = source_mixing.mix(df, source_mixing.word_count()).collect()
    assert len(out) == len(rows)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 80 and all(r.taken <= 3 * r.size for r in own) and own[0].source_size == sum(r.size for r in own)
    assert sum(r.taken for r in out) <= sum(r.size for r in out)
    assert source_mixing.mix(df.limit(0), source_mixing.word_count()).count() == 0


def test_target_cap_is_reshared(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 100)], "source string, size long")
    got = {r.source: r.target for r in source_mixing.targets(sizes).collect()}
    assert got == {"a": 3.0, "b": pytest.approx(198 * 2 / 5), "c": pytest.approx(198 * 3 / 5)}


def test_mixing_stage_loses_no_row_that_the_mix_took(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    # source a: one doc_id with two texts; b: nameless equal rows that make up much of the table; c: rows equal in all columns
    rows = [(1, words(100), "en", "a", 9), (1, "x", "en", "a", 1)] + [(None, words(7), "en", "b", 7)] * 60 + [(3, words(11), "de", "c", 11)] * 2 + [(4, None, "en", "c", 0), (5, words(12), "en", "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copies", F.lit("own"))
    taken = source_mixing.mix(docs, source_mixing.word_count()).groupBy("source").agg(F.sum("taken").alias("taken"), F.min("target").alias("target")).collect()
    out = source_mixing.stage_mix(spark, docs, "").collect()
    assert out[0].copies == "own" and set(docs.columns) == set(out[0].asDict())
    for r in taken:
        mine = [x for x in out if x.source == r.source]
        # the order of a source's queue differs from the query's, as its rows are told apart by more; the amounts stay near
        assert abs(sum(len(x.text.split()) for x in mine) - r.target) <= 101 and mine
        assert r.taken > 0
    size = len([x for x in out if x.source == "b"])
    assert size <= 180
    assert source_mixing.stage_mix(spark, docs.limit(0), "").collect() == []


def test_passages_of_a_document_with_several_texts(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    a, passage = words("a", 70), words("p", 60)
    rows = [(1, a), (5, a), (5, f"{words('b', 8)} {passage}"), (9, f"z {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.n_words, r.first_doc_id, r.is_first) for r in suffix_dedup.repeated_spans(docs).collect())
    assert got == [(1, 0, 70, 1, True), (5, 0, 70, 1, False), (5, len(words("b", 8)) + 1, 60, 5, True), (9, 2, 60, 5, False)]
    assert suffix_dedup.repeated_spans(docs.limit(0)).collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = corpus_pipeline.stored(stage(spark, docs, SF), "test-stage")
        assert k == 4 or out.columns == names
        after = out.collect()
        if k == 1:
            want = brute.line_dedup([(i, r.text) for i, r in before.items()])
            assert {r.doc_id: r.text for r in after} == {i: t for i, t in want.items() if t == before[i].text or brute.words(t)} and all(r.n_chars == len(r.text) for r in after)
        elif k == 2:
            want = brute.jaccard_components([(i, r.text) for i, r in before.items()])
            assert {r.doc_id for r in after} == {i for i in before if want[i][1] == i}
        elif k == 4:
            assert len(after) == docs.count() and all(r.n_tokens == len(r.token_ids) // 4 for r in after)
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline

    clean = " ".join(f"Word{i} and more." for i in range(30))
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "a b\na b", None, "s", 7), (2, "w " * 50, "en", "s", 100), (3, clean, "en", "s", 1), (None, clean.replace("Word", "Term"), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("kept") for c in ("copies", "n_dropped", "key", "label", "row")})
    want = {"quality rules": {3, None}, "line dedup": {None, 1, 2, 3}, "n-gram Jaccard join": {None, 1, 2, 3}, "mixing sources to target weights": {1, 2, 3, None}, "BPE encoding and decoding": {None, 1, 2, 3}}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert {r.doc_id for r in rows} <= want[name] and ({3, None} <= {r.doc_id for r in rows} or name == "mixing sources to target weights"), name
        assert name.startswith("BPE") or out.columns == docs.columns and all(r.copies == r.row == r.n_dropped == "kept" for r in rows), name
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_quality_stage_keeps_what_the_verdict_keeps(spark):
    from lorekeep.llm import quality_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (None, "", "en", "s", 0), (1, "x " * 10, None, None, None)], docs.schema)
    mine = docs.unionByName(odd).withColumn("kept", F.lit("own"))
    kept = quality_rules.stage_quality(spark, mine, SF).collect()
    field = quality_rules.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = []
    for r in mine.collect():
        n, _, _, _, repeats = brute.base_counts(r.text)
        if n < 20 or 100 * repeats > 30 * n:
            continue
        for _, features, words, ptr in quality_rules.analyse(pa.array([r.text], pa.large_string())):
            states = best_states(field, features)
            if sum(w for w, s in zip(words, states, strict=True) if s) / n >= quality_rules.MIN_CONTENT_SHARE:
                want.append(r)
    key = lambda r: (r.doc_id or 0, r.text)
    assert sorted(kept, key=key) == sorted(want, key=key) and 0 < len(want) < mine.count()
    assert quality_rules.stage_quality(spark, mine.limit(0), SF).collect() == []


def best_states(field, features):
    """The best path of a chain by plain dynamic programming over all states, kept as whole paths."""
    emit, move = (features @ field.emit).tolist(), field.move.tolist()
    paths = [(emit[0][0], [0]), (emit[0][1], [1])] if emit else []
    for g in emit[1:]:
        paths = [max(((w + move[p[-1]][s] + g[s], [*p, s]) for w, p in paths), key=lambda x: x[0]) for s in (0, 1)]
    return max(paths, key=lambda x: x[0])[1] if paths else []


def test_suffix_hashes_use_the_whole_bitmap():
    """The retained suffixes have the least hashes of their windows, so these crowded into a small part of the bitmap and most bits of it were found set."""
    import numpy as np

    words = np.random.default_rng(5).integers(0, 1 << 63, 200_000).astype(np.uint64)
    _, hashes = suffix_dedup.minimisers(words, np.array([0, len(words)]))
    assert len(hashes) > 5_000 and 0.45 < float((hashes >> np.uint64(63)).mean()) < 0.55


def test_pairs_of_blocks_are_planned_once(spark, capsys):
    """As one plan the cuts of the families were made anew for each of their uses, which cost the driver memory."""
    rows = [(f, f * 100 + i, 10 + i % 3, 40) for f, size in ((1, 9), (2, 2)) for i in range(size)]
    found = shingle_join.in_blocks(spark.createDataFrame(rows, "lead long, id long, n long, reach long"), 4)
    blocks = found[0] if isinstance(found, tuple) else found
    capsys.readouterr()
    blocks.explain()
    assert capsys.readouterr().out.count("Exchange ") <= 12
    got = [tuple(r) for r in blocks.select("lead", "id", "x", "y", "side").collect()]
    assert sorted(r[1] for r in got if r[0] == 2) == [200, 201]
    pairs = {frozenset((a[1], b[1])) for a in got for b in got if a[0] == b[0] == 1 and a[2:4] == b[2:4] and (a[4] != b[4] or a[2] == a[3])}
    assert {frozenset((100 + i, 100 + j)) for i in range(9) for j in range(i)} <= pairs


def test_pages_of_bitmaps_travel_packed():
    """Pages without a place that occurs twice went to the driver too, and all of them at their full size."""
    import numpy as np

    places = np.array([5, 5, 9, (3 << 16) + 1], dtype=np.uint64) << np.uint64(64 - bitmaps.BITS)
    sent = [(page, bits) for b in bitmaps._twice(bitmaps.paged(iter([places]))) for page, bits in zip(b.column("page").to_pylist(), b.column("bits").to_pylist(), strict=True)]
    assert [page for page, _ in sent] == [0] and len(sent[0][1]) < 200
