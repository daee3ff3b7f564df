"""Hybrid search, multi-query search and context packs (survey R8, R11-R13, R18-R22, R25, R26, T11, F17).

Signals run as one plan each and are fused by rank.  A signal that cannot run (no index, no vectors) is reported
and left out.  Filters on fields and on the number of signals come after fusion and its overshoot, so
fewer than ``limit`` rows may be left; ``exact_filter`` applies the filter before instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periodic import resolve_alias
from ..functions.scalars import age_days, normalise_query, snippet
from ..operators import fusion, links, retrieval
from ..operators.predicates import Literal, hybrid_filter
from ..sources.scans import in_folder
from .dql import Resolver, resolver

STRICT, RELAXED = 0.05, 0.01


@dataclass
class Corpus:
    """Tables of a collection; an index that is missing turns its signal off."""

    notes: DataFrame  # path, title, body, mtime, tags, ...
    edges: DataFrame | None = None  # src, dst
    chunks: DataFrame | None = None  # path, chunk_index, content, title, aliases, parts
    postings: DataFrame | None = None
    lengths: DataFrame | None = None
    tfidf: DataFrame | None = None
    terms: DataFrame | None = None
    vectors: DataFrame | None = None  # id, path, chunk_index, vector
    feedback: DataFrame | None = None  # path, useful, not_useful
    embed: object = None  # text -> list of numbers

    def with_indexes(self) -> Corpus:
        if self.chunks is not None and self.postings is None:
            self.postings, self.lengths = retrieval.bm25_index(self.chunks)
        if self.tfidf is None:
            self.tfidf, self.terms = retrieval.tfidf_index(self.notes)
        return self


@dataclass
class Options:
    limit: int = 10
    folder: str | None = None
    min_signals: int = 1
    granularity: str = "note"
    graph_boost: bool = True
    fields: dict[str, Literal | list] | None = None
    exact_filter: bool = False
    recency_weight: float = 0.0
    feedback_weight: float = 0.0
    half_life: float = 365.0
    hypothetical: str | None = None
    scorer: object = None
    now: datetime | None = None


@dataclass
class Result:
    hits: DataFrame
    signals: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)
    reranked: bool = False


def _note_or_block(path: Column, chunk: Column, granularity: str) -> Column:
    return F.concat(path, F.lit("#"), chunk.cast("string")) if granularity == "block" else path


def _field_condition(notes: DataFrame, wanted: dict, find: Resolver) -> Column:
    keep = F.lit(True)
    for key, value in wanted.items():
        found = find(key)
        keep = keep & (hybrid_filter(found, value) if found else F.lit(False))
    return keep


def _signals(corpus: Corpus, query: str, options: Options, floor: float) -> tuple[DataFrame | None, list[str], dict[str, str]]:
    fan = max(50, 5 * options.limit)
    notes = corpus.notes.where(in_folder(F.col("path"), options.folder))
    if options.fields and options.exact_filter:
        notes = notes.where(_field_condition(notes, options.fields, resolver(notes)))
    scope = notes.select("path")
    lists, used, errors = [], [], {}

    def add(name: str, make) -> None:
        try:
            hits = make().withColumn("query_id", F.lit(query))
        except Exception as e:  # noqa: BLE001  one signal's failure must not end the search
            errors[name] = str(e)[:200]
            return
        lists.append(fusion.ranks(hits.select("query_id", "id", "score"), name))
        used.append(name)

    def full_text() -> DataFrame:
        found = retrieval.bm25_search(corpus.postings, corpus.lengths, query, fan, scope=corpus.lengths.select("path", "chunk_index").join(scope, "path", "left_semi"))
        filled = retrieval.fill_with_parts(found, corpus.chunks.join(scope, "path", "left_semi"), query, fan) if corpus.chunks is not None else found
        return filled.groupBy(_note_or_block(F.col("path"), F.col("chunk_index"), options.granularity).alias("id")).agg(F.max("score").alias("score"))

    def words() -> DataFrame:
        own = corpus.tfidf.join(scope.withColumnRenamed("path", "doc"), "doc", "left_semi")
        found = retrieval.tfidf_search(own, corpus.terms, query, fan, floor)
        if options.granularity == "block" and corpus.chunks is not None:  # a note's score belongs to each of its blocks
            blocks = corpus.chunks.select(F.col("path").alias("doc"), "chunk_index")
            return found.join(blocks, "doc").select(F.concat("doc", F.lit("#"), F.col("chunk_index").cast("string")).alias("id"), "score")
        return found.select((F.concat("doc", F.lit("#0")) if options.granularity == "block" else F.col("doc")).alias("id"), "score")

    def near() -> DataFrame:
        q = corpus.embed(options.hypothetical or query)
        found = retrieval.vector_search(corpus.vectors.join(scope, "path", "left_semi"), q, 2 * fan, 0.3).join(corpus.vectors.select("id", "path", "chunk_index"), "id")
        return found.groupBy(_note_or_block(F.col("path"), F.col("chunk_index"), options.granularity).alias("id")).agg(F.max("score").alias("score"))

    if corpus.postings is not None:
        add("bm25", full_text)
    if corpus.tfidf is not None:
        add("tfidf", words)
    if corpus.vectors is not None and corpus.embed is not None:
        add("vector", near)
    every = None
    for x in lists:
        every = x if every is None else every.unionByName(x)
    return every, used, errors


def hybrid(corpus: Corpus, query: str, options: Options | None = None) -> Result:
    """One query; a strict pass, and a relaxed one if it finds nothing and no signal failed."""
    options = options or Options()
    query = normalise_query(query)
    ranked, used, errors = _signals(corpus, query, options, STRICT)
    if ranked is not None and not errors and not ranked.limit(1).count():
        ranked, used, errors = _signals(corpus, query, options, RELAXED)
    if ranked is None:
        return Result(corpus.notes.limit(0).select(F.col("path").alias("id"), F.lit(0.0).alias("score")), used, errors)
    return Result(_finish(corpus, fusion.rrf(ranked), options, query), used, errors, options.scorer is not None)


def _finish(corpus: Corpus, fused: DataFrame, options: Options, query: str) -> DataFrame:
    now = F.lit(options.now).cast("timestamp") if options.now else F.current_timestamp()
    path = F.split("id", "#")[0] if options.granularity == "block" else F.col("id")
    over = fusion.overshoot(fused.join(corpus.notes.select(F.col("path").alias("live")), path == F.col("live"), "left_semi"), options.limit)
    if options.graph_boost and corpus.edges is not None and options.granularity == "note":
        over = fusion.in_degree_tie_break(over.drop("pos"), corpus.edges)
    if options.scorer is not None:
        # What the scorer reads is the text around the first word of the query that the note has, its beginning if it has none.
        places = [F.nullif(F.locate(w, F.lower("body")), F.lit(0)) for w in dict.fromkeys(query.lower().split())]
        at = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1)) if places else F.lit(1)
        passages = over.select("query_id", "id").join(corpus.notes.select(F.col("path").alias("id"), snippet(F.col("body"), at, F.lit(1), 300).alias("passage")), "id", "left").withColumn("query_text", F.lit(query))
        over = fusion.rerank(over, options.scorer, passages)
    ages = corpus.notes.select(F.col("path").alias("id"), age_days(F.col("mtime"), now).alias("age_days"))
    if options.recency_weight > 0:
        over = fusion.recency_blend(over, ages, options.recency_weight, options.half_life).drop("age_days")
    if options.feedback_weight > 0 and corpus.feedback is not None:
        over = fusion.feedback_blend(over, corpus.feedback.withColumnRenamed("path", "id"), options.feedback_weight).drop("useful", "not_useful")
    if options.fields and not options.exact_filter:
        keep = corpus.notes.where(_field_condition(corpus.notes, options.fields, resolver(corpus.notes))).select(F.col("path").alias("id"))
        over = over.join(keep, "id", "left_semi")
    out = fusion.final(over, options.limit, options.min_signals)
    return out.join(ages, "id", "left").withColumn("stale", F.col("age_days") >= 365).orderBy("rank")


def hybrid_multi(corpus: Corpus, queries: list[str], options: Options | None = None) -> Result:
    """Up to eight queries, fused over their lists; the best score of a note is kept."""
    options = options or Options()
    asked = list(dict.fromkeys(q for q in map(normalise_query, queries) if q))
    if len(asked) > 8:
        raise ValueError(f"{len(asked)} queries: at most eight are fused")
    each = Options(**{**options.__dict__, "limit": min(100, max(3 * options.limit, 30))})
    results = [hybrid(corpus, q, each) for q in asked]
    lists = None
    for q, r in zip(asked, results, strict=True):
        rows = r.hits.select("id", F.lit(q).alias("query"), *([F.col("rank")] if "rank" in r.hits.columns else [F.lit(1).alias("rank")]), "score")
        lists = rows if lists is None else lists.unionByName(rows)
    hits = fusion.multi_query(lists, options.limit).select("id", F.col("best_score").alias("score"), F.col("rrf"))
    return Result(hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rrf"), "id"))), sorted({s for r in results for s in r.signals}), {k: v for r in results for k, v in r.errors.items()})


def context_pack(corpus: Corpus, query: str, subqueries: tuple[str, ...] = (), budget_tokens: int = 4000, backlinks: bool = True, dailies: int = 0, options: Options | None = None) -> dict:
    """Text for a reader: best notes cut to a budget of four characters a token, backlinks of the first three, recent dailies.

    Each note gets at most half of what is left (500 characters at least).  Only about ten short rows come to the driver."""
    options = options or Options()
    lists = [[r.id for r in hybrid(corpus, q, options).hits.orderBy("rank").collect()] for q in (query, *subqueries)]
    fused = list(dict.fromkeys(h for hits in zip(*[x + [None] * max(0, options.limit - len(x)) for x in lists], strict=False) for h in hits if h))
    chosen = fusion.select_evidence(lists, fused, options.limit)
    budget, used, parts, included = 4 * budget_tokens, 0, [f"# Context: {query}", "## Top notes"], []
    bodies = {r.path: r.body for r in corpus.notes.where(F.col("path").isin(chosen)).select("path", F.substring("body", 1, budget).alias("body")).collect()} if chosen else {}
    for path in chosen:
        if used >= budget or path not in bodies:
            continue
        body = bodies[path].strip()
        room = min(len(body), max(500, (budget - used) // 2))
        block = f"### {path}\n\n{body if len(body) <= room else body[:room] + ' …'}\n"
        parts.append(block)
        used += len(block)
        included.append(path)
    if backlinks and corpus.edges is not None and included and used < budget:
        rows = corpus.edges.where(F.col("dst").isin(included[:3])).groupBy("dst").agg(F.slice(F.sort_array(F.collect_set("src")), 1, 5).alias("src")).collect()
        parts.append("## Backlinks")
        parts += [f"- {r.dst} ← {', '.join(r.src)}" for r in sorted(rows, key=lambda r: r.dst)]
    if dailies:
        recent = corpus.notes.where(F.col("title").rlike(r"^\d{4}-\d\d-\d\d$")).orderBy(F.desc("title")).limit(dailies).select("path", F.substring("body", 1, 500).alias("body")).collect()
        parts.append("## Recent dailies")
        parts += [f"### {r.path}\n\n{r.body.strip()}" for r in recent]
    text = "\n".join(parts)
    return {"text": text, "notes": included, "tokens": -(-len(text) // 4), "queries": [query, *subqueries]}


def resolve_target(notes: DataFrame, path: str | None = None, title: str | None = None, strict: bool = False, now: datetime | None = None) -> dict:
    """A note by path (with or without suffix), title or periodic alias; else up to three suggestions."""
    want = (path or title or "").strip().strip("/")
    exact = [r.path for r in notes.where(F.lower("path").isin(want.lower(), want.lower() + ".md")).select("path").orderBy("path").limit(2).collect()] if path or not title else []
    named = exact or [r.path for r in notes.where(F.lower("title") == want.rsplit("/", 1)[-1].lower()).select("path").orderBy("path").limit(10).collect()]
    if not named and (alias := resolve_alias(want, now or datetime.now())):
        named = [r.path for r in notes.where(F.lower("path") == f"{alias[1]}.md".lower()).select("path").limit(1).collect()]
    if len(named) > 1 and strict:
        raise ValueError(f"{want!r} names several notes: {named}")
    return {"path": named[0]} if named else {"path": None, "suggestions": [r.path for r in links.suggestions(notes, want).collect()]}
