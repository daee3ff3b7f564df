"""Aggregate and lint reports (survey A1-A4, A16, A20-A24, F19-F21, F23, P20, P21, T6)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import fold_tag_text
from ..functions.scalars import age_days, json_kind, word_count
from ..sources.scans import in_folder

#: Capitalised words that do not begin a phrase.
CONCEPT_STOPS = ("The", "A", "An", "This", "That", "These", "Those", "If", "When", "While", "But", "And", "Or")
QUESTION = r"(?i)^\s*(?:[-*+>]\s+|#{1,6}\s+|\d+\.\s+)*(?:open question\s*[:\-]|q:|todo\?|\?\?)\s+(\S.*)$"


def tag_counts(tags: DataFrame, min_count: int = 1, limit: int = 200) -> DataFrame:
    """Notes of each folded tag, split into those with it in front matter and those with it only in the text.

    ``tags``: path, tag_folded, origin.  One shuffle by (tag, note), then one by tag."""
    per_note = tags.groupBy("tag_folded", "path").agg(F.max(F.col("origin") == "frontmatter").alias("fm"))
    counts = per_note.groupBy(F.col("tag_folded").alias("tag")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("fm").cast("long")).alias("frontmatter"), F.sum((~F.col("fm")).cast("long")).alias("inline_only"))
    return counts.where(F.col("count") >= min_count).orderBy(F.desc("count"), "tag").limit(limit)


def key_inventory(notes: DataFrame, map_column: str = "frontmatter", min_count: int = 1) -> DataFrame:
    """Front-matter keys: notes, sorted value types, up to three distinct examples of 80 characters."""
    rows = notes.select("path", F.explode(map_column).alias("key", "value")).withColumn("key", F.lower("key"))
    counts = rows.groupBy("key").agg(F.count_distinct("path").alias("notes"), F.sort_array(F.collect_set(json_kind(F.col("value")))).alias("types")).where(F.col("notes") >= min_count)
    # Three examples by a ranked window, which Spark cuts before the shuffle: the values of a key are never collected.
    texts = rows.select("key", F.substring("value", 1, 80).alias("value")).where("value is not null").distinct()
    shown = texts.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("value"))).where("n <= 3").groupBy("key").agg(F.sort_array(F.collect_list("value")).alias("examples"))
    return counts.join(shown, "key", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def collection_stats(notes: DataFrame, now: Column, body: str = "body") -> DataFrame:
    """One row: notes, bytes, mean words, modified in the last week."""
    return notes.agg(
        F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("bytes"), F.coalesce(F.floor(F.avg(word_count(F.col(body))) + 0.5), F.lit(0)).alias("mean_words"),
        F.sum((F.col("mtime") >= now - F.expr("interval 7 days")).cast("long")).alias("modified_last_week"),
    )


def link_stats(notes: DataFrame, resolved: DataFrame, tags: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """Orphans, broken links and distinct tags as one row each, and the commonest tags (each spelling of a note counts)."""
    from .links import orphans

    return {
        "orphans": orphans(notes, resolved).agg(F.count(F.lit(1)).alias("n")), "broken": resolved.where("resolved is null and kind <> 'embed'").agg(F.count(F.lit(1)).alias("n")), "tags": tags.agg(F.count_distinct("tag_folded").alias("n")),
        "top_tags": tags.select("path", "tag", "tag_folded").distinct().groupBy("tag_folded").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "tag_folded").limit(top),
    }


def list_notes(notes: DataFrame, tag: str | None = None, since: Column | None = None, folder: str | None = None, limit: int = 50) -> DataFrame:
    rows = notes.where(in_folder(F.col("path"), folder))
    if tag:
        rows = rows.where(F.exists("tags", lambda t: F.lower(F.regexp_replace(t, "^#+", "")) == fold_tag_text(tag)))
    if since is not None:
        rows = rows.where(F.col("mtime") >= since)
    return rows.orderBy(F.desc("mtime"), "path").limit(limit).select("path", "title", "mtime")


def recent(notes: DataFrame, now: Column, minutes: int = 1440, limit: int = 20) -> DataFrame:
    return notes.where(F.col("mtime") >= now - F.make_interval(mins=F.lit(minutes))).orderBy(F.desc("mtime"), "path").limit(limit).select("path", "mtime")


def stale(notes: DataFrame, now: Column, days: int = 365, limit: int = 50) -> DataFrame:
    """Oldest first."""
    return notes.withColumn("age_days", age_days(F.col("mtime"), now)).where(F.col("age_days") >= days).orderBy(F.desc("age_days"), "path").limit(limit).select("path", "age_days")


def phrases(notes: DataFrame, body: str = "body", most: int = 30) -> DataFrame:
    """(path, phrase): runs of one to three capitalised words, the first ``most`` distinct ones of a note."""
    found = F.expr(rf"regexp_extract_all({body}, '(?<![A-Za-z0-9_])([A-Z][a-z][a-z]+(?:\\s+[A-Z][a-z][a-z]+){{0,2}})(?![A-Za-z0-9_])', 1)")
    clean = F.filter(F.transform(found, lambda p: F.regexp_replace(p, r"\s+", " ")), lambda p: ~F.element_at(F.split(p, " "), 1).isin(*CONCEPT_STOPS))
    return notes.select("path", F.explode(F.slice(F.array_distinct(clean), 1, most)).alias("phrase"))


def concepts(notes: DataFrame, min_mentions: int = 3, limit: int = 50) -> DataFrame:
    """Phrases of several notes that no note is named after."""
    titles = notes.select(F.lower("title").alias("low"))
    found = phrases(notes).withColumn("low", F.lower("phrase")).join(titles, "low", "left_anti")
    return found.groupBy("phrase").agg(F.count_distinct("path").alias("mentions")).where(F.col("mentions") >= min_mentions).orderBy(F.desc("mentions"), "phrase").limit(limit)


def lint(notes: DataFrame, resolved: DataFrame, now: Column, stub_words: int = 100, stale_days: int = 365, min_mentions: int = 3, most: int = 50) -> dict[str, DataFrame]:
    """Five lists of findings, each at most ``most`` long."""
    from .links import orphans

    reviewed = F.coalesce(*[F.col("frontmatter").getItem(k) for k in ("last_reviewed", "last-reviewed")]) if "frontmatter" in notes.columns else F.lit(None).cast("string")
    touched = F.coalesce(F.try_to_timestamp(F.regexp_replace(reviewed, '"', "")), F.col("mtime"))
    words = word_count(F.col("body"))
    return {
        "orphans": orphans(notes, resolved).orderBy("path").limit(most),
        "broken": resolved.where("resolved is null and kind <> 'embed'").orderBy("path", "ord").limit(most).select("path", "raw", "target"),
        "stubs": notes.withColumn("word_count", words).where(F.col("word_count") < stub_words).orderBy("path").limit(most).select("path", "word_count"),
        "stale": notes.withColumn("age_days", age_days(touched, now)).where(F.col("age_days") >= stale_days).orderBy("path").limit(most).select("path", "age_days"),
        "concepts": concepts(notes, min_mentions, most),
    }


def check_pattern(pattern: str) -> str:
    """Refuses patterns whose repetition can nest or overlap without bound."""
    from re import _constants as C
    from re import _parser

    repeats = (C.MAX_REPEAT, C.MIN_REPEAT)

    def inner(op, arg) -> list:
        """The sequences inside an item."""
        if op in (*repeats, C.POSSESSIVE_REPEAT):
            return [arg[2]]
        if op == C.SUBPATTERN:
            return [arg[-1]]
        if op == C.BRANCH:
            return list(arg[1])
        if op in (C.ASSERT, C.ASSERT_NOT):
            return [arg[1]]
        return [arg] if op == C.ATOMIC_GROUP else []

    def wide(op, arg) -> bool:
        return op in repeats and arg[1] == C.MAXREPEAT

    def varies(sequence) -> bool:
        """Whether one text can be matched in several ways: a repetition of open length, or a choice, at any depth."""
        return any(op == C.BRANCH or op in repeats and arg[0] != arg[1] or any(map(varies, inner(op, arg))) for op, arg in sequence)

    def look(sequence) -> None:
        last = None
        for op, arg in sequence:
            if op in (C.GROUPREF, C.GROUPREF_EXISTS) or op in repeats and (arg[1] == C.MAXREPEAT or arg[1] > 8) and varies(arg[2]):
                raise ValueError("pattern may backtrack without bound")
            if wide(op, arg):
                now = repr(arg[2])
                if last is not None and (last == now or "ANY" in last + now):
                    raise ValueError("pattern may backtrack without bound")
                last = now
            elif not (op in repeats and arg[0] == 0):  # what may be empty keeps two repetitions beside each other
                last = None
            for part in inner(op, arg):
                look(part)

    look(_parser.parse(pattern))
    if re.search(r"\([^()]*\|[^()]*\)\s*[*+{]", pattern):  # the parser makes a class of a choice of single characters, Java's does not
        raise ValueError("pattern may backtrack without bound")
    return pattern


def linear_pattern(pattern: str) -> str:
    """The pattern, if it has a linear-time automaton: no references to groups, no looking around, no huge counted repetition."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid as e:
        raise ValueError(f"not a pattern for linear-time matching: {e}") from None
    return pattern


def matching(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """The rows whose ``column`` holds the pattern, by RE2 automata: time is linear in the text whatever the pattern, which users may choose freely.

    A null text holds nothing; ``\\w`` and the like are ASCII, as in Java."""
    linear_pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.fill_null(pc.match_substring_regex(b.column(column), pattern), False))

    return rows.mapInArrow(run, rows.schema)


def open_questions(lines: DataFrame, notes: DataFrame, now: Column, pattern: str | None = None, limit: int = 100) -> DataFrame:
    """Lines that pose a question, under their current heading, oldest notes first; a pattern of the caller's own is matched in linear time."""
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    carried = lines.withColumn("heading", F.last("heading_text", ignorenulls=True).over(order)).where(~F.col("in_fence"))
    carried = carried.where(F.col("text").rlike(QUESTION)) if pattern is None else matching(carried, "text", pattern)
    question = F.trim(F.regexp_extract("text", QUESTION, 1)) if pattern is None else F.trim("text")
    dated = carried.select("path", "line", "heading", question.alias("question")).join(notes.select("path", "mtime"), "path")
    return dated.withColumn("age_days", age_days(F.col("mtime"), now)).orderBy("mtime", "path", "line").limit(limit).select("path", "line", "heading", "question", "age_days")


def identifiers(body: Column) -> Column:
    """struct(arxiv, doi, url): distinct identifiers, at most three addresses.  The patterns are fixed values."""
    text = lambda p: F.array_distinct(F.regexp_extract_all(body, F.lit(p), F.lit(1)))
    return F.struct(
        text(r"(?i)\barxiv[:\s]*([0-9]{4}\.[0-9]{4,5}(?:v\d+)?)\b").alias("arxiv"), text(r"(?i)\bdoi[:\s]*(10\.\d{4,9}/[\w\-._;()/:]+)").alias("doi"), F.slice(text(r"\b(https?://[^\s<>\")\]]+)"), 1, 3).alias("url"),
    )


def paper_audit(notes: DataFrame, tag: str = "paper", limit: int = 100) -> DataFrame:
    """Tagged notes without a citation key, with the identifiers their text has."""
    tagged = F.exists("tags", lambda t: F.lower(F.regexp_replace(t, "^#+", "")) == fold_tag_text(tag))
    cited = F.exists(F.map_keys("frontmatter"), lambda k: F.lower(k).isin("arxiv", "doi", "url", "isbn"))
    return notes.where(tagged & ~cited).orderBy("path").limit(limit).select("path", identifiers(F.col("body")).alias("found"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One SHA-256 over all rows, whatever their order: the hashes of rows are added up, in pieces of 48 bits, with their number."""
    own = rows.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))
    pieces = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(5)]
    return own.agg(F.sha2(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *pieces), 256).alias("fingerprint"))


def audit(declared: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose declared number of chunks differs from the indexed one."""
    counts = indexed.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("found"))
    both = declared.select("path", "kind", F.col("n_chunks").alias("declared")).join(counts, ["path", "kind"], "full_outer")
    return both.select("path", "kind", F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("found", F.lit(0)).alias("found")).where("declared <> found")
