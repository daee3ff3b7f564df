"""Mutations as pure functions: a table of notes in, a new snapshot and a report of changes out (survey K1-K9).

A note is (path, content).  Nothing is written here; the caller stores the snapshot, which replaces the old one at once.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.markdown import Fence, compose, links, mask_code, split_front_matter, split_lines
from .links import resolve


def create(notes: DataFrame, path: str, body: str, front_matter: dict | None = None, overwrite: bool = False) -> DataFrame:
    taken = notes.where(F.col("path") == path)
    if not overwrite and taken.limit(1).count():
        raise FileExistsError(path)
    row = notes.sparkSession.createDataFrame([(path, compose(front_matter or {}, body))], "path string, content string")
    return notes.select("path", "content").where(F.col("path") != path).unionByName(row)


def append(notes: DataFrame, path: str, text: str, separator: str = "\n\n") -> DataFrame:
    joined = F.concat(F.regexp_replace("content", r"\n+$", ""), F.lit(separator), F.lit(text))
    return notes.withColumn("content", F.when(F.col("path") == path, F.when(F.coalesce("content", F.lit("")) == "", F.lit(text)).otherwise(joined)).otherwise(F.col("content")))


def _outside_fences(content: str, change) -> tuple[str, int]:
    fence, out, total = Fence(), [], 0
    for line, end in split_lines(content):
        if not fence.step(line)[0]:
            line, n = change(line)
            total += n
        out.append(line + end)
    return "".join(out), total


def replace(notes: DataFrame, search: str, new: str, case_sensitive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Literal replacement outside fenced code; (snapshot, (path, count)).

    A text without any fence mark is changed by Spark's own ``replace`` where case counts; only the others go through Python."""
    if not search:
        raise ValueError("nothing to search for")
    pattern = re.compile(re.escape(search), 0 if case_sensitive else re.IGNORECASE)

    def run(batches):
        for pdf in batches:
            got = [_outside_fences(c or "", lambda line: pattern.subn(lambda _: new, line)) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "content": [g[0] for g in got], "count": [g[1] for g in got]})

    hit = F.col("content").contains(search) if case_sensitive else F.lower("content").contains(search.lower())
    plain = ~F.col("content").contains("```") & ~F.col("content").contains("~~~") if case_sensitive else F.lit(False)
    found = notes.where(hit).select("path", "content")
    changed = found.where(~plain).mapInPandas(run, "path string, content string, count long")
    without = F.length("content") - F.length(F.replace("content", F.lit(search), F.lit("")))
    swapped = found.where(plain).select("path", F.replace("content", F.lit(search), F.lit(new)).alias("content"), (without / len(search)).cast("long").alias("count"))
    every = swapped.unionByName(changed)
    rest = notes.where(~F.coalesce(hit, F.lit(False))).select("path", "content")
    return rest.unionByName(every.drop("count")), every.where("count > 0").select("path", "count")


def rewritten(raw: str, old: str, new: str) -> str:
    """A raw link with its target replaced: a bare one stays bare, a path-qualified one gets the new path."""
    m = re.fullmatch(r"(!?)\[\[([^\]#^|]*)([^\]]*)\]\]", raw)
    if not m:
        return raw
    had_suffix = m[2].strip().lower().endswith(".md")
    target = new if "/" in m[2] else new.rsplit("/", 1)[-1]
    return f"{m[1]}[[{target if had_suffix else re.sub(r'(?i)[.]md$', '', target)}{m[3]}]]"


def _spans(content: str) -> list[dict]:
    """The links of a note outside code, with their places in it."""
    body = split_front_matter(content)[1]
    offset = len(content) - len(body)
    return [{"ord": k, "at": offset + x["start"], "raw": x["raw"], "target": x["target"]} for k, x in enumerate(links(mask_code(body)))]


def rename(notes: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Moves a note and rewrites every link that resolves to it, where it stands; (snapshot, (path, raw, becomes)).

    A note that is already at the new path is never replaced."""
    there = {r.path for r in notes.where(F.col("path").isin(old, new)).select("path").distinct().collect()}
    if old not in there:
        raise FileNotFoundError(old)
    if new in there:
        raise FileExistsError(new)
    raw_links = "array<struct<ord:int,at:int,raw:string,target:string>>"

    def scan(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "links": [_spans(c or "") for c in pdf["content"]]})

    table = notes.select("path", "content").mapInPandas(scan, f"path string, links {raw_links}").select("path", F.explode("links").alias("l")).select("path", "l.ord", "l.at", "l.raw", "l.target")
    hits = resolve(table, notes.withColumn("title", F.col("path"))).where(F.col("resolved") == old).select("path", "at", "raw")
    grouped = hits.groupBy("path").agg(F.sort_array(F.collect_list("at")).alias("places"))

    def change(batches):
        for pdf in batches:
            out = []
            for content, places in zip(pdf["content"], pdf["places"], strict=True):
                wanted = set(places) if places is not None else set()
                for x in reversed(_spans(content) if wanted else []):
                    if x["at"] in wanted:
                        content = content[: x["at"]] + rewritten(x["raw"], old, new) + content[x["at"] + len(x["raw"]) :]
                out.append(content)
            yield pd.DataFrame({"path": [new if p == old else p for p in pdf["path"]], "content": out})

    snapshot = notes.select("path", "content").join(grouped, "path", "left").mapInPandas(change, "path string, content string")
    part = lambda k: F.regexp_extract("raw", r"^(!?)\[\[([^\]#^|]*)([^\]]*)\]\]$", k)
    target = F.when(part(2).contains("/"), F.lit(new)).otherwise(F.lit(new.rsplit("/", 1)[-1]))
    shown = F.when(F.lower(F.trim(part(2))).endswith(".md"), target).otherwise(F.regexp_replace(target, r"(?i)[.]md$", ""))
    becomes = F.concat(part(1), F.lit("[["), shown, part(3), F.lit("]]"))
    return snapshot, hits.select("path", "raw").distinct().withColumn("becomes", becomes)


def archive(notes: DataFrame, path: str, folder: str = "Archive") -> tuple[DataFrame, DataFrame]:
    return rename(notes, path, f"{folder.strip('/')}/{path.rsplit('/', 1)[-1]}")


def set_front_matter(notes: DataFrame, path: str, values: dict) -> tuple[DataFrame, DataFrame]:
    """Sets keys (null deletes); (snapshot, (path, changed)) with changes written +key, ~key, -key."""

    def run(batches):
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                data, body, _, valid = split_front_matter(content or "")
                if not valid:
                    raise ValueError("front matter is not valid YAML")
                marks, new = [], dict(data)
                for k, v in values.items():
                    if v is None:
                        if k in new:
                            marks.append(f"-{k}")
                            del new[k]
                    elif k not in new:
                        marks.append(f"+{k}")
                        new[k] = v
                    elif json.dumps(new[k]) != json.dumps(v):
                        marks.append(f"~{k}")
                        new[k] = v
                out.append((compose(new, body) if marks else content, marks))
            yield pd.DataFrame({"path": pdf["path"], "content": [o[0] for o in out], "changed": [o[1] for o in out]})

    done = notes.where(F.col("path") == path).select("path", "content").mapInPandas(run, "path string, content string, changed array<string>")
    return notes.where(F.col("path") != path).select("path", "content").unionByName(done.drop("changed")), done.select("path", "changed")


def map_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two (path, key, value) tables: + added, ~ changed, - removed."""
    both = before.withColumnRenamed("value", "old").join(after.withColumnRenamed("value", "new"), ["path", "key"], "full_outer")
    mark = F.when(F.col("old").isNull(), "+").when(F.col("new").isNull(), "-").when(F.col("old") != F.col("new"), "~")
    return both.withColumn("mark", mark).where("mark is not null").select("path", "key", "mark")


def append_chat(notes: DataFrame, path: str, role: str, content: str, when: str, title: str | None = None) -> DataFrame:
    """Appends a message block, under a new thread heading if a title is given."""
    head = f"## Chat: {title}\n\n" if title else ""
    return append(notes, path, f"{head}### {role} · {when}\n\n{content.strip()}\n")
