"""Parsing of Markdown notes (survey S6-S8, P1-P13, P16, P20, P21, K9).

The scanners that keep state (front matter, fences, code masking, chunking) are plain Python functions; they
run once per note at ingest, in Arrow batches, and what they yield is stored as columns.
"""

from __future__ import annotations

import bisect
import datetime as dt
import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fold import fold_text, nfc

try:
    import yaml
except ImportError:  # notes then have no front matter
    yaml = None

_EOL = re.compile("\r\n|[\n\r  ]")
_OPEN = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$", re.S)
_LINK_STOP = re.compile(r"\]|\r\n|[\r\n\u2028\u2029]")
_TAG = regex.compile(r"(?<![^\s(\[{>])#(\p{L}[\p{L}\p{N}\p{M}_/-]*)")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
MAX_CHUNK = 4096


def _plain(value):
    """YAML values as JSON values; dates become ISO text."""
    if isinstance(value, dict):
        return {nfc(str(k)): _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [_plain(v) for v in value]
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, str):
        return nfc(value)
    return value if isinstance(value, bool | int | float) or value is None else str(value)


def split_front_matter(source: str) -> tuple[dict, str, bool, bool]:
    """(data, body, coerced, valid): see S7; invalid YAML leaves the whole source as body."""
    text = source.removeprefix("﻿")
    first = re.match(r"---(\r\n|\n|\r|$)", text)
    if not first:
        return {}, text, False, True
    rest = text[first.end() :]
    closing = re.search(r"(?:^|(?<=\n)|(?<=\r))---(\r\n|\n|\r|$)(?<![^\r\n-])", rest)
    block, body = (rest[: closing.start()], rest[closing.end() :]) if closing else (rest, "")
    if yaml is None:
        return {}, text, False, False
    try:
        data = yaml.safe_load(block)
    except (yaml.YAMLError, ValueError):
        return {}, text, False, False
    if data is None:
        return {}, body, False, True
    if not isinstance(data, dict):
        return {}, body, True, True
    return _plain(data), body, False, True


def compose(data: dict, body: str) -> str:
    """A note's text from front matter and body; midnight dates are written as dates."""
    if not data or yaml is None:
        return body
    plain = {k: (v[:10] if isinstance(v, str) and re.fullmatch(r"\d{4}-\d\d-\d\dT00:00:00(\.0+)?(Z|\+00:00)?", v) else v) for k, v in data.items()}
    return f"---\n{yaml.safe_dump(plain, allow_unicode=True, sort_keys=False, default_flow_style=False)}---\n{body}"


class Fence:
    """Fence state over the lines of a text (P2)."""

    def __init__(self) -> None:
        self.mark: str | None = None

    def step(self, line: str) -> tuple[bool, bool]:
        """(inside a fence or a delimiter, is a delimiter)."""
        m = _OPEN.match(line)
        if self.mark is None:
            if m and not (m[1][0] == "`" and "`" in m[2]):
                self.mark = m[1]
                return True, True
            return False, False
        if m and m[1][0] == self.mark[0] and len(m[1]) >= len(self.mark) and not m[2].strip():
            self.mark = None
            return True, True
        return True, False


def split_lines(text: str) -> list[tuple[str, str]]:
    """(line, its line end)."""
    out, at = [], 0
    for m in _EOL.finditer(text):
        out.append((text[at : m.start()], m[0]))
        at = m.end()
    return [*out, (text[at:], "")]


def mask_code(text: str) -> str:
    """Code replaced by spaces, offsets kept (P1)."""
    fence, parts = Fence(), []
    for line, end in split_lines(text):
        parts.append((" " * len(line) if fence.step(line)[0] else line) + end)
    masked = "".join(parts)
    runs = []
    for m in re.finditer(r"(\\?)(`+)", masked):  # a back-slash takes the first back-tick of an opener
        runs.append((m.start(2), m.end(2), bool(m[1])))
    out, i = list(masked), 0
    by_length: dict[int, list[int]] = {}
    for k, (a, b, _) in enumerate(runs):
        by_length.setdefault(b - a, []).append(k)
    while i < len(runs):
        a, b, escaped = runs[i]
        start, size = (a + 1, b - a - 1) if escaped else (a, b - a)
        same = by_length.get(size, []) if size else []
        after = bisect.bisect_right(same, i)
        if after == len(same):
            i += 1
            continue
        closer = same[after]
        for p in range(start, runs[closer][1]):
            if out[p] not in "\r\n  ":
                out[p] = " "
        i = closer + 1
    return "".join(out)


def split_link(inner: str) -> dict[str, str | None]:
    """Alias after the first bar, then block after the first caret, then section after the first hash (P4)."""
    rest, bar, alias = inner.partition("|")
    rest, caret, block = rest.partition("^")
    target, mark, section = rest.partition("#")
    clean = lambda on, x: x.strip() if on and x.strip() else None
    return {"target": nfc(target.strip()), "section": clean(mark, section), "block": clean(caret, block), "alias": clean(bar, alias)}


def link_places(text: str) -> Iterator[tuple[int, int]]:
    """(begin of the opening brackets, end of the inner text) of each link, in one pass (P3).

    The first line end or closing bracket after an opener settles it: two brackets close a link and one does not; the search goes on behind what was found,
    and behind the first opening bracket of an empty link.  So every character is looked at twice at most, whatever is left open."""
    at = text.find("[[")
    while at >= 0:
        stop = _LINK_STOP.search(text, at + 2)
        if not stop:
            return
        end = stop.start()
        if stop[0] != "]":
            further = stop.end()
        elif end == at + 2:
            further = at + 1
        elif text.startswith("]]", end):
            yield at, end
            further = end + 2
        else:
            further = end + 1
        at = text.find("[[", further)


def links(masked: str) -> list[dict]:
    out = []
    for at, end in link_places(masked):
        embed, inner = masked[at - 1 : at] == "!", masked[at + 2 : end]
        start = at - embed
        if inner.strip():
            out.append({"kind": "embed" if embed else "wikilink", "raw": masked[start : end + 2], "start": start, **split_link(inner)})
    return out


def inline_tags(masked: str) -> list[str]:
    return list(dict.fromkeys(nfc(t) for t in _TAG.findall(masked)))


def folded_key(data: dict, *keys: str):
    """First non-null value of several keys; an exact key goes before a folded one."""
    for key in keys:
        hit = data[key] if key in data else next((v for k, v in data.items() if fold_text(str(k)) == fold_text(key)), None)
        if hit is not None:
            return hit
    return None


def front_matter_tags(data: dict) -> list[str]:
    found = folded_key(data, "tags", "tag")
    parts = [x for x in found if isinstance(x, str)] if isinstance(found, list) else re.split(r"[,\s]+", found) if isinstance(found, str) else []
    return [t for t in (nfc(p.strip().lstrip("#")) for p in parts) if t]


def aliases(data: dict) -> list[str]:
    out = []
    for key in ("aliases", "alias"):
        found = folded_key(data, key)
        out += [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, str)]
    return [a for a in dict.fromkeys(x.strip()[:256] for x in out) if a][:64]


def line_table(body: str) -> list[dict]:
    """Lines with fence state, heading and breadcrumb (P9)."""
    fence, stack, out = Fence(), [], []
    for number, (text, _) in enumerate(split_lines(body), 1):
        inside, _delimiter = fence.step(text)
        m = None if inside else _HEADING.match(text)
        level = title = None
        if m:
            level, title = len(m[1]), re.sub(r"[ \t]+#+$|^#+$", "", m[2] or "").strip()
            stack = [*stack[: level - 1], title] if len(stack) >= level - 1 else [*stack, title]
        out.append({"line": number, "text": text, "in_fence": inside, "heading_level": level, "heading_text": title, "breadcrumb": list(stack)})
    return out


def chunks(body: str, most: int = MAX_CHUNK) -> list[dict]:
    """Paragraphs between empty lines; long ones packed line by line; a longer line is cut (P10)."""
    rows, out, group = line_table(body), [], []

    def add(text: str, first: dict, last: dict) -> None:
        if text.strip():
            out.append({"chunk_index": len(out), "line_start": first["line"], "line_end": last["line"], "text": text, "breadcrumb": " > ".join(x for x in first["breadcrumb"] if x)})

    def flush() -> None:
        if not group:
            return
        whole = "\n".join(r["text"] for r in group)
        if len(whole) <= most:
            add(whole, group[0], group[-1])
        else:
            held: list[dict] = []
            size = 0
            for r in group:
                if len(r["text"]) > most:
                    if held:
                        add("\n".join(x["text"] for x in held), held[0], held[-1])
                        held, size = [], 0
                    for at in range(0, len(r["text"]), most):
                        add(r["text"][at : at + most], r, r)
                    continue
                if held and size + 1 + len(r["text"]) > most:
                    add("\n".join(x["text"] for x in held), held[0], held[-1])
                    held, size = [], 0
                held.append(r)
                size += len(r["text"]) + (1 if len(held) > 1 else 0)
            if held:
                add("\n".join(x["text"] for x in held), held[0], held[-1])
        group.clear()

    for r in rows:
        if r["text"] == "":
            flush()
        else:
            group.append(r)
    flush()
    return out


def enriched(note: dict) -> list[dict]:
    """Chunks with their section prefix; the first also with link targets, title and aliases (P11)."""
    out = []
    for c in note["chunks"]:
        text = f"[section: {c['breadcrumb']}]\n{c['text']}" if c["breadcrumb"] else c["text"]
        first = c["chunk_index"] == 0
        targets = list(dict.fromkeys(x["target"] for x in note["links"] if x["target"]))
        if first and targets:
            text += f"\n[wikilink_targets: {', '.join(targets)}]"
        out.append({**c, "content": text, "title": note["title"] if first else "", "aliases": " ".join(note["aliases"]) if first else ""})
    return out


_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PART = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+|[\p{Lo}\p{Lm}]+")


def identifier_parts(text: str, most: int = 256) -> list[str]:
    """Parts of camelCase and letter-digit words (P12); a word that does not split gives nothing."""
    out: dict[str, None] = {}
    for word in _WORD.findall(text):
        parts = _PART.findall(word)
        if len(parts) > 1:
            out.update(dict.fromkeys(p.lower() for p in parts if 2 <= len(p) <= 64))
    return list(out)[:most]


def parse_note(path: str, source: str) -> dict:
    data, body, coerced, _ = split_front_matter(source)
    masked = mask_code(body)
    found = links(masked)
    own = front_matter_tags(data)
    in_text = inline_tags(masked)
    title = re.sub(r"(?i)\.md$", "", path.rsplit("/", 1)[-1])
    return {
        "title": title, "frontmatter": {k: json.dumps(v, ensure_ascii=False, separators=(",", ":")) for k, v in data.items()}, "coerced": coerced, "body": body,
        "body_start_line": len(split_lines(source)) - len(split_lines(body)) + 1, "links": found, "fm_tags": own, "inline_tags": in_text, "tags": list(dict.fromkeys([*own, *in_text])),
        "aliases": aliases(data), "lines": line_table(body), "chunks": chunks(body),
    }


_LINKS = "array<struct<kind:string,raw:string,target:string,section:string,block:string,alias:string>>"
NOTE_COLUMNS = (
    "path string, basename string, folder string, mtime timestamp, size long, title string, body string, body_start_line int, coerced boolean, frontmatter map<string,string>, "
    f"links {_LINKS}, fm_tags array<string>, inline_tags array<string>, tags array<string>, aliases array<string>, "
    "lines array<struct<line:int,text:string,in_fence:boolean,heading_level:int,heading_text:string,breadcrumb:array<string>>>, "
    "chunks array<struct<chunk_index:int,line_start:int,line_end:int,text:string,breadcrumb:string,content:string,title:string,aliases:string,parts:array<string>>>"
)


def notes(files: DataFrame) -> DataFrame:
    """Parsed notes of a table (path, mtime, content) of texts, one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, mtime, content in zip(pdf["path"], pdf["mtime"], pdf["content"], strict=True):
                content = content or ""
                n = parse_note(path, content)
                cs = [{**c, "parts": identifier_parts(c["content"])} for c in enriched(n)]
                rows.append({
                    "path": nfc(path), "basename": path.rsplit("/", 1)[-1], "folder": path.rpartition("/")[0], "mtime": mtime, "size": len(content.encode()), "title": nfc(n["title"]), "body": n["body"], "body_start_line": n["body_start_line"],
                    "coerced": n["coerced"], "frontmatter": n["frontmatter"], "links": [{k: x[k] for k in ("kind", "raw", "target", "section", "block", "alias")} for x in n["links"]], "fm_tags": n["fm_tags"],
                    "inline_tags": n["inline_tags"], "tags": n["tags"], "aliases": n["aliases"], "lines": n["lines"], "chunks": cs,
                })
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in re.split(r", (?=[a-z_]+ (?:string|timestamp|long|int|boolean|map|array))", NOTE_COLUMNS)])

    return files.select("path", "mtime", "content").mapInPandas(run, NOTE_COLUMNS)


def link_table(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.posexplode("links").alias("ord", "link")).select("path", "ord", "link.*")


def tag_table(parsed: DataFrame) -> DataFrame:
    """One row for each note and folded tag, with where it stands."""
    every = parsed.select("path", F.explode("fm_tags").alias("tag"), F.lit("frontmatter").alias("origin")).unionByName(parsed.select("path", F.explode("inline_tags").alias("tag"), F.lit("inline").alias("origin")))
    return every.withColumn("tag_folded", F.lower("tag"))


def line_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("lines").alias("l")).select("path", "l.*")


def chunk_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "tags", F.explode("chunks").alias("c")).select("path", "tags", "c.*").withColumn("kind", F.lit("md"))


_CHAT_TITLE, _CHAT_MESSAGE = re.compile(r"^##\s+Chat:\s*(.*)$"), re.compile(r"^###\s+(\S+)\s+·\s+(.+)$")


def chat_messages(lines: DataFrame) -> DataFrame:
    """Messages of chat notes (P16, W6): runs of lines from one message heading to the next marker."""
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("line")
    head = F.regexp_extract("text", r"^###\s+(\S+)\s+·\s+(.+)$", 1)
    title = F.regexp_extract("text", r"^##\s+Chat:\s*(.*)$", 1)
    is_title = F.col("text").rlike(r"^##\s+Chat:") & ~F.col("in_fence")
    is_message = (head != "") & ~F.col("in_fence")
    marked = lines.withColumn("is_title", is_title).withColumn("is_message", is_message)
    run = marked.withColumn("thread", F.sum(F.col("is_title").cast("int")).over(order)).withColumn("island", F.sum((F.col("is_title") | F.col("is_message")).cast("int")).over(order))
    run = run.withColumn("thread_title", F.last(F.when(F.col("is_title"), title), ignorenulls=True).over(order))
    grouped = run.where("thread >= 1").groupBy("path", "thread", "thread_title", "island").agg(
        F.max(F.when(F.col("is_message"), head)).alias("role"), F.max(F.when(F.col("is_message"), F.trim(F.regexp_extract("text", r"^###\s+(\S+)\s+·\s+(.+)$", 2)))).alias("timestamp"),
        F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.sort_array(F.collect_list(F.when(~F.col("is_message") & ~F.col("is_title"), F.struct("line", "text")))).alias("rest"),
    )
    return grouped.where("role is not null").select("path", "thread", "thread_title", "role", "timestamp", "line_start", "line_end", F.regexp_replace(F.array_join(F.col("rest")["text"], "\n"), r"^\s+|\s+$", "").alias("content"))
