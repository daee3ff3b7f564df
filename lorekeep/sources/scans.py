"""Scans of folders of files (survey S1-S5, S9-S11, S14, S18, S19, F22, T8, T10)."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links

try:
    import yaml
except ImportError:
    yaml = None

MAX_FILES = 100_000


def glob_regex(glob: str) -> str:
    """Anchored pattern of a glob: ``*`` without slash, ``**`` anything, ``?`` one character without slash."""
    parts = re.split(r"(\*\*/?|\*|\?)", glob)
    return "^" + "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.sub(r"([\\.\[\]{}()+^$|])", r"\\\1", p)) for p in parts) + "$"


def visible(path: Column, allow: tuple[str, ...] = (), deny: tuple[str, ...] = ()) -> Column:
    """No hidden segment, some allowed glob (if any are given), no denied one."""
    keep = ~path.rlike(r"(^|/)\.")
    if allow:
        keep &= path.rlike("|".join(map(glob_regex, allow)))
    if deny:
        keep &= ~path.rlike("|".join(map(glob_regex, deny)))
    return keep


def in_folder(path: Column, folder: str | None) -> Column:
    """Whole path segments: ``a/b`` holds ``a/b/c.md`` and not ``a/bc.md``."""
    folder = (folder or "").strip("/")
    return path.startswith(folder + "/") if folder else F.lit(True)


def below(root: str, path: Column) -> Column:
    """The path of a file relative to the folder that was read, decoded."""
    base = root.rstrip("/").split("://")[-1].removeprefix("file:").lstrip("/")
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^.*?" + re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", base) + "/", "")


def files(spark: SparkSession, root: str, extension: str = "md", folder: str | None = None, allow: tuple[str, ...] = (), deny: tuple[str, ...] = ()) -> DataFrame:
    """(path, mtime, size, content) of the files below root with an extension; content is binary and is read only where selected."""
    base = root.rstrip("/")
    where = f"{base}/{folder.strip('/')}" if folder else base
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*" if extension == "*" else f"*.{extension}").option("recursiveFileLookup", "true").load(where)
    rows = raw.select(below(base, F.col("path")).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    return rows.where(visible(F.col("path"), allow, deny))


def texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content", F.decode("content", "UTF-8"))


def bounded(rows: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """The same rows, or an error if there are more than ``most``: never a silent prefix."""
    n = rows.select(F.lit(1)).limit(most + 1).count()
    if n > most:
        raise ValueError(f"listing is incomplete: more than {most} files")
    return rows


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...], max_files: int = MAX_FILES, max_visited: int = 10 * MAX_FILES, folder: str | None = None, allow: tuple[str, ...] = (), deny: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
    """(path, mtime, size) of the first ``max_files`` files with one of the extensions, in path order, and a receipt: how many entries were visited, at most
    ``max_visited`` being counted, and whether the listing is complete.  Names only are read, no contents; a folder that is not there is empty and complete."""
    if max_files < 1 or max_visited < 1 or not extensions or not all(re.fullmatch(r"\.?[A-Za-z0-9]+", e) for e in extensions):
        raise ValueError("bounds must be positive, extensions letters and digits")
    try:
        every = files(spark, root, "*", folder, allow, deny).select("path", "mtime", "size")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, mtime timestamp, size long"), {"visited": 0, "complete": True}
    wanted = every.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    visited = every.limit(max_visited + 1).count()
    many = wanted.limit(max_files + 1).count()
    return wanted.orderBy("path").limit(max_files), {"visited": min(visited, max_visited), "complete": visited <= max_visited and many <= max_files}


def page(rows: DataFrame, limit: int, after: str | None = None) -> DataFrame:
    """Keyset page in order of path, with ``has_more`` on each row."""
    later = rows.where(F.col("path") > after) if after is not None else rows
    some = later.orderBy("path").limit(limit + 1)
    n = some.agg(F.count(F.lit(1)).alias("n"))
    return some.orderBy("path").limit(limit).crossJoin(F.broadcast(n)).withColumn("has_more", F.col("n") > limit).drop("n")


CANVAS = (
    "nodes array<struct<id:string,type:string,x:double,y:double,width:double,height:double,text:string,file:string,url:string,label:string,color:string,subpath:string>>, "
    "edges array<struct<id:string,fromNode:string,toNode:string,fromSide:string,toSide:string,label:string,color:string>>"
)


def canvases(rows: DataFrame, limit: int = 100) -> DataFrame:
    """Newest first, with node and edge counts; a malformed one counts 0."""
    parsed = rows.withColumn("canvas", F.from_json("content", CANVAS))
    count = lambda c: F.greatest(F.coalesce(F.size(F.col(c)), F.lit(0)), F.lit(0)).cast("int")
    return parsed.select("path", "mtime", count("canvas.nodes").alias("node_count"), count("canvas.edges").alias("edge_count")).orderBy(F.desc("mtime"), "path").limit(limit)


def canvas_nodes(rows: DataFrame) -> DataFrame:
    node = rows.select("path", F.explode(F.from_json("content", CANVAS)["nodes"]).alias("node")).select("path", "node.*")
    return node.withColumn("kind", F.when(F.col("type").isin("text", "file", "link", "group"), F.col("type")).otherwise("unknown"))


def canvas_edges(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.explode(F.from_json("content", CANVAS)["edges"]).alias("edge")).select("path", "edge.*")


def canvas_summary(rows: DataFrame) -> DataFrame:
    """Counts of nodes by kind."""
    return canvas_nodes(rows).groupBy("path").pivot("kind", ["text", "file", "link", "group", "unknown"]).count().na.fill(0)


def file_nodes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, id, file, file_resolved): the note that each file node names, by its exact path, else as a link would find it."""
    nodes = canvas_nodes(rows).where("kind = 'file'").select("path", "id", "file", F.regexp_replace(F.coalesce("file", F.lit("")), "^/+", "").alias("target"))
    exact = notes.select(F.col("path").alias("target"), F.col("path").alias("direct"))
    # A reference is relative to the collection, not to its canvas: it is resolved as a link of a note at the root.
    wanted = nodes.where("target <> ''").select("target").distinct()
    asked = wanted.select(F.lit("").alias("path"), F.col("target").alias("ord"), "target")
    found = links.resolve(asked, notes).select("target", "resolved")
    return nodes.join(exact, "target", "left").join(found, "target", "left").select("path", "id", "file", F.coalesce("direct", "resolved").alias("file_resolved"))


def broken_file_nodes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """File nodes that name something, but no note."""
    return file_nodes(rows, notes).where("file_resolved is null and regexp_replace(coalesce(file, ''), '^/+', '') <> ''").select("path", "id", "file")


def newest(rows: DataFrame, limit: int = 100) -> DataFrame:
    return rows.drop("content").orderBy(F.desc("mtime"), "path").limit(limit)


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """Relevance queries from JSON lines: blank and ``//`` lines are skipped; bad rows and repeated ids are errors."""
    schema = "id string, query string, relevant array<string>, category string"
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("//"))
    parsed = rows.select(F.from_json("value", schema).alias("q"), "value").select("q.*", "value")
    bad = parsed.where("query is null or relevant is null").count()
    repeated = parsed.where("id is not null").groupBy("id").count().where("count > 1").count()
    if bad or repeated:
        raise ValueError(f"{bad} malformed rows, {repeated} repeated ids")
    return parsed.drop("value")


def feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback counts; an unreadable file counts as empty."""
    schema = "path string, useful long, not_useful long, last_marked timestamp"
    try:
        return spark.read.schema(schema).json(path)
    except Exception:  # noqa: BLE001  any failure of the reader: ratings are optional
        return spark.createDataFrame([], schema)


def parse_base(text: str) -> dict:
    """A ``.base`` file as plain data; formulas and summaries are kept and never evaluated."""
    data = yaml.safe_load(text) if yaml else json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("a base file must be a mapping")
    views = data.get("views")
    return {"filters": data.get("filters"), "formulas": data.get("formulas") or {}, "properties": data.get("properties") or {}, "summaries": data.get("summaries") or {}, "views": [v for v in views if isinstance(v, dict)] if isinstance(views, list) else []}
