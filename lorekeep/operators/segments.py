"""Text index of immutable segments (survey K10, K12, Z4, Z9).

A batch of changes is one new segment: the postings of the changed documents, what the segment adds to each statistic, and the paths
that are ``dead`` in all segments before it (a changed document's old rows, a deleted document's).  Nothing that is stored is
rewritten, so a batch costs what it changes.  The manifest names the segments that make up a version; it is written last, and
a batch that it has already counted is skipped.

What is read is merged then: rows are live if no later segment has their path among its dead; document
frequencies are the sums of the segments' less those of the dead rows; norms depend on all document frequencies and are stored
once a version.  ``compact`` writes the live rows as one segment; versions that were named before stay readable until ``vacuum``.
"""

from __future__ import annotations

import contextlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from . import retrieval
from .index_store import CosineIndex, WordIndex

COLUMNS = ("content", "title", "aliases")
MOST_SENT = 2_000_000


@dataclass
class Version:
    number: int
    batch: int
    segments: list[str]


class SegmentedIndex:
    """An index folder.  Paths are of type ``kind``; chunk rows have (path, chunk_index) and the text columns.

    An index may keep the half for ``weights`` (cosine ranking) or for ``words`` (BM25) only; it then answers nothing that needs the other."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "string", columns: tuple[str, ...] = COLUMNS, keeps: tuple[str, ...] = ("weights", "words")) -> None:
        self.keeps = keeps
        self.spark, self.folder, self.columns = spark, folder.rstrip("/"), columns
        self._known: list[list[str]] = []
        self.schemas = {
            "tf": f"doc {kind}, term string, tf long", "terms": "term string, df long", "docs": f"doc {kind}", "dead": f"doc {kind}", "lengths": f"path {kind}, chunk_index int, length long",
            "postings": f"path {kind}, chunk_index int, column string, term string, positions array<int>",
        }

    # ---- versions -----------------------------------------------------------------------------------------

    def newest(self) -> Version:
        try:
            row = self.spark.read.schema("number long, batch long, segments array<string>").json(f"{self.folder}/manifest").orderBy(F.desc("number")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        return Version(row.number, row.batch, list(row.segments)) if row else Version(-1, -1, [])

    def _publish(self, v: Version) -> Version:
        self.spark.createDataFrame([(v.number, v.batch, v.segments)], "number long, batch long, segments array<string>").coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        return v

    # ---- writing ------------------------------------------------------------------------------------------

    def append(self, batch: int, bodies: DataFrame, chunks: DataFrame, deleted: DataFrame) -> Version:
        """One segment of the changed documents: ``bodies`` (path, body), their ``chunks``, and the ``deleted`` (path).  A path has one row in ``bodies``."""
        now = self.newest()
        if batch <= now.batch:
            return now
        name = f"segment-{batch}-{uuid.uuid4().hex}"
        postings, lengths = retrieval.bm25_index(chunks, ("path", "chunk_index"), self.columns) if "words" in self.keeps else (None, None)
        tf = retrieval.term_counts(bodies, "path", "body") if "weights" in self.keeps else None
        gone = bodies.select("path").unionByName(deleted.select("path")).distinct().select(F.col("path").alias("doc"))
        self._write(name, tf, bodies.select(F.col("path").alias("doc")), gone, postings, lengths)
        return self._publish(Version(now.number + 1, batch, [*now.segments, name]))

    def _write(self, name: str, tf: DataFrame | None, docs: DataFrame, dead: DataFrame, postings: DataFrame | None, lengths: DataFrame | None) -> None:
        if tf is not None:
            self._store(name, "tf", tf)
            self._store(name, "terms", self._of(name, "tf").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        self._store(name, "docs", docs)
        self._store(name, "dead", dead)
        if postings is not None:
            self._store(name, "postings", postings)
            self._store(name, "lengths", lengths)

    def _needs(self, half: str) -> None:
        if half not in self.keeps:
            raise ValueError(f"this index keeps no {half}")

    def _store(self, segment: str, table: str, df: DataFrame) -> None:
        columns = [c.split()[0] for c in self.schemas[table].split(", ")]
        kinds = {c.split()[0]: c.split(None, 1)[1] for c in self.schemas[table].split(", ")}
        df.select(*[F.col(c).cast(kinds[c]) for c in columns]).write.parquet(f"{self.folder}/{segment}/{table}")

    def compact(self) -> Version:
        """The live rows of all segments as one, without dead paths."""
        now = self.newest()
        if len(now.segments) > 1:
            name = f"segment-{now.batch}-{uuid.uuid4().hex}"
            docs = self.live("docs", now)
            weights, words = "weights" in self.keeps, "words" in self.keeps
            self._write(name, self.live("tf", now) if weights else None, docs, docs.limit(0), self.live("postings", now) if words else None, self.live("lengths", now) if words else None)
            now = self._publish(Version(now.number + 1, now.batch, [name]))
        return now

    def vacuum(self) -> None:
        """Deletes what the newest version does not name; no reader may be using an older one."""
        now = self.newest()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(path(self.folder)):
            name = status.getPath().getName()
            if (name.startswith("segment-") and name not in now.segments) or (name.startswith("norms-") and name != f"norms-{now.number}"):
                with contextlib.suppress(Exception):  # what is left over costs disk only
                    fs.delete(status.getPath(), True)

    # ---- reading ------------------------------------------------------------------------------------------

    def _of(self, segment: str, table: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.folder}/{segment}/{table}")

    def _all(self, table: str, v: Version, skip: int = 0) -> DataFrame:
        """The rows of all segments but the first ``skip``, with the place of their segment."""
        out = self.spark.createDataFrame([], self.schemas[table]).withColumn("at", F.lit(0))
        for at, segment in enumerate(v.segments[skip:], skip):
            out = out.unionByName(self._of(segment, table).withColumn("at", F.lit(at)))
        return out

    def _kills(self, v: Version) -> DataFrame:
        """(doc, since): the last segment that has the path among its dead; the first segment's dead kill nothing.

        Kept for a version.  Up to ``MOST_SENT`` rows are sent to where the segments are read, so that no posting is shuffled to tell which are live."""
        if v.segments not in self._known:
            self._known[:] = [v.segments]
            kills = stored(self._all("dead", v, 1).groupBy("doc").agg(F.max("at").alias("since")), "segment-kills")
            self._killed = F.broadcast(kills) if kills.count() <= MOST_SENT else kills
        return self._killed

    def live(self, table: str, v: Version | None = None) -> DataFrame:
        v = v or self.newest()
        rows = self._all(table, v)
        if len(v.segments) < 2:
            return rows.drop("at")
        key = "doc" if "doc" in rows.columns else "path"
        return rows.join(self._kills(v).withColumnRenamed("doc", key), key, "left").where("since is null or at >= since").select(*[c.split()[0] for c in self.schemas[table].split(", ")])

    def document_counts(self, v: Version | None = None) -> DataFrame:
        """(term, df, idf) of the live rows, from the segments' counts and the dead rows."""
        self._needs("weights")
        v = v or self.newest()
        added = self._all("terms", v).select("term", "df")
        dead = self._all("tf", v).join(self._kills(v), "doc").where("at < since").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        df = added.unionByName(dead.select("term", (-F.col("df")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        n = self.live("docs", v).count()
        return df.select("term", "df", F.ln(1 + F.lit(float(n)) / (1 + F.col("df"))).alias("idf"))

    def cosine(self) -> CosineIndex:
        self._needs("weights")
        v = self.newest()
        tf, terms, at = self.live("tf", v), self.document_counts(v), f"{self.folder}/norms-{v.number}"
        norms = retrieval.row_norms(tf, terms)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            norms.write.mode("overwrite").parquet(at)
        return CosineIndex(tf, terms, self.spark.read.schema(norms.schema).parquet(at))

    def words(self) -> WordIndex:
        self._needs("words")
        v = self.newest()
        return WordIndex(self.live("postings", v), self.live("lengths", v), ("path", "chunk_index"))
