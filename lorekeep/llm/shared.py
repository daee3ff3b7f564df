"""Sources and shared storage for the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one is set only where that is unset and
    driver and executors are one process (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lorekeep-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            context.setCheckpointDir(folder)
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and a lost executor loses nothing.

    What ``discard`` does not delete before goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` has written, when all that is made of them is stored itself."""
    for df in tables:
        if path := getattr(df, "stored_path", None):
            jvm = df.sparkSession._jvm
            with contextlib.suppress(Exception):  # what is left over costs disk only
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on the rows of each group; a group must be of bounded size.  Many small groups share an Arrow batch, unlike with ``applyInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            if held is not None:
                rows = pa.concat_tables([held, rows])  # only a group at a time is copied, not the batch
            if not len(rows):
                continue
            columns = [rows.column(k).to_numpy() for k in keys]
            ends = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()
            done = [work(rows.slice(a, z - a).combine_chunks()) for a, z in zip([0, *ends], ends, strict=False)]
            held = rows.slice(ends[-1] if ends else 0).combine_chunks()
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held is not None and len(held):
            yield from work(held).to_batches()
        pa.default_memory_pool().release_unused()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
