"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared
folder and read again as the next one's docs.  All but the last return the columns of ``documents``.

Nulls in any column, empty and very long texts, repeated rows, further columns and empty tables pass through every stage; what each
makes of them is stated at the stage.  A document without words goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm.bpe_codec import stage_bpe
from lorekeep.llm.line_dedup import stage_lines
from lorekeep.llm.quality_rules import stage_quality
from lorekeep.llm.shared import stored, table
from lorekeep.llm.shingle_join import stage_near_duplicates
from lorekeep.llm.source_mixing import stage_mix

STAGES = [
    ("quality rules", stage_quality),
    ("line dedup", stage_lines),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("mixing sources to target weights", stage_mix),
    ("BPE encoding and decoding", stage_bpe),
]

#: The trained field, the joins on edited texts and the encoding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name.lower()))
    return STAGES[-1][1](spark, docs, sf_dir)
