"""A training corpus from raw documents: five stages, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuesheet.llm.common import table, written
from cuesheet.llm.decontamination import drop_contaminated
from cuesheet.llm.exact import keep_first_copies
from cuesheet.llm.packing import pack_documents
from cuesheet.llm.quality import drop_low_quality
from cuesheet.llm.simhash import keep_one_of_each_group

STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", keep_first_copies),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: SQL can't train the classifier or encode text; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents that all stages keep; between stages they are Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
