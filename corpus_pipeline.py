"""Corpus preparation: quality rules, line dedup, near-duplicate removal, mixing and packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as the next one's
``docs``; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import line_dedup, mixing, packing, quality, simhash
from kerbline.runtime import materialize


def _counted(out: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; n_chars follows the text."""
    if "n_chars" in like.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines. Null and empty texts are rejected; repeated rows are judged alike."""
    return _counted(quality.clean(docs), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of runs that stand earlier. A null text stays null; rows alike in id and text lose the same."""
    return _counted(line_dedup.dedup_lines(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one of least id; copies with a word in fifty replaced count, by the wide fingerprints.

    Null and wordless texts are one group. A null id comes last; of repeated rows one stays.
    """
    return simhash.keep_one(docs, classes_of=simhash.similar)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, copies as repeated rows; a null source is one of its own."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences; a repeated row has pieces of its own, told apart by sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Fingerprints, pivotal rounding and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
