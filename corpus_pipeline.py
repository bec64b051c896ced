"""The corpus pipeline: five filtering and mixing stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet into the shared folder and reads it again as the next one's docs.

All stages take nulls in any column, empty and very long texts, repeated rows,
empty tables and further columns of any name, which pass through; each says
what becomes of them.  An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import decontam, mixing, quality, secrets, simhash
from cuemill.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or stray from their language go.  Null
    and empty texts fail it; a null language is judged by the base rule alone;
    equal rows share their fate; a text at a limit stays."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that of the smallest id; rows
    without an id come last, of rows of one id that of the smallest hash stays.
    Texts without words are one group; equal rows are one document."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.  Null and empty texts have
    none and stay; null items are no items; equal rows share their fate."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; ``n_chars`` follows the text.  No row goes; a
    null text stays null, with its ``n_chars``; equal rows get equal texts."""
    out = secrets.masked(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies`` and ``taken`` words (such
    columns are replaced).  The null source comes last; texts without words cost
    nothing and come with their source's certain copies; rows equal in id, source
    and text share their fate."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
]

#: SQL cannot express the stages of SimHash components and Wu-Manber matching
#: over whole tables in reasonable time; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage{k}")
    return docs
