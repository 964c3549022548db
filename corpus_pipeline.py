"""A corpus pipeline over ``documents``: quality rules, near duplicates, benchmark
decontamination, secrets, mixing.

Each stage works on all rows its predecessor kept and returns the columns of
``documents``, but for the last one, which returns the mix. ``run`` writes each stage as
Parquet under the shared folder of ``spark.checkpoint.dir`` and reads it again, so that a
stage never recomputes the ones before it and survives lost executors.

Cases: null, empty and wordless texts fail the quality rules and go in the first stage; of near copies one row
stays, also where ids are null or repeat; a null source is mixed as a source of its own; columns other than those of
``documents`` are left out before the first stage; where nothing is left, an empty table included, the mix is empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm import decontaminate, forest, mixing, quality, secrets
from tremolo.llm.common import table
from tremolo.session import checkpoint_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.judge_quality(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return forest.one_of_each(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows."""
    clean = secrets.redact(secrets.scan_secrets(docs))
    return clean.withColumn("n_chars", F.coalesce(
        F.char_length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: SQL cannot express the quality model or the random-token model; tests/llm has a brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = checkpoint_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
