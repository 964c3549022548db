"""Registered queries of the training-data operators, over the whole tables.

A query applies its operator and derives the digest columns of its contract from the
operator's own results. ``ORACLE_SQL`` (from ``oracles``) has DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.llm import (
    chatformat,
    debruijn,
    decontaminate,
    divergence,
    forest,
    langid,
    licenses,
    linedups,
    mixing,
    periodic,
    prefixfree,
    quality,
    secrets,
)
from tremolo.llm.common import sha256_of, table
from tremolo.llm.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query
def op1_decontaminate(spark, d):
    found = decontaminate.contaminated(_texts(spark, d), table(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit",
                        F.size("hit_items").cast("long").alias("n_items"),
                        sha256_of(F.array_join("hit_items", ",")).alias("items_sha256"),
                        "contaminated")


@query
def op2_secrets(spark, d):
    found = secrets.scan_secrets(_texts(spark, d))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        sha256_of(secrets.spelled(base)).alias("base_sha256"),
        secrets.spelled(secrets.all_spans()).alias("spans"))


@query
def op3_substrings(spark, d):
    return debruijn.remove_repeats(_texts(spark, d)).select(
        "doc_id", "n_words", "n_removed", sha256_of("kept_text").alias("kept_sha256"))


@query
def op4_chats(spark, d):
    return chatformat.format_chats(table(spark, d, "conversations"))


@query
def op5_licenses(spark, d):
    found = licenses.scan_licenses(_texts(spark, d), keep_text=False)
    return found.select(
        "doc_id", "n_words", F.size("base_starts").cast("long").alias("n_base"),
        F.array_min("base_starts").alias("first_word"),
        F.array_max("base_starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


@query
def op6_mix(spark, d):
    return mixing.mix(table(spark, d, "documents")).drop("source")


@query
def op7_quality(spark, d):
    return quality.judge_quality(_texts(spark, d), table(spark, d, "labels"), keep_text=False)


@query
def op8_jaccard(spark, d):
    return forest.jaccard_join(_texts(spark, d)).drop("text")


@query
def op9_suffixes(spark, d):
    """Beyond the contract: n_kept, and has_repeats (some byte was removed)."""
    return prefixfree.remove_repeated_bytes(_texts(spark, d)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"),
        (F.col("n_removed") > 0).alias("has_repeats"))


@query
def op10_language(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")


@query
def op11_periodic(spark, d):
    found = periodic.collapse_runs(_texts(spark, d))
    listed = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length",
                        "period", "exponent_milli",
                        sha256_of(F.array_join(listed, "")).alias("runs_sha256"),
                        sha256_of("collapsed").alias("collapsed_sha256"))


@query
def op12_linedups(spark, d):
    return linedups.drop_lines(_texts(spark, d)).select(
        "doc_id", "n_lines", "n_dropped", sha256_of("kept_text").alias("kept_sha256"))


@query
def op13_divergence(spark, d):
    return divergence.audit_sources(table(spark, d, "documents").select("text", "lang", "source"))
