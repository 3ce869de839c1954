"""Queries of the training-text problems (4, 8, 9, 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspan.llm import handwritten, leakage, mixture, splitting
from archspan.runtime import Scratch, load


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.found(load(spark, sf_dir, "source_files"), load(spark, sf_dir, "thirdparty_files"))


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by language, reason and reason by layout alone; '' is hand-written source."""
    judged = handwritten.judged(load(spark, sf_dir, "source_files"), load(spark, sf_dir, "thirdparty_files"))
    return judged.groupBy("lang", *[F.coalesce(c, F.lit("")).alias(c) for c in ("reason", "layout_reason")]).agg(F.count(F.lit(1)).alias("n_files"))


def p4_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository the code nodes whose file is hand-written and those whose file is not."""
    files = load(spark, sf_dir, "source_files")
    path = F.regexp_replace(F.regexp_replace(F.trim("file_path"), r"[\\/]+", "/"), r"^\./", "")
    bad = files.join(p4_found(spark, sf_dir), "file_id", "left_semi").select("repo_id", path.alias("path")).distinct().withColumn("made", F.lit(1))
    nodes = load(spark, sf_dir, "fqn_nodes").where(F.col("file_path").isNotNull()).select("repo_id", path.alias("path"))
    return nodes.join(bad, ["repo_id", "path"], "left").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count("made").alias("n_made"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(p8_found(spark, sf_dir), load(spark, sf_dir, "eval_items"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), Scratch(spark, "mixture"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = Scratch(spark, "mixed").cut(p9_mixture(spark, sf_dir))
    return mixture.actual_shares(mixed, load(spark, sf_dir, "mix_targets"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "split_limits"))


QUERIES = {f.__name__: f for f in (p4_found, p4_reasons, p4_by_repo, p8_found, p8_items, p9_mixture, p9_shares, p10_pieces)}

_LEAKS = """
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(passage, '[A-Za-z0-9]+'), lambda w: lower(w)) AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS u(k)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM i, unnest(range(1, len(w) - 10)) AS u(k)),
f AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""
SQL: dict[str, str] = {
    "p8_found": _LEAKS + "SELECT doc_id, item_id FROM f",
    "p8_items": _LEAKS + "SELECT item_id, case_id, count(f.doc_id) AS n_docs FROM eval_items LEFT JOIN f USING (item_id) GROUP BY 1, 2",
}
