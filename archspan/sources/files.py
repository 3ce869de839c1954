"""Rule files, trace lines, reports, source trees and the written store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspan.runtime import count_by

GOLD_SCHEMA = "adr_id string, adr_path string, note string, constraints array<struct<subject:string,predicate:string,object:string,justification:string,scope:string>>"
_EDGE = "struct<subject:string,object:string,predicate:string,scope:string>"
TRACE_SCHEMA = (
    "adr_id string, edges array<struct<subject:string,object:string,predicate:string,scope:string,provenance:struct<subject:array<string>,object:array<string>>>>, hit_cap boolean, parse_failed boolean, wall_seconds double, "
    f"parse_dropped array<struct<reason:string,item:string>>, none_verdict_edges array<{_EDGE}>, pre_validation_edges array<{_EDGE}>, usage map<string,bigint>, tool_calls array<struct<name:string,arguments:string,result_fqns:array<string>>>"
)
#: Files of tests: below a folder tests or test, or test_*.py and *_test.py.
TESTS = r"(^|/)tests?/|(^|/)(test_[^/]*|[^/]*_test\.py)$"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Rule files: one JSON array of ADRs per file, with the file's name as ``file``."""
    return spark.read.schema(GOLD_SCHEMA).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def write_gold(rules: DataFrame, path: str) -> None:
    """Flat rules (adr_id, adr_path, subject, predicate, object, justification, scope) regrouped per ADR, one JSON line each; ADRs without rules keep an empty list."""
    rule = F.struct("subject", "predicate", "object", "justification", "scope")
    grouped = rules.groupBy("adr_id", "adr_path").agg(F.sort_array(F.collect_list(F.when(F.col("subject").isNotNull(), rule))).alias("constraints"))
    grouped.write.mode("overwrite").json(path)


def append_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace lines below a folder; lines that are no JSON come out with null columns."""
    return spark.read.schema(TRACE_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(path).withColumn("file", F.input_file_name())


def write_report(rows: DataFrame, path: str, **meta: str) -> None:
    """JSON lines with the run's marks as a ``_meta`` object."""
    rows.withColumn("_meta", F.struct(*[F.lit(v).alias(k) for k, v in sorted(meta.items())], F.current_timestamp().alias("generated_at"))).write.mode("errorifexists").json(path)


def python_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, content) of the hand-run Python files below a folder: no tests, no path part that starts with a dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{root.rstrip('/')}/", "")
    return files.select(rel.alias("file_path"), F.decode("content", "utf-8").alias("content")).where(~F.col("file_path").rlike(TESTS) & ~F.col("file_path").rlike(r"(^|/)\."))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key doesn't come in again, and the incoming rows."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def first_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and the new ones with keys that aren't there yet; nothing is removed."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def delete_by_file(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the given (repo_id, file_path); rules live in their own table and stay."""
    gone = nodes.join(files.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_semi").select("repo_id", "fqn").distinct()
    kept = edges
    for end in ("source", "target"):
        kept = kept.join(gone.withColumnRenamed("fqn", end), ["repo_id", end], "left_anti")
    return nodes.join(gone, ["repo_id", "fqn"], "left_anti").select(nodes.columns), kept.select(edges.columns)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself; fails where a key has several rows."""
    twice = count_by(df, *keys).where("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"{keys} not unique: {twice.limit(3).collect()}")
    return df
