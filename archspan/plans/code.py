"""Queries over source text, file-level diffs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspan.functions import names
from archspan.operators import grounding, model, snapshots
from archspan.plans import dealt
from archspan.runtime import Scratch, load
from archspan.sources import python_code
from archspan.streaming import incremental


def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.definitions(python_code.code_facts(load(spark, sf_dir, "source_files")))


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = Scratch(spark, "facts").cut(python_code.code_facts(load(spark, sf_dir, "source_files")))
    return python_code.code_edges(facts)


def code_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.code_hash(load(spark, sf_dir, "source_files"))


def code_same_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code hashes that several definitions share, with the number of definitions, files and repositories."""
    h = code_hashes(spark, sf_dir)
    return h.groupBy("code_hash").agg(F.count(F.lit(1)).alias("n_definitions"), F.count_distinct("file_id").alias("n_files"), F.count_distinct("repo_id").alias("n_repos")).where("n_definitions > 1")


def diff_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per snapshot and file: names added, removed and changed, with the file's module as fallback name."""
    s = load(spark, sf_dir, "node_snapshots")
    changed = snapshots.changes(s, Scratch(spark, "diff"))
    files = s.groupBy("line_id", "fqn").agg(F.max_by("file_path", F.struct("row_no")).alias("file_path"))
    per = changed.join(files, ["line_id", "fqn"]).groupBy("line_id", "to_sha", "file_path").agg(*[F.count(F.when(F.col("change_kind") == k, 1)).alias(f"n_{k}") for k in ("added", "removed", "changed")])
    return per.withColumn("module", names.path_to_fqn("file_path"))


def changed_scopes(spark: SparkSession, sf_dir: str, days: int | None = 10) -> DataFrame:
    """Current nodes at or under the subject of any rule of the latest ``days`` (or of any rule): the scopes a partial check starts from."""
    n = model.current_nodes(load(spark, sf_dir, "fqn_nodes"))
    late = load(spark, sf_dir, "constraint_edges")
    if days is not None:
        end = late.agg(F.max("recorded_at").alias("end"))
        late = late.crossJoin(F.broadcast(end)).where(F.col("recorded_at") >= F.col("end") - F.expr(f"INTERVAL {days} DAYS"))
    return grounding.scopes_under(n, late.select("repo_id", names.base(F.trim("subject")).alias("top")))


def all_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_scopes(spark, sf_dir, None)


def stream_daily_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as an arriving stream: partial counts per micro-batch, summed on reading."""
    return incremental.accumulate(spark, incremental.stream_table(spark, sf_dir, "dep_edges"))


QUERIES = {f.__name__: f for f in (code_definitions, code_edges, code_hashes, code_same_text, diff_modules, changed_scopes, all_scopes, stream_daily_edges)}

SQL = {
    "diff_modules": dealt._SNAPS
    + r"""SELECT line_id, to_sha, file_path, count(*) FILTER (change_kind = 'added') AS n_added, count(*) FILTER (change_kind = 'removed') AS n_removed, count(*) FILTER (change_kind = 'changed') AS n_changed,
regexp_replace(regexp_replace(regexp_replace(file_path, '\.py$', ''), '[/\\]', '.', 'g'), '\.__init__$', '') AS module
FROM found JOIN (SELECT line_id, fqn, arg_max(file_path, row_no) AS file_path FROM node_snapshots GROUP BY 1, 2) USING (line_id, fqn) GROUP BY 1, 2, 3""",
    "changed_scopes": r"""WITH n AS (SELECT DISTINCT repo_id, fqn FROM fqn_nodes WHERE deleted_at IS NULL),
t AS (SELECT DISTINCT repo_id, regexp_replace(trim(subject), '\.\*$', '') AS top FROM constraint_edges WHERE recorded_at >= (SELECT max(recorded_at) FROM constraint_edges) - INTERVAL 10 DAYS)
SELECT DISTINCT n.repo_id, n.fqn FROM n JOIN t ON n.repo_id = t.repo_id AND (n.fqn = t.top OR starts_with(n.fqn, t.top || '.')) WHERE t.top <> ''""",
    "all_scopes": r"""WITH n AS (SELECT DISTINCT repo_id, fqn FROM fqn_nodes WHERE deleted_at IS NULL),
t AS (SELECT DISTINCT repo_id, regexp_replace(trim(subject), '\.\*$', '') AS top FROM constraint_edges)
SELECT DISTINCT n.repo_id, n.fqn FROM n JOIN t ON n.repo_id = t.repo_id AND (n.fqn = t.top OR starts_with(n.fqn, t.top || '.')) WHERE t.top <> ''""",
    "stream_daily_edges": "SELECT CAST(loaded_at AS DATE) AS day, upper(trim(kind)) AS kind, count(*) AS n FROM dep_edges GROUP BY 1, 2",
}
