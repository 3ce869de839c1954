"""Development dependencies that a repository declares for itself."""

from __future__ import annotations

import configparser
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspan.operators.reviews import package_name

#: Names of extras that hold development dependencies.
DEV_EXTRAS = ("dev", "development", "dev-dependencies", "test", "tests", "testing", "lint", "linting", "typing", "types", "docs", "documentation")


def read_configs(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, content) of the pyproject.toml and setup.cfg files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{pyproject.toml,setup.cfg}").load(root)
    return files.select(F.col("path").alias("file_path"), F.decode("content", "utf-8").alias("content"))


def _extras(file_path: str, content: str) -> list[str]:
    """The lines of the development extras of one file; none where it can't be read."""
    try:
        if file_path.endswith("pyproject.toml"):
            groups = tomllib.loads(content).get("project", {}).get("optional-dependencies", {})
            return [line for name, lines in groups.items() if name in DEV_EXTRAS for line in lines if isinstance(line, str)]
        config = configparser.ConfigParser()
        config.read_string(content)
        section = config["options.extras_require"] if config.has_section("options.extras_require") else {}
        return [line for name in section if name in DEV_EXTRAS for line in section[name].splitlines()]
    except (tomllib.TOMLDecodeError, configparser.Error, AttributeError, TypeError):
        return []


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["repo_id"], r["file_path"], line) for r in batch.to_pylist() if r["content"] for line in _extras(r["file_path"] or "", r["content"])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["repo_id", "file_path", "spec"])


def dev_packages(configs: DataFrame) -> DataFrame:
    """(repo_id, package) of ``configs`` (repo_id, file_path, content): the development extras of pyproject.toml, or of setup.cfg where that has none."""
    specs = configs.select("repo_id", "file_path", "content").mapInArrow(_read, "repo_id string, file_path string, spec string")
    named = specs.select("repo_id", F.col("file_path").endswith("pyproject.toml").alias("first"), package_name("spec").alias("package")).where("package IS NOT NULL").distinct()
    best = named.groupBy("repo_id").agg(F.max("first").alias("first"))
    return named.join(best, ["repo_id", "first"]).select("repo_id", "package").distinct()
