"""Table access and lineage cuts.

Iterative operators write their intermediate state to the shared folder named
by ``spark.checkpoint.dir`` so that a lost executor costs one round, not all. Their
rounds run when the operator is called, not when its result is used.
"""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of files that a task of work that is heavy per row should hold, about.
TASK_BYTES = 32 << 20


def session(app: str = "archspan", cpus: str = "*", **conf: str) -> SparkSession:
    """Local session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", conf.pop("partitions", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("memory", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; on a cluster its
    absence is an error, as a folder of one machine is none of the others'.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Scratch:
    """Written tables of one operator run; superseded ones can be dropped early, the rest go when the application ends."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._written: list[tuple[DataFrame, str]] = []
        self._n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and reads it back, so later plans start from files."""
        return self._write(df, self._next())

    def cut_all(self, *tables: DataFrame) -> list[DataFrame]:
        """``cut`` of several tables that don't need each other, as jobs that run side by side."""
        paths = [self._next() for _ in tables]
        with ThreadPoolExecutor(len(tables)) as pool:
            return list(pool.map(self._write, tables, paths))

    def _next(self) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}"

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        target, files = self._at(path)
        files.deleteOnExit(target)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._written.append((back, path))
        return back

    def cut_counts(self, df: DataFrame, *conditions: Column) -> tuple[DataFrame, list[int]]:
        """``cut``, and how many rows meet each condition, counted by the job that writes."""
        seen = Observation()
        back = self.cut(df.observe(seen, *[F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(conditions)]))
        return back, [seen.get[f"n{i}"] for i in range(len(conditions))]

    def cut_counting(self, df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
        back, (n,) = self.cut_counts(df, condition)
        return back, n

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this run that nothing reads any more."""
        for back, path in self._written:
            if any(back is df for df in tables):
                target, files = self._at(path)
                files.delete(target, True)

    def _at(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def table_bytes(table: DataFrame) -> int:
    """Bytes of a table's files as Spark's own statistics have them (no job; an estimate where it isn't a plain scan, 0 where Spark knows none)."""
    known = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return known if known < 1 << 60 else 0


def spread(df: DataFrame, source: DataFrame | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``df`` with at least one partition per ``task_bytes`` of its source table's files, and per task slot.

    For work that is heavy per row: neither few files nor large row groups leave it
    to few tasks. A scan that has as many partitions already isn't shuffled.
    """
    wanted = max(-(-table_bytes(df if source is None else source) // task_bytes), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Row counts per key, named ``n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
