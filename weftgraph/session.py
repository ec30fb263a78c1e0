"""Session helpers shared by every operator: session defaults, reliable checkpoints, scratch tables, observed steps, table paths."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


#: Bytes of rows in memory for a byte of their files, at most, about.
UNPACKED = 40.0


def local_session(app: str = "weftgraph", cores: int | str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names.

    Where none is set, a local master gets a temporary folder; a cluster is refused, for its machines don't share one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftgraph-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint: it outlives lost executors.

    Spark deletes the files once nothing refers to the DataFrame, if spark.cleaner.referenceTracking.cleanCheckpoints
    is true, as ``local_session`` sets it; a cluster has to set it itself.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class StepLog:
    """Rows and seconds of an operator's steps. Rows are observed while a step is computed, so no step is run or read again."""

    def __init__(self) -> None:
        self.steps: list[tuple[int, str, int, float]] = []

    def cut(self, name: str, df: DataFrame) -> DataFrame:
        """``cut``, and a line in the log."""
        seen, began = Observation(f"{name}-{uuid.uuid4().hex}"), time.monotonic()
        out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        self.steps.append((len(self.steps), name, seen.get["rows"], time.monotonic() - began))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, name, rows, seconds), one row a step."""
        return spark.createDataFrame(self.steps, "step int, name string, rows bigint, seconds double")


class Scratch:
    """Intermediate tables of one operator: written to the shared folder, and deleted together when it ends.

    Unlike a checkpoint a table is compressed, is read by column, and goes at a known moment. What an operator returns
    must not read it: ``cut`` the result before the end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(self.folder)

    def table(self, df: DataFrame) -> DataFrame:
        """``df``, computed once and read from its table. Its lineage ends there, and lost executors cost nothing."""
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def partitions(spark: SparkSession, least: int) -> Iterator[None]:
    """Steps planned within have ``least`` shuffle partitions, or more where the session has more: tasks don't grow with the tables.

    Files count UNPACKED times their size: tables of numbers lie packed so well that the driver would broadcast millions
    of rows.
    """
    keys = {"spark.sql.shuffle.partitions": lambda v: max(least, int(v)), "spark.sql.sources.fileCompressionFactor": lambda v: max(UNPACKED, float(v))}
    before = {k: spark.conf.get(k) for k in keys}
    for k, more in keys.items():
        spark.conf.set(k, str(more(before[k])))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Beside:
    """Tables of one operator that are dealt out alike by their keys, into as many files, so that joins on these need no shuffle.

    They lie in the operator's scratch folder and leave the catalog when it ends.
    """

    def __init__(self, scratch: Scratch):
        self.spark, self.scratch, self.names = scratch.spark, scratch, []
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> Beside:
        return self

    def __exit__(self, *_: object) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def table(self, df: DataFrame, *keys: str, dealt: bool = False, buckets: int | None = None) -> DataFrame:
        """``df``, computed once; ``dealt``: its rows lie in tasks by the keys already."""
        name, buckets = f"beside_{uuid.uuid4().hex}", buckets or self.buckets
        self.names.append(name)
        rows = df if dealt else df.repartition(buckets, *keys)
        rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{self.scratch.folder}/{name}").saveAsTable(name)
        return self.spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
