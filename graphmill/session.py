"""Session helpers: reading the driver's tables, durable cut points, local sessions."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "4g", partitions: int = 8) -> SparkSession:
    """A session for tests and local benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphmill")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local session, whose executors are this machine, gets one of its own
    where it is unset; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"graphmill-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the current round of an
    iterative operator only, and plans do not grow with the number of rounds.
    Unlike a checkpointed RDD the table is compressed, has true statistics for
    join planning, and carries no inferred constraints, whose number would
    multiply with every round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphmill_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes in fewer partitions than there are cores, as one small file does; else as it is.

    For narrow passes that cost far more than a shuffle of their input.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()  # of the physical plan; nothing runs
    return df.repartition(cores) if parts < cores else df


def release(df: DataFrame) -> None:
    """Delete the table behind a `durable` result that nothing will read again."""
    path = getattr(df, "_graphmill_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


class SharedFiles:
    """Small files under a folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self) -> list[str]:
        if not self.fs.exists(self._path("")):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path("")))

    def read_json(self, name: str):
        """The content of a JSON file, None where there is none."""
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create_json(self, name: str, value) -> bool:
        """Write a JSON file that does not exist yet, whole or not at all; False where another writer was first."""
        fresh = self._path(f".{name}.{uuid.uuid4().hex}")
        self.fs.mkdirs(self._path(""))
        stream = self.fs.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(fresh, self._path(name)):
            self.fs.delete(fresh, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
