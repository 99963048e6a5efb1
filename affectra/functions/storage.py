"""Tables written on the way to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint directory.

    A local session without either gets a fresh temporary folder; a cluster
    without either is refused, as executors couldn't read what others wrote.
    """
    context = spark.sparkContext
    got = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not got:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        got = tempfile.mkdtemp(prefix="affectra-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


class Path:
    """A path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._of = lambda p: Path(spark, p)

    def exists(self) -> bool:
        return self.system.exists(self.hadoop)

    def delete(self) -> None:
        self.system.delete(self.hadoop, True)

    def children(self, suffix: str = "") -> list[str]:
        return sorted(p for p in (str(s.getPath()) for s in self.system.listStatus(self.hadoop)) if p.endswith(suffix))

    def move(self, to: str) -> None:
        """Takes the place of what lies at `to`; folders above it are made."""
        other = self._of(to)
        other.system.mkdirs(other.hadoop.getParent())
        other.delete()
        if not self.system.rename(self.hadoop, other.hadoop):
            raise OSError(f"{self.hadoop} can't become {to}")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        Path(spark, path).delete()
    except Exception:  # the session may be gone at exit
        pass


class Tables:
    """Written tables that go together: at the end of a `with` block, or with the Python session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        atexit.register(self.drop)

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df written once as Parquet (in a folder for each value of `by`) and read back: its lineage ends there."""
        path = f"{shared_dir(self.spark)}/tables/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        while self.paths:
            _forget(self.spark, self.paths.pop())
        atexit.unregister(self.drop)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back; for plans that are handed on, so it goes with the session."""
    return Tables(df.sparkSession).put(df, name)
