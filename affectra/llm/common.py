"""Helpers shared by the text operators: columns, shared storage, closures."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affectra.functions.cluster import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where neither that nor a checkpoint directory of the context is set, a local
    session gets a fresh temporary folder, as tests do; a cluster is refused.
    """
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        got = tempfile.mkdtemp(prefix="affectra-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back.

    This cuts the lineage: a lost executor costs its running tasks, never a
    finished stage. The table goes when the Python session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """The column of that very name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All columns of df as one struct, so that names made on the way can't clash with them."""
    return F.struct(*map(column, df.columns)) if df.columns else F.struct(F.lit(0).alias("none"))


def unpacked(names: list[str], other: dict[str, Column] | None = None) -> list[Column]:
    """Columns of the struct `row` by name; those in `other` are taken from there."""
    return [(other or {}).get(c, F.col("row").getField(c)).alias(c) for c in names]


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, the fixed rule that makes the folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; sets partition counts, never a threshold."""
    got = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0]
    return int(got or 0)


#: The characters that part words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
