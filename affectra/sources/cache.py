"""Features of audio files, cached by the files' identity.

An entry's key is made of path, size, time of change and encoder, all of which a
listing has, so no waveform is opened on a hit. The cache is a Parquet table in
folders by the first digits of the key. New entries are appended; entries that
are damaged or made again by force replace their folder alone, which is written
whole from what is sound in it. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affectra.functions.cluster import ship
from affectra.functions.storage import Path, Tables
from affectra.operators.metrics import finite
from affectra.operators.transforms import cache_key

from .encoders import checked, resolved
from .files import decode_wav
from .stores import opened

ENTRY = "cache_key string, n int, x array<float>, check long, bucket string"


def features_of(files: DataFrame, extractor: Callable, width: int, rate: int | None, keep: str) -> DataFrame:
    """(keep, n, x): frames and all their values of each file, decoded in tasks.

    files: path, or path and content; without content a task opens the path. An
    unreadable file is an error that names it.
    """
    ship(files.sparkSession)
    held = "content" in files.columns

    def run(batches):
        for b in batches:
            for i, path in enumerate(b.column("path").to_pylist()):
                if held:
                    content = b.column("content")[i].as_py()
                else:
                    with opened(path) as f:
                        content = f.read()
                got = decode_wav(content, rate)
                if got.get("error"):
                    raise ValueError(f"{path}: {got['error']}")
                a = checked(extractor(np.asarray(got["samples"], dtype=np.float32)), width, path)
                yield pa.RecordBatch.from_arrays([b.column(keep).slice(i, 1), pa.array([len(a)], pa.int32()), pa.array([a.ravel()], pa.list_(pa.float32()))], names=[keep, "n", "x"])

    columns = list(dict.fromkeys([keep, "path", *(["content"] if held else [])]))
    return files.select(*columns).mapInArrow(run, f"{keep} string, n int, x array<float>")


def as_frames(n: Column, x: Column, width: int) -> Column:
    """An array of vectors from all their values."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(x, i * width + 1, width))


class FeatureCache:
    """Features by an encoder of a given name, below a folder of any store.

    extractor: samples -> [frames, width], or "module:function" of one; without
    it, entries that are missing are an error. digits: hexadecimal digits of a
    key that name its folder.
    """

    def __init__(self, spark: SparkSession, path: str, encoder: str, extractor: Callable | str | None = None, width: int = 768, rate: int | None = 16000, digits: int = 2):
        self.spark, self.path, self.encoder, self.width, self.rate, self.digits = spark, path.rstrip("/"), encoder, width, rate, digits
        self.extractor = resolved(extractor) if isinstance(extractor, str) else extractor

    def keyed(self, wavs: DataFrame) -> DataFrame:
        """wavs (path, modified, size) with cache_key and bucket."""
        key = cache_key(F.col("path"), F.col("size"), F.unix_micros("modified"), self.encoder)
        return wavs.withColumn("cache_key", key).withColumn("bucket", F.substring("cache_key", 1, self.digits))

    def _table(self) -> DataFrame:
        """All rows that can be read; files that can't are left out."""
        if not Path(self.spark, self.path).exists():
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).option("ignoreCorruptFiles", "true").parquet(self.path)

    def _sound(self) -> Column:
        return F.coalesce((F.col("n") >= 1) & (F.size("x") == F.col("n") * self.width) & (F.xxhash64("x") == F.col("check")) & F.forall("x", finite), F.lit(False))

    def entries(self) -> DataFrame:
        """(cache_key, bucket, n, x) of sound entries; of a key that is there twice, as two writers would leave it, one."""
        return self._table().where(self._sound()).dropDuplicates(["cache_key"]).select("cache_key", "bucket", "n", "x")

    def _silent_buckets(self) -> set[str]:
        """Folders with a file of which no row can be read; names of at most 16 ** digits folders."""
        if not Path(self.spark, self.path).exists():
            return set()
        name = F.regexp_replace(F.url_decode("path"), "^file:/+", "/")
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.path).select(name.alias("f"))
        read = self._table().select(F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/+", "/").alias("f")).distinct()
        return {r[0] for r in files.join(read, "f", "left_anti").select(F.regexp_extract("f", "bucket=([0-9a-f]+)/", 1)).distinct().collect()}

    def ensure(self, wavs: DataFrame, force: bool = False) -> DataFrame:
        """(path, cache_key, n, x) of every file of wavs (path, modified, size), made where the cache lacks them, or anew by force."""
        with Tables(self.spark) as tables:
            wanted = tables.put(self.keyed(wavs), "wanted")
            missing = wanted if force else wanted.join(self.entries().select("cache_key"), "cache_key", "left_anti")
            first = missing.select("path").limit(1).collect()
            if first:
                if self.extractor is None:
                    raise FileNotFoundError(f"no entry for {first[0].path}, and no extractor to make one")
                self._fill(missing.dropDuplicates(["cache_key"]), tables)
        return self.keyed(wavs).select("path", "cache_key").join(self.entries().drop("bucket"), "cache_key")

    def _fill(self, missing: DataFrame, tables: Tables) -> None:
        made = features_of(missing.select("cache_key", "path"), self.extractor, self.width, self.rate, "cache_key")
        made = tables.put(made.select("cache_key", "n", "x", F.xxhash64("x").alias("check"), F.substring("cache_key", 1, self.digits).alias("bucket")), "made")
        stale = self._table().select("cache_key", "bucket").join(made.select("cache_key"), "cache_key", "left_semi")
        again = sorted({r.bucket for r in stale.select("bucket").distinct().collect()} | self._silent_buckets())
        self._write(made.where(~F.col("bucket").isin(again)), "append")
        if again:
            rest = self._table().where(F.col("bucket").isin(again)).where(self._sound()).join(made.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
            whole = tables.put(rest.select(*made.columns).unionByName(made.where(F.col("bucket").isin(again))), "buckets")
            self._write(whole, "overwrite")

    def _write(self, rows: DataFrame, mode: str) -> None:
        """Rows of a folder go to one file; overwriting touches the folders that have rows."""
        rows.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
