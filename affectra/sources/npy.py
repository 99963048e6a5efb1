"""Matrices in .npy files as a Spark data source, format "npy": rows are (row long, feat array<float>).

Reading gives each task a range of rows, of which it reads those bytes alone.
Writing is positional: every row goes to the place that its number says, in a
file of the attempt's own, so tasks write side by side, in any order, and again
after a loss, and what a lost attempt still writes touches nothing. A new file
takes its name when all rows are there. Appended rows are copied behind the old
ones then, file to file, and the header, which alone makes them count, is
replaced last. So whoever reads meanwhile, or after a failure, sees the old file
whole. One writer at a time; the file lies on a folder that all executors mount.
"""

from __future__ import annotations

import ast
import io
import os
import shutil
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from affectra.functions.cluster import ship

from .stores import located, opened, size

SCHEMA = "row long, feat array<float>"
#: Bytes that a header takes in files made here: room for any number of rows.
HEADER = 128
#: Bytes of rows that travel at once.
PIECE = 8 << 20


@dataclass(frozen=True)
class Header:
    shape: tuple[int, ...]
    dtype: np.dtype
    start: int
    fortran: bool = False

    @classmethod
    def read(cls, path: str) -> Header:
        with opened(path) as f:
            head = f.read(12)
            if head[:6] != b"\x93NUMPY":
                raise ValueError(f"{path}: not an .npy file")
            wide = head[6] >= 2
            n = struct.unpack_from("<I" if wide else "<H", head, 8)[0]
            start = 12 if wide else 10
            d = ast.literal_eval((head[start:] + f.read(n)).decode("latin1")[:n])
        return cls(d["shape"], np.dtype(d["descr"]), start + n, d["fortran_order"])

    def matrix(self, path: str, width: int | None) -> tuple[int, int]:
        """Rows and width; one vector is a row."""
        shape = self.shape if len(self.shape) == 2 else (1, *self.shape)
        if len(shape) != 2 or self.fortran or self.dtype.kind != "f" or (width is not None and shape[1] != width):
            raise ValueError(f"{path}: {self.dtype} {self.shape} is no matrix of floats in row order" + (f", {width} wide" if width is not None else ""))
        return shape

    def bytes(self) -> bytes:
        """The header, as long as `start` says."""
        d = repr({"descr": np.lib.format.dtype_to_descr(self.dtype), "fortran_order": False, "shape": self.shape}).encode("latin1")
        if len(d) + 11 > self.start:
            raise ValueError(f"{self.shape} doesn't fit a header of {self.start} bytes")
        return b"\x93NUMPY\x01\x00" + struct.pack("<H", self.start - 10) + d.ljust(self.start - 11) + b"\n"


@dataclass
class Range(InputPartition):
    first: int
    rows: int

    def __init__(self, first: int, rows: int):
        self.first, self.rows = first, rows


class Reader(DataSourceReader):
    def __init__(self, path: str, width: int | None, rows: int):
        self.path, self.rows, self.header = path, rows, Header.read(path)
        self.shape = self.header.matrix(path, width)
        have = size(path) - self.header.start
        if have < self.shape[0] * self.shape[1] * self.header.dtype.itemsize:
            raise ValueError(f"{path}: {have} bytes behind the header, fewer than {self.shape} need")

    def partitions(self) -> list[Range]:
        return [Range(i, min(self.rows, self.shape[0] - i)) for i in range(0, self.shape[0], self.rows)] or [Range(0, 0)]

    def read(self, partition: Range):
        width, step = self.shape[1], self.header.dtype.itemsize
        most = max(1, PIECE // max(1, width * step))
        with opened(self.path) as f:
            for i in range(partition.first, partition.first + partition.rows, most):
                n = min(most, partition.first + partition.rows - i)
                raw = f.read_at(n * width * step, self.header.start + i * width * step)
                x = np.frombuffer(raw, dtype=self.header.dtype).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + n)), lists], names=["row", "feat"])


@dataclass
class Wrote(WriterCommitMessage):
    """What a task wrote: rows, and the sums of their numbers and squares, which tell whether each number is there once."""

    n: int
    total: int
    squares: int


class Writer(DataSourceArrowWriter):
    """Puts rows at their places, behind what is there when appending."""

    def __init__(self, path: str, overwrite: bool, width: int | None):
        system, self.path = located(path)
        if system.type_name != "local":
            raise ValueError(f"{path}: rows are put at their places on a mounted folder only")
        self.old = None if overwrite or not os.path.exists(self.path) else Header.read(self.path)
        self.base, self.width = self.old.matrix(self.path, width) if self.old else (0, width)
        if self.old and self.old.dtype != np.dtype("<f4"):
            raise ValueError(f"{path} holds {self.old.dtype}, not 32-bit floats")
        if self.width is None:
            raise ValueError("a new .npy file needs the option width")
        if self.old:
            Header((1 << 62, self.width), self.old.dtype, self.old.start).bytes()  # there is room to count any rows
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        self.target = f"{self.path}.{uuid.uuid4().hex}"
        with open(self.target, "wb"):
            pass

    def write(self, batches) -> Wrote:
        n = total = squares = 0
        with open(self.target, "r+b") as f:
            for b in batches:
                rows = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if not len(rows):
                    continue
                lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False)
                if (lengths != self.width).any() or rows.min() < 0:
                    raise ValueError(f"rows need a number from 0 and {self.width} values")
                x = x.reshape(len(rows), self.width).astype("<f4")
                for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows) != 1) + 1):
                    f.seek(HEADER + int(rows[part[0]]) * self.width * 4)
                    f.write(x[part].tobytes())
                n += len(rows)
                numbers = rows.tolist()
                total, squares = total + sum(numbers), squares + sum(i * i for i in numbers)
            f.flush()
            os.fsync(f.fileno())
        return Wrote(n, total, squares)

    def commit(self, messages: list[Wrote | None]) -> None:
        done = [m for m in messages if m is not None]
        n, total, squares = (sum(getattr(m, k) for m in done) for k in ("n", "total", "squares"))
        if total != n * (n - 1) // 2 or squares != (n - 1) * n * (2 * n - 1) // 6:
            self.abort(messages)
            raise ValueError(f"{self.path}: rows are not numbered 0 to {n - 1}, each once")
        size_ = n * self.width * 4
        with open(self.target, "r+b") as f:
            f.truncate(HEADER + size_)
            f.write(Header((n, self.width), np.dtype("<f4"), HEADER).bytes())
            f.flush()
            os.fsync(f.fileno())
        if self.old is None:
            os.replace(self.target, self.path)
            return
        with open(self.target, "rb") as new, open(self.path, "r+b") as f:
            end = self.old.start + self.base * self.width * 4
            new.seek(HEADER)
            f.seek(end)
            shutil.copyfileobj(new, f, PIECE)
            f.truncate(end + size_)
            f.flush()
            os.fsync(f.fileno())
            f.seek(0)
            f.write(Header((self.base + n, self.width), np.dtype("<f4"), self.old.start).bytes())
            f.flush()
            os.fsync(f.fileno())
        os.remove(self.target)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.target):
            os.remove(self.target)


class NpySource(DataSource):
    """Options: path; width (needed for a new file, checked otherwise); rows (of a task, 4096 by default)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def _width(self) -> int | None:
        return int(self.options["width"]) if "width" in self.options else None

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._width(), int(self.options.get("rows", 4096)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, self._width())


def register(spark: SparkSession) -> None:
    """Makes format "npy" known to the session."""
    ship(spark)
    spark.dataSource.register(NpySource)


def read_matrix(spark: SparkSession, path: str, width: int | None = None, rows: int = 4096) -> DataFrame:
    """(row, feat) of an .npy file, a task for each range of rows."""
    register(spark)
    source = spark.read.format("npy").option("rows", str(rows))
    return (source if width is None else source.option("width", str(width))).load(path)


def append_utterances(frames: DataFrame, lengths: DataFrame, prefix: str, width: int = 768, append: bool = False) -> None:
    """<prefix>.npy with all frames in order of utterances, and <prefix>.lengths with their numbers, those of 0 too.

    frames: utt_idx, frame_idx, feat; lengths: utt_idx, n_frames of every
    utterance. Unless append, what was there is replaced; else both go behind it.
    An utterance whose frames aren't all there is refused, and the old files stay.
    """
    from affectra.operators.offsets import offsets

    from . import files

    spark = frames.sparkSession
    register(spark)
    spans = offsets(lengths.select("utt_idx", "n_frames"))
    placed = frames.join(spans, "utt_idx").select((F.col("frame_offset") + F.col("frame_idx")).cast("long").alias("row"), F.col("feat").cast("array<float>").alias("feat"))
    before = None
    if append and size(f"{prefix}.lengths") is not None:
        before = files.lines(spark, f"{prefix}.lengths").select(F.col("utt_idx"), F.col("line").alias("n"), F.lit(0).alias("part"))
    total = lengths.agg(F.sum("n_frames")).first()[0] or 0
    have = frames.count()
    if total != have:
        raise ValueError(f"{prefix}: lengths sum to {total}, there are {have} frames")
    placed.write.format("npy").mode("append" if append else "overwrite").option("width", str(width)).save(f"{prefix}.npy")
    rows = lengths.select("utt_idx", F.col("n_frames").cast("string").alias("n"), F.lit(1).alias("part"))
    files.write_file(rows if before is None else before.unionByName(rows), F.col("n"), ["part", "utt_idx"], f"{prefix}.lengths")


GRANULARITY = ("frame", "utterance")


def save_features(rows: DataFrame, folder: str, granularity: str = "frame", name: str = "name", frames: str = "frames") -> DataFrame:
    """(path, n_frames): an .npy file <folder>/<name>.npy for each row, its frames [T, D] or, by utterance, their mean [D].

    Tasks write the files, each under a name of its own until it is whole.
    Reading the result does the work, so write or count it.
    """
    if granularity not in GRANULARITY:
        raise ValueError(f"granularity {granularity!r} is neither frame nor utterance")
    ship(rows.sparkSession)
    _, top = located(folder)

    def run(batches):
        os.makedirs(top, exist_ok=True)
        for b in batches:
            made: list = []
            for who, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.asarray(x, dtype=np.float32)
                out = io.BytesIO()
                np.save(out, a if granularity == "frame" else a.mean(axis=0), allow_pickle=False)
                path = f"{top}/{who}.npy"
                with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(out.getbuffer())
                os.replace(f.name, path)
                made.append((path, len(a)))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "n_frames"])

    return rows.select(name, frames).mapInArrow(run, "path string, n_frames long")
