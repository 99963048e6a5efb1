"""Readers and writers of the reference's file formats as DataFrames.

Text files are read whole and split by line so that every row has its position,
utt_idx: rows of sibling files belong together by position. Files of labels are
small; frames are read by ranges of rows.
"""

from __future__ import annotations

import json
import struct
from dataclasses import asdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affectra.functions.cluster import ship
from affectra.operators.offsets import offsets

#: Default class list of the emotion files.
LABELS = ("hap", "sad", "ang", "dis")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(utt_idx, line) of a text file; the newline at its end makes no line."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r?\n\z", "").alias("v"))
    return whole.select(F.posexplode(F.split("v", "\r?\n", -1)).alias("utt_idx", "line")).withColumn("utt_idx", F.col("utt_idx").cast("long"))


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).withColumn("f", F.split("line", "\t", -1))


def _reject(df: DataFrame, broken: Column, what: str, path: str) -> DataFrame:
    bad = df.where(F.coalesce(broken, F.lit(True))).orderBy("utt_idx").limit(20).collect()
    if bad:
        raise ValueError(f"{path}: {what} in line {', '.join(str(r.utt_idx + 1) for r in bad)}")
    return df


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    df = lines(spark, path).withColumn("n_frames", F.trim("line").try_cast("int"))
    return _reject(df, F.col("n_frames").isNull() | (F.col("n_frames") < 0), "no length", path).select("utt_idx", "n_frames")


def read_vad(spark: SparkSession, path: str, mixed: bool = False) -> DataFrame:
    """(utt_idx, utt_id, valence, arousal, dominance); Dominance is null where a line has three fields.

    Unless mixed, all lines have as many fields. NaN passes the range check.
    """
    df = _fields(spark, path)
    n = F.size("f")
    _reject(df, ~n.isin(3, 4), "neither three nor four fields", path)
    if not mixed and df.agg(F.count_distinct(n)).first()[0] > 1:
        raise ValueError(f"{path}: lines have three fields here and four there")
    x = [F.get("f", F.lit(i)).try_cast("double") for i in (1, 2, 3)]
    out = df.select("utt_idx", F.get("f", F.lit(0)).alias("utt_id"), x[0].alias("valence"), x[1].alias("arousal"), F.when(n == 4, x[2]).alias("dominance"), (n == 4).alias("_d"))
    _reject(out, F.col("utt_id") == "", "no id", path)
    _reject(out, F.col("valence").isNull() | F.col("arousal").isNull() | (F.col("_d") & F.col("dominance").isNull()), "no number", path)
    for d in ("valence", "arousal", "dominance"):
        _reject(out, F.coalesce(~F.isnan(d) & (F.abs(d) > 1), F.lit(False)), f"{d} outside -1 to 1", path)
    return out.drop("_d")


def read_emotions(spark: SparkSession, path: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(utt_idx, utt_id, label, class_idx) with a closed list of at least two different labels."""
    if len(labels) < 2 or len(set(labels)) < len(labels) or not all(labels):
        raise ValueError("two or more different labels, none empty")
    df = _fields(spark, path)
    _reject(df, F.size("f") != 2, "not two fields", path)
    place = F.array_position(F.array(*map(F.lit, labels)), F.get("f", F.lit(1))) - 1
    out = df.select("utt_idx", F.get("f", F.lit(0)).alias("utt_id"), F.get("f", F.lit(1)).alias("label"), place.cast("int").alias("class_idx"))
    _reject(out, F.col("utt_id") == "", "no id", path)
    return _reject(out, F.col("class_idx") < 0, "unknown label", path)


def read_lenient_labels(spark: SparkSession, path: str | None) -> DataFrame:
    """(utt_idx, label): the second of the fields that white space parts; without a file no rows, so that labels join as null."""
    if path is None:
        return spark.createDataFrame([], "utt_idx long, label string")
    return lines(spark, path).select("utt_idx", F.get(F.split(F.trim("line"), r"\s+"), F.lit(1)).alias("label"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(utt_idx, root, rel_path, path, n_samples) of a manifest: its root, then a path and a size a line."""
    df = lines(spark, path).where(F.trim("line") != "")
    root = df.where("utt_idx = 0").select(F.trim("line").alias("root"))
    f = F.split("line", "\t")
    rows = df.where("utt_idx > 0").select((F.col("utt_idx") - 1).alias("utt_idx"), F.get(f, F.lit(0)).alias("rel_path"), F.get(f, F.lit(1)).try_cast("long").alias("n_samples"))
    return rows.join(F.broadcast(root)).withColumn("path", F.concat_ws("/", "root", "rel_path"))


def read_scp(spark: SparkSession, path: str) -> DataFrame:
    """(utt_idx, name, path): a name, a blank and a path a line."""
    f = F.split(F.trim("line"), r"\s+", 2)
    return lines(spark, path).where(F.trim("line") != "").select("utt_idx", F.get(f, F.lit(0)).alias("name"), F.get(f, F.lit(1)).alias("path"))


def read_evaluations(spark: SparkSession, glob: str, labels: tuple[str, ...]) -> DataFrame:
    """(file, utt_id, label): lines with "Ses" of tab-separated evaluation texts, their second and third field, exc merged into hap."""
    from affectra.operators.transforms import merged_label

    rows = spark.read.text(glob).select(F.col("_metadata.file_path").alias("file"), "value").where(F.contains("value", F.lit("Ses")))
    f = F.split("value", "\t")
    return rows.select("file", F.get(f, F.lit(1)).alias("utt_id"), merged_label(F.get(f, F.lit(2))).alias("label")).where(F.col("label").isin(*labels))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte order mark before the first name goes."""
    df = spark.read.csv(path, header=True)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def read_annotations(spark: SparkSession, path: str, names: dict[str, str], audio_dir: str) -> DataFrame:
    """audio, speaker, emotion, valence, arousal, dominance, audio_path by the given column names; dominance may be missing.

    Blank keys and labels that are no finite numbers are refused, all in one message.
    """
    from affectra.operators import metrics, transforms

    df = read_csv(spark, path)
    missing = [v for k, v in names.items() if k != "dominance" and v not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    raw = df.select(*(F.col(names[k]).alias(k) for k in ("audio", "speaker", "emotion", "valence", "arousal")), (F.col(names["dominance"]) if names.get("dominance") in df.columns else F.lit(None).cast("string")).alias("dominance"))
    bad = [F.col(c).isNull() | (F.trim(c) == "") for c in ("audio", "speaker", "emotion")]
    bad += [~F.coalesce(metrics.finite(F.col(c).try_cast("double")), F.lit(False)) for c in ("valence", "arousal")]
    bad.append(F.col("dominance").isNotNull() & ~F.coalesce(metrics.finite(F.col("dominance").try_cast("double")), F.lit(False)))
    broken = bad[0]
    for b in bad[1:]:
        broken = broken | b
    rows = raw.where(broken).limit(20).collect()
    if rows:
        raise ValueError(f"{path}: blank keys or bad numbers: {[r.asDict() for r in rows]}")
    return raw.withColumns({c: F.col(c).cast("double") for c in ("valence", "arousal", "dominance")}).withColumn("audio_path", transforms.absolute(F.col("audio"), audio_dir))


def read_vad_csv(spark: SparkSession, path: str, audio_dir: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Prepared labels of a CSV: file_path below audio_dir where it is relative, numbers as doubles, blank ones NaN, split and session as they stand.

    Columns go by the given names; rows without file_path are refused.
    """
    from affectra.operators import transforms

    df = transforms.prepared_labels(read_csv(spark, path), names or {})
    if not df.where(F.col("file_path").isNull() | (F.trim("file_path") == "")).isEmpty():
        raise ValueError(f"{path}: rows without file_path")
    nan = {d: F.coalesce(F.col(d), F.lit(float("nan"))) for d in ("valence", "arousal", "dominance")}
    return df.withColumns(nan).withColumn("file_path", transforms.absolute(F.col("file_path"), audio_dir) if audio_dir else F.col("file_path"))


def read_frames(spark: SparkSession, path: str, width: int = 768, rows: int = 4096) -> DataFrame:
    """(row, feat) of a two-dimensional .npy matrix, in ranges of rows, from wherever Arrow reads."""
    from .npy import read_matrix

    return read_matrix(spark, path, width, rows)


def read_prefix(spark: SparkSession, prefix: str, width: int = 768, shortest: int = 1, longest: int | None = None, mixed: bool = False, labels: tuple[str, ...] = LABELS, emotions: bool = True) -> DataFrame:
    """One row per frame of utterances within the length limits, with labels: .npy, .lengths, .vad and .emo side by side.

    utt_idx, frame_idx, feat, n_frames, utt_id, valence, arousal, dominance, label, class_idx. Counts and ids of
    the files must agree.
    """
    lengths = read_lengths(spark, prefix + ".lengths")
    vad = read_vad(spark, prefix + ".vad", mixed)
    frames = read_frames(spark, prefix + ".npy", width)
    counts = {"lengths": lengths.count(), "vad": vad.count()}
    total, have = lengths.agg(F.sum("n_frames")).first()[0], frames.count()
    if total != have:
        raise ValueError(f"{prefix}: lengths sum to {total}, the matrix has {have} rows")
    joined = vad
    if emotions:
        emo = read_emotions(spark, prefix + ".emo", labels)
        counts["emo"] = emo.count()
        differ = vad.join(emo.select("utt_idx", F.col("utt_id").alias("other"), "label", "class_idx"), "utt_idx").where("utt_id <> other").limit(1).collect()
        if differ:
            raise ValueError(f"{prefix}: line {differ[0].utt_idx + 1} is {differ[0].utt_id} here and {differ[0].other} there")
        joined = vad.join(emo.select("utt_idx", "label", "class_idx"), "utt_idx")
    if len(set(counts.values())) > 1:
        raise ValueError(f"{prefix}: row counts differ: {counts}")
    spans = offsets(lengths).where(F.col("n_frames").between(shortest, longest if longest is not None else 2**31 - 1))
    rows = spans.where("n_frames > 0").select("utt_idx", "n_frames", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame_idx"), "frame_offset")
    placed = rows.withColumn("row", (F.col("frame_offset") + F.col("frame_idx")).cast("long")).join(frames, "row")
    return placed.select("utt_idx", "frame_idx", "feat", "n_frames").join(joined, "utt_idx")


def decode_sound(content: bytes, rate: int | None = 16000) -> dict:
    """As decode_wav, for any WAV of whole or floating samples: 8, 16, 24 and 32 bits, 32- and 64-bit floats."""
    head = _chunks(content)
    if isinstance(head, str):
        return {"error": f"unreadable: {head}"}
    kind, channels, hz, bits, data = head
    meta = {"channels": channels, "sample_rate": hz, "sample_width": (bits + 7) // 8, "n_samples": len(data) // max(1, channels * ((bits + 7) // 8))}
    known = (kind == 1 and bits in (8, 16, 24, 32)) or (kind == 3 and bits in (32, 64))
    error = next((e for ok, e in ((known, "sample format"), (channels == 1, "not mono"), (rate is None or hz == rate, "sample rate"), (meta["n_samples"] > 0, "empty")) if not ok), None)
    if error:
        return meta | {"error": error}
    raw = data[: meta["n_samples"] * meta["sample_width"]]
    if kind == 3:
        a = np.frombuffer(raw, dtype=f"<f{bits // 8}").astype(np.float64)
    elif bits == 8:
        a = (np.frombuffer(raw, dtype=np.uint8) - 128.0) / 128
    elif bits == 24:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
        a = np.concatenate([np.zeros((len(b), 1), dtype=np.uint8), b], axis=1).reshape(-1).view("<i4") / 2.0**31
    else:
        a = np.frombuffer(raw, dtype=f"<i{bits // 8}") / 2.0 ** (bits - 1)
    return meta | {"samples": a.astype(np.float32).tolist()}


def _chunks(content: bytes) -> tuple[int, int, int, int, bytes] | str:
    """Kind of samples (1 whole, 3 floating), channels, rate, bits and data of a WAV file, or what is wrong with it."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return "no RIFF WAVE file"
    at, form = 12, None
    while at + 8 <= len(content):
        name, n = struct.unpack_from("<4sI", content, at)
        body = content[at + 8 : at + 8 + n]
        if name == b"fmt " and n >= 16 and len(body) >= 16:
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == 0xFFFE and len(body) >= 26:  # the kind is told in an extension
                form = struct.unpack_from("<H", body, 24) + form[1:]
        elif name == b"data":
            return (form[0], form[1], form[2], form[5], body) if form else "no format before the samples"
        at += 8 + n + n % 2
    return "no samples"


def decode_wav(content: bytes, rate: int | None = 16000) -> dict:
    """Metadata and samples in -1..1 of an 8-, 16- or 32-bit PCM mono file; `error` says what is wrong."""
    import io
    import wave

    try:
        with wave.open(io.BytesIO(content)) as w:
            meta = {"channels": w.getnchannels(), "sample_rate": w.getframerate(), "sample_width": w.getsampwidth(), "n_samples": w.getnframes()}
            raw = w.readframes(w.getnframes())
    except (wave.Error, EOFError) as e:
        return {"error": f"unreadable: {e}"}
    kind = {1: ("u1", 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}.get(meta["sample_width"])
    error = next((e for ok, e in ((kind, "sample width"), (meta["channels"] == 1, "not mono"), (rate is None or meta["sample_rate"] == rate, "sample rate"), (meta["n_samples"] > 0, "empty")) if not ok), None)
    if error:
        return meta | {"error": error}
    a = (np.frombuffer(raw, dtype=kind[0]).astype(np.float64) - kind[1]) / kind[2]
    return meta | {"samples": a.astype(np.float32).tolist()}


WAV = "path string, channels int, sample_rate int, sample_width int, n_samples long, samples array<float>, error string"


def read_wavs(spark: SparkSession, folder: str, rate: int | None = 16000, decode=decode_wav) -> DataFrame:
    """The .wav files of a folder (not below it) decoded, a row each; errors are a column, to be raised together. decode: decode_wav, or decode_sound for more formats."""
    ship(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select("path", "content")

    def run(batches):
        for b in batches:
            rows = [{"path": p} | decode(c, rate) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            kinds = {"path": pa.string(), "channels": pa.int32(), "sample_rate": pa.int32(), "sample_width": pa.int32(), "n_samples": pa.int64(), "samples": pa.list_(pa.float32()), "error": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    return found.mapInArrow(run, WAV)


def wav_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, size) of a folder's .wav files in order of path; a folder without any is refused."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    if found.isEmpty():
        raise ValueError(f"{folder}: no .wav file")
    return found.orderBy("path")


def wav_header(path: str) -> tuple:
    """(channels, sample_rate, sample_width, n_samples, error) of a WAV file, of which only the heads of its chunks are read."""
    from .stores import opened

    try:
        with opened(path) as f:
            head, at, end = f.read_at(12, 0), 12, f.size()
            if head[:4] != b"RIFF" or head[8:] != b"WAVE":
                raise ValueError("no RIFF WAVE file")
            kind = None
            while at + 8 <= end:
                name, n = struct.unpack("<4sI", f.read_at(8, at))
                if name == b"fmt ":
                    kind = struct.unpack("<HHIIHH", f.read_at(16, at + 8))
                    if kind[0] not in (1, 0xFFFE):
                        raise ValueError(f"format {kind[0]} is not PCM")
                elif name == b"data":
                    if kind is None or not kind[4]:
                        raise ValueError("no format before the samples")
                    return kind[1], kind[2], (kind[5] + 7) // 8, min(n, end - at - 8) // kind[4], None
                at += 8 + n + n % 2
            raise ValueError("no samples")
    except (OSError, ValueError, struct.error) as e:
        return None, None, None, None, f"unreadable: {e}"


def probe_wavs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, channels, sample_rate, sample_width, n_samples, error) from the heads of chunks: bytes read don't grow with the files."""
    ship(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select("path")

    def run(batches):
        for b in batches:
            rows = [(p, *wav_header(p)) for p in b.column(0).to_pylist()]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["path", "channels", "sample_rate", "sample_width", "n_samples", "error"])

    return found.mapInArrow(run, "path string, channels int, sample_rate int, sample_width int, n_samples long, error string")


def faults(probed: DataFrame, rate: int | None = 16000) -> DataFrame:
    """probed with the first fault of each file as its error: unreadable, sample width, channels, rate, or no samples."""
    rules = ((F.col("sample_width").isin(1, 2, 4), "sample width"), (F.col("channels") == 1, "not mono"), (F.lit(rate is None) | (F.col("sample_rate") == F.lit(rate)), "sample rate"), (F.col("n_samples") > 0, "empty"))
    return probed.withColumn("error", F.coalesce("error", *(F.when(~ok, text) for ok, text in rules)))


def refuse_bad_audio(wavs: DataFrame, most: int = 20) -> DataFrame:
    """wavs, or one error that names its unreadable files, the first `most` by path."""
    bad = wavs.where("error is not null").orderBy("path").select("path", "error").limit(most).collect()
    if bad:
        raise ValueError("; ".join(f"{r.path}: {r.error}" for r in bad))
    return wavs


def missing_audio(rows: DataFrame, path: str, wavs: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` paths of rows that no file has; wavs lists files by path, as Spark names them."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    have = wavs.select(plain("path").alias("_p"))
    return rows.select(plain(path).alias(path)).distinct().join(have, F.col(path) == F.col("_p"), "left_anti").orderBy(path).limit(most)


def attach_cache_paths(rows: DataFrame, cache: str, key: str = "cache_key") -> DataFrame:
    """rows with cache_path, the file of a key below the cache's folder."""
    return rows.withColumn("cache_path", F.concat(F.lit(cache.rstrip("/") + "/"), key, F.lit(".npy")))


def spectral(samples: list[float], window: int = 400, width: int = 768) -> np.ndarray:
    """Magnitude spectra of windows, the last one zero-padded, each over its maximum: a demonstration, no estimate of emotion."""
    a = np.asarray(samples, dtype=np.float64)
    a = np.pad(a, (0, -len(a) % window if len(a) else window)).reshape(-1, window)  # no sample is one empty window
    m = np.abs(np.fft.rfft(a, n=2 * width - 2, axis=1))[:, :width]
    return (m / np.maximum(m.max(axis=1, keepdims=True), 1e-8)).astype(np.float32)


def extract(wavs: DataFrame, extractor=spectral, normalise: bool = False) -> DataFrame:
    """(path, frame_idx, feat): any callable samples -> [frames, width], utterance by utterance.

    normalise: samples less their mean over their deviation first.
    """
    from .encoders import normalised

    ship(wavs.sparkSession)

    def run(batches):
        for b in batches:
            for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.asarray(s, dtype=np.float64)
                a = np.asarray(extractor(normalised(s) if normalise else s), dtype=np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(a)), pa.array(range(len(a)), pa.int32()), pa.array(list(a), pa.list_(pa.float32()))], names=["path", "frame_idx", "feat"])

    return wavs.where("error is null").select("path", "samples").mapInArrow(run, "path string, frame_idx int, feat array<float>")


# sinks


def _as_file(spark: SparkSession, path: str, suffix: str, write) -> None:
    """One file at path: write(folder) makes it in a folder beside, and it takes its name when it is whole."""
    import uuid

    from affectra.functions.storage import Path

    beside = f"{path}.{uuid.uuid4().hex}"
    try:
        write(beside)
        Path(spark, Path(spark, beside).children(suffix)[0]).move(path)
    finally:
        Path(spark, beside).delete()


def _in_order(df: DataFrame, order: list[str]) -> DataFrame:
    return df.repartition(1).sortWithinPartitions(*order)


def write_file(df: DataFrame, line: Column, order: list[str], path: str) -> None:
    """One text file in order; label files are small."""
    rows = _in_order(df.select(*order, line.alias("value")), order).select("value")
    _as_file(df.sparkSession, path, ".txt", lambda to: rows.write.text(to))


def write_lines(df: DataFrame, line: Column, order: str, path: str) -> None:
    """One ordered text file in a folder; label files are small."""
    df.select(order, line.alias("value")).repartitionByRange(1, order).sortWithinPartitions(order).select("value").write.mode("overwrite").text(path)


def write_lengths(df: DataFrame, path: str) -> None:
    write_lines(df, F.col("n_frames").cast("string"), "utt_idx", path)


def write_labels(df: DataFrame, emotions: str, vad: str) -> dict:
    """The tab-separated emotion file and the space-separated label file, in the same order; written and skipped counts.

    Each file is one job; the counts are observed while the first is written.
    """
    from pyspark.sql import Observation

    whole = F.col("label").isNotNull() & F.col("valence").isNotNull() & F.col("arousal").isNotNull()
    seen = Observation()
    counted = df.observe(seen, F.count_if(whole).alias("written"), F.count_if(~whole).alias("skipped"))
    write_file(counted.where(whole), F.concat_ws("\t", "utt_id", "label"), ["utt_idx"], emotions)
    write_file(df.where(whole), F.concat_ws(" ", "utt_id", F.col("valence").cast("string"), F.col("arousal").cast("string")), ["utt_idx"], vad)
    return {k: seen.get[k] for k in ("written", "skipped")}


def write_json(payload: dict, path: str | None = None) -> str:
    text = json.dumps(payload, sort_keys=True, ensure_ascii=False, indent=2) + "\n"
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def write_manifest(df: DataFrame, root: str, path: str) -> None:
    """The root, then a path below it and a number of samples a line, in order of utt_idx."""
    from affectra.operators.transforms import relative

    rows = df.select("utt_idx", F.concat_ws("\t", relative(F.col("path"), root), F.col("n_samples").cast("string")).alias("line"))
    head = df.sparkSession.createDataFrame([(-1, root)], "utt_idx long, line string")
    write_lines(head.unionByName(rows), F.col("line"), "utt_idx", path)


def joined_sessions(sessions: list[DataFrame]) -> DataFrame:
    """Tables of several sessions, one behind another: utt_idx counts on from session to session."""
    out, base = None, 0
    for df in sessions:
        part = df.withColumn("utt_idx", F.col("utt_idx") + base)
        out = part if out is None else out.unionByName(part)
        base += df.count()
    if out is None:
        raise ValueError("no session")
    return out


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One CSV file at path, with a header that a byte order mark begins; folders above it are made.

    Rows come in the order of the columns named, else in the order that df has.
    A table of predictions is small: one task writes it.
    """
    first = df.columns[0]
    rows = _in_order(df, order) if order else df.coalesce(1)
    named = rows.withColumnRenamed(first, "\ufeff" + first)
    _as_file(df.sparkSession, path, ".csv", lambda to: named.write.csv(to, header=True, emptyValue=""))


def write_normalized(df: DataFrame, columns: list[str], path: str) -> str:
    """The table with columns on 0..1, as CSV beside the original: <name>_normalized.csv, which is returned."""
    from affectra.operators.transforms import rescale_auto

    to = path.removesuffix(".csv") + "_normalized.csv"
    write_csv(rescale_auto(df, columns), to)
    return to


def save_parallel(spark: SparkSession, weights: dict[str, np.ndarray], config: dict, path: str) -> dict:
    """Weights of the heads emotion, valence, arousal and dominance (a row of input width + 1 each output) once they fit the configuration."""
    from affectra.operators.payloads import KIND, HeadsConfig

    full = HeadsConfig.of({"model_type": KIND} | config)
    want = {"emotion": full.num_classes, "valence": 1, "arousal": 1, "dominance": 1}
    for head, n in want.items():
        got = np.atleast_2d(weights[head]).shape if head in weights else None
        if got != (n, full.input_dim + 1):
            raise ValueError(f"{head}: {got} instead of {(n, full.input_dim + 1)}")
    saved = {"model_type": KIND} | config | asdict(full)
    save_model(spark, weights, saved, path)
    return saved


def save_model(spark: SparkSession, weights: dict[str, np.ndarray], metadata: dict, path: str) -> None:
    """Weights as rows (layer, row, weights) and metadata as JSON text, both in one Parquet folder each."""
    rows = [(k, i, [float(x) for x in w]) for k, a in weights.items() for i, w in enumerate(np.atleast_2d(a))]
    spark.createDataFrame(rows, "layer string, row int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], dict]:
    """Weights by layer, names rid of "head." and "module.", and metadata. A head has few rows."""
    pdf: pd.DataFrame = spark.read.parquet(f"{path}/weights").toPandas()
    weights = {k.removeprefix("module.").removeprefix("head."): np.vstack(g.sort_values("row")["weights"].to_list()) for k, g in pdf.groupby("layer")}
    return weights, json.loads(spark.read.parquet(f"{path}/metadata").first()[0])
