"""From a folder of recordings to a table of predictions: features through the cache, rows to train on, heads, scales, the table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affectra.operators.fitting import predicted
from affectra.operators.metrics import DIMS
from affectra.operators.networks import MeanPool, Network, Params
from affectra.operators.payloads import folder_table
from affectra.operators.transforms import minmax
from affectra.sources.cache import FeatureCache, as_frames, features_of
from affectra.sources.files import faults, probe_wavs, refuse_bad_audio, wav_folder, write_csv


def over_frames(network: Network) -> Network:
    """A network over pooled vectors as one over frames: each branch begins with their mean."""
    branches = tuple((names, [MeanPool(), *layers]) for names, layers in network.branches)
    return replace(network, branches=branches, classifier=network.classifier if network.mediated else [MeanPool(), *network.classifier])


def dataset(annotations: DataFrame, features: DataFrame, fitted: DataFrame, labels: tuple[str, ...], width: int = 768, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """(utt_id, frames, class_idx, and each dimension on the training rows' scale, null without a label).

    annotations: audio, emotion, audio_path and dimensions; features: path, n, x
    of the cache; fitted: the one row of fit_minmax. Unknown labels and
    annotations without features are refused.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rows = annotations.withColumn("_p", plain("audio_path")).join(features.select(plain("path").alias("_p"), "n", "x"), "_p", "left").join(F.broadcast(fitted))
    label = F.array_position(F.array(*map(F.lit, labels)), F.col("emotion")) - 1
    scaled = {d: F.when(F.col(f"trained_{d}"), minmax(F.col(d), F.col(f"lo_{d}"), F.col(f"hi_{d}"), F.lit(True))) for d in dims}
    lost = F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("no features for "), "audio_path"))).when(label < 0, F.raise_error(F.concat(F.lit("unknown label "), "emotion")))
    return rows.select(F.col("audio").alias("utt_id"), F.coalesce(lost.cast("array<array<float>>"), as_frames(F.col("n"), F.col("x"), width)).alias("frames"), label.cast("int").alias("class_idx"), *(c.alias(d) for d, c in scaled.items()))


def predict_folder(spark: SparkSession, folder: str, cache: FeatureCache, network: Network, weights: Params, labels: tuple[str, ...], fitted: DataFrame, out: str | None = None) -> DataFrame:
    """The table of a folder's predictions, also as one CSV file in order of names if out says where.

    All unreadable files are named in one error before any is decoded. network
    takes frames and predicts Valence, Arousal and Dominance.
    """
    wavs = wav_folder(spark, folder)
    refuse_bad_audio(faults(probe_wavs(spark, folder), cache.rate))
    features = cache.ensure(wavs)
    made = folder_table(predicted(features.select("path", as_frames(F.col("n"), F.col("x"), cache.width).alias("frames")), network, weights, "frames", ["path"]), labels, fitted)
    if out:
        write_csv(made, out, ["audio_file"])
    return made


def predict_stream(spark: SparkSession, folder: str, extractor: Callable, network: Network, weights: Params, labels: tuple[str, ...], fitted: DataFrame, out: str, checkpoint: str, width: int = 768, rate: int | None = 16000):
    """The same table for files as they arrive: what is there is done in order of arrival, each file once; returns the running query."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.wav").load(folder)
    features = features_of(files.select("path", "content"), extractor, width, rate, "path")
    made = folder_table(predicted(features.select("path", as_frames(F.col("n"), F.col("x"), width).alias("frames")), network, weights, "frames", ["path"]), labels, fitted)
    return made.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
