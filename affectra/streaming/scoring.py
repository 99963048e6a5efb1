"""Scoring of feature files as they arrive; the reference has no streaming, the head is the same expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affectra.operators import arrays as A


def scored(features: DataFrame, rows: list[list[float]], labels: list[str]) -> DataFrame:
    """utt_id, label and probability of each row of (utt_id, feat), batch or stream."""
    p = A.softmax(A.linear(F.transform("feat", lambda x: x.cast("double")), rows))
    out = features.select("utt_id", p.alias("p"))
    return out.select("utt_id", F.element_at(F.array(*map(F.lit, labels)), A.argmax(F.col("p")).cast("int") + 1).alias("label"), F.array_max("p").alias("probability"))


def score_stream(spark: SparkSession, folder: str, rows: list[list[float]], labels: list[str], out: str, checkpoint: str):
    """Score Parquet files that arrive in folder into out; returns the running query."""
    stream = spark.readStream.schema("utt_id long, feat array<float>").parquet(folder)
    return scored(stream, rows, labels).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
