"""Views with the engine's schemas over the driver's tables, which hold no audio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def affect(spark: SparkSession, sf: str) -> DataFrame:
    """Utterances with Valence, Arousal and, for every third, Dominance."""
    k = F.get_json_object("props", "$.k").cast("double")
    e = F.col("event_id")
    u = F.col("user_id") % 10
    return table(spark, sf, "events").select(
        e.alias("utt_id"), F.col("user_id").alias("speaker"), F.col("event_type").alias("emotion"), F.col("value").alias("valence"), k.alias("arousal"),
        F.when(e % 3 == 0, F.col("value") - k).alias("dominance"), (e % 5 + 1).alias("session"), F.when(u < 7, "train").when(u == 7, "valid").otherwise("test").alias("split"),
    )


AFFECT = """affect AS (SELECT event_id AS utt_id, user_id AS speaker, event_type AS emotion, value AS valence, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS arousal,
 CASE WHEN event_id % 3 = 0 THEN value - CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS dominance, event_id % 5 + 1 AS session,
 CASE WHEN user_id % 10 < 7 THEN 'train' WHEN user_id % 10 = 7 THEN 'valid' ELSE 'test' END AS split FROM events)"""


def classes(spark: SparkSession, sf: str) -> DataFrame:
    """Emotion labels with their index in sorted order; a handful of rows."""
    from affectra.operators.metrics import class_index

    return class_index(affect(spark, sf), "emotion")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """affect with predictions pv, pa, pd."""
    b = 0.1 * (F.col("utt_id") % 10)
    return affect(spark, sf).withColumns({"pv": 0.8 * F.col("valence") + b, "pa": 0.8 * F.col("arousal") + b, "pd": 0.8 * F.col("dominance") + b})


def pred(spark: SparkSession, sf: str) -> DataFrame:
    """scored with the true class and a predicted one."""
    a = scored(spark, sf).withColumn("pred_class", ((F.col("utt_id") * 7 + F.length("emotion")) % 5).cast("int"))
    return a.join(F.broadcast(classes(spark, sf).withColumnsRenamed({"label": "emotion", "class_idx": "true_class"})), "emotion")


PRED = (
    AFFECT
    + """, classes AS (SELECT emotion AS label, CAST(row_number() OVER (ORDER BY emotion) - 1 AS INTEGER) AS class_idx FROM (SELECT DISTINCT emotion FROM affect)),
pred AS (SELECT a.*, 0.8 * valence + 0.1 * (utt_id % 10) AS pv, 0.8 * arousal + 0.1 * (utt_id % 10) AS pa, 0.8 * dominance + 0.1 * (utt_id % 10) AS pd,
 CAST((utt_id * 7 + length(emotion)) % 5 AS INTEGER) AS pred_class, c.class_idx AS true_class FROM affect a JOIN classes c ON c.label = a.emotion)"""
)

#: Classes and width of the vectors, and the fixed weights that the heads use there.
CLASSES, WIDTH = 10, 64


def weights(c: int, n: int = WIDTH) -> list[float]:
    return [0.01 * ((7 * c + 3 * j) % 5 - 2) for j in range(n)]


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("utt_id"), F.transform("embedding", lambda x: x.cast("double")).alias("feat"), F.col("label").alias("true_class"))


VECTORS = "vectors AS (SELECT vec_id AS utt_id, CAST(embedding AS DOUBLE[]) AS feat, label AS true_class FROM embeddings)"


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Ragged utterances of 1, 3, 5, ... frames."""
    v, u = F.col("vec_id"), F.floor(F.sqrt(F.col("vec_id").cast("double"))).cast("long")
    return table(spark, sf, "embeddings").select(u.alias("utt_idx"), (v - u * u).alias("frame_idx"), F.transform("embedding", lambda x: x.cast("double")).alias("feat"), (v % 7 != 3).alias("valid"))


FRAMES = "frames AS (SELECT CAST(floor(sqrt(vec_id)) AS BIGINT) AS utt_idx, vec_id - CAST(floor(sqrt(vec_id)) AS BIGINT) * CAST(floor(sqrt(vec_id)) AS BIGINT) AS frame_idx, CAST(embedding AS DOUBLE[]) AS feat, vec_id % 7 <> 3 AS valid FROM embeddings)"


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as utterances, their lines as frames."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("utt_idx")).agg(F.count("*").alias("n_frames"))


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conv_id")
    name = F.concat(F.lit("Ses0"), (c % 5 + 1).cast("string"), F.lit("F_impro"), c.cast("string"), F.lit("_F"), F.col("turn").cast("string"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", name.alias("utt_id"))


UTTS = "utts AS (SELECT conv_id, turn, role, text, 'Ses0' || (conv_id % 5 + 1) || 'F_impro' || conv_id || '_F' || turn AS utt_id FROM conversations)"
