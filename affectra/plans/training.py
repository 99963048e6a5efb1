"""Queries that train, and that go by files: each derives what it reads from the driver's tables."""

from __future__ import annotations

import os
import uuid
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from affectra.functions.cluster import ship
from affectra.functions.storage import shared_dir
from affectra.operators import fitting as G
from affectra.operators import networks as N
from affectra.operators import splits as S
from affectra.operators.arrays import frame_slice
from affectra.operators.profile import duplicated
from affectra.operators.transforms import prepared_labels
from affectra.sources import files as R
from affectra.sources import npy as Y
from affectra.sources.cache import FeatureCache, as_frames

from . import proxies as X
from .catalogue import query, r6

HIDDEN, SEED = 16, 42


def labelled(spark, sf):
    """Vectors with targets: the first three components, Dominance for every third vector; a fifth is for validation."""
    v = X.vectors(spark, sf)
    x = lambda i: F.get("feat", F.lit(i))
    return v.select("utt_id", "feat", F.col("true_class").alias("class_idx"), x(0).alias("valence"), x(1).alias("arousal"), F.when(F.col("utt_id") % 3 == 0, x(2)).alias("dominance"), (F.col("utt_id") % 5 == 0).alias("held"))


def _parts(rows):
    return rows.where("not held"), rows.where("held")


@query()
def train_separate_heads(spark, sf):
    """Figures of each epoch of separate heads."""
    rows, held = _parts(labelled(spark, sf))
    got = G.fit(rows, held, N.separate_heads(X.CLASSES, X.WIDTH, HIDDEN), 3, 1e-2)
    return G.history_table(rows, got.history)


@query()
def train_mediated_heads(spark, sf):
    """Figures of each epoch of heads whose classes see the predicted dimensions only."""
    rows, held = _parts(labelled(spark, sf))
    got = G.fit(rows, held, N.mediated_heads(X.CLASSES, width=X.WIDTH, hidden=HIDDEN), 3, 1e-2, select="accuracy", largest=True)
    return G.history_table(rows, got.history)


@query()
def train_two_stages(spark, sf):
    """Figures of each epoch of both stages, over ragged utterances."""
    frames = X.frames(spark, sf).where("valid")
    first = lambda i: F.get(F.get("frames", F.lit(0)), F.lit(i))
    rows = G.utterances(frames).select(F.col("utt_idx").alias("utt_id"), "frames", first(0).alias("valence"), first(1).alias("arousal"), (F.col("utt_idx") % 4).cast("int").alias("class_idx"))
    got = G.fit_two_stages(rows.where("utt_id % 5 <> 0"), rows.where("utt_id % 5 = 0"), N.attentive_decoder(4, X.WIDTH, HIDDEN), (2, 2), 1e-2, 1e-3, 1e-2)
    return G.history_table(rows, [h for h in got.history if h["stage"] == 1], stage=1).unionByName(G.history_table(rows, [h for h in got.history if h["stage"] == 2], stage=2))


def fixed_weights(classes: int = X.CLASSES, width: int = X.WIDTH, hidden: int = 4) -> N.Params:
    """Weights of mediated heads by a rule that the SQL repeats."""
    k, h, c = np.arange(3), np.arange(hidden), np.arange(classes)
    return {
        "vad_head.pre_net.weight": 5 * np.array([X.weights(i, width) for i in range(hidden)]), "vad_head.pre_net.bias": 0.01 * h,
        "vad_head.post_net.weight": 0.1 * ((k[:, None] + 2 * h) % 3 - 1), "vad_head.post_net.bias": 0.05 * k,
        "classifier.weight": 0.1 * ((c[:, None] + k) % 4 - 1.5), "classifier.bias": 0.01 * c,
    }


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label AS y FROM embeddings),
h AS (SELECT v.*, list_transform(range(4), lambda c: greatest(0, 0.01 * c + list_sum(list_transform(range(64), lambda j: x[j + 1] * 0.05 * ((7 * c + 3 * j) % 5 - 2))))) AS h FROM v),
p AS (SELECT h.*, list_transform(range(3), lambda k: 0.05 * k + list_sum(list_transform(range(4), lambda c: h[c + 1] * 0.1 * ((k + 2 * c) % 3 - 1)))) AS p FROM h),
z AS (SELECT p.*, list_transform(range(10), lambda c: 0.01 * c + list_sum(list_transform(range(3), lambda k: p[k + 1] * 0.1 * ((c + k) % 4 - 1.5)))) AS z FROM p),
d AS (SELECT k, p[k + 1] AS a, x[k + 1] AS t FROM z, range(3) AS r(k) WHERE k < 2 OR vec_id % 3 = 0),
c AS (SELECT k, 2 * (avg(a * t) - avg(a) * avg(t)) / (var_pop(a) + var_pop(t) + (avg(a) - avg(t)) ** 2 + 1e-8) AS ccc FROM d GROUP BY k),
l AS (SELECT 1 - avg(ccc) AS vad FROM c),
e AS (SELECT avg(ln(list_sum(list_transform(z, lambda u: exp(u)))) - z[y + 1]) AS emo FROM z)
SELECT round(vad, 6) AS vad_loss, round(emo, 6) AS emotion_loss, round(0.7 * vad + 0.3 * emo, 6) AS loss FROM l, e
""")
def joint_loss_mediated(spark, sf):
    """The joint loss that training starts from, by its own pass over all rows."""
    network = N.mediated_heads(X.CLASSES, width=X.WIDTH, hidden=4)
    got = G.fit(labelled(spark, sf), None, network, 1, weights=fixed_weights(), lambda_vad=0.7, lambda_emo=0.3)
    now = got.history[0]["train"]
    return spark.createDataFrame([(now["vad_loss"], now["emotion_loss"], now["loss"])], "vad_loss double, emotion_loss double, loss double").select(*(r6(c, c) for c in ("vad_loss", "emotion_loss", "loss")))


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
h AS (SELECT v.*, list_transform(range(4), lambda c: greatest(0, 0.01 * c + list_sum(list_transform(range(64), lambda j: x[j + 1] * 0.05 * ((7 * c + 3 * j) % 5 - 2))))) AS h FROM v),
p AS (SELECT h.*, list_transform(range(3), lambda k: 0.05 * k + list_sum(list_transform(range(4), lambda c: h[c + 1] * 0.1 * ((k + 2 * c) % 3 - 1)))) AS p FROM h)
SELECT vec_id AS utt_id, round(p[1], 6) AS valence, round(p[2], 6) AS arousal, round(p[3], 6) AS dominance,
  round(0.01 * 3 + list_sum(list_transform(range(3), lambda k: p[k + 1] * 0.1 * ((3 + k) % 4 - 1.5))), 6) AS logit3 FROM p
""")
def predictions_mediated(spark, sf):
    """Predictions and one logit of every vector by a network with a hidden layer."""
    got = G.predicted(X.vectors(spark, sf), N.mediated_heads(X.CLASSES, width=X.WIDTH, hidden=4), fixed_weights(), keep=["utt_id"])
    return got.select("utt_id", *(r6(F.get("vad", F.lit(i)), d) for i, d in enumerate(("valence", "arousal", "dominance"))), r6(F.get("logits", F.lit(3)), "logit3"))


@query("WITH " + X.FRAMES + " SELECT utt_idx, frame_idx, CAST(count(*) OVER (PARTITION BY utt_idx) AS INTEGER) AS n_frames, round(list_sum(list_transform(feat, lambda x: x * 1000)), 3) AS s FROM frames")
def npy_round_trip(spark, sf):
    """Frames of all utterances written to one .npy matrix with their lengths, and read back by ranges."""
    frames = X.frames(spark, sf).select("utt_idx", "frame_idx", "feat")
    lengths = frames.groupBy("utt_idx").agg(F.count("*").cast("int").alias("n_frames"))
    prefix = f"{shared_dir(spark)}/npy-{uuid.uuid4().hex}/train"
    names = lengths.select("utt_idx")
    Y.append_utterances(frames, lengths, prefix, X.WIDTH)
    # a line is an utterance, in order of their numbers
    read = R.read_lengths(spark, f"{prefix}.lengths").withColumnRenamed("utt_idx", "line")
    place = R.offsets(names.withColumn("n_frames", F.lit(1))).select("utt_idx", F.col("frame_offset").alias("line"))
    spans = R.offsets(read, "line").join(place, "line")
    rows = spans.where("n_frames > 0").select("utt_idx", "n_frames", F.posexplode(F.sequence(F.col("frame_offset"), F.col("frame_offset") + F.col("n_frames") - 1)).alias("frame_idx", "row"))
    matrix = Y.read_matrix(spark, f"{prefix}.npy", X.WIDTH)
    total = F.aggregate("feat", F.lit(0.0), lambda s, x: s + x.cast("double") * 1000)
    return rows.join(matrix, "row").select("utt_idx", F.col("frame_idx").cast("long").alias("frame_idx"), "n_frames", (F.round(total, 3) + 0.0).alias("s"))


def _recordings(spark, sf):
    """(name, samples): a waveform of 16-bit samples for each hundred vectors."""
    e = X.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("u"), "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 32767).cast("int")).alias("s"))
    parts = F.array_sort(F.collect_list(F.struct("vec_id", "s")))
    return e.groupBy("u").agg(F.flatten(F.transform(parts, lambda p: p["s"])).alias("samples")).select(F.concat(F.lit("u"), F.col("u").cast("string")).alias("name"), "samples")


def _written_wavs(rows, folder):
    """Tasks write a WAV file for each row; how many."""
    ship(rows.sparkSession)

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, samples in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with wave.open(f"{folder}/{name}.wav", "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(16000)
                    w.writeframes(np.array(samples, dtype="<i2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


def five_statistics(samples: np.ndarray) -> np.ndarray:
    """Mean, population deviation, mean magnitude, maximum and minimum of each window of 320 samples, the last one as long as it is."""
    a = np.asarray(samples, dtype=np.float64)
    parts = [a[i : i + 320] for i in range(0, len(a), 320)]
    return np.array([[w.mean(), w.std(), np.abs(w).mean(), w.max(), w.min()] for w in parts], dtype=np.float32)


@query("""
WITH s AS (SELECT vec_id // 100 AS u, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id, j) - 1 AS i, CAST(floor(CAST(embedding[j] AS DOUBLE) * 32767) / 32768 AS FLOAT) AS x FROM embeddings, range(1, 65) AS t(j))
SELECT 'u' || u || '.wav' AS audio_file, i // 320 AS frame_idx, round(avg(x::DOUBLE), 4) + 0.0 AS mean, round(stddev_pop(x::DOUBLE), 4) AS std, round(avg(abs(x::DOUBLE)), 4) AS mean_abs, round(max(x)::DOUBLE, 4) + 0.0 AS max, round(min(x)::DOUBLE, 4) + 0.0 AS min FROM s GROUP BY u, i // 320
""")
def recordings_to_features(spark, sf):
    """Features of recordings through the cache: filled once, then taken from it without an extractor."""
    folder = f"{shared_dir(spark)}/wavs-{uuid.uuid4().hex}"
    _written_wavs(_recordings(spark, sf), folder)
    wavs = R.wav_folder(spark, folder)
    R.refuse_bad_audio(R.faults(R.probe_wavs(spark, folder)))
    FeatureCache(spark, f"{folder}/cache", "statistics", five_statistics, 5).ensure(wavs)
    got = FeatureCache(spark, f"{folder}/cache", "statistics", None, 5).ensure(wavs)
    frames = got.select(F.regexp_extract("path", "([^/]*)$", 1).alias("audio_file"), F.posexplode(as_frames(F.col("n"), F.col("x"), 5)).alias("frame_idx", "f"))
    names = ("mean", "std", "mean_abs", "max", "min")
    return frames.select("audio_file", F.col("frame_idx").cast("long").alias("frame_idx"), *((F.round(F.get("f", F.lit(i)).cast("double"), 4) + 0.0).alias(c) for i, c in enumerate(names)))


@query("SELECT CAST(floor(0.8 * count(*)) AS BIGINT) AS train, CAST(count(*) - floor(0.8 * count(*)) AS BIGINT) AS valid FROM events")
def train_share_sizes(spark, sf):
    """Rows of both parts of a split by floor(0.8 n)."""
    got = S.train_share(X.table(spark, sf, "events").select("event_id"), "event_id", SEED)
    return got.agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "valid").alias("valid"))


@query("WITH " + X.AFFECT + " SELECT 'u' || utt_id || '.wav' AS file_path, valence, arousal, dominance, upper(split) AS split, CAST(NULL AS VARCHAR) AS session FROM affect")
def prepared_label_rows(spark, sf):
    """Labels brought to the prepared columns by a map of names; one of them isn't there."""
    import warnings

    df = X.affect(spark, sf).select(F.concat(F.lit("u"), F.col("utt_id").cast("string"), F.lit(".wav")).alias("path"), F.col("valence").alias("V"), F.col("arousal").alias("A"), "dominance", F.upper("split").alias("part"), "speaker")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return prepared_labels(df, {"file_path": "path", "valence": "V", "arousal": "A", "split": "part"})


@query("""
SELECT 'doc_id' AS "column", count(doc_id) <> count(DISTINCT doc_id) AS duplicated FROM documents
UNION ALL SELECT 'text', count(text) <> count(DISTINCT text) FROM documents UNION ALL SELECT 'lang', count(lang) <> count(DISTINCT lang) FROM documents
""")
def duplicated_columns(spark, sf):
    """Which columns of the documents hold a value more than once."""
    return duplicated(X.table(spark, sf, "documents"), ["doc_id", "text", "lang"])


@query("WITH " + X.FRAMES + " SELECT utt_idx, count(*) AS n, round(sum(feat[1]), 6) + 0.0 AS s FROM frames WHERE frame_idx BETWEEN 2 AND 4 GROUP BY utt_idx")
def frame_slices(spark, sf):
    """Three frames of each utterance from the third on, as far as it has them."""
    rows = G.utterances(X.frames(spark, sf)).select("utt_idx", frame_slice(F.col("frames"), F.lit(2), F.lit(3)).alias("f")).where(F.size("f") > 0)
    return rows.select("utt_idx", F.size("f").cast("long").alias("n"), r6(F.aggregate("f", F.lit(0.0), lambda s, x: s + F.get(x, F.lit(0))), "s"))


@query()
def cross_validate_frames(spark, sf):
    """Right answers of a classifier over ragged frames, for each of five folds held out, and their means."""
    rows = G.utterances(X.frames(spark, sf).where("valid")).select(F.col("utt_idx").alias("utt_id"), "frames", (F.col("utt_idx") % 4).cast("int").alias("class_idx"), (F.col("utt_idx") % 5).alias("fold"))
    return G.cross_validated(rows, N.frame_classifier(4, X.WIDTH, HIDDEN), epochs=1, rate=1e-2, optimizer="rmsprop")
