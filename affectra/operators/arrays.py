"""Pooling, heads, softmax, frames and explanations as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(x: Column, w: list[float], bias: float = 0.0) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(float(bias)), lambda s, v: s + v)


def linear(x: Column, rows: list[list[float]], bias: list[float] | None = None) -> Column:
    """W x + b as an array; a column expression, for heads of some thousand weights at most."""
    return F.array(*(dot(x, w, b) for w, b in zip(rows, bias or [0.0] * len(rows), strict=True)))


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return F.transform(x, lambda v: 1 / (1 + F.exp(-v)))


def tanh(x: Column) -> Column:
    return F.transform(x, lambda v: F.tanh(v))


def bound(value: Column, use) -> Column:
    """use(value), where value is computed once a row however often lambdas inside `use` name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """Values less their mean over their population deviation; time in proportion to the length."""

    def scaled(a: Column) -> Column:
        return bound(_sum(a) / F.size(a), lambda mean: bound(F.sqrt(_sum(a, lambda v: (v - mean) * (v - mean)) / F.size(a) + eps), lambda dev: F.transform(a, lambda v: (v - mean) / dev)))

    return bound(x, scaled)


def softmax(x: Column) -> Column:
    def shares(e: Column) -> Column:
        return bound(_sum(e), lambda total: F.transform(e, lambda v: v / total))

    return bound(x, lambda a: bound(F.array_max(a), lambda top: bound(F.transform(a, lambda v: F.exp(v - top)), shares)))


def fit_length(x: Column, n: int) -> Column:
    """The first n values, with zeros behind them where there are fewer."""
    return F.when(F.size(x) >= n, F.slice(x, 1, n)).otherwise(F.concat(x, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(x))))


def frame_slice(frames: Column, offset: Column, size: Column) -> Column:
    """`size` frames from the 0-based offset on; fewer where there are fewer."""
    return F.slice(frames, (offset + 1).cast("int"), size.cast("int"))


def argmax(x: Column) -> Column:
    """The first place of the largest value."""
    return bound(x, lambda a: F.array_position(a, F.array_max(a)) - 1)


def ranked(x: Column) -> Column:
    """Structs (value, idx) from the largest value on; ties by smaller index."""
    return F.transform(F.array_sort(F.transform(x, lambda v, i: F.struct((-v).alias("neg"), i.alias("idx")))), lambda s: F.struct((-s["neg"]).alias("value"), s["idx"].alias("idx")))


def pool(frames: DataFrame, key: str = "utt_idx", feat: str = "feat", valid: str | None = "valid", empty: str = "null") -> DataFrame:
    """(key, pooled): mean of valid frames, by place in the vector.

    Places are exploded and summed map-side, so an utterance of any length never
    gathers in one row. empty: "null" or "zero" for utterances without a valid
    frame ("null" rows are violations: they can't be pooled).
    """
    ok = F.col(valid) if valid else F.lit(True)
    sums = frames.select(key, ok.alias("ok"), F.posexplode(feat).alias("j", "x")).groupBy(key, "j").agg(F.avg(F.when(F.col("ok"), F.col("x"))).alias("m"))
    value = F.coalesce("m", F.lit(0.0)) if empty == "zero" else F.col("m")
    got = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", value.alias("m")))), lambda s: s["m"]).alias("pooled"))
    return got if empty == "zero" else got.withColumn("pooled", F.when(F.get("pooled", F.lit(0)).isNotNull(), F.col("pooled")))


def attention_pool(frames: DataFrame, w: list[float], key: str = "utt_idx") -> DataFrame:
    """(key, pooled): frames weighted by the softmax of a linear score over the utterance's valid frames."""
    scored = frames.where("valid").withColumn("s", dot(F.col("feat"), w))
    top = scored.withColumn("top", F.max("s").over(Window.partitionBy(key)))
    e = top.select(key, F.exp(F.col("s") - F.col("top")).alias("e"), F.posexplode("feat").alias("j", "x"))
    sums = e.groupBy(key, "j").agg((F.sum(F.col("e") * F.col("x")) / F.sum("e")).alias("m"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("pooled"))


def pad(frames: DataFrame, batch: Column, key: str = "utt_idx") -> DataFrame:
    """(batch, key, frame_idx, padded) up to the batch's longest utterance."""
    n = frames.groupBy(key).agg(F.count("*").alias("n")).withColumn("batch", batch)
    most = n.withColumn("most", F.max("n").over(Window.partitionBy("batch")))
    return most.select("batch", key, F.explode(F.sequence(F.lit(0), F.col("most").cast("int") - 1)).alias("frame_idx"), "n").select("batch", key, "frame_idx", (F.col("frame_idx") >= F.col("n")).alias("padded"))


#: Kernel and stride of the encoder's convolutions: fixed values.
CONVOLUTIONS = ((10, 5), (3, 2), (3, 2), (3, 2), (3, 2), (2, 2), (2, 2))


def conv_frames(samples: Column) -> Column:
    for k, s in CONVOLUTIONS:
        samples = F.floor((samples - k) / s) + 1
    return samples


def window_statistics(samples: DataFrame, width: int = 320, key: str = "utt_idx") -> DataFrame:
    """Mean, population deviation, mean magnitude, maximum and minimum of each window of `width` samples (i, x)."""
    w = samples.groupBy(key, F.floor(F.col("i") / width).alias("window"))
    return w.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.avg(F.abs("x")).alias("mean_abs"), F.max("x").alias("max"), F.min("x").alias("min"))


def placeholder(stats: Column, width: int = 768) -> Column:
    """Five statistics, each repeated to fill a vector of `width`; the last one is cut short."""
    each = -(-width // 5)
    return F.slice(F.flatten(F.transform(stats, lambda s: F.array_repeat(s, each))), 1, width)


def contributions(vad: DataFrame, weights: list[list[float]], bias: list[float], dims: tuple[str, ...]) -> DataFrame:
    """One row per utterance and class: bias, each dimension's term, and their sum, the logit."""
    rows = F.array(*(F.struct(F.lit(c).alias("class_idx"), F.lit(b).alias("bias"), *((F.lit(w) * F.col(d)).alias(f"{d}_term") for w, d in zip(ws, dims, strict=True))) for c, (ws, b) in enumerate(zip(weights, bias, strict=True))))
    terms = vad.select("utt_id", F.explode(rows).alias("x")).select("utt_id", "x.*")
    return terms.withColumn("logit", sum((F.col(f"{d}_term") for d in dims), F.col("bias")))


def contrast(vad: DataFrame, weights: list[list[float]], bias: list[float], dims: tuple[str, ...], places: int = 9) -> DataFrame:
    """The predicted class against its runner-up: differences of bias and terms, whose sum is the margin.

    Classes are ranked within the row, so nothing is shuffled. Logits are compared
    to `places` decimals; ties go to the smaller index.
    """
    logit = lambda ws, b: sum((F.lit(w) * F.col(d) for w, d in zip(ws, dims, strict=True)), F.lit(b))
    each = F.array(*(F.struct((-F.round(logit(ws, b), places)).alias("neg"), F.lit(c).alias("class_idx"), F.lit(b).alias("bias"), *((F.lit(w) * F.col(d)).alias(f"{d}_term") for w, d in zip(ws, dims, strict=True))) for c, (ws, b) in enumerate(zip(weights, bias, strict=True))))
    two = vad.select("utt_id", F.slice(F.array_sort(each), 1, 2).alias("r"))
    a, b = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    names = ["bias", *(f"{d}_term" for d in dims)]
    return two.select("utt_id", a["class_idx"].alias("class_idx"), b["class_idx"].alias("next_class_idx"), *((a[n] - b[n]).alias(f"delta_{n}") for n in names), (b["neg"] - a["neg"]).alias("delta_logit"))
