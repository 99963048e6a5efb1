"""Padded batches, masks and permutations over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def padded_batches(frames: DataFrame, batch: Column, carry: tuple[str, ...] = (), key: str = "utt_idx", order: str = "frame_idx", feat: str = "feat") -> DataFrame:
    """One row per utterance: batch, key, size, those of carry, feats [longest of the batch, width] zero-filled, padding_mask (true on padding).

    An utterance's frames meet in its own row, as a batch needs them. Columns in
    carry (targets, their masks, labels) are the same on all of its frames.
    """
    rows = frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, feat))).alias("f"), *(F.first(c).alias(c) for c in carry))
    sized = rows.select(batch.alias("batch"), key, F.size("f").alias("size"), *carry, F.transform("f", lambda x: x[feat]).alias("feats"))
    most = F.max("size").over(Window.partitionBy("batch"))
    zero = F.transform(F.get("feats", F.lit(0)), lambda x: x * 0)
    wide = sized.withColumn("most", most).withColumn("feats", F.concat("feats", F.array_repeat(zero, F.col("most") - F.col("size"))))
    mask = F.transform(F.sequence(F.lit(0), F.col("most") - 1), lambda i: i >= F.col("size"))
    return wide.select("batch", key, "size", *carry, "feats", mask.alias("padding_mask"))


def shuffle_ranks(rows: DataFrame, key: str, noise: Column, group: str) -> DataFrame:
    """(group, key, rank): places by noise within each group, that is the inverse permutation of its argsort; ties by key."""
    return rows.select(group, key, noise.alias("noise")).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("noise", key)) - 1).drop("noise")


def argsort(ranks: DataFrame, key: str, group: str) -> DataFrame:
    """(group, rank, source): which row lies at each place, the permutation itself."""
    return ranks.select(group, "rank", F.col(key).alias("source"))


def keep_first(ranks: DataFrame, share: float, group: str) -> DataFrame:
    """ranks with masked: of each group floor(n * (1 - share)) places stay, the others are masked; which stay depends on the noise alone."""
    n = F.count("*").over(Window.partitionBy(group))
    return ranks.withColumn("masked", F.col("rank") >= F.floor(n * (1 - share)))


def without_extra(frames: DataFrame, extra: int, order: str = "frame_idx") -> DataFrame:
    """Frames without the first `extra` ones, which are tokens and no audio; the others count from 0 again."""
    return frames.where(F.col(order) >= extra).withColumn(order, F.col(order) - extra)


def annealed(start: float, end: float, step: Column, total: int) -> Column:
    """From start to end in a line over `total` steps, then end."""
    return F.when(step >= total, F.lit(end)).otherwise(end - (end - start) * (1 - step / total))


def alibi_slopes(heads: int) -> list[float]:
    """Slopes of the distance penalty: a geometric series for a power of two, else that of the next smaller one filled with every other slope of twice as many heads."""
    power = 1 << heads.bit_length() - 1
    own = [2.0 ** (-8.0 * (i + 1) / power) for i in range(power)]
    return own if power == heads else own + alibi_slopes(2 * power)[::2][: heads - power]


def alibi_slope(h: Column, heads: Column) -> Column:
    """alibi_slopes as a column: the slope of head h (from 0) of so many heads."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(heads)))
    return F.when(h < power, F.pow(F.lit(2.0), -8.0 * (h + 1) / power)).otherwise(F.pow(F.lit(2.0), -8.0 * (2 * (h - power) + 1) / (2 * power)))


def alibi_bias(lengths: DataFrame, heads: int, n: str = "n") -> DataFrame:
    """lengths with h, i, j and bias: for each head and pair of places in a sequence of n, its slope times their distance, negative.

    Pairs are made within a sequence's row, so nothing is shuffled.
    """
    place = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = lengths.where(F.col(n) > 0).select("*", place(F.lit(heads)).alias("h")).select("*", place(F.col(n)).alias("i")).select("*", place(F.col(n)).alias("j"))
    return rows.withColumn("bias", -F.abs(F.col("i") - F.col("j")) * alibi_slope(F.col("h"), F.lit(heads)))
