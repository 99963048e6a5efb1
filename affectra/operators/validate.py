"""Validation rules: each gives violations (rule_id, key, value); strict mode raises with the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import finite


class DataError(ValueError):
    """Rows broke a rule; the message names rules and rows."""


def violations(df: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """rules: id -> (broken, value). All rules are tested in one pass."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(k).alias("rule_id"), value.cast("string").alias("value"))) for k, (broken, value) in rules.items())))
    return df.select(F.col(key).alias("key"), F.explode(found).alias("v")).select("v.rule_id", "key", "v.value")


def strict(found: DataFrame, n: int = 20) -> None:
    rows = found.orderBy("rule_id", "key").limit(n).collect()
    if rows:
        raise DataError("; ".join(f"{r.rule_id} at {r.key}: {r.value}" for r in rows))


def not_numeric(text: str) -> tuple[Column, Column]:
    return F.col(text).isNotNull() & ~finite(F.col(text).try_cast("double")) | (F.col(text).isNotNull() & F.col(text).try_cast("double").isNull()), F.col(text)


def out_of_range(x: str, lo: float = -1.0, hi: float = 1.0) -> tuple[Column, Column]:
    """NaN passes, as any comparison with it is false to begin with."""
    c = F.col(x)
    return ~F.isnan(c) & ((c < lo) | (c > hi)), c


def blank(x: str) -> tuple[Column, Column]:
    return F.col(x).isNull() | (F.trim(F.col(x)) == ""), F.col(x)


def bad_feature(feat: str, width: int) -> tuple[Column, Column]:
    c = F.col(feat)
    return (F.size(c) != width) | F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.size(c)


def misaligned(a: DataFrame, b: DataFrame, index: str, name: str) -> DataFrame:
    """Positions where two files name different rows, or where one has no row."""
    x, y = a.select(index, F.col(name).alias("left")), b.select(index, F.col(name).alias("right"))
    return x.join(y, index, "full").where(~F.col("left").eqNullSafe(F.col("right")))


def class_out_of_range(index: str, classes: int) -> tuple[Column, Column]:
    c = F.col(index)
    return c.isNull() | (c < 0) | (c >= classes), c


def too_few(df: DataFrame, group: str, value: str, least: int) -> DataFrame:
    """(group, n_labels) of groups with fewer than `least` different values."""
    return df.groupBy(group).agg(F.count_distinct(value).alias("n_labels")).where(F.col("n_labels") < least)


def without(df: DataFrame, group: str, ok: Column) -> DataFrame:
    """Groups none of whose rows are ok."""
    return df.groupBy(group).agg(F.count_if(ok).alias("_n")).where("_n = 0").select(group)


def target_dims(df: DataFrame, split: str = "split") -> DataFrame:
    """(split, target_dim, incomplete): three dimensions where every row has Dominance, else two; incomplete where only some have."""
    d = df.groupBy(split).agg(F.count("dominance").alias("d"), F.count("*").alias("n"))
    return d.select(split, F.when(F.col("d") == F.col("n"), 3).otherwise(2).alias("target_dim"), ((F.col("d") > 0) & (F.col("d") < F.col("n"))).alias("incomplete"))


def same_shape(predicted: DataFrame, target: DataFrame, p: str, t: str, key: str) -> None:
    """Predictions and targets have one row each, of two or three dimensions alike."""
    both = predicted.select(key, F.size(p).alias("p")).join(target.select(key, F.size(t).alias("t")), key, "full")
    bad = both.where(~F.col("p").eqNullSafe(F.col("t")) | ~F.coalesce(F.col("p").isin(2, 3), F.lit(False))).limit(5).collect()
    if bad:
        raise DataError(f"shapes differ or aren't two or three: {[r.asDict() for r in bad]}")


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """df, or an error that names what has no rows."""
    if df.isEmpty():
        raise DataError(f"{what}: no rows")
    return df
