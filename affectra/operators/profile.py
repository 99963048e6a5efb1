"""Profiles of tables: nulls, distinct values, shares, moments, histograms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affectra.functions.storage import written


def _long(df: DataFrame, row: dict[str, object], value: str) -> DataFrame:
    return df.agg(*(c.alias(k) for k, c in row.items())).select(F.explode(F.array(*(F.struct(F.lit(k).alias("column"), F.col(f"`{k}`").alias(value)) for k in row))).alias("x")).select("x.*")


def null_counts(df: DataFrame) -> DataFrame:
    return _long(df, {c: F.count_if(F.col(c).isNull()) for c in df.columns}, "n_null")


def distinct_counts(df: DataFrame) -> DataFrame:
    return _long(df, {c: F.count_distinct(c) for c in df.columns}, "n_distinct")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n, percent (two places, halves to even); nulls are a value of their own."""
    total = df.count()
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("percent", F.bround(F.col("n") / F.lit(max(1, total)) * 100, 2))


def order_statistics(df: DataFrame, columns: list[str], ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """(column, total, v0, v1, ...): the values at 0-based places among each column's sorted values that aren't null.

    ranks gives the places, from the column of totals; a place that isn't there
    gives null. Distinct values with their counts are dealt to ranges in order,
    as Spark samples them, and written, so that ranges and their sums agree;
    only ranges that hold a wanted place are summed up within.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns)))
    counts = df.select(cells.alias("x")).select("x.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    ranges = written(counts.repartitionByRange("column", "value").withColumn("p", F.spark_partition_id()), "ranges")
    column = Window.partitionBy("column")  # a row for each range
    sums = ranges.groupBy("column", "p").agg(F.sum("n").alias("all"))
    sums = sums.select("column", "p", "all", F.coalesce(F.sum("all").over(column.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("all").over(column).alias("total"))
    places = [r.cast("long") for r in ranks(F.col("total"))]
    wanted = sums.select("column", "p", "base", "all", "total", *(r.alias(f"r{i}") for i, r in enumerate(places)))
    within = lambda i: (F.col("base") <= F.col(f"r{i}")) & (F.col(f"r{i}") < F.col("base") + F.col("all"))
    wanted = wanted.where(reduce(or_, (within(i) for i in range(len(places)))))  # a row a place at most
    stop = F.col("base") + F.sum("n").over(Window.partitionBy("column", "p").orderBy("value"))
    placed = ranges.join(F.broadcast(wanted), ["column", "p"]).withColumn("stop", stop)
    at = lambda i: (F.col("stop") - F.col("n") <= F.col(f"r{i}")) & (F.col(f"r{i}") < F.col("stop"))
    values = placed.groupBy("column").agg(*(F.max(F.when(at(i), F.col("value"))).alias(f"v{i}") for i in range(len(places))))
    return sums.groupBy("column").agg(F.max("total").alias("total")).join(F.broadcast(values), "column", "left")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles and maximum of each column."""
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*(f(F.col(c)).alias(f"{k}|{c}") for c in columns for k, f in stats.items()))
    rows = wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"`{k}|{c}`").alias(k) for k in stats)) for c in columns))).alias("x")).select("x.*")

    quantiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    at = lambda total, q: (total - 1) * q
    found = order_statistics(df, columns, lambda total: [f(at(total, q)) for q in quantiles.values() for f in (F.floor, F.ceil)])

    def quantile(i: int, q: float) -> Column:
        part = at(F.col("total"), q) - F.floor(at(F.col("total"), q))
        return (1 - part) * F.col(f"v{2 * i}") + part * F.col(f"v{2 * i + 1}")

    quartiles = found.select("column", *(quantile(i, q).alias(k) for i, (k, q) in enumerate(quantiles.items())))
    return rows.join(F.broadcast(quartiles), "column", "left").select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def skew_kurtosis(df: DataFrame, column: str) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, null below three and four values."""
    n = F.count(column).cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(column))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6))
    return df.agg(skew.alias("skew"), kurt.alias("kurt"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, n) of equal-width bins from 1 on; the last one is closed. Empty bins have no row."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, n long")
    place = F.lit(1) if lo == hi else F.least(F.call_function("width_bucket", F.col(column), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return df.where(F.col(column).isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def ordered_counts(counts: DataFrame, label: str, n: str) -> DataFrame:
    """Label counts from the most frequent on, ties by label, each with its place; a label list is short."""
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc(n), label)) - 1)


def duplicated(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, duplicated) for each column: whether some value, null aside, is there more than once."""
    return _long(df, {c: F.count(c) != F.count_distinct(c) for c in columns}, "duplicated")


def subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (subset): whether every key of a is in b; both ways make equal sets."""
    return a.join(b, a.columns, "left_anti").agg((F.count("*") == 0).alias("subset"))


def box_plot(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, the farthest values within 1.5 interquartile ranges of them, and how many lie beyond."""
    q = describe(df, [column]).select("q25", "q50", "q75")
    x, reach = F.col(column), (F.col("q75") - F.col("q25")) * 1.5
    low, high = F.col("q25") - reach, F.col("q75") + reach
    return df.select(column).join(F.broadcast(q)).groupBy("q25", "q50", "q75").agg(F.min(F.when(x >= low, x)).alias("low"), F.max(F.when(x <= high, x)).alias("high"), F.count_if((x < low) | (x > high)).alias("outliers"))


def column_kinds(df: DataFrame, most: int = 30) -> DataFrame:
    """For each column whether it is numeric, and whether it is categorical: not numeric and of at most `most` different values."""
    numeric = {c: t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") for c, t in df.dtypes}
    kinds = F.create_map(*(F.lit(x) for kv in numeric.items() for x in kv))
    n = distinct_counts(df)
    return n.select("column", kinds[F.col("column")].alias("numeric"), (~kinds[F.col("column")] & (F.col("n_distinct") <= most)).alias("categorical"))
