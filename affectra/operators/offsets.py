"""Running sums over long tables without a window that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affectra.functions.storage import Tables

#: Keys in a block of the first level, and blocks in a block of each level above.
BLOCK = 4096


def _before(sums: DataFrame, levels: int) -> DataFrame:
    """(b, o): of a table (b, n) with one row a block, the sum of n over smaller b; each level has BLOCK times fewer rows."""
    if levels == 0:
        return sums.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    above = F.floor(F.col("b") / BLOCK)
    inner = Window.partitionBy("up").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    rest = _before(sums.groupBy(above.alias("b")).agg(F.sum("n").alias("n")), levels - 1).select(F.col("b").alias("up"), F.col("o").alias("of"))
    own = sums.withColumn("up", above).withColumn("i", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return own.join(rest, "up").select("b", (F.col("i") + F.col("of")).alias("o"))


def offsets(lengths: DataFrame, key: str = "utt_idx", levels: int = 1) -> DataFrame:
    """(key, n_frames, frame_offset): exclusive running sum of n_frames in order of key.

    Blocks of keys are summed, then blocks of blocks, `levels` times, so the last
    window has one row in BLOCK ** (levels + 1) keys: 16 million keys a row, and
    a window of 60,000 rows at 10**12 keys.
    """
    b: Column = F.floor(F.col(key) / BLOCK)
    inner = Window.partitionBy("b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = _before(lengths.groupBy(b.alias("b")).agg(F.sum("n_frames").alias("n")), levels)
    rows = lengths.select(key, "n_frames", b.alias("b")).withColumn("i", F.coalesce(F.sum("n_frames").over(inner), F.lit(0)))
    return rows.join(before, "b").select(key, "n_frames", (F.col("i") + F.col("o")).alias("frame_offset"))


def ranked(df: DataFrame, order: list[str], tables: Tables, rank: str = "rank") -> DataFrame:
    """df with the 0-based place of each row in the order of columns that tell all rows apart.

    Rows are dealt to ranges in order and written once, so that ranges and their
    counts agree; a window holds one range, or a count a range.
    """
    ranges = tables.put(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranges.join(F.broadcast(base), "_p").withColumn(rank, F.col("_base") + place - 1).drop("_p", "_base")
