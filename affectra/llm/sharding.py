"""Sharding by extendible hashing, in DataFrame operations only.

A row's key hashes to BITS bits; a shard is a prefix of them. The directory
starts at the empty prefix and only prefixes whose bytes exceed the limit take
another bit. Bytes are first summed by long prefixes (map-side), so the
directory is built from those sums; rows are read once more to be given their
shard. Each round looks STEP bits further, into oversized prefixes alone. Rows
that still share a prefix when the bits end have equal keys: they fill pages by a
running sum of their bytes, taken over ranges of rows, so that each page is
within the limit however many rows one key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, packed, unpacked, written

#: Bits of the hash that shards may use, and bits looked at in one round.
BITS, STEP = 60, 12
#: A directory of so many shards at most is broadcast (some 40 bytes a shard); a larger one is joined with keys before rows.
DIRECTORY_ROWS = 200_000
#: Rows of hot keys in a range of the running sum.
RANGE_ROWS = 1_000_000


def key_hash(key: str | Column) -> Column:
    """The first BITS bits of the md5 of the key as text; null keys hash as the empty text."""
    text = F.coalesce((column(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """Shards as (depth, prefix, bytes, rows) of a table (h, bytes), without row data.

    Every shard is within limit bytes, unless it has all BITS bits. An empty
    table has no shards. The number of rounds is at most BITS / STEP.
    """
    done: DataFrame | None = None
    big, start = sized, 0
    while True:
        stop = min(BITS, start + STEP)
        fine = big.groupBy(_prefix(F.col("h"), stop).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        levels = fine.select(F.explode(F.sequence(F.lit(start), F.lit(stop))).alias("depth"), "p", "bytes", "rows")
        sums = levels.groupBy("depth", F.call_function("shiftright", F.col("p"), (F.lit(stop) - F.col("depth")).cast("int")).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        large = sums.where((F.col("bytes") > limit) & (F.col("depth") < stop)).select((F.col("depth") + 1).alias("depth"), "prefix")
        halves = large.select("depth", F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        reached = written(sums.where(F.col("depth") > start).join(halves, ["depth", "prefix"], "left_semi").unionByName(sums.where(F.col("depth") == start)), "directory")
        leaves = reached.where((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        done = leaves if done is None else done.unionByName(leaves)
        over = reached.where((F.col("bytes") > limit) & (F.col("depth") == stop)).select("prefix")
        if stop == BITS or over.isEmpty():
            return done
        big = big.withColumn("prefix", _prefix(F.col("h"), stop)).join(over, "prefix", "left_semi").select("h", "bytes")
        start = stop  # a round per STEP bits, as far as prefixes are oversized


def _pages(hot: DataFrame, limit: int) -> DataFrame:
    """(i, page, bytes): the page of each row of a written table (h, size, i), where i is unique and no page goes beyond limit.

    Rows lie end to end in stretches of `limit` bytes. Those within stretch k fill
    page 2k; the one that goes over its end has page 2k + 1 for itself.
    """
    ranges = 1 + hot.count() // RANGE_ROWS
    dealt = written(hot.select("h", "size", "i").repartitionByRange(ranges, "h", "i").withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = dealt.groupBy("h", "part").agg(F.sum("size").alias("all")).select("h", "part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    along = Window.partitionBy("part", "h").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ended = dealt.withColumn("to", F.sum("size").over(along)).join(base, ["h", "part"]).withColumn("end", F.col("base") + F.col("to"))
    begin = F.col("end") - F.col("size")
    first, last = F.floor(begin / limit), F.floor((F.greatest(F.col("end") - 1, begin)) / limit)
    placed = written(ended.select("h", "i", "size", (first * 2 + (first != last).cast("long")).alias("page")), "pages")
    return placed.join(written(placed.groupBy("h", "page").agg(F.sum("size").alias("bytes")), "pages"), ["h", "page"]).select("i", "page", "bytes")


def shard(df: DataFrame, limit: int, key: str = "doc_id", size: str | Column = "text") -> DataFrame:
    """df with shard (the prefix as bits, a page number behind "+" where the bits ended), shard_depth, shard_bytes.

    limit: bytes of `size` (null counts 0) in a shard. Rows with null keys, and
    repeated rows, are kept; a single row larger than limit has a shard or page of
    its own, over the limit. An empty table stays empty. Other columns may have
    any names; columns of df that have these three are replaced.
    """
    made = ("shard", "shard_depth", "shard_bytes")
    keep = [c for c in df.columns if c not in made]
    bytes_ = F.coalesce(F.octet_length(column(size) if isinstance(size, str) else size), F.lit(0)).cast("long")
    rows = df.select(packed(df).alias("row"), key_hash(key).alias("h"), bytes_.alias("size"))
    found = written(directory(rows.select("h", F.col("size").alias("bytes")), limit), "directory")
    over = (F.col("depth") == BITS) & (F.col("bytes") > limit) & (F.col("rows") > 1)
    n, depths, crowded = found.agg(F.count("*"), F.array_sort(F.collect_set("depth")), F.sum(over.cast("int"))).first()  # BITS + 1 depths at most
    if not n:
        return rows.select(*unpacked(keep), F.lit("").alias("shard"), F.lit(0).alias("shard_depth"), F.lit(0).cast("long").alias("shard_bytes"))
    shards = found.select("depth", "prefix", "bytes", over.alias("crowded"))
    # a key asks at each depth that has shards; shards are disjoint, so just one answers
    ask = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(F.col("h"), d).alias("prefix")) for d in depths))).alias("ask")
    if n <= DIRECTORY_ROWS:
        placed = rows.select("*", ask).select("row", "h", "size", "ask.*").join(F.broadcast(shards), ["depth", "prefix"])
    else:
        keys = written(rows.select("h").distinct().select("h", ask).select("h", "ask.*").join(shards, ["depth", "prefix"]), "keys")
        placed = rows.join(keys, "h")
    name = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    out = placed.where(~F.col("crowded")).select(*unpacked(keep), name.alias("shard"), F.col("depth").alias("shard_depth"), F.col("bytes").alias("shard_bytes"))
    if not crowded:
        return out
    hot = written(placed.where("crowded").withColumn("i", F.monotonically_increasing_id()), "hot")  # numbered once
    paged = hot.drop("bytes").join(_pages(hot, limit), "i")
    return out.unionByName(paged.select(*unpacked(keep), F.concat(name, F.lit("+"), F.col("page").cast("string")).alias("shard"), F.col("depth").alias("shard_depth"), F.col("bytes").alias("shard_bytes")))


def write_shards(df: DataFrame, path: str, limit: int, key: str = "doc_id", size: str = "text") -> None:
    """Write each shard to a folder of its own, shard=<bits>."""
    shard(df, limit, key, size).repartition("shard").write.partitionBy("shard").parquet(path)
