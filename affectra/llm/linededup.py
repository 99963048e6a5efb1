"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Runs of at least `run` consecutive lines that also occur earlier (smaller id, or
further up in the same document) are deleted; so is a repeated line of at least
`words` words by itself, a run by its size. In each window of `run` lines the
smallest line hash (the last on ties) is selected; equal windows select alike, so
each repeated run shares a selected line: the guaranteed fingerprint. A long line
selects itself. Fingerprints that occur at one place only are left out. Around the
others positions are joined: each window with the first place of the same lines,
by a 128-bit key whose first place a partial aggregate finds before the shuffle,
so no pairs arise within a group. Matches extend both ways: windows that follow
one another in both places are one run, as long as the lines agree, and the later
one goes. Tables that are joined are written first, so that Spark sees
their size: it broadcasts small ones and splits the partition of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column, packed, text_or_empty, unpacked, written

#: Lines that make a run, and words that make a single line one.
RUN, WORDS = 2, 50


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _place(id_col: str, text_col: str) -> Column:
    """The place of a row: its id (null first) and a hash of its text."""
    d = column(id_col)
    return F.struct(d.isNotNull().alias("a"), F.coalesce(d.cast("long"), F.lit(0)).alias("b"), F.xxhash64(text_or_empty(column(text_col))).alias("c"))


def repeated_runs(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", words: int | None = WORDS) -> DataFrame:
    """(place, start, stop, source, source_start): maximal runs of lines, from start to before stop, that also occur earlier.

    place and source are structs of id (null as a false `a`) and a hash of the
    text; source is where the run's lines first occur. Documents that have
    none give no row, nor does an empty table.
    """
    lines = F.split(text_or_empty(column(text_col)), "\n", -1)
    long = F.array().cast("array<int>") if words is None else F.filter(F.transform(lines, lambda x, i: F.when(F.regexp_count(x, F.lit(WORD)) >= words, i)), lambda i: i.isNotNull())
    hashed = docs.select(_place(id_col, text_col).alias("place"), F.transform(lines, _line_hash).alias("h"), F.transform(lines, lambda x: F.xxhash64(F.trim(x), F.lit(7))).alias("g"), long.alias("long")).where((F.size("h") >= run) | (F.size("long") > 0))
    starts = F.when(F.size("h") >= run, F.sequence(F.lit(0), F.size("h") - run)).otherwise(F.array().cast("array<int>"))

    def chosen(s):
        """The position that a window selects: the last smallest hash of its lines."""
        return -F.array_min(F.transform(F.sequence(F.lit(0), F.lit(run - 1)), lambda k: F.struct(F.get(F.col("h"), s + k).alias("h"), (-(s + k)).alias("p"))))["p"]

    def window(s, size, f, fresh):
        return F.struct(s.cast("int").alias("s"), F.lit(size).alias("size"), f.alias("f"), fresh.alias("fresh"), F.xxhash64(F.slice("h", s + 1, size)).alias("k1"), F.xxhash64(F.slice("g", s + 1, size)).alias("k2"))

    # a fingerprint counts where the first window selects it, not once a window
    fresh = lambda s: (s == 0) | (chosen(s) != chosen(s - 1))
    every = F.transform(starts, lambda s: window(s, run, F.get(F.col("h"), chosen(s)), fresh(s)))
    if words is not None and run > 1:  # a key of its own: lines that only windows of `run` share aren't counted with it
        every = F.concat(every, F.transform("long", lambda s: window(s, 1, F.xxhash64(F.get(F.col("h"), s), F.lit(1)), F.lit(True))))
    windows = written(hashed.select("place", F.explode(every).alias("w")).select("place", "w.*"), "windows")
    repeated = written(windows.groupBy("f").agg(F.sum(F.col("fresh").cast("int")).alias("n")).where("n > 1").select("f"), "fingerprints")
    around = written(windows.join(repeated, "f", "left_semi").drop("f", "fresh"), "around")  # read twice below
    firsts = written(around.groupBy("k1", "k2").agg(F.min(F.struct("place", "s")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    joined = around.join(firsts, ["k1", "k2"]).where(F.struct("place", "s") > F.col("first")).select("place", "s", "size", F.col("first.place").alias("source"), F.col("first.s").alias("at"))
    # windows on one diagonal that follow without a gap are one match
    along = Window.partitionBy("place", "source", F.col("at") - F.col("s")).orderBy("s", "size")
    reach = F.max(F.col("s") + F.col("size")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(reach >= F.col("s"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    runs = joined.withColumn("part", part).groupBy("place", "source", (F.col("at") - F.col("s")).alias("shift"), "part")
    return runs.agg(F.min("s").alias("start"), F.max(F.col("s") + F.col("size")).alias("stop")).select("place", "start", "stop", "source", (F.col("start") + F.col("shift")).alias("source_start"))


def remove_repeated_runs(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", words: int | None = WORDS) -> DataFrame:
    """docs with `text_col` rid of later repeated runs, and n_lines, n_removed.

    Lines part at "\\n" and are compared without outer spaces. Null text is
    empty, and stays null. A repeated line of at least `words` words (parted by
    white space) goes without equal neighbours too; where `words` is None,
    documents of fewer than `run` lines keep all. Rows with equal ids are
    ordered by a hash of their text, rows equal in both are copies of one
    another at the same place and keep alike; null ids come first. Other columns
    may have any names; columns of docs named n_lines or n_removed are replaced.
    """
    made = ("n_lines", "n_removed")
    gone = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("stop") - 1)))))
    later = repeated_runs(docs, run, id_col, text_col, words).groupBy("place").agg(gone.alias("gone"))
    rows = docs.select(packed(docs).alias("row"), _place(id_col, text_col).alias("place"))
    lines = F.split(text_or_empty(F.col("row")[text_col]), "\n", -1)  # behind the join, so that texts travel once
    out = rows.join(later, "place", "left").select("row", lines.alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(F.size("gone") == 0, F.col("row")[text_col]).otherwise(kept)
    return out.select(*unpacked([c for c in docs.columns if c not in made], {text_col: text}), F.size("lines").alias("n_lines"), F.size("gone").alias("n_removed"))
