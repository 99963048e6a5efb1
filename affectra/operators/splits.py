"""Splits, folds and seeded samples; neither rows nor speakers reach the driver."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affectra.functions.cluster import ship
from affectra.functions.storage import Tables, written

from .profile import order_statistics


def loso(df: DataFrame, session: str = "session") -> DataFrame:
    """Each row once for every session held out: fold and role (test or train)."""
    folds = df.select(F.col(session).alias("fold")).distinct()
    return df.join(F.broadcast(folds)).withColumn("role", F.when(F.col(session) == F.col("fold"), "test").otherwise("train"))


def positional(df: DataFrame, sizes: list[int], index: str) -> DataFrame:
    """fold of each row by its position: the sizes' running sums bound the test ranges; null beyond them."""
    fold, at = F.lit(None).cast("int"), sum(sizes)
    for k in range(len(sizes) - 1, -1, -1):
        at -= sizes[k]
        fold = F.when((F.col(index) >= at) & (F.col(index) < at + sizes[k]), k).otherwise(fold)
    return df.withColumn("fold", fold)


def by_speaker(df: DataFrame, speaker: str, label: str, valid: float, test: float, seed: int, tries: int = 2000) -> DataFrame:
    """split by speaker so that none is in two splits and training rows have every label.

    Speakers are ranked by a seeded hash; those of the first ranks are tested,
    the next are for validation. Only the two bounding hashes reach the driver.
    Hashes are drawn again and again until the labels are covered.
    """
    if valid < 0 or test < 0 or valid + test >= 1:
        raise ValueError("ratios must be at least 0 and sum to less than 1")
    pairs = df.select(F.col(speaker).alias("s"), F.col(label).alias("e")).distinct()
    names = pairs.select("s").distinct()
    n, labels = names.count(), pairs.select("e").distinct().count()
    if n < 3:
        raise ValueError("three speakers at least")
    n_valid, n_test = (max(1, round(n * r)) for r in (valid, test))
    if n_valid + n_test >= n:
        n_valid = n_test = 1
    for draw in range(tries):

        def h(c: str, draw: int = draw):
            return F.pmod(F.xxhash64(F.col(c), F.lit(seed), F.lit(draw)), F.lit(1 << 52))  # exact as a double

        at = order_statistics(names.select(h("s").alias("h")), ["h"], lambda _: [F.lit(n_test - 1), F.lit(n_test + n_valid - 1)]).first()
        low, high = int(at.v0), int(at.v1)
        if pairs.where(h("s") > high).select("e").distinct().count() == labels:
            return df.withColumn("split", F.when(h(speaker) <= low, "test").when(h(speaker) <= high, "valid").otherwise("train"))
    raise ValueError("no split covers every label in training")


#: Speakers or rows that a split in the drawn order of a random generator lists on the driver; more rows are drawn in tasks.
LISTED = 1_000_000
#: Steps of a shuffle that a task draws at once.
DRAWN = 1 << 18


def by_speaker_drawn(df: DataFrame, speaker: str, label: str, valid: float = 0.2, test: float = 0.2, seed: int = 42, tries: int = 2000) -> DataFrame:
    """split by speaker as Python's generator of that seed shuffles the sorted speakers: the first are for validation, the next tested.

    For studies of at most LISTED speakers whose split must be the known one;
    by_speaker has no such bound. Each try shuffles the sorted list afresh.
    """
    import random

    if valid < 0 or test < 0 or valid + test >= 1:
        raise ValueError("ratios must be at least 0 and sum to less than 1")
    who = F.col(speaker).cast("string")
    names = [r[0] for r in df.select(who).distinct().limit(LISTED + 1).collect()]
    if not 3 <= len(names) <= LISTED:
        raise ValueError(f"three speakers at least, and {LISTED} at most: by_speaker takes more")
    names.sort()
    has: dict[str, set] = {}
    for s, e in df.select(who, F.col(label).cast("string")).distinct().collect():
        has.setdefault(s, set()).add(e)
    labels = set().union(*has.values())
    n_valid, n_test = (max(1, round(len(names) * r)) for r in (valid, test))
    if n_valid + n_test >= len(names):
        n_valid = n_test = 1
    rng = random.Random(seed)
    for _ in range(tries):
        order = names.copy()
        rng.shuffle(order)
        if set().union(*(has[s] for s in order[n_valid + n_test :])) == labels:
            rows = [(s, "valid" if i < n_valid else "test" if i < n_valid + n_test else "train") for i, s in enumerate(order)]
            table = df.sparkSession.createDataFrame(rows, "_s string, split string")
            return df.drop("split").join(table, who == F.col("_s")).drop("_s")
    raise ValueError("no split covers every label in training")


def _bounds(n: int, valid: float, test: float) -> tuple[int, int]:
    """Validation and test rows of n: all train below three rows, no validation below four."""
    if n < 3:
        return 0, 0
    n_test = max(1, round(n * test)) if test > 0 else 0
    n_valid = max(1, round(n * valid)) if valid > 0 and n >= 4 else 0
    return (0, 1) if n_test + n_valid >= n else (n_valid, n_test)


def by_row(df: DataFrame, key: str, valid: float, seed: int, test: float = 0.0) -> DataFrame:
    """train, valid or test by a seeded hash of the row's key, in exact numbers; speakers may be in several, so leaky is true.

    Only the two bounding hashes reach the driver. Rows of equal key go together,
    which may shift the numbers.
    """
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52))  # exact as a double
    n_valid, n_test = _bounds(df.count(), valid, test)
    at = order_statistics(df.select(h.alias("h")), ["h"], lambda _: [F.lit(n_test - 1), F.lit(n_test + n_valid - 1)]).first()
    low, high = (-1 if x is None else int(x) for x in ((at.v0, at.v1) if at else (None, None)))
    return df.withColumns({"split": F.when(h <= low, "test").when(h <= high, "valid").otherwise("train"), "leaky": F.lit(True)})


def train_share(df: DataFrame, key: str, seed: int, share: float = 0.8) -> DataFrame:
    """train for the first floor(share * n) rows by a seeded hash of the key, valid for the others; speakers may be in both, so leaky is true.

    Rows of equal key go together. share lies between 0 and 1.
    """
    if not 0 <= share <= 1:
        raise ValueError(f"share {share} is not between 0 and 1")
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52))
    at = order_statistics(df.select(h.alias("h")), ["h"], lambda total: [F.floor(F.lit(float(share)) * total) - 1]).first()
    last = -1 if at is None or at.v0 is None else int(at.v0)
    return df.withColumns({"split": F.when(h <= last, "train").otherwise("valid"), "leaky": F.lit(True)})


def exact_sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows by a seeded hash of the key (all, if there are no more); only the bounding hash reaches the driver. Rows of equal key go together."""
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52))
    if k <= 0:
        return df.limit(0)
    at = order_statistics(df.select(h.alias("h")), ["h"], lambda _: [F.lit(k - 1)]).first()
    return df if at is None or at.v0 is None else df.where(h <= int(at.v0))


def _draws(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(i, j): in NumPy's shuffle of n places, step i (n - 1 down to 1) swaps places i and j <= i; 0 stays.

    A step may take several of the generator's numbers, so where a block of steps
    begins is only known by drawing those before: the driver draws them all, a
    block at a time, and keeps the generator's state at each block's beginning.
    """
    ship(spark)
    block = DRAWN
    # RandomState draws as the shuffle does (bits masked until they are in range), over whichever generator
    generator = np.random.default_rng(seed).bit_generator
    source, states = np.random.RandomState(generator), []
    for top in range(n - 1, 0, -block):
        states.append((top, json.dumps(generator.state)))
        source.randint(0, np.arange(top, max(top - block, 0), -1) + 1, dtype=np.int64)

    def run(batches):
        for b in batches:
            for top, state in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of = np.random.PCG64(0)
                of.state = json.loads(state)
                i = np.arange(top, max(top - block, 0), -1)
                j = np.random.RandomState(of).randint(0, i + 1, dtype=np.int64)
                last = [0] if top <= block else []
                yield pa.RecordBatch.from_arrays([pa.array(np.append(x, last).astype(np.int64)) for x in (i, j)], names=["i", "j"])

    blocks = spark.createDataFrame(states, "top long, state string")
    return blocks.repartition(min(len(states), 4096)).mapInArrow(run, "i long, j long")


def _drawn_places(spark: SparkSession, n: int, seed: int, tables: Tables) -> DataFrame:
    """(row, place): where each of n rows stands after NumPy's shuffle of that seed, without the shuffled list.

    A row waits at its place until a step picks that place: the largest step that
    does so is where it ends. If none does, its own step swaps it down to place j,
    where the next smaller step that picks j ends its way; if none does, step j
    moves it on. Such ways are followed by doubling: they halve with each move, so
    few rounds close all.
    """
    draws = tables.put(_draws(spark, n, seed), "draws")
    smaller = F.lag("i").over(Window.partitionBy("j").orderBy("i"))  # a place is picked log(n) times or so
    place = F.coalesce(smaller, F.when(F.col("i") == F.col("j"), F.col("i")))
    ways = tables.put(draws.select(F.col("i").alias("row"), place.alias("place"), "j"), "ways")
    while not ways.where("place is null").isEmpty():
        on = ways.select(F.col("row").alias("j"), F.col("place").alias("end"), F.col("j").alias("next"))
        ahead = ways.where("place is null").select("row", "j").join(on, "j").select("row", F.col("end").alias("place"), F.col("next").alias("j"))
        ways = tables.put(ways.where("place is not null").unionByName(ahead), "ways")
    picked = draws.groupBy(F.col("j").alias("row")).agg(F.max("i").alias("picked"))
    return ways.join(picked, "row", "left").select("row", F.coalesce("picked", "place").alias("place"))


def by_row_drawn(df: DataFrame, index: str, seed: int = 42, valid: float = 0.1, test: float = 0.1) -> DataFrame:
    """split of rows 0 to n - 1 by a NumPy permutation of that seed: its first are tested, the next are for validation ("val").

    Up to LISTED rows the permutation is a list; beyond that Spark follows each
    row through the same shuffle, and only the generator's states reach the driver.
    """
    spark, n = df.sparkSession, df.count()
    n_valid, n_test = _bounds(n, valid, test)
    split = F.when(F.col("place") < n_test, "test").otherwise("val").alias("_split")
    if n <= LISTED:
        order = np.arange(n)
        np.random.default_rng(seed).shuffle(order)
        places = spark.createDataFrame([(int(i), k) for k, i in enumerate(order[: n_test + n_valid])], "row long, place long")
        table = places.select(F.col("row").alias("_i"), split)
    else:
        with Tables(spark) as tables:
            places = _drawn_places(spark, n, seed, tables).where(F.col("place") < n_test + n_valid)
            table = written(places.select(F.col("row").alias("_i"), split), "drawn")
    return df.drop("split").join(table, F.col(index) == F.col("_i"), "left").withColumn("split", F.coalesce("_split", F.lit("train"))).drop("_i", "_split")


def by_column(df: DataFrame, column: str) -> DataFrame:
    """split from a column that names it, without outer blanks and in lower case."""
    return df.withColumn("split", F.lower(F.trim(column)))


def by_session(df: DataFrame, session: str, held: str) -> DataFrame:
    """One session is tested, the others train."""
    return df.withColumn("split", F.when(F.col(session).cast("string") == held, "test").otherwise("train"))


def validate_on_test(df: DataFrame, split: str = "split") -> DataFrame:
    """Test rows serve as validation rows too, once more as role "valid"; all others train."""
    role = F.when(F.col(split) == "test", F.array(F.lit("test"), F.lit("valid"))).otherwise(F.array(F.lit("train")))
    return df.withColumn("role", F.explode(role))


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Rows in a seeded order of the epoch's own, for what reads them in turn."""
    return df.orderBy(F.xxhash64(key, F.lit(seed), F.lit(epoch)), key)


def sample_corpora(corpora: dict[str, DataFrame], shares: dict[str, float], seed: int) -> DataFrame:
    """Rows of several corpora with corpus_key, each kept with its share."""
    out = None
    for k, df in corpora.items():
        part = df.sample(fraction=min(1.0, shares.get(k, 1.0)), seed=seed).withColumn("corpus_key", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def leakage(df: DataFrame, speaker: str = "speaker", split: str = "split") -> DataFrame:
    return df.groupBy(speaker).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def best_epoch(history: DataFrame, metric: str, largest: bool, run: str = "run_id") -> DataFrame:
    """The first epoch with the best value in each run, by one aggregate; epochs without a value count last."""
    x = F.col(metric)
    order = F.struct(x.isNull(), -x if largest else x, "epoch")
    best = F.min_by(F.struct(*(c for c in history.columns if c != run)), order)
    return history.groupBy(run).agg(best.alias("b")).select(*(F.col(run) if c == run else F.col("b")[c].alias(c) for c in history.columns))


def last_epoch(history: DataFrame, run: str = "run_id") -> DataFrame:
    """The last epoch of each run."""
    last = F.max_by(F.struct(*(c for c in history.columns if c != run)), "epoch")
    return history.groupBy(run).agg(last.alias("b")).select(*(F.col(run) if c == run else F.col("b")[c].alias(c) for c in history.columns))
