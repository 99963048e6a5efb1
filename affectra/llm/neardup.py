"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's shingle hashes pass through one permutation; a second permutation,
circularly shifted by k, gives coordinate k of its signature. Equal sets become
one representative first, so exact copies cost nothing more. Representatives
that agree in a band meet in its bucket, and each is verified against the
bucket's hub, the member with the largest buckets: pairs grow with members, not
with their square. What then shares a small bucket but no component is compared
pair by pair. In larger buckets two sets can only be similar enough if they share
one of their rarest shingles, and only such pairs of different components are
verified. Nothing is capped. Counts by bucket or shingle are written before they
are joined, so Spark sees their size and splits the partition of a hot key
instead of leaving it to one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import BASES, U, mix, rolling
from .common import map_arrow, text_or_empty, written
from .substrings import slices, word_hashes

#: Bytes of text whose shingles are made at once in a task (one text at least).
SLICE = 1 << 21

#: Members of a bucket up to which all its unlinked pairs are compared at once.
SMALL_BUCKET = 4


def shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `width` words; shorter texts are one shingle, texts without words none."""
    w, counts = word_hashes([t.lower() for t in texts])
    doc = np.repeat(np.arange(len(counts)), counts)
    ok = np.flatnonzero(doc[width - 1 :] == doc[: max(0, len(doc) - width + 1)]) if len(w) >= width else np.zeros(0, dtype=np.int64)
    h = mix(rolling(w, width, BASES[1])[ok])
    at = np.searchsorted(doc[ok], np.arange(len(counts) + 1))
    ends = np.cumsum(counts)
    out = []
    for i, n in enumerate(counts.tolist()):
        if n >= width:
            out.append(np.unique(h[at[i] : at[i + 1]]))
        elif n:  # the whole sequence; its length keeps it apart from longer ones
            z = int(ends[i])
            out.append(mix(rolling(w[z - n : z], n, BASES[1]) + U(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash signatures, a row for each (non-empty) set."""
    out = np.empty((len(sets), coordinates), dtype=np.uint64)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (n == 0 or n + len(sets[j]) <= 1 << 15):
            n += len(sets[j])
            j += 1
        first = mix(np.concatenate(sets[i:j]) ^ U(0x5DEECE66D1CE4E5B))
        at = np.cumsum([0, *map(len, sets[i : j - 1])])
        y, z = np.empty_like(first), np.empty_like(first)
        for k in range(coordinates):
            np.add(first, U(k), out=y)
            y *= U(0xBF58476D1CE4E5B9)
            np.right_shift(y, U(32), out=z)
            y ^= z
            y *= U(0x94D049BB133111EB)
            out[i:j, k] = np.minimum.reduceat(y, at)
        i = j
    return out


def _signed(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, j in slices(pc.binary_length(batch.column(1)).to_pylist(), SLICE):
                b = batch.slice(i, j - i)
                sets = shingles([t.encode() for t in b.column(1).to_pylist()], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    sig = signatures([sets[i] for i in full], bands * rows)
                    by_band = sig.reshape(len(full), bands, rows)
                    key = np.zeros((len(full), bands), dtype=np.uint64)
                    for r in range(rows):
                        key = mix(key * U(BASES[0]) + by_band[:, :, r])
                    for x, k in zip(full, key.view(np.int64).tolist(), strict=True):
                        keys[x] = k
                one = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                two = [int(mix(s.copy()).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, sets), pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "one", "two", "bands"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("d"), text_or_empty(text_col).alias("t")), run, "doc_id long, n_shingles long, one long, two long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("d").alias("a"), F.col("t").alias("s")), "a").join(texts.select(F.col("d").alias("b"), "t"), "b").select("a", "b", "s", "t")

    def run(batches):
        known: dict = {}  # the sets of the last slices' texts
        for batch in batches:
            for i, j in slices(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_pylist(), SLICE):
                s, t = (batch.column(c).slice(i, j - i).to_pylist() for c in (2, 3))
                every = dict.fromkeys([*s, *t])
                known = {x: known[x] for x in every if x in known}
                new = [x for x in every if x not in known]
                known.update(zip(new, shingles([x.encode() for x in new], width), strict=True))
                ok = []
                for x, y in zip(s, t, strict=True):
                    p, q = known[x], known[y]
                    n = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(n > 0 and 100 * n >= percent * (len(p) + len(q) - n))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i).filter(pa.array(ok)) for c in (0, 1)], names=["a", "b"])

    return map_arrow(both, run, "a long, b long")


def _rare_pairs(open_sets: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of open_sets (u set, r id, n size, c component), of different components, that may be similar enough.

    Shingles are ordered by how many sets hold them, rarest first. Two sets whose
    first common shingle leaves x and y shingles from there on have at most
    min(x, y) in common, which must reach percent / (100 + percent) of both sizes.
    A shingle's largest component is paired with the others only, not with itself.
    """

    def run(batches):
        for batch in batches:
            for i, j in slices(pc.binary_length(batch.column(1)).to_pylist(), SLICE):
                sets = shingles([t.encode() for t in batch.column(1).slice(i, j - i).to_pylist()], width)
                size = [len(s) for s in sets]
                one = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                ids = np.array(batch.column(0).slice(i, j - i).to_pylist(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, size)), pa.array(np.repeat(one, size)), pa.array(np.concatenate(sets).view(np.int64))], names=["r", "one", "h"])

    near = texts.join(open_sets.select(F.col("r").alias("d")).distinct(), "d").select("d", "t")
    held = written(map_arrow(near, run, "r long, one long, h long").select(F.xxhash64("r", "one").alias("u"), "h"), "shingles")
    shared = written(held.groupBy("h").agg(F.count("*").alias("f")).where("f > 1"), "shared")
    ranked = held.join(shared, "h").groupBy("u").agg(F.sort_array(F.collect_set(F.struct("f", "h"))).alias("s")).join(open_sets, "u").where(F.size("s") * 100 >= F.col("n") * percent)
    first = F.slice("s", F.lit(1), F.floor((F.size("s") * 100 - F.col("n") * percent) / 100).cast("int") + 1)
    rare = written(ranked.select("r", "n", "c", F.size("s").alias("of"), F.posexplode(first).alias("i", "s")).select(F.col("s.h").alias("h"), "r", "n", "c", (F.col("of") - F.col("i")).alias("rest")), "rare")
    top = written(rare.groupBy("h", "c").agg(F.count("*").alias("m")).groupBy("h").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1").drop("parts"), "top")
    x, y = rare.join(top, "h").where("c <> top").alias("x"), rare.alias("y")
    enough = F.least("x.rest", "y.rest") * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    once = (F.col("y.c") == F.col("x.top")) | (F.col("x.r") < F.col("y.r"))
    pairs = x.join(y, [F.col("x.h") == F.col("y.h"), F.col("x.c") != F.col("y.c"), once, enough])
    return pairs.select(F.least("x.r", "y.r").alias("a"), F.greatest("x.r", "y.r").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for each vertex of edges (a, b) the smallest vertex it reaches.

    Smallest-label propagation with pointer jumping; each round is a written
    table, and rounds grow with the logarithm of a component's diameter or so.
    """
    ways = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("v", "w").distinct(), "ways")
    label = written(ways.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("c")), "labels")
    while True:
        near = ways.join(label.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("c").alias("n"))
        step = label.join(near, "v").select("v", F.least("c", "n").alias("n"), "c")
        jump = label.select(F.col("v").alias("n"), F.col("c").alias("j"))
        new = written(step.join(jump, "n", "left").select("v", F.least("n", "j").alias("c"), F.col("c").alias("old")), "labels")
        label = new.select("v", "c")
        if new.where("c <> old").isEmpty():
            return label


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = 32, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Documents link where 100 * intersection >= percent * union of their sets of
    distinct `width`-word shingles; component_id is the smallest id reachable. A
    linked pair of similarity s meets in no band with probability
    (1 - s**rows)**bands: 3e-7 at 0.85, 6e-5 at 0.8. Sets hold 64-bit hashes of
    shingles; sets of one size and equal 128-bit sums of hashes count as equal.
    Texts without words link with nothing. Rows of equal id are one vertex; a row
    without id is kept alone, with a null component. An empty table gives no
    rows; other columns aren't carried, whatever their names.
    """
    signed = written(_signed(docs, width, bands, rows, id_col, text_col), "signatures")
    sets = written(signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("r"), F.first("bands").alias("bands")), "sets")
    texts = docs.select(F.col(id_col).cast("long").alias("d"), text_or_empty(text_col).alias("t"))
    size = sets.select("r", F.col("n_shingles").alias("n"))
    member = sets.select(F.col("n_shingles").alias("n"), "r", F.posexplode("bands").alias("i", "k"))
    bucket = written(member.groupBy("i", "k").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    met = written(member.join(bucket, ["i", "k"]), "buckets")
    reach = met.join(met.groupBy("r").agg(F.sum("size").alias("reach")), "r")
    hub = written(reach.groupBy("i", "k").agg(F.max_by("r", F.struct("reach", -F.col("r"))).alias("a")), "hubs")
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent  # no smaller set can be similar enough
    star = met.join(hub, ["i", "k"]).where("r <> a").select("a", F.col("r").alias("b"), "n").distinct().join(size.select(F.col("r").alias("a"), F.col("n").alias("m")), "a").where(fits).select("a", "b")
    star = written(star, "star")
    edges = written(_verified(star, texts, width, percent), "edges")
    label = components(edges)
    # buckets that still hold several components
    placed = met.join(label, met["r"] == label["v"], "left").select("i", "k", "r", "n", "size", F.coalesce("c", "r").alias("c"))
    mixed = written(placed.groupBy("i", "k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("i", "k"), "mixed")
    open_ = written(placed.join(mixed, ["i", "k"], "left_semi"), "open")
    few = open_.where(F.col("size") <= SMALL_BUCKET).select("i", "k", "r", "n", "c")
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, [F.col("x.i") == F.col("y.i"), F.col("x.k") == F.col("y.k"), F.col("x.r") < F.col("y.r"), F.col("x.c") != F.col("y.c"), F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent]).select(F.col("x.r").alias("a"), F.col("y.r").alias("b"))
    many = open_.where(F.col("size") > SMALL_BUCKET).select("r", "n", "c").distinct().join(sets.select("r", F.col("n_shingles").alias("n"), F.xxhash64("r", "one").alias("u")), ["r", "n"])
    rare = _rare_pairs(written(many, "many"), texts, width, percent)
    pairs = written(pairs.union(rare).distinct(), "pairs")
    more = written(_verified(pairs, texts, width, percent), "edges")
    if not more.isEmpty():
        label = components(edges.unionByName(more))
    of = sets.select("n_shingles", "one", "two", "r").join(label, F.col("r") == F.col("v"), "left").select("n_shingles", "one", "two", F.coalesce("c", "r").alias("c"))
    out = signed.join(of, ["n_shingles", "one", "two"], "left").withColumn("c", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")))
    return out.select("doc_id", "n_shingles", F.col("c").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("c"), F.lit(True)).alias("kept"))
