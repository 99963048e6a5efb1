"""Documents in batches of neighbouring ids, and hash exchanges between batches.

Batches are ranges of ids in order (rows of one id in order of a hash of the
text), cut by bytes, so "earlier" between batches is a smaller batch number and
no ids travel with hashes. A batch first resolves repeats
within itself (the pre-aggregation: a hot hash leaves a batch once), sends each
distinct hash to the bucket of its leading bits as packed bytes, and gets back
the places of hashes that other batches hold. Batches are sorted within, so the
same input gives the same places whenever a task runs again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affectra.functions.cluster import ship

from .common import text_bytes, text_or_empty, written

#: Bytes of text in a batch, and hashes in a bucket on average.
BATCH_BYTES, BUCKET_HASHES = 6 << 20, 1_000_000
#: Batches whose beginnings are collected and bisected; more are joined.
CUTS = 1 << 16
#: What a row counts besides its text, so that empty ones are bounded too; bytes of text in a range of the running sum.
ROW_BYTES, RANGE_BYTES = 16, 64 << 20

U = np.uint64
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    x = x ^ x >> U(30)
    x *= _MIX1
    x ^= x >> U(27)
    x *= _MIX2
    x ^= x >> U(31)
    return x


#: A random value for each byte; odd bases of the rolling hashes and their inverses modulo 2**64.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), or of its inverse, modulo 2**64."""
    got = _powers.get((base, inverse))
    if got is None or len(got) < n:
        step = np.full(max(n, 1 << 16), pow(base, -1 if inverse else 1, 1 << 64), dtype=np.uint64)
        step[0] = 1
        got = _powers[base, inverse] = np.cumprod(step, dtype=np.uint64)
    return got[:n]


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every `width` neighbouring values: a difference of prefix sums, shifted to a common power."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:], dtype=np.uint64)
    return (sums[width:] - sums[:n]) * powers(base, n, True)


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The order of rows: id (null first) and a hash of the text."""
    return F.col(id_col).cast("long"), F.xxhash64(text_or_empty(text_col))


def _keys(docs: DataFrame, total: int, id_col: str, text_col: str) -> DataFrame:
    """(d, h, b, before, one, hot, begins) of each key: its batch, bytes before it, bytes of a row, whether its equal rows alone exceed a batch, and whether a batch begins with it.

    A batch is what begins within BATCH_BYTES of the running sum of bytes over
    the keys in order, which is taken range by range.
    """
    d, h = _key(id_col, text_col)
    each = docs.select(d.alias("d"), h.alias("h"), (F.octet_length(text_or_empty(text_col)).cast("long") + ROW_BYTES).alias("s"))
    keys = each.groupBy("d", "h").agg(F.sum("s").alias("s"), F.max("s").alias("one"))
    ranges = written(keys.repartitionByRange(1 + total // RANGE_BYTES, F.asc_nulls_first("d"), "h").withColumn("p", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = ranges.groupBy("p").agg(F.sum("s").alias("all")).select("p", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    along = Window.partitionBy("p").orderBy(F.asc_nulls_first("d"), "h")
    sums = ranges.select("*", F.sum("s").over(along).alias("to"), F.lag(F.struct("s"), 1).over(along).alias("last")).join(F.broadcast(base), "p")
    began = F.col("base") + F.col("to") - F.col("s")
    b, before = F.floor(began / BATCH_BYTES), F.floor((began - F.coalesce(F.col("last.s"), F.lit(0))) / BATCH_BYTES)
    hot = (F.col("s") > BATCH_BYTES) & (F.col("s") > F.col("one"))
    return sums.select("d", "h", b.alias("b"), began.alias("before"), "one", hot.alias("hot"), (F.col("last").isNull() | (b > before)).alias("begins"))


def batched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """(b, d, h, t and those of extra): the number of the batch, id, hash of the text and text; and all bytes of text.

    Rows are in order of id (null first) and hash. Rows of one id part into
    batches like others; so do rows equal in id and text, which are counted and
    dealt out again: only a single text makes a batch larger than BATCH_BYTES
    and the text that it ends with. Up to CUTS batches the keys that begin them
    are collected and a row finds its batch by bisection; beyond that rows are
    joined with their keys.
    """
    ship(docs.sparkSession)
    total = text_bytes(docs, text_col)
    d, h = _key(id_col, text_col)
    extra = extra or {}
    rows = docs.select(d.alias("d"), h.alias("h"), text_or_empty(text_col).alias("t"), *(c.alias(k) for k, c in extra.items()))
    columns = "cast(b as int) as b", "d", "h", "t", *extra
    keys = _keys(docs, total, id_col, text_col)
    same = F.col("d").eqNullSafe(F.col("hd")) & (F.col("h") == F.col("hh"))
    if total // BATCH_BYTES <= CUTS:
        got = keys.where("begins or hot").drop("begins").collect()
        got.sort(key=lambda r: (r.d is not None, r.d or 0, r.h))
        parts = rows.withColumn("b", _place([(r.d, r.h, r.b) for r in got]))
        hot = [(r.d, r.h, r.before, r.one) for r in got if r.hot]
        if not hot:
            return parts.selectExpr(*columns), total
        listed = F.broadcast(docs.sparkSession.createDataFrame(hot, "hd long, hh long, before long, one long"))
        parts = parts.join(listed, same, "left_anti")
    else:
        kept = written(keys.withColumnsRenamed({"d": "hd", "h": "hh"}), "keys")
        listed = kept.where("hot").select("hd", "hh", "before", "one")
        parts = rows.join(kept.where("not hot").select("hd", "hh", "b"), same)
    copies = rows.join(listed, same).groupBy("d", "h", "t", "before", "one", *extra).agg(F.count("*").alias("n"))
    dealt = copies.select("d", "h", "t", *extra, "before", "one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    dealt = dealt.withColumn("b", F.floor((F.col("before") + F.col("i") * F.col("one")) / BATCH_BYTES))
    return parts.selectExpr(*columns).unionByName(dealt.selectExpr(*columns)), total


class Cuts:
    """The keys (d, h) that begin batches, in order; null d is the smallest."""

    def __init__(self, cuts: list[tuple]):
        self.b = np.array([0, *(c[2] for c in cuts)], dtype=np.int64)
        self.d = np.unique(np.array([c[0] for c in cuts if c[0] is not None], dtype=np.int64))
        self.h = np.unique(np.array([c[1] for c in cuts], dtype=np.int64))
        null = np.array([c[0] is None for c in cuts], dtype=bool)
        self.keys = self._key(np.array([c[0] or 0 for c in cuts], dtype=np.int64), null, np.array([c[1] for c in cuts], dtype=np.int64))

    def _key(self, d: np.ndarray, null: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Numbers in order of keys, as far as cuts tell them apart: even places are ids of cuts (0: null), where the hash counts."""
        place = np.where(null, 0, 1 + np.searchsorted(self.d, d) + np.searchsorted(self.d, d, side="right"))
        among = np.searchsorted(self.h, h, side="right")
        return place * (len(self.h) + 1) + np.where(null | (place % 2 == 0), among, 0)

    def batch(self, d: np.ndarray, null: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The batch of the last cut at or below each key; 0 below all."""
        return self.b[np.searchsorted(self.keys, self._key(d, null, h), side="right")]


def _place(cuts: list[tuple]) -> Column:
    """The batch of (d, h), by bisection among the cuts; the text stays where it is, only keys go to Python."""
    held = Cuts(cuts)

    @F.arrow_udf("long")
    def place(d: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(held.batch(d.fill_null(0).to_numpy(), d.is_null().to_numpy(zero_copy_only=False), h.to_numpy()))

    return place("d", "h")


_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(data: bytes) -> bytes:
    return _zip.compress(data)


def expand(data: bytes) -> bytes:
    return _unzip.decompress(data)


def pack(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, lowest first, planes of zeros at the end left out, compressed."""
    used = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return squeeze(np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :used].T.tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    out, data = np.zeros((n, 8), dtype=np.uint8), expand(data)
    if n and data:
        out[:, : len(data) // n] = np.frombuffer(data, dtype=np.uint8).reshape(-1, n).T
    return out.view("<u8")[:, 0].astype(np.uint64)


def rows_of(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a batch, in order of id (null first), hash and text."""
    rows = sorted(zip(table.column("d").to_pylist(), table.column("h").to_pylist(), (t.encode() for t in table.column("t").to_pylist()), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    return [r[0] for r in rows], [r[2] for r in rows]


def buckets(total_hashes: int) -> int:
    """Bits of a bucket's number."""
    return max(0, int(np.ceil(np.log2(max(1, total_hashes / BUCKET_HASHES)))))


def split(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the buckets that have any of the sorted hashes, and their numbers: work in proportion to the hashes, however many buckets there are."""
    if not len(h):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
    name = h >> U(64 - bits) if bits else np.zeros(len(h), dtype=np.uint64)
    at = np.concatenate([[0], np.flatnonzero(name[1:] != name[:-1]) + 1, [len(h)]])
    return at, name[at[:-1]].astype(np.int64)


def begins(h: np.ndarray, bits: int, names: list[int]) -> np.ndarray:
    """Where the buckets of these numbers begin in the sorted hashes."""
    k = np.array(names, dtype=np.uint64)
    return np.searchsorted(h, k << U(64 - bits)) if bits else np.zeros(len(k), dtype=np.int64)


def firsts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each equal hash, sorted by hash, and for every place whether its hash came before."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    later = np.zeros(len(s), dtype=bool)
    later[order] = ~new
    return order[new], later


MESSAGE = "k int, b int, n int, h binary, c binary, w binary"


def send(docs: DataFrame, hashes: Callable[[list, list[bytes]], tuple[np.ndarray, np.ndarray]], bits: int, counted: bool = False) -> DataFrame:
    """Distinct hashes of each batch, dealt to buckets: rows (k bucket, b batch, n, h steps between sorted 64-bit hashes, c their 32-bit checks, w how often each is there if counted)."""

    def run(table: pa.Table) -> pa.Table:
        ids, texts = rows_of(table)
        h, check = hashes(ids, texts)
        place, _ = firsts(h)
        s, c = h[place], check[place].astype(np.uint32)
        at, names = split(s, bits)
        w = np.bincount(np.searchsorted(s, h), minlength=len(s)).astype(np.uint64) if counted else None
        out = [(int(k), int(z - a), pack(np.diff(s[a:z], prepend=U(0))), c[a:z].tobytes(), pack(w[a:z]) if counted else None) for k, a, z in zip(names, at[:-1], at[1:], strict=True)]
        b = table.column("b")[0].as_py()
        return pa.table({"k": pa.array([x[0] for x in out], pa.int32()), "b": pa.array([b] * len(out), pa.int32()), "n": pa.array([x[1] for x in out], pa.int32()), **{name: pa.array([x[i] for x in out], pa.binary()) for i, name in enumerate(("h", "c", "w"), 2)}})

    return docs.groupBy("b").applyInArrow(run, MESSAGE)


def answer(sent: DataFrame, later_only: bool, often: int | None = None) -> DataFrame:
    """(b, k, p, q): places, in what batch b sent to bucket k, of hashes that other batches sent; later_only: earlier batches; q: of those that are there `often` times in all."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(x).to_pylist() for x in ("b", "n", "h", "c", "w")), strict=True), key=lambda r: r[:4])
        h = np.concatenate([np.cumsum(unpack(x, m), dtype=np.uint64) for _, m, x, *_ in rows])
        c = np.concatenate([np.frombuffer(r[3], dtype=np.uint32) for r in rows])
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if (same & (c[order][1:] != c[order][:-1])).any():
            order = np.lexsort((c, h))
            same = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
        flag, many = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
        flag[order[1:][same]] = True
        if not later_only:
            flag[order[:-1][same]] = True
        if often is not None:
            w = np.concatenate([unpack(r[4], r[1]) for r in rows]).astype(np.int64)
            group = np.cumsum(np.concatenate([[False], ~same])) if len(order) else np.zeros(0, dtype=np.int64)
            many[order] = np.bincount(group, weights=w[order])[group] >= often if len(order) else False
        ends = np.cumsum([0, *(r[1] for r in rows)])
        k = table.column("k")[0].as_py()
        out = [(r[0], *(np.flatnonzero(x[i:j]).astype(np.uint32).tobytes() for x in (flag, many))) for r, i, j in zip(rows, ends[:-1], ends[1:], strict=True) if flag[i:j].any() or many[i:j].any()]
        return pa.table({"b": pa.array([x[0] for x in out], pa.int32()), "k": pa.array([k] * len(out), pa.int32()), "p": pa.array([x[1] for x in out], pa.binary()), "q": pa.array([x[2] for x in out], pa.binary())})

    return sent.groupBy("k").applyInArrow(run, "b int, k int, p binary, q binary")


def flagged(h: np.ndarray, bits: int, answers: pa.Table, column: str = "p") -> tuple[np.ndarray, np.ndarray]:
    """For a batch's hashes, in order: whether the hash was answered in that column, and whether it came before in the batch."""
    place, later = firsts(h)
    s = h[place]
    names = answers.column("k").to_pylist()
    hit = np.zeros(len(s), dtype=bool)
    for at, p in zip(begins(s, bits, names).tolist(), answers.column(column).to_pylist(), strict=True):
        hit[at + np.frombuffer(p, dtype=np.uint32).astype(np.int64)] = True
    # spread from the first of each hash to all
    out = np.zeros(len(h), dtype=bool)
    if len(h):
        out = hit[np.searchsorted(s, h)]
    return out, later
