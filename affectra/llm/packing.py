"""Packing into fixed-size sequences by cutting-stock column generation.

A document of n ids (its tokens, then one end id) is first cut into whole
sequences of `capacity`; the remainder, 1 to capacity - 1 ids, is an item of the
cutting-stock problem. Only the histogram of remainders, in CLASSES classes of
length whatever the corpus, reaches the driver, where a linear program over
patterns of classes is solved by column generation: a knapsack dynamic program
prices new patterns from the simplex multipliers. Rounded pattern counts say how
many slots each class has; documents are ranked within their class and the rank
alone gives sequence and slot. What rounding leaves over (fewer than one pattern
per class, so bounded) is laid end to end, cut at sequence ends, and its last
part is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty, written

END_ID = 0
#: Classes of length in the linear program; a class rounds lengths up, which
#: costs about half a class width of padding a document.
CLASSES = 256
#: Entries of a worker's memory of encoded words; it is emptied beyond that.
MEMORY = 400_000

_encoders: dict = {}
_ODD = re.compile(r" (?=\s|$)")


class _Words(dict):
    """Little-endian ids of a space and a word, encoded when first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word):
        if len(self) >= MEMORY:
            self.clear()
        got = self[word] = np.array(self.encode(" " + word), dtype="<u4").tobytes()
        return got


def _added(ranks_path: str) -> tuple[re.Pattern, dict[str, bytes]]:
    """A pattern of the vocabulary's added tokens, the longest first, and the id of each as bytes."""
    with open(ranks_path.removesuffix(".tiktoken") + ".json") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens are matched as they stand only")
    added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in tokens}
    return re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")"), added


def encoder(ranks_path: str):
    """text -> ids as little-endian unsigned 32-bit bytes.

    ranks_path holds a public byte-level BPE vocabulary as ranks. A text is split
    at each space that a visible character follows: the vocabulary's pattern
    always parts pieces there, so words are encoded once and remembered. Texts
    in which white space follows a space are encoded whole. Added tokens of the
    .json beside the ranks part a text first: each is one id and what lies between
    is encoded by itself, the space before one too.
    """
    if ranks_path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        encode = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _encoders[ranks_path] = encode, _Words(encode), *_added(ranks_path)
    encode, words, markers, added = _encoders[ranks_path]
    odd = _ODD.search

    def plain(text: str) -> bytes:
        if odd(text):
            return np.array(encode(text), dtype="<u4").tobytes()
        head, *rest = text.split(" ")
        return np.array(encode(head), dtype="<u4").tobytes() + b"".join(map(words.__getitem__, rest))

    def ids(text: str) -> bytes:
        if not any(map(text.__contains__, added)):
            return plain(text)
        # every other part is a marker
        return b"".join(added[x] if i % 2 else plain(x) for i, x in enumerate(markers.split(text)) if x)

    return ids


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _tokenized(docs: DataFrame, ranks_path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: its number of ids, checksums of its pieces, and its place
    among the documents of the same class that the same task has read."""
    end, width = np.array([END_ID], dtype="<u4").tobytes(), max(1, capacity // CLASSES)

    def run(batches):
        ids = encoder(ranks_path)
        part, whole, seen = TaskContext.get().partitionId(), 0, {}
        for b in batches:
            rows: list[list] = [[] for _ in range(5)]
            for text in b.column("t").to_pylist():
                buf = ids(text) + end
                n = len(buf) // 4
                rem = n % capacity
                kind = -(-rem // width)
                rank = seen.get(kind, 0)
                seen[kind] = rank + 1
                for r, x in zip(rows, (n, kind, rank, whole, [zlib.crc32(buf[i : i + 4 * capacity]) for i in range(0, len(buf), 4 * capacity)]), strict=True):
                    r.append(x)
                whole += n // capacity
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.list_(pa.int64())), pa.array([part] * len(rows[0]), pa.int32())], names=["doc_id", "doc_tokens", "kind", "rank", "whole", "crcs", "part"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("d"), text_or_empty(text_col).alias("t")), run, "doc_id long, doc_tokens long, kind int, rank long, whole long, crcs array<long>, part int")


def _knapsack(value: np.ndarray, capacity: int, most: int) -> list[np.ndarray]:
    """Up to `most` patterns (copies of each length, the index), best value first.

    best[c] is the value of the best pattern within c; each length tried as the
    first item of a full pattern gives one candidate.
    """
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=int)
    top = len(value) - 1
    for c in range(1, capacity + 1):
        k = min(c, top)
        got = best[c - k : c][::-1] + value[1 : k + 1]
        j = int(got.argmax())
        best[c], pick[c] = (got[j], j + 1) if got[j] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    first = value[1:] + best[capacity - top : capacity][::-1]
    out = []
    for s in np.argsort(-first)[:most]:
        if value[s + 1] <= 0:
            continue
        a, c = np.zeros(top + 1), capacity - int(s) - 1
        a[s + 1] = 1
        while c > 0:
            if pick[c]:
                a[pick[c]] += 1
            c -= pick[c] or 1
        out.append(a)
    return out


def patterns(demand: dict[int, int], capacity: int, gap: float = 0.0003, rounds: int = 400) -> list[tuple[dict[int, int], float]]:
    """Patterns (copies of each length) and how often the linear program uses them.

    min sum x, for each length: sum of copies * x = demand. Column generation
    starts from lengths paired with their complements; it ends when Farley's
    bound shows less than `gap` to gain. rounds bounds the driver's work; an
    earlier end costs some padding and never a document.
    """
    sizes = np.array(sorted(s for s, d in demand.items() if d > 0))
    if not len(sizes):
        return []
    at = {int(s): i for i, s in enumerate(sizes)}
    d = np.array([demand[int(s)] for s in sizes], dtype=float)
    m = len(sizes)
    cols, inverse = np.zeros((m, m)), np.zeros((m, m))
    for i, s in enumerate(map(int, sizes)):
        cols[i, i] = capacity // s
        j = at.get(capacity - s)
        if j is not None and j != i and d[i] <= d[j] and (d[i] < d[j] or i < j):  # the scarcer of a pair goes with its complement
            cols[i, i] = cols[j, i] = 1
    for i in range(m):
        inverse[i, i] += 1 / cols[i, i]
        for j in np.flatnonzero(cols[:, i]):
            if j != i:
                inverse[j, i] -= 1 / cols[j, j]
    x = np.einsum("ij,j", inverse, d)
    value = np.zeros(int(sizes[-1]) + 1)
    for _ in range(rounds):
        value[sizes] = np.maximum(inverse.sum(axis=0), 0)
        pool = np.array([a[sizes] for a in _knapsack(value, capacity, 64)])
        if not len(pool) or np.einsum("ij,j", pool, value[sizes]).max() <= 1 + gap:
            break
        for _ in range(len(pool)):
            worth = np.einsum("ij,j", pool, inverse.sum(axis=0))
            k = int(worth.argmax())
            if worth[k] <= 1 + gap / 2:
                break
            a = pool[k]
            w = np.einsum("ij,j", inverse, a)
            ok = w > 1e-9
            if not ok.any():
                break
            r = int(np.where(ok, np.maximum(x, 0) / np.where(ok, w, 1), np.inf).argmin())
            step = max(x[r], 0) / w[r]
            x -= step * w
            x[r] = step
            pivot = inverse[r] / w[r]
            inverse -= w[:, None] * pivot
            inverse[r] = pivot
            cols[:, r] = a
    return [({int(sizes[i]): int(c) for i, c in enumerate(cols[:, k]) if c}, float(max(x[k], 0))) for k in range(m)]


def plan(demand: dict[int, int], capacity: int) -> dict:
    """Slots for each class, and how many of its documents they take.

    slots[class]: (first ranks, [copies in a sequence, first slot, first
    sequence]); documents whose rank is beyond given[class] are the rest.
    """
    left = dict(demand)
    used: list[list] = []
    for pattern, x in sorted(patterns(demand, capacity), key=lambda p: -(p[1] % 1)):
        k = min([int(x + 1e-6), *(left[s] // c for s, c in pattern.items())])
        for s, c in pattern.items():
            left[s] -= k * c
        used.append([pattern, k])
    for u in used:  # rounding up as far as documents are left
        if all(left[s] >= c for s, c in u[0].items()) and sum(s * c for s, c in u[0].items()) == capacity:
            u[1] += 1
            for s, c in u[0].items():
                left[s] -= c
    slots: dict[int, tuple[list, list]] = {}
    given: dict[int, int] = {}
    first = 0
    for pattern, k in used:
        if k:
            slot = 0
            for s, c in sorted(pattern.items(), reverse=True):
                ranks, where = slots.setdefault(s, ([], []))
                ranks.append(given.get(s, 0))
                where.append((c, slot, first))
                given[s] = given.get(s, 0) + k * c
                slot += c
            first += k
    return {"slots": slots, "given": given, "sequences": first}


def ends_of(total: int, capacity: int) -> list[int]:
    """Ends of the sequences that hold `total` ids end to end: capacity each, then powers of two."""
    ends = list(range(capacity, total + 1, capacity))
    at, bit = total - total % capacity, capacity
    while bit := bit // 2:
        if total % capacity & bit:
            at += bit
            ends.append(at)
    return ends


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, capacity: int = 1024, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of documents in sequences: one row per piece.

    doc_id, start, length (ids before and in the piece), ids_crc32, doc_tokens,
    sequence_id, offset. Null and empty texts are one end id; null ids and
    repeated rows are documents of their own; an empty table gives no rows;
    other columns are not carried. capacity is a power of two.
    """
    ranks_path = ranks_path or default_vocabulary()
    width = max(1, capacity // CLASSES)
    counted = written(_tokenized(docs, ranks_path, capacity, id_col, text_col), "packing")
    kinds = counted.groupBy("kind", "part").agg(F.count("*").alias("n"))
    # a row per class: CLASSES rows at most
    demand = {r["kind"]: r["n"] for r in kinds.where("kind > 0").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    p = plan(demand, capacity // width)
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = kinds.select("kind", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked"))
    tasks = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    wholes = counted.groupBy("part").agg(F.sum(F.floor(F.col("doc_tokens") / capacity)).alias("w")).select("part", F.coalesce(F.sum("w").over(tasks), F.lit(0)).alias("wholes"))
    placed = counted.join(earlier, ["kind", "part"]).join(wholes, "part").select("doc_id", "doc_tokens", "kind", (F.col("rank") + F.col("ranked")).alias("rank"), (F.col("whole") + F.col("wholes")).alias("whole"), "crcs")

    def lay(batches):
        """Pieces; `offset` is the slot. The rest has no sequence yet: its class and rank are kept there."""
        for b in batches:
            rows = []
            for d, n, kind, rank, whole, crcs in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                full = n // capacity
                rows += [(d, i * capacity, capacity, crcs[i], n, -1 - whole - i, 0) for i in range(full)]
                if kind:
                    last = (d, full * capacity, n % capacity, crcs[full], n)
                    if rank < p["given"].get(kind, 0):
                        ranks, where = p["slots"][kind]
                        k = bisect_right(ranks, rank) - 1
                        copies, slot, first = where[k]
                        rows.append((*last, first + (rank - ranks[k]) // copies, slot + (rank - ranks[k]) % copies))
                    else:
                        rows.append((*last, None, (kind << 40) + rank))
            yield _batch(rows, PIECE)

    laid = written(map_arrow(placed, lay, ", ".join(f"{c} long" for c in PIECE)), "packing")
    inside = Window.partitionBy("sequence_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)  # capacity rows at most
    slotted = laid.where("sequence_id >= 0").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    rest = laid.where("sequence_id is null")
    total = rest.agg(F.sum("length")).first()[0] or 0  # below CLASSES * capacity but for a linear program cut short
    ends = ends_of(total, capacity)
    whole = laid.where("sequence_id < 0").withColumn("sequence_id", p["sequences"] + len(ends) - 1 - F.col("sequence_id"))
    along = Window.orderBy(F.desc("offset")).rowsBetween(Window.unboundedPreceding, -1)  # the bounded rest only
    first_rest = p["sequences"]

    def cut(batches):
        for b in batches:
            rows = []
            for d, start, length, crc, n, at in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                stop, k = at + length, bisect_right(ends, at)
                while at < stop:
                    to = min(stop, ends[k])
                    rows.append((d, start, to - at, crc, n, first_rest + k, at - (ends[k - 1] if k else 0), length))
                    start, at, k = start + to - at, to, k + 1
            yield _batch(rows, [*PIECE, "of"])

    resting = written(map_arrow(rest.select(*PIECE[:5], F.coalesce(F.sum("length").over(along), F.lit(0)).alias("at")), cut, ", ".join(f"{c} long" for c in [*PIECE, "of"])), "packing")
    # at most a document for each of the rest's sequence ends is cut there; its ids are taken again
    torn = resting.where("length < of").groupBy("doc_id", "doc_tokens", "ids_crc32").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    again = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t")).alias("a").join(F.broadcast(torn.alias("c")), F.col("a.doc_id").eqNullSafe(F.col("c.doc_id"))).select("a.doc_id", "t", "doc_tokens", "ids_crc32", "cuts")
    end = np.array([END_ID], dtype="<u4").tobytes()

    def check(batches):
        ids = encoder(ranks_path)
        for b in batches:
            rows = []
            for d, t, n, last, cuts in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                buf = ids(t) + end
                if len(buf) == 4 * n and zlib.crc32(buf[n // capacity * capacity * 4 :]) == last:  # else another row with this id
                    rows += [(d, c["start"], c["length"], zlib.crc32(buf[4 * c["start"] : 4 * (c["start"] + c["length"])]), n, c["sequence_id"], c["offset"]) for c in cuts]
            yield _batch(rows, PIECE)

    checked = map_arrow(again, check, ", ".join(f"{c} long" for c in PIECE)).dropDuplicates(["sequence_id", "offset"])
    return slotted.select(PIECE).unionByName(whole.select(PIECE)).unionByName(resting.where("length = of").select(PIECE)).unionByName(checked)


def sequences(pieces: DataFrame, docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed ids themselves: sequence_id, ids (array of int, unpadded).

    Needs distinct document ids. Rows of a sequence meet in one group of at most
    `capacity` ids.
    """
    ranks_path = ranks_path or default_vocabulary()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def take(batches):
        ids = encoder(ranks_path)
        for b in batches:
            out = [np.frombuffer(ids(t) + end, dtype="<u4")[s : s + k].tolist() for t, s, k in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    joined = pieces.join(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t")), "doc_id").select("sequence_id", "offset", "t", "start", "length")
    parts = map_arrow(joined, take, "sequence_id long, offset long, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
