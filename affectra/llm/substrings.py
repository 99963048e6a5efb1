"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Every window of `window` words of a document is hashed; hashes meet in Spark by
their leading bits (see batches). Windows that start earlier elsewhere are
marked and merge into maximal intervals of words to remove. A window's key has
96 bits (a 64-bit and an independent 32-bit rolling hash over 64-bit word
hashes): among n windows n**2 / 2**97 false matches are expected, 0.002 at the
2**44 windows of 100 TB of text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import BASES, BYTES, U, answer, batched, buckets, flagged, mix, powers, rolling, rows_of, send

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once, so that arrays stay in the processor's cache.
CHUNK = 1 << 19


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and the number of words of each text."""
    hashes, counts = [], []
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (n == 0 or n + len(texts[j]) < CHUNK):
            n += len(texts[j]) + 1
            j += 1
        a = np.frombuffer(b" ".join(texts[i:j]) + b" ", dtype=np.uint8)
        space = _SPACE[a]
        turn = np.flatnonzero(np.diff(space, prepend=True))
        start, stop = turn[::2], turn[1::2]
        sums = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum(BYTES[a] * powers(BASES[0], len(a)), out=sums[1:], dtype=np.uint64)
        hashes.append(mix((sums[stop] - sums[start]) * powers(BASES[0], len(a), True)[start] + (stop - start).astype(np.uint64)))
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        counts.append(np.diff(np.searchsorted(start, ends), prepend=0))
        i = j
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes or [none.astype(np.uint64)]), np.concatenate(counts or [none])


def slices(sizes: list[int], most: int):
    """Bounds (start, stop) of neighbours whose sizes add up to `most` at most, one at least."""
    i = 0
    while i < len(sizes):
        j, n = i, 0
        while j < len(sizes) and (j == i or n + sizes[j] <= most):
            n += sizes[j]
            j += 1
        yield i, j
        i = j


def windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of windows within a text: hashes, check bytes, first words; and the words of each text."""
    w, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(counts)), counts)
    ok = np.flatnonzero(doc[width - 1 :] == doc[: len(doc) - width + 1]) if len(w) >= width else np.zeros(0, dtype=np.int64)
    h = mix(rolling(w, width, BASES[1])[ok])
    check = (mix(rolling(w, width, BASES[2])[ok]) >> U(32)).astype(np.uint32)
    return h, check, ok, counts


RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept string"


def remove_repeated_windows(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (maximal removed runs of words), kept (the other words joined by a space).

    A word goes if a window of `window` words that covers it also starts earlier:
    in a smaller id (null ids come first; equal ids in order of a hash of the text), or further
    up in the same document. Null text has no words. Repeated rows are documents
    of their own. An empty table gives no rows; other columns aren't carried.
    """
    parts, total = batched(docs, id_col, text_col)
    bits = buckets(total // 6)

    def hashes(ids, texts):
        h, check, _, _ = windows(texts, window)
        return h, check

    answers = answer(send(parts, hashes, bits), later_only=True)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = rows_of(left)
        h, _, first, counts = windows(texts, window)
        hit, later = flagged(h, bits, right)
        starts = first[hit | later]
        cover = np.zeros(int(counts.sum()) + 1, dtype=np.int32)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        ends = np.cumsum(counts)
        out: list[list] = [[], [], [], []]
        for t, z, n in zip(texts, ends, counts, strict=True):
            g = gone[z - n : z]
            words = t.split()
            if g.any():
                turn = np.flatnonzero(np.diff(g, prepend=False, append=False)).tolist()
                words = [w for w, x in zip(words, g.tolist(), strict=True) if not x]
            else:
                turn = []
            for o, x in zip(out, (int(n), int(g.sum()), [{"start": a, "stop": b} for a, b in zip(turn[::2], turn[1::2], strict=True)], b" ".join(words).decode()), strict=True):
                o.append(x)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "spans": pa.array(out[2], span), "kept": pa.array(out[3], pa.string())})

    return parts.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(run, RESULT)
