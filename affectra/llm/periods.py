"""Periodic runs of words, found by block convolution at dyadic scales.

At scale m the words are cut into blocks of m; a block's squared differences
from the words 1 * m to 2 * m places on, taken for all places at once by a
number-theoretic transform, are zero where the block occurs again. Such a
distance is a seed, which extends both ways to a maximal stretch. A run of at
least three periods holds a whole block of the scale below its period, so no run
is missed; extended seeds are compared word by word, so none is made up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import BASES, U, mix, powers
from .common import column, map_arrow, text_or_empty
from .substrings import slices

#: A prime of the form k * 2**27 + 1 and a primitive root of it: texts of up to 2**27 words a period.
PRIME, ROOT = 2013265921, 31
#: Bytes of text, and elements of blocks, taken together.
CHUNK, ELEMENTS = 2 << 20, 1 << 20

_P = U(PRIME)
_roots: dict[tuple[int, bool], np.ndarray] = {}


def _unity(h: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. h - 1 of a root of unity of order 2 * h, or of its inverse."""
    got = _roots.get((h, inverse))
    if got is None:
        w = pow(ROOT, (PRIME - 1) // (2 * h), PRIME)
        w = pow(w, -1, PRIME) if inverse else w
        got, n = np.ones(h, dtype=np.uint64), 1
        while n < h:
            got[n : 2 * n] = got[:n] * U(pow(w, n, PRIME)) % _P
            n *= 2
        _roots[h, inverse] = got
    return got


def _reduced(x: np.ndarray) -> np.ndarray:
    """x of less than twice the prime, modulo it: what is too small wraps and is the larger."""
    return np.minimum(x, x - _P)


def transform(x: np.ndarray) -> np.ndarray:
    """Rows transformed modulo PRIME; places come in bit-reversed order."""
    rows, n = x.shape
    h = n // 2
    while h:
        v = x.reshape(rows, -1, 2, h)
        u, w = v[:, :, 0], v[:, :, 1]
        x = np.stack([_reduced(u + w), (u + _P - w) * _unity(h, False) % _P], axis=2)
        h //= 2
    return x.reshape(rows, n)


def back(x: np.ndarray) -> np.ndarray:
    """The inverse of transform."""
    rows, n = x.shape
    h = 1
    while h < n:
        v = x.reshape(rows, -1, 2, h)
        u, w = v[:, :, 0], v[:, :, 1] * _unity(h, True) % _P
        x = np.stack([_reduced(u + w), _reduced(u + _P - w)], axis=2)
        h *= 2
    return x.reshape(rows, n) * U(pow(n, -1, PRIME)) % _P


def mismatches(blocks: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo PRIME, of each block from the words at every place of its window.

    Rows of blocks have m numbers, those of windows `after` w >= m; the result
    has w - m + 1 places a row. Zero where all are equal; a zero elsewhere (a sum
    that PRIME divides) is for the caller to rule out.
    """
    m, w = blocks.shape[1], after.shape[1]
    n = 1 << (w - 1).bit_length()
    x, y = np.zeros((len(blocks), n), dtype=np.uint64), np.zeros((len(blocks), n), dtype=np.uint64)
    x[:, :m], y[:, :w] = blocks[:, ::-1], after
    products = back(transform(x) * transform(y) % _P)[:, m - 1 : w]
    squares = np.zeros((len(blocks), w + 1), dtype=np.uint64)
    np.cumsum(after * after % _P, axis=1, out=squares[:, 1:])
    own = (blocks * blocks % _P).sum(axis=1, keepdims=True)
    return (own + squares[:, m:] - squares[:, : w - m + 1] + U(2) * (_P - products)) % _P


def scales(x: np.ndarray, longest: int, smallest: int):
    """(m, starts of blocks) for each scale that a text of `longest` words has room for.

    x: numbers of words from 1. A block whose words don't all occur again within
    twice its length lies in no run of the scale and is left out.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    again = np.full(n, n + 1, dtype=np.int64)
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    m, farthest = smallest, again[: n // smallest * smallest].reshape(-1, smallest).max(axis=1)
    while 3 * m <= longest or m == smallest:
        yield m, np.flatnonzero(farthest < 2 * m) * m
        farthest = farthest[: len(farthest) // 2 * 2].reshape(-1, 2).max(axis=1)
        m *= 2


def occurrences(x: np.ndarray, block: np.ndarray, m: int, low: int):
    """(block starts, distances from low to 2 * m - 1) without mismatch, some blocks at a time."""
    width = 2 * m - 1 - low + m
    padded = np.concatenate([x, np.zeros(3 * m, dtype=x.dtype)])
    step = max(1, ELEMENTS // (4 * m))
    for i in range(0, len(block), step):
        b = block[i : i + step, None]
        row, place = np.nonzero(mismatches(padded[b + np.arange(m)], padded[b + low + np.arange(width)]) == 0)
        yield b[row, 0], place + low


def _uncovered(block: np.ndarray, m: int, found: np.ndarray) -> np.ndarray:
    """Blocks less those that a run of smaller period holds with their windows: they occur at multiples of that period only, in the same run."""
    if not len(block) or not len(found):
        return block
    wide = found[found[:, 1] - found[:, 0] >= 3 * m]
    depth = np.zeros(len(block) + 1, dtype=np.int64)
    np.add.at(depth, np.searchsorted(block, wide[:, 0]), 1)
    np.add.at(depth, np.searchsorted(block, wide[:, 1] - 3 * m, side="right"), -1)
    return block[np.cumsum(depth[:-1]) == 0]


def _extended(x: np.ndarray, prefix: tuple[np.ndarray, np.ndarray], b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far words d apart are equal before and from each place b, by bisection over prefix hashes.

    Hashes never fall short; where two differing stretches hash alike a result is
    too far, which the caller's comparison finds.
    """
    n = len(x)
    sums, unit = prefix
    code = lambda i, j: (sums[j] - sums[i]) * unit[i]
    out = []
    for sign, most in ((-1, b), (1, n - b - d)):
        low, high = np.zeros(len(b), dtype=np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            i, j = (b - mid, b) if sign < 0 else (b, b + mid)
            equal = code(i, j) == code(i + d, j + d)
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        out.append(low)
    return out[0], out[1]


def _compared(x: np.ndarray, prefix: tuple[np.ndarray, np.ndarray], b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _extended, word by word."""
    before, after = [], []
    for i, k in zip(b.tolist(), d.tolist(), strict=True):
        other = np.flatnonzero(x[:-k] != x[k:])
        at = np.searchsorted(other, i)
        before.append(i - 1 - other[at - 1] if at else i)
        after.append((other[at] if at < len(other) else len(x) - k) - i)
    return np.array(before, dtype=np.int64), np.array(after, dtype=np.int64)


def runs(x: np.ndarray, longest: int, least: int = 24, periods: int = 3, extend=_extended) -> np.ndarray:
    """(start, stop, period) of all runs in numbers of words, by start, then period.

    A run is a maximal stretch with smallest period q and at least `least` words
    and `periods` * q. Texts of at most `longest` words follow each other in x
    with numbers of their own, so no stretch crosses them.
    """
    smallest = 1 << ((least + 2) // 3).bit_length() - 1
    if longest < least or len(x) < smallest:
        return np.zeros((0, 3), dtype=np.int64)
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(mix(x + U(1)) * powers(BASES[2], len(x)), out=sums[1:], dtype=np.uint64)
    prefix = sums, powers(BASES[2], len(x) + 1, True)
    found = np.zeros((0, 3), dtype=np.int64)
    for m, block in scales(x, longest, smallest):
        for b, d in occurrences(x, _uncovered(block, m, found), m, 1 if m == smallest else m):
            before, after = extend(x, prefix, b, d)
            start, stop = b - before, b + d + after
            kept = (stop - start >= np.maximum(least, periods * d)) & (stop > start + d)
            # a stretch is found at each multiple of its period too: the least is the period
            found = np.unique(np.concatenate([found, np.column_stack([start, stop, d])[kept]]), axis=0)
            new = np.ones(len(found), dtype=bool)
            new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
            found = found[new]
    if not all(np.array_equal(x[s : e - q], x[s + q : e]) for s, e, q in found.tolist()):
        return runs(x, longest, least, periods, _compared)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, numbers of all words from 1 (equal words of one text have one, texts share none), and counts."""
    words, numbers, base = [], [], 1
    for t in texts:
        w = t.split()
        place = {k: i for i, k in enumerate(dict.fromkeys(w), base)}
        numbers.append(np.fromiter(map(place.__getitem__, w), dtype=np.uint64, count=len(w)))
        words.append(w)
        base += len(place)
    return words, np.concatenate(numbers or [np.zeros(0, dtype=np.uint64)]), np.array([len(w) for w in words], dtype=np.int64)


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = 24, periods: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    A run is a stretch of consecutive words with smallest period q, at least
    `least` words and `periods` (3 or more) times q, that no neighbour extends.
    collapsed: the words that no run holds after its first period, joined by a
    space. Null and empty texts have no words and no runs; rows without id and
    repeated rows are rows of their own; an empty table gives no rows; other
    columns aren't carried. Words are parted by space and U+0009 to U+000D.
    """
    if periods < 3 or least < 1:
        raise ValueError("runs have three periods and one word at least")

    def run(batches):
        for b in batches:
            texts = b.column("t").cast(pa.binary()).to_pylist()
            for i, j in slices([len(t) for t in texts], CHUNK):
                words, x, counts = numbered(texts[i:j])
                found = runs(x, int(counts.max(initial=0)), least, periods)
                gone = np.zeros(len(x) + 1, dtype=np.int64)
                np.add.at(gone, found[:, 0] + found[:, 2], 1)
                np.add.at(gone, found[:, 1], -1)
                gone = np.cumsum(gone[:-1]) > 0
                stop = np.cumsum(counts)
                doc = np.searchsorted(stop, found[:, 0], side="right")
                bounds = np.searchsorted(doc, np.arange(len(words) + 1))
                lists, kept = [], []
                for k, w in enumerate(words):
                    base = int(stop[k] - counts[k])
                    mine = found[bounds[k] : bounds[k + 1]].tolist()
                    lists.append([{"start": s - base, "length": e - s, "period": q} for s, e, q in mine])
                    if mine:
                        w = [v for v, g in zip(w, gone[base : int(stop[k])].tolist(), strict=True) if not g]
                    kept.append(b" ".join(w))
                yield pa.RecordBatch.from_arrays([b.column("d").slice(i, j - i), pa.array(counts, pa.int64()), pa.array(lists, _RUN), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(column(id_col).cast("long").alias("d"), text_or_empty(column(text_col)).alias("t"))
    return map_arrow(rows, run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
