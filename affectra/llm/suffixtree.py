"""LM scoring with a probabilistic suffix tree over words.

A symbol is a lower-cased word or the end of a text; a context is the last 1 to
`depth` words, across word ends. Every context that occurs `least` times in the
training texts, but less often than its suffix, is tried, so the tree grows with
the corpus; one as frequent as its suffix is followed by the same symbols, so
nothing can diverge there, nor is it made longer. A context is retained if its
next-symbol distribution diverges from its longest retained suffix's: by the
leave-one-out log-likelihood that it gains over the suffix in all its
occurrences, at least `gain`. Distributions are smoothed with the suffix's,
p(s | x) = (n(x, s) + prior * p(s | suffix)) / (n(x) + prior), down to the base,
and a token is scored by the longest retained suffix of what precedes it.

Texts are dealt to batches (see batches) once. A batch sends each distinct gram
(context and symbol, as a hash) with its count to the bucket of its leading bits
and gets the corpus's count back; gains of contexts follow them there, in the
order of the grams that the contexts are. Grams of a level are sent only where
the context of one word less occurred often enough.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import BASES, BATCH_BYTES, U, batched, buckets, expand, mix, pack, split, squeeze, unpack
from .common import id_crc, map_arrow, text_or_empty
from .substrings import slices, word_hashes

#: Words in a context; its least occurrences; least gain in natural log-likelihood; prior weight of the suffix.
DEPTH, LEAST, GAIN, PRIOR = 3, 2, 1.0, 2.0
#: Bits of a gram's hash beyond the logarithm of the corpus's tokens: of 2**SPARE grams one shares its count with another or so.
SPARE = 20
#: Gains travel in steps of 1 / STEP.
STEP = 256
#: The symbol behind a text's last word, and what words never hash to.
END = U(0x0123456789ABCDEF)
#: Bytes of text whose words a task counts at once for the corpus's totals, and distinct words it remembers before it hands them on.
SLICE, MEMORY = 6 << 20, 1 << 21

NAMES = ["k", "b", "n", "h", "v"]
MESSAGE = "k long, b int, n int, h binary, v binary"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, END behind each text, and the number of symbols of each."""
    w, counts = word_hashes([t.lower() for t in texts])
    at = np.cumsum(counts + 1) - 1
    out = np.empty(len(w) + len(counts), dtype=np.uint64)
    word = np.ones(len(out), dtype=bool)
    word[at] = False
    out[word], out[at] = w, END
    return out, counts + 1


def ordered(key: np.ndarray, width: int) -> np.ndarray:
    """An order that sorts keys of `width` bits: leading bits and places are sorted as one number, if those bits tell keys apart."""
    n = len(key)
    room = U(n.bit_length())
    lead = key << U(64 - width) >> room << room
    got = np.sort(lead | np.arange(n, dtype=np.uint64))
    order = (got & ((U(1) << room) - U(1))).astype(np.int64)
    k, same = key[order], got[1:] >> room == got[:-1] >> room
    return order if (k[1:][same] == k[:-1][same]).all() else np.argsort(key, kind="stable")


def _messages(b: int, kind: int, bits: int, width: int, key: np.ndarray, value: np.ndarray, keys: bool = True) -> list[tuple]:
    """Rows of MESSAGE of sorted distinct keys of `width` bits, bucket by bucket; without the keys where the bucket has them."""
    at, names = split(key << U(64 - width), bits)
    low = U((1 << width - bits) - 1)
    return [((kind << 32) + int(k), b, int(z - a), pack(np.diff(key[a:z] & low, prepend=U(0))) if keys else None, pack(value[a:z])) for k, a, z in zip(names, at[:-1], at[1:], strict=True)]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array(c, t) for n, c, t in zip(NAMES, zip(*rows, strict=True) if rows else [[]] * 5, _KINDS, strict=True)})


def _sign(x: np.ndarray) -> np.ndarray:
    """Whole numbers of either sign as natural ones, small ones staying small."""
    return np.where(x < 0, -2 * x - 1, 2 * x).astype(np.uint64)


def _unsign(x: np.ndarray) -> np.ndarray:
    half = (x >> U(1)).astype(np.int64)
    return np.where(x & U(1), -half - 1, half)


def _sum(rows: list[tuple], values: dict[int, np.ndarray], key: np.ndarray) -> list[np.ndarray]:
    """For each of a bucket's rows, the values of its keys summed over all rows."""
    order = ordered(key, 64)
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[order][1:] != key[order][:-1]
    value = np.concatenate([values.get(r[1], np.zeros(r[2], dtype=np.int64)) for r in rows])
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.add.reduceat(value[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return np.split(back, np.cumsum([r[2] for r in rows])[:-1])


def _rows(table: pa.Table) -> tuple[list[tuple], np.ndarray]:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in NAMES), strict=True), key=lambda r: r[:3])
    return rows, np.concatenate([np.cumsum(unpack(r[3], r[2]), dtype=np.uint64) for r in rows])


def counted(table: pa.Table) -> pa.Table:
    """What a bucket answers to grams: (b, k, n, v) with counts summed over batches, in the order of each batch."""
    rows, key = _rows(table)
    sums = _sum(rows, {r[1]: unpack(r[4], r[2]).astype(np.int64) for r in rows}, key)
    return _table([(r[0], r[1], r[2], None, pack(x.astype(np.uint64))) for r, x in zip(rows, sums, strict=True)])


def settled(gain: float):
    """What a bucket answers to a later send: to grams their counts; to gains of contexts, which are grams sent before (left), whether the sum is at least `gain`."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or right.column("h").null_count == 0:
            return counted(right) if right.num_rows else _table([])
        rows, key = _rows(left)
        gains = {b: _unsign(unpack(v, n)) for b, n, v in zip(*(right.column(c).to_pylist() for c in ("b", "n", "v")), strict=True)}
        kept = [(x >= round(gain * STEP)).astype(np.uint64) for x in _sum(rows, gains, key)]
        return _table([(r[0] + (3 << 32), r[1], r[2], None, pack(x)) for r, x in zip(rows, kept, strict=True)])

    return run


def totals(texts: DataFrame, bits: int) -> tuple[int, int]:
    """Tokens and distinct tokens of a table of texts (t); words are told apart by 64-bit hashes."""

    def run(batches):
        key, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def out():
            return _table(_messages(0, 0, bits, 64, key, n.astype(np.uint64))).to_batches()

        for b in batches:
            for i, j in slices(pc.binary_length(b.column(0)).to_pylist(), SLICE):
                k, m = np.unique(symbols([t.encode() for t in b.column(0).slice(i, j - i).to_pylist()])[0], return_counts=True)
                key, back = np.unique(np.concatenate([key, k]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([n, m])).astype(np.int64)
                if len(key) >= MEMORY:
                    yield from out()
                    key, n = key[:0], n[:0]
        yield from out()

    def count(table: pa.Table) -> pa.Table:
        rows, key = _rows(table)
        return pa.table({"n": [sum(int(unpack(r[4], r[2]).sum()) for r in rows)], "v": [len(np.unique(key))]})

    got = map_arrow(texts, run, MESSAGE).groupBy("k").applyInArrow(count, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(got[0] or 0), int(got[1] or 0)


class Level:
    """A batch's grams of one length: the distinct keys, and of each token the number of the gram that it ends; -1 where none is asked for."""

    def __init__(self, gram: np.ndarray, asked: np.ndarray, width: int):
        self.which = np.flatnonzero(asked)
        key = gram[self.which] >> U(64 - width)
        order = ordered(key, width)
        key = key[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        self.key, self.width = key[new], width
        self.of = np.full(len(gram), -1)
        self.of[self.which[order]] = np.cumsum(new) - 1

    def spread(self, values: np.ndarray) -> np.ndarray:
        """What each token's gram got; 0 where none was asked for."""
        return np.append(values, 0)[self.of].astype(values.dtype)


class Batch:
    """What a batch knows once it has the answers on the first `known` levels and on the gains of the first `tested`; nothing at -1."""

    def __init__(self, left: pa.Table, right: pa.Table | None, of: Model, known: int, tested: int):
        self.b, self.ids, texts, held = left.column("b")[0].as_py(), [], [], []
        for ids, kept_back, ends, z in zip(*(left.column(c).to_pylist() for c in ("d", "held", "ends", "z")), strict=True):
            blob = expand(z)
            self.ids += ids
            held += kept_back
            texts += [blob[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        self.held = np.array(held, dtype=bool)
        self.w, self.sizes = symbols(texts)
        self.taught = np.repeat(~self.held, self.sizes)
        self.place = np.arange(len(self.w)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        answers: dict[int, list] = {}
        if right is not None:
            for k, n, v in sorted(zip(*(right.column(c).to_pylist() for c in ("k", "n", "v")), strict=True)):
                answers.setdefault(k >> 32, []).append(unpack(v, n))
        none = [np.zeros(0, dtype=np.uint64)]
        self.gram, self.levels, self.n = [self.w], [], []
        # where the context of each level before a token is tried, and where it is retained
        self.tried, self.retained = [np.zeros(0, dtype=bool)], [np.zeros(0, dtype=bool)]
        for k in range(known + 1):
            self.levels.append(self._level(of, k))
            self.n.append(self.levels[k].spread(np.concatenate(answers.get(2 * k, none)).astype(np.int64)))
            ok = self.place > k
            ok[1:] &= self.n[k][:-1] >= of.least
            if k:  # a context that is there as often as its suffix is followed by the same: nothing can diverge
                ok[1:] &= self.n[k][:-1] < self.n[k - 1][:-1]
            self.tried.append(ok)
        for k in range(1, tested + 1):
            flag = self.levels[k - 1].spread(np.concatenate(answers.get(2 * k + 1, none)))
            got = self.tried[k].copy()
            got[1:] &= flag[:-1] > 0
            self.retained.append(got)

    def _level(self, of: Model, k: int) -> Level:
        """Grams of level k: all of a word and of two, and those behind contexts that occur often enough."""
        while len(self.gram) <= k:
            longer = self.gram[-1].copy()
            longer[len(self.gram) :] = mix(longer[len(self.gram) :] * U(BASES[1]) + self.w[: -len(self.gram)])
            self.gram.append(longer)
        return Level(self.gram[k], self.tried[k] if k > 1 else self.place >= k, of.width if k else 64)

    def chances(self, of: Model, depth: int, without: bool) -> np.ndarray:
        """Probability of each token by its longest retained context of at most `depth` words; without: its own occurrence is left out of the counts."""
        one = int(without)
        p = (np.maximum(self.n[0] - one, 0) + 0.1) / (of.tokens - one + 0.1 * (of.kinds + 1))
        for k in range(1, depth + 1):
            p = np.where(self.retained[k], self.follow(of, k, p, one), p)
        return p

    def follow(self, of: Model, k: int, p: np.ndarray, one: int) -> np.ndarray:
        before = np.concatenate([[0], self.n[k - 1][:-1]])
        return (np.maximum(self.n[k] - one, 0) + of.prior * p) / (np.maximum(before - one, 0) + of.prior)

    def counts(self, of: Model, k: int) -> list[tuple]:
        """Messages that ask for level k."""
        level = self._level(of, k)
        n = np.bincount(level.of[level.which], weights=self.taught[level.which], minlength=len(level.key)).astype(np.uint64)
        return _messages(self.b, 2 * k, of.bits, level.width, level.key, n)

    def gains(self, of: Model, k: int) -> list[tuple]:
        """Messages with what level k's contexts gain over their suffixes here; such a context is a gram of level k - 1."""
        level, ok = self.levels[k - 1], np.flatnonzero(self.tried[k] & self.taught)
        p = self.chances(of, k - 1, True)
        g = np.bincount(level.of[ok - 1], weights=np.log(self.follow(of, k, p, 1)[ok] / p[ok]), minlength=len(level.key))
        return _messages(self.b, 2 * k - 2, of.bits, level.width, level.key, _sign(np.rint(g * STEP).astype(np.int64)), keys=False)


def bundled(parts: DataFrame) -> DataFrame:
    """(b, d ids, held, ends, z): texts of one batch that a task reads together, end to end and compressed."""

    def run(batches):
        for t in batches:
            where: dict[int, list[int]] = {}
            for i, b in enumerate(t.column(0).to_pylist()):
                where.setdefault(b, []).append(i)
            rows = []
            for b, i in where.items():
                of = t.take(pa.array(i))
                texts = [x.encode() for x in of.column(2).to_pylist()]
                rows.append((b, of.column(1).to_pylist(), of.column(3).to_pylist(), np.cumsum([len(x) for x in texts]).tolist(), squeeze(b"".join(texts))))
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["b", "d", "held", "ends", "z"])

    return map_arrow(parts.select("b", "d", "t", "held"), run, "b int, d array<long>, held array<boolean>, ends array<long>, z binary")


class Model:
    """Parameters and the corpus's totals, the same in all tasks."""

    def __init__(self, depth: int, least: int, prior: float, tokens: int, kinds: int, bits: int):
        self.depth, self.least, self.prior, self.tokens, self.kinds, self.bits = depth, least, prior, tokens, kinds, bits
        self.width = min(64, max(1, tokens).bit_length() + SPARE)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = LEAST, gain: float = GAIN, prior: float = PRIOR) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents that aren't held out (by default every tenth by crc32
    of the id is). base_score is the smoothed unigram log10 probability, score
    the tree's, whose empty context is the base: words that never occur in
    training are one symbol in both. depth is 1 at least. Null and empty texts
    are the end token alone; null ids are training rows; repeated rows count
    each time and keep a row each. An empty table gives no rows; other columns
    aren't carried, whatever their names.
    """
    held = F.coalesce(held_out if held_out is not None else id_crc(id_col) % 10 == 0, F.lit(False))
    parts, size = batched(docs, id_col, text_col, {"held": held})
    bits, n = buckets(size // 6), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (8 * BATCH_BYTES))
    tokens, kinds = totals(docs.where(~held).select(text_or_empty(text_col).alias("t")), bits)
    of = Model(depth, least, prior, tokens, kinds, bits)
    parts = bundled(parts).repartition(n, "b")  # dealt once for all the exchanges below
    sent = [parts.groupBy("b").applyInArrow(lambda t: _table((x := Batch(t, None, of, -1, 0)).counts(of, 0) + x.counts(of, 1)), MESSAGE).repartition(n, "k")]
    answers = [sent[0].groupBy("k").applyInArrow(counted, MESSAGE).select("b", "k", "n", "v").repartition(n, "b")]

    def ask(k: int):
        """Sends the grams of level k + 1 and the gains of level k."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _table([])
            x = Batch(left, right, of, k, k - 1)
            return _table((x.counts(of, k + 1) if k < depth else []) + x.gains(of, k))

        return run

    for k in range(1, depth + 1):
        known = reduce(DataFrame.unionByName, answers)
        sent.append(parts.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(ask(k), MESSAGE).repartition(n, "k"))
        before = sent[max(0, k - 2)]  # which has the grams that are level k's contexts
        answers.append(before.groupBy("k").cogroup(sent[k].groupBy("k")).applyInArrow(settled(gain), MESSAGE).select("b", "k", "n", "v").repartition(n, "b"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, **{c: pa.array([], pa.float64()) for c in ("base_score", "score")}})
        x = Batch(left, right, of, depth, depth)
        n = len(x.ids)
        base = np.log10((x.n[0] + 0.1) / (tokens + 0.1 * (kinds + 1)))
        score = np.log10(x.chances(of, depth, False))
        first = np.cumsum(x.sizes) - x.sizes  # no text is without symbols
        return pa.table({"doc_id": pa.array(x.ids, pa.int64()), "held_out": pa.array(x.held.tolist(), pa.bool_()), "n_tokens": pa.array(x.sizes.astype(np.int64)), "n_known": pa.array(np.add.reduceat((x.n[0] > 0).astype(np.int64), first)), "train_tokens": pa.array(np.full(n, tokens, dtype=np.int64)), "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(score, first)})

    known = reduce(DataFrame.unionByName, answers)
    return parts.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(run, RESULT)
