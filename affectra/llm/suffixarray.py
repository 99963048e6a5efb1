"""Suffix-array dedup: strings of `length` bytes that a document of smaller id has.

Only what can match is sorted. In every window of `length` bytes the smallest
hash of its GRAM-byte grams is the window's anchor; equal windows have equal
anchors, so a window can only match windows of anchors that occur again.
Anchors are counted between batches (see batches). The stretches of text around
repeated anchors, each distinct one once a batch, go to the bucket of their
anchor; around an anchor that is there very often they are parted, and the bytes
beside the anchor choose the bucket too. There their suffixes are sorted to full depth, with the common prefix of
each two neighbours, and previous and next smaller ids in suffix order give the
longest previous factor of each suffix: the longer of the prefixes that it
shares with the nearest suffixes above and below it whose document has a smaller
id. A window goes if that is `length` at least. Answers are bits of windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import BASES, BYTES, U, answer, batched, begins, buckets, expand, flagged, mix, pack, powers, rolling, rows_of, send, split, squeeze, unpack

#: Bytes in an anchor's gram, and bytes of stretches in a bucket, on average.
GRAM, BUCKET_BYTES = 24, 1 << 19
#: Bytes hashed at once; windows in a stretch at most, as bits of a number; suffixes sorted at once.
CHUNK, WINDOWS, SORTED = 1 << 18, 56, 1 << 18


def _windows_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def ids_in_order(ids: list) -> np.ndarray:
    """Ids as unsigned numbers in the same order; null is the smallest."""
    return np.array([0 if d is None else d + (1 << 63) for d in ids], dtype=np.uint64)


#: Places in the corpus from which on an anchor's windows are told apart by what else they hold; neighbouring windows that stay together then; stretches parted at once.
OFTEN, TOGETHER, PARTED = 4096, 2, 1 << 15


class Stretches:
    """Neighbouring windows of one anchor in a batch's texts, in order: anchor, first window, number of windows, id, hash of the content; and the joined bytes."""

    def __init__(self, ids: list, texts: list[bytes], length: int, contents: bool = True):
        gram = min(GRAM, length)
        ends = np.cumsum([len(t) for t in texts])
        ids_ = ids_in_order(ids)
        self.bytes, self.length = np.frombuffer(b"".join(texts), dtype=np.uint8), length
        parts: list[list] = [[], [], [], [], []]
        for c in range(0, max(0, len(self.bytes) - length + 1), CHUNK):
            a = self.bytes[c : c + CHUNK + length - 1]
            least = _windows_min(mix(rolling(BYTES[a], gram, BASES[0])), length - gram + 1)
            share = np.diff(np.clip(ends, c, c + len(least)), prepend=c)  # of each text
            doc = np.repeat(np.arange(len(ends)), share)
            ok = np.flatnonzero(np.repeat(ends - c, share) - np.arange(len(least)) >= length)
            if not len(ok):
                continue
            new = np.ones(len(ok), dtype=bool)
            value = least[ok]
            new[1:] = (value[1:] != value[:-1]) | (ok[1:] != ok[:-1] + 1)  # places of two texts aren't neighbours
            place = np.arange(len(ok))
            new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % WINDOWS == 0  # one gram over and over
            first = np.flatnonzero(new)
            begin, windows = ok[first], np.diff(np.append(first, len(ok)))
            content = np.zeros(0, dtype=np.uint64)
            if contents:
                sums = np.zeros(len(a) + 1, dtype=np.uint64)
                np.cumsum(BYTES[a] * powers(BASES[1], len(a)), out=sums[1:], dtype=np.uint64)
                size = windows + length - 1
                content = mix((sums[begin + size] - sums[begin]) * powers(BASES[1], len(a), True)[begin] + size.astype(np.uint64))
            # smallest hashes crowd near zero: mixed again, they part evenly into buckets
            for p, x in zip(parts, (mix(~least[begin]), c + begin, windows, ids_[doc[begin]], content), strict=True):
                p.append(x)
        none = np.zeros(0, dtype=np.int64)
        self.h, self.id, self.content = (np.concatenate(parts[i] or [none.astype(np.uint64)]) for i in (0, 3, 4))
        self.start, self.windows = (np.concatenate(parts[i] or [none]) for i in (1, 2))

    def pieces(self, which: np.ndarray) -> tuple[Stretches, np.ndarray, np.ndarray]:
        """Stretches parted into TOGETHER windows each, in order of place: the pieces, and for each which stretch (its place in `which`) it is of and its first window there.

        Windows stay together by their distance from the anchor; what all of them
        hold around it makes the key, which equal windows share. So one key holds
        no more contexts than differ in the bytes that it leaves out.
        """
        gram, parts = min(GRAM, self.length), []
        step = self.length - gram
        n = len(self.bytes) if len(which) else 0
        sums, unit = np.zeros(n + 1, dtype=np.uint64), powers(BASES[0], n + 1, True)
        np.cumsum(BYTES[self.bytes[:n]] * powers(BASES[0], n), out=sums[1:], dtype=np.uint64)
        code = lambda i, size: (sums[i + size] - sums[i]) * unit[i]
        for c in range(0, len(which), PARTED):
            f = which[c : c + PARTED]
            size = self.windows[f] + step  # grams of a stretch
            of = np.repeat(np.arange(len(f)), size)
            at = np.repeat(self.start[f] - np.cumsum(size) + size, size) + np.arange(size.sum())
            g = mix(code(at, gram))
            least = np.minimum.reduceat(g, np.cumsum(size) - size)
            anchor = np.flatnonzero(g == least[of])
            w = self.windows[f]
            own = np.repeat(np.arange(len(f)), w)
            inside = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            begin = self.start[f][own] + inside
            # the first anchor from a window's beginning on, found by its place among the stretches' grams
            place = (np.cumsum(size) - size)[own] + inside
            pos = at[anchor[np.searchsorted(anchor, place)]]
            near = (pos - begin) // TOGETHER * TOGETHER
            far = np.minimum(near + TOGETHER - 1, step)
            key = mix(code(pos - near, near + self.length - far) + near.astype(np.uint64))
            new = np.ones(len(own), dtype=bool)
            new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
            first = np.flatnonzero(new)
            windows = np.diff(np.append(first, len(own)))
            long = windows + self.length - 1
            parts.append((key[first], self.id[f][own[first]], mix(code(begin[first], long) + long.astype(np.uint64)), begin[first], windows, c + own[first], inside[first]))
        got = object.__new__(Stretches)
        got.bytes, got.length = self.bytes, self.length
        kinds = (np.uint64, np.uint64, np.uint64, *[np.int64] * 4)
        joined = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=k) for i, k in enumerate(kinds)]
        order = np.argsort(joined[3], kind="stable")  # in order of ids
        got.h, got.id, got.content, got.start, got.windows, owner, offset = (x[order] for x in joined)
        return got, owner, offset

    def distinct(self, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the stretches marked `again`: their places, sorted by anchor, content and text; which are the first of equal ones; and each one's first."""
        which = np.flatnonzero(again)
        which = which[np.lexsort((which, self.content[which], self.h[which]))]
        same = (self.content[which][1:] == self.content[which][:-1]) & (self.h[which][1:] == self.h[which][:-1]) & (self.windows[which][1:] == self.windows[which][:-1])
        new = np.ones(len(which), dtype=bool)
        pair = np.flatnonzero(same)
        left, right, size = self.start[which[pair]], self.start[which[pair + 1]], self.windows[which[pair]] + self.length - 1
        padded = words(self.bytes)
        for k in range(0, int(size.max(initial=0)), 8):  # hashes only say what to compare
            same[pair] &= cut(padded[left + k], size - k) == cut(padded[right + k], size - k)
        new[1:] = ~same
        return which, new, np.cumsum(new) - 1


class Travelling:
    """What a batch sends of its stretches marked `again`, sorted by key: each distinct one, or, around an anchor that is there often, each distinct piece of it."""

    def __init__(self, s: Stretches, again: np.ndarray, often: np.ndarray):
        self.all = s
        self.which, new, self.group = s.distinct(again)
        self.first = self.which[new]
        self.parted = often[self.first]
        whole = self.first[~self.parted]
        self.pieces, owner, self.offset = s.pieces(self.first[self.parted])
        self.owner = np.flatnonzero(self.parted)[owner]
        self.piece, new, self.piece_group = self.pieces.distinct(np.ones(len(owner), dtype=bool))
        self.piece_first = self.piece[new]
        both = lambda name: np.concatenate([getattr(s, name)[whole], getattr(self.pieces, name)[self.piece_first]])
        self.order = np.argsort(both("h"), kind="stable")
        self.h, self.start, self.windows, self.id = (both(name)[self.order] for name in ("h", "start", "windows", "id"))

    def spread(self, mask: np.ndarray) -> np.ndarray:
        """Bits of the windows that go, of every stretch in `which`, from those of what was sent; a text of smaller id in the batch has all of what it shares."""
        sent = np.empty_like(mask)
        sent[self.order] = mask
        n = int((~self.parted).sum())
        own = np.zeros(len(self.first), dtype=np.uint64)
        own[~self.parted] = sent[:n]
        p = self.pieces
        part = sent[n:][self.piece_group]
        part[p.id[self.piece] > p.id[self.piece_first][self.piece_group]] = ~U(0)
        part &= (U(1) << p.windows[self.piece].astype(np.uint64)) - U(1)
        np.bitwise_or.at(own, self.owner[self.piece], part << self.offset[self.piece].astype(np.uint64))
        every = own[self.group]
        every[self.all.id[self.which] > self.all.id[self.first][self.group]] = ~U(0)
        return every


def words(blob: np.ndarray) -> np.ndarray:
    """At each place the 8 bytes from there on as a number, those first that come first; zeros behind the end."""
    padded = np.concatenate([blob, np.zeros(WINDOWS + 256, dtype=np.uint8)])
    return np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))


def cut(word: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Words of which only the first `left` bytes count."""
    keep = np.clip(left, 0, 8).astype(np.uint64)
    return np.where(keep > 0, word.astype(np.uint64) >> (U(8) * (U(8) - np.maximum(keep, U(1)))) << (U(8) * (U(8) - np.maximum(keep, U(1)))), U(0))


def suffix_order(blob: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of `size` bytes from each start, and of each two neighbours in it the common prefix (0 for the first)."""
    padded, n = words(blob).astype(np.uint64), len(start)
    order, tied, group = np.arange(n), np.arange(n), np.zeros(n, dtype=np.uint64)
    room = max(1, n.bit_length())
    step = (64 - room) // 8
    for k in range(0, int(size.max(initial=0)), step):  # places that are tied so far: their group and the next bytes in one number
        tied, group = _parted(order, tied, group << U(64 - room), lambda o, k=k: cut(padded[start[o] + k], np.minimum(size[o] - k, step)) >> U(room))
        if not len(tied):
            break
    _parted(order, tied, group << U(64 - room), lambda o: size[o].astype(np.uint64))
    lcp, going = np.zeros(n, dtype=np.int64), np.arange(1, n)
    least = np.minimum(size[order][1:], size[order][:-1])
    for k in range(0, int(size.max(initial=0)), 8):
        differ = padded[start[order[going]] + k] ^ padded[start[order[going - 1]] + k]
        stop = (differ != 0) | (least[going - 1] <= k + 8)
        differ = differ[stop]
        lcp[going[stop]] = k + sum((differ < U(1 << bits)).astype(np.int64) for bits in range(0, 64, 8))  # leading bytes
        going = going[~stop]
    lcp[1:] = np.minimum(lcp[1:], least)
    return order, lcp


def _parted(order: np.ndarray, tied: np.ndarray, group: np.ndarray, key) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the tied places of order, in place, by group and key, which share no bit; the places that are tied still, and their groups."""
    of = order[tied]
    both = group | key(of)
    by = np.argsort(both)
    order[tied], both = of[by], both[by]
    same = both[1:] == both[:-1]
    still = np.append(same, False)
    still[1:] |= same
    number = np.cumsum(np.append(True, ~same))[: len(tied)]
    return tied[still[: len(tied)]], (number[still[: len(tied)]] - 1).astype(np.uint64)


def longest_previous(lcp: np.ndarray, value: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factors, in suffix order: the longest prefix shared with a suffix of smaller value; 0 where it is below `least`.

    Of the suffixes with smaller values the nearest above and the nearest below
    share most. Places leap all at once over values that aren't smaller, as far
    as those have leapt, with the least common prefix on the way.
    """
    best = np.zeros(len(lcp), dtype=np.int64)
    for flip in (False, True):
        v = value[::-1] if flip else value
        shared = np.append(lcp[1:], 0)[::-1].copy() if flip else lcp.copy()
        before = np.arange(len(v)) - 1
        open_ = np.flatnonzero((before >= 0) & (shared >= least))
        while len(open_):
            open_ = open_[v[before[open_]] >= v[open_]]
            by = before[open_]
            ahead, least_shared = before[by], np.minimum(shared[open_], shared[by])
            before[open_], shared[open_] = ahead, np.where(ahead >= 0, least_shared, 0)
            open_ = open_[(ahead >= 0) & (least_shared >= least)]
        got = np.where((before >= 0) & (shared >= least), shared, 0)
        best = np.maximum(best, got[::-1] if flip else got)
    return best


def repeated(blob: np.ndarray, begin: np.ndarray, windows: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each stretch the bits of its windows whose longest previous factor is `length` at least.

    Suffixes that begin alike are sorted in one pass; a pass takes SORTED of them or so.
    """
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    start, size = np.repeat(begin, windows) + inside, np.repeat(windows + length - 1, windows) - inside
    value, hit = np.repeat(ids, windows), np.zeros(len(start), dtype=bool)
    passes = 1 + len(start) // SORTED
    turn = mix(words(blob)[start].astype(np.uint64)) % U(passes)
    for i in range(passes):
        at = np.flatnonzero(turn == U(i))
        if len(at):
            order, lcp = suffix_order(blob, start[at], size[at])
            hit[at[order]] = longest_previous(lcp, value[at][order], length) >= length
    return np.bitwise_or.reduceat(hit.astype(np.uint64) << inside.astype(np.uint64), np.cumsum(windows) - windows)


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"


def remove_earlier_strings(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept (the other bytes).

    A byte goes if a string of `length` bytes that covers it also starts in a
    document of smaller id. Rows without id come before all others; rows of
    equal id, or without, take nothing from one another. length is from 25 to
    255. Null text is empty; repeated rows keep a row each. An empty table gives
    no rows; other columns aren't carried, whatever their names.
    """
    parts, total = batched(docs, id_col, text_col)
    often = OFTEN
    bits, wide = buckets(total // 14), max(0, int(np.ceil(np.log2(max(1, total // 2 / BUCKET_BYTES)))))

    def hashes(ids, texts):
        h = Stretches(ids, texts, length, contents=False).h
        return h, (mix(h ^ U(BASES[2])) >> U(32)).astype(np.uint32)

    known = answer(send(parts, hashes, bits, counted=True), later_only=False, often=often).select(F.lit(0).alias("kind"), "b", "k", "p", "q")

    def marked(table: pa.Table, answers: pa.Table) -> tuple[list, list[bytes], Travelling]:
        ids, texts = rows_of(table)
        s = Stretches(ids, texts, length)
        hit, _ = flagged(s.h, bits, answers)
        order = np.argsort(s.h, kind="stable")
        same = s.h[order][1:] == s.h[order][:-1]
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        return ids, texts, Travelling(s, hit, flagged(s.h, bits, answers, "q")[0])

    def stretch(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["k", "b", "low", "ids", "windows", "data"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})
        _, _, t = marked(left, right)
        rows = []
        at, names_ = split(t.h, wide)
        for k, a, z in zip(names_.tolist(), at[:-1], at[1:], strict=True):
            size, low = t.windows[a:z] + length - 1, t.id[a:z].min()
            index = np.repeat(t.start[a:z] - np.cumsum(size) + size, size) + np.arange(size.sum())
            rows.append((k, left.column("b")[0].as_py(), int(low.view(np.int64)), pack(t.id[a:z] - low), squeeze(t.windows[a:z].astype(np.uint8).tobytes()), squeeze(t.all.bytes[index].tobytes())))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)})

    def resolve(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("b", "low", "ids", "windows", "data")), strict=True))
        w = [np.frombuffer(expand(r[3]), dtype=np.uint8).astype(np.int64) for r in rows]
        ids = np.concatenate([unpack(r[2], len(x)) + np.array([r[1]]).view(np.uint64) for r, x in zip(rows, w, strict=True)])
        windows = np.concatenate(w)
        size = windows + length - 1
        begin = np.cumsum(size) - size
        blob = np.frombuffer(b"".join(expand(r[4]) for r in rows), dtype=np.uint8)
        # of equal stretches the one of the smallest id is sorted; larger ids have every window earlier
        order, lcp = suffix_order(blob, begin, size)
        new = np.ones(len(order), dtype=bool)
        new[1:] = (lcp[1:] < size[order][1:]) | (size[order][1:] != size[order][:-1])
        of = np.empty(len(order), dtype=np.int64)
        of[order] = np.cumsum(new) - 1
        by_id = np.lexsort((ids, of))
        first = by_id[np.flatnonzero(np.diff(of[by_id], prepend=-1))]
        mask = repeated(blob, begin[first], windows[first], ids[first], length)[of]
        mask = np.where(ids > ids[first][of], (U(1) << windows.astype(np.uint64)) - U(1), mask)
        out, at, k = [], 0, table.column("k")[0].as_py()
        for (b, *_), x in zip(rows, w, strict=True):
            m = mask[at : at + len(x)]
            at += len(x)
            p = np.flatnonzero(m)
            if len(p):
                out.append((b, m[p].tobytes() + p.astype(np.uint32).tobytes()))
        return pa.table({"kind": pa.array([1] * len(out), pa.int32()), "b": pa.array([x[0] for x in out], pa.int32()), "k": pa.array([k] * len(out), pa.int32()), "p": pa.array([x[1] for x in out], pa.binary()), "q": pa.array([None] * len(out), pa.binary())})

    sent = parts.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(stretch, "k int, b int, low long, ids binary, windows binary, data binary")
    resolved = sent.groupBy("k").applyInArrow(resolve, "kind int, b int, k int, p binary, q binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = np.array(right.column("kind").to_pylist(), dtype=np.int64)
        ids, texts, travelling = marked(left, right.filter(pa.array(kind == 0)))
        mask = np.zeros(len(travelling.h), dtype=np.uint64)
        got = right.filter(pa.array(kind == 1))
        for at, p in zip(begins(travelling.h, wide, got.column("k").to_pylist()).tolist(), got.column("p").to_pylist(), strict=True):
            n = len(p) // 12
            mask[at + np.frombuffer(p, dtype=np.uint32, offset=8 * n).astype(np.int64)] = np.frombuffer(p, dtype=np.uint64, count=n)
        s, which, every = travelling.all, travelling.which, travelling.spread(mask)
        w, begin = s.windows[which], s.start[which]
        cover = np.zeros(len(s.bytes) + 1, dtype=np.int32)
        whole = every & (U(1) << w.astype(np.uint64)) - U(1) == (U(1) << w.astype(np.uint64)) - U(1)
        np.add.at(cover, begin[whole], 1)  # all its windows: one run
        np.add.at(cover, begin[whole] + w[whole] + length - 1, -1)
        for i in range(WINDOWS):
            some = ~whole & (i < w) & (every >> U(i) & U(1)).astype(bool)
            np.add.at(cover, begin[some] + i, 1)
            np.add.at(cover, begin[some] + i + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        out: list[list] = [[], [], [], []]
        at = 0
        for t in texts:
            g = gone[at : at + len(t)]
            at += len(t)
            turn = np.flatnonzero(np.diff(g, prepend=False, append=False)).tolist() if g.any() else []
            cuts = [0, *turn, len(t)]
            for o, x in zip(out, (len(t), int(g.sum()), [{"start": a, "stop": z} for a, z in zip(turn[::2], turn[1::2], strict=True)], b"".join(t[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True))), strict=True):
                o.append(x)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "spans": pa.array(out[2], span), "kept": pa.array(out[3], pa.binary())})

    return parts.groupBy("b").cogroup(known.unionByName(resolved).groupBy("b")).applyInArrow(run, RESULT)
