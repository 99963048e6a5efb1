"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are compared as lower-cased words. An item of m words may
differ from a passage of a document by k = floor(m / 5) word edits (a similarity
of 0.8). Split into k + 1 pieces, one piece must occur there unchanged, so only
exact piece hits, found by an automaton over all pieces, are verified with
Myers' bit-parallel distance around the hit. Items are taken in blocks of a
bounded size, each against all documents, so what a task or the driver holds
doesn't grow with either table: where there are several blocks, the hits of one
are written before the next is read.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty, written

#: Bytes of item texts in one block.
BLOCK_BYTES = 8 << 20


def budget(words: int) -> int:
    return words // 5


def pieces(words: list[bytes], k: int) -> list[tuple[int, list[bytes]]]:
    """k + 1 runs of words, as even as may be, each with its first word's place."""
    m, out, at = len(words), [], 0
    for i in range(k + 1):
        n = m // (k + 1) + (i < m % (k + 1))
        out.append((at, words[at : at + n]))
        at += n
    return out


def myers(item: list[bytes], text: list[bytes], k: int) -> tuple[int, int] | None:
    """(distance, end) of the item's best approximate occurrence in text, the first of the best, within k; None beyond.

    Bit-parallel with words as symbols; Python's integers carry items of any length.
    """
    m = len(item)
    peq: dict[bytes, int] = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = mask, 0, m, None
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask  # row 0 stays 0: an occurrence starts anywhere
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def _matcher(items: list[tuple[int, str]]):
    import ahocorasick

    words = {i: t.lower().encode().split() for i, t in items}
    found: dict[str, list] = {}
    for i, w in words.items():
        if w:
            for at, piece in pieces(w, budget(len(w))):
                found.setdefault(" " + b" ".join(piece).decode() + " ", []).append((i, at, len(piece)))
    a = ahocorasick.Automaton()
    for piece, where in found.items():
        a.add_word(piece, where)
    if found:
        a.make_automaton()

    def match(text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, first word of the searched stretch's match end, words) for each item in the text."""
        if not found:
            return []
        w = text.lower().encode().split()
        flat = " " + b" ".join(w).decode() + " "
        spaces = [0, *accumulate(len(x.decode()) + 1 for x in w)]  # places of the spaces in flat
        spans: dict[int, set] = {}
        for end, where in a.iter(flat):
            # the hit's last character is the space behind its last word
            stop = bisect_left(spaces, end)
            for i, at, n in where:
                spans.setdefault(i, set()).add(stop - n - at)
        out = []
        for i, starts in spans.items():
            item, best = words[i], None
            k = budget(len(item))
            lo = hi = None
            for s in [*sorted(starts), None]:
                if s is not None and hi is not None and s - k <= hi:
                    hi = max(hi, s + len(item) + k)
                    continue
                if hi is not None:
                    b = max(0, lo)
                    got = myers(item, w[b : max(0, hi)], k)
                    if got and (best is None or got[0] < best[0]):
                        best = (got[0], b + got[1])
                if s is not None:
                    lo, hi = s - k, s + len(item) + k
            if best:
                out.append((i, best[0], best[1], len(item)))
        return out

    return match


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, end_word, item_words.

    end_word: words up to the match's end in the first of the closest places.
    Null and empty texts and items match nothing; rows with null ids are
    searched like others; repeated rows give a row each, repeated items one
    each; empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty("text").alias("text"))
    # equal items are searched once, however often they are there
    told = written(items.select("text").distinct().withColumn("n", F.monotonically_increasing_id()), "items")
    named = items.join(told, "text").select("n", "item_id")
    total, rows = told.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(1, -(-(total or 0) // BLOCK_BYTES), -(-(rows or 0) // 50_000))
    texts = docs.select(F.col(id_col).cast("long").alias("d"), text_or_empty(text_col).alias("t"))
    found = None
    for b in range(blocks):
        block = [(r.n, r.text) for r in told.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).collect()]

        def run(batches, block=block):
            match = _matcher([(n, t) for n, (_, t) in enumerate(block)])
            for batch in batches:
                rows = [(d, block[i][0], *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, *x in match(t)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["doc_id", "n", "distance", "end_word", "item_words"])

        part = map_arrow(texts, run, "doc_id long, n long, distance long, end_word long, item_words long")
        part = part if blocks == 1 else written(part, "hits")
        found = part if found is None else found.unionByName(part)
    return found.join(named, "n").select("doc_id", "item_id", "distance", "end_word", "item_words")
