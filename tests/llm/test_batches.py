"""Batches and their exchange: places by bisection, buckets that hold something, many small batches."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from affectra.llm import batches as B
from affectra.llm import suffixarray as A
from affectra.llm.substrings import remove_repeated_windows
from affectra.llm.suffixarray import remove_earlier_strings
from affectra.llm.suffixtree import score_texts


def test_cuts_are_found_by_bisection():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = int(r.integers(0, 30))
        some = {(None if r.random() < 0.2 else int(r.integers(-5, 5)) * (1 << 58), int(r.integers(-3, 3))) for _ in range(n)}
        cuts = [(d, h, b) for b, (d, h) in enumerate(sorted(some, key=lambda c: (c[0] is not None, c[0] or 0, c[1])), 1)]
        rows = [(None if r.random() < 0.2 else int(r.integers(-6, 6)) * (1 << 58) + int(r.integers(-1, 2)), int(r.integers(-4, 4))) for _ in range(200)]
        order = lambda c: (c[0] is not None, c[0] or 0, c[1])
        want = [max([b for d, h, b in cuts if order((d, h)) <= order(row)], default=0) for row in rows]
        got = B.Cuts(cuts).batch(np.array([d or 0 for d, _ in rows]), np.array([d is None for d, _ in rows]), np.array([h for _, h in rows]))
        assert got.tolist() == want


def test_only_buckets_that_hold_something_are_walked():
    h = np.sort(np.random.default_rng(2).integers(0, 1 << 64, 1_000_000, dtype=np.uint64))
    took = {}
    for bits in (0, 1, 12, 20, 40):
        began = time.perf_counter()
        at, names = B.split(h, bits)
        took[bits] = time.perf_counter() - began
        assert at[0] == 0 and at[-1] == len(h) and (np.diff(at) > 0).all() and len(names) == len(at) - 1
        assert np.array_equal(B.begins(h, bits, names.tolist()), at[:-1])
        assert bits == 0 or np.array_equal(np.repeat(names, np.diff(at)).astype(np.uint64), h >> np.uint64(64 - bits))
    assert took[40] < 20 * took[12] + 0.5
    at, names = B.split(h[:0], 7)
    assert at.tolist() == [0] and not len(names)


@pytest.mark.parametrize("bits", [None, 9])
def test_many_small_batches_and_buckets_change_nothing(spark, monkeypatch, bits):
    words = [f"w{i * i % 97}" for i in range(400)]
    rows = [(i // 2 if i % 50 else None, " ".join(words[i % 60 : i % 60 + 10 + i % 31])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    runs = {
        "windows": lambda: remove_repeated_windows(docs, 5).select("doc_id", "n_removed", "kept"),
        "strings": lambda: remove_earlier_strings(docs).select("doc_id", "n_removed", F.hex("kept").alias("kept")),
        "tree": lambda: score_texts(docs, depth=3).select("doc_id", "n_tokens", F.round("score", 6).alias("kept")),
    }
    want = {k: sorted(map(str, f().collect())) for k, f in runs.items()}
    monkeypatch.setattr(B, "BATCH_BYTES", 300)
    if bits:
        for module in ("batches", "substrings", "suffixarray", "suffixtree"):
            monkeypatch.setattr(f"affectra.llm.{module}.buckets", lambda n: bits)
    parts, _ = B.batched(docs)
    assert parts.select("b").distinct().count() > 150
    for k, f in runs.items():
        got = sorted(map(str, f().collect()))
        assert [g.split(", n_")[0] for g in got] == [g.split(", n_")[0] for g in want[k]]
        if k != "tree":  # gains are summed in another order between batches, at 1 / 256 of a nat
            assert got == want[k], k


def test_a_plan_for_thousands_of_batches_is_small(spark):
    cuts = [(i, 0, i) for i in range(5000)]
    began = time.perf_counter()
    got = spark.range(10_000).select(F.col("id").alias("d"), F.lit(0).cast("long").alias("h")).withColumn("b", B._place(cuts))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert time.perf_counter() - began < 5 and len(plan) < 5000
    assert got.where("b <> least(d, 4999)").count() == 0


def test_a_text_larger_than_a_batch(spark):
    """Seven megabytes in one row, beside a copy of its middle."""
    import hashlib

    from affectra.llm import fillmiddle, gifmedia, periods

    words = [f"word{i * i % 1_000_003}" for i in range(600_000)]
    text = " ".join(words)
    middle = " ".join(words[300_000:300_500])
    assert len(text) > B.BATCH_BYTES
    docs = spark.createDataFrame([(1, text), (2, "so " + middle), (3, None)], "doc_id long, text string")
    windows = {r.doc_id: r for r in remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed").collect()}
    assert windows[1].n_words == 600_000 and (windows[2].n_words, windows[2].n_removed) == (501, 500) and windows[3].n_words == 0
    strings = {r.doc_id: r for r in remove_earlier_strings(docs).select("doc_id", "n_bytes", "n_removed").collect()}
    assert strings[1].n_removed == 0 and strings[2].n_bytes - strings[2].n_removed == 3 - (text[text.index(middle) - 1] == " ")
    scored = {r.doc_id: r for r in score_texts(docs).collect()}
    assert scored[1].n_tokens == 600_001 and scored[3].n_tokens == 1 and all(r.score < 0 for r in scored.values())
    cut = fillmiddle.fill_in_middle(docs).withColumn("again", fillmiddle.restored(F.col("output"), F.col("form"))).select("doc_id", F.sha2(F.col("again").cast("binary"), 256).alias("s")).collect()
    assert {r.doc_id: r.s for r in cut}[1] == hashlib.sha256(text.encode()).hexdigest()
    runs = {r.doc_id: r for r in periods.periodic_runs(docs).select("doc_id", "n_words", F.sha2(F.col("collapsed").cast("binary"), 256).alias("s"), "runs").collect()}
    assert runs[1].n_words == 600_000 and (runs[1].runs or runs[1].s == hashlib.sha256(text.encode()).hexdigest())
    media = {r.doc_id: r for r in gifmedia.digests(gifmedia.stored(docs)).collect()}
    payload = text.encode() + bytes(-len(text.encode()) % 64)
    assert media[1].payload_sha256 == hashlib.sha256(payload).hexdigest()


def test_items_that_repeat_are_searched_once(spark, monkeypatch):
    from affectra.llm import decontaminate as dec

    monkeypatch.setattr(dec, "BLOCK_BYTES", 2000)
    items = [(i, "one two three four five six seven eight nine ten") for i in range(500)] + [(900, "a b c d e f g"), (900, "a b c d e f g")]
    docs = spark.createDataFrame([(7, "zero one two three four five six seven eight nine ten eleven"), (8, "nothing"), (9, "x a b c d e f g y")], "doc_id long, text string")
    got = dec.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    rows = got.collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == sorted([(7, i) for i in range(500)] + [(9, 900)] * 2)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize(("length", "often"), [(50, 1), (50, 3), (26, 1), (25, 2), (120, 1)])
def test_parted_anchors_change_nothing(spark, monkeypatch, length, often):
    from affectra.llm import suffixarray as sa

    r = np.random.default_rng(length)
    line = "a line that is there in ever new contexts, and is longer than fifty bytes"
    texts = [" ".join(f"{int(r.integers(0, 9999))}" for _ in range(int(r.integers(1, 40)))) + line * int(r.integers(0, 3)) + "".join("xyz"[int(k)] for k in r.integers(0, 3, int(r.integers(0, 90)))) for _ in range(150)]
    texts += ["z" * 400, "ab" * 200, "z" * 90 + line, None, "", *texts[:9], texts[3][5:] + texts[4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(B, "BATCH_BYTES", 2500)
    want = sorted(map(str, remove_earlier_strings(docs, length).collect()))
    monkeypatch.setattr(sa, "OFTEN", often)
    monkeypatch.setattr(sa, "PARTED", 7)
    assert sorted(map(str, remove_earlier_strings(docs, length).collect())) == want
    # and by brute force
    seen, removed = {}, {}
    for d, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen.setdefault(b[i : i + length], d) < d:
                gone[i : i + length] = True
        removed[d] = int(gone.sum())
    assert {x.doc_id: x.n_removed for x in remove_earlier_strings(docs, length).collect()} == removed


def test_one_line_in_many_contexts_is_dealt_to_many_buckets():
    """What one key holds, in bytes, of a line in 20,000 contexts: nearly all of its anchors' windows before, little after."""
    from affectra.llm import suffixarray as sa

    r = np.random.default_rng(1)
    line = b" this very line stands in twenty thousand places "
    texts = [r.integers(97, 123, 60, dtype=np.uint8).tobytes() + line + r.integers(97, 123, 60, dtype=np.uint8).tobytes() for _ in range(20_000)]
    s = sa.Stretches(list(range(len(texts))), texts, 50)
    key, n = np.unique(s.h, return_counts=True)
    again = np.isin(s.h, key[n > 1])

    def largest(t):
        size = (t.windows + 49).astype(np.float64)
        _, of = np.unique(t.h, return_inverse=True)
        return np.bincount(of, weights=size).max()

    before, after = largest(sa.Travelling(s, again, np.zeros(len(again), dtype=bool))), largest(sa.Travelling(s, again, np.ones(len(again), dtype=bool)))
    assert before > 500_000 and after < before / 20, (before, after)


def test_suffixes_are_sorted_by_what_is_tied(monkeypatch):
    r = np.random.default_rng(3)
    text = bytes(r.integers(97, 99, 600, dtype=np.uint8)) * 2 + b"\0\0" * 40
    start = np.arange(0, len(text) - 90)
    size = r.integers(25, 90, len(start))
    many = lambda *_: pytest.fail("all keys of all suffixes")
    monkeypatch.setattr(np, "lexsort", many)
    order, lcp = A.suffix_order(np.frombuffer(text, dtype=np.uint8), start, size)
    got = [text[start[i] : start[i] + size[i]] for i in order]
    assert sorted(order) == list(range(len(start))) and got == sorted(got)
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0, *(shared(a, b) for a, b in zip(got[:-1], got[1:], strict=True))]
    assert [len(x) for x in A.suffix_order(np.frombuffer(text, dtype=np.uint8), start[:0], size[:0])] == [0, 0]
