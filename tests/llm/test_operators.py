"""Each text operator against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from affectra.llm import decontaminate as dec
from affectra.llm import gifmedia as gif
from affectra.llm import queries as q
from affectra.llm import rules
from affectra.llm.linededup import remove_repeated_runs, repeated_runs
from affectra.llm.neardup import near_duplicates
from affectra.llm.packing import default_vocabulary, encoder, ends_of, pack_documents, sequences
from affectra.llm.sharding import shard
from affectra.llm.substrings import remove_repeated_windows
from affectra.llm.suffixtree import score_texts

SCHEMA = "doc_id long, text string, lang string, n long, spans string, c string, t string"
SPACE = b" \t\n\r\x0b\x0c"


def texts(seed=1, n=60):
    """Texts with copies, near copies, shared passages, empty, null and long ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ß", "the", "of"] * 10
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    out = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([3, 30, 120, 400]))]
        t = " ".join(words[: len(words) // 2]) + r.choice(["\n", " ", "\t "]) + " ".join(words[len(words) // 2 :])
        if i % 5 == 0:
            t = t + " " + passage + "\n" + " ".join(r.choice(vocabulary) for _ in range(10))
        if i % 7 == 3 and out:
            t = r.choice([x for x in out if x] or [t])
            if i % 2:
                w = t.split(" ")
                w[len(w) // 2] = "changed"
                t = " ".join(w)
        out.append(t)
    out += ["", None, "  \n ", "one", "one two", "x" * 5000, "a\na\na\na\nb", "a\na\nb"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", 1, "s", "c", "t") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def plain():
    return {i * 3: t or "" for i, t in enumerate(texts())}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = encoder(default_vocabulary())
    for x in ["", " ", "a", "a b", "a  b", " a \n b", "a\n\n b", "x \t y", "it's 12 é!! z", "tail ", "tail  ", *[x or "" for x in texts(3, 10)]]:
        assert np.frombuffer(ids(x), dtype="<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_encoder_knows_the_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, ids, m = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder(default_vocabulary()), "<|endoftext|>"
    odd = [m, f"a {m} b", f"a{m}b", f"{m}{m}", f" {m}  {m} ", f"a\n{m}\n b", f"a b  {m} c", "<|endoftext", "<|<|endoftext|>|>", m.upper()]
    r = random.Random(5)
    odd += ["".join(r.choice([m, " ", "  ", "\n", "a", "bc", "<|", "é", "'s", "1"]) for _ in range(12)) for _ in range(2000)]
    for x in odd:
        assert np.frombuffer(ids(x), dtype="<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x
    p = pack_documents(spark.createDataFrame([(1, f"a {m} b")], "doc_id long, text string")).toPandas()
    want = np.array([64, 220, 50256, 275, 0], dtype="<u4").tobytes()
    assert set(p.doc_tokens) == {5} and {zlib.crc32(want[4 * a : 4 * (a + n)]) for a, n in zip(p.start, p.length, strict=True)} == set(p.ids_crc32)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing_places_every_id_once(spark, docs, plain, capacity):
    ids = encoder(default_vocabulary())
    p = pack_documents(docs, capacity).toPandas()
    end = np.array([0], dtype="<u4").tobytes()
    for d, part in p.sort_values("start").groupby("doc_id"):
        buf, at = ids(plain[d]) + end, 0
        for r in part.itertuples():
            assert r.start == at and r.doc_tokens == len(buf) // 4
            at += r.length
            assert zlib.crc32(buf[4 * r.start : 4 * at]) == r.ids_crc32
        assert at == len(buf) // 4
    assert set(p.doc_id) == set(plain)
    for _, part in p.sort_values("offset").groupby("sequence_id"):
        assert (part.length.cumsum() - part.length == part.offset).all() and part.length.sum() <= capacity
    got = {r.sequence_id: r.ids for r in sequences(pack_documents(docs, capacity), docs).collect()}
    assert sum(map(len, got.values())) == p.length.sum()
    assert ends_of(2 * capacity + 5, capacity) == [capacity, 2 * capacity, 2 * capacity + 4, 2 * capacity + 5]


def test_packing_pads_little(spark):
    """Below a hundredth of what sequences hold; ends at a power of two aren't padded."""
    for sf in ("sf0.001", "sf0.01"):
        p = pack_documents(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).toPandas()
        held = p.groupby("sequence_id").length.sum()
        padded = held[held & (held - 1) != 0]
        share = (1024 - padded).sum() / held.sum()
        assert 0 <= share < 0.01 and held.max() <= 1024, (sf, share)


def test_packing_odd_tables(spark):
    assert pack_documents(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (1, "x")], "doc_id long, text string")
    p = pack_documents(odd).toPandas()
    assert len(p) >= 4 and p.length.sum() == 3 + 1 + 1 + 2


def brute_lines(plain, run, words=None):
    seen, out = {}, {}
    for d in sorted(plain):
        lines = plain[d].split("\n")
        keys = [x.strip(" ") for x in lines]
        gone = set()
        for s in range(len(lines) - run + 1):
            k = tuple(keys[s : s + run])
            if k in seen:
                gone |= set(range(s, s + run))
            else:
                seen[k] = (d, s)
        for s, k in enumerate(keys):
            if words is not None and len(k.encode().split()) >= words:
                if (k, "alone") in seen:
                    gone.add(s)
                seen[k, "alone"] = d
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return out


@pytest.mark.parametrize(("run", "words"), [(1, None), (2, None), (2, 30), (3, 20), (4, None), (5, 50)])
def test_line_dedup(spark, docs, plain, run, words):
    r = random.Random(run)
    block = [r.choice("abcdef") for _ in range(30)]
    plain = plain | {1000 + i: "\n".join(block[(k := r.randrange(25)) : k + r.randrange(1, 9)] + [r.choice("ghij")] + block[(k := r.randrange(25)) : k + r.randrange(1, 9)]) for i in range(40)}
    docs = docs.unionByName(spark.createDataFrame([(d, t) for d, t in plain.items() if d >= 1000], "doc_id long, text string"), True)
    got = remove_repeated_runs(docs, run, words=words)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    want = brute_lines(plain, run, words)
    for r in got.collect():
        assert (r.text or "", r.n_removed) == want[r.doc_id]
    assert remove_repeated_runs(empty(spark)).count() == 0


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_dedup_of_one_long_line(spark, run):
    long, copied = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(29))
    plain = {1: f"a\n{long}\nb", 2: f"c\n {long} \nd", 3: long, 4: f"e\n{copied}\nf", 5: f"g\n{copied}\nh", 6: f"{long}\n{long}", 7: "c\nd\ne\nf", 8: "c\nd\ne\nf", 9: None}
    got = {r.doc_id: (r.text, r.n_removed) for r in remove_repeated_runs(spark.createDataFrame(list(plain.items()), "doc_id long, text string").repartition(3), run, words=30).collect()}
    want = {d: t for d, (t, _) in brute_lines({d: t or "" for d, t in plain.items()}, run).items()}
    if run > 1:
        assert want[2] == plain[2] and want[3] == plain[3]  # by lines alone both stay
    for d in (2, 3, 6):
        want[d] = "\n".join(x for x in want[d].split("\n") if x.strip() != long)
    assert {d: t or "" for d, (t, _) in got.items()} == want
    assert got[3] == ("", 1) and got[6] == ("", 2) and (run == 1 or got[5] == (plain[5], 0)) and got[9] == (None, 0)


def test_windows_are_joined_with_fingerprints_once(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "x\na\nb")], "doc_id long, text string")
    runs = repeated_runs(docs, 2)
    read = {f.split("/tables/")[1].split("-")[0] for f in runs.inputFiles()}
    assert read == {"around", "firsts"}  # what is left to do needs no other table
    assert [(r.place.b, r.start, r.stop, r.source.b, r.source_start) for r in runs.collect()] == [(2, 1, 3, 1, 0)]


def test_gif_round_trip_and_rules():
    r = random.Random(0)
    for n in (1, 2, 63, 64, 700, 4096, 70_000):
        for data in (bytes(r.randrange(256) for _ in range(n)), b"ab" * n, bytes(n)):
            for defer in (False, True):
                assert gif.lzw_decode(gif.lzw_encode(data, 8, defer), 8, len(data)) == data
    payload = bytes(r.randrange(256) for _ in range(64 * 9000))
    got = gif.frames(gif.encode(payload))
    assert b"".join(f["indices"].tobytes() for f in got) == payload and [f["start_ms"] for f in got] == [0, 100]
    # two colours, disposal and transparency, built by hand
    table = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])

    def frame(x, indices, disposal, clear):
        return b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0]) + b"\0\x2c" + bytes([x, 0, 0, 0, len(indices), 0, 1, 0, 0]) + b"\x02" + gif._blocks(gif.lzw_encode(bytes(indices), 2))

    body = b"GIF89a" + bytes([4, 0, 1, 0, 0x81, 0, 0]) + table
    seen = gif.frames(body + frame(0, [0, 1, 2, 3], 1, None) + frame(0, [3, 3, 1, 1], 3, 3) + frame(1, [2, 2], 2, None) + frame(0, [1], 1, None) + b";")
    rgb = [[tuple(p[:3]) if p[3] else None for p in f["canvas"][0].tolist()] for f in seen]
    red, green, blue, grey = (255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9)
    assert rgb == [[red, green, blue, grey], [red, green, green, green], [red, blue, blue, grey], [green, None, None, grey]]
    assert gif.frames(b"") == [] and gif.frames(b"GIF89a" + bytes(7)) == []


def test_lzw_is_decoded_without_a_step_a_code():
    rng = np.random.default_rng(5)
    for data in (bytes(rng.integers(97, 100, 20_000, dtype=np.uint8)), bytes(5000), b"ab" * 4000):
        for defer in (False, True):
            code, calls = gif.lzw_encode(data, 8, defer), []
            sys.setprofile(lambda *e: calls.append(e[1]))  # noqa: B023
            got = [gif.lzw_decode(code, 8, most) for most in (len(data), 777)]
            sys.setprofile(None)
            assert got == [data, data[:777]] and len(calls) < len(code) / 4 + 1500
            cut = gif.lzw_decode(code[: len(code) // 2], 8, len(data))
            assert 0 < len(cut) < len(data) and data.startswith(cut)


def plain_gif(data):
    """Frames (indices, delay in hundredths) of a GIF with a global palette, and the palette, by the textbook."""
    at = 13 + (3 << (data[10] & 7) + 1)
    palette, out, delay = data[13:at], [], 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            delay, at = data[at + 4] | data[at + 5] << 8, at + 8
            continue
        bits, at, body = data[at + 10], at + 11, b""
        while data[at]:
            body, at = body + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
        at += 1
        number, n, got, table, last = int.from_bytes(body, "little"), bits + 1, bytearray(), None, None
        while True:
            code, number = number & (1 << n) - 1, number >> n
            if code == 1 << bits:
                table, last, n = [bytes([i]) for i in range(1 << bits)] + [b"", b""], None, bits + 1
                continue
            if code == (1 << bits) + 1:
                break
            word = table[code] if code < len(table) else last + last[:1]
            got += word
            if last is not None and len(table) < 4096:
                table.append(last + word[:1])
            n, last = min(12, max(n, len(table).bit_length())), word
        out.append((bytes(got), delay))
    return out, palette


def test_gif_against_a_plain_reader(spark):
    r = random.Random(8)
    texts = ["", "a", "é" * 40, "".join(chr(r.randrange(1, 900)) for _ in range(9000)), " ".join(r.choice(["so", "what", "now"]) for _ in range(4000)), "z" * 600_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    read = {x.doc_id: x for x in gif.read_media(gif.to_media(df)).collect()}
    features = {x.doc_id: x for x in gif.digests(gif.stored(df)).collect()}
    for d, t in enumerate(texts):
        found, palette = plain_gif(bytes(read[d].media))
        payload = t.encode() + bytes(-len(t.encode()) % 64 or (0 if t else 64))
        assert b"".join(x for x, _ in found) == payload == bytes(read[d].payload)
        assert features[d].media_sha256 == hashlib.sha256(bytes(read[d].media)).hexdigest() and features[d].media_bytes == len(read[d].media)
        canvas = bytearray()
        text, start = [], 0
        for (x, delay), f in zip(found, read[d].frames, strict=True):
            canvas[: len(x)] = x  # the last frame may leave rows of the one before
            want = [sum(palette[3 * v + i] // 32 == b for v in canvas) for i in range(3) for b in range(8)] if len(x) < 9000 else f.histogram
            assert list(f.histogram) == want and sum(f.histogram) == 3 * len(canvas) and (f.start_ms, f.delay_ms) == (start, 10 * delay)
            text.append(f"64x{len(x) // 64}@{start}+{10 * delay}:{','.join(map(str, want))}")
            start += 10 * delay
        assert features[d].feature == ";".join(text)
    red = gif.histogram(np.array([[[255, 0, 31, 255], [255, 32, 0, 0]]], dtype=np.uint8))
    assert red == [0] * 7 + [1] + [1] + [0] * 7 + [1] + [0] * 7


def test_gif_table(spark, docs, plain):
    got = gif.digests(gif.stored(docs)).collect()
    assert len(got) == len(plain)
    for r in got:
        t = plain[r.doc_id].encode()
        payload = t + bytes(-len(t) % 64 or (0 if t else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(t), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert gif.digests(gif.stored(empty(spark))).count() == 0


def test_rules_learn_and_compile(spark):
    r = random.Random(2)
    rows = [(i, "plain words in a row " * 5 if i % 3 else "JUNK!! $$$ ### " * 9, 1 if i % 3 else 0) for i in range(240)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = rules.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert 0 < len(model.rules) < 40
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 9000)], "doc_id long, text string")
    assert all(0 <= x.quality_score <= 1 for x in rules.score(odd, model).collect())
    got = rules.score(df, model).collect()
    assert all((x.quality_score >= 0.7) == (x.quality == 1) for x in got)
    none = rules.train(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert rules.score(odd, none).first().quality_score == 0.5


def test_rules_against_plain_python(spark, docs, plain):
    """Statistics and a compiled score, text by text."""
    import re

    def by_hand(t):
        n, words, lines = max(len(t), 1), re.split(r"[\x20\x09-\x0D]+", t.lower()), t.split("\n")
        share = lambda chars: sum(c in chars for c in t) / n
        return {
            "chars": math.log1p(len(t)), "upper": sum(c.isupper() for c in t) / n, "digits": share("0123456789"), "stops": share(".,;:?"), "shouts": share("!"), "bars": share("|"), "signs": share("#$%&*<>{}[]=_~^\\/@+"), "blanks": share(" "),
            "lines": len(lines) / n, "line_kinds": len(set(lines)) / len(lines), "word_kinds": len(set(words)) / len(words), "word_length": n / len(words), "words": math.log1p(len(words)), "short_words": sum(len(w) <= 3 for w in words) / len(words),
        }

    stats = rules.statistics(F.coalesce("text", F.lit("")))
    got = {r.doc_id: r.asDict() for r in docs.select("doc_id", *(c.alias(k) for k, c in stats.items())).collect()}
    want = {d: by_hand(t) for d, t in plain.items()}
    for d, w in want.items():
        assert {k: got[d][k] for k in w} == pytest.approx(w), d
    model = rules.RuleModel([(("chars", True, 5.0),), (("word_kinds", False, 0.9), ("blanks", True, 0.1))], [1.5, -2.0], 0.25)
    for r in rules.score(docs, model).collect():
        w = want[r.doc_id]
        z = 0.25 + 1.5 * (w["chars"] > 5.0) - 2.0 * (w["word_kinds"] <= 0.9 and w["blanks"] > 0.1)
        assert r.quality_score == pytest.approx(1 / (1 + math.exp(-z)))


def test_rules_on_held_out_rows(spark):
    got = q.op4_quality(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95


@pytest.mark.parametrize("limit", [700, 10**9])
def test_shards(spark, docs, plain, limit):
    got = shard(docs, limit).toPandas()
    assert len(got) == len(plain)
    size = {d: len(t.encode()) for d, t in plain.items()}
    names = sorted(set(got["shard"]))
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    for name, part in got.groupby("shard"):
        assert sum(size[d] for d in part.doc_id) == part.shard_bytes.iloc[0]
        assert part.shard_bytes.iloc[0] <= limit or len(name) == 60
        if name:  # its parent was too large
            assert sum(size[d] for d, s in zip(got.doc_id, got["shard"], strict=True) if s.startswith(name[:-1])) > limit or len(name) == 60
    assert shard(empty(spark), limit).count() == 0


def test_shard_of_one_hot_key_has_pages(spark):
    df = spark.createDataFrame([(7, "x" * 100)] * 300, "doc_id long, text string")
    got = shard(df, 2000).groupBy("shard").count().collect()
    assert len(got) > 10 and sum(r["count"] for r in got) == 300


def test_pages_of_hot_keys_are_within_the_limit(spark, monkeypatch):
    from affectra.llm import sharding

    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    monkeypatch.setattr(sharding, "DIRECTORY_ROWS", 3)
    r = random.Random(2)
    rows = [(None if i % 3 else 7, "x" * r.choice([0, 1, 99, 700, 1999, 2000])) for i in range(900)] + [(7, "y" * 5000), (8, "z" * 5000)] + [(i, "x" * 50) for i in range(100, 400)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2000).collect()
    assert Counter((x.doc_id, x.text) for x in got) == Counter(rows)
    size, count = Counter(), Counter(x.shard for x in got)
    for x in got:
        size[x.shard] += len(x.text)
    assert all(x.shard_bytes == size[x.shard] and (size[x.shard] <= 2000 or count[x.shard] == 1) for x in got)
    assert sum("+" in x for x in size) < 2.5 * sum(n for x, n in size.items() if "+" in x) / 2000


def distance(item, text):
    """Least edits between item and any stretch of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("block", [8 << 20, 700])
def test_decontamination(spark, block, monkeypatch):
    r = random.Random(5)
    words = [f"v{i}" for i in range(60)]
    items = [[r.choice(words) for _ in range(r.choice([4, 9, 25, 70]))] for _ in range(12)]
    rows = []
    for d in range(60):
        item = list(r.choice(items))
        for _ in range(r.randrange(0, 2 + len(item) // 4)):
            k = r.randrange(len(item))
            r.choice([lambda item=item, k=k: item.__setitem__(k, "edit"), lambda item=item, k=k: item.insert(k, "more"), lambda item=item, k=k: len(item) > 1 and item.pop(k)])()
        rows.append((d, " ".join([r.choice(words) for _ in range(30)] + item).upper() + "\n tail"))
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(98, None), (99, "")]
    docs = spark.createDataFrame([*rows, (100, None), (None, rows[0][1])], "doc_id long, text string")
    monkeypatch.setattr(dec, "BLOCK_BYTES", block)
    got = {(x.doc_id, x.item_id): x.distance for x in dec.find_leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = {}
    for d, t in [*rows, (None, rows[0][1])]:
        for i, item in enumerate(items):
            n = distance(item, t.lower().split())
            if n <= len(item) // 5:
                want[d, i] = n
    assert got == want and len(want) > 20
    assert dec.find_leaks(docs.limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


class BruteTree:
    """Counts, retained contexts and chances of a suffix tree over lists of words, by plain dictionaries."""

    def __init__(self, texts, depth, least, gain, prior):
        self.depth, self.prior = depth, prior
        self.n = Counter(tuple(t[i - k : i + 1]) for t in texts for i in range(len(t)) for k in range(min(depth, i) + 1))
        self.total, self.kinds = sum(map(len, texts)), len({w for t in texts for w in t})
        self.before = Counter(tuple(t[i - k : i]) for t in texts for i in range(len(t)) for k in range(1, min(depth, i) + 1))
        self.kept, tried = set(), set()
        # a context is counted if what it begins with was tried, and tried if it is there often, but less often than its suffix
        count = lambda x: self.before[x] if len(x) <= 2 or x[:-1] in tried else 0
        for k in range(1, depth + 1):
            gains = Counter()
            tried |= {x for x in self.before if len(x) == k and count(x) >= least and (k == 1 or count(x) < count(x[1:]))}
            for t in texts:
                for i in range(k, len(t)):
                    x = tuple(t[i - k : i])
                    if x in tried:
                        p = self.chance(t, i, k - 1, 1)
                        gains[x] += math.log((self.n[(*x, t[i])] - 1 + prior * p) / (self.before[x] - 1 + prior) / p)
            self.kept |= {x for x, g in gains.items() if round(g * 256) >= gain * 256}

    def chance(self, t, i, depth, one):
        p = (max(0, self.n[(t[i],)] - one) + 0.1) / (self.total - one + 0.1 * (self.kinds + 1))
        for k in range(1, min(depth, i) + 1):
            x = tuple(t[i - k : i])
            if x in self.kept:
                p = (max(0, self.n[(*x, t[i])] - one) + self.prior * p) / (max(0, self.before[x] - one) + self.prior)
        return p


@pytest.mark.parametrize(("depth", "least", "size"), [(1, 2, 1 << 22), (2, 2, 1 << 22), (3, 3, 1 << 22), (4, 2, 1 << 22), (2, 2, 20_000)])
def test_language_model(spark, docs, plain, depth, least, size, monkeypatch):
    from affectra.llm import batches

    monkeypatch.setattr(batches, "BATCH_BYTES", size)
    monkeypatch.setattr(batches, "BUCKET_HASHES", 300)
    got = score_texts(docs, depth=depth, least=least).collect()
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in plain}
    words = {d: [*t.encode().lower().split(), "end"] for d, t in plain.items()}
    tree = BruteTree([w for d, w in words.items() if not held[d]], depth, least, 1.0, 2.0)
    assert len(got) == len(plain) and (depth == 1 or {1, 2} <= set(map(len, tree.kept)))
    for r in got:
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(w), tree.total)
        assert r.n_known == sum(tree.n[(x,)] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10(tree.chance(w, i, 0, 0)) for i in range(len(w))))
        # a context at the very threshold may fall either way where gains are summed by batch
        near = 1e-9 if size > 20_000 else 0.02
        assert r.score == pytest.approx(sum(math.log10(tree.chance(w, i, depth, 0)) for i in range(len(w))), rel=near)
    known = [*{x[0] for x in tree.n if len(x) == 1}, "unknown"]
    for x in [*list(tree.kept)[:20], ()]:
        assert sum(tree.chance([*x, w], len(x), depth, 0) for w in known) == pytest.approx(1)


def test_language_model_odd_tables(spark, docs):
    assert score_texts(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, None, 1), (None, "a b", 2), (3, "A b", 3), (3, "A b", 3), (29, "", 4), (29, "c", 5)], "doc_id long, text string, held int")
    got = score_texts(odd).collect()
    assert zlib.crc32(b"29") % 10 == 0 and len(got) == 6
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == Counter([(None, False, 1, 1, 10), (None, False, 3, 3, 10), (3, False, 3, 3, 10), (3, False, 3, 3, 10), (29, True, 1, 1, 10), (29, True, 2, 1, 10)])
    all_held = score_texts(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in all_held)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_language_model_beats_its_base_on_held_out_rows(spark, sf):
    """Four words tell more than two, and two more than the base."""
    base, score = score_texts(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base + 0.05 * abs(base)
    two = score_texts(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), depth=2).where("held_out").agg(F.sum("score")).first()[0]
    assert score > two > base


def test_substrings(spark, docs, plain):
    width, seen, want = 20, set(), {}
    for d in sorted(plain):
        w = plain[d].encode().split()
        gone = set()
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            if k in seen:
                gone |= set(range(s, s + width))
            seen.add(k)
        want[d] = len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    got = remove_repeated_windows(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want and any(x[1] for x in want.values())
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
    assert remove_repeated_windows(empty(spark)).count() == 0


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_batches_are_bounded_by_bytes(spark, most, monkeypatch):
    from affectra.llm import batches as bt

    monkeypatch.setattr(bt, "CUTS", most)
    monkeypatch.setattr(bt, "BATCH_BYTES", 4000)
    monkeypatch.setattr(bt, "RANGE_BYTES", 20_000)
    r = random.Random(4)
    word = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(50))
    rows = [(i, "x") for i in range(300)] + [(i, word()) for i in range(300, 340)] + [(None, word()) for _ in range(40)] + [(7, word()) for _ in range(40)]
    rows += [(9, rows[300][1])] * 40 + [(None, rows[340][1])] * 40 + [(None, None)] * 700
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts, total = bt.batched(docs)
    assert total == sum(len(t or "") for _, t in rows)
    got = parts.collect()
    assert Counter((x.d, x.t) for x in got) == Counter((d, t or "") for d, t in rows)
    size, ends = Counter(), {}
    for x in got:
        size[x.b] += len(x.t) + bt.ROW_BYTES
        k = (x.d is not None, x.d or 0, x.h)
        lo, hi = ends.get(x.b, (k, k))
        ends[x.b] = min(lo, k), max(hi, k)
    assert max(size.values()) <= 4000 + 299 + bt.ROW_BYTES and len(size) >= 15
    order = [ends[b] for b in sorted(ends)]
    assert all(a[1] <= z[0] for a, z in zip(order, order[1:], strict=False))
    left = remove_repeated_windows(docs).collect()
    whole = Counter(x.doc_id for x in left if x.n_removed == 0 and x.n_words == 50)
    # of each text the first copy alone is whole: null ids come first, then 7 and 9
    assert whole == Counter({None: 40, 7: 40} | {i: 1 for i in range(301, 340)} | {9: 1}) and len(left) == len(rows)


def test_substrings_with_many_batches(spark, docs, monkeypatch):
    from affectra.llm import batches

    one = {r.doc_id: r.kept for r in remove_repeated_windows(docs).collect()}
    monkeypatch.setattr(batches, "BATCH_BYTES", 4000)
    monkeypatch.setattr(batches, "BUCKET_HASHES", 300)
    assert {r.doc_id: r.kept for r in remove_repeated_windows(docs).collect()} == one


def brute_strings(rows, length):
    """(id, bytes, removed, kept) of each row, sorted, by a dictionary of all strings."""
    key = lambda d: (d is not None, d or 0)
    least = {}
    for d, t in rows:
        for i in range(len(t) - length + 1):
            x = t[i : i + length]
            least[x] = min(least.get(x, key(d)), key(d))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < key(d):
                gone[i : i + length] = True
        out.append((key(d), len(t), int(gone.sum()), bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 22, 3000])
@pytest.mark.parametrize("length", [50, 33])
def test_suffix_array(spark, docs, plain, size, length, monkeypatch):
    from affectra.llm import batches, suffixarray

    monkeypatch.setattr(batches, "BATCH_BYTES", size)
    monkeypatch.setattr(suffixarray, "BUCKET_BYTES", size)
    monkeypatch.setattr(suffixarray, "SORTED", 4 * size)
    monkeypatch.setattr(suffixarray, "CHUNK", 1 << 18 if size > 3000 else 700)
    long = " ".join(f"{i * i % 977}" for i in range(400))
    rows = [(d, t.encode()) for d, t in plain.items()]
    rows += [(None, long.encode()), (None, long.encode()), (50, long.encode()), (50, (long + " tail").encode()), (3, plain[30].encode()), (3, plain[33].encode()), (200, b"ab" * 4000), (201, b"ba" * 900 + b"c" * 300)]
    table = spark.createDataFrame([(d, t.decode()) for d, t in rows], "doc_id long, text string").repartition(3)
    got = suffixarray.remove_earlier_strings(table, length).collect()
    want = brute_strings(rows, length)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == want and any(x[2] for x in want)
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed and all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert suffixarray.remove_earlier_strings(empty(spark)).count() == 0


def test_longest_previous_factors():
    from affectra.llm import suffixarray as sa

    r = random.Random(3)
    for n, letters in [(1, "a"), (40, "ab"), (300, "abc"), (200, "a"), (400, "abcdefghijkl")]:
        text = "".join(r.choice(letters) for _ in range(n)).encode()
        blob, start = np.frombuffer(text, dtype=np.uint8), np.arange(n)
        size = np.minimum(n - start, 40)
        order, lcp = sa.suffix_order(blob, start, size)
        parts = [text[i : i + k] for i, k in zip(order, size[order], strict=True)]
        common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert parts == sorted(parts) and lcp.tolist() == [0, *(common(x, y) for x, y in zip(parts, parts[1:], strict=False))]
        value = np.array([r.randrange(6) for _ in range(n)])
        for least in (1, 5):
            got = sa.longest_previous(lcp, value[order], least)
            want = [max((common(x, y) for y, j in zip(parts, order, strict=True) if value[j] < value[i]), default=0) for x, i in zip(parts, order, strict=True)]
            assert got.tolist() == [x if x >= least else 0 for x in want]


def brute_components(plain, width, percent):
    sets = {}
    for d, t in plain.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("width", "percent", "small"), [(3, 85, 64), (5, 80, 2)])
def test_near_duplicates(spark, docs, plain, width, percent, small, monkeypatch):
    from affectra.llm import neardup

    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    got = near_duplicates(docs, width, percent, 32, 5).collect()
    want = brute_components(plain, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and any(not r.kept for r in got)


def test_near_duplicates_in_a_large_family(spark):
    """Copies of one text with 0 to 7 edited words: many share buckets, few are linked, some only by others."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    texts = {}
    for d in range(150):
        own = list(words)
        for at in rng.sample(range(150), d % 8):
            own[at] = rng.choice(["x", f"y{d}", f"z{d // 2}"])
        texts[d] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 3, 85)


def test_near_duplicates_odd_tables(spark):
    assert near_duplicates(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "A B\nc  d"), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(odd).collect())
    assert got == [(False, 2, 2, True), (False, 4, 2, False), (False, 4, 2, False), (False, 9, 9, True), (True, 0, None, True)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x\ny\nx\ny", 1, 2, 3, 4.0)], "doc_id long, text string, n_lines int, shard int, _h int, quality_score double")
    assert remove_repeated_runs(df).first().n_removed == 2
    assert shard(df, 10).first().shard is not None
    assert pd.notna(rules.score(df, rules.RuleModel([], [], 0.0)).first().quality_score)


def test_runs_of_lines_are_maximal(spark):
    plain = {1: "a\nb\nc\nd\ne", 2: "x\nb\nc\nd\ny\na\nb", 3: "c\nd\ne\nz"}
    got = repeated_runs(spark.createDataFrame(list(plain.items()), "doc_id long, text string")).collect()
    assert {(r.place.b, r.start, r.stop, r.source.b, r.source_start) for r in got} == {(2, 1, 4, 1, 1), (2, 5, 7, 1, 0), (3, 0, 3, 1, 2)}
