"""Fill-in-middle, exact top-k search and periodic runs against brute force, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from affectra.llm import balltree as B
from affectra.llm import fillmiddle as M
from affectra.llm import periods as P
from affectra.llm import queries as q
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, h1 string, d string, t string, key string, n long"


def odd(rows):
    return [(d, t, "x", "y", "z", "k", 7) for d, t in rows]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_ball_tree"])
def test_equals_sql(spark, duck, name):
    got, want = q.QUERIES[name](spark, DATA).toPandas(), duck.execute(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    names = sorted(got.columns)
    plain = lambda df: sorted(map(str, df[names].astype(object).where(df[names].notna(), None).itertuples(index=False)))
    assert [re.sub(r"\.0\b", "", r) for r in plain(got)] == [re.sub(r"\.0\b", "", r) for r in plain(want)]


# fill-in-middle


def filled(d, t, unit="token"):
    """(n, form, prefix_chars, middle_chars, output), written plainly."""
    t = t or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t) if unit == "token" else list(t)
    key = sha(f"1:{'' if d is None else d}")
    h = [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in M.MARKERS) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def strings(seed, n):
    r = random.Random(seed)
    letters = "abcXYZ  \n<>PSM019.,éßñ中文字🙂👍́\x00 "
    return ["".join(r.choice(letters) for _ in range(r.choice([1, 5, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize("unit", ["token", "character"])
def test_fill_in_middle_as_written_plainly(spark, unit):
    texts = [*strings(1, 300), None, "", "<P>", "x<S", "<M", "🙂", "word", "<S<S>", "a" * 70_000, "é" * 70_000]
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts)] + [(None, "no id, é"), (5, "twice ünd"), (5, "twice ünd")]
    docs = spark.createDataFrame(odd(rows), SCHEMA).repartition(3)
    got = M.fill_in_middle(docs, unit=unit).withColumn("again", M.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str(d), t or "", *filled(d, t, unit)) for d, t in rows)
    assert sorted((str(r.doc_id), r.again, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(docs.limit(0), unit=unit).count() == 0


def test_exception_index_converts_both_ways():
    for t in strings(2, 100):
        a = np.frombuffer(t.encode(), dtype=np.uint8)
        index = M.ExceptionIndex(a)
        at = np.array([len(t[:i].encode()) for i in range(len(t) + 1)])
        assert index.bytes(np.arange(len(t) + 1)).tolist() == at.tolist()
        assert index.characters(at).tolist() == list(range(len(t) + 1))
        assert len(index.at) == sum(len(c.encode()) > 1 for c in t)


def test_markers_that_overlap_are_refused(spark):
    docs = spark.createDataFrame(odd([(1, "a b")]), SCHEMA)
    for markers in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("xy", "yz", "<M>")):
        with pytest.raises(ValueError, match="overlap"):
            M.fill_in_middle(docs, markers=markers)
    with pytest.raises(ValueError, match="neither"):
        M.fill_in_middle(docs, unit="line")


# top-k


def plain_top(rows, k):
    """{row number of a query: [(vec_id, score)]}, every pair scored with Python's integers."""
    v = [(i, d, [int(np.floor(1024 * float(x))) for x in e]) for i, (d, e) in enumerate(rows) if d is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = {}
    for i, d, e in v:
        if d % 100 == 0:
            scores = [(-sum(a * b for a, b in zip(e, f, strict=True)), c) for j, c, f in v if j != i and len(f) == len(e)]
            out[i] = [(d, r, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return out


ODD_VECTORS = "vec_id long, embedding array<float>, id string, v string, copy int, code string, p int, width int"


def vectors(seed, n, d, kind):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) if kind == "even" else r.normal(size=(20, d))[r.integers(0, 20, n)] * 3 + r.normal(size=(n, d)) * 0.05
    return [(int(i), [float(np.float32(c)) for c in row]) for i, row in zip(r.permutation(n) * (1 if kind == "even" else 50), x, strict=True)]


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_top_inner_products_equal_all_pairs(spark, kind):
    rows = vectors(3, 900, 8, kind)
    hot = [0.5] * 8
    rows += [(10_000 + 100 * i, hot) for i in range(40)] + [(20_000, [0.0] * 8), (20_001, [0.0] * 8), (20_000, [0.0] * 8)]
    rows += [(200, None), (300, [None, *hot[1:]]), (400, [float("nan"), *hot[1:]]), (500, [float("inf"), *hot[1:]]), (None, hot), (30_000, []), (30_001, []), (40_000, [1.0, 2.0]), (40_001, [1.0, -2.0]), (50_000, [3e5, 3e5, 3e5]), (50_001, [-3e5, 5.0, 1e5])]
    rows += [(60_000, [2.0] * 8)] * 3
    df = spark.createDataFrame([(d, e, "i", "v", 1, "c", 2, 3) for d, e in rows], ODD_VECTORS).repartition(5)
    got = B.top_inner_products(df, F.col("id") % 100 == 0, shard_bytes=20_000, block_bytes=5_000, tasks=12).collect()
    want = [x for y in plain_top(rows, 10).values() for x in y]
    assert sorted(map(tuple, got)) == sorted(want)
    assert B.top_inner_products(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert B.top_inner_products(df.where("vec_id = 7"), F.col("id") % 100 == 0).count() == 0


def test_a_ball_tree_prunes_what_cannot_be_among_the_best():
    r = np.random.default_rng(1)
    x = np.floor(1024 * (r.normal(size=(50, 4))[r.integers(0, 50, 8000)] * 4 + r.normal(size=(8000, 4)) * 0.02)).astype(np.int64)
    ids = np.arange(8000)
    block = B.Block(ids[:200], x[:200], 5)
    tree = B.build(ids, x)
    block.search(tree)
    leaves = len(tree["levels"][-1][1])
    assert leaves >= 64 and block.visits < 200 * leaves / 4
    scores = x[:200] @ x.T
    scores[ids[:200], ids[:200]] = np.iinfo(np.int64).min
    for q, (s, i) in enumerate(zip(block.scores.tolist(), block.found.tolist(), strict=True)):
        best = sorted(enumerate(scores[q].tolist()), key=lambda x: (-x[1], x[0]))[:5]
        assert list(zip(i, s, strict=True)) == best


def test_every_node_of_a_ball_tree_holds_its_rows():
    x = np.random.default_rng(2).integers(-1000, 1000, size=(1000, 6))
    tree = B.build(np.arange(1000)[::-1].copy(), x)
    assert sorted(tree["ids"].tolist()) == list(range(1000))
    for bounds, centres, radii, least in tree["levels"]:
        for a, b, c, rad, low in zip(bounds[:-1], bounds[1:], centres, radii, least, strict=True):
            assert np.sqrt(((tree["x"][a:b] - c) ** 2).sum(axis=1)).max() <= rad + 1e-6 and tree["ids"][a:b].min() == low
    assert np.diff(tree["levels"][-1][0]).max() <= B.LEAF_ROWS


# periodic runs


def plain_runs(w, least=24, periods=3):
    out = {}
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, periods * p):
                out.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def word_lists(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        kinds = r.choice([1, 2, 3, 40])
        w = [f"w{r.randrange(kinds)}" for _ in range(r.choice([0, 3, 23, 24, 25, 90, 260]))]
        for _ in range(r.randrange(4)):
            if w:
                a, p, c = r.randrange(len(w)), r.randint(1, 50), r.randint(2, 7)
                w[a : a + p * c] = w[a : a + p] * c
        out.append(w)
    return out


def test_runs_equal_brute_force_by_both_extensions():
    for i in range(0, 240, 4):
        lists = word_lists(5, 240)[i : i + 4]
        words, x, counts = P.numbered([" ".join(w).encode() for w in lists])
        want, base = [], 0
        for w in lists:
            want += [(base + s, base + s + n, p) for s, n, p in plain_runs(w)]
            base += len(w)
        for extend in (P._extended, P._compared):
            assert sorted(map(tuple, P.runs(x, int(counts.max(initial=0)), extend=extend).tolist())) == sorted(want)


def test_runs_of_other_least_lengths():
    for least, periods in ((1, 3), (5, 4), (60, 3)):
        for w in word_lists(6, 60):
            _, x, counts = P.numbered([" ".join(w).encode()])
            assert sorted((s, e - s, p) for s, e, p in P.runs(x, len(w), least, periods).tolist()) == plain_runs(w, least, periods), (least, periods, w)


def test_convolution_is_the_sum_of_squared_differences():
    r = np.random.default_rng(4)
    for m, w in ((8, 22), (16, 31), (1, 1), (4, 4), (32, 63)):
        x, y = r.integers(0, 1 << 28, (5, m)).astype(np.uint64), r.integers(0, 1 << 28, (5, w)).astype(np.uint64)
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], y[i, d : d + m], strict=True)) % P.PRIME for d in range(w - m + 1)] for i in range(5)]
        assert P.mismatches(x, y).tolist() == want


def test_a_long_text_of_one_word_is_one_run():
    x = np.ones(200_000, dtype=np.uint64)
    assert P.runs(x, len(x)).tolist() == [[0, 200_000, 1]]
    w = [*["a"] * 500, "b", *["a"] * 2000, *["c", "d"] * 700]
    _, x, _ = P.numbered([" ".join(w).encode()])
    assert [(s, e - s, p) for s, e, p in P.runs(x, len(w)).tolist()] == plain_runs(w)


def digests(d, text):
    """The row of op13 for a document, written plainly."""
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), zlib.crc32(str(d).encode()) if d is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, k, p in found for i in range(s + p, s + k)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None
    lines = "".join(f"{s},{k},{p}\n" for s, k, p in sorted(found, key=lambda r: (r[0], r[2])))
    return (d, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op13_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    separators = [" ", "\n", "\t ", "  ", "\x0b"]
    rows = [(i, r.choice(["", " "]) + r.choice(separators).join(w)) for i, w in enumerate(word_lists(7, 250))]
    rows += [(i, " ".join(r.choice("é ß x y the of".split()) + str(r.randrange(9)) for _ in range(r.randrange(150)))) for i in range(300, 700)]
    rows += [(10, None), (11, ""), (12, " \n "), (None, "a b " * 40), (13, "a b " * 40), (13, "a b " * 40), (14, "x y " * 30)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    got = q.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(digests(d, t)) for d, t in rows)
    assert sum(x.n_runs > 0 for x in got) > 100 and P.periodic_runs(spark.read.parquet(path).limit(0)).count() == 0
    assert got[0].asDict().keys() == {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}


def test_periodic_runs_take_other_columns(spark):
    docs = spark.createDataFrame(odd([(4, "a b c " * 20), (None, None), (4, "a b c " * 20)]), SCHEMA)
    got = P.periodic_runs(docs).collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [(4, 60, [(0, 60, 3)], "a b c"), (None, 0, [], ""), (4, 60, [(0, 60, 3)], "a b c")]
    with pytest.raises(ValueError, match="three"):
        P.periodic_runs(docs, periods=2)


def test_planted_runs_keep_the_number_of_words(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a = {r.doc_id: r.text for r in docs.collect()}
    b = {r.doc_id: r.text for r in q.with_planted_runs(docs).collect()}
    changed = [d for d in a if a[d] != b[d]]
    assert changed and all(zlib.crc32(str(d).encode()) % 10 == 0 and len((a[d] or "").split()) == len(b[d].split()) for d in changed)
