"""The pipeline's stages in turn, each held against brute force on its own input."""

import corpus_pipeline as cp
from tests.llm.test_operators import brute_components, brute_lines, distance

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, DATA), "test")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    good = [d for d, y in labels.items() if y == 1]
    assert sum(d in kept["quality"] for d in good) >= 0.97 * len(good)
    assert sum(d not in kept["quality"] for d, y in labels.items() if y == 0) >= 0.9 * sum(y == 0 for y in labels.values())
    want = {d: t for d, (t, n) in brute_lines(kept["quality"], 2, 50).items() if not (n and not t.strip(" "))}
    assert kept["line_dedup"] == want
    parts = brute_components(kept["line_dedup"], 5, 80)
    assert set(kept["near_dedup"]) == {d for d, (_, c) in parts.items() if d == c}
    items = [r.text.lower().split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = {d for d, t in kept["near_dedup"].items() if any(len(set(i) & set(t.lower().split())) >= 0.5 * len(set(i)) and distance(i, t.lower().split()) <= len(i) // 5 for i in items)}
    assert set(kept["decontaminate"]) == set(kept["near_dedup"]) - leaks
    packed = cp.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["decontaminate"])
    assert set(before) >= set(kept["decontaminate"])
    # packing: pieces of a document are its ids by the tokenizer itself, end to end; sequences have no gaps and no more than 1024
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packed.toPandas()
    for d, part in pieces.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(kept["decontaminate"][d] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (part.length.cumsum() - part.length == part.start).all() and part.length.sum() == len(ids) and set(part.doc_tokens) == {len(ids)}
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(part.start, part.length, strict=True)] == part.ids_crc32.tolist()
    for _, part in pieces.sort_values("offset").groupby("sequence_id"):
        assert (part.length.cumsum() - part.length == part.offset).all() and part.length.sum() <= 1024
    assert cp.run(spark, DATA).count() == packed.count()


def test_rows_without_id_and_rows_that_share_one(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    clean, other, far = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(None, f"{far} {item}"), (None, clean), (5, item), (5, other), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in cp.decontaminate(spark, docs, DATA).collect()} == {(None, clean), (5, other), (6, None)}


def test_near_dedup_tells_rows_apart(spark):
    one, two, far = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(4, one), (4, two), (9, one), (None, one + " tail"), (None, two), (None, far), (7, None), (7, ""), (8, two), (3, far)]
    got = cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), DATA)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(4, one), (4, two), (7, None), (7, ""), (3, far)], key=repr)


ODD = "doc_id long, text string, n_chars int, quality_score double, n_lines string, n_removed int, h int, r int, row int, place int, lines int, gone int, kept int, size int, chars int, `a.b` int, shard int, _y int, _id int, later int, id int, depth int, crowded int, i int"


def odd_rows(spark):
    """Null and repeated ids, null and empty texts, repeated rows, one long text; names that the operators use inside."""
    long = " ".join(f"word{i * i % 7919}" for i in range(60_000))
    texts = ["The first line\nand the second\nand more", None, "", long, "a b c", "The first line\nand the second\nand more", "  \n "]
    rows = [(d, t, 1, 0.5, "n", 3, *range(18)) for d in (None, 5, 5, 8) for t in texts]
    return spark.createDataFrame(rows, ODD)


def test_stages_keep_odd_rows_and_columns(spark):
    docs = odd_rows(spark)
    for name, stage in cp.STAGES[:-1]:
        got = cp.written(stage(spark, docs, DATA), "odd")
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema], name
        kept = got.collect()
        assert all(tuple(r)[4:] == ("n", 3, *range(18)) and r.quality_score == 0.5 for r in kept), name
        if name != "quality":
            assert sum(r.text is None for r in kept) == 4, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    assert cp.pack(spark, docs, DATA).select("doc_id").distinct().count() == 3 and cp.pack(spark, docs.limit(0), DATA).count() == 0


def test_operators_take_odd_rows_and_columns(spark):
    from affectra.llm import decontaminate, gifmedia, linededup, neardup, packing, rules, sharding, substrings, suffixarray, suffixtree

    docs = odd_rows(spark)
    labels = spark.createDataFrame([(5, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "and the second and more"), (None, None), (2, "")], "item_id long, text string")
    made = {
        "pack": packing.pack_documents,
        "lines": linededup.remove_repeated_runs,
        "gif": lambda d: gifmedia.digests(gifmedia.stored(d)),
        "rules": lambda d: rules.score(d, rules.train(d, labels)),
        "shard": lambda d: sharding.shard(d, 5000),
        "tree": suffixtree.score_texts,
        "leaks": lambda d: decontaminate.find_leaks(d, bench),
        "windows": substrings.remove_repeated_windows,
        "strings": suffixarray.remove_earlier_strings,
        "near": neardup.near_duplicates,
    }
    for name, f in made.items():
        got = f(docs).collect()
        if name not in ("pack", "leaks"):
            assert len(got) == 28 and sum(r.doc_id is None for r in got) == 7, name
        assert f(docs.limit(0)).count() == 0, name
        if name in ("lines", "rules", "shard"):
            keep = [c for c in docs.columns if c not in ("n_lines", "n_removed", "quality_score", "shard")]
            assert all(c in got[0].asDict() for c in keep), name
            assert all((r.h, r.row, r["a.b"], r._y, r.i) == (0, 2, 9, 11, 17) for r in got), name
        if name == "leaks":
            assert {(r.doc_id, r.item_id) for r in got} == {(None, 1), (5, 1), (8, 1)} and len(got) == 8
