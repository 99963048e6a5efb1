"""Operators against small cases worked out by hand."""

import struct
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from affectra.operators import arrays as A
from affectra.operators import metrics as M
from affectra.operators import splits as S
from affectra.operators import train as H
from affectra.operators import transforms as T
from affectra.operators import validate as V
from affectra.sources import files as R


def fit_class_head(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 30, rate: float = 0.05, valid: np.ndarray | None = None) -> tuple[np.ndarray, list[dict]]:
    """Linear softmax head by cross-entropy; returns the weights of the best epoch (first of the least validation loss) and the history."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, opt = np.zeros((x1.shape[1], classes)), H.Adam((x1.shape[1], classes), rate)
    held = np.zeros(len(x), dtype=bool) if valid is None else valid
    held = held if held.any() else np.ones(len(x), dtype=bool)
    best, history = (np.inf, w), []
    for epoch in range(1, epochs + 1):
        z = np.einsum("ij,jk", x1, w)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))
        history.append({"epoch": epoch, "train": float(loss.mean()), "valid": float(loss[held].mean())})
        if history[-1]["valid"] < best[0]:
            best = history[-1]["valid"], w.copy()
        p[np.arange(len(y)), y] -= 1
        w = opt.step(w, np.einsum("ij,ik", x1, p) / len(y))
    return best[1], history


def fit_vad_head(x: np.ndarray, t: np.ndarray, epochs: int = 60, rate: float = 0.05, before: np.ndarray | None = None) -> tuple[np.ndarray, list[bool]]:
    """One linear head per dimension by CCC loss; t has NaN where a label is missing.

    A dimension with fewer than two labels (Dominance often) gets no step at
    all, not even weight decay: its weights come back bit for bit.
    """
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.full((x1.shape[1], t.shape[1]), 0.01) if before is None else before.copy()
    trained = []
    for d in range(t.shape[1]):
        ok = np.isfinite(t[:, d])
        trained.append(bool(ok.sum() >= 2))
        if trained[-1]:
            opt = H.Adam(x1.shape[1], rate)
            for _ in range(epochs):
                _, g = H.ccc_and_gradient(np.einsum("ij,j", x1[ok], w[:, d]), t[ok, d])
                w[:, d] = opt.step(w[:, d], -np.einsum("ij,i", x1[ok], g))
    return w, trained


def test_perfect_agreement(spark):
    df = spark.createDataFrame([(-1.0, 0.0), (0.0, 0.5), (1.0, 1.0)], "v double, a double").withColumns({"pv": F.col("v"), "pa": F.col("a")})
    r = df.agg(M.ccc("pv", "v").alias("c"), M.ccc_loss([("pv", "v"), ("pa", "a")]).alias("l")).first()
    assert r.c == pytest.approx(1, abs=1e-6) and r.l == pytest.approx(0, abs=1e-6)


def test_masked_dominance(spark):
    rows = [(0.1, 0.2, 0.5), (0.4, 0.1, None), (0.3, 0.9, 0.1), (0.2, 0.2, None)]
    df = spark.createDataFrame(rows, "p double, t double, d double").withColumn("q", F.col("p") * 2)
    moved = df.withColumn("q", F.when(F.col("d").isNull(), F.col("q") + 1000).otherwise(F.col("q")))
    loss = [x.agg(M.ccc_loss([("p", "t"), ("q", "d")])).first()[0] for x in (df, moved)]
    assert loss[0] == loss[1]
    one = df.where("d > 0.2")
    assert one.agg(M.ccc("q", "d", least=2)).first()[0] is None
    assert one.agg(M.ccc("q", "d", least=2, absent=float("nan"))).first()[0] != 0
    assert df.limit(0).agg(M.ccc_loss([("p", "t")])).first()[0] == 0


def test_identity_classification(spark):
    df = spark.range(4).select(F.col("id").cast("int").alias("true_class"), F.col("id").cast("int").alias("pred_class"))
    r = M.report(M.confusion(df, 4)).first()
    assert (r.wa, r.ua_skip, r.weighted_f1, r.macro_f1) == (1, 1, 1, 1)
    five = M.report(M.confusion(df, 5)).first()
    assert five.ua_strict is None and five.ua_zero == pytest.approx(0.8) and five.macro_f1 == pytest.approx(0.8)


def test_pooling(spark):
    df = spark.createDataFrame([(0, 0, [1.0], True), (0, 1, [100.0], False), (0, 2, [3.0], True), (1, 0, [5.0], False)], "utt_idx long, frame_idx int, feat array<double>, valid boolean")
    assert {r.utt_idx: r.pooled for r in A.pool(df).collect()} == {0: [2.0], 1: None}
    assert {r.utt_idx: r.pooled for r in A.pool(df, empty="zero").collect()} == {0: [2.0], 1: [0.0]}
    assert {r.utt_idx: r.pooled for r in A.attention_pool(df, [0.0]).collect()} == {0: [2.0]}


def test_explanations(spark):
    vad = spark.createDataFrame([(1, 0.2, -0.4, 0.6)], "utt_id long, valence double, arousal double, dominance double")
    w, b = [[1.0, 0.0, 0.5], [-0.5, 1.0, 0.0], [0.0, -1.0, 0.5], [-1.0, 0.5, -0.5]], [0.1, -0.2, 0.3, 0.0]
    terms = A.contributions(vad, w, b, M.DIMS)
    x = np.array([0.2, -0.4, 0.6])
    assert [r.logit for r in terms.orderBy("class_idx").collect()] == pytest.approx((np.array(w) @ x + b).tolist())
    c = A.contrast(vad, w, b, M.DIMS).first()
    assert c.delta_bias + c.delta_valence_term + c.delta_arousal_term + c.delta_dominance_term == pytest.approx(c.delta_logit)


def test_scales(spark):
    for lo, hi in ((0, 1), (1, 5), (1, 9), (-1, 1)):
        df = spark.createDataFrame([(float(lo),), (float(hi),), (float("nan"),), (None,)], "x double")
        got = [r.x for r in T.rescale_auto(df, ["x"]).collect()]
        assert got[:2] == [0.0, 1.0] and got[2] != got[2] and got[3] is None
    with pytest.raises(ValueError):
        T.rescale_auto(spark.createDataFrame([(0.0,), (10.0,)], "x double"), ["x"])


def test_rules(spark):
    df = spark.createDataFrame([(0, 0.5, "1.5", "a"), (1, 1.2, "no", " "), (2, float("nan"), "inf", None)], "k int, x double, s string, id string")
    got = {(r.rule_id, r.key) for r in V.violations(df, "k", {"range": V.out_of_range("x"), "number": V.not_numeric("s"), "blank": V.blank("id")}).collect()}
    assert got == {("range", 1), ("number", 1), ("number", 2), ("blank", 1), ("blank", 2)}
    with pytest.raises(V.DataError):
        V.strict(V.violations(df, "k", {"range": V.out_of_range("x")}))


def test_speaker_split_needs_three(spark):
    with pytest.raises(ValueError):
        S.by_speaker(spark.createDataFrame([("a", "x"), ("b", "x")], "s string, e string"), "s", "e", 0.2, 0.2, 7)


def test_gradient_matches_differences():
    r = np.random.default_rng(0)
    p, t = r.normal(size=9), r.normal(size=9)
    _, g = H.ccc_and_gradient(p, t)
    for i in range(9):
        q = p.copy()
        q[i] += 1e-6
        assert (H.ccc_and_gradient(q, t)[0] - H.ccc_and_gradient(p, t)[0]) / 1e-6 == pytest.approx(g[i], abs=1e-5)


def test_dominance_head_is_untouched_without_labels():
    r = np.random.default_rng(1)
    x, t = r.normal(size=(30, 4)), r.normal(size=(30, 3))
    t[:, 2] = np.nan
    before = r.normal(size=(5, 3))
    w, trained = fit_vad_head(x, t, before=before)
    assert trained == [True, True, False] and (w[:, 2] == before[:, 2]).all() and (w[:, 0] != before[:, 0]).any()


@pytest.fixture
def prefix(tmp_path):
    np.save(tmp_path / "a.npy", np.arange(9 * 768, dtype=np.float32).reshape(9, 768))
    (tmp_path / "a.lengths").write_text("1\n3\n5\n")
    (tmp_path / "a.vad").write_text("u0\t-0.5\t0.25\nu1\t0.1\t0.2\nu2\t0\t1\n")
    (tmp_path / "a.emo").write_text("u0\thap\nu1\tsad\nu2\tang\n")
    return tmp_path


def test_prefix(spark, prefix):
    df = R.read_prefix(spark, str(prefix / "a"), shortest=2, longest=3)
    rows = df.orderBy("utt_idx", "frame_idx").collect()
    assert [(r.utt_idx, r.frame_idx, r.feat[0], r.class_idx) for r in rows] == [(1, 0, 768.0, 1), (1, 1, 1536.0, 1), (1, 2, 2304.0, 1)]
    assert rows[0].valence == 0.1 and rows[0].dominance is None


@pytest.mark.parametrize(("name", "text", "message"), [("emo", "u0\thap\nu1\tneu\nu2\tang\n", "unknown"), ("emo", "u0\thap\nx\tsad\nu2\tang\n", "there"), ("vad", "u0\t0\t0\nu1\t0\t0\n", "counts"), ("vad", "u0\t0\t1.2\nu1\t0\t0\nu2\t0\t0\n", "outside"), ("vad", "u0\t0\t0\t0\nu1\t0\t0\nu2\t0\t0\n", "four"), ("lengths", "1\n3\n4\n", "sum"), ("lengths", "1\nx\n4\n", "length")])
def test_prefix_refusals(spark, prefix, name, text, message):
    (prefix / f"a.{name}").write_text(text)
    with pytest.raises(ValueError, match=message):
        R.read_prefix(spark, str(prefix / "a"))


def test_mixed_dominance(spark, prefix):
    (prefix / "a.vad").write_text("u0\t0\t0\nu1\t0\t0\t0.5\nu2\t0\t0\n")
    assert [r.dominance for r in R.read_vad(spark, str(prefix / "a.vad"), mixed=True).orderBy("utt_idx").collect()] == [None, 0.5, None]


def _wav(path, samples, width=2, channels=1, rate=16000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples)


def test_wavs(spark, tmp_path):
    ramp = np.linspace(-8000, 8000, 16000).astype("<i2")
    _wav(tmp_path / "a.wav", ramp.tobytes())
    _wav(tmp_path / "b.wav", bytes([0, 128, 255]), 1)
    _wav(tmp_path / "c.wav", struct.pack("<ii", -(2**31), 2**30), 4)
    _wav(tmp_path / "d.wav", bytes(6), 3)
    _wav(tmp_path / "e.wav", bytes(8), 2, 2)
    (tmp_path / "f.wav").write_bytes(b"junk")
    (tmp_path / "g.mp3").write_bytes(b"junk")
    got = {r.path[-5]: r for r in R.read_wavs(spark, str(tmp_path)).collect()}
    assert set(got) == set("abcdef")
    assert np.allclose(got["a"].samples, ramp / 32768) and got["b"].samples == [-1.0, 0.0, 0.9921875] and got["c"].samples == [-1.0, 0.5]
    assert got["d"].error == "sample width" and got["e"].error == "not mono" and got["f"].error.startswith("unreadable")
    f = R.extract(R.read_wavs(spark, str(tmp_path)))
    assert f.where(F.col("path").endswith("a.wav")).count() == 40 and f.where(F.size("feat") != 768).count() == 0


def test_annotations(spark, tmp_path):
    p = tmp_path / "a.csv"
    names = {"audio": "file", "speaker": "who", "emotion": "emo", "valence": "V", "arousal": "A", "dominance": "D"}
    p.write_text("﻿file,who,emo,V,A\nx.wav,s1,joy,1,2\n/y.wav,s2,calm,3,4\n", encoding="utf-8")
    got = R.read_annotations(spark, str(p), names, "/data").orderBy("speaker").collect()
    assert [(r.audio_path, r.valence, r.dominance) for r in got] == [("/data/x.wav", 1.0, None), ("/y.wav", 3.0, None)]
    p.write_text("file,who,emo,V,A\nx.wav,s1,joy,inf,2\n")
    with pytest.raises(ValueError):
        R.read_annotations(spark, str(p), names, "/data")
    p.write_text("file,who,emo,V\nx.wav,s1,joy,1\n")
    with pytest.raises(ValueError, match="no column"):
        R.read_annotations(spark, str(p), names, "/data")


def test_text_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("/root\na/b.wav\t320\n\nc.wav\t5\n")
    assert [(r.path, r.n_samples) for r in R.read_manifest(spark, str(tmp_path / "m.tsv")).orderBy("utt_idx").collect()] == [("/root/a/b.wav", 320), ("/root/c.wav", 5)]
    (tmp_path / "e.txt").write_text("% head\n[1]\tSes01F_x\texc\t[1]\nC-E1\tSes\n[1]\tSes01F_y\tneu\t[2]\n")
    assert [(r.utt_id, r.label) for r in R.read_evaluations(spark, str(tmp_path / "*.txt"), ("hap", "sad")).collect()] == [("Ses01F_x", "hap")]
    df = spark.createDataFrame([(1, "b", "sad", 0.5, 0.0), (0, "a", "hap", 1.0, 0.5), (2, "c", None, 0.0, 0.0)], "utt_idx long, utt_id string, label string, valence double, arousal double")
    assert R.write_labels(df, str(tmp_path / "emo"), str(tmp_path / "va")) == {"written": 2, "skipped": 1}
    assert [r.value for r in spark.read.text(str(tmp_path / "emo")).collect()] == ["a\thap", "b\tsad"]
    R.save_model(spark, {"head.w": np.eye(2)}, {"labels": ["x"]}, str(tmp_path / "model"))
    w, meta = R.load_model(spark, str(tmp_path / "model"))
    assert (w["w"] == np.eye(2)).all() and meta == {"labels": ["x"]}
    assert R.write_json({"b": 1, "a": "é"}) == '{\n  "a": "é",\n  "b": 1\n}\n'


def test_stream_scores_like_a_batch(spark, tmp_path):
    from affectra.streaming.scoring import score_stream, scored

    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)], "utt_id long, feat array<float>")
    df.write.parquet(str(tmp_path / "in"))
    w, labels = [[1.0, 0.0], [0.0, 1.0]], ["p", "q"]
    q = score_stream(spark, str(tmp_path / "in"), w, labels, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(scored(df, w, labels).collect())


def trained_head(x, y, fit, held, epochs=30, rate=0.05):
    """Weights of the epoch of least loss on the rows held out, by plain loops."""
    x1, w, opt, best = np.hstack([x, np.ones((len(x), 1))]), np.zeros((x.shape[1] + 1, 3)), H.Adam((x.shape[1] + 1, 3), rate), (np.inf, None)
    for _ in range(epochs):
        p = np.exp(x1 @ w)
        p /= p.sum(axis=1, keepdims=True)
        loss = -np.log(p[np.arange(len(y)), y])
        if loss[held].mean() < best[0]:
            best = loss[held].mean(), w.copy()
        p[np.arange(len(y)), y] -= 1
        w = opt.step(w, x1[fit].T @ p[fit] / fit.sum())
    return best[1]


def test_folds_train_on_rows_of_many_tasks(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(200, 4)), r.integers(0, 3, 200)
    x[np.arange(200), y] += 2
    fold = np.arange(200) % 5
    rows = spark.createDataFrame([(v.tolist(), int(c), int(f)) for v, c, f in zip(x, y, fold, strict=True)], "feat array<double>, true_class int, fold long").repartition(7)
    got = H.train_folds(rows, 3)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()  # no fold meets in one task
    held = np.array([r.v for r in spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "x array<double>, y int").select((F.pmod(F.xxhash64("x", "y"), F.lit(5)) == 0).alias("v")).collect()])
    assert 20 < held.sum() < 60
    for k, part in got.toPandas().groupby("fold"):
        _, plain = fit_class_head(x[(fold != k) & ~held], y[(fold != k) & ~held], 3)
        part = part.sort_values("epoch")
        assert np.allclose(part.train_loss, [h["train"] for h in plain]) and not np.allclose(part.train_loss, part.valid_loss)
        w = trained_head(x, y, (fold != k) & ~held, (fold != k) & held)
        right = (np.hstack([x[fold == k], np.ones((40, 1))]) @ w).argmax(axis=1) == y[fold == k]
        assert np.allclose(part.test_wa, right.mean())
    assert H.train_folds(rows.limit(0), 3).count() == 0 and set(H.train_folds(rows.where("fold < 2"), 3, epochs=2).toPandas().fold) == {0, 1}


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_quartiles_of_many_ranges(spark, many_ranges):
    from affectra.operators import profile as P

    r = np.random.default_rng(2)
    a, b = r.normal(size=701), r.integers(0, 5, 701)
    df = spark.createDataFrame([(float(u), int(v) if v else None, None) for u, v in zip(a, b, strict=True)], "a double, b int, c double")
    got = {x["column"]: x for x in P.describe(df, ["a", "b", "c"]).collect()}
    for c, v in (("a", a), ("b", b[b > 0])):
        assert np.allclose([got[c].q25, got[c].q50, got[c].q75], np.quantile(v, [0.25, 0.5, 0.75])) and got[c].n == len(v)
    assert got["c"].n == 0 and got["c"].q50 is None
    assert "percentile(" not in P.describe(df, ["a"])._jdf.queryExecution().toString()
    got = P.order_statistics(df, ["a", "b", "c"], lambda total: [F.lit(0), total - 1, total, F.lit(-1), F.floor(total / 3)]).collect()
    assert {x["column"]: tuple(x)[1:] for x in got} == {c: (len(v), v[0], v[-1], None, None, v[len(v) // 3]) for c, v in (("a", sorted(a.tolist())), ("b", sorted(b[b > 0].tolist())))}


def test_shares_of_rows_are_floors(spark, many_ranges):
    for n, share in ((0, 0.8), (1, 0.8), (9, 0.8), (101, 0.8), (7, 0.0), (7, 1.0)):
        got = S.train_share(spark.range(n), "id", 3, share).collect()
        assert sum(r.split == "train" for r in got) == int(share * n) and len(got) == n and all(r.leaky for r in got)
    df = spark.range(500)
    pick = lambda seed: {r.id for r in S.train_share(df, "id", seed).where("split = 'valid'").collect()}
    assert pick(1) == pick(1) != pick(2)
    with pytest.raises(ValueError, match="share"):
        S.train_share(df, "id", 1, 1.5)


def test_epoch_orders_are_seeded(spark):
    df = spark.range(300).repartition(5)
    order = lambda seed, epoch: [r.id for r in S.epoch_order(df, "id", seed, epoch).collect()]
    assert order(1, 1) == order(1, 1) and len({tuple(order(s, e)) for s, e in ((1, 1), (1, 2), (2, 1))}) == 3 and sorted(order(1, 2)) == list(range(300))


def test_one_csv_file_replaces_another_when_it_is_whole(spark, tmp_path):
    path = str(tmp_path / "made" / "p.csv")
    df = spark.createDataFrame([(i, f"x,{i}\n", "") for i in range(50)], "a long, b string, warning string").repartition(7)
    R.write_csv(df, path, ["a"])
    first = (tmp_path / "made" / "p.csv").read_text("utf-8-sig")
    assert first.splitlines()[0] == "a,b,warning" and pd.read_csv(path, keep_default_na=False).a.tolist() == list(range(50))
    broken = df.withColumn("a", F.when(F.col("a") < 49, F.col("a")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        R.write_csv(broken, path)
    assert (tmp_path / "made" / "p.csv").read_text("utf-8-sig") == first and len([f for f in (tmp_path / "made").iterdir() if not f.name.startswith(".")]) == 1
    R.write_csv(df.limit(0), path)
    assert (tmp_path / "made" / "p.csv").read_bytes() == "\ufeffa,b,warning\n".encode()


def test_speaker_split_has_exact_shares_and_no_table_of_speakers(spark):
    df = spark.range(3000).selectExpr("concat('s', id % 300) as speaker", "id % 7 as emotion")
    got = S.by_speaker(df, "speaker", "emotion", 0.2, 0.1, seed=3)
    assert {x.split: x.n for x in got.groupBy("split").agg(F.count_distinct("speaker").alias("n")).collect()} == {"test": 30, "valid": 60, "train": 210}
    assert got.count() == 3000 and "Join" not in got._jdf.queryExecution().toString()


def test_nan_predictions_show(spark):
    df = spark.createDataFrame([(0.1, 0.2), (float("nan"), 0.4), (0.5, float("nan")), (0.3, None)], "p double, t double")
    r = df.agg(M.ccc("p", "t").alias("c"), M.mae("p", "t").alias("m"), M.ccc_loss([("p", "t")]).alias("l")).first()
    assert all(x != x for x in r)
    assert df.where("not isnan(p)").agg(M.mae("p", "t")).first()[0] == pytest.approx(0.1)


def test_an_empty_last_line_is_refused(spark, prefix):
    for name, read in (("lengths", R.read_lengths), ("vad", R.read_vad), ("emo", R.read_emotions)):
        p = prefix / f"a.{name}"
        assert read(spark, str(p)).count() == 3
        p.write_text(p.read_text() + "\n")
        with pytest.raises(ValueError):
            read(spark, str(p))


def test_norms_of_long_rows(spark):
    x = np.random.default_rng(1).normal(size=160_000)
    df = spark.createDataFrame([(x.tolist(),), ([2.0, 2.0],), (None,)], "x array<double>")
    got = [r[0] for r in df.select(A.layer_norm(F.col("x"))).collect()]
    assert np.allclose(got[0], (x - x.mean()) / np.sqrt(x.var() + 1e-5)) and got[1] == [0.0, 0.0] and got[2] is None
    p = [r[0] for r in df.select(A.softmax(F.col("x"))).collect()]
    assert np.allclose(p[0], np.exp(x - x.max()) / np.exp(x - x.max()).sum()) and p[1] == [0.5, 0.5] and p[2] is None


@pytest.mark.parametrize("seed", [1, 7, 42])
def test_drawn_splits_are_the_known_ones(spark, seed):
    import random

    rows = [(f"s{i % 10}", "xyz"[i % 3], i) for i in range(90)]
    got = S.by_speaker_drawn(spark.createDataFrame(rows, "s string, e string, i long"), "s", "e", seed=seed)
    order = sorted({r[0] for r in rows})
    random.Random(seed).shuffle(order)
    want = {s: "valid" if k < 2 else "test" if k < 4 else "train" for k, s in enumerate(order)}
    assert {r.s: r.split for r in got.collect()} == want and got.count() == 90
    index = np.arange(90)
    np.random.default_rng(seed).shuffle(index)
    split = {r.i: r.split for r in S.by_row_drawn(spark.createDataFrame(rows, "s string, e string, i long"), "i", seed=seed).collect()}
    assert [split[i] for i in index] == ["test"] * 9 + ["val"] * 9 + ["train"] * 72


@pytest.mark.parametrize(("n", "block"), [(5, 1), (65, 64), (3000, 256)])
def test_drawn_rows_beyond_the_list(spark, monkeypatch, n, block):
    monkeypatch.setattr(S, "LISTED", 3)
    monkeypatch.setattr(S, "DRAWN", block)
    index = np.arange(n)
    np.random.default_rng(7).shuffle(index)
    with S.Tables(spark) as tables:
        place = {r.row: r.place for r in S._drawn_places(spark, n, 7, tables).collect()}
    assert [place[i] for i in index] == list(range(n)) and len(place) == n
    split = {r.id: r.split for r in S.by_row_drawn(spark.range(n), "id", seed=7).collect()}
    held = max(1, round(n * 0.1))
    assert [split[i] for i in index] == ["test"] * held + ["val"] * held + ["train"] * (n - 2 * held)


@pytest.mark.parametrize("n", [0, 2, 3, 4, 10])
def test_row_splits_have_exact_numbers(spark, n):
    got = S.by_row(spark.range(n), "id", 0.2, seed=3, test=0.2).groupBy("split").count().collect()
    want = {0: {}, 2: {"train": 2}, 3: {"train": 2, "test": 1}, 4: {"train": 2, "valid": 1, "test": 1}, 10: {"train": 6, "valid": 2, "test": 2}}
    assert {r.split: r["count"] for r in got} == want[n]


def test_running_sums_in_levels(spark, monkeypatch):
    from affectra.operators import offsets as O

    monkeypatch.setattr(O, "BLOCK", 4)
    df = spark.range(300).selectExpr("id * 3 as utt_idx", "id % 7 as n_frames")
    for levels in (0, 1, 3):
        got = [r.frame_offset for r in O.offsets(df, levels=levels).orderBy("utt_idx").collect()]
        assert got == np.concatenate([[0], np.cumsum(np.arange(300) % 7)[:-1]]).tolist()


def test_vad_heads_from_sums(spark):
    r = np.random.default_rng(4)
    x, w = r.normal(size=(120, 5)), r.normal(size=(6, 3))
    t = np.hstack([x, np.ones((120, 1))]) @ w + 0.1 * r.normal(size=(120, 3))
    t[:, 2] = np.nan
    rows = [(u.tolist(), *map(float, v)) for u, v in zip(x, t, strict=True)]
    df = spark.createDataFrame(rows, "feat array<double>, valence double, arousal double, dominance double").repartition(4)
    before = {d: r.normal(size=6) for d in M.DIMS}
    got, history = H.train_vad_heads(df, df, epochs=200, before=before, decay=0.1)
    assert (got["dominance"] == before["dominance"]).all() and history[0]["dominance_loss_skipped"]
    assert history[-1]["train_loss"] < 0.2 < history[0]["train_loss"]
    c, g = H.ccc_from_moments(got["valence"], H.vad_moments(df)["valence"])
    p = np.hstack([x, np.ones((120, 1))]) @ got["valence"]
    want, dp = H.ccc_and_gradient(p, t[:, 0])
    assert c == pytest.approx(want) and np.allclose(g, np.hstack([x, np.ones((120, 1))]).T @ dp)
    with pytest.raises(ValueError):
        H.train_vad_heads(df.withColumns({"valence": F.lit(None), "arousal": F.lit(None)}), df)


def test_optimisers():
    w = np.array([3.0, -2.0])
    opt = H.RMSprop(2, 0.01)
    v, b, want = np.zeros(2), np.zeros(2), w.copy()
    for k in range(5):
        w = opt.step(w, 2 * w)
        g = 2 * want
        v, b = 0.99 * v + 0.01 * g * g, 0.9 * b + g / (np.sqrt(0.99 * v + 0.01 * g * g) + 1e-8)
        want = want - 0.01 * b
        assert np.allclose(w, want), k
    assert [H.cyclic_rate(i, 0.0, 1.0, 2) for i in range(6)] == [0, 0.5, 1, 0.5, 0, 0.5]


def test_sinks_and_probes(spark, tmp_path):
    with pytest.raises(ValueError, match="no .wav"):
        (tmp_path / "none").mkdir()
        R.wav_folder(spark, str(tmp_path / "none"))
    _wav(tmp_path / "b.wav", bytes(640))
    _wav(tmp_path / "a.wav", bytes(9), 3)
    (tmp_path / "c.wav").write_bytes(b"junk")
    assert [r.path[-5:] for r in R.wav_folder(spark, str(tmp_path)).collect()] == ["a.wav", "b.wav", "c.wav"]
    probed = {r.path[-5]: r for r in R.probe_wavs(spark, str(tmp_path)).collect()}
    assert (probed["a"].sample_width, probed["a"].n_samples, probed["b"].n_samples, probed["b"].sample_rate) == (3, 3, 320, 16000) and probed["c"].error
    with pytest.raises(ValueError, match="a.wav: sample width; .*c.wav"):
        R.refuse_bad_audio(R.read_wavs(spark, str(tmp_path)))
    rows = spark.createDataFrame([(str(tmp_path / "b.wav"),), ("/no/d.wav",), ("/no/c.wav",)], "path string")
    assert [r.path for r in R.missing_audio(rows, "path", R.wav_folder(spark, str(tmp_path))).collect()] == ["/no/c.wav", "/no/d.wav"]
    assert R.attach_cache_paths(spark.createDataFrame([("k",)], "cache_key string"), "/c/").first().cache_path == "/c/k.npy"
    m = spark.createDataFrame([(1, "/r/b.wav", 5), (0, "/r/x/a.wav", 4)], "utt_idx long, path string, n_samples long")
    R.write_manifest(m, "/r", str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["/r", "x/a.wav\t4", "b.wav\t5"]
    assert [r.utt_idx for r in R.joined_sessions([m, m]).orderBy("utt_idx").collect()] == [0, 1, 2, 3]
    R.write_csv(spark.createDataFrame([("é", 1.5)], "a string, b double"), str(tmp_path / "t.csv"))
    text = (tmp_path / "t.csv").read_bytes()
    assert text == "\ufeffa,b\né,1.5\n".encode() and R.read_csv(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    to = R.write_normalized(spark.createDataFrame([(1.0,), (5.0,)], "v double"), ["v"], str(tmp_path / "n.csv"))
    assert to.endswith("n_normalized.csv") and sorted(r.v for r in R.read_csv(spark, to).collect()) == ["0.0", "1.0"]
    (tmp_path / "wav.scp").write_text("u1 /a b.wav\nu2 /c.wav\n")
    assert [tuple(r) for r in R.read_scp(spark, str(tmp_path / "wav.scp")).orderBy("utt_idx").collect()] == [(0, "u1", "/a b.wav"), (1, "u2", "/c.wav")]
    assert R.read_lenient_labels(spark, None).count() == 0
    assert spark.range(1).select(T.relative(F.lit("/a.b/c"), "/a.b"), T.relative(F.lit("/axb/c"), "/a.b")).first()[:] == ("c", "axb/c")


def test_saved_models_and_arguments(spark, tmp_path):
    from affectra.operators import payloads as Y

    config = {"input_dim": 2, "hidden_dim": 4, "class_labels": ["a", "b"]}
    heads = {"emotion": np.ones((2, 3)), **{d: np.ones((1, 3)) for d in M.DIMS}}
    R.save_parallel(spark, heads, config, str(tmp_path / "m"))
    w, meta = R.load_model(spark, str(tmp_path / "m"))
    assert (w["emotion"] == 1).all() and Y.HeadsConfig.of(meta).continues(4, ["a", "b"]).num_classes == 2
    for hidden, labels in ((5, ["a", "b"]), (4, ["b", "a"])):
        with pytest.raises(ValueError):
            Y.HeadsConfig.of(meta).continues(hidden, labels)
    with pytest.raises(ValueError, match="valence"):
        R.save_parallel(spark, heads | {"valence": np.ones((1, 9))}, config, str(tmp_path / "x"))
    for bad in ({"model_type": "other"}, {"num_classes": 3}, {"dominance_status": "guessed"}, {"class_names": ["a"]}):
        with pytest.raises(ValueError):
            Y.HeadsConfig.of({"model_type": Y.KIND} | config | bad)
    Y.check_training_arguments(0, 1, 1, 1, 0.1)
    with pytest.raises(ValueError, match="both loss weights 0; epochs"):
        Y.check_training_arguments(0, 0, 0, 1, 0.1)
    for args in (("d", None, "h", False), (None, None, None, False)):
        with pytest.raises(ValueError):
            Y.check_inference_arguments(*args)
    history = [{"epoch": 1, "v": 0.5}, {"epoch": 2, "v": 0.4}, {"epoch": 3, "v": 0.4}]
    s = Y.training_summary(history, "v", ["a"], {"valence": 2, "arousal": 2, "dominance": 0}, "untrained", "out")
    assert s["saved_epoch"] == 2 and s["supervised_dimensions"] == ["valence", "arousal"] and s["valid"]["v"] == 0.4
    df = spark.createDataFrame([(1, [0.1, 0.2])], "k int, v array<double>")
    V.same_shape(df, df, "v", "v", "k")
    with pytest.raises(V.DataError):
        V.same_shape(df, df.withColumn("v", F.slice("v", 1, 1)), "v", "v", "k")
    with pytest.raises(V.DataError, match="train"):
        V.not_empty(df.limit(0), "train")


def test_extraction_and_samples(spark, tmp_path):
    assert R.spectral([]).shape == (1, 768) and not R.spectral([]).any() and R.spectral([1.0] * 401).shape == (2, 768)
    _wav(tmp_path / "a.wav", np.linspace(-8000, 9000, 800).astype("<i2").tobytes())
    seen = R.extract(R.read_wavs(spark, str(tmp_path)), lambda s: [[float(s.mean()), float(s.std())]], normalise=True).first()
    assert seen.feat == pytest.approx([0, 1], abs=1e-3)
    for k, n in ((0, 0), (7, 7), (50, 50), (90, 60)):
        got = S.exact_sample(spark.range(60), "id", k, seed=2)
        assert got.count() == n == got.distinct().count()


def test_prepared_labels_and_their_csv(spark, tmp_path):
    (tmp_path / "v.csv").write_text("\ufefffile,V,A,extra\nx.wav,0.5,,1\n/y.wav,bad,1,2\n", encoding="utf-8")
    names = {"file_path": "file", "valence": "V", "arousal": "A"}
    with pytest.warns(UserWarning, match="dominance, split, session"):
        got = R.read_vad_csv(spark, str(tmp_path / "v.csv"), "/data", names)
    assert got.columns == list(T.PREPARED)
    rows = got.orderBy(F.desc("file_path")).collect()
    assert [r.file_path for r in rows] == ["/y.wav", "/data/x.wav"] and rows[1].valence == 0.5 and rows[0].arousal == 1 and rows[0].split is None
    assert all(np.isnan(x) for x in (rows[0].valence, rows[1].arousal, rows[0].dominance))
    with pytest.raises(ValueError, match="no column file_path"):
        R.read_vad_csv(spark, str(tmp_path / "v.csv"))
    (tmp_path / "b.csv").write_text("file_path,valence\n,1\n")
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="without file_path"):
        R.read_vad_csv(spark, str(tmp_path / "b.csv"))


def test_more_sample_formats():
    def riff(kind, bits, data, channels=1, rate=16000, wide=False):
        form = struct.pack("<HHIIHH", 0xFFFE if wide else kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
        form += struct.pack("<HHIH", 22, bits, 0, kind) + bytes(14) if wide else b""
        body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"junk" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
        return b"RIFF" + struct.pack("<I", len(body)) + body

    x = np.array([-1.0, -0.5, 0.0, 0.25, 0.75])
    for wide in (False, True):
        for bits in (8, 16, 24, 32):
            whole = (x * 2 ** (bits - 1)).astype(np.int64)
            data = (whole + 128).astype(np.uint8).tobytes() if bits == 8 else b"".join(int(v).to_bytes(bits // 8, "little", signed=True) for v in whole)
            assert R.decode_sound(riff(1, bits, data, wide=wide))["samples"] == x.tolist(), bits
            if bits in (8, 16, 32) and not wide:
                assert R.decode_sound(riff(1, bits, data)) == R.decode_wav(riff(1, bits, data))
        for bits in (32, 64):
            assert R.decode_sound(riff(3, bits, x.astype(f"<f{bits // 8}").tobytes(), wide=wide))["samples"] == x.tolist()
    assert [R.decode_sound(c).get("error") for c in (riff(1, 12, b"ab"), riff(1, 16, b"abcd", 2), riff(1, 16, b"ab", rate=8000), riff(1, 16, b""))] == ["sample format", "not mono", "sample rate", "empty"]
    assert all("unreadable" in R.decode_sound(c)["error"] for c in (b"", b"RIFF", riff(1, 16, b"ab")[:40], b"RIFF0000WAVEdata\2\0\0\0ab"))


def test_slices_of_frames_and_duplicates(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 1, 2), ([1, 2], 1, 5), ([1], 3, 1), ([7], 0, 0)], "x array<int>, o long, n long")
    assert [r[0] for r in df.select(A.frame_slice(F.col("x"), F.col("o"), F.col("n"))).collect()] == [[2, 3], [2], [], []]
    from affectra.operators import profile as P

    assert {r["column"]: r.duplicated for r in P.duplicated(spark.createDataFrame([(1, "a", None), (2, "a", None), (None, "b", 3)], "k int, s string, t int"), ["k", "s", "t"]).collect()} == {"k": False, "s": True, "t": False}
