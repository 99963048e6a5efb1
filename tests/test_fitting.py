"""Networks: gradients against finite differences, and training over tasks against the same steps in one array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affectra.functions.storage import Tables
from affectra.operators import fitting as G
from affectra.operators import networks as N
from affectra.operators import train as H

NETWORKS = {
    "separate": N.separate_heads(4, 6, 5),
    "shared": N.vad_head(width=6, hidden=5),
    "mediated": N.mediated_heads(4, width=6, hidden=5),
    "frames": N.frame_classifier(4, 6, 5),
    "bounded": N.bounded_regressor(6, 5, 0.3),
    "attentive": N.attentive_decoder(4, 6, 5),
}
RAGGED = ("frames", "bounded", "attentive")


def table(seed=0, n=40, width=6, ragged=False, dominance=True, classes=4):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = r.normal(size=(r.integers(1, 5) if ragged else 1, width))
        v, a, d = np.tanh(x.mean(axis=0)[:3] + 0.1 * r.normal(size=3))
        out.append((i, x.tolist() if ragged else x[0].tolist(), float(v), float(a) if i % 7 else None, float(d) if dominance and i % 3 else None, int(r.integers(0, classes)) if i % 11 else None))
    return out


def frame(spark, rows, ragged=False):
    return spark.createDataFrame(rows, f"utt_id long, feat array<{'array<double>' if ragged else 'double'}>, valence double, arousal double, dominance double, class_idx int")


def arrays(rows, network):
    """What a batch of all rows is for a network."""
    x = [np.array(r[1]).reshape(-1, network.width) for r in rows]
    at = {"valence": 2, "arousal": 3, "dominance": 4}
    t = np.array([[np.nan if r[at[d]] is None else r[at[d]] for d in network.dims] for r in rows]).reshape(len(rows), len(network.dims))
    y = np.array([-1 if r[5] is None else r[5] for r in rows])
    return np.concatenate(x), N.Rows(np.array([len(a) for a in x]), np.arange(len(x), dtype=np.uint64)), t, y


def plain_loss(network, w, x, rows, t, y, lambda_vad, lambda_emo):
    """The loss as its definition says, with NumPy over whole columns."""
    p, z, _ = network.predict(w, x, rows)
    losses = []
    for j, d in enumerate(network.dims):
        ok = np.isfinite(t[:, j])
        if ok.sum() >= (2 if d == "dominance" else 1):
            a, b = p[ok, j], t[ok, j]
            losses.append(1 - 2 * ((a - a.mean()) * (b - b.mean())).mean() / (a.var() + b.var() + (a.mean() - b.mean()) ** 2 + 1e-8))
    ce = 0.0
    if z.shape[1] and (y >= 0).any():
        k = z[y >= 0]
        ce = (np.log(np.exp(k).sum(axis=1)) - k[np.arange(len(k)), y[y >= 0]]).mean()
    return lambda_vad * (np.mean(losses) if losses else 0.0) + lambda_emo * ce, np.mean(losses) if losses else 0.0, ce


def plain_gradient(network, w, data, lambda_vad, lambda_emo, h=1e-6):
    out = {}
    for k, v in w.items():
        g = np.zeros_like(v)
        for i in np.ndindex(v.shape):
            up, down = dict(w), dict(w)
            up[k], down[k] = v.copy(), v.copy()
            up[k][i] += h
            down[k][i] -= h
            g[i] = (plain_loss(network, up, *data, lambda_vad, lambda_emo)[0] - plain_loss(network, down, *data, lambda_vad, lambda_emo)[0]) / (2 * h)
        out[k] = g
    return out


@pytest.mark.parametrize("name", NETWORKS)
def test_gradients_by_finite_differences(spark, name):
    network, ragged = NETWORKS[name], name in RAGGED
    rows = table(3, 17, ragged=ragged)
    w = network.start(5)
    passes = G.Passes(network, 0.7, 0.3)
    with Tables(spark) as tables:
        data = G.prepared(frame(spark, rows, ragged).repartition(3), network, tables, "utt_id", "feat", "class_idx")
        now = passes.measured(data, w)
        x, r, t, y = arrays(rows, network)
        assert np.allclose([now.loss, now.vad_loss, now.emotion_loss], plain_loss(network, w, x, r, t, y, 0.7, 0.3), atol=1e-12)
        got = passes.gradients(data, w, now, None)
    want = plain_gradient(network, w, (x, r, t, y), 0.7, 0.3)
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], atol=2e-7), k


def whole_run(network, rows, epochs, rate, decay, lambda_vad, lambda_emo, w, dominance=True):
    """Full-batch AdamW in one array: the steps that fit() spreads over tasks."""
    x, r, t, y = arrays(rows, network)
    w, state, losses = dict(w), {}, []
    for _ in range(epochs):
        losses.append(plain_loss(network, w, x, r, t, y, lambda_vad, lambda_emo))
        p, z, saved = network.predict(w, x, r)
        dp, dz = np.zeros_like(p), np.zeros_like(z)
        counted = [j for j, d in enumerate(network.dims) if np.isfinite(t[:, j]).sum() >= (2 if d == "dominance" else 1)]
        for j in counted:
            ok = np.isfinite(t[:, j])
            dp[ok, j] = -lambda_vad * H.ccc_and_gradient(p[ok, j], t[ok, j])[1] / len(counted)
        ok = y >= 0
        e = np.exp(z[ok] - z[ok].max(axis=1, keepdims=True))
        e /= e.sum(axis=1, keepdims=True)
        e[np.arange(ok.sum()), y[ok]] -= 1
        dz[ok] = lambda_emo * e / ok.sum()
        g = network.gradients(w, saved, dp, dz)
        for k in w:
            if dominance or not k.startswith("dominance_head"):
                w[k] = state.setdefault(k, H.Adam(w[k].shape, rate, decay)).step(w[k], g[k])
    return w, losses


def test_separate_heads_of_width_256_as_in_one_array(spark):
    network = N.separate_heads(4, 12, 256)
    rows = table(1, 60, 12)
    start = network.start(9)
    got = G.fit(frame(spark, rows).repartition(5), None, network, 3, 1e-2, weights=start, decay=0.05)
    want, losses = whole_run(network, rows, 3, 1e-2, 0.05, 1, 1, start)
    assert all(np.allclose(got.weights[k], want[k], rtol=0, atol=1e-9) for k in want)
    assert np.allclose([[h["train"][k] for k in ("loss", "vad_loss", "emotion_loss")] for h in got.history], losses, rtol=0, atol=1e-9)
    assert got.selection == "final" and got.label_counts["dominance"] == sum(r[4] is not None for r in rows)
    assert all(not np.array_equal(got.weights[k], start[k]) for k in start)


def test_dominance_without_labels_stays_bit_for_bit(spark):
    network = N.separate_heads(4, 6, 5)
    start = network.start(2)
    for rows in (table(4, 30, dominance=False), [(*r[:4], 0.5 if i == 1 else None, r[5]) for i, r in enumerate(table(4, 30))]):
        got = G.fit(frame(spark, rows).repartition(2), None, network, 2, 0.05, weights=start, decay=0.1)
        want, _ = whole_run(network, rows, 2, 0.05, 0.1, 1, 1, start, dominance=False)
        for k in start:
            assert np.array_equal(got.weights[k], start[k]) == k.startswith("dominance_head"), k
            assert np.allclose(got.weights[k], want[k], rtol=0, atol=1e-9)
        assert [h["train"]["dominance_loss_batches"] for h in got.history] == [0, 0]


def test_targets_without_mark_have_no_effect(spark):
    network = N.separate_heads(4, 6, 5)
    w = network.start(1)
    rows = table(6, 20)
    passes = G.Passes(network, 1, 1)
    with Tables(spark) as tables:
        first = passes.measured(G.prepared(frame(spark, rows), network, tables, "utt_id", "feat", "class_idx"), w)
        moved = frame(spark, rows).withColumn("dominance", F.when(F.col("dominance").isNotNull(), F.col("dominance")).otherwise(float("nan")))
        assert passes.measured(G.prepared(moved, network, tables, "utt_id", "feat", "class_idx"), w) == first


@pytest.mark.parametrize("weights", [(1.0, 1.0), (0.3, 2.0), (1.0, 0.0)])
def test_joint_loss_of_mediated_heads(spark, weights):
    network = NETWORKS["mediated"]
    rows = [r for r in table(2, 50) if None not in r]
    start = network.start(3)
    got = G.fit(frame(spark, rows).repartition(3), frame(spark, rows[:20]), network, 3, 2e-2, weights=start, decay=0.0, lambda_vad=weights[0], lambda_emo=weights[1], select="accuracy", largest=True)
    want, losses = whole_run(network, rows, 3, 2e-2, 0.0, *weights, start)
    assert np.allclose([[h["train"][k] for k in ("loss", "vad_loss", "emotion_loss")] for h in got.history], losses, rtol=0, atol=1e-9)
    scores = [h["valid"]["accuracy"] for h in got.history]
    assert got.saved_epoch == 1 + scores.index(max(scores)) and got.selection == "best_valid_accuracy"
    if got.saved_epoch == 3:
        assert all(np.allclose(got.weights[k], want[k], rtol=0, atol=1e-9) for k in want)


def test_small_batches_hold_each_row_once_an_epoch(spark):
    rows = table(5, 43)
    network = NETWORKS["separate"]
    with Tables(spark) as tables:
        data = G.prepared(frame(spark, rows).repartition(4), network, tables, "utt_id", "feat", "class_idx")
        seen = {}
        for epoch in (1, 2, 1):
            parts = [sorted(r.i for r in b.collect()) for b in G.batches(data, 43, 8, 7, epoch, tables)]
            assert [len(p) for p in parts] == [8, 8, 8, 8, 8, 3] and sorted(sum(parts, [])) == sorted(r.i for r in data.collect())
            assert seen.setdefault(epoch, parts) == parts
        assert seen[1] != seen[2]
    got = G.fit(frame(spark, rows).repartition(4), None, network, 2, 1e-2, batch_size=16)
    again = G.fit(frame(spark, rows).repartition(4), None, network, 2, 1e-2, batch_size=16)
    assert [h["train"]["num_batches"] for h in got.history] == [3, 3]
    assert all(np.array_equal(got.weights[k], again.weights[k]) for k in got.weights)


def test_two_stages(spark):
    network = NETWORKS["attentive"]
    rows = table(8, 40, ragged=True)
    df = frame(spark, rows, True).repartition(3)
    start = network.start(42)
    got = G.fit_two_stages(df, df, network, (3, 3), 5e-2, 1e-3, 5e-2, feat="feat")
    first, second = [h for h in got.history if h["stage"] == 1], [h for h in got.history if h["stage"] == 2]
    assert len(first) == len(second) == 3 and first[-1]["valid"]["vad_loss"] < first[0]["train"]["vad_loss"]
    # the first stage in one array, its classifier untouched
    x, r, t, y = arrays(rows, network)
    w, state, losses = dict(start), {}, []
    states = []
    for _ in range(3):
        p, z, saved = network.predict(w, x, r)
        dp = np.zeros_like(p)
        for j in range(3):
            ok = np.isfinite(t[:, j])
            dp[ok, j] = -H.ccc_and_gradient(p[ok, j], t[ok, j])[1] / 3
        g = network.gradients(w, saved, dp, np.zeros_like(z))
        w = {k: v if k.startswith("classifier") else state.setdefault(k, H.Adam(v.shape, 5e-2)).step(v, g[k]) for k, v in w.items()}
        losses.append(plain_loss(network, w, x, r, t, y, 1, 0)[0])
        states.append(w)
    assert np.allclose([h["valid"]["loss"] for h in first], losses, rtol=0, atol=1e-9)
    # the second starts from the best state of the first
    best = states[int(np.argmin(losses))]
    assert second[0]["train"]["emotion_loss"] == pytest.approx(plain_loss(network, best, x, r, t, y, 0, 1)[2], abs=1e-9)
    scores = [h["valid"]["accuracy"] for h in second]
    assert got.saved_epoch == 1 + scores.index(max(scores)) and got.selection == "best_valid_accuracy"


KILLED = """
import os, signal, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from affectra.operators import fitting as G
from tests.test_fitting import NETWORKS, frame, table
spark = SparkSession.builder.master("local[3,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
network = NETWORKS["bounded"]
df = frame(spark, table(9, 30, ragged=True), True).repartition(3)
def fitted():
    return G.fit(df, None, network, 2, 1e-2, weights=network.start(1), optimizer="adam", label=None, lambda_emo=0.0).weights
plain, real, killed = fitted(), G._gradient, spark.sparkContext.accumulator(0)
def once(*args):
    at = TaskContext.get()
    if at.partitionId() == 0 and at.attemptNumber() == 0:
        os.kill(os.getpid(), signal.SIGKILL)
    killed.add(at.attemptNumber())
    return real(*args)
G._gradient = once
again = fitted()
print("EQUAL", all((plain[k] == again[k]).all() for k in plain), killed.value > 0)
"""


def test_weights_are_the_same_after_a_killed_and_repeated_task():
    import os
    import subprocess
    import sys
    from pathlib import Path

    top = str(Path(__file__).resolve().parents[1])
    got = subprocess.run([sys.executable, "-c", KILLED], capture_output=True, text=True, timeout=300, cwd=top, env={**os.environ, "PYTHONPATH": top})
    assert "EQUAL True True" in got.stdout, got.stderr[-2000:]


def test_dropout_drops_its_share_and_nothing_in_evaluation():
    layer = N.Dropout(0, 0.25)
    x = np.ones((4000, 16))
    rows = lambda draw: N.Rows(np.ones(4000, dtype=int), np.arange(4000, dtype=np.uint64), draw)
    y, kept = layer.forward({}, x, rows(5))
    assert abs((y == 0).mean() - 0.25) < 0.01 and np.allclose(y[y > 0], 1 / 0.75) and abs(y.mean() - 1) < 0.02
    assert np.array_equal(layer.forward({}, x, rows(5))[0], y) and not np.array_equal(layer.forward({}, x, rows(6))[0], y)
    assert np.array_equal(layer.forward({}, x, rows(None))[0], x) and np.array_equal(layer.backward({}, kept, x, {}), y)
    assert not np.array_equal(N.Dropout(1, 0.25).forward({}, x, rows(5))[0], y)
    half = layer.forward({}, x[2000:], N.Rows(np.ones(2000, dtype=int), np.arange(2000, 4000, dtype=np.uint64), 5))[0]
    assert np.array_equal(half, y[2000:])


def test_other_optimizers_rates_and_frozen_parts(spark):
    network = NETWORKS["mediated"]
    df = frame(spark, table(1, 30)).repartition(2)
    start = network.start(0)
    got = G.fit(df, df, network, 2, optimizer="rmsprop", weights=start, schedule=lambda e: H.cyclic_rate(e, 1e-4), frozen=("classifier",))
    assert all(np.array_equal(got.weights[k], start[k]) == k.startswith("classifier") for k in start)
    still = G.fit(df, None, network, 1, {"": 0.0, "classifier": 1e-2}, optimizer="adam", weights=start)
    assert all(np.array_equal(still.weights[k], start[k]) != k.startswith("classifier") for k in start)
    rows = G.history_table(df, got.history, run_id="a").collect()
    assert {(r.part, r.epoch) for r in rows} == {(p, e) for p in ("train", "valid") for e in (1, 2)} and {r.run_id for r in rows} == {"a"}


def test_faults_are_named(spark):
    network = NETWORKS["separate"]
    df = frame(spark, table(1, 5))
    for kw, text in (({"epochs": 0}, "epochs"), ({"batch_size": 0}, "batch_size"), ({"lambda_vad": 0, "lambda_emo": 0}, "weights"), ({"optimizer": "sgd"}, "sgd"), ({"weights": {"a": np.ones(1)}}, "fit")):
        with pytest.raises(ValueError, match=text):
            G.fit(df, None, network, **{"epochs": 1, **kw})
    with pytest.raises(ValueError, match="no row"):
        G.fit(df.limit(0), None, network, 1)
    with pytest.raises(ValueError, match="not 6"):
        G.fit(df.withColumn("feat", F.slice("feat", 1, 5)), None, network, 1)


def test_predictions_of_ragged_rows(spark):
    network = NETWORKS["attentive"]
    w = network.start(4)
    rows = table(2, 25, ragged=True)
    df = frame(spark, [*rows, (99, [], 0.0, 0.0, 0.0, 0), (98, None, 0.0, 0.0, 0.0, 0)], True).repartition(3)
    got = {r.utt_id: r for r in G.predicted(df, network, w, keep=["utt_id"]).collect()}
    p, z, _ = network.predict(w, *arrays(rows, network)[:2])
    assert all(np.allclose(got[i].vad, p[i]) and np.allclose(got[i].logits, z[i]) for i in range(25)) and got[99].vad is None and got[98].logits is None
    frames = spark.createDataFrame([(i, j, [1.0 * i, 1.0 * j]) for i in range(3) for j in (2, 0, 1)], "utt_idx long, frame_idx int, feat array<double>").withColumn("speaker", F.col("utt_idx") + 7)
    assert {r.utt_idx: (r.frames, r.speaker) for r in G.utterances(frames, carried=["speaker"]).collect()} == {i: ([[i, 0], [i, 1], [i, 2]], i + 7) for i in range(3)}


def test_other_criteria(spark):
    network = NETWORKS["shared"]
    rows = table(3, 30)
    df = frame(spark, rows).repartition(2)
    w = network.start(2)
    x, r, t, y = arrays(rows, network)
    p = network.predict(w, x, r)[0]
    square = lambda p: np.mean([((p[:, j] - t[:, j])[np.isfinite(t[:, j])] ** 2).mean() for j in range(3)])
    got = G.fit(df, None, network, 1, criterion="mse", weights=w, lambda_emo=0, label=None)
    assert got.history[0]["train"]["vad_loss"] == pytest.approx(square(p), abs=1e-12)
    with Tables(spark) as tables:
        data = G.prepared(df, network, tables, "utt_id", "feat", None)
        for criterion in (G.square_criterion, G.ccc_criterion, lambda n, p, t, pp, tt, pt: ((p - t) ** 2 / n, (2 * (p - t) / n, 0.0, 0.0))):
            passes = G.Passes(network, 1.0, 0.0, criterion)
            g = passes.gradients(data, w, passes.measured(data, w), None)
            for k in ("vad_head.post_net.bias", "vad_head.pre_net.bias"):
                for i in range(len(w[k])):
                    up, down = ({**w, k: w[k] + e * (np.arange(len(w[k])) == i)} for e in (1e-6, -1e-6))
                    assert g[k][i] == pytest.approx((passes.measured(data, up).loss - passes.measured(data, down).loss) / 2e-6, abs=1e-6) if i < 2 else True
    with pytest.raises(ValueError, match="criterion"):
        G.fit(df, None, network, 1, criterion="mae")


def test_folds_are_held_out_one_by_one(spark):
    from affectra.operators import splits as S

    network = N.frame_classifier(3, 4, 8)
    r = np.random.default_rng(3)
    rows = []
    for i in range(90):
        y = i % 3
        rows.append((i, (r.normal(size=(int(r.integers(1, 4)), 4)) * 0.3 + np.eye(4)[y] * 2).tolist(), y, i % 5))
    df = spark.createDataFrame(rows, "utt_id long, frames array<array<double>>, class_idx int, fold int").repartition(3)
    options = {"epochs": 4, "rate": 2e-2, "optimizer": "rmsprop", "schedule": lambda e: H.cyclic_rate(e, 5e-3, 2e-2)}
    got = G.cross_validated(df, network, folds=[0, 3], **options).collect()
    assert [x.fold for x in got] == [0, 3, None] and [x.n for x in got] == [18, 18, 36] and got[-1].wa == pytest.approx((got[0].wa + got[1].wa) / 2) and got[-1].wa > 0.8
    # the first fold by hand
    rest = df.where("fold <> 0")
    parts = S.train_share(rest, "utt_id", 42, 0.8)
    one = G.fit(parts.where("split = 'train'"), parts.where("split = 'valid'"), network, 4, 2e-2, optimizer="rmsprop", schedule=options["schedule"], feat="frames", lambda_vad=0.0, select="accuracy", largest=True)
    made = G.predicted(df.where("fold = 0"), network, one.weights, "frames", ["class_idx"]).collect()
    assert got[0].saved_epoch == one.saved_epoch and got[0].wa == pytest.approx(np.mean([int(np.argmax(m.logits)) == m.class_idx for m in made]))
    seen = G.cross_validated(df, network, folds=[1], validate_on_test=True, **{**options, "epochs": 1}).first()
    assert seen.n == 18
    with pytest.raises(ValueError, match="no rows"):
        G.cross_validated(df, network, folds=[9], **options)
