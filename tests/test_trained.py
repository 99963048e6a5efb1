"""Configurations, training from feature files to a saved model, and models read again."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from affectra.operators import networks as N
from affectra.operators.fitting import predicted
from affectra.plans import trained as M
from affectra.sources import npy as Y
from affectra.sources.files import save_model

WIDTH = 6


def files(spark, folder, name, n=24, seed=1, dominance="some", width=WIDTH):
    """A prefix with its four files."""
    r = np.random.default_rng(seed)
    counts = [int(r.integers(1, 5)) for _ in range(n)]
    x = [r.normal(size=(c, width)) for c in counts]
    frames = spark.createDataFrame([(u, i, v.tolist()) for u, a in enumerate(x) for i, v in enumerate(a)], "utt_idx long, frame_idx int, feat array<double>")
    Y.append_utterances(frames, spark.createDataFrame(list(enumerate(counts)), "utt_idx long, n_frames int"), str(folder / name), width)
    vad, emo = [], []
    for u, a in enumerate(x):
        v = np.tanh(a.mean(axis=0)[:3])
        k = 3 if dominance == "all" or (dominance == "some" and u % 3) else 2
        vad.append("\t".join([f"u{u}", *(f"{z:.6f}" for z in v[:k])]))
        emo.append(f"u{u}\t{M.LABELS[int(np.argmax(a.mean(axis=0)[:4]))]}")
    (folder / f"{name}.vad").write_text("\n".join(vad) + "\n")
    (folder / f"{name}.emo").write_text("\n".join(emo) + "\n")
    return str(folder / name)


@pytest.mark.parametrize("kind", M.KINDS)
def test_from_files_to_a_saved_model(spark, tmp_path, kind):
    dominance = "some" if kind == M.KIND else "all"
    prefix, valid = files(spark, tmp_path, "train", dominance=dominance), files(spark, tmp_path, "valid", 12, 2, dominance)
    config = M.Training(prefix, str(tmp_path / "model"), kind, valid, epochs=3, batch_size=10, learning_rate=2e-2, input_dim=WIDTH, hidden_dim=8)
    got = M.train(spark, config, str(tmp_path / "metrics.json"))
    assert json.loads((tmp_path / "metrics.json").read_text())["saved_epoch"] == got["saved_epoch"] and got["num_samples"] == 24
    assert [h["train"]["num_batches"] for h in got["history"]] == [3, 3, 3]
    scores = [h["valid"]["mean_ccc" if kind == "vad_head" else "loss"] for h in got["history"]]
    assert got["saved_epoch"] == 1 + scores.index((max if kind == "vad_head" else min)(scores)) and got["selection"] == ("best_valid_mean_ccc" if kind == "vad_head" else "best_valid_loss")
    network, weights, saved = M.load(spark, str(tmp_path / "model"))
    made = predicted(M.rows_of(spark, valid, config), network, weights, "frames", ["utt_id"])
    assert made.count() == 12 and made.where(F.size("vad") != 3).count() == 0 and saved["metadata"]["seed"] == 42
    if kind == M.KIND:
        assert saved["dominance_status"] == "trained" and saved["vad_label_counts"]["dominance"] == 16
        # going on without Dominance labels keeps that head as it is
        more = files(spark, tmp_path, "more", dominance="none")
        again = M.train(spark, M.Training(more, str(tmp_path / "next"), initial=str(tmp_path / "model"), epochs=1, batch_size=None, weight_decay=0.1, input_dim=WIDTH, hidden_dim=8))
        _, after, _ = M.load(spark, str(tmp_path / "next"))
        assert again["dominance_status"] == "retained_from_checkpoint" and again["selection"] == "final" and again["valid"] is None
        assert all(np.array_equal(after[k], weights[k]) == k.startswith("dominance_head") for k in weights)
        with pytest.raises(ValueError, match="saved with"):
            M.train(spark, M.Training(more, str(tmp_path / "x"), initial=str(tmp_path / "model"), epochs=1, input_dim=WIDTH, hidden_dim=9))
        fresh = M.train(spark, M.Training(more, str(tmp_path / "fresh"), epochs=1, batch_size=None, input_dim=WIDTH, hidden_dim=8))
        assert fresh["dominance_status"] == "untrained" and fresh["supervised_dimensions"] == ["valence", "arousal"]


def test_saved_models_are_checked(spark, tmp_path):
    network = M.over_frames(N.mediated_heads(4, width=WIDTH, hidden=5))
    w = network.start(1)
    meta = {"target_dim": 3, "input_dim": WIDTH, "hidden_dim": 5, "class_labels": list(M.LABELS)}
    path = str(tmp_path / "m")
    save_model(spark, {f"module.head.{k}": v for k, v in w.items()}, meta, path)
    _, got, _ = M.load(spark, path)
    assert all(np.array_equal(got[k], w[k]) for k in w)
    with pytest.raises(ValueError, match="target_dim 3, not 2"):
        M.load(spark, path, target_dim=2)
    with pytest.raises(ValueError, match="expected"):
        M.load(spark, path, labels=("sad", "hap", "ang", "dis"))
    for change, text in (({"target_dim": 4}, "neither"), ({"class_names": ["x"]}, "names"), ({"hidden_dim": 6}, "don't fit"), ({"class_labels": ["sad", "hap", "ang", "dis"]}, "expected")):
        with pytest.raises(ValueError, match=text):
            M.save(spark, path, w, meta | change)
    with pytest.raises(ValueError, match="without target_dim"):
        M.MediatedConfig.of({})
    assert M.MediatedConfig.of({"target_dim": 2}) == M.MediatedConfig(2, 768, 256, M.LABELS, M.LABELS)
    save_model(spark, {k: v for k, v in w.items() if k != "classifier.bias"}, meta, path)
    with pytest.raises(ValueError, match="don't fit"):
        M.load(spark, path)
    with pytest.raises(ValueError, match="neither"):
        M.network_of({"target_dim": 5})


def test_configurations(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"common": {"seed": 7}, "optimization": {"lr": "5e-4", "epoch": 3}, "train_prefix": "a", "output": "b"}))
    got = M.configured(spark, str(tmp_path / "c.json"), batch_size=5)
    assert got == M.Training("a", "b", seed=7, learning_rate=5e-4, epochs=3, batch_size=5)
    assert M.configured(spark, train_prefix="a", output="b") == M.Training("a", "b")
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("common:\n  seed: 3  # of all generators\ndataset:\n  _name: X\n  feat_path: p\n  label_names: [a, b]\noptimization:\n  lr: 5e-4\noutput: o\n")
    assert M.configured(spark, str(tmp_path / "c.yaml")) == M.Training("p", "o", seed=3, learning_rate=5e-4, class_labels=("a", "b"))
    for text, match in (('{"x": {"warmup": 1}, "output": "o"}', "warmup"), ('{"output": "??"}', "output, train_prefix"), ('{"output": "o", "train_prefix": "p", "epochs": 0, "batch_size": 0, "hidden_dim": 0, "max_length": 0, "kind": "k"}', "epochs.*kind.*hidden_dim.*max_length")):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError, match=match):
            M.configured(spark, str(tmp_path / "bad.json"))
