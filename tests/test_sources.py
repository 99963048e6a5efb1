"""The .npy source and sink, headers by ranges, the feature cache and a folder's predictions from WAV files to the table."""

import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from affectra.sources import files as R
from affectra.sources import npy as Y


def matrix(path):
    return np.load(path, allow_pickle=False)


def numbered(spark, a, parts=5, base=0):
    rows = [(base + i, [float(x) for x in v]) for i, v in enumerate(a)]
    return spark.createDataFrame(rows, Y.SCHEMA).repartition(parts)


def test_a_matrix_is_written_appended_and_read(spark, tmp_path):
    Y.register(spark)
    a, path = np.random.default_rng(1).normal(size=(1003, 6)).astype(np.float32), str(tmp_path / "below" / "a.npy")
    numbered(spark, a).write.format("npy").mode("overwrite").option("width", "6").save(path)
    assert np.array_equal(matrix(path), a) and os.path.getsize(path) == Y.HEADER + a.nbytes
    numbered(spark, a[:10] * 2, 3).write.format("npy").mode("append").save(path)
    assert np.array_equal(matrix(path), np.concatenate([a, a[:10] * 2]))
    got = Y.read_matrix(spark, path, 6, rows=100)
    assert got.rdd.getNumPartitions() == 11 and got.count() == 1013
    assert np.array_equal(np.array([r.feat for r in got.orderBy("row").collect()], dtype=np.float32), matrix(path))
    numbered(spark, a[:4]).write.format("npy").mode("overwrite").option("width", "6").save(path)
    assert np.array_equal(matrix(path), a[:4])
    numbered(spark, a[:0]).write.format("npy").mode("append").option("width", "6").save(path)
    assert np.array_equal(matrix(path), a[:4])


def test_files_of_numpy_itself(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(30, 4))
    for kind in ("<f2", "<f4", "<f8"):
        np.save(tmp_path / "n.npy", a.astype(kind))
        got = np.array([r.feat for r in Y.read_matrix(spark, str(tmp_path / "n.npy"), rows=7).orderBy("row").collect()])
        assert np.array_equal(got, a.astype(kind).astype(np.float32))
    np.save(tmp_path / "n.npy", a.astype("<f4"))
    numbered(spark, a[:3]).write.format("npy").mode("append").save(str(tmp_path / "n.npy"))
    assert np.array_equal(matrix(tmp_path / "n.npy"), np.concatenate([a, a[:3]]).astype("<f4"))
    np.save(tmp_path / "one.npy", a[0])
    assert Y.read_matrix(spark, str(tmp_path / "one.npy")).count() == 1
    np.save(tmp_path / "none.npy", a[:0])
    assert Y.read_matrix(spark, str(tmp_path / "none.npy")).count() == 0
    for bad, text in ((np.asfortranarray(a), "row order"), (np.zeros((2, 2), dtype=int), "floats"), (np.zeros((2, 2, 2)), "matrix")):
        np.save(tmp_path / "bad.npy", bad)
        with pytest.raises(Exception, match=text):
            Y.read_matrix(spark, str(tmp_path / "bad.npy")).count()
    with pytest.raises(Exception, match="5 wide"):
        Y.read_matrix(spark, str(tmp_path / "n.npy"), 5).count()
    (tmp_path / "short.npy").write_bytes((tmp_path / "n.npy").read_bytes()[:-1])
    with pytest.raises(Exception, match="fewer"):
        Y.read_matrix(spark, str(tmp_path / "short.npy")).count()
    (tmp_path / "junk.npy").write_bytes(b"junk")
    with pytest.raises(Exception, match="not an .npy"):
        Y.read_matrix(spark, str(tmp_path / "junk.npy")).count()


def test_a_failed_write_leaves_the_old_file_whole(spark, tmp_path):
    Y.register(spark)
    a, path = np.random.default_rng(1).normal(size=(50, 3)).astype(np.float32), str(tmp_path / "a.npy")
    numbered(spark, a).write.format("npy").mode("overwrite").option("width", "3").save(path)
    old = (tmp_path / "a.npy").read_bytes()
    lost = numbered(spark, a).withColumn("row", F.when(F.col("row") < 49, F.col("row")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
    gap = numbered(spark, a).where("row <> 20")
    twice = numbered(spark, a).union(numbered(spark, a[:1]))
    narrow = numbered(spark, a[:, :2])
    for df, text in ((lost, "lost"), (gap, "each once"), (twice, "each once"), (narrow, "3 values")):
        for mode in ("append", "overwrite"):
            with pytest.raises(Exception, match=text):
                df.write.format("npy").mode(mode).option("width", "3").save(path)
            assert (tmp_path / "a.npy").read_bytes() == old and os.listdir(tmp_path) == ["a.npy"], (text, mode)
    # rows beyond the counted ones, as a driver that died would leave them, are not seen and not kept
    with open(path, "ab") as f:
        f.write(b"\0" * 100)
    assert Y.read_matrix(spark, path).count() == 50 and np.array_equal(matrix(path), a)
    numbered(spark, a[:2]).write.format("npy").mode("append").save(path)
    assert np.array_equal(matrix(path), np.concatenate([a, a[:2]]))


def test_utterances_with_their_lengths(spark, tmp_path):
    r = np.random.default_rng(4)
    counts = [3, 0, 1, 5, 0]
    all_frames = [(u, i, r.normal(size=4).astype(np.float32).tolist()) for u, n in enumerate(counts) for i in range(n)]
    frames = spark.createDataFrame(all_frames, "utt_idx long, frame_idx int, feat array<float>").repartition(3)
    lengths = spark.createDataFrame(list(enumerate(counts)), "utt_idx long, n_frames int")
    prefix = str(tmp_path / "train")
    Y.append_utterances(frames, lengths, prefix, 4)
    want = np.array([f[2] for f in all_frames], dtype=np.float32)
    assert np.array_equal(matrix(prefix + ".npy"), want) and (tmp_path / "train.lengths").read_text() == "3\n0\n1\n5\n0\n"
    Y.append_utterances(frames, lengths, prefix, 4, append=True)
    assert np.array_equal(matrix(prefix + ".npy"), np.concatenate([want, want])) and (tmp_path / "train.lengths").read_text() == "3\n0\n1\n5\n0\n" * 2
    with pytest.raises(ValueError, match="9, there are 8"):
        Y.append_utterances(frames.where("utt_idx <> 2"), lengths.withColumn("n_frames", F.col("n_frames")), prefix, 4)
    assert R.read_lengths(spark, prefix + ".lengths").count() == 10
    Y.append_utterances(frames, lengths, prefix, 4)
    assert np.array_equal(matrix(prefix + ".npy"), want)


def test_a_file_for_each_utterance(spark, tmp_path):
    rows = [(f"u{i}", np.random.default_rng(i).normal(size=(i + 1, 3)).astype(np.float32).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "name string, frames array<array<float>>").repartition(2)
    for kind in Y.GRANULARITY:
        made = Y.save_features(df, str(tmp_path / kind), kind).collect()
        assert sorted(r.n_frames for r in made) == [1, 2, 3, 4, 5] and sorted(os.listdir(tmp_path / kind)) == [f"u{i}.npy" for i in range(5)]
        for name, frames in rows:
            want = np.array(frames, dtype=np.float32)
            assert np.allclose(matrix(tmp_path / kind / f"{name}.npy"), want if kind == "frame" else want.mean(axis=0))
    with pytest.raises(ValueError, match="granularity"):
        Y.save_features(df, str(tmp_path), "word")


def wav(path, samples, rate=16000, width=2, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes() if width == 2 else bytes(width * len(samples)))


def test_headers_are_read_by_ranges(spark, tmp_path):
    wav(tmp_path / "a.wav", np.zeros(300))
    wav(tmp_path / "b.wav", np.zeros(200), 8000, 4, 2)
    # a chunk before the samples, then 3 GB of samples that nobody reads
    huge = bytearray((tmp_path / "a.wav").read_bytes()[:44])
    extra = b"LIST" + (6).to_bytes(4, "little") + b"abcdef"
    huge[36:36] = extra
    huge[-4:] = (3_000_000_000).to_bytes(4, "little")
    with open(tmp_path / "c.wav", "wb") as f:
        f.write(huge)
        f.truncate(len(huge) + 3_000_000_000)
    (tmp_path / "d.wav").write_bytes(b"RIFF")
    (tmp_path / "e.wav").write_bytes((tmp_path / "a.wav").read_bytes()[:244])
    got = {r.path[-5]: tuple(r)[1:] for r in R.probe_wavs(spark, str(tmp_path)).collect()}
    assert got["a"] == (1, 16000, 2, 300, None) and got["b"] == (2, 8000, 4, 100, None) and got["c"] == (1, 16000, 2, 1_500_000_000, None)
    assert got["d"][:4] == (None,) * 4 and "unreadable" in got["d"][4] and got["e"][3] == 100


def test_counts_of_labels_are_observed_in_one_job_a_file(spark, tmp_path):
    rows = [(i, f"u{i}", "hap" if i % 3 else None, 0.5, None if i == 4 else -0.5) for i in range(9)]
    df = spark.createDataFrame(rows, "utt_idx long, utt_id string, label string, valence double, arousal double").repartition(3)
    runs = lambda: spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()
    before = runs()
    got = R.write_labels(df, str(tmp_path / "train.emo"), str(tmp_path / "va.txt"))
    assert runs() - before == 2
    kept = [r[0] for r in rows if r[2] and r[4] is not None]
    assert got == {"written": len(kept), "skipped": 9 - len(kept)}
    assert (tmp_path / "train.emo").read_text() == "".join(f"u{i}\thap\n" for i in kept) and (tmp_path / "va.txt").read_text() == "".join(f"u{i} 0.5 -0.5\n" for i in kept)


# the cache and what stands on it

WIDTH = 8


def tiny(samples):
    """Two statistics of windows of 100 samples, in 8 places."""
    a = np.asarray(samples, dtype=np.float64)
    w = a[: len(a) // 100 * 100].reshape(-1, 100)
    return np.concatenate([w.mean(axis=1, keepdims=True), w.std(axis=1, keepdims=True), np.zeros((len(w), 6))], axis=1).astype(np.float32)


def counting(folder):
    """tiny, which leaves a mark for each call."""

    def made(samples):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w"):
            pass
        return tiny(samples)

    return made


@pytest.fixture
def recordings(tmp_path):
    folder = tmp_path / "wavs"
    folder.mkdir()
    for i in range(5):
        wav(folder / f"{'edcba'[i]}.wav", np.sin(np.arange(500 + 200 * i) / (5 + i)) * 0.1 * (i + 1))
    return folder


def test_only_what_is_missing_is_decoded(spark, tmp_path, recordings):
    from affectra.sources.cache import FeatureCache

    marks = tmp_path / "marks"
    marks.mkdir()
    calls = lambda: len(list(marks.iterdir()))
    cache = FeatureCache(spark, str(tmp_path / "cache"), "tiny", counting(str(marks)), WIDTH, digits=1)
    listed = lambda: R.wav_folder(spark, str(recordings))
    got = {r.path[-5]: (r.n, np.array(r.x, dtype=np.float32)) for r in cache.ensure(listed()).collect()}
    for i in range(5):
        samples = R.decode_wav((recordings / f"{'edcba'[i]}.wav").read_bytes())["samples"]
        assert got["edcba"[i]][0] == 5 + 2 * i and np.array_equal(got["edcba"[i]][1], tiny(samples).ravel())
    assert calls() == 5
    # hits: nothing is opened, even without a file or an extractor
    kept = (recordings / "a.wav").read_bytes()
    before = listed().collect()
    frozen = spark.createDataFrame(before, "path string, modified timestamp, size long")
    (recordings / "a.wav").unlink()
    again = FeatureCache(spark, str(tmp_path / "cache"), "tiny", None, WIDTH, digits=1).ensure(frozen)
    assert again.count() == 5 and calls() == 5
    # changed: another size or time is another key
    (recordings / "a.wav").write_bytes(kept)
    os.utime(recordings / "a.wav", (1_000_000_000, 1_000_000_000))
    assert cache.ensure(listed()).count() == 5 and calls() == 6 and cache.entries().count() == 6
    # another encoder has entries of its own
    with pytest.raises(FileNotFoundError, match="wav"):
        FeatureCache(spark, str(tmp_path / "cache"), "other", None, WIDTH, digits=1).ensure(listed())
    cache.ensure(listed(), force=True)
    assert calls() == 11 and cache.entries().count() == 6 and cache._table().count() == 6


def test_damaged_entries_are_found_and_made_again(spark, tmp_path, recordings):
    from affectra.sources.cache import FeatureCache

    path = str(tmp_path / "cache")
    cache = FeatureCache(spark, path, "tiny", tiny, WIDTH, digits=1)
    listed = R.wav_folder(spark, str(recordings))
    want = {r.path: r.x for r in cache.ensure(listed).collect()}
    rows = cache._table().collect()
    # values that don't fit their check, too few, not finite: one entry each
    wrong = [(r.cache_key, r.n, x, r.check, r.bucket) for r, x in zip(rows, ([9.0] * WIDTH * rows[0].n, rows[1].x[:-1], [float("nan")] * WIDTH * rows[2].n), strict=False)]
    kept = [tuple(r) for r in rows[3:]]
    for r in rows[:3]:
        for f in (tmp_path / "cache" / f"bucket={r.bucket}").iterdir():
            f.unlink()
    spoiled = {r.bucket for r in rows[:3]}
    spark.createDataFrame(wrong + [k for k in kept if k[4] in spoiled], "cache_key string, n int, x array<float>, check long, bucket string").write.mode("append").partitionBy("bucket").parquet(path)
    assert cache.entries().count() == 2
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "cache").glob("bucket=*/*.parquet") if f.parent.name[-1] not in spoiled}
    assert {r.path: r.x for r in cache.ensure(listed).collect()} == want and cache._table().count() == 5
    assert all(f.stat().st_mtime_ns == t for f, t in untouched.items())
    # a file cut short
    victim = next((tmp_path / "cache").glob("bucket=*/*.parquet"))
    victim.write_bytes(victim.read_bytes()[:40])
    for crc in victim.parent.glob(".*.crc"):
        crc.unlink()
    lost = 5 - cache.entries().count()
    assert lost >= 1
    assert {r.path: r.x for r in cache.ensure(listed).collect()} == want and cache._table().count() == 5 and not victim.exists()


def test_unfit_features_are_refused_with_their_file(spark, tmp_path, recordings):
    from affectra.sources.cache import FeatureCache

    listed = R.wav_folder(spark, str(recordings))
    for bad in (lambda s: np.zeros((0, WIDTH)), lambda s: np.zeros((3, 5)), lambda s: np.full((2, WIDTH), np.nan)):
        with pytest.raises(Exception, match="wav: features"):
            FeatureCache(spark, str(tmp_path / "cache"), "bad", bad, WIDTH).ensure(listed)
    (recordings / "a.wav").write_bytes(b"junk")
    with pytest.raises(Exception, match="a.wav: unreadable"):
        FeatureCache(spark, str(tmp_path / "cache"), "tiny", tiny, WIDTH).ensure(R.wav_folder(spark, str(recordings)))


class Doubled:
    """An encoder as a factory makes it; with old=True it takes two arguments only."""

    def __init__(self, scale, shape="x", old=False):
        self.scale, self.shape, self.old = scale, shape, old

    def extract_features(self, source, padding_mask=None, **more):
        if self.old and more:
            raise TypeError("unexpected arguments")
        x = np.repeat(source[:, ::100, None] * self.scale, WIDTH, axis=2)
        return {"x": {"x": x}, "tuple": (x, 1), "plain": x}[self.shape]


def factory(arguments):
    return Doubled(*arguments)


def test_encoders_are_made_where_they_run(spark, tmp_path, recordings):
    from affectra.sources.cache import FeatureCache
    from affectra.sources.encoders import Encoder, resolved

    listed = R.wav_folder(spark, str(recordings))
    samples = {f.name[0]: np.array(R.decode_wav(f.read_bytes())["samples"], dtype=np.float32) for f in recordings.iterdir()}
    for i, arguments in enumerate([(2.0,), (2.0, "tuple"), (2.0, "plain", True)]):
        got = FeatureCache(spark, str(tmp_path / "cache"), f"e{i}", Encoder(factory, arguments), WIDTH).ensure(listed).collect()
        assert all(np.allclose(r.x, np.repeat(samples[r.path[-5]][::100] * 2, WIDTH)) for r in got) and len(got) == 5
    level = Encoder("tests.test_sources:factory", (1.0,), normalise=True)(samples["a"])
    s = samples["a"].astype(float)
    assert np.allclose(level[:, 0], ((s - s.mean()) / np.sqrt(s.var() + 1e-5))[::100], atol=1e-6)
    assert resolved("tests.test_sources:tiny") is tiny or resolved("tests.test_sources:tiny").__name__ == "tiny"
    for bad, kind in (("tests.test_sources", ValueError), ("tests.test_sources:WIDTH", TypeError), ("tests.test_sources:none", AttributeError)):
        with pytest.raises(kind):
            resolved(bad)


def test_from_recordings_to_the_table(spark, tmp_path, recordings):
    """Annotations and features to rows, a head trained on them, and the table of a folder, once whole and once as files arrive."""
    import pandas as pd

    from affectra.operators import fitting as G
    from affectra.operators import networks as N
    from affectra.operators.transforms import fit_minmax
    from affectra.plans import study as U
    from affectra.sources.cache import FeatureCache

    labels = ("ang", "hap")
    (tmp_path / "notes.csv").write_text("file,who,emo,V,A\n" + "".join(f"{c}.wav,s{i},{labels[i % 2]},{i},{i * i}\n" for i, c in enumerate("abcde")))
    names = {"audio": "file", "speaker": "who", "emotion": "emo", "valence": "V", "arousal": "A"}
    notes = R.read_annotations(spark, str(tmp_path / "notes.csv"), names, str(recordings))
    fitted = fit_minmax(notes.withColumn("split", F.lit("train"))).cache()
    cache = FeatureCache(spark, str(tmp_path / "cache"), "tiny", tiny, WIDTH)
    rows = U.dataset(notes, cache.ensure(R.wav_folder(spark, str(recordings))), fitted, labels, WIDTH)
    got = {r.utt_id: r for r in rows.collect()}
    matrices = {c: tiny(R.decode_wav((recordings / f"{c}.wav").read_bytes())["samples"]) for c in "abcde"}
    for i, c in enumerate("abcde"):
        r = got[f"{c}.wav"]
        assert np.array_equal(np.array(r.frames, dtype=np.float32), matrices[c]) and r.class_idx == i % 2 and r.dominance is None
        assert r.valence == pytest.approx(i / 2 - 1) and r.arousal == pytest.approx(i * i / 8 - 1)
    with pytest.raises(Exception, match="unknown label"):
        U.dataset(notes, cache.ensure(R.wav_folder(spark, str(recordings))), fitted, ("hap", "sad"), WIDTH).collect()
    network = U.over_frames(N.separate_heads(2, WIDTH, 4))
    model = G.fit(rows, None, network, 2, 1e-2, feat="frames")
    out = tmp_path / "made" / "table.csv"
    table = U.predict_folder(spark, str(recordings), cache, network, model.weights, labels, fitted, str(out))
    # the same by hand
    want = []
    for c in "abcde":
        x = matrices[c].astype(np.float64).mean(axis=0)
        head = lambda n: model.weights[f"{n}_head.post_net.weight"] @ np.maximum(model.weights[f"{n}_head.pre_net.weight"] @ x + model.weights[f"{n}_head.pre_net.bias"], 0) + model.weights[f"{n}_head.post_net.bias"]  # noqa: B023, E731
        z = head("emotion")
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        v, a, d = (head(n)[0] for n in ("valence", "arousal", "dominance"))
        want.append([f"{c}.wav", labels[int(p.argmax())], *p, v, (v + 1) * 2, a, (a + 1) * 8, d, d])
    made = pd.read_csv(out, keep_default_na=False, encoding="utf-8-sig")
    columns = ["audio_file", "predicted_emotion", "probability_ang", "probability_hap", "valence_normalized", "valence", "arousal_normalized", "arousal", "dominance_normalized", "dominance"]
    for r, w in zip(made[columns].itertuples(index=False), want, strict=True):
        assert list(r[:2]) == w[:2] and np.allclose(list(r[2:]), w[2:], atol=1e-6)
    assert set(made.dominance_scale_status) == {"unavailable_normalized_value_repeated"} and set(made.valence_status) == {"trained"} and made.warning.str.len().min() > 0
    # as files arrive
    query = U.predict_stream(spark, str(recordings), tiny, network, model.weights, labels, fitted, str(tmp_path / "stream"), str(tmp_path / "at"), WIDTH)
    query.awaitTermination(120)
    order = lambda df: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.orderBy("audio_file").collect()]
    assert order(spark.read.parquet(str(tmp_path / "stream"))) == order(table)
    wav(recordings / "f.wav", np.ones(700) * 0.2)
    U.predict_stream(spark, str(recordings), tiny, network, model.weights, labels, fitted, str(tmp_path / "stream"), str(tmp_path / "at"), WIDTH).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "stream")).count() == 6
    wav(recordings / "g.wav", np.ones(700), 8000)
    (recordings / "h.wav").write_bytes(b"junk")
    with pytest.raises(ValueError, match="g.wav: sample rate; .*h.wav: unreadable"):
        U.predict_folder(spark, str(recordings), cache, network, model.weights, labels, fitted)
