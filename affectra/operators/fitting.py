"""Networks fitted over tables: every step sums its gradients in tasks and moves the weights on the driver.

CCC's gradient in one prediction needs the moments of all of them, so a step is
two passes over its rows: predictions' moments, then gradients. Sums are made in
order of partitions, and masks are hashes of keys, so tasks that run again after
an executor is lost give the same weights bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectra.functions.cluster import ship
from affectra.functions.storage import Tables

from .networks import Network, Params, Rows
from .offsets import ranked
from .train import Adam, RMSprop

#: Numbers of a sum that travel in one row.
CHUNK = 1024
#: Labels that a dimension needs in a step before its loss counts.
LEAST = {"dominance": 2}


def utterances(frames: DataFrame, key: str = "utt_idx", feat: str = "feat", place: str = "frame_idx", carried: list[str] | None = None) -> DataFrame:
    """(key, frames, and first values of carried columns): an utterance's frames in order, as the row that it is trained as.

    A row holds one utterance whole; readers bound its frames (shortest, longest).
    """
    gathered = F.transform(F.array_sort(F.collect_list(F.struct(place, feat))), lambda s: s[feat]).alias("frames")
    return frames.groupBy(key).agg(gathered, *(F.first(c).alias(c) for c in carried or []))


def prepared(rows: DataFrame, network: Network, tables: Tables, key: str, feat: str, label: str | None) -> DataFrame:
    """(i, h, n, x, t, y): rows as networks take them, written once: a number, a hash of the key, frames, all their values, targets, class.

    feat holds a vector or an array of vectors. Rows without frames are left out;
    targets that are null or no finite numbers don't count, nor do null classes.
    """
    ragged = isinstance(rows.schema[feat].dataType, T.ArrayType) and isinstance(rows.schema[feat].dataType.elementType, T.ArrayType)
    x = F.flatten(feat) if ragged else F.col(feat)
    n = F.size(feat) if ragged else F.when(F.size(feat) > 0, 1).otherwise(0)
    target = lambda d: F.col(d).cast("double") if d in rows.columns else F.lit(None).cast("double")
    t = F.array(*(F.coalesce(target(d), F.lit(float("nan"))) for d in network.dims)) if network.dims else F.array().cast("array<double>")
    y = F.coalesce(F.col(label).cast("int"), F.lit(-1)) if label else F.lit(-1)
    data = rows.where(F.col(feat).isNotNull()).select(F.xxhash64(key).alias("h"), n.cast("int").alias("n"), x.cast("array<double>").alias("x"), t.alias("t"), y.alias("y")).where("n > 0")
    wrong = F.size("x") != F.col("n") * network.width
    kept = tables.put(data.withColumn("i", F.monotonically_increasing_id()), "rows")
    bad = kept.where(wrong).limit(1).collect()
    if bad:
        raise ValueError(f"{len(bad[0].x)} values in {bad[0].n} vectors, not {network.width} in each")
    return kept


def _batch(b: pa.RecordBatch, network: Network, draw: int | None) -> tuple[np.ndarray, Rows, np.ndarray, np.ndarray]:
    flat = lambda name: b.column(name).flatten().to_numpy(zero_copy_only=False)
    rows = Rows(b.column("n").to_numpy().astype(np.int64), b.column("h").to_numpy().astype(np.int64).view(np.uint64), draw)
    return flat("x").reshape(-1, network.width), rows, flat("t").reshape(b.num_rows, len(network.dims)), b.column("y").to_numpy()


def totals(data: DataFrame, size: int, vector: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of vectors of `size` over all batches of rows: a task adds its own, then chunks of all tasks are added in order of partitions."""

    def run(batches):
        total = np.zeros(size)
        seen = False
        for b in batches:
            if b.num_rows:
                total += vector(b)
                seen = True
        at = range(0, size, CHUNK) if seen else []
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([total[i : i + CHUNK] for i in at], pa.list_(pa.float64()))], names=["part", "at", "v"])

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        v = np.stack([np.asarray(x) for x in table.column("v").to_pylist()])[order].sum(axis=0)
        return pa.table({"at": table.column("at").slice(0, 1), "v": pa.array([v], pa.list_(pa.float64()))})

    parts = data.mapInArrow(run, "part int, at int, v array<double>").groupBy("at").applyInArrow(add, "at int, v array<double>").collect()
    out = np.zeros(size)
    for r in parts:  # as many numbers as the network has
        out[r["at"] : r["at"] + len(r.v)] = r.v
    return out


def _moments(network: Network, w: Params, b: pa.RecordBatch, draw: int | None) -> np.ndarray:
    """For each dimension labels and the sums of p, t, p p, t t and p t over them; then classes, their summed cross-entropy and right answers."""
    x, rows, t, y = _batch(b, network, draw)
    p, z, _ = network.predict(w, x, rows)
    out = []
    for j in range(len(network.dims)):
        ok = np.isfinite(t[:, j])
        a, c = p[ok, j], t[ok, j]
        out += [len(a), a.sum(), c.sum(), (a * a).sum(), (c * c).sum(), (a * c).sum()]
    ok = np.flatnonzero(y >= 0) if z.shape[1] else np.zeros(0, dtype=np.int64)
    z = z[ok]
    top = z.max(axis=1, keepdims=True) if len(ok) else z
    log = np.log(np.exp(z - top).sum(axis=1)) + top.reshape(-1)[: len(ok)] - z[np.arange(len(ok)), y[ok]] if len(ok) else np.zeros(0)
    right = (z.argmax(axis=1) == y[ok]).sum() if len(ok) else 0
    return np.array([*out, len(ok), log.sum(), right], dtype=np.float64)


#: A loss of one dimension by its labels n and the sums p, t, p p, t t and p t: the loss, and its derivatives in the sums p, p p and p t.
Criterion = Callable[[float, float, float, float, float, float], tuple[float, tuple[float, float, float]]]


def _ccc(n: float, p: float, t: float, pp: float, tt: float, pt: float) -> float:
    mp, mt = p / n, t / n
    return float(2 * (pt / n - mp * mt) / (pp / n - mp * mp + tt / n - mt * mt + (mp - mt) ** 2 + 1e-8))


def ccc_criterion(n: float, p: float, t: float, pp: float, tt: float, pt: float) -> tuple[float, tuple[float, float, float]]:
    """One less CCC."""
    mt, c = t / n, _ccc(n, p, t, pp, tt, pt)
    share = -2 / (pp - 2 * p * mt + tt - t * mt + n * mt * mt + n * 1e-8)  # over n times the denominator
    return 1 - c, (share * mt * (c - 1), -share * c / 2, share)


def square_criterion(n: float, p: float, t: float, pp: float, tt: float, pt: float) -> tuple[float, tuple[float, float, float]]:
    """Mean squared difference."""
    return (pp - 2 * pt + tt) / n, (0.0, 1 / n, -2 / n)


CRITERIA: dict[str, Criterion] = {"ccc": ccc_criterion, "mse": square_criterion}


@dataclass(frozen=True)
class Measured:
    """Losses of rows from their moments, and what a prediction's derivative is made of."""

    loss: float
    vad_loss: float
    emotion_loss: float
    ccc: dict[str, float | None]
    accuracy: float | None
    mean_ccc: float | None
    slopes: dict[str, tuple[float, float, float]]  # derivative in a prediction: a constant, its factor, and its target's
    classes: int

    @classmethod
    def of(cls, m: np.ndarray, dims: tuple[str, ...], lambda_vad: float, lambda_emo: float, criterion: Criterion = ccc_criterion) -> Measured:
        ccc: dict[str, float | None] = {}
        losses, slopes = [], {}
        for d, sums in zip(dims, m[:-3].reshape(-1, 6), strict=True):
            ccc[d] = None
            if sums[0] >= LEAST.get(d, 1):
                ccc[d] = _ccc(*sums)
                loss, (a, b, c) = criterion(*sums)
                losses.append(loss)
                slopes[d] = a, 2 * b, c
        slopes = {d: tuple(lambda_vad * x / len(losses) for x in s) for d, s in slopes.items()}
        vad = float(sum(losses) / len(losses)) if losses else 0.0
        n, ce, right = m[-3:]
        emotion = float(ce / n) if n else 0.0
        known = [c for c in ccc.values() if c is not None]
        return cls(lambda_vad * vad + lambda_emo * emotion, vad, emotion, ccc, float(right / n) if n else None, sum(known) / len(known) if known else None, slopes, int(n))

    def row(self) -> dict:
        return {"loss": self.loss, "vad_loss": self.vad_loss, "emotion_loss": self.emotion_loss, "accuracy": self.accuracy, "mean_ccc": self.mean_ccc, **{f"ccc_{d}": c for d, c in self.ccc.items()}}


def _gradient(network: Network, w: Params, names: list[str], b: pa.RecordBatch, draw: int | None, measured: Measured, lambda_emo: float) -> np.ndarray:
    x, rows, t, y = _batch(b, network, draw)
    p, z, saved = network.predict(w, x, rows)
    d_vad, d_logits = np.zeros_like(p), np.zeros_like(z)
    for j, d in enumerate(network.dims):
        if d in measured.slopes:
            constant, own, target = measured.slopes[d]
            ok = np.isfinite(t[:, j])
            d_vad[ok, j] = constant + own * p[ok, j] + target * t[ok, j]
    ok = np.flatnonzero(y >= 0) if z.shape[1] else np.zeros(0, dtype=np.int64)
    if len(ok) and lambda_emo:
        e = np.exp(z[ok] - z[ok].max(axis=1, keepdims=True))
        e /= e.sum(axis=1, keepdims=True)
        e[np.arange(len(ok)), y[ok]] -= 1
        d_logits[ok] = lambda_emo / measured.classes * e
    got = network.gradients(w, saved, d_vad, d_logits)
    return np.concatenate([got[k].ravel() for k in names])


class Passes:
    """Passes over prepared rows with given weights."""

    def __init__(self, network: Network, lambda_vad: float, lambda_emo: float, criterion: Criterion = ccc_criterion):
        self.network, self.lambda_vad, self.lambda_emo, self.criterion = network, lambda_vad, lambda_emo, criterion

    def _sent(self, data: DataFrame, size: int, w: Params, vector) -> np.ndarray:
        sent = data.sparkSession.sparkContext.broadcast(w)  # as large as the network
        try:
            return totals(data, size, lambda b: vector(sent.value, b))
        finally:
            sent.unpersist()

    def measured(self, data: DataFrame, w: Params, draw: int | None = None) -> Measured:
        network = self.network
        m = self._sent(data, 6 * len(network.dims) + 3, w, lambda v, b: _moments(network, v, b, draw))
        return Measured.of(m, network.dims, self.lambda_vad, self.lambda_emo, self.criterion)

    def gradients(self, data: DataFrame, w: Params, measured: Measured, draw: int) -> Params:
        network, lambda_emo = self.network, self.lambda_emo
        names = sorted(w)
        flat = self._sent(data, sum(w[k].size for k in names), w, lambda v, b: _gradient(network, v, names, b, draw, measured, lambda_emo))
        ends = np.cumsum([w[k].size for k in names])
        return {k: flat[e - w[k].size : e].reshape(w[k].shape) for k, e in zip(names, ends, strict=True)}


def batches(data: DataFrame, n: int, size: int | None, seed: int, epoch: int, tables: Tables) -> Iterator[DataFrame]:
    """data in steps of `size` rows, the last one smaller, in an order by a seeded hash of the epoch's own; None: all at once.

    An epoch's rows are dealt out once, so that a step reads its own rows only.
    """
    if size is None or size >= n:
        yield data
        return
    order = data.select("i", F.xxhash64("h", F.lit(seed), F.lit(epoch)).alias("o"))
    place = ranked(order, ["o", "i"], tables).select("i", F.floor(F.col("rank") / size).cast("int").alias("batch"))
    dealt = tables.put(data.join(place, "i").repartition("batch"), "epoch", by="batch")
    for b in range(-(-n // size)):
        yield dealt.where(F.col("batch") == b).drop("batch")


@dataclass
class Fitted:
    network: Network
    weights: Params
    history: list[dict]
    saved_epoch: int
    selection: str
    label_counts: dict[str, int] = field(default_factory=dict)


def _optimizer(kind: str, shape, rate: float, decay: float):
    if kind in ("adamw", "adam"):
        return Adam(shape, rate, decay if kind == "adamw" else 0.0)
    if kind == "rmsprop":
        return RMSprop(shape, rate)
    raise ValueError(f"optimizer {kind!r} is none of adamw, adam and rmsprop")


def fit(
    rows: DataFrame, valid: DataFrame | None, network: Network, epochs: int, rate: float | dict[str, float] = 1e-3, weights: Params | None = None, optimizer: str = "adamw", decay: float = 0.01,
    lambda_vad: float = 1.0, lambda_emo: float = 1.0, batch_size: int | None = None, seed: int = 42, key: str = "utt_id", feat: str = "feat", label: str | None = "class_idx",
    frozen: tuple[str, ...] = (), select: str = "loss", largest: bool = False, floor: float | None = None, schedule: Callable[[int], float] | None = None, criterion: str | Criterion = "ccc",
) -> Fitted:
    """network fitted to rows, with the weights of its best epoch by `select` over valid (the first of them; without valid the last epoch's).

    rows: key, feat (a vector, or an array of vectors), columns of the network's
    dimensions and a class index where there are any; those that are missing or
    null teach nothing. The loss is lambda_vad times the mean of the criterion
    ("ccc": one less CCC, "mse", or any function of the moments that also gives
    its derivatives) over dimensions with labels (Dominance from two on), plus
    lambda_emo times the cross-entropy. A branch of Dominance alone gets no step, no decay either,
    where its loss is left out. Parameters named in frozen (by their first
    letters) stay. rate may name parts: {"classifier": 1e-3, "": 1e-4}; schedule
    gives the rate of an epoch, from 0. Rows without frames, and tables without
    rows, are refused by an error that says so. History: epoch, train (means over
    steps) and valid figures.
    """
    if epochs < 1 or (batch_size is not None and batch_size < 1):
        raise ValueError("epochs and batch_size must be at least 1")
    if lambda_vad < 0 or lambda_emo < 0 or lambda_vad == lambda_emo == 0:
        raise ValueError("loss weights must not be below 0, and one above")
    if isinstance(criterion, str) and criterion not in CRITERIA:
        raise ValueError(f"criterion {criterion!r} is none of {', '.join(CRITERIA)}")
    spark = rows.sparkSession
    ship(spark)
    w = dict(weights or network.start(seed))
    if {k: v.shape for k, v in w.items()} != {k: v.shape for k, v in network.start(0).items()}:
        raise ValueError("weights don't fit the network")
    passes, state, history, best = Passes(network, lambda_vad, lambda_emo, CRITERIA[criterion] if isinstance(criterion, str) else criterion), {}, [], None
    rates = rate if isinstance(rate, dict) else {"": rate}
    of = lambda k: rates[max((p for p in rates if k.startswith(p)), key=len)]
    with Tables(spark) as tables:
        data = prepared(rows, network, tables, key, feat, label)
        held = prepared(valid, network, tables, key, feat, label) if valid is not None else None
        counted = data.agg(F.count("*").alias("n"), *(F.count_if(~F.isnan(F.get("t", F.lit(j)))).alias(d) for j, d in enumerate(network.dims))).first()
        if not counted.n:
            raise ValueError("no row to train on")
        counts = {d: counted[d] for d in network.dims}
        if floor is not None:
            best = floor, 0, w
        for epoch in range(1, epochs + 1):
            steps: list[Measured] = []
            trained = 0
            with Tables(spark) as dealt:
                for step, part in enumerate(batches(data, counted.n, batch_size, seed, epoch, dealt)):
                    draw = (epoch << 24) + step
                    now = passes.measured(part, w, draw)
                    g = passes.gradients(part, w, now, draw)
                    idle = {f"{names[0]}_head" for names, _ in network.branches if names == ("dominance",) and "dominance" not in now.slopes}
                    for k in w:
                        if not any(k.startswith(f) for f in (*frozen, *idle)):
                            one = state.setdefault(k, _optimizer(optimizer, w[k].shape, of(k), decay))
                            one.rate = schedule(epoch - 1) if schedule else one.rate
                            w[k] = one.step(w[k], g[k])
                    steps.append(now)
                    trained += "dominance" in now.slopes
            mean = lambda k: float(np.mean([getattr(s, k) for s in steps]))
            row = {"epoch": epoch, "train": {**{k: mean(k) for k in ("loss", "vad_loss", "emotion_loss")}, "num_batches": len(steps), "dominance_loss_batches": trained}}
            if held is not None:
                row["valid"] = passes.measured(held, w).row()
                score = row["valid"].get(select)
                if score is not None and (best is None or (score > best[0] if largest else score < best[0])):
                    best = score, epoch, dict(w)
            history.append(row)
    if best is None:
        return Fitted(network, w, history, epochs, "final", counts)
    return Fitted(network, best[2], history, best[1], f"best_valid_{select}", counts)


def fit_two_stages(
    rows: DataFrame, valid: DataFrame, network: Network, epochs: tuple[int, int], rate: float = 1e-3, decoder_rate: float = 1e-4, classifier_rate: float = 1e-3,
    batch_size: int | None = None, seed: int = 42, key: str = "utt_id", feat: str = "frames", label: str = "class_idx",
) -> Fitted:
    """The decoder by CCC, then from its best state decoder and classifier by cross-entropy, each at a rate of its own.

    The first stage keeps the epoch of least validation loss; the second that of
    most right answers in validation, the first stage's state if none is right.
    """
    common = {"optimizer": "adam", "batch_size": batch_size, "seed": seed, "key": key, "feat": feat, "label": label}
    first = fit(rows, valid, network, epochs[0], rate, lambda_emo=0.0, frozen=("classifier",), **common)
    second = fit(rows, valid, network, epochs[1], {"": decoder_rate, "classifier": classifier_rate}, weights=first.weights, lambda_vad=0.0, select="accuracy", largest=True, floor=0.0, **common)
    history = [{"stage": i, **h} for i, f in ((1, first), (2, second)) for h in f.history]
    return Fitted(network, second.weights, history, second.saved_epoch, second.selection, first.label_counts)


def history_table(rows: DataFrame, history: list[dict], **more) -> DataFrame:
    """The history as rows (part, epoch, measure, value), with `more` as further columns: a row an epoch and measure."""
    flat = [(*more.values(), part, h["epoch"], k, None if v is None else float(v)) for h in history for part in ("train", "valid") if part in h for k, v in h[part].items()]
    names = "".join(f"{k} {'long' if isinstance(v, int) else 'string'}, " for k, v in more.items())
    return rows.sparkSession.createDataFrame(flat, names + "part string, epoch long, measure string, value double")


def predicted(rows: DataFrame, network: Network, weights: Params, feat: str = "feat", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, vad (in order of the network's dimensions) and logits of each row; null for rows without frames."""
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema[feat].dataType
    ragged = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
    n = F.coalesce(F.size(feat) if ragged else F.when(F.size(feat) > 0, 1), F.lit(0))
    kept = rows.select(*(keep if keep is not None else [c for c in rows.columns if c != feat]), F.greatest(n, F.lit(0)).cast("int").alias("_n"), F.coalesce((F.flatten(feat) if ragged else F.col(feat)).cast("array<double>"), F.array().cast("array<double>")).alias("_x"))
    out = T.StructType([*kept.drop("_n", "_x").schema.fields, T.StructField("vad", T.ArrayType(T.DoubleType())), T.StructField("logits", T.ArrayType(T.DoubleType()))])
    sent = spark.sparkContext.broadcast(weights)

    def run(batches):
        for b in batches:
            counts = b.column("_n").to_numpy().astype(np.int64)
            some = counts > 0
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, network.width)
            p, z, _ = network.predict(sent.value, x, Rows(counts[some], np.zeros(some.sum(), dtype=np.uint64)))
            place = np.cumsum(some) - 1
            pick = lambda a: pa.array([a[i] if ok else None for i, ok in zip(place, some, strict=True)], pa.list_(pa.float64()))
            columns = [b.column(c) for c in out.names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pick(p), pick(z)], names=out.names)

    return kept.mapInArrow(run, out)


def cross_validated(
    rows: DataFrame, network: Network, fold: str = "fold", folds: list[int] | None = None, epochs: int = 100, key: str = "utt_id", feat: str = "frames", label: str = "class_idx",
    seed: int = 42, share: float = 0.8, validate_on_test: bool = False, **options,
) -> DataFrame:
    """(fold, saved_epoch, n, wa, ua, weighted_f1) of a classifier for each fold held out, and their means as fold null.

    A fold's own rows are its test rows; of the others the share floor(share * n)
    by a seeded hash trains and the rest chooses the first epoch of most right
    answers (or the test rows do, as some published figures have it). Options
    are those of fit(). Without folds named, those that the column has count.
    A fold without test rows is refused.
    """
    from .metrics import confusion, report
    from .splits import train_share

    spark = rows.sparkSession
    out = []
    with Tables(spark) as tables:
        data = tables.put(rows, "cross")
        for k in folds or sorted(r[0] for r in data.select(fold).where(F.col(fold).isNotNull()).distinct().collect()):
            test, rest = data.where(F.col(fold) == k), data.where(F.col(fold) != k)
            if test.isEmpty():
                raise ValueError(f"fold {k} has no rows")
            parts = train_share(rest, key, seed, share)
            train, valid = (rest, test) if validate_on_test else (parts.where("split = 'train'"), parts.where("split = 'valid'"))
            got = fit(train, valid, network, epochs, key=key, feat=feat, label=label, seed=seed, lambda_vad=0.0, select="accuracy", largest=True, **options)
            made = predicted(test.where(F.col(label).isNotNull()), network, got.weights, feat, [label])
            top = F.array_position("logits", F.array_max("logits")).cast("int") - 1
            r = report(confusion(made.where("logits is not null").select(F.col(label).cast("int").alias("true_class"), top.alias("pred_class")), network.classes)).first()
            out.append((k, got.saved_epoch, made.count(), float(r.wa), float(r.ua_skip), float(r.weighted_f1)))
    mean = [float(np.mean([o[i] for o in out])) for i in (3, 4, 5)]
    return spark.createDataFrame([*((int(k), *o) for k, *o in out), (None, None, sum(o[2] for o in out), *mean)], "fold long, saved_epoch long, n long, wa double, ua double, weighted_f1 double")
