"""Linear heads of folds by gradients that tasks sum over their rows, VAD heads from one pass of moments; optimizers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affectra.functions.cluster import ship
from affectra.functions.storage import written


def ccc_and_gradient(p: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray]:
    """CCC of predictions p and its gradient in p."""
    n, mp, mt = len(p), p.mean(), t.mean()
    d = p.var() + t.var() + (mp - mt) ** 2 + 1e-8
    c = 2 * ((p - mp) * (t - mt)).mean() / d
    return float(c), 2 / (n * d) * ((t - mt) - c * (p - mt))


class Adam:
    """Adam, or AdamW with decay."""

    def __init__(self, shape, rate: float = 1e-2, decay: float = 0.0):
        self.m, self.v, self.t, self.rate, self.decay = np.zeros(shape), np.zeros(shape), 0, rate, decay

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.999**self.t)
        return w * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + 1e-8)


class RMSprop:
    """RMSprop with momentum; the rate may change from step to step."""

    def __init__(self, shape, rate: float = 1e-2, momentum: float = 0.9, smoothing: float = 0.99):
        self.v, self.b, self.rate, self.momentum, self.smoothing = np.zeros(shape), np.zeros(shape), rate, momentum, smoothing

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.v = self.smoothing * self.v + (1 - self.smoothing) * g * g
        self.b = self.momentum * self.b + g / (np.sqrt(self.v) + 1e-8)
        return w - self.rate * self.b


def cyclic_rate(step: int, base: float, top: float = 1e-3, up: int = 10) -> float:
    """A triangle between two rates: `up` steps up, as many down."""
    at = step % (2 * up)
    return base + (top - base) * (at if at <= up else 2 * up - at) / up


def train_folds(rows: DataFrame, classes: int, feat: str = "feat", target: str = "true_class", fold: str = "fold", folds: int = 5, epochs: int = 30, rate: float = 0.05) -> DataFrame:
    """history rows (fold, epoch, train_loss, valid_loss, test_wa) of a head for each fold.

    rows carry `fold`; fold k's own rows are its test rows. Of the others a fifth,
    by a hash of the row, is held out of training: its loss chooses the best
    epoch (the training loss where the fifth is empty). Every epoch is a pass
    over the rows, whose tasks give sums of losses and gradients of all folds; a
    task holds a batch of rows and the driver the weights. Folds without test
    rows or training rows have no history.
    """
    spark = rows.sparkSession
    ship(spark)
    data = rows.select(F.col(feat).cast("array<double>").alias("x"), F.col(target).cast("long").alias("y"), F.col(fold).cast("long").alias("f"), (F.pmod(F.xxhash64(feat, target), F.lit(5)) == 0).alias("v"))
    schema = "fold long, epoch long, train_loss double, valid_loss double, test_wa double"
    data = written(data, "folds")  # every epoch reads it
    one = data.select(F.size("x").alias("n")).first()
    if one is None:
        return spark.createDataFrame([], schema)
    shape = (one.n + 1, classes)

    def sums(weights: np.ndarray, tested: bool) -> dict[int, tuple]:
        """For each fold: rows, their summed loss (right answers when tested), rows held out and their loss, summed gradient."""
        model = spark.sparkContext.broadcast(weights)

        def run(batches):
            w = model.value
            n, loss, gradient = np.zeros((2, folds)), np.zeros((2, folds)), np.zeros((folds, *shape))
            for b in batches:
                if not b.num_rows:
                    continue
                x1 = np.hstack([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), np.ones((b.num_rows, 1))])
                y, own, held = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False).astype(bool)
                for k in range(folds):
                    for part, used in enumerate([own == k] if tested else [(own != k) & ~held, (own != k) & held]):
                        x, t = x1[used], y[used]
                        at = np.arange(len(t))
                        z = np.einsum("ij,jk", x, w[k])
                        n[part, k] += len(t)
                        if tested:
                            loss[part, k] += (z.argmax(axis=1) == t).sum()
                            continue
                        z -= z.max(axis=1, keepdims=True)
                        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
                        loss[part, k] -= np.log(np.maximum(p[at, t], 1e-300)).sum()
                        if part == 0:
                            p[at, t] -= 1
                            gradient[k] += np.einsum("ij,ik", x, p)
            flat = gradient.reshape(folds, -1)
            at = np.flatnonzero(n[0])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[0, at]), pa.array(loss[0, at]), pa.array(n[1, at]), pa.array(loss[1, at]), pa.array(flat[at].tolist(), pa.list_(pa.float64()))], names=["k", "n", "loss", "nv", "lossv", "g"])

        part = data.mapInArrow(run, "k long, n double, loss double, nv double, lossv double, g array<double>")
        # one row for each fold and place of the weights reaches the driver
        total = part.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n", "loss", "nv", "lossv")))
        placed = part.select("k", F.posexplode("g").alias("at", "v")).groupBy("k", "at").agg(F.sum("v").alias("v")).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("g"))
        got = total.withColumn("g", F.lit(None).cast("array<double>")) if tested else total.join(placed, "k")
        out = {r.k: (r.n, r.loss, r.nv, r.lossv, None if tested else np.array(r.g).reshape(shape)) for r in got.collect()}
        model.unpersist()
        return out

    w = np.zeros((folds, *shape))
    opt, best, history = [Adam(shape, rate) for _ in range(folds)], {}, []
    for epoch in range(1, epochs + 1):
        for k, (n, loss, nv, lossv, g) in sums(w, False).items():
            valid = lossv / nv if nv else loss / n
            history.append((k, epoch, loss / n, valid))
            if valid < best.get(k, (np.inf, None))[0]:
                best[k] = valid, w[k].copy()
            w[k] = opt[k].step(w[k], g / n)
    chosen = np.stack([best[k][1] if k in best else w[k] for k in range(folds)])
    wa = {k: right / n for k, (n, right, *_) in sums(chosen, True).items()}
    return spark.createDataFrame([(k, e, float(x), float(v), float(wa[k])) for k, e, x, v in history if k in wa], schema)


def vad_moments(rows: DataFrame, feat: str = "feat", dims: tuple[str, ...] = ("valence", "arousal", "dominance")) -> dict[str, dict]:
    """For each dimension n, sum of x xT, x, t x, t and t t over rows with a finite label; x has a last 1.

    One pass over the rows. A linear head's CCC and its gradient follow from these
    sums alone, so no epoch reads the rows again. What reaches the driver is one
    matrix of the features' width a dimension, summed place by place in Spark.
    """
    spark = rows.sparkSession
    ship(spark)
    data = rows.select(F.col(feat).cast("array<double>").alias("x"), *(F.col(d).cast("double").alias(d) for d in dims))

    def run(batches):
        sums: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.hstack([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), np.ones((b.num_rows, 1))])
            for i, d in enumerate(dims):
                t = b.column(1 + i).to_numpy(zero_copy_only=False).astype(float)
                ok = np.isfinite(t)
                z = np.column_stack([x[ok], t[ok]])
                sums[d] = sums.get(d, 0) + np.einsum("ij,ik", z, z)
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(m)), pa.array(range(len(m)), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["d", "i", "m"])

    part = data.mapInArrow(run, "d string, i int, m array<double>").select("d", "i", F.posexplode("m").alias("j", "v"))
    got = part.groupBy("d", "i", "j").agg(F.sum("v").alias("v")).groupBy("d", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("m")).collect()
    out = {}
    for d in dims:
        m = np.array([r.m for r in sorted((r for r in got if r.d == d), key=lambda r: r.i)])
        out[d] = {"n": m[-2, -2], "xx": m[:-1, :-1], "x": m[:-1, -2], "tx": m[:-1, -1], "t": m[-2, -1], "tt": m[-1, -1]} if len(m) else {"n": 0.0}
    return out


def ccc_from_moments(w: np.ndarray, s: dict) -> tuple[float, np.ndarray]:
    """CCC of the predictions x w and its gradient in w."""
    n, xw = s["n"], np.einsum("ij,j", s["xx"], w)
    mp, mt = np.einsum("i,i", s["x"], w) / n, s["t"] / n
    vp, vt, cov = np.einsum("i,i", w, xw) / n - mp * mp, s["tt"] / n - mt * mt, np.einsum("i,i", s["tx"], w) / n - mp * mt
    below = vp + vt + (mp - mt) ** 2 + 1e-8
    c = 2 * cov / below
    up = 2 * (s["tx"] / n - mt * s["x"] / n)
    down = 2 * (xw / n - mp * s["x"] / n) + 2 * (mp - mt) * s["x"] / n
    return float(c), (up - c * down) / below


def train_vad_heads(rows: DataFrame, valid: DataFrame, feat: str = "feat", dims: tuple[str, ...] = ("valence", "arousal", "dominance"), epochs: int = 60, rate: float = 0.05, decay: float = 0.0, before: dict[str, np.ndarray] | None = None, criterion=ccc_from_moments) -> tuple[dict[str, np.ndarray], list[dict]]:
    """A linear head a dimension by 1 - CCC over all labelled rows, and the history of training and validation losses.

    A dimension with fewer than two labels gets no step at all, not even weight
    decay: its weights come back bit for bit. The weights kept are those of the
    epoch with the least mean validation loss, the first of them. criterion gives
    agreement and gradient from the sums of vad_moments.
    """
    fit, held = vad_moments(rows, feat, dims), vad_moments(valid, feat, dims)
    taught = [d for d in dims if fit[d]["n"] >= 2]
    if not taught:
        raise ValueError("no dimension has two labels")
    start = before or {d: np.full(len(fit[taught[0]]["x"]), 0.01) for d in dims}
    w, opt = {d: start[d].copy() for d in dims}, {d: Adam(len(start[d]), rate, decay) for d in taught}
    best, history = (np.inf, w), []
    for epoch in range(1, epochs + 1):
        got = {d: criterion(w[d], fit[d]) for d in taught}
        seen = [1 - criterion(w[d], held[d])[0] for d in taught if held[d]["n"] >= 2]
        history.append({"epoch": epoch, "train_loss": float(np.mean([1 - c for c, _ in got.values()])), "valid_loss": float(np.mean(seen)) if seen else None, "dominance_loss_skipped": "dominance" not in taught})
        score = history[-1]["valid_loss"] if seen else history[-1]["train_loss"]
        if score < best[0]:
            best = score, {d: v.copy() for d, v in w.items()}
        for d, (_, g) in got.items():
            w[d] = opt[d].step(w[d], -g)
    return best[1], history
