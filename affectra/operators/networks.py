"""Networks over pooled vectors or ragged frames: layers with their gradients, and the heads made of them.

A layer works on the rows of a task's batch at once. Ragged utterances lie one
behind another, so a layer below the pooling sees frames and one above it
utterances. Parameters are a dictionary of arrays; gradients have its keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .metrics import DIMS

Params = dict[str, np.ndarray]

_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX[0]
    x = (x ^ x >> np.uint64(27)) * _MIX[1]
    return x ^ x >> np.uint64(31)


@dataclass(frozen=True)
class Rows:
    """What a layer may need of its batch: frames of each utterance, a hash of each row's key, and the draw of its masks (none: evaluation)."""

    counts: np.ndarray
    hashes: np.ndarray
    draw: int | None = None

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


@dataclass(frozen=True)
class Linear:
    name: str
    inputs: int
    outputs: int

    def start(self, rng: np.random.Generator) -> Params:
        """Uniform within one over the root of the inputs."""
        reach = 1 / np.sqrt(self.inputs)
        return {f"{self.name}.weight": rng.uniform(-reach, reach, (self.outputs, self.inputs)), f"{self.name}.bias": rng.uniform(-reach, reach, self.outputs)}

    def forward(self, w: Params, x: np.ndarray, rows: Rows):
        return x @ w[f"{self.name}.weight"].T + w[f"{self.name}.bias"], x

    def backward(self, w: Params, x: np.ndarray, d: np.ndarray, out: Params) -> np.ndarray:
        out[f"{self.name}.weight"], out[f"{self.name}.bias"] = d.T @ x, d.sum(axis=0)
        return d @ w[f"{self.name}.weight"]


class Plain:
    """A layer without parameters."""

    def start(self, rng: np.random.Generator) -> Params:
        return {}


class Relu(Plain):
    def forward(self, w: Params, x: np.ndarray, rows: Rows):
        return np.maximum(x, 0), x > 0

    def backward(self, w: Params, on: np.ndarray, d: np.ndarray, out: Params) -> np.ndarray:
        return d * on


class Tanh(Plain):
    def forward(self, w: Params, x: np.ndarray, rows: Rows):
        y = np.tanh(x)
        return y, y

    def backward(self, w: Params, y: np.ndarray, d: np.ndarray, out: Params) -> np.ndarray:
        return d * (1 - y * y)


class Sigmoid(Plain):
    def forward(self, w: Params, x: np.ndarray, rows: Rows):
        y = 1 / (1 + np.exp(-x))
        return y, y

    def backward(self, w: Params, y: np.ndarray, d: np.ndarray, out: Params) -> np.ndarray:
        return d * y * (1 - y)


@dataclass(frozen=True)
class Dropout(Plain):
    """Zeros a share of the values and scales the others up; nothing in evaluation.

    A value's fate is a hash of its row's key, its place, this layer and the
    draw, so a task that runs again draws the same.
    """

    layer: int
    rate: float

    def forward(self, w: Params, x: np.ndarray, rows: Rows):
        if rows.draw is None or not self.rate:
            return x, None
        with np.errstate(over="ignore"):
            seed = _mixed(rows.hashes ^ _mixed(np.array([rows.draw * 256 + self.layer], dtype=np.uint64)))
            code = _mixed(seed[:, None] + np.arange(x.shape[1], dtype=np.uint64) * _MIX[2])
        kept = ((code >> np.uint64(11)).astype(np.float64) / 2.0**53 >= self.rate) / (1 - self.rate)
        return x * kept, kept

    def backward(self, w: Params, kept: np.ndarray | None, d: np.ndarray, out: Params) -> np.ndarray:
        return d if kept is None else d * kept


@dataclass(frozen=True)
class Norm:
    """Layer norm with a scale and a shift for each place."""

    name: str
    width: int
    eps: float = 1e-5

    def start(self, rng: np.random.Generator) -> Params:
        return {f"{self.name}.weight": np.ones(self.width), f"{self.name}.bias": np.zeros(self.width)}

    def forward(self, w: Params, x: np.ndarray, rows: Rows):
        dev = np.sqrt(x.var(axis=1, keepdims=True) + self.eps)
        y = (x - x.mean(axis=1, keepdims=True)) / dev
        return y * w[f"{self.name}.weight"] + w[f"{self.name}.bias"], (y, dev)

    def backward(self, w: Params, saved, d: np.ndarray, out: Params) -> np.ndarray:
        y, dev = saved
        out[f"{self.name}.weight"], out[f"{self.name}.bias"] = (d * y).sum(axis=0), d.sum(axis=0)
        d = d * w[f"{self.name}.weight"]
        return (d - d.mean(axis=1, keepdims=True) - y * (d * y).mean(axis=1, keepdims=True)) / dev


def _sums(x: np.ndarray, rows: Rows) -> np.ndarray:
    """Sums over each utterance's frames; utterances have one frame at least."""
    return np.add.reduceat(x, rows.first, axis=0) if len(rows.counts) else x[:0]


class MeanPool(Plain):
    """Means over the frames of each utterance."""

    def forward(self, w: Params, x: np.ndarray, rows: Rows):
        return _sums(x, rows) / rows.counts[:, None], rows

    def backward(self, w: Params, rows: Rows, d: np.ndarray, out: Params) -> np.ndarray:
        return np.repeat(d / rows.counts[:, None], rows.counts, axis=0)


@dataclass(frozen=True)
class AttentionPool:
    """Frames weighted by the softmax, over their utterance, of a linear score."""

    name: str
    width: int

    def start(self, rng: np.random.Generator) -> Params:
        return Linear(self.name, self.width, 1).start(rng)

    def forward(self, w: Params, x: np.ndarray, rows: Rows):
        s = x @ w[f"{self.name}.weight"][0] + w[f"{self.name}.bias"][0]
        top = np.maximum.reduceat(s, rows.first) if len(rows.counts) else s
        e = np.exp(s - np.repeat(top, rows.counts))
        a = e / np.repeat(_sums(e, rows), rows.counts)
        return _sums(a[:, None] * x, rows), (x, a, rows)

    def backward(self, w: Params, saved, d: np.ndarray, out: Params) -> np.ndarray:
        x, a, rows = saved
        each = np.repeat(d, rows.counts, axis=0)
        along = (each * x).sum(axis=1)
        score = a * (along - np.repeat(_sums(a * along, rows), rows.counts))
        out[f"{self.name}.weight"], out[f"{self.name}.bias"] = (score @ x)[None, :], np.array([score.sum()])
        return a[:, None] * each + score[:, None] * w[f"{self.name}.weight"]


def forward(layers: list, w: Params, x: np.ndarray, rows: Rows) -> tuple[np.ndarray, list]:
    saved = []
    for layer in layers:
        x, s = layer.forward(w, x, rows)
        saved.append(s)
    return x, saved


def backward(layers: list, w: Params, saved: list, d: np.ndarray, out: Params) -> np.ndarray:
    for layer, s in zip(reversed(layers), reversed(saved), strict=True):
        d = layer.backward(w, s, d, out)
    return d


@dataclass(frozen=True)
class Network:
    """Branches over the input, each with the dimensions that it predicts, and a classifier over the input or over those predictions."""

    kind: str
    width: int
    branches: tuple[tuple[tuple[str, ...], list], ...] = ()
    classifier: list = field(default_factory=list)
    mediated: bool = False
    classes: int = 0

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(d for names, _ in self.branches for d in names)

    def start(self, seed: int) -> Params:
        """Weights by a seeded generator, branch by branch."""
        rng = np.random.default_rng(seed)
        out: Params = {}
        for layer in [*(x for _, layers in self.branches for x in layers), *self.classifier]:
            out |= layer.start(rng)
        return out

    def predict(self, w: Params, x: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Predictions, a column for each of dims, and logits; and what gradients() needs."""
        parts = [forward(layers, w, x, rows) for _, layers in self.branches]
        vad = np.concatenate([y for y, _ in parts], axis=1) if parts else np.zeros((len(rows.counts), 0))
        z, top = forward(self.classifier, w, vad if self.mediated else x, rows) if self.classifier else (np.zeros((len(vad), 0)), [])
        return vad, z, ([s for _, s in parts], top)

    def gradients(self, w: Params, saved: tuple, d_vad: np.ndarray, d_logits: np.ndarray) -> Params:
        """Gradients of a loss with these derivatives in predictions and logits."""
        out: Params = {}
        if self.classifier:
            d = backward(self.classifier, w, saved[1], d_logits, out)
            d_vad = d_vad + d if self.mediated else d_vad
        at = 0
        for (names, layers), s in zip(self.branches, saved[0], strict=True):
            backward(layers, w, s, d_vad[:, at : at + len(names)], out)
            at += len(names)
        return out


def _two(name: str, width: int, hidden: int, outputs: int) -> list:
    return [Linear(f"{name}.pre_net", width, hidden), Relu(), Linear(f"{name}.post_net", hidden, outputs)]


def separate_heads(classes: int, width: int = 768, hidden: int = 256, dims: tuple[str, ...] = DIMS) -> Network:
    """A hidden layer and an output for the classes, and for each dimension one of its own, over a pooled vector."""
    return Network("parallel_emotion_vad", width, tuple(((d,), _two(f"{d}_head", width, hidden, 1)) for d in dims), _two("emotion_head", width, hidden, classes), False, classes)


def vad_head(dims: tuple[str, ...] = DIMS, width: int = 768, hidden: int = 256) -> Network:
    """A hidden layer that the dimensions share, over a pooled vector."""
    if not 2 <= len(dims) <= 3:
        raise ValueError(f"two or three dimensions, not {dims}")
    return Network("vad_head", width, ((dims, _two("vad_head", width, hidden, len(dims))),))


def mediated_heads(classes: int, dims: tuple[str, ...] = DIMS, width: int = 768, hidden: int = 256) -> Network:
    """The shared head, and a linear classifier that sees its predictions only."""
    if classes < 2:
        raise ValueError(f"two classes at least, not {classes}")
    return Network("vad_emotion", width, vad_head(dims, width, hidden).branches, [Linear("classifier", len(dims), classes)], True, classes)


def frame_classifier(classes: int, width: int = 768, hidden: int = 256) -> Network:
    """A hidden layer on each frame, the mean over frames, and an output for the classes."""
    return Network("frame_classifier", width, (), [Linear("pre_net", width, hidden), Relu(), MeanPool(), Linear("post_net", hidden, classes)], False, classes)


def bounded_regressor(width: int = 768, hidden: int = 256, rate: float = 0.1, dims: tuple[str, ...] = ("arousal", "dominance", "valence")) -> Network:
    """Frames' mean, dropout, a hidden layer of tanh, dropout, outputs on 0..1."""
    return Network("bounded_regressor", width, ((dims, [MeanPool(), Dropout(0, rate), Linear("regressor.1", width, hidden), Tanh(), Dropout(1, rate), Linear("regressor.4", hidden, len(dims)), Sigmoid()]),))


def attentive_decoder(classes: int, width: int = 768, hidden: int = 256, dims: tuple[str, ...] = DIMS) -> Network:
    """Attention over frames, a normed hidden layer and outputs on -1..1 (the decoder), and a linear classifier over these."""
    decoder = [AttentionPool("vad_decoder.score", width), Linear("vad_decoder.hidden", width, hidden), Norm("vad_decoder.norm", hidden), Relu(), Linear("vad_decoder.out", hidden, len(dims)), Tanh()]
    return Network("two_stage", width, ((dims, decoder),), [Linear("classifier", len(dims), classes)], True, classes)
