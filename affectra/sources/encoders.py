"""Feature extractors: any callable of samples, named ones, and encoders that a factory makes where they run."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import numpy as np


def resolved(spec: str) -> Callable:
    """The callable that "module:function" names."""
    module, colon, name = spec.partition(":")
    if not colon or not module or not name:
        raise ValueError(f"{spec!r} is not module:function")
    got = getattr(importlib.import_module(module), name)
    if not callable(got):
        raise TypeError(f"{spec} is not callable")
    return got


def normalised(samples: np.ndarray) -> np.ndarray:
    """Samples less their mean over their deviation."""
    x = np.asarray(samples, dtype=np.float64)
    return (x - x.mean()) / np.sqrt(x.var() + 1e-5) if len(x) else x


class Encoder:
    """samples -> [frames, width] by an encoder that factory(arguments) makes once in each task.

    factory: a callable, or "module:function". What it makes has
    extract_features(source, padding_mask=None, mask=False, remove_extra_tokens=True)
    (or without the last two), for a source [1, samples]; the result may be the
    features, a tuple that begins with them, or a mapping with "x". Only factory
    and arguments travel to executors.
    """

    def __init__(self, factory: Callable | str, arguments=None, normalise: bool = False):
        self.factory, self.arguments, self.normalise = factory, arguments, normalise
        self._made = None

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    def __call__(self, samples) -> np.ndarray:
        if self._made is None:
            make = resolved(self.factory) if isinstance(self.factory, str) else self.factory
            self._made = make(self.arguments)
        source = np.asarray(normalised(samples) if self.normalise else samples, dtype=np.float32)[None, :]
        try:
            out = self._made.extract_features(source, padding_mask=None, mask=False, remove_extra_tokens=True)
        except TypeError:
            out = self._made.extract_features(source, padding_mask=None)
        x = out["x"] if isinstance(out, dict) else out[0] if isinstance(out, tuple) else out
        x = np.asarray(x, dtype=np.float32)
        return x[0] if x.ndim == 3 else x


def checked(x, width: int, what: str) -> np.ndarray:
    """Features as a matrix of finite 32-bit floats with at least one frame; an error names what they were made of."""
    a = np.asarray(x, dtype=np.float32)
    if a.ndim != 2 or a.shape[1] != width or not len(a):
        raise ValueError(f"{what}: features {a.shape} instead of (frames, {width})")
    if not np.isfinite(a).all():
        raise ValueError(f"{what}: features that are not finite")
    return a
