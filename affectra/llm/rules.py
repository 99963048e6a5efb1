"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

Statistics of whole texts are Spark expressions. On a bounded sample of labelled
rows the driver grows small trees, takes every path from a root as a conjunctive
rule, and fits weights by logistic regression with a lasso penalty, which leaves
few rules. Those become one Column, so scoring is a projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, id_crc, packed, text_or_empty, unpacked

#: Labelled rows that the classifier is fitted on at most (the smallest by a hash of the id).
SAMPLE_ROWS = 8_000
#: Trees, rows drawn for each of them, their depth, thresholds tried for a statistic, rules kept for the lasso, its penalty and steps.
TREES, TREE_ROWS, DEPTH, CUTS, RULES, PENALTY, STEPS = 40, 2_000, 3, 24, 160, 0.002, 400


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; all are 0 or 1 and the like for empty texts, never null."""
    n = F.greatest(F.length(text), F.lit(1))

    def share(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))) / n

    words, lines = F.split(F.lower(text), r"[\x20\x09-\x0D]+", -1), F.split(text, "\n", -1)
    return {
        "chars": F.log1p(F.length(text).cast("double")),
        "upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / n,
        "digits": share("0123456789"),
        "stops": share(".,;:?"),
        "shouts": share("!"),
        "bars": share("|"),
        "signs": share("#$%&*<>{}[]=_~^\\/@+"),
        "blanks": share(" "),
        "lines": F.size(lines) / n,
        "line_kinds": F.size(F.array_distinct(lines)) / F.size(lines),
        "word_kinds": F.size(F.array_distinct(words)) / F.size(words),
        "word_length": n / F.size(words),
        "words": F.log1p(F.size(words).cast("double")),
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / F.size(words),
    }


@dataclass
class RuleModel:
    """A logistic score over rules; a rule is ((statistic, above, threshold), ...)."""

    rules: list[tuple[tuple[str, bool, float], ...]]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            held = F.lit(True)
            for name, above, t in rule:
                held = held & ((F.col(name) > t) if above else (F.col(name) <= t))
            total = total + F.when(held, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], rng, path: tuple, out: list) -> None:
    """Paths of one tree below a node; each split lowers the squared error most, among a random half of the statistics."""
    if len(path) == DEPTH or len(rows) < 20:
        return
    yy = y[rows]
    best = (1e-9, -1, 0.0)
    base = yy.sum() ** 2 / len(yy)
    for j in rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]:
        xs = x[rows, j]
        for t in cuts[j]:
            low = xs <= t
            n = int(low.sum())
            if 5 <= n <= len(rows) - 5:
                s = yy[low].sum()
                gain = s * s / n + (yy.sum() - s) ** 2 / (len(yy) - n) - base
                if gain > best[0]:
                    best = (gain, int(j), float(t))
    if best[1] < 0:
        return
    low = x[rows, best[1]] <= best[2]
    for above, part in ((False, rows[low]), (True, rows[~low])):
        step = (*path, (best[1], above, best[2]))
        out.append(step)
        _grow(x, y, part, cuts, rng, step, out)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> RuleModel:
    """Rules and lasso logistic weights for labels y (0 or 1); one class or no rows give its smoothed rate alone."""
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return RuleModel([], [], bias)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, CUTS))) for j in range(x.shape[1])]
    paths: list[tuple] = []
    for _ in range(TREES):
        _grow(x, y, rng.choice(len(y), size=min(len(y), TREE_ROWS), replace=True), cuts, rng, (), paths)
    paths = sorted({tuple(sorted(p)) for p in paths})

    def holds(p) -> np.ndarray:
        return np.logical_and.reduce([(x[:, j] > t) if above else (x[:, j] <= t) for j, above, t in p])

    z = np.array([holds(p) for p in paths], dtype=float)
    rate = z.mean(axis=1)
    worth = np.abs(((z - rate[:, None]) * (y - y.mean())).mean(axis=1)) / np.sqrt(np.maximum(rate * (1 - rate), 1e-6))
    chosen = np.argsort(-worth, kind="stable")[:RULES]
    z = np.ascontiguousarray(z[chosen].T)
    w, v, b, t = np.zeros(len(chosen)), np.zeros(len(chosen)), bias, 1.0
    bv, step = b, 4.0 / (1 + float((z * z).sum(axis=1).mean()))
    for _ in range(STEPS):  # accelerated proximal gradient; einsum keeps to one thread
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j", z, v) + bv, -30, 30)))
        g = (p - y) / len(y)
        nw = v - step * np.einsum("ij,i", z, g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * PENALTY, 0)
        nb = bv - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, bv = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    used = [i for i in range(len(w)) if abs(w[i]) > 1e-6]
    return RuleModel([tuple((names[j], a, c) for j, a, c in paths[chosen[i]]) for i in used], [float(w[i]) for i in used], float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: Column | None = None) -> RuleModel:
    """Fit on the documents of at most SAMPLE_ROWS labels; folds: which labels may teach (all but fold 2 of 4 by default).

    Of an id's labels the largest counts; labels other than 0 and 1, and null
    ids, teach nothing; each row of a repeated id teaches. Labels tie in the
    sample by a hash of the id, thresholds and rules by their order. Without rows
    that teach, or with one class alone, the model is that class's smoothed rate.
    Other columns of both tables may have any names.
    """
    names = list(statistics(F.lit("")))
    may = folds if folds is not None else id_crc(id_col) % 4 != 2
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & may).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    taught = F.broadcast(marked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS))  # so texts needn't be dealt by id
    texts = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    stats = statistics(text_or_empty("text"))
    got = texts.join(taught, "id").select("id", "y", *(c.alias(k) for k, c in stats.items())).collect()
    got.sort(key=lambda r: (r["id"], *map(float, r[2:])))
    x = np.array([[float(r[k]) for k in names] for r in got]).reshape(len(got), len(names))
    return fit(x, np.array([float(r["y"]) for r in got]), names)


def score(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """docs with quality_score (0 to 1, higher is better).

    Null text scores as empty; each row is scored by itself, repeated or not. An
    empty table stays empty. Other columns may have any names; one named
    quality_score is replaced.
    """
    wide = scored(docs, model, text_col)
    return wide.select(*unpacked([c for c in docs.columns if c != "quality_score"]), "quality_score")


def scored(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """(row, quality_score): the rows of docs as structs, each with its score."""
    stats = statistics(text_or_empty(column(text_col)))
    wide = docs.select(packed(docs).alias("row"), *(c.cast("double").alias(k) for k, c in stats.items()))
    return wide.select("row", model.column().alias("quality_score"))
