"""What a prediction hands on: payloads as JSON, the folder table, checks of checkpoints and arguments."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .metrics import DIMS

#: States of the Dominance head, and the texts that warn of an untrained one in the table and in the payload.
STATUSES = ("trained", "retained_from_checkpoint", "untrained")
TABLE_WARNING = "Dominance教師がないためDヘッドは未学習です。出力値は研究結果に使用できません。"
PAYLOAD_WARNING = "Dominance is emitted numerically but its head has no supervised training and is not a learned dominance estimate."


def named(values: Column, names: tuple[str, ...]) -> Column:
    """A vector as a struct of named doubles."""
    return F.struct(*(F.get(values, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)))


def scale_status(trained: Column) -> Column:
    return F.when(trained, "original_scale").otherwise("unavailable_normalized_value_repeated")


def vad_payload(rows: DataFrame, path: str, vad: str, dims: tuple[str, ...], checkpoint: str | None, random_head: bool) -> DataFrame:
    """(path, payload): JSON of one prediction of two or three dimensions."""
    body = F.struct(F.col(path).alias("wav"), F.lit(len(dims)).alias("target_dim"), F.array(*map(F.lit, dims)).alias("labels"), named(F.col(vad), dims).alias("prediction"), F.lit(checkpoint).cast("string").alias("head_checkpoint"), F.lit(random_head).alias("random_head"))
    return rows.select(path, F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


#: The kind that models of separate heads are saved as: a fixed value.
KIND = "parallel_emotion_vad"


@dataclass(frozen=True)
class HeadsConfig:
    """What is saved beside the weights of separate heads; what doesn't fit together is refused, all of it in one error."""

    class_labels: tuple[str, ...] = ("hap", "sad", "ang", "dis")
    class_names: tuple[str, ...] | None = None
    num_classes: int | None = None
    input_dim: int = 768
    hidden_dim: int = 256
    dominance_status: str = STATUSES[-1]
    vad_label_counts: dict[str, int] = field(default_factory=dict)
    supervised_dimensions: tuple[str, ...] = ()

    @classmethod
    def of(cls, saved: dict) -> HeadsConfig:
        """From saved metadata, whose other entries are left alone."""
        if saved.get("model_type") != KIND:
            raise ValueError(f"saved as {saved.get('model_type')}, not as {KIND}")
        known = {f.name: saved[f.name] for f in fields(cls) if f.name in saved}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})

    def __post_init__(self):
        put = object.__setattr__
        put(self, "class_names", self.class_names or self.class_labels)
        put(self, "num_classes", self.num_classes or len(self.class_labels))
        rules = {
            f"{self.num_classes} classes, but labels {self.class_labels}": len(self.class_labels) == self.num_classes,
            f"{self.num_classes} classes, but names {self.class_names}": len(self.class_names) == self.num_classes,
            f"dominance_status {self.dominance_status}": self.dominance_status in STATUSES,
        }
        if not all(rules.values()):
            raise ValueError("; ".join(k for k, ok in rules.items() if not ok))

    def continues(self, hidden_dim: int, labels: list[str]) -> HeadsConfig:
        """Itself, if training may go on from it: width and order of labels are the same."""
        if (self.hidden_dim, self.class_labels) != (hidden_dim, tuple(labels)):
            raise ValueError(f"saved with {self.hidden_dim} and {self.class_labels}, asked for {hidden_dim} and {tuple(labels)}")
        return self


def parallel_payload(rows: DataFrame, path: str, logits: str, vad: str, config: HeadsConfig, checkpoint: str) -> DataFrame:
    """(path, payload): JSON of a parallel prediction; a warning is in it only where Dominance is untrained."""
    labels, status = config.class_labels, config.dominance_status
    p, best = A.softmax(F.col(logits)), A.argmax(F.col(logits)).cast("int")
    of = lambda names: F.element_at(F.array(*map(F.lit, names)), F.col("best") + 1)
    by_label = lambda x: F.struct(*(F.get(x, F.lit(i)).alias(c) for i, c in enumerate(labels)))
    states = dict(zip(DIMS, ("trained", "trained", status), strict=True))
    parts = [
        F.col(path).alias("wav"), F.lit(checkpoint).alias("classifier_checkpoint"), F.lit(KIND).alias("model_type"), F.array(*map(F.lit, labels)).alias("class_labels"),
        F.struct(F.col("best").alias("index"), of(labels).alias("code"), of(config.class_names).alias("name")).alias("prediction"),
        by_label(F.col("p")).alias("probabilities"), by_label(F.col(logits)).alias("logits"),
        F.struct(*(F.struct(F.get(vad, F.lit(i)).alias("value"), F.lit(s).alias("status")).alias(d) for i, (d, s) in enumerate(states.items()))).alias("vad"),
        F.struct(*(F.lit(config.vad_label_counts.get(d, 0)).alias(d) for d in DIMS)).alias("vad_label_counts"), F.array(*map(F.lit, config.supervised_dimensions)).cast("array<string>").alias("supervised_dimensions"),
    ]
    if status == "untrained":
        parts.append(F.lit(PAYLOAD_WARNING).alias("warning"))
    return rows.withColumns({"p": p, "best": best}).select(path, F.to_json(F.struct(*parts)).alias("payload"))


def folder_table(rows: DataFrame, labels: tuple[str, ...], fitted: DataFrame, path: str = "path", logits: str = "logits", vad: str = "vad") -> DataFrame:
    """The flat table of a folder's predictions: file, label, a probability a class, and for each dimension the
    normalised value, the value on the original scale, whether it was trained and whether its scale is known.

    fitted is the one row of transforms.fit_minmax. An untrained dimension has no
    scale, so its normalised value is repeated; untrained Dominance is warned of.
    """
    from .transforms import minmax_inverse

    made = rows.withColumn("p", A.softmax(F.col(logits))).join(F.broadcast(fitted))
    out = [F.regexp_extract(path, "([^/]*)$", 1).alias("audio_file"), F.element_at(F.array(*map(F.lit, labels)), A.argmax(F.col("p")).cast("int") + 1).alias("predicted_emotion")]
    out += [F.get("p", F.lit(i)).alias(f"probability_{c}") for i, c in enumerate(labels)]
    for i, d in enumerate(DIMS):
        x, trained = F.get(vad, F.lit(i)), F.col(f"trained_{d}")
        out += [x.alias(f"{d}_normalized"), F.coalesce(minmax_inverse(x, F.col(f"lo_{d}"), F.col(f"hi_{d}"), trained), x).alias(d)]
        out += [F.when(trained, "trained").otherwise("untrained").alias(f"{d}_status"), scale_status(trained).alias(f"{d}_scale_status")]
    return made.select(*out, F.when(F.col("trained_dominance"), "").otherwise(TABLE_WARNING).alias("warning"))


def margins(rows: DataFrame, logits: str = "logits") -> DataFrame:
    """rows with best, runner_up, logit_margin and probability_margin; ties by smaller index."""
    r = A.ranked(F.col(logits))
    both = rows.withColumn("r", r).withColumn("p", A.softmax(F.col(logits)))
    a, b = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return both.select(*rows.columns, a["idx"].alias("best"), b["idx"].alias("runner_up"), (a["value"] - b["value"]).alias("logit_margin"), (F.get("p", a["idx"]) - F.get("p", b["idx"])).alias("probability_margin"))


def check_training_arguments(lambda_vad: float, lambda_emo: float, epochs: int, batch_size: int, learning_rate: float, weight_decay: float = 0.0) -> None:
    """Bounds of the arguments, all faults in one error."""
    faults = [m for bad, m in ((lambda_vad < 0 or lambda_emo < 0, "loss weights below 0"), (lambda_vad == 0 and lambda_emo == 0, "both loss weights 0"), (epochs < 1, "epochs below 1"), (batch_size < 1, "batch_size below 1"), (learning_rate <= 0, "learning_rate not above 0"), (weight_decay < 0, "weight_decay below 0")) if bad]
    if faults:
        raise ValueError("; ".join(faults))


def check_inference_arguments(model_dir: str | None, checkpoint: str | None, head: str | None, allow_random: bool) -> None:
    """An encoder needs its folder and its checkpoint; a head is needed unless a random one is allowed."""
    if bool(model_dir) != bool(checkpoint):
        raise ValueError("model_dir and checkpoint go together")
    if not head and not allow_random:
        raise ValueError("a head is needed unless a random one is allowed")


def training_summary(history: list[dict], metric: str, labels: list[str], counts: dict[str, int], dominance_status: str, output: str, largest: bool = False) -> dict:
    """Where the model lies, its labels and dimensions, the saved epoch and how it was chosen, the last training figures and the history."""
    if not history:
        raise ValueError("no epoch was trained")
    scored = [h for h in history if h.get(metric) is not None]
    best = (max if largest else min)(scored, key=lambda h: (h[metric], -h["epoch"]) if largest else (h[metric], h["epoch"])) if scored else history[-1]
    return {"output": output, "model_type": KIND, "class_labels": list(labels), "num_classes": len(labels), "vad_label_counts": counts, "supervised_dimensions": [d for d in DIMS if counts.get(d)], "dominance_status": dominance_status, "saved_epoch": best["epoch"], "selection": f"best {metric}" if scored else "last epoch", "train": history[-1], "valid": best if scored else None, "history": history}
