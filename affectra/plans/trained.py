"""Training by a configuration: from feature files to a saved model, its summary and its figures; and saved models read again."""

from __future__ import annotations

import json
from dataclasses import MISSING, asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affectra.operators import networks as N
from affectra.operators.fitting import Fitted, fit, utterances
from affectra.operators.metrics import DIMS
from affectra.operators.payloads import KIND, HeadsConfig, check_training_arguments
from affectra.sources.files import LABELS, load_model, read_prefix, save_model, write_json

from .study import over_frames

#: Kinds of model that are trained here.
KINDS = (KIND, "vad_emotion", "vad_head")
#: Names by which configuration files may call a field.
NAMES = {"lr": "learning_rate", "epoch": "epochs", "feat_path": "train_prefix", "label_names": "class_labels"}


@dataclass(frozen=True)
class Training:
    """What a training run is told; faults are all in one error.

    valid_prefix: without it the last epoch is kept. initial: a saved model of
    separate heads to go on from. batch_size: None trains on all rows at a time.
    """

    train_prefix: str
    output: str
    kind: str = KIND
    valid_prefix: str | None = None
    initial: str | None = None
    class_labels: tuple[str, ...] = LABELS
    epochs: int = 10
    batch_size: int | None = 32
    learning_rate: float = 1e-3
    weight_decay: float = 0.0
    input_dim: int = 768
    hidden_dim: int = 256
    lambda_vad: float = 1.0
    lambda_emo: float = 1.0
    seed: int = 42
    min_length: int = 1
    max_length: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "class_labels", tuple(self.class_labels))
        faults = []
        try:
            check_training_arguments(self.lambda_vad, self.lambda_emo, self.epochs, self.batch_size or 1, self.learning_rate, self.weight_decay)
        except ValueError as e:
            faults.append(str(e))
        rules = {
            f"kind {self.kind!r} is none of {KINDS}": self.kind in KINDS,
            "hidden_dim or input_dim below 1": min(self.hidden_dim, self.input_dim) >= 1,
            "min_length below 0": self.min_length >= 0,
            "max_length below min_length": self.max_length is None or self.max_length >= self.min_length,
            f"only {KIND} goes on from another model": self.initial is None or self.kind == KIND,
        }
        faults += [what for what, ok in rules.items() if not ok]
        if faults:
            raise ValueError("; ".join(faults))


def _parsed(text: str, path: str) -> dict:
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise ValueError(f"{path}: no YAML library here; write the configuration as JSON") from None
        return yaml.safe_load(text) or {}
    return json.loads(text)


def configured(spark: SparkSession, path: str | None = None, **over) -> Training:
    """The configuration of a JSON or YAML file, over which the arguments go.

    Sections are named for readers only: their entries count as if they stood at
    the top. Entries that no field is called, values that are still to be filled
    in ("??"), and fields without a value are refused, each kind in one error.
    """
    given: dict = {}
    if path:
        tree = _parsed(spark.read.text(path, wholetext=True).first()[0], path)
        for k, v in tree.items():
            given |= v if isinstance(v, dict) else {k: v}
    given = {NAMES.get(k, k): v for k, v in given.items() if not k.startswith("_")} | over
    known = {f.name: f for f in fields(Training)}
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"{path or 'arguments'}: no entry is called {', '.join(unknown)}")
    kinds = {"float": float, "int": int}
    given = {k: kinds[known[k].type](v) if known[k].type in kinds and isinstance(v, str) and v != "??" else v for k, v in given.items()}
    lacking = sorted({k for k, v in given.items() if v == "??"} | {k for k, f in known.items() if f.default is MISSING and k not in given})
    if lacking:
        raise ValueError(f"{path or 'arguments'}: no value for {', '.join(lacking)}")
    return Training(**given)


@dataclass(frozen=True)
class MediatedConfig:
    """What is saved beside a network whose classes see predicted dimensions only; older models may lack all but target_dim."""

    target_dim: int
    input_dim: int = 768
    hidden_dim: int = 256
    class_labels: tuple[str, ...] = LABELS
    class_names: tuple[str, ...] | None = None

    @classmethod
    def of(cls, saved: dict, labels: tuple[str, ...] = LABELS) -> MediatedConfig:
        """From saved metadata; the labels must be the expected ones in their order."""
        if "target_dim" not in saved:
            raise ValueError("saved without target_dim")
        known = {f.name: saved[f.name] for f in fields(cls) if f.name in saved}
        got = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})
        if got.class_labels != tuple(labels):
            raise ValueError(f"saved with labels {got.class_labels}, expected {tuple(labels)}")
        return got

    def __post_init__(self):
        object.__setattr__(self, "class_names", self.class_names or self.class_labels)
        if self.target_dim not in (2, 3):
            raise ValueError(f"target_dim {self.target_dim} is neither 2 nor 3")
        if len(self.class_names) != len(self.class_labels):
            raise ValueError(f"labels {self.class_labels}, but names {self.class_names}")


def network_of(metadata: dict, labels: tuple[str, ...] | None = None) -> N.Network:
    """The network, over frames, that saved metadata describe; separate heads name their kind, a mediated one has labels, a plain head has neither."""
    if metadata.get("model_type") == KIND:
        config = HeadsConfig.of(metadata)
        return over_frames(N.separate_heads(config.num_classes, config.input_dim, config.hidden_dim))
    if "class_labels" in metadata or metadata.get("model_type") == "vad_emotion":
        m = MediatedConfig.of(metadata, labels or LABELS)
        return over_frames(N.mediated_heads(len(m.class_labels), DIMS[: m.target_dim], m.input_dim, m.hidden_dim))
    if metadata.get("target_dim") not in (2, 3):
        raise ValueError(f"target_dim {metadata.get('target_dim')} is neither 2 nor 3")
    return over_frames(N.vad_head(DIMS[: metadata["target_dim"]], metadata.get("input_dim", 768), metadata.get("hidden_dim", 256)))


def save(spark: SparkSession, path: str, weights: N.Params, metadata: dict, labels: tuple[str, ...] | None = None) -> None:
    """A model and what describes it, once its weights fit that description."""
    want = {k: v.shape for k, v in network_of(metadata, labels).start(0).items()}
    got = {k: v.shape for k, v in weights.items()}
    if got != want:
        differ = sorted(k for k in {*got, *want} if got.get(k) != want.get(k))
        raise ValueError("weights don't fit: " + ", ".join(f"{k} {got.get(k)} instead of {want.get(k)}" for k in differ))
    save_model(spark, weights, metadata, path)


def load(spark: SparkSession, path: str, target_dim: int | None = None, labels: tuple[str, ...] | None = None) -> tuple[N.Network, N.Params, dict]:
    """A saved model, its names rid of what wrappers put before them; weights that its description lacks or doesn't know are refused.

    target_dim: that of the model if it must be a certain one.
    """
    rows, metadata = load_model(spark, path)
    if target_dim is not None and metadata.get("target_dim", target_dim) != target_dim:
        raise ValueError(f"{path}: target_dim {metadata['target_dim']}, not {target_dim}")
    network = network_of(metadata, labels)
    want = network.start(0)
    if rows.keys() != want.keys() or any(rows[k].size != v.size for k, v in want.items()):
        raise ValueError(f"{path}: weights don't fit {network.kind}")
    return network, {k: rows[k].reshape(v.shape) for k, v in want.items()}, metadata


def rows_of(spark: SparkSession, prefix: str, config: Training) -> DataFrame:
    """(utt_id, frames, targets, class_idx) of the utterances within the length limits."""
    frames = read_prefix(spark, prefix, config.input_dim, config.min_length, config.max_length, config.kind == KIND, config.class_labels, config.kind != "vad_head")
    carried = ["utt_id", *DIMS, *(["class_idx"] if config.kind != "vad_head" else [])]
    return utterances(frames.withColumn("feat", F.col("feat").cast("array<double>")), carried=carried)


def _start(spark: SparkSession, config: Training, dims: tuple[str, ...]) -> tuple[N.Network, N.Params | None, dict]:
    n = len(config.class_labels)
    if config.kind == KIND:
        network = over_frames(N.separate_heads(n, config.input_dim, config.hidden_dim))
        if config.initial:
            _, weights, saved = load(spark, config.initial)
            HeadsConfig.of(saved).continues(config.hidden_dim, list(config.class_labels))
            return network, weights, saved
        return network, None, {}
    make = N.mediated_heads(n, dims, config.input_dim, config.hidden_dim) if config.kind == "vad_emotion" else N.vad_head(dims, config.input_dim, config.hidden_dim)
    return over_frames(make), None, {}


def train(spark: SparkSession, config: Training, metrics: str | None = None) -> dict:
    """A model trained and saved as the configuration says; its summary, also as JSON at `metrics` if given.

    Separate heads keep the epoch of least validation loss, as mediated ones do;
    a plain head that of the greatest mean CCC. Dominance without labels is
    untrained, or as the model was from which training goes on.
    """
    rows = rows_of(spark, config.train_prefix, config)
    held = rows_of(spark, config.valid_prefix, config) if config.valid_prefix else None
    counts = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(d).isNotNull() & ~F.isnan(d)).alias(d) for d in DIMS)).first().asDict()
    n, counts = counts.pop("n"), {d: int(c) for d, c in counts.items()}
    dims = DIMS if counts["dominance"] else DIMS[:2]
    network, weights, saved = _start(spark, config, dims)
    select = {"select": "mean_ccc", "largest": True} if config.kind == "vad_head" else {}
    got: Fitted = fit(
        rows, held, network, config.epochs, config.learning_rate, weights, decay=config.weight_decay, lambda_vad=config.lambda_vad, lambda_emo=0.0 if config.kind == "vad_head" else config.lambda_emo,
        batch_size=config.batch_size, seed=config.seed, key="utt_idx", feat="frames", label=None if config.kind == "vad_head" else "class_idx", **select,
    )
    before = saved.get("dominance_status")
    status = "trained" if counts["dominance"] else "retained_from_checkpoint" if before in ("trained", "retained_from_checkpoint") else "untrained"
    told = {"history": got.history, "saved_epoch": got.saved_epoch, "selection": got.selection, **{k: v for k, v in asdict(config).items() if k not in ("output", "class_labels")}}
    described = {"input_dim": config.input_dim, "hidden_dim": config.hidden_dim, "metadata": told}
    labels = {"class_labels": list(config.class_labels), "class_names": list(config.class_labels), "num_classes": len(config.class_labels), "lambda_vad": config.lambda_vad, "lambda_emo": config.lambda_emo}
    if config.kind == KIND:
        described |= {"model_type": KIND, **labels, "dominance_status": status, "vad_label_counts": counts, "supervised_dimensions": [d for d, c in counts.items() if c]}
    else:
        described |= {"target_dim": len(dims), **({"model_type": "vad_emotion", **labels} if config.kind == "vad_emotion" else {})}
    save(spark, config.output, got.weights, described, config.class_labels)
    best = next((h["valid"] for h in got.history if h["epoch"] == got.saved_epoch and "valid" in h), None)
    summary = {"output": config.output, "kind": config.kind, "num_samples": n, **{k: v for k, v in described.items() if k != "metadata"}, "saved_epoch": got.saved_epoch, "selection": got.selection, "train": got.history[-1]["train"], "valid": best, "history": got.history}
    write_json(summary, metrics)
    return summary
