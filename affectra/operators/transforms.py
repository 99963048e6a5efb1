"""Label scales, names, paths and normalisers as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import DIMS, finite

#: Scales in the order in which they are tried: least, most, how it becomes 0..1. Fixed values.
SCALES = ((0.0, 1.0), (1.0, 5.0), (1.0, 9.0), (-1.0, 1.0))


def rescale_auto(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns brought to 0..1 by the first scale that holds all finite values, then clipped.

    A column without finite values is left alone; one that fits no scale is an
    error.
    """
    bounds = df.agg(*(f(F.when(finite(F.col(c)), F.col(c))).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max)))).first()
    out = df
    for c in columns:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        if lo is None:
            continue
        scale = next(((a, b) for a, b in SCALES if a <= lo and hi <= b), None)
        if scale is None:
            raise ValueError(f"{c}: {lo} to {hi} fits no known scale")
        x = (F.col(c) - scale[0]) / (scale[1] - scale[0])
        out = out.withColumn(c, F.when(F.col(c).isNull() | F.isnan(c), F.col(c)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))))
    return out


def five_point(x: Column) -> Column:
    """1..5 to -1..1."""
    return (x - 3) / 2


def fit_minmax(df: DataFrame, split: str = "split") -> DataFrame:
    """One row: lo and hi of each dimension over the training rows, 0 and 0 where untrained, and whether it was trained."""
    train = F.col(split) == "train"
    cells = []
    for d in DIMS:
        x = F.when(train, F.col(d))
        cells += [F.coalesce(F.min(x), F.lit(0.0)).alias(f"lo_{d}"), F.coalesce(F.max(x), F.lit(0.0)).alias(f"hi_{d}"), (F.count(x) > 0).alias(f"trained_{d}")]
    return df.agg(*cells)


def minmax(x: Column, lo: Column, hi: Column, trained: Column) -> Column:
    return F.when(~trained | (hi == lo), F.when(x.isNotNull(), 0.0)).otherwise(2 * (x - lo) / (hi - lo) - 1)


def minmax_inverse(x: Column, lo: Column, hi: Column, trained: Column) -> Column:
    return F.when(trained, F.when(hi == lo, lo).otherwise((x + 1) * (hi - lo) / 2 + lo))


def merged_label(label: Column, words: bool = False) -> Column:
    """exc becomes hap: the whole label, or each whole word of a line."""
    return F.regexp_replace(label, r"\bexc\b", "hap") if words else F.when(label == "exc", "hap").otherwise(label)


def session_of(utt: Column) -> Column:
    return F.substring(utt, 5, 1)


def conversation_of(utt: Column) -> Column:
    return F.regexp_replace(utt, "_[^_]*$", "")


def absolute(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", F.lit(root), path))


def relative(path: Column, root: str) -> Column:
    """The path without the root that it begins with, and without slashes before what follows."""
    return F.ltrim(F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path), F.lit("/"))


def suffix(path: Column) -> Column:
    """The last dot of the name and what follows; empty for none, or where it begins or ends the name."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def cleaned(text: Column) -> Column:
    """Without outer white space, in lower case."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def up_to(n: Column, multiple: int = 320) -> Column:
    """How many samples fill n up to a multiple."""
    return F.pmod(-n, F.lit(multiple))


#: Columns of a prepared label table, in order: a fixed value.
PREPARED = ("file_path", "valence", "arousal", "dominance", "split", "session")


def prepared_labels(df: DataFrame, names: dict[str, str], required: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """The columns PREPARED and no others, taken by the given names (PREPARED's own by default).

    A column that isn't there is null, with a warning that names all of them;
    one of `required` is an error.
    """
    import warnings

    of = {c: names.get(c, c) for c in PREPARED}
    missing = [c for c, n in of.items() if n not in df.columns]
    lost = [of[c] for c in missing if c in required]
    if lost:
        raise ValueError(f"no column {', '.join(lost)}")
    if missing:
        warnings.warn(f"no column {', '.join(of[c] for c in missing)}: left empty", stacklevel=2)
    kind = lambda c: "double" if c in DIMS else "string"
    return df.select(*((F.lit(None) if c in missing else F.col(f"`{of[c]}`")).try_cast(kind(c)).alias(c) for c in PREPARED))


def cache_key(path: Column, size: Column, modified: Column, encoder: str) -> Column:
    return F.sha2(F.concat_ws("|", path, size.cast("string"), modified.cast("string"), F.lit(encoder)), 256)


def dominance_status(count: Column, before: Column) -> Column:
    """trained if labels exist; else kept from a checkpoint that was trained; else untrained."""
    return F.when(count > 0, "trained").when(before.isin("trained", "retained_from_checkpoint"), "retained_from_checkpoint").otherwise("untrained")
