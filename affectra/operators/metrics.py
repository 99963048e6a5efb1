"""Agreement and classification metrics as plain aggregates, one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import bound

#: What keeps a degenerate CCC finite.
EPSILON = 1e-8
#: The dimensions in their order everywhere.
DIMS = ("valence", "arousal", "dominance")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _only(x: Column, ok: Column) -> Column:
    return F.when(ok, x)


def both(p: str | Column, t: str | Column) -> Column:
    """Where there is a prediction and a finite target. A prediction that is NaN counts, and shows in the result."""
    p, t = (F.col(x) if isinstance(x, str) else x for x in (p, t))
    return p.isNotNull() & finite(t)


def ccc(p: str, t: str, ok: Column | None = None, least: int = 1, absent: float | None = None) -> Column:
    """Concordance correlation over rows where ok (by default those with a finite target); `absent` where fewer than `least` rows."""
    ok = both(p, t) if ok is None else ok & both(p, t)
    x, y = _only(F.col(p), ok), _only(F.col(t), ok)
    value = 2 * F.covar_pop(x, y) / (F.var_pop(x) + F.var_pop(y) + F.pow(F.avg(x) - F.avg(y), F.lit(2)) + EPSILON)
    return F.when(F.count(x) >= least, value).otherwise(F.lit(absent).cast("double"))


def ccc_loss(pairs: list[tuple[str, str]], least: dict[str, int] | None = None, mode: str = "mean") -> Column:
    """1 - CCC averaged (or summed) over dimensions that have rows; 0 if none has. least: rows a target needs."""
    parts = [1 - ccc(p, t, least=(least or {}).get(t, 1)) for p, t in pairs]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    n = sum((x.isNotNull().cast("int") for x in parts[1:]), parts[0].isNotNull().cast("int"))
    return total if mode == "sum" else F.coalesce(F.try_divide(total, n), F.lit(0.0))


def mae(p: str, t: str) -> Column:
    return F.avg(_only(F.abs(F.col(p) - F.col(t)), both(p, t)))


def class_index(rows: DataFrame, label: str) -> DataFrame:
    """(label, class_idx) of the distinct labels in sorted order; a class list is small."""
    return rows.select(F.col(label).alias("label")).where(F.col(label).isNotNull()).distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("class_idx"))


def confusion(rows: DataFrame, n: int, target: str = "true_class", predicted: str = "pred_class") -> DataFrame:
    """Dense confusion counts (target, predicted, n), zero cells included."""
    spark = rows.sparkSession
    cells = spark.range(n * n).select((F.col("id") / n).cast("int").alias("target"), (F.col("id") % n).cast("int").alias("predicted"))
    got = rows.groupBy(F.col(target).cast("int").alias("target"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(F.broadcast(got), ["target", "predicted"], "left").select("target", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(cells: DataFrame) -> DataFrame:
    """Counters and scores of each class; recall and reported F1 are null without support."""
    c = cells.select(F.explode(F.array(F.struct(F.col("target").alias("c"), F.lit(True).alias("t")), F.struct(F.col("predicted").alias("c"), F.lit(False).alias("t")))).alias("x"), "target", "predicted", "n").select("x.*", "target", "predicted", "n")
    sums = c.groupBy(F.col("c").alias("class_idx")).agg(
        F.sum(F.when(F.col("t"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("t"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("t") & (F.col("target") == F.col("predicted")), F.col("n")).otherwise(0)).alias("tp"),
    )
    recall, precision = F.try_divide(F.col("tp"), F.col("support")), F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    made = sums.withColumns({"recall": recall, "precision": precision, "fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    p, r = F.col("precision"), F.coalesce("recall", F.lit(0.0))
    return made.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def report(cells: DataFrame) -> DataFrame:
    """One row: WA; UA with absent classes skipped, refused (null) or zero; weighted, clamped and macro F1."""
    s, f, r = F.col("support"), F.col("f1"), F.col("recall")
    # clamped: denominators of at least 1, and of at least 1e-8 under the harmonic mean
    cp, cr = F.col("tp") / F.greatest("predicted", F.lit(1)), F.col("tp") / F.greatest("support", F.lit(1))
    clamped = 2 * cp * cr / F.greatest(cp + cr, F.lit(1e-8))
    return per_class(cells).agg(
        F.sum(s).alias("n"), F.try_divide(F.sum("tp"), F.sum(s)).alias("wa"), F.avg(r).alias("ua_skip"),
        F.when(F.min(s) > 0, F.avg(r)).alias("ua_strict"), F.avg(F.coalesce(r, F.lit(0.0))).alias("ua_zero"),
        F.try_divide(F.sum(f * s), F.sum(s)).alias("weighted_f1"), F.try_divide(F.sum(clamped * s), F.greatest(F.sum(s), F.lit(1))).alias("weighted_f1_clamped"), F.avg(f).alias("macro_f1"),
    )


def log_sum_exp(logits: Column) -> Column:
    return bound(logits, lambda z: bound(F.array_max(z), lambda top: top + F.log(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top)))))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax of the target's logit, for each row."""
    return log_sum_exp(logits) - F.get(logits, target)


def batch_macro(rows: DataFrame, loss: Column, size: int, order: str) -> DataFrame:
    """Mean over batches of `size` ordered rows of each batch's mean; the last batch may be smaller.

    order is a dense index from 0 (the row order that readers give), so batches
    need no global sort.
    """
    per = rows.groupBy(F.floor(F.col(order) / size).alias("batch")).agg(loss.alias("loss"))
    return per.agg(F.avg("loss").alias("loss"), F.count("*").alias("num_batches"))
