"""Queries over the driver's tables, with the SQL that states each independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affectra.operators import arrays as A
from affectra.operators import metrics as M
from affectra.operators import padding as B
from affectra.operators import profile as P
from affectra.operators import splits as S
from affectra.operators import train as H
from affectra.operators import transforms as T
from affectra.operators import validate as V
from affectra.operators.offsets import offsets

from . import proxies as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def r6(c, name: str):
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0).alias(name)  # -0.0 becomes 0.0


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


PAIRS = [("pv", "valence"), ("pa", "arousal"), ("pd", "dominance")]


def _logits(c0: int = 0):
    return A.linear(F.col("feat"), [X.weights(c) for c in range(X.CLASSES)])


def _predicted(spark, sf):
    return X.vectors(spark, sf).select("utt_id", "true_class", _logits().alias("logits"))


#: Logits of the fixed head for each vector and class, long: (utt_id, true_class, c, logit).
LOGITS = X.VECTORS + ", w AS (SELECT c, list_transform(range(64), lambda j: 0.01 * ((7 * c + 3 * j) % 5 - 2)) AS w FROM range(10) AS t(c)), logits AS (SELECT utt_id, true_class, c, list_sum(list_transform(range(1, 65), lambda j: feat[j] * w[j])) AS logit FROM vectors, w)"
PREDICTED = LOGITS + ", p AS (SELECT utt_id, any_value(true_class) AS true_class, CAST(arg_max(c, logit) AS INTEGER) AS pred_class FROM (SELECT * FROM logits ORDER BY utt_id, c) GROUP BY utt_id)"
#: Counters of each class over p(true_class, pred_class), with k classes.
PER_CLASS = """, k AS (SELECT c::INTEGER AS class_idx FROM range({n}) AS t(c)), pc AS (SELECT class_idx, (SELECT count(*) FROM p WHERE true_class = class_idx) AS support,
 (SELECT count(*) FROM p WHERE pred_class = class_idx) AS predicted, (SELECT count(*) FROM p WHERE pred_class = class_idx AND true_class = class_idx) AS tp FROM k),
 pr AS (SELECT *, predicted - tp AS fp, support - tp AS fn, CASE WHEN support > 0 THEN tp / support END AS recall, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS prec FROM pc),
 pf AS (SELECT *, CASE WHEN prec + coalesce(recall, 0) > 0 THEN 2 * prec * coalesce(recall, 0) / (prec + coalesce(recall, 0)) ELSE 0 END AS f1 FROM pr)"""
HEAD = "WITH " + PREDICTED + PER_CLASS.format(n=10)
#: A class that no row predicts or has: index 5 of 6 over the utterances.
SIX = "WITH " + X.PRED + ", p AS (SELECT true_class, pred_class FROM pred)" + PER_CLASS.format(n=6)


def _cells(spark, sf):
    p = _predicted(spark, sf).select("true_class", A.argmax(F.col("logits")).cast("int").alias("pred_class"))
    return M.confusion(p, X.CLASSES)


@query(HEAD + " SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS wa, round(avg(recall), 6) AS ua, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(f1), 6) AS macro_f1 FROM pf")
def classification_report(spark, sf):
    r = M.report(_cells(spark, sf))
    return r.select("n", r6("wa", "wa"), r6("ua_skip", "ua"), r6("weighted_f1", "weighted_f1"), r6("macro_f1", "macro_f1"))


@query("WITH " + PREDICTED + " SELECT t.c::INTEGER AS target, q.c::INTEGER AS predicted, (SELECT count(*) FROM p WHERE true_class = t.c AND pred_class = q.c) AS n FROM range(10) AS t(c), range(10) AS q(c)")
def confusion_matrix_dense(spark, sf):
    return _cells(spark, sf)


@query(HEAD + " SELECT class_idx, support, predicted, tp, round(recall, 6) AS recall, round(prec, 6) AS prec, round(CASE WHEN support > 0 THEN f1 END, 6) AS f1 FROM pf")
def per_class_metrics(spark, sf):
    c = M.per_class(_cells(spark, sf))
    return c.select("class_idx", "support", "predicted", "tp", r6("recall", "recall"), r6("precision", "prec"), r6(F.when(F.col("support") > 0, F.col("f1")), "f1"))


@query(SIX + " SELECT round(avg(recall), 6) AS ua_skip, round(CASE WHEN min(support) > 0 THEN avg(recall) END, 6) AS ua_strict, round(avg(coalesce(recall, 0)), 6) AS ua_zero FROM pf")
def ua_variants(spark, sf):
    r = M.report(M.confusion(X.pred(spark, sf), 6))
    return rounded(r.select("ua_skip", "ua_strict", "ua_zero"), "ua_skip", "ua_strict", "ua_zero")


@query(
    SIX + " SELECT round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(CASE WHEN tp > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END * support) / sum(support), 6) AS weighted_f1_clamped, round(sum(f1) / 6, 6) AS macro_f1 FROM pf"
)
def f1_variants(spark, sf):
    r = M.report(M.confusion(X.pred(spark, sf), 6))
    return rounded(r.select("weighted_f1", "weighted_f1_clamped", "macro_f1"), "weighted_f1", "weighted_f1_clamped", "macro_f1")


@query(HEAD + " SELECT class_idx, tp, fp, fn FROM pf")
def tp_fp_fn(spark, sf):
    return M.per_class(_cells(spark, sf)).select("class_idx", "tp", "fp", "fn")


def _ccc_sql(p: str, t: str, least: int = 1) -> str:
    ok = f"{p} IS NOT NULL AND {t} IS NOT NULL"
    return f"CASE WHEN count(*) FILTER ({ok}) >= {least} THEN 2 * covar_pop({p}, {t}) / (var_pop({p}) FILTER ({ok}) + var_pop({t}) FILTER ({ok}) + (avg({p}) FILTER ({ok}) - avg({t}) FILTER ({ok})) ** 2 + 1e-8) END"


@query("WITH " + X.PRED + " SELECT " + ", ".join(f"round({_ccc_sql(p, t)}, 6) AS ccc_{t}" for p, t in PAIRS) + " FROM pred")
def ccc_by_dim(spark, sf):
    return X.scored(spark, sf).agg(*(r6(M.ccc(p, t), f"ccc_{t}") for p, t in PAIRS))


@query("WITH " + X.PRED + f" SELECT round(1 - ({_ccc_sql('pv', 'valence')} + {_ccc_sql('pa', 'arousal')}) / 2, 6) AS loss FROM pred")
def ccc_loss(spark, sf):
    return X.scored(spark, sf).agg(r6(M.ccc_loss(PAIRS[:2]), "loss"))


@query("WITH " + X.PRED + " SELECT split, round(1 - (" + " + ".join(_ccc_sql(p, t) for p, t in PAIRS) + ") / 3, 6) AS loss FROM pred GROUP BY split")
def masked_ccc(spark, sf):
    return X.scored(spark, sf).groupBy("split").agg(r6(M.ccc_loss(PAIRS), "loss"))


@query(
    "WITH " + X.PRED + ", x AS (SELECT speaker, " + ", ".join(f"{_ccc_sql(p, t, 2 if t == 'dominance' else 1)} AS c_{t}" for p, t in PAIRS) + ", count(dominance) AS n_dominance FROM pred GROUP BY speaker) SELECT speaker, n_dominance, round(CASE WHEN c_dominance IS NULL THEN 1 - (c_valence + "
        "c_arousal) / 2 ELSE 1 - (c_valence + c_arousal + c_dominance) / 3 END, 6) AS loss FROM x"
)
def parallel_ccc_min_rows(spark, sf):
    return X.scored(spark, sf).groupBy("speaker").agg(F.count("dominance").alias("n_dominance"), r6(M.ccc_loss(PAIRS, {"dominance": 2}), "loss"))


@query("WITH " + X.PRED + " SELECT speaker, count(dominance) AS n, " + f"round(coalesce({_ccc_sql('pd', 'dominance', 2)}, -9), 6) AS ccc FROM pred GROUP BY speaker")
def offline_ccc_nan(spark, sf):
    """Not a number below two rows; shown as -9."""
    c = M.ccc("pd", "dominance", least=2, absent=float("nan"))
    return X.scored(spark, sf).groupBy("speaker").agg(F.count("dominance").alias("n"), c.alias("c")).select("speaker", "n", r6(F.nanvl("c", F.lit(-9.0)), "ccc"))


@query("WITH " + X.PRED + f" SELECT round(2 - {_ccc_sql('pv', 'valence')} - {_ccc_sql('pa', 'arousal')}, 6) AS loss FROM pred")
def stage1_loss(spark, sf):
    return X.scored(spark, sf).agg(r6(M.ccc_loss(PAIRS[:2], mode="sum"), "loss"))


@query("WITH " + X.PRED + " SELECT emotion, " + ", ".join(f"round(avg(abs({p} - {t})), 6) AS mae_{t}" for p, t in PAIRS) + " FROM pred GROUP BY emotion")
def mae_masked(spark, sf):
    return X.scored(spark, sf).groupBy("emotion").agg(*(r6(M.mae(p, t), f"mae_{t}") for p, t in PAIRS))


@query("WITH " + X.PRED + f", b AS (SELECT utt_id // 32 AS batch, 1 - {_ccc_sql('pv', 'valence')} AS loss FROM pred GROUP BY 1) SELECT round(avg(loss), 6) AS loss, count(*) AS num_batches FROM b")
def batch_macro_loss(spark, sf):
    return rounded(M.batch_macro(X.scored(spark, sf), 1 - M.ccc("pv", "valence"), 32, "utt_id"), "loss")


@query("WITH " + LOGITS + ", e AS (SELECT utt_id, ln(sum(exp(logit))) - max(logit) FILTER (c = true_class) AS ce FROM logits GROUP BY utt_id) SELECT count(*) AS n, round(avg(ce), 6) AS cross_entropy FROM e")
def cross_entropy(spark, sf):
    p = _predicted(spark, sf)
    return p.agg(F.count("*").alias("n"), r6(F.avg(M.cross_entropy(F.col("logits"), F.col("true_class"))), "cross_entropy"))


@query(
    "WITH "
    + X.PRED
    + f", l AS (SELECT [0.5 * pv, 0.3 * pa, 0.1 * pv - 0.2 * pa, -0.1 * pv, 0.2] AS z, * FROM pred) SELECT round(0.7 * (1 - ({_ccc_sql('pv', 'valence')} + {_ccc_sql('pa', 'arousal')}) / 2) + 0.3 * avg(ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[true_class + 1]), 6) AS loss FROM l"
)
def joint_loss(spark, sf):
    z = F.array(0.5 * F.col("pv"), 0.3 * F.col("pa"), 0.1 * F.col("pv") - 0.2 * F.col("pa"), -0.1 * F.col("pv"), F.lit(0.2))
    return X.pred(spark, sf).withColumn("z", z).agg(r6(0.7 * M.ccc_loss(PAIRS[:2]) + 0.3 * F.avg(M.cross_entropy(F.col("z"), F.col("true_class"))), "loss"))


@query("WITH " + X.PRED + f" SELECT speaker, count(*) AS n, round({_ccc_sql('pv', 'valence')}, 6) AS ccc FROM pred GROUP BY speaker")
def ccc_by_speaker(spark, sf):
    return X.scored(spark, sf).groupBy("speaker").agg(F.count("*").alias("n"), r6(M.ccc("pv", "valence"), "ccc"))


@query(f"SELECT round({_ccc_sql('l_quantity', 'l_tax * 300')}, 6) AS ccc, count(*) AS n FROM lineitem")
def ccc_lineitem(spark, sf):
    li = X.table(spark, sf, "lineitem").select("l_quantity", (F.col("l_tax") * 300).alias("t"))
    return li.agg(r6(M.ccc("l_quantity", "t"), "ccc"), F.count("*").alias("n"))


# pooling and frames

POOLED = X.FRAMES + ", pooled AS (SELECT utt_idx, j, avg(feat[j]) FILTER (valid) AS m FROM frames, range(1, 65) AS t(j) GROUP BY utt_idx, j)"


def _spread(df, column="pooled"):
    return df.select("utt_idx", F.posexplode(column).alias("j", "x")).select("utt_idx", (F.col("j") + 1).cast("long").alias("j"), r6("x", "x"))


@query("WITH " + POOLED + " SELECT utt_idx, j, round(m, 6) AS x FROM pooled WHERE m IS NOT NULL")
def masked_mean_pool(spark, sf):
    return _spread(A.pool(X.frames(spark, sf)).where("pooled is not null"))


@query("WITH " + POOLED + " SELECT utt_idx, j, round(coalesce(m, 0), 6) AS x FROM pooled")
def clamp_mean_pool(spark, sf):
    return _spread(A.pool(X.frames(spark, sf), empty="zero"))


@query("WITH " + X.FRAMES + " SELECT utt_idx, j, round(avg(feat[j]), 6) AS x FROM frames, range(1, 65) AS t(j) GROUP BY utt_idx, j")
def utterance_mean(spark, sf):
    return _spread(A.pool(X.frames(spark, sf), valid=None))


@query(
    "WITH "
    + X.FRAMES
    + ", w AS (SELECT c, list_transform(range(64), lambda j: 0.01 * ((7 * c + 3 * j) % 5 - 2)) AS w FROM range(4) AS t(c)) SELECT utt_idx, c + 1 AS j, round(avg(greatest(0, list_sum(list_transform(range(1, 65), lambda j: feat[j] * w[j])))), 6) AS x FROM frames, w WHERE valid GROUP BY utt_idx, c"
)
def project_then_pool(spark, sf):
    f = X.frames(spark, sf).withColumn("feat", A.relu(A.linear(F.col("feat"), [X.weights(c) for c in range(4)])))
    return _spread(A.pool(f).where("pooled is not null"))


@query(
    "WITH "
    + X.FRAMES
    + ", s AS (SELECT utt_idx, feat, exp(list_sum(list_transform(range(1, 65), lambda j: feat[j] * 0.01 * ((7 + 3 * (j - 1)) % 5 - 2)))) AS e FROM frames WHERE valid) SELECT utt_idx, j, round(sum(e * feat[j]) / sum(e), 6) AS x FROM s, range(1, 65) AS t(j) GROUP BY utt_idx, j"
)
def attention_pool(spark, sf):
    return _spread(A.attention_pool(X.frames(spark, sf), X.weights(1)))


@query("WITH " + X.FRAMES + ", n AS (SELECT utt_idx, count(*) AS n, max(count(*)) OVER (PARTITION BY utt_idx // 4) AS most FROM frames GROUP BY utt_idx) SELECT utt_idx // 4 AS batch, utt_idx, i AS frame_idx, i >= n AS padded FROM n, range(0, 4000) AS t(i) WHERE i < most")
def padding_mask(spark, sf):
    got = A.pad(X.frames(spark, sf), F.floor(F.col("utt_idx") / 4))
    return got.select("batch", "utt_idx", F.col("frame_idx").cast("long").alias("frame_idx"), "padded")


@query("WITH n AS (SELECT l_orderkey AS utt_idx, count(*) AS n_frames FROM lineitem GROUP BY 1) SELECT utt_idx, n_frames, (coalesce(sum(n_frames) OVER (ORDER BY utt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS frame_offset FROM n")
def offset_index(spark, sf):
    return offsets(X.lengths(spark, sf))


@query(
    "WITH n AS (SELECT l_orderkey AS utt_idx, count(*) AS n_frames FROM lineitem GROUP BY 1 HAVING NOT (l_orderkey BETWEEN 100 AND 199)) SELECT utt_idx, n_frames, (coalesce(sum(n_frames) OVER (ORDER BY utt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS frame_offset FROM n"
)
def offset_rebase(spark, sf):
    return offsets(X.lengths(spark, sf).where(~F.col("utt_idx").between(100, 199)))


@query(
    "WITH s AS (SELECT doc_id AS utt_id, n_chars * 37 AS n FROM documents), a AS (SELECT utt_id, n, floor((n - 10) / 5.0) + 1 AS x FROM s), b AS (SELECT "
        "utt_id, n, floor((x - 3) / 2.0) + 1 AS x FROM a), c AS (SELECT utt_id, n, floor((x - 3) / 2.0) + 1 AS x FROM b), d AS (SELECT utt_id, n, floor((x - "
        "3) / 2.0) + 1 AS x FROM c), e AS (SELECT utt_id, n, floor((x - 3) / 2.0) + 1 AS x FROM d), f AS (SELECT utt_id, n, floor((x - 2) / 2.0) + 1 AS x FROM "
        "e) SELECT utt_id, n AS n_samples, (floor((x - 2) / 2.0) + 1)::BIGINT AS n_frames FROM f"
)
def conv_out_lengths(spark, sf):
    s = X.table(spark, sf, "documents").select(F.col("doc_id").alias("utt_id"), (F.col("n_chars") * 37).alias("n_samples"))
    return s.select("utt_id", "n_samples", A.conv_frames(F.col("n_samples")).cast("long").alias("n_frames"))


SAMPLES = "samples AS (SELECT vec_id // 100 AS utt_idx, (vec_id % 100) * 64 + j - 1 AS i, CAST(embedding[j] AS DOUBLE) AS x FROM embeddings, range(1, 65) AS t(j))"


def _samples(spark, sf):
    e = X.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "x"))
    return e.select(F.floor(F.col("vec_id") / 100).alias("utt_idx"), (F.col("vec_id") % 100 * 64 + F.col("j")).alias("i"), F.col("x").cast("double").alias("x"))


STATS = ("mean", "std", "mean_abs", "max", "min")


@query("WITH " + SAMPLES + ' SELECT utt_idx, i // 320 AS "window", round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(avg(abs(x)), 6) AS mean_abs, round(max(x), 6) AS "max", round(min(x), 6) AS "min" FROM samples GROUP BY 1, 2')
def window_stats(spark, sf):
    return rounded(A.window_statistics(_samples(spark, sf)), *STATS)


@query("WITH " + SAMPLES + ', w AS (SELECT utt_idx, i // 320 AS "window", [avg(x), stddev_pop(x), avg(abs(x)), max(x), min(x)] AS s FROM samples GROUP BY 1, 2) SELECT utt_idx, "window", j, round(s[j // 154 + 1], 6) AS x FROM w, range(768) AS t(j)')
def placeholder_features(spark, sf):
    w = A.window_statistics(_samples(spark, sf))
    return w.select("utt_idx", "window", F.posexplode(A.placeholder(F.array(*STATS))).alias("j", "x")).select("utt_idx", "window", F.col("j").cast("long").alias("j"), r6("x", "x"))


@query("WITH " + X.VECTORS + ", s AS (SELECT utt_id, list_avg(feat) AS m, list_var_pop(feat) AS v, feat FROM vectors) SELECT utt_id, j, round((feat[j] - m) / sqrt(v + 1e-5), 6) AS x FROM s, range(1, 65) AS t(j)")
def waveform_layer_norm(spark, sf):
    n = X.vectors(spark, sf).select("utt_id", F.posexplode(A.layer_norm(F.col("feat"))).alias("j", "x"))
    return n.select("utt_id", (F.col("j") + 1).cast("long").alias("j"), r6("x", "x"))


# heads, each as array expressions

HIDDEN = [X.weights(c) for c in range(8)]
OUT = [[0.1 * ((c + j) % 3 - 1) for j in range(8)] for c in range(3)]
CLASS = [[0.2 * ((c + d) % 4) for d in range(3)] for c in range(4)]
#: The hidden layer before its non-linearity, long; then what follows it.
HID = X.VECTORS + ", h AS (SELECT utt_id, list_transform(range(8), lambda c: list_sum(list_transform(range(1, 65), lambda j: feat[j] * 0.01 * ((7 * c + 3 * (j - 1)) % 5 - 2)))) AS h FROM vectors)"


def _out(f: str, n: int = 3) -> str:
    return f"list_transform(range({n}), lambda c: list_sum(list_transform(range(1, 9), lambda j: {f.format('h[j]')} * 0.1 * ((c + j - 1) % 3 - 1))))"


def _vad(spark, sf, activation=A.relu):
    return X.vectors(spark, sf).select("utt_id", "true_class", A.linear(activation(A.linear(F.col("feat"), HIDDEN)), OUT).alias("o"))


def _named(df, column="o", names=M.DIMS):
    return df.select("utt_id", *(r6(F.get(column, F.lit(i)), n) for i, n in enumerate(names)))


@query("WITH " + HID + ", o AS (SELECT utt_id, " + _out("greatest({}, 0)") + " AS o FROM h) SELECT utt_id, round(o[1], 6) AS valence, round(o[2], 6) AS arousal, round(o[3], 6) AS dominance FROM o")
def vad_head(spark, sf):
    return _named(_vad(spark, sf))


@query("WITH " + HID + ", o AS (SELECT utt_id, " + _out("greatest({}, 0)") + " AS o FROM h) SELECT utt_id, c AS class_idx, round(o[1] * 0.2 * (c % 4) + o[2] * 0.2 * ((c + 1) % 4) + o[3] * 0.2 * ((c + 2) % 4), 6) + 0.0 AS logit FROM o, range(4) AS t(c)")
def mediated_logits(spark, sf):
    z = _vad(spark, sf).select("utt_id", F.posexplode(A.linear(F.col("o"), CLASS)).alias("class_idx", "z"))
    return z.select("utt_id", F.col("class_idx").cast("long").alias("class_idx"), r6("z", "logit"))


@query("WITH " + HID + ", o AS (SELECT utt_id, h, " + _out("greatest({}, 0)", 1) + "[1] AS v FROM h) SELECT utt_id, round(v, 6) AS valence, round(h[1], 6) AS logit_0, round(h[2], 6) AS logit_1 FROM o")
def parallel_heads(spark, sf):
    v = X.vectors(spark, sf).withColumns({"e": A.linear(F.col("feat"), HIDDEN[:2]), "v": A.linear(A.relu(A.linear(F.col("feat"), HIDDEN)), OUT[:1])})
    return v.select("utt_id", r6(F.get("v", F.lit(0)), "valence"), r6(F.get("e", F.lit(0)), "logit_0"), r6(F.get("e", F.lit(1)), "logit_1"))


@query("WITH " + HID + ", o AS (SELECT utt_id, " + _out("tanh({})") + " AS o FROM h) SELECT utt_id, round(1 / (1 + exp(-o[1])), 6) AS valence, round(1 / (1 + exp(-o[2])), 6) AS arousal, round(1 / (1 + exp(-o[3])), 6) AS dominance FROM o")
def tanh_sigmoid_head(spark, sf):
    return _named(_vad(spark, sf, A.tanh).withColumn("o", A.sigmoid(F.col("o"))))


@query(
    "WITH " + HID + ", n AS (SELECT utt_id, list_transform(h, lambda x: greatest(0, (x - list_avg(h)) / sqrt(list_var_pop(h) + 1e-5))) AS h FROM h), o AS (SELECT utt_id, " + _out("{}") + " AS o FROM n) SELECT utt_id, round(tanh(o[1]), 6) AS valence, round(tanh(o[2]), 6) AS arousal, round(tanh(o[3]), 6) AS dominance FROM o"
)
def attention_decoder_head(spark, sf):
    """Linear, layer norm, ReLU, linear, tanh over a pooled vector."""
    return _named(_vad(spark, sf, lambda h: A.relu(A.layer_norm(h))).withColumn("o", A.tanh(F.col("o"))))


@query("WITH " + LOGITS + " SELECT utt_id, c AS class_idx, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY utt_id), 6) AS probability FROM logits")
def softmax_probs(spark, sf):
    p = _predicted(spark, sf).select("utt_id", F.posexplode(A.softmax(F.col("logits"))).alias("class_idx", "p"))
    return p.select("utt_id", F.col("class_idx").cast("long").alias("class_idx"), r6("p", "probability"))


@query("WITH " + PREDICTED + " SELECT utt_id, pred_class, 'class_' || pred_class AS label FROM p")
def argmax_label(spark, sf):
    labels = F.array(*(F.lit(f"class_{c}") for c in range(X.CLASSES)))
    return _predicted(spark, sf).select("utt_id", A.argmax(F.col("logits")).cast("int").alias("pred_class")).select("utt_id", "pred_class", F.element_at(labels, F.col("pred_class") + 1).alias("label"))


@query(
    "WITH " + LOGITS + ", r AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY logit DESC, c) AS r FROM logits) SELECT utt_id, max(c) FILTER (r = 1) AS top, "
        "max(c) FILTER (r = 2) AS runner_up, round(max(logit) FILTER (r = 1) - max(logit) FILTER (r = 2), 6) AS margin FROM r GROUP BY utt_id"
)
def top2_margin(spark, sf):
    r = _predicted(spark, sf).select("utt_id", A.ranked(F.col("logits")).alias("r"))
    a, b = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return r.select("utt_id", a["idx"].cast("long").alias("top"), b["idx"].cast("long").alias("runner_up"), r6(a["value"] - b["value"], "margin"))


#: The reference point of the explanations: four classes over V, A, D.
EXPLAIN_W, EXPLAIN_B = [[1.0, 0.0, 0.5], [-0.5, 1.0, 0.0], [0.0, -1.0, 0.5], [-1.0, 0.5, -0.5]], [0.1, -0.2, 0.3, 0.0]
TERMS = X.PRED + ", w(class_idx, bias, wv, wa, wd) AS (VALUES (0, 0.1, 1.0, 0.0, 0.5), (1, -0.2, -0.5, 1.0, 0.0), (2, 0.3, 0.0, -1.0, 0.5), (3, 0.0, -1.0, 0.5, -0.5)), x AS (SELECT utt_id, class_idx, bias::DOUBLE AS b, wv * pv AS v, wa * pa AS a, wd * pd AS d, bias + wv * pv + wa * pa + wd * pd AS z FROM pred, w WHERE pd IS NOT NULL)"


def _explained(spark, sf):
    return X.scored(spark, sf).where("pd is not null").select("utt_id", F.col("pv").alias("valence"), F.col("pa").alias("arousal"), F.col("pd").alias("dominance"))


def _terms(spark, sf):
    return A.contributions(_explained(spark, sf), EXPLAIN_W, EXPLAIN_B, M.DIMS)


@query("WITH " + TERMS + " SELECT utt_id, class_idx, round(b, 6) AS bias, round(v, 6) + 0.0 AS valence_term, round(a, 6) + 0.0 AS arousal_term, round(d, 6) + 0.0 AS dominance_term, round(z, 6) + 0.0 AS logit FROM x")
def logit_contributions(spark, sf):
    return rounded(_terms(spark, sf), "bias", "valence_term", "arousal_term", "dominance_term", "logit")


@query(
    "WITH "
    + TERMS
    + ", r AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY round(z, 9) DESC, class_idx) AS r FROM x) SELECT s.utt_id, s.class_idx, t.class_idx "
        "AS next_class_idx, round(s.b - t.b, 6) AS delta_bias, round(s.v - t.v, 6) AS delta_valence, round(s.a - t.a, 6) AS delta_arousal, round(s.d - t.d, 6) "
        "AS delta_dominance, round(s.z - t.z, 6) AS margin FROM r s JOIN r t ON t.utt_id = s.utt_id AND s.r = 1 AND t.r = 2"
)
def contrast_runner_up(spark, sf):
    c = A.contrast(_explained(spark, sf), EXPLAIN_W, EXPLAIN_B, M.DIMS)
    return c.select("utt_id", "class_idx", "next_class_idx", r6("delta_bias", "delta_bias"), *(r6(f"delta_{d}_term", f"delta_{d}") for d in M.DIMS), r6("delta_logit", "margin"))


# transforms


@query("WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part), r AS (SELECT p_partkey, 1 + 4 * (p_size - lo) / (hi - lo) AS x FROM part, b) SELECT p_partkey, round((x - 1) / 4, 6) AS x FROM r")
def rescale_auto(spark, sf):
    part = X.table(spark, sf, "part")
    b = part.agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    r = part.join(F.broadcast(b)).select("p_partkey", (1 + 4 * (F.col("p_size") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x"))
    return rounded(T.rescale_auto(r, ["x"]), "x")


@query("SELECT p_partkey, round((p_size - 3) / 2, 6) AS x FROM part")
def rescale_1_5(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", r6(T.five_point(F.col("p_size")), "x"))


@query("SELECT p_partkey, round(p_size / 16, 6) AS x FROM part")
def div16(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", r6(F.col("p_size") / 16, "x"))


FIT = X.AFFECT + ", f AS (SELECT " + ", ".join(f"coalesce(min({d}), 0) AS lo_{d}, coalesce(max({d}), 0) AS hi_{d}, count({d}) > 0 AS trained_{d}" for d in M.DIMS) + " FROM affect WHERE split = 'train')"


@query("WITH " + FIT + " SELECT * FROM f")
def minmax_fit(spark, sf):
    return T.fit_minmax(X.affect(spark, sf))


def _fitted(spark, sf):
    a = X.affect(spark, sf)
    return a.join(F.broadcast(T.fit_minmax(a)))


def _scale(d):
    return F.col(f"lo_{d}"), F.col(f"hi_{d}"), F.col(f"trained_{d}")


@query("WITH " + FIT + " SELECT utt_id, " + ", ".join(f"round(CASE WHEN {d} IS NULL THEN NULL WHEN hi_{d} = lo_{d} THEN 0 ELSE 2 * ({d} - lo_{d}) / (hi_{d} - lo_{d}) - 1 END, 6) AS {d}" for d in M.DIMS) + " FROM affect, f")
def minmax_transform(spark, sf):
    return _fitted(spark, sf).select("utt_id", *(r6(T.minmax(F.col(d), *_scale(d)), d) for d in M.DIMS))


@query("WITH " + FIT + " SELECT utt_id, " + ", ".join(f"round({d}, 6) AS {d}" for d in M.DIMS) + " FROM affect")
def minmax_inverse(spark, sf):
    """The inverse of the transform gives the values back."""
    return _fitted(spark, sf).select("utt_id", *(r6(T.minmax_inverse(T.minmax(F.col(d), *_scale(d)), *_scale(d)), d) for d in M.DIMS))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'click' ELSE event_type END AS label FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def label_merge(spark, sf):
    e = X.table(spark, sf, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    exc = F.when(F.col("event_type") == "view", "exc").otherwise(F.when(F.col("event_type") == "click", "hap").otherwise(F.col("event_type")))
    got = T.merged_label(exc)
    return e.select("event_id", F.when(got == "hap", "click").otherwise(got).alias("label"))


@query("WITH " + X.UTTS + " SELECT utt_id, substr(utt_id, 5, 1) AS session, regexp_replace(utt_id, '_[^_]*$', '') AS conversation FROM utts")
def id_parse(spark, sf):
    u = X.utterances(spark, sf)
    return u.select("utt_id", T.session_of(F.col("utt_id")).alias("session"), T.conversation_of(F.col("utt_id")).alias("conversation"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, starts_with(url, '/') AS is_absolute, CASE WHEN starts_with(url, '/') THEN url ELSE '/data/' || url END AS path FROM pages")
def path_parse(spark, sf):
    u = F.col("url")
    return X.table(spark, sf, "pages").select("page_id", F.regexp_extract(u, "([^/]*)$", 1).alias("name"), F.startswith(u, F.lit("/")).alias("is_absolute"), T.absolute(u, "/data").alias("path"))


@query("SELECT event_id, sha256('a/' || event_id || '.wav' || '|' || user_id || '|' || (event_id * 10) || '|' || 'encoder') AS cache_key FROM events")
def cache_key(spark, sf):
    e = X.table(spark, sf, "events")
    p = F.concat(F.lit("a/"), F.col("event_id").cast("string"), F.lit(".wav"))
    return e.select("event_id", T.cache_key(p, F.col("user_id"), F.col("event_id") * 10, "encoder").alias("cache_key"))


# validation and joins


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 100 AND 2000")
def length_filter(spark, sf):
    return X.table(spark, sf, "documents").where(F.col("n_chars").between(100, 2000)).select("doc_id", "n_chars")


@query("SELECT 'not_numeric' AS rule_id, part.p_partkey AS key, p_brand AS value FROM part WHERE TRY_CAST(CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) IS NULL")
def bad_numeric(spark, sf):
    p = X.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("x"))
    return V.violations(p, "p_partkey", {"not_numeric": V.not_numeric("x")})


@query("SELECT 'range' AS rule_id, c_custkey AS key, round(c_acctbal / 5000, 3) AS value FROM customer WHERE abs(round(c_acctbal / 5000, 3)) > 1")
def range_violations(spark, sf):
    c = X.table(spark, sf, "customer").select("c_custkey", F.round(F.col("c_acctbal") / 5000, 3).alias("x"))
    return V.violations(c, "c_custkey", {"range": V.out_of_range("x")}).withColumn("value", F.col("value").cast("double"))


@query("WITH k AS (SELECT DISTINCT event_type FROM events WHERE event_type < 'p') SELECT event_id, event_type FROM events WHERE event_type NOT IN (SELECT event_type FROM k)")
def unknown_labels(spark, sf):
    e = X.table(spark, sf, "events").select("event_id", "event_type")
    return e.join(F.broadcast(e.where("event_type < 'p'").select("event_type").distinct()), "event_type", "left_anti").select("event_id", "event_type")


@query('SELECT event_id, event_type AS "left", CASE WHEN event_id % 50 = 7 THEN \'other\' ELSE event_type END AS "right" FROM events WHERE event_id % 50 = 7 AND event_type <> \'other\'')
def id_mismatch(spark, sf):
    a = X.table(spark, sf, "events").select("event_id", "event_type")
    return V.misaligned(a, a.withColumn("event_type", F.when(F.col("event_id") % 50 == 7, "other").otherwise(F.col("event_type"))), "event_id", "event_type")


@query("WITH " + X.AFFECT + " SELECT speaker, count(DISTINCT CASE WHEN utt_id % 97 = 0 THEN 'test' ELSE split END) AS n_splits FROM affect GROUP BY speaker HAVING count(DISTINCT CASE WHEN utt_id % 97 = 0 THEN 'test' ELSE split END) > 1")
def speaker_leakage(spark, sf):
    return S.leakage(X.affect(spark, sf).withColumn("split", F.when(F.col("utt_id") % 97 == 0, "test").otherwise(F.col("split"))))


@query("WITH " + X.AFFECT + " SELECT split, emotion FROM (SELECT DISTINCT s.split, e.emotion FROM affect s, (SELECT DISTINCT emotion FROM affect) e) EXCEPT SELECT split, emotion FROM affect WHERE session <> 3 OR emotion <> 'view'")
def label_coverage(spark, sf):
    """Labels that a split lacks once session 3's views are left out."""
    a = X.affect(spark, sf)
    every = a.select("split").distinct().join(F.broadcast(a.select("emotion").distinct()))
    return every.join(a.where("session <> 3 or emotion <> 'view'").select("split", "emotion").distinct(), ["split", "emotion"], "left_anti")


@query("WITH " + X.AFFECT + " SELECT utt_id FROM affect WHERE coalesce(CASE WHEN utt_id % 4 = 1 THEN NULL ELSE valence END, dominance) IS NULL")
def no_label_rows(spark, sf):
    return X.affect(spark, sf).where(F.coalesce(F.when(F.col("utt_id") % 4 != 1, F.col("valence")), F.col("dominance")).isNull()).select("utt_id")


@query("SELECT (SELECT count(*) FROM documents) AS features, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS aligned")
def count_alignment(spark, sf):
    d, n = X.table(spark, sf, "documents").agg(F.count("*").alias("features")), X.table(spark, sf, "labels").agg(F.count("*").alias("labels"))
    return d.join(n).withColumn("aligned", F.col("features") == F.col("labels"))


@query("SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def align_join(spark, sf):
    return X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id").select("doc_id", "n_chars", "quality")


@query("WITH " + X.PRED + " SELECT utt_id, emotion, true_class AS class_idx FROM pred")
def label_lookup(spark, sf):
    return X.affect(spark, sf).join(F.broadcast(X.classes(spark, sf)), F.col("emotion") == F.col("label")).select("utt_id", "emotion", "class_idx")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def cache_misses(spark, sf):
    return X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("WITH " + X.AFFECT + " SELECT utt_id FROM affect WHERE split = 'train'")
def split_semi(spark, sf):
    a = X.affect(spark, sf)
    speakers = a.where("split = 'train'").select("speaker").distinct()
    return a.join(speakers, "speaker", "left_semi").select("utt_id")


@query("""
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, h, i, j, -abs(i - j) * CASE WHEN h < 8 THEN 2.0 ** (-(h + 1)) ELSE 2.0 ** (-0.5 * (2 * (h - 8) + 1)) END AS bias FROM n, range(12) AS a(h), range(0, n) AS b(i), range(0, n) AS c(j))
SELECT conv_id, h, count(*) AS pairs, round(sum(bias), 6) + 0.0 AS total, round(min(bias), 6) + 0.0 AS least FROM p GROUP BY conv_id, h
""")
def alibi_bias(spark, sf):
    """Distance penalties of twelve heads over the turns of each conversation."""
    n = X.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    pairs = B.alibi_bias(n, 12).groupBy("conv_id", F.col("h").cast("long").alias("h"))
    return pairs.agg(F.count("*").alias("pairs"), r6(F.sum("bias"), "total"), r6(F.min("bias"), "least"))


# profiles

COLS = ("utt_id", "speaker", "emotion", "valence", "arousal", "dominance", "session", "split")


def _union(expr: str, alias: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {expr.format(c)} AS {alias} FROM affect" for c in COLS)


@query("WITH " + X.AFFECT + " " + _union("count(*) FILTER ({} IS NULL)", "n_null"))
def null_counts(spark, sf):
    return P.null_counts(X.affect(spark, sf))


@query("WITH " + X.AFFECT + " " + _union("count(DISTINCT {})", "n_distinct"))
def distinct_counts(spark, sf):
    return P.distinct_counts(X.affect(spark, sf))


@query("SELECT o_orderpriority AS value, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM orders) * 100, 2) AS percent FROM orders GROUP BY 1")
def value_counts_pct(spark, sf):
    return P.value_counts(X.table(spark, sf, "orders"), "o_orderpriority")


NUM = ("l_quantity", "l_extendedprice", "l_discount")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS \"min\", round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS \"max\" FROM lineitem" for c in NUM))
def describe(spark, sf):
    return rounded(P.describe(X.table(spark, sf, "lineitem"), list(NUM)), "mean", "std", "q25", "q50", "q75")


@query("SELECT round(skewness(o_totalprice), 6) AS skew, round(kurtosis(o_totalprice), 6) AS kurt FROM orders")
def skew_kurt(spark, sf):
    return rounded(P.skew_kurtosis(X.table(spark, sf, "orders"), "o_totalprice"), "skew", "kurt")


@query("WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(CAST(floor((o_totalprice - lo) / (hi - lo) * 30) AS INTEGER) + 1, 30) AS bin, count(*) AS n FROM orders, b GROUP BY 1")
def histogram30(spark, sf):
    return P.histogram(X.table(spark, sf, "orders"), "o_totalprice")


@query("WITH " + X.AFFECT + " SELECT emotion, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid, count(*) FILTER (split = 'test') AS test FROM affect GROUP BY emotion")
def crosstab(spark, sf):
    return X.affect(spark, sf).groupBy("emotion").pivot("split", ["train", "valid", "test"]).count().na.fill(0)


@query("WITH " + X.AFFECT + " SELECT count(valence) AS valence, count(arousal) AS arousal, count(dominance) AS dominance FROM affect")
def label_counts(spark, sf):
    return X.affect(spark, sf).agg(*(F.count(d).alias(d) for d in M.DIMS))


@query("WITH " + X.AFFECT + " SELECT split, count(DISTINCT speaker) AS n, min(speaker) AS first, max(speaker) AS last FROM affect GROUP BY split")
def group_unique(spark, sf):
    """Speakers of each split, distinct before they are gathered."""
    d = X.affect(spark, sf).select("split", "speaker").distinct()
    return d.groupBy("split").agg(F.count("*").alias("n"), F.min("speaker").alias("first"), F.max("speaker").alias("last"))


@query("WITH " + X.AFFECT + " SELECT " + ", ".join(f"count({d}) AS n_{d}, round(min({d}), 6) AS min_{d}, round(max({d}), 6) AS max_{d}, round(avg({d}), 6) AS mean_{d}" for d in M.DIMS) + " FROM affect")
def finite_stats(spark, sf):
    x = {d: F.when(M.finite(F.col(d)), F.col(d)) for d in M.DIMS}
    return X.affect(spark, sf).agg(*(c for d, v in x.items() for c in (F.count(v).alias(f"n_{d}"), r6(F.min(v), f"min_{d}"), r6(F.max(v), f"max_{d}"), r6(F.avg(v), f"mean_{d}"))))


# folds


@query("WITH " + X.AFFECT + ", s AS (SELECT DISTINCT session AS fold FROM affect) SELECT fold, CASE WHEN session = fold THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM affect, s GROUP BY 1, 2")
def loso_folds(spark, sf):
    return S.loso(X.affect(spark, sf)).groupBy("fold", "role").agg(F.count("*").alias("n"))


SIZES = [108, 102, 115, 103, 124]


@query("SELECT event_id, CASE WHEN event_id < 108 THEN 0 WHEN event_id < 210 THEN 1 WHEN event_id < 325 THEN 2 WHEN event_id < 428 THEN 3 WHEN event_id < 552 THEN 4 END AS fold FROM events")
def positional_folds(spark, sf):
    return S.positional(X.table(spark, sf, "events"), SIZES, "event_id").select("event_id", "fold")


@query("SELECT event_id FROM events WHERE NOT (event_id BETWEEN 108 AND 209)")
def fold_complement(spark, sf):
    return S.positional(X.table(spark, sf, "events"), SIZES, "event_id").where(~F.col("fold").eqNullSafe(F.lit(1))).select("event_id")


@query("WITH " + X.PRED + ", f AS (SELECT session, avg(CAST(true_class = pred_class AS INTEGER)) AS wa FROM pred GROUP BY session) SELECT round(avg(wa), 6) AS mean_wa, count(*) AS folds FROM f")
def fold_average(spark, sf):
    f = X.pred(spark, sf).groupBy("session").agg(F.avg((F.col("true_class") == F.col("pred_class")).cast("double")).alias("wa"))
    return f.agg(r6(F.avg(F.nanvl("wa", F.lit(None))), "mean_wa"), F.count("*").alias("folds"))


HISTORY = "h AS (SELECT user_id AS run_id, event_id AS epoch, floor(value) AS metric FROM events)"


@query("WITH " + HISTORY + " SELECT run_id, epoch, metric FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY metric DESC, epoch) AS r FROM h) WHERE r = 1")
def best_epoch(spark, sf):
    h = X.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"), F.floor("value").cast("double").alias("metric"))
    return S.best_epoch(h, "metric", largest=True)


@query("WITH " + X.AFFECT + " SELECT speaker, CASE WHEN count(dominance) > 0 THEN 'trained' WHEN speaker % 2 = 0 THEN 'retained_from_checkpoint' ELSE 'untrained' END AS status FROM affect GROUP BY speaker")
def freeze_rule(spark, sf):
    before = F.when(F.col("speaker") % 2 == 0, "trained").otherwise("untrained")
    n = X.affect(spark, sf).groupBy("speaker").agg(F.count("dominance").alias("n"))
    return n.select("speaker", T.dominance_status(F.col("n"), before).alias("status"))


# random or iterative: rows only


@query()
def speaker_split(spark, sf):
    return S.by_speaker(X.affect(spark, sf), "speaker", "emotion", 0.2, 0.2, seed=7).select("utt_id", "speaker", "emotion", "split")


@query()
def random_split(spark, sf):
    return S.by_row(X.affect(spark, sf), "utt_id", 0.2, seed=7).select("utt_id", "split", "leaky")


@query()
def train_heads(spark, sf):
    return H.train_folds(X.vectors(spark, sf).withColumn("fold", F.col("utt_id") % 5), X.CLASSES)


@query()
def weighted_corpus_sample(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", "lang")
    return S.sample_corpora({k: d.where(F.col("lang") == k) for k in ("en", "de", "fr", "es")}, {"en": 0.5, "de": 1.0}, seed=7)
