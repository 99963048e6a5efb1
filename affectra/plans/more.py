"""Further queries over the driver's tables: columns, splits, batches, masks, heads and payloads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from affectra.operators import arrays as A
from affectra.operators import metrics as M
from affectra.operators import networks as N
from affectra.operators import padding as B
from affectra.operators import payloads as Y
from affectra.operators import profile as P
from affectra.operators import splits as S
from affectra.operators import transforms as T
from affectra.operators import validate as V

from . import proxies as X
from .catalogue import CLASS, HID, HIDDEN, LOGITS, OUT, SAMPLES, _out, _predicted, _samples, query, r6, rounded

# columns


@query(r"SELECT event_id, lower(regexp_replace('  ' || event_type || chr(9), '^\s+|\s+$', '', 'g')) AS label FROM (SELECT event_id, upper(event_type) AS event_type FROM events)")
def clean_label(spark, sf):
    e = X.table(spark, sf, "events")
    return e.select("event_id", T.cleaned(F.concat(F.lit("  "), F.upper("event_type"), F.lit("\t"))).alias("label"))


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(p, '[^/]\.[^./]+$') THEN regexp_extract(p, '[^/](\.[^./]+)$', 1) ELSE '' END AS suffix
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/a/b.c/' || page_id || '.wav' WHEN 1 THEN 'x/.hidden' WHEN 2 THEN 'y.d/z' ELSE url END AS p FROM pages)
""")
def path_suffix(spark, sf):
    kind, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    p = F.when(kind == 0, F.concat(F.lit("/a/b.c/"), n, F.lit(".wav"))).when(kind == 1, "x/.hidden").when(kind == 2, "y.d/z").otherwise(F.col("url"))
    return X.table(spark, sf, "pages").select("page_id", T.suffix(p).alias("suffix"))


@query("SELECT doc_id, n_chars AS n_samples, (320 - n_chars % 320) % 320 AS missing, (n_chars + (320 - n_chars % 320) % 320) // 320 AS n_frames FROM documents")
def pad_to_frames(spark, sf):
    n = F.col("n_chars")
    return X.table(spark, sf, "documents").select("doc_id", n.alias("n_samples"), T.up_to(n).alias("missing"), F.floor((n + T.up_to(n)) / 320).alias("n_frames"))


@query("WITH " + HID + ", o AS (SELECT utt_id, " + _out("greatest({}, 0)") + " AS o FROM h) SELECT utt_id, round(o[1], 6) AS valence, round(o[2], 6) AS arousal, round(o[3], 6) AS dominance FROM o WHERE o[1] > o[2]")
def named_predictions(spark, sf):
    """Vectors unpacked by name; the names serve in a predicate."""
    o = A.linear(A.relu(A.linear(F.col("feat"), HIDDEN)), OUT)
    v = X.vectors(spark, sf).select("utt_id", Y.named(o, M.DIMS).alias("vad"))
    return v.where(F.col("vad.valence") > F.col("vad.arousal")).select("utt_id", *(r6(f"vad.{d}", d) for d in M.DIMS))


@query(
    "WITH "
    + X.AFFECT
    + f"""
SELECT speaker, CASE WHEN n > 1 THEN 'trained' ELSE 'untrained' END AS dominance_status, CASE WHEN n > 1 THEN 'original_scale' ELSE 'unavailable_normalized_value_repeated' END AS dominance_scale_status,
 CASE WHEN n > 1 THEN '' ELSE '{Y.TABLE_WARNING}' END AS warning FROM (SELECT speaker, count(dominance) AS n FROM affect GROUP BY speaker)
"""
)
def status_columns(spark, sf):
    trained = F.col("n") > 1
    n = X.affect(spark, sf).groupBy("speaker").agg(F.count("dominance").alias("n"))
    return n.select("speaker", F.when(trained, "trained").otherwise("untrained").alias("dominance_status"), Y.scale_status(trained).alias("dominance_scale_status"), F.when(trained, "").otherwise(Y.TABLE_WARNING).alias("warning"))


@query("WITH " + SAMPLES + ", s AS (SELECT utt_idx, avg(x) AS m, sqrt(var_pop(x) + 1e-5) AS d FROM samples GROUP BY utt_idx) SELECT utt_idx, i, round((x - m) / d, 6) + 0.0 AS x FROM samples JOIN s USING (utt_idx)")
def samples_layer_norm(spark, sf):
    """Waveforms of 6,400 samples, each normalised as one array."""
    w = _samples(spark, sf).groupBy("utt_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("w"))
    return w.select("utt_idx", F.posexplode(A.layer_norm(F.col("w"))).alias("i", "x")).select("utt_idx", F.col("i").cast("long").alias("i"), r6("x", "x"))


@query("WITH " + X.VECTORS + " SELECT utt_id, j, round(CASE WHEN j <= n THEN coalesce(feat[j], 0) END, 6) AS x FROM (SELECT *, CASE utt_id % 2 WHEN 0 THEN 48 ELSE 80 END AS n FROM vectors), range(1, 81) AS t(j) WHERE j <= n")
def crop_or_pad(spark, sf):
    v = X.vectors(spark, sf)
    n = F.when(F.col("utt_id") % 2 == 0, A.fit_length(F.col("feat"), 48)).otherwise(A.fit_length(F.col("feat"), 80))
    return v.select("utt_id", F.posexplode(n).alias("j", "x")).select("utt_id", (F.col("j") + 1).cast("long").alias("j"), r6("x", "x"))


@query("SELECT least(1000, (SELECT count(*) FROM events)) AS n, true AS is_subset")
def sample_of_k(spark, sf):
    """A seeded sample has as many rows as asked for, all of them rows of the table."""
    e = X.table(spark, sf, "events").select("event_id")
    s = S.exact_sample(e, "event_id", 1000, seed=5)
    return s.agg(F.count("*").alias("n")).join(F.broadcast(P.subset(s, e).toDF("is_subset")))


# order, sets and profiles


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def first_rows(spark, sf):
    """A top-20 report."""
    return X.table(spark, sf, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS place, n FROM (SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1)")
def labels_by_frequency(spark, sf):
    n = X.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))
    return P.ordered_counts(n, "label", "n").select("label", F.col("place").cast("long").alias("place"), "n")


@query("SELECT DISTINCT l_returnflag AS label, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS class_idx FROM lineitem")
def sorted_labels(spark, sf):
    return M.class_index(X.table(spark, sf, "lineitem"), "l_returnflag").select("label", F.col("class_idx").cast("long").alias("class_idx"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AS labels_in_documents, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) = 0 AS documents_in_labels")
def key_sets(spark, sf):
    d, n = (X.table(spark, sf, t).select("doc_id") for t in ("documents", "labels"))
    return P.subset(n, d).toDF("labels_in_documents").join(F.broadcast(P.subset(d, n).toDF("documents_in_labels")))


@query("WITH " + X.AFFECT + " SELECT split, list_sort(list(DISTINCT emotion)) AS labels FROM affect GROUP BY split")
def labels_of_split(spark, sf):
    """Labels of each split, in order; a label list is short."""
    return X.affect(spark, sf).groupBy("split").agg(F.array_sort(F.collect_set("emotion")).alias("labels"))


BOX = "b AS (SELECT quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.75) AS q75 FROM orders)"


@query(
    "WITH "
    + BOX
    + """
SELECT round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, min(o_totalprice) FILTER (o_totalprice >= q25 - 1.5 * (q75 - q25)) AS low, max(o_totalprice) FILTER (o_totalprice <= q75 + 1.5 * (q75 - q25)) AS high,
 count(*) FILTER (o_totalprice < q25 - 1.5 * (q75 - q25) OR o_totalprice > q75 + 1.5 * (q75 - q25)) AS outliers FROM orders, b GROUP BY q25, q50, q75
"""
)
def box_plot(spark, sf):
    return rounded(P.box_plot(X.table(spark, sf, "orders"), "o_totalprice"), "q25", "q50", "q75")


@query("SELECT 'o_orderkey' AS \"column\", true AS numeric, false AS categorical UNION ALL SELECT 'o_orderstatus', false, true UNION ALL SELECT 'o_orderpriority', false, true UNION ALL SELECT 'o_totalprice', true, false")
def column_kinds(spark, sf):
    return P.column_kinds(X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"))


# validation


@query("SELECT 'class_range' AS rule_id, event_id AS key, CAST(event_id % 7 - 1 AS VARCHAR) AS value FROM events WHERE event_id % 7 - 1 NOT BETWEEN 0 AND 4")
def class_range(spark, sf):
    e = X.table(spark, sf, "events").select("event_id", (F.col("event_id") % 7 - 1).alias("c"))
    return V.violations(e, "event_id", {"class_range": V.class_out_of_range("c", 5)})


@query("WITH " + X.AFFECT + " SELECT speaker, count(DISTINCT emotion) AS n_labels FROM affect WHERE utt_id % 3 = 0 GROUP BY speaker HAVING count(DISTINCT emotion) < 2")
def too_few_labels(spark, sf):
    return V.too_few(X.affect(spark, sf).where("utt_id % 3 = 0"), "speaker", "emotion", 2)


@query("WITH " + X.FRAMES + " SELECT utt_idx FROM frames GROUP BY utt_idx HAVING count(*) FILTER (valid AND frame_idx % 3 <> 0) = 0")
def cannot_pool(spark, sf):
    """Utterances without a valid frame."""
    return V.without(X.frames(spark, sf), "utt_idx", F.col("valid") & (F.col("frame_idx") % 3 != 0))


@query("WITH " + X.AFFECT + ", s AS (SELECT split, count(valence) + count(arousal) AS two, count(dominance) AS d, count(*) AS n FROM affect GROUP BY split) SELECT split, CASE WHEN d = n THEN 3 ELSE 2 END AS target_dim, d > 0 AND d < n AS incomplete FROM s")
def target_dims(spark, sf):
    return V.target_dims(X.affect(spark, sf), "split")


@query("WITH " + X.FRAMES + " SELECT 'feature' AS rule_id, utt_idx * 100000 + frame_idx AS key, CAST(len(f) AS VARCHAR) AS value FROM (SELECT utt_idx, frame_idx, CASE WHEN frame_idx % 5 = 4 THEN feat[1:32] ELSE feat END AS f FROM frames) WHERE len(f) <> 64")
def bad_features(spark, sf):
    f = X.frames(spark, sf).select((F.col("utt_idx") * 100000 + F.col("frame_idx")).alias("k"), F.when(F.col("frame_idx") % 5 == 4, F.slice("feat", 1, 32)).otherwise(F.col("feat")).alias("f"))
    return V.violations(f, "k", {"feature": V.bad_feature("f", 64)})


# splits


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split FROM events")
def explicit_split(spark, sf):
    named = F.when(F.col("event_id") % 3 == 0, " Train").when(F.col("event_id") % 3 == 1, "VALID ").otherwise("test")
    return S.by_column(X.table(spark, sf, "events").select("event_id", named.alias("given")), "given").select("event_id", "split")


@query("WITH " + X.AFFECT + " SELECT utt_id, CASE WHEN session = 5 THEN 'test' ELSE 'train' END AS split FROM affect")
def session_holdout(spark, sf):
    return S.by_session(X.affect(spark, sf), "session", "5").select("utt_id", "split")


@query("WITH " + X.AFFECT + " SELECT utt_id, unnest(CASE WHEN split = 'test' THEN ['test', 'valid'] ELSE ['train'] END) AS role FROM affect")
def eval_is_test(spark, sf):
    return S.validate_on_test(X.affect(spark, sf)).select("utt_id", "role")


@query("WITH " + X.AFFECT + " SELECT a.utt_id, s.split FROM affect a JOIN (SELECT DISTINCT speaker, split FROM affect) s ON s.speaker = a.speaker")
def split_lookup(spark, sf):
    a = X.affect(spark, sf)
    return a.select("utt_id", "speaker").join(a.select("speaker", "split").distinct(), "speaker").select("utt_id", "split")


@query("SELECT split, CAST(n AS DOUBLE) AS n FROM (SELECT 'train' AS split, (SELECT count(*) FROM events) - greatest(1, round_even((SELECT count(*) FROM "
    "events) * 0.1, 0)) - greatest(1, round_even((SELECT count(*) FROM events) * 0.2, 0)) AS n UNION ALL SELECT 'test', greatest(1, round_even((SELECT "
    "count(*) FROM events) * 0.1, 0)) UNION ALL SELECT 'valid', greatest(1, round_even((SELECT count(*) FROM events) * 0.2, 0)))")
def exact_split_sizes(spark, sf):
    """A seeded split by rows has the asked-for numbers exactly."""
    s = S.by_row(X.table(spark, sf, "events"), "event_id", 0.2, seed=11, test=0.1)
    return s.groupBy("split").agg(F.count("*").cast("double").alias("n"))


@query("SELECT p.utt_id, p.pred_class, l.quality AS target FROM (SELECT doc_id AS utt_id, CAST(doc_id % 2 AS INTEGER) AS pred_class FROM documents) p JOIN labels l ON l.doc_id = p.utt_id")
def predictions_with_targets(spark, sf):
    p = X.table(spark, sf, "documents").select(F.col("doc_id").alias("utt_id"), (F.col("doc_id") % 2).cast("int").alias("pred_class"))
    return p.join(X.table(spark, sf, "labels").select(F.col("doc_id").alias("utt_id"), F.col("quality").alias("target")), "utt_id")


# batches, permutations, masks


@query("WITH " + X.FRAMES + ", n AS (SELECT utt_idx, count(*) AS n, max(count(*)) OVER (PARTITION BY utt_idx // 4) AS most FROM frames GROUP BY utt_idx) SELECT n.utt_idx // 4 AS "
    "batch, n.utt_idx, n.n AS size, i AS frame_idx, round(coalesce(f.feat[1], 0), 6) AS first, round(coalesce(f.feat[64], 0), 6) AS last, i >= n.n AS "
    "padded, n.utt_idx % 5 AS emotion_target FROM n JOIN range(0, 4000) AS t(i) ON i < n.most LEFT JOIN frames f ON f.utt_idx = n.utt_idx AND f.frame_idx "
    "= i")
def padded_batch(spark, sf):
    f = X.frames(spark, sf).withColumn("emotion_target", F.col("utt_idx") % 5)
    b = B.padded_batches(f, F.floor(F.col("utt_idx") / 4), ("emotion_target",))
    long = b.select("batch", "utt_idx", F.col("size").cast("long").alias("size"), "emotion_target", F.posexplode(F.arrays_zip("feats", "padding_mask")).alias("frame_idx", "x"))
    return long.select("batch", "utt_idx", "size", F.col("frame_idx").cast("long").alias("frame_idx"), r6(F.get("x.feats", F.lit(0)), "first"), r6(F.get("x.feats", F.lit(63)), "last"), F.col("x.padding_mask").alias("padded"), "emotion_target")


@query("WITH " + X.FRAMES + ", r AS (SELECT utt_idx, frame_idx, row_number() OVER (PARTITION BY utt_idx ORDER BY (frame_idx * 7919) % 101, frame_idx) - 1 AS rank FROM frames) "
    "SELECT utt_idx, frame_idx, rank, source FROM r JOIN (SELECT utt_idx AS u, rank AS at, frame_idx AS source FROM r) s ON s.u = utt_idx AND s.at = "
    "frame_idx")
def inverse_permutation(spark, sf):
    """A permutation and its inverse in one row a place."""
    ranks = B.shuffle_ranks(X.frames(spark, sf), "frame_idx", F.col("frame_idx") * 7919 % 101, "utt_idx")
    source = B.argsort(ranks, "frame_idx", "utt_idx").withColumnRenamed("rank", "frame_idx")
    return ranks.join(source, ["utt_idx", "frame_idx"]).select("utt_idx", "frame_idx", F.col("rank").cast("long").alias("rank"), "source")


@query("WITH " + X.FRAMES + ", r AS (SELECT utt_idx, frame_idx, row_number() OVER (PARTITION BY utt_idx ORDER BY (frame_idx * 7919) % 101, frame_idx) - 1 AS rank, count(*) OVER "
    "(PARTITION BY utt_idx) AS n FROM frames) SELECT utt_idx, count(*) FILTER (rank < floor(n * 0.25)) AS kept, count(*) FILTER (rank >= floor(n * 0.25)) "
    "AS masked, sum(frame_idx) FILTER (rank < floor(n * 0.25)) AS kept_sum FROM r GROUP BY utt_idx")
def random_mask(spark, sf):
    ranks = B.shuffle_ranks(X.frames(spark, sf), "frame_idx", F.col("frame_idx") * 7919 % 101, "utt_idx")
    m = B.keep_first(ranks, 0.75, "utt_idx")
    return m.groupBy("utt_idx").agg(F.count_if(~F.col("masked")).alias("kept"), F.count_if("masked").alias("masked"), F.sum(F.when(~F.col("masked"), F.col("frame_idx"))).alias("kept_sum"))


@query("WITH " + X.FRAMES + " SELECT utt_idx, frame_idx - 2 AS frame_idx, round(feat[1], 6) AS first FROM frames WHERE frame_idx >= 2")
def strip_extra_tokens(spark, sf):
    return B.without_extra(X.frames(spark, sf), 2).select("utt_idx", "frame_idx", r6(F.get("feat", F.lit(0)), "first"))


@query("SELECT event_id AS step, round(CASE WHEN event_id >= 500 THEN 1.0 ELSE 1.0 - 0.9 * (1 - event_id / 500) END, 6) AS rate FROM events")
def annealed_rate(spark, sf):
    return X.table(spark, sf, "events").select(F.col("event_id").alias("step"), r6(B.annealed(0.1, 1.0, F.col("event_id"), 500), "rate"))


@query("""
WITH n AS (SELECT DISTINCT count(*) AS heads FROM conversations GROUP BY conv_id), p AS (SELECT heads, 2.0 ** floor(log2(heads)) AS p FROM n)
SELECT heads, h, round(CASE WHEN h < p THEN 2.0 ** (-8.0 * (h + 1) / p) ELSE 2.0 ** (-8.0 * (2 * (h - p) + 1) / (2 * p)) END, 9) AS slope FROM p, range(0, heads) AS t(h)
""")
def alibi_slopes(spark, sf):
    """Slopes of as many heads as some conversation has turns."""
    heads = X.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("heads")).select("heads").distinct()
    rows = heads.select("heads", F.explode(F.sequence(F.lit(0).cast("long"), F.col("heads") - 1)).alias("h"))
    return rows.withColumn("slope", F.round(B.alibi_slope(F.col("h"), F.col("heads")), 9))


@query("WITH h AS (SELECT user_id AS run_id, event_id AS epoch, floor(value) AS metric FROM events) SELECT run_id, epoch, metric FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) AS r FROM h) WHERE r = 1")
def last_epoch(spark, sf):
    h = X.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"), F.floor("value").cast("double").alias("metric"))
    return S.last_epoch(h)


# heads and payloads


@query("""
WITH d AS (SELECT max(len(embedding)) AS w, count(DISTINCT label) AS c FROM embeddings)
SELECT 'emotion_head' AS part, 8 * w + 8 + 8 * c + c AS n FROM d UNION ALL SELECT p || '_head', 8 * w + 8 + 8 + 1 FROM d, (VALUES ('valence'), ('arousal'), ('dominance')) AS t(p)
""")
def parameter_counts(spark, sf):
    """Parameters of the separate heads, of hidden width 8, that fit the vectors and labels of a table."""
    size = X.table(spark, sf, "embeddings").agg(F.max(F.size("embedding")).alias("w"), F.count_distinct("label").alias("c")).first()
    rows = [(k, i, [float(x) for x in w]) for k, a in N.separate_heads(size.c, size.w, 8).start(0).items() for i, w in enumerate(np.atleast_2d(a))]
    model = spark.createDataFrame(rows, "layer string, row int, weights array<double>")
    return model.groupBy(F.substring_index("layer", ".", 1).alias("part")).agg(F.sum(F.size("weights")).alias("n"))


def _dim(i: int) -> str:
    """One dimension's own two layers over h: ReLU, then row i of OUT."""
    return f"list_sum(list_transform(range(1, 9), lambda j: greatest(h[j], 0) * 0.1 * (({i} + j - 1) % 3 - 1)))"


@query("WITH " + HID + f" SELECT utt_id, round({_dim(0)}, 6) AS valence, round({_dim(1)}, 6) AS arousal, round({_dim(2)}, 6) AS dominance, round(h[1], 6) AS logit_0, round(h[2], 6) AS logit_1, round(h[3], 6) AS logit_2, round(h[4], 6) AS logit_3 FROM h")
def parallel_classifier(spark, sf):
    """Four heads of one pooled vector that share no weights: emotion, Valence, Arousal, Dominance."""
    feat = F.col("feat")
    heads = {d: A.linear(A.relu(A.linear(feat, HIDDEN)), [OUT[i]]) for i, d in enumerate(M.DIMS)} | {"e": A.linear(feat, HIDDEN[:4])}
    v = X.vectors(spark, sf).withColumns(heads)
    return v.select("utt_id", *(r6(F.get(d, F.lit(0)), d) for d in M.DIMS), *(r6(F.get("e", F.lit(i)), f"logit_{i}") for i in range(4)))


@query(
    "WITH "
    + X.FRAMES
    + """, w AS (SELECT c, list_transform(range(64), lambda j: 0.01 * ((7 * c + 3 * j) % 5 - 2)) AS w FROM range(8) AS t(c)),
p AS (SELECT utt_idx, c, avg(greatest(0, list_sum(list_transform(range(1, 65), lambda j: feat[j] * w[j])))) AS m FROM frames, w WHERE valid GROUP BY utt_idx, c)
SELECT utt_idx, k AS class_idx, round(sum(m * 0.1 * ((k + c) % 3 - 1)), 6) + 0.0 AS logit FROM p, range(4) AS t(k) GROUP BY utt_idx, k
"""
)
def categorical_baseline(spark, sf):
    """Frames projected, ReLU, pooled, then a linear layer of four classes."""
    out = [[0.1 * ((c + j) % 3 - 1) for j in range(8)] for c in range(4)]
    f = X.frames(spark, sf).withColumn("feat", A.relu(A.linear(F.col("feat"), HIDDEN)))
    z = A.pool(f).where("pooled is not null").select("utt_idx", F.posexplode(A.linear(F.col("pooled"), out)).alias("class_idx", "z"))
    return z.select("utt_idx", F.col("class_idx").cast("long").alias("class_idx"), r6("z", "logit"))


@query(
    "WITH " + HID + ", n AS (SELECT utt_id, list_transform(h, lambda x: greatest(0, (x - list_avg(h)) / sqrt(list_var_pop(h) + 1e-5))) AS h FROM h), o AS (SELECT utt_id, "
        "list_transform(" + _out("{}") + ", lambda x: tanh(x)) AS o FROM n) SELECT utt_id, c AS class_idx, round(o[1] * 0.2 * (c % 4) + o[2] * 0.2 * ((c + 1) % 4) + o[3] * 0.2 * ((c + 2) % "
        "4), 6) + 0.0 AS logit FROM o, range(4) AS t(c)"
)
def two_stage_classifier(spark, sf):
    """Dimensions from a pooled vector, then classes from the dimensions."""
    h = A.relu(A.layer_norm(A.linear(F.col("feat"), HIDDEN)))
    z = X.vectors(spark, sf).select("utt_id", A.tanh(A.linear(h, OUT)).alias("o")).select("utt_id", F.posexplode(A.linear(F.col("o"), CLASS)).alias("class_idx", "z"))
    return z.select("utt_id", F.col("class_idx").cast("long").alias("class_idx"), r6("z", "logit"))


@query(
    "WITH "
    + LOGITS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY logit DESC, c) AS r, exp(logit) / sum(exp(logit)) OVER (PARTITION BY utt_id) AS p FROM logits)
SELECT utt_id, round(max(logit) FILTER (r = 1) - max(logit) FILTER (r = 2), 6) AS logit_margin, round(max(p) FILTER (r = 1) - max(p) FILTER (r = 2), 6) AS probability_margin FROM r GROUP BY utt_id
"""
)
def probability_margin(spark, sf):
    m = Y.margins(_predicted(spark, sf))
    return m.select("utt_id", r6("logit_margin", "logit_margin"), r6("probability_margin", "probability_margin"))


LABELED = ("hap", "sad", "ang", "dis")


def _folder(spark, sf):
    o = A.linear(A.relu(A.linear(F.col("feat"), HIDDEN)), OUT)
    path = F.concat(F.lit("/data/"), F.col("utt_id").cast("string"), F.lit(".wav"))
    return X.vectors(spark, sf).select(path.alias("path"), A.linear(F.col("feat"), HIDDEN[:4]).alias("logits"), o.alias("vad"))


#: Fitted on 1 to 5 for Valence and Arousal; Dominance wasn't trained.
FITTED = (1.0, 5.0, True, 1.0, 5.0, True, 0.0, 0.0, False)


@query(
    "WITH "
    + HID
    + f""", o AS (SELECT utt_id, h[1:4] AS z, [{_dim(0)}, {_dim(1)}, {_dim(2)}] AS v FROM h),
p AS (SELECT *, list_transform(z, lambda x: exp(x) / list_sum(list_transform(z, lambda y: exp(y)))) AS p FROM o)
SELECT utt_id || '.wav' AS audio_file, ['hap', 'sad', 'ang', 'dis'][list_position(p, list_max(p))] AS predicted_emotion,
 round(p[1], 6) AS probability_hap, round(p[2], 6) AS probability_sad, round(p[3], 6) AS probability_ang, round(p[4], 6) AS probability_dis,
 round(v[1], 6) AS valence_normalized, round((v[1] + 1) * 2 + 1, 6) AS valence, 'trained' AS valence_status, 'original_scale' AS valence_scale_status,
 round(v[2], 6) AS arousal_normalized, round((v[2] + 1) * 2 + 1, 6) AS arousal, 'trained' AS arousal_status, 'original_scale' AS arousal_scale_status,
 round(v[3], 6) AS dominance_normalized, round(v[3], 6) AS dominance, 'untrained' AS dominance_status, 'unavailable_normalized_value_repeated' AS dominance_scale_status,
 '{Y.TABLE_WARNING}' AS warning FROM p
"""
)
def folder_predictions(spark, sf):
    """The flat prediction table of a folder."""
    columns = ", ".join(f"lo_{d} double, hi_{d} double, trained_{d} boolean" for d in M.DIMS)
    t = Y.folder_table(_folder(spark, sf), LABELED, spark.createDataFrame([FITTED], columns))
    return rounded(t, *(c for c, k in t.dtypes if k == "double"))


@query(
    "WITH "
    + HID
    + f""", o AS (SELECT utt_id, [round({_dim(0)}, 3), round({_dim(1)}, 3)] AS v FROM h)
SELECT '/data/' || utt_id || '.wav' AS wav, 2 AS target_dim, v[1] + 0.0 AS valence, v[2] + 0.0 AS arousal, true AS no_head, true AS random_head FROM o
"""
)
def vad_payload(spark, sf):
    """Payloads written as JSON and read again."""
    rows = _folder(spark, sf).withColumn("vad", F.transform(F.slice("vad", 1, 2), lambda x: F.round(x, 3)))
    j = Y.vad_payload(rows, "path", "vad", M.DIMS[:2], None, True)
    at = lambda p: F.get_json_object("payload", p)
    return j.select(at("$.wav").alias("wav"), at("$.target_dim").cast("int").alias("target_dim"), (at("$.prediction.valence").cast("double") + 0.0).alias("valence"), (at("$.prediction.arousal").cast("double") + 0.0).alias("arousal"), at("$.head_checkpoint").isNull().alias("no_head"), at("$.random_head").cast("boolean").alias("random_head"))


@query(
    "WITH "
    + HID
    + f""", o AS (SELECT utt_id, h[1:4] AS z, {_dim(2)} AS d FROM h), p AS (SELECT *, CAST(list_position(z, list_max(z)) AS INTEGER) - 1 AS best, list_transform(z, lambda x: exp(x) / list_sum(list_transform(z, lambda y: exp(y)))) AS p FROM o)
SELECT '/data/' || utt_id || '.wav' AS wav, best, ['hap', 'sad', 'ang', 'dis'][best + 1] AS code, round(p[1], 6) AS p_hap, round(d, 6) + 0.0 AS dominance, 'untrained' AS status, true AS warned FROM p
"""
)
def parallel_payload(spark, sf):
    config = Y.HeadsConfig(vad_label_counts={"valence": 3, "arousal": 3}, supervised_dimensions=("valence", "arousal"))
    j = Y.parallel_payload(_folder(spark, sf), "path", "logits", "vad", config, "head.pt")
    at = lambda p: F.get_json_object("payload", p)
    return j.select(at("$.wav").alias("wav"), at("$.prediction.index").cast("int").alias("best"), at("$.prediction.code").alias("code"), r6(at("$.probabilities.hap").cast("double"), "p_hap"), r6(at("$.vad.dominance.value").cast("double"), "dominance"), at("$.vad.dominance.status").alias("status"), at("$.warning").isNotNull().alias("warned"))


# drawn: rows only


@query()
def speaker_split_drawn(spark, sf):
    return S.by_speaker_drawn(X.affect(spark, sf), "speaker", "emotion", seed=42).select("utt_id", "speaker", "emotion", "split")


@query()
def row_split_drawn(spark, sf):
    return S.by_row_drawn(X.table(spark, sf, "events"), "event_id").select("event_id", "split")
