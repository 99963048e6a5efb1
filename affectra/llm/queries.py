"""Queries of the text operators, one opN_<name> each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .balltree import top_inner_products
from .common import documents, id_crc, table, text_or_empty
from .decontaminate import find_leaks
from .fillmiddle import fill_in_middle, restored
from .gifmedia import digests, stored
from .linededup import remove_repeated_runs
from .neardup import near_duplicates
from .packing import pack_documents
from .periods import periodic_runs
from .rules import score, train
from .sharding import shard
from .substrings import remove_repeated_windows
from .suffixarray import remove_earlier_strings
from .suffixtree import score_texts

#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids, a row per piece; null text is one end id."""
    return pack_documents(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rid of later repeated runs of two lines and later repeated lines of 50 words; null text is one empty line."""
    left = remove_repeated_runs(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: A run is two lines, or one line of 50 words.
OP2_SQL = r"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents),
l AS (SELECT doc_id, unnest(range(len(raw))) AS s, unnest(raw) AS line FROM x),
w AS (SELECT doc_id, s, trim(line, ' ') || chr(10) || trim(lead(line) OVER (PARTITION BY doc_id ORDER BY s), ' ') AS k FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM w WHERE k IS NOT NULL),
o AS (SELECT doc_id, s, row_number() OVER (PARTITION BY trim(line, ' ') ORDER BY doc_id, s) AS r FROM l WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
g AS (SELECT doc_id, s + o AS s FROM f, (VALUES (0), (1)) AS t(o) WHERE r > 1 UNION SELECT doc_id, s FROM o WHERE r > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.s) AS n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.s) FILTER (WHERE g.s IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.s = l.s GROUP BY l.doc_id
"""


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as GIF payloads, read back; null text is 64 zero bytes."""
    return digests(stored(documents(spark, sf_dir)))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of at most SHARD_BYTES bytes of text by a hash of the id."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return shard(docs, SHARD_BYTES).select("doc_id", "n_bytes", "shard", F.col("shard_depth").cast("long").alias("shard_depth"), "shard_bytes")


OP5_SQL = f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0) AS b, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h FROM documents),
e AS (SELECT doc_id, b, d, h >> (60 - d)::BIGINT AS p FROM r, range(0, 61) AS t(d)),
s AS (SELECT d, p, CAST(sum(b) AS BIGINT) AS bytes FROM e GROUP BY d, p),
m AS (SELECT e.doc_id, min(e.d) FILTER (WHERE s.bytes <= {SHARD_BYTES} OR e.d = 60) AS depth FROM e JOIN s ON s.d = e.d AND s.p = e.p GROUP BY e.doc_id)
SELECT e.doc_id, CAST(e.b AS BIGINT) AS n_bytes, right(lpad(bin(e.p), 64, '0'), m.depth::INT) AS shard, CAST(m.depth AS BIGINT) AS shard_depth, s.bytes AS shard_bytes
FROM e JOIN m ON m.doc_id = e.doc_id AND m.depth = e.d JOIN s ON s.d = e.d AND s.p = e.p
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item found in it, a fifth of the item's words edited at most."""
    return find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rid of words in 20-word windows that start earlier; null text has no words."""
    got = remove_repeated_windows(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS x FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS s, unnest(x) AS word FROM w),
k AS (SELECT doc_id, s, md5(array_to_string(list(word) OVER r, ' ')) AS k, count(*) OVER r AS n FROM p WINDOW r AS (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM k WHERE n = 20),
c AS (SELECT p.doc_id, p.s, p.word, coalesce(max(CASE WHEN f.r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.s = p.s)
SELECT d.doc_id, count(c.s) AS n_words, CAST(coalesce(sum(c.gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.s) FILTER (WHERE c.gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its component of near copies (three-word shingles, 85 %)."""
    return near_duplicates(documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(1, greatest(len(x) - 1, CASE WHEN len(x) > 0 THEN 2 ELSE 1 END))) AS i FROM w),
h AS (SELECT DISTINCT doc_id, array_to_string(x[i:i + 2], ' ') AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
s AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM h a JOIN h b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM s JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; labels of fold 2 of 4 by crc32 of the id teach nothing."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; fold 0 of 10 by crc32 of the id teaches nothing."""
    return score_texts(documents(spark, sf_dir))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rid of bytes in 50-byte strings that a document of smaller id has; null text is empty."""
    got = remove_earlier_strings(documents(spark, sf_dir))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH x AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents),
p AS (SELECT doc_id, unnest(range(len(x))) AS s, unnest(x) AS byte FROM x),
w AS (SELECT *, CASE WHEN count(*) OVER r = 50 THEN md5(array_to_string(list(byte) OVER r, '')) END AS k FROM p
  WINDOW r AS (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
f AS (SELECT *, k IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY k) AS earlier FROM w),
c AS (SELECT doc_id, s, byte, max(CASE WHEN earlier THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
t AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY s), 0) = 0 THEN 1 ELSE 0 END AS begins FROM c)
SELECT d.doc_id, count(t.s) AS n_bytes, CAST(coalesce(sum(t.gone), 0) AS BIGINT) AS n_removed, CAST(coalesce(sum(t.begins), 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(string_agg(t.byte, '' ORDER BY t.s) FILTER (WHERE t.gone = 0), ''))) AS kept_sha256
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents parted in three by tokens and put in another order, with checksums of that and of the text made from it; null text is empty."""
    got = fill_in_middle(documents(spark, sf_dir))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS k FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
  ('0x' || substr(k, 1, 8))::BIGINT AS h1, ('0x' || substr(k, 9, 8))::BIGINT AS h2, ('0x' || substr(k, 17, 8))::BIGINT AS h3, ('0x' || substr(k, 25, 8))::BIGINT AS h4 FROM x),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS pre, coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS mid, coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten greatest inner products of every hundredth vector with all others."""
    got = top_inner_products(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return got.select("query_id", "rank", "vec_id", "score")


OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which those whose crc32(doc_id) ends in 0 go on, from a word that it chooses, in repetitions of the words there."""
    h = id_crc()
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.coalesce(F.size("w"), F.lit(0)).cast("long"))
    g = F.floor(F.col("h") / 10)
    rest = chosen.select("doc_id", "text", "w", "n", g.alias("g"), F.when(F.col("n") > 0, F.pmod(g, F.greatest("n", F.lit(1)))).alias("a")).withColumn("left", F.col("n") - F.col("a"))
    p = (F.floor(F.col("left") / (3 + F.pmod("g", F.lit(8)))) + 1).cast("int")
    a, left = F.col("a").cast("int"), F.col("left").cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil(F.col("left") / p).cast("int")))
    return rest.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", F.slice("w", 1, a), F.slice(again, 1, left))).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth with planted repetitions: their periodic runs, the one of most periods, and what is left; null text has no words."""
    got = periodic_runs(with_planted_runs(documents(spark, sf_dir)))
    # length / period, compared exactly, then start and period
    def order(x, y):
        more, most = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(more > most, -1).when(more < most, 1).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(F.signum(x["period"] - y["period"]).cast("int"))

    best = got.withColumn("best", F.get(F.array_sort("runs", order), F.lit(0)))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {"op9_suffix_array": op9_suffix_array, "op4_quality": op4_quality, "op6_suffix_tree": op6_suffix_tree, "op10_neardup": op10_neardup, "op8_substrings": op8_substrings, "op1_pack": op1_pack, "op2_line_dedup": op2_line_dedup, "op3_gif": op3_gif, "op5_shard": op5_shard, "op7_decontaminate": op7_decontaminate, "op11_fill_middle": op11_fill_middle, "op12_ball_tree": op12_ball_tree, "op13_periodic_runs": op13_periodic_runs}
SQL: dict[str, str] = {"op8_substrings": OP8_SQL, "op2_line_dedup": OP2_SQL, "op5_shard": OP5_SQL, "op9_suffix_array": OP9_SQL, "op10_neardup": OP10_SQL, "op11_fill_middle": OP11_SQL, "op12_ball_tree": OP12_SQL}
