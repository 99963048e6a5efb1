"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
Columns of docs may have any names besides doc_id and text; all but the last stage
return the columns that they got. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affectra.llm.common import column, documents, packed, table, text_or_empty, unpacked, written
from affectra.llm.decontaminate import find_leaks
from affectra.llm.linededup import remove_repeated_runs
from affectra.llm.neardup import near_duplicates
from affectra.llm.packing import pack_documents
from affectra.llm.rules import scored, train

#: Documents that score below this go.
QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is below QUALITY.

    Each row is judged by its own text, repeated or without id; null text is empty.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).where(F.col("quality_score") >= QUALITY).select(*unpacked(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of two lines, and later repeated lines of 50 words.

    A document of which nothing is left goes. A column n_chars, where there is
    one, gets the new length of texts that lost lines. Null text stays null; rows
    without id come first, rows of one id in order of a hash of the text, and
    rows equal in both keep alike.
    """
    left = remove_repeated_runs(docs.select("doc_id", "text", packed(docs).alias("row")))
    emptied = (F.col("n_removed") > 0) & (F.length(F.trim("text")) == 0)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return left.where(~F.coalesce(emptied, F.lit(False))).select(*unpacked(docs.columns, changed))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text_or_empty(text))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8).

    Rows are told apart by a number of their own, so rows that share an id, or
    have none, are documents like others; the smallest id of a group stays, of
    equal ids any one row. Texts without words all stay.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("r"), F.col("doc_id").alias("d"), column("text").alias("t"), packed(docs).alias("row")), "rows")
    group = near_duplicates(rows, width=5, percent=80, bands=36, rows=5, id_col="r", text_col="t").select(F.col("doc_id").alias("r"), "component_id")
    first = group.join(rows.select("r", "d"), "r").groupBy("component_id").agg(F.min(F.struct(F.col("d").isNull(), "d", "r")).alias("first")).select(F.col("first.r").alias("r"))
    return rows.join(first, "r", "left_semi").select(*unpacked(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, up to a fifth of its words edited.

    Whether a row goes depends on its text alone, which a 64-bit hash stands
    for: rows without id go too, and clean rows stay where a hit has their id.
    Null and empty texts stay.
    """
    keyed = docs.select(_text_hash(column("text")).alias("h"), "text")
    hit = written(find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_col="h").select(F.col("doc_id").alias("h")).distinct(), "leaks")
    rows = docs.select(_text_hash(column("text")).alias("h"), packed(docs).alias("row"))
    return rows.join(hit, "h", "left_anti").select(*unpacked(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of the documents left in sequences of 1024 ids; rows without id or of one id are documents of their own."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: A trained score and edit distances have no SQL form; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
