"""A training corpus from raw documents: language ID, quality, near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame with
the columns of documents; the last one returns token ids.  run() applies them in order and writes what each stage
returns to the shared folder, so a lost executor repeats one stage's task, not the pipeline.

Nulls and edge cases: texts that are null or without a letter are rejected by the first stage, and later stages
accept them all the same; rows with a null doc_id are never near duplicates; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import lang_id, mixing, ngram_join, pieces, quality
from sparkloom.llm.common import Scratch, fresh, read
from sparkloom.llm.queries import PIECE_BPE
from sparkloom.llm.vectors import BATCH_BYTES, BYTES_KEY

#: Whole texts that Arrow sends to a Python worker at once.  Spark's own 10,000 are a whole task's texts, held by the executor and by
#: its worker, and a worker that lives on keeps that memory in all later stages.
TEXTS = 500
#: A document needs this posterior of its best language, and this calibrated chance of good quality.
LANGUAGE_SCORE, QUALITY_SCORE = 0.5, 0.3


def few_texts(spark: SparkSession) -> None:
    """Arrow's batches of the session have TEXTS rows and about BATCH_BYTES at most from now on, as a stage's rows are made when its caller writes them."""
    spark.conf.set(BYTES_KEY, BATCH_BYTES)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS:
        spark.conf.set(key, TEXTS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a clear language, as learned from those that have one."""
    few_texts(spark)
    found = fresh(docs, "language")
    known = lang_id.identify(spark, docs, lang_id.train(docs), into=found)
    clear = (F.col(f"{found}.lang_pred") != lang_id.UNDETERMINED) & (F.col(f"{found}.score") >= LANGUAGE_SCORE)
    return known.where(clear).drop(found)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of good quality, as learned from labels.quality."""
    few_texts(spark)
    stats, score = fresh(docs, "stats"), fresh(docs, "score")
    _, model = quality.measure_and_fit(spark, docs, read(spark, sf_dir, "labels"), Scratch(spark, "quality"))
    scored = quality.score(spark, quality.with_statistics(docs, "text", stats), model, stats, score)
    return scored.where(F.col(score) >= QUALITY_SCORE).drop(stats, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each group of near duplicates."""
    few_texts(spark)
    gone, rows, place, again = (fresh(docs, name) for name in ("gone", "rows", "place", "again"))
    groups = ngram_join.join(spark, docs.select("doc_id", "text"), Scratch(spark, "groups"))
    lost = Scratch(spark, "gone").write(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "ids")
    kept = docs.join(lost, docs["doc_id"].cast("bigint") == F.col(gone), "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias(rows)).where(F.col(rows) > 1).select("doc_id")
    if repeated.isEmpty():
        return kept
    # Rows that share a doc_id: one stays, that with the smallest hash of its text.  Rows of equal text are told apart by a
    # number that is written down, so a task that runs again picks the same one; other columns may be of any type.
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = Scratch(spark, "marked").write(kept.join(repeated.withColumn(again, F.lit(True)), "doc_id", "left").select(*names, again, F.monotonically_increasing_id().alias(place)), "rows")
    first = marked.where(F.col(again)).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), F.col(place))).alias(rows)).select(F.col(f"{rows}.{place}").alias(place), F.lit(True).alias(rows))
    return marked.join(first, place, "left").where(F.col(again).isNull() | F.col(rows)).select(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    few_texts(spark)
    return mixing.mix(spark, docs, Scratch(spark, "mix"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids_sha256, decoded_sha256, ids) of each document of the mix."""
    few_texts(spark)
    made = pieces.encode(docs.select("doc_id", "source", "text"), PIECE_BPE)
    return made.select("doc_id", "source", "pieces.*")


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("pieces", token_ids),
]
#: Language, quality and piece ids are not SQL; tests/llm/test_pipeline.py follows run() stage by stage in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
