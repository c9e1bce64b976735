"""The training-data pipeline: language identification, near duplicates, benchmark decontamination, secret scan, packing.

Each stage reads what the one before it has kept. All but the last give the columns of ``documents``; the last gives the
packed pieces. Rows without id go through every stage. Rows with null or empty texts, or without a letter, go in the first
stage, which finds no language in them. An empty table gives empty stages. Repeated rows leave one in the second. Very long
texts are held whole by one task. Extra columns go along, whatever their names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm import decontaminate, jaccard, langid, packing, secrets
from factledger.llm.common import discard, fresh, quoted, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; those without a letter, or with less than half of their letters in
    one language, go. ``lang`` becomes the language found."""
    model = langid.fit(docs)
    names = tuple(fresh(docs.columns, x) for x in langid.NAMES)
    found = langid.identify(docs, model, keep=docs.columns, spans=False, names=names)
    kept = found.where((F.col(names[0]) != langid.UND) & (F.col(names[1]) >= 0.5))
    return kept.withColumn("lang", F.col(names[0])).select(*quoted(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one with the least id."""
    return jaccard.one_per_component(docs).select(*quoted(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*quoted(docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text replaced by their kind; ``n_chars`` is that of the new text."""
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = secrets.find_secrets(docs, replace=True, keep=keep, spans_name=fresh(docs.columns, "spans"))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*quoted(docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", packed),
]


BATCH_ROWS = 2000  # rows in an Arrow batch: what a worker and its executor hold of a task's input at a time


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage has read goes once the
    next one is written. Stages run with Arrow batches of ``BATCH_ROWS``, since all share the executors' memory; after them
    the session has its own setting again."""
    name_of, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name_of, str(BATCH_ROWS))
    try:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            read, docs = docs, stored(stage(spark, docs, sf_dir), name)
            discard(read)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(name_of, before)


#: SQL can express neither the classifier nor the tokenizer; the tests hold each stage against a plain version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
