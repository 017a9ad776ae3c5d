"""A corpus cleaned in stages: documents in, token ids out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, neardup, pii, sptok
from tidemark.llm.spark import held_out, remove, shared_dir, table

#: Least share of all a document's n-grams that its language's filter must hold.
SURE = 0.2
#: Fewer n-grams than these are too little evidence to reject a document by.
EVIDENCE = 10


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or, with EVIDENCE of it, in no learned language; lang becomes the predicted one."""
    filters = langid.fit(docs.where(~held_out(5, 0)), fewest=2)
    told = langid.predict(docs, filters, *docs.columns)
    kept = told.where((F.col("lang_pred") != "und") & ((F.col("known") >= SURE) | (F.col("grams") < EVIDENCE)))
    return kept.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group of near-duplicates; rows without a doc_id come last."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; each row is judged by its text."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by the kind's name; n_chars follows."""
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and SentencePiece ids."""
    coded = sptok.tokenize(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("sentencepiece", tokens),
]

#: Fingerprints and tokenization aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet in the shared folder and read again, the one before is removed then."""
    docs, folder, last = table(spark, sf_dir, "documents"), shared_dir(spark), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
        if last:
            remove(spark, last)
        last = f"{folder}/{k}_{name}"
    return docs
