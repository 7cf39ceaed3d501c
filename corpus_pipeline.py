"""A corpus pipeline of five stages over ``documents``.

Documents that the quality classifier rejects go; of each group of near
duplicates one stays; contaminated documents go; secrets are replaced; what is
left is encoded. Each stage works on all its predecessor kept.

In every stage a null or empty text is a text without words: the classifier
scores it like any other, nothing else removes or changes it, and it encodes to
no tokens. A null id is kept as it is. Repeated rows meet the same fate, except
that of rows with equal ids and texts one stays after near duplicates go. All but
the last stage keep the columns they are given, whatever others there are and
however these are named. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.llm import decontaminate, gam, jaccard, secrets, spm
from turnlens.llm.durable import shared_folder
from turnlens.llm.queries import token_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, accepts; of equal scores all or none."""
    return gam.accept(docs, gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of linked ones; texts without words link with nothing."""
    return jaccard.one_of_each(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced and n_chars brought up to date."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their tokens, and whether decoding these gives the text."""
    out = spm.encode(docs, token_file("piece_bpe_32k.model"), decode=True)
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(spm.MARK), F.lit(" "))
    return out.withColumns({"n_tokens": F.size("tokens").cast("long"), "round_trip": F.col("decoded") == plain}).drop("decoded")


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", contamination),
    ("secret_scan", secret_spans),
    ("sentencepiece", tokens),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet in the shared folder and read again.

    A stage's table is removed once the next one has been written; the last one,
    which the result reads, stays for the caller.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return docs
