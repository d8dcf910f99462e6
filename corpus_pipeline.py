"""Clean a corpus: toxic texts go, one of each group of near copies stays, leaked tests go, personal data is masked,
and what is left is tokenized. Each stage is written as Parquet and read again by the next.

All stages but the last keep the columns of their input, whatever further ones there are. Null and empty texts are no
reason to go; equal ones are near copies. Equal texts are judged alike by every stage, ties go to the smallest id, rows
without an id stay only where their group has none, and an empty table passes all stages. Long texts are read whole by
every stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetide.llm import bpe, decontamination, pii, simhash, toxicity
from sitetide.session import free_name, own_folder, table

#: Stages on word shingles take five words and a similarity of 0.8.
SHINGLE = 5
#: Bytes of text that a task of the last stage holds at a time, with their words and ids.
CHUNK_BYTES = 4 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; null and empty texts stay."""
    name = free_name("toxic", docs)
    scored = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), name)
    return scored.filter(F.col(name) < 0.5).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: a Jaccard index of 0.8 or more."""
    return simhash.keep_similar(docs, shingle=SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    names = tuple(free_name(c, docs) for c in decontamination.NAMES)
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), keep=True, names=names)
    return found.filter(F.size(names[1]) == 0).drop(*names)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars``, where there is one, follows the text."""
    masked = pii.mask(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source`` (those that there are), the ids of each text, and the digest of the text decoded from them."""
    names = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    coded = bpe.digests(docs, names=names, with_list=True, chunk=CHUNK_BYTES)
    return coded.select(*names, "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal data", mask_personal),
    ("tokens", encode),
]

#: SQL cannot train the classifier of the first stage; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{own_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
