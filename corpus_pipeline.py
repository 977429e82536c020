"""A corpus pipeline: language identification, near-duplicate removal, repeated passages, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid
from ledgerloom.llm.common import exact, read, small_batches
from ledgerloom.llm.near import near_duplicates
from ledgerloom.llm.packing import pack
from ledgerloom.llm.repeats import remove_repeats
from ledgerloom.session import ensure_checkpoint_dir

#: A text is rejected if it has no letter, or if no language gets this much of its probability.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the network can tell; it learns from the labelled ones among them.
    Documents without a letter go; without any labelled document the others stay."""
    network = langid.fit(docs)
    found = langid.identify(docs.select("doc_id", "text", F.struct("*").alias("row")), network, keep=["row"])
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE) if network else F.col("row.text").rlike(r"\p{L}")
    return found.where(sure).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near copies (five-word shingles, similarity 0.8), and one
    row of it. Rows without an id can't be told apart and stay."""
    kept = near_duplicates(docs, size=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*map(exact, docs.columns)).union(docs.where("doc_id is null"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages out; documents of which nothing is left go. n_chars follows the new text."""
    row = F.struct(*[exact(c) for c in docs.columns if c != "text"]).alias("row")
    out = remove_repeats(docs.select("doc_id", "text", row)).where("n_words > n_removed")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed training sequences, a row per piece with its ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("7 language", language), ("3 near copies", near_copies), ("5 passages", passages), ("4 packing", packing)]
#: No stage but the last could be put into SQL; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written as Parquet and read by the next stage."""
    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
