"""The registered query of each operator here, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import ensure_checkpoint_dir

from . import langid, mixing, mtree, onebit, pieces
from .aligned import align
from .bitfiles import read_token_ids, write_token_ids
from .common import crc_mod, read
from .near import near_duplicates
from .packing import pack
from .repair import damage, repair
from .repeats import remove_repeats
from .tokens import count_tokens
from .urls import judge

QUERIES: dict = {}
ORACLES: dict[str, str] = {
    "op8_tree_search": """
        with scaled as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint score
            from scaled q join scaled c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
        select * from (
            select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int "rank", vec_id, score from scored)
        where "rank" <= 10""",
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(read(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


@query
def op2_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return onebit.search(rows, rows.where("vec_id % 20 = 0"), k=20)


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")


@query
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 3) == 1
    documents = read(spark, sf_dir, "documents").withColumn("held_out", held_out)
    found = langid.identify(documents, langid.fit(documents.where(~F.col("held_out"))), keep=["held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return mtree.search(rows, rows.where("vec_id % 100 = 0"), k=10)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    return judge(read(spark, sf_dir, "pages"), rules)


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align(read(spark, sf_dir, "documents"), *paths, keep_groups=False).withColumnRenamed("groups", "groups_sha256")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(read(spark, sf_dir, "conversations")), keep_text=False)


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_token_ids(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
