"""The numbered operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, kneser_ney, licenses, merkle, mixing, near_vectors, pii, probminhash, quality, repeats, shard_tree, url_aliases, whitening
from .oracle import merkle_sql, shard_sql

_WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ranks_path() -> str:
    """The public vocabulary of the contract; any file of ranks may be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def op1_url_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return url_aliases.judge_urls(_table(spark, folder, "pages"))


def op2_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.link_vectors(_table(spark, folder, "embeddings"))


def op3_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    model = kneser_ney.train(docs.filter(~held_out))
    return kneser_ney.score(docs.withColumn("held_out", held_out), model)


def trusted_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "labels").filter("quality = 1").select("doc_id")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return quality.judge(docs, trusted_documents(spark, folder), columns=["doc_id"])


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = licenses.scan(docs, frequencies=licenses.document_frequencies(docs))
    return found.drop("text", "matches")


def op6_probminhash(spark: SparkSession, folder: str) -> DataFrame:
    return probminhash.near_duplicates(_table(spark, folder, "documents"))


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return mixing.mix_sources(docs.select("doc_id", "source", word_count("text").alias("size"))).drop("source", "copies")


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return bpe.digest_documents(docs, ranks_path()).drop("text")


def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Every copy of a repeated string goes, the first one too: the query's contract."""
    return repeats.remove_repeats(_table(spark, folder, "documents"), keep_first=False)


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    made = merkle.manifest(docs, changed=changed, now=merkle.folded_case(merkle.FIELDS))
    return merkle.prove(made).withColumnRenamed("id", "doc_id")


#: Shards of the query, and what one more makes of them.
SHARDS = 8


def op12_shard_tree(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    docs = _table(spark, folder, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard_tree.place(docs, shard_tree.tree_for(SHARDS))
    placed = shard_tree.place(placed, shard_tree.tree_for(SHARDS + 1), names=("_g", "_k", "grown_shard"))
    columns = ["doc_id", "size", "text_crc32", "region", "rack", "shard", "grown_shard"]
    return shard_tree.slots(placed, columns).withColumn("law", F.lit("key"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_aliases,
        op2_near_vectors,
        op3_kneser_ney,
        op4_quality_rules,
        op5_license_scan,
        op6_probminhash,
        op7_personal_data,
        op8_source_mixing,
        op9_byte_bpe,
        op10_repeats,
        op11_merkle_manifest,
        op12_shard_tree,
        op13_whitening,
    )
}

ORACLE: dict[str, str] = {
    "op11_merkle_manifest": merkle_sql(merkle.FIELDS, merkle.FAN),
    "op12_shard_tree": shard_sql(shard_tree.tree_for(SHARDS), shard_tree.tree_for(SHARDS + 1)),
}
