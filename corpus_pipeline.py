"""A training-data pipeline: each stage applies one operator to all that the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmart.llm import bpe, mixing, pii, probminhash, quality, registry
from parcelmart.llm.columns import held
from parcelmart.sources.staging import stage as staged

#: SQL cannot express the hashed, trained and random stages; tests compare them with brute-force versions.
ORACLE_SQL = None

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_WORD = r"[^\x20\x09-\x0D]"


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*_COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The ratios are those of the documents given.

    A NULL or empty text has too few words and goes; rows that repeat are judged alike; an empty table stays empty.
    """
    return _plain(quality.judge(_plain(docs), registry.trusted_documents(spark, sf_dir)).filter("kept"))


def _with_id(docs: DataFrame) -> DataFrame:
    """The plain columns and _id, 128 bits that depend on all of them: rows share it if they are alike in every column."""
    plain = _plain(docs)
    # NULL is told from every value, and each value from what follows it by its length.
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in _COLUMNS]
    return plain.withColumn("_id", held(F.substring(F.sha2(F.concat(*parts), 256), 1, 32)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one of smallest doc_id (NULL last), of equal ids the same one in every run.

    Rows are documents of their own, also those that repeat an id; rows without words are in no group and all stay.
    """
    rows = _with_id(docs)
    # Rows alike in all columns are of one group if they have words; one of them stands for all.
    worded = rows.filter(F.col("text").rlike(_WORD))
    groups = probminhash.near_duplicates(worded, key="_id").select("_id", "class_id").distinct()
    ids = worded.select("_id", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_id")))["_id"]
    kept = groups.join(ids, "_id").groupBy("class_id").agg(first.alias("_id")).select("_id")
    one_each = worded.dropDuplicates(["_id"]).join(kept, "_id", "left_semi")
    wordless = rows.filter(~F.coalesce(F.col("text").rlike(_WORD), F.lit(False)))
    return _plain(one_each.unionByName(wordless))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the new text.

    A NULL text stays NULL, as does its n_chars; an empty one stays empty; rows that repeat stay, changed alike.
    """
    found = pii.find_personal_data(_plain(docs), redacted=True)
    return found.select("doc_id", F.col("redacted_text").alias("text"), "lang", "source", F.length("redacted_text").cast("long").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to twice; those it does not take go.

    Rows without words have size 0 and are taken by the same draws; rows alike in all columns are interchangeable.
    """
    rows = _with_id(docs)
    sized = rows.select("_id", "source", registry.word_count("text").alias("size"))
    # Rows alike in all columns are interchangeable: their copies are added up and taken from one of them.
    copies = mixing.mix_sources(sized, key="_id").groupBy("_id").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    taken = rows.dropDuplicates(["_id"]).join(copies, "_id").select(*_COLUMNS, "copies")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*_COLUMNS)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the digests of the ids and of what they decode to. A NULL text is empty; rows that repeat stay."""
    out = bpe.digest_documents(_plain(docs), registry.ranks_path())
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("byte_level_bpe", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written and read again by the next.

    Other columns of the table, whatever their names, do not matter; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = staged(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
