"""A corpus built from the documents table in stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideops.llm import bpe, chosen_path, language, mixing, suffix
from rideops.llm.common import fold_of, measured, small_batches, table
from rideops.session import cut_lineage, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without text or without a letter go."""
    small_batches(spark)
    held_out = fold_of("doc_id", 4) == 2
    named = language.language_columns(docs, language.train(docs.where(~held_out)), held_out, COLUMNS[1:])
    return named.where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates (five words, similarity 0.8).

    Rows of one id are one document; equal rows become one. A row without an id stays.
    """
    small_batches(spark)
    gone = measured(chosen_path.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct())
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    # Only rows that share an id can be equal; no other text is shuffled to find out.
    shared = measured(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    alone = kept.where("doc_id is not null").join(shared, "doc_id", "left_anti")
    return alone.unionByName(kept.join(shared, "doc_id", "left_semi").unionByName(kept.where("doc_id is null")).dropDuplicates())


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document has in a 50-byte string.

    What is left of a cut character becomes U+FFFD and goes, with any others of that text.
    """
    small_batches(spark)
    kept = suffix.without_repeats(docs, ("lang", "source")).withColumn("_kept", F.col("kept").cast("string"))
    mended = F.replace(F.make_valid_utf8("_kept"), F.lit("\ufffd"), F.lit(""))
    return kept.withColumn("text", F.coalesce(F.try_validate_utf8("_kept"), mended)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    sized = cut_lineage(docs.select("doc_id", "source", mixing.word_count().alias("size")))
    taken = mixing.with_copies(docs, mixing.mixing_plan(sized)).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of the ids and of the text decoded from them."""
    small_batches(spark)
    return bpe.bpe_columns(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("repeated_strings", drop_repeated_strings),
          ("mix", mix_sources), ("encode", encode)]
#: Naive Bayes, chosen paths, suffix sorting and BPE have no SQL form; run() is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
