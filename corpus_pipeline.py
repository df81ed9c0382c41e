"""From raw documents to packed training sequences, in five stages of the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom.llm import decontamination, jaccard, language, packing, substrings
from tickerloom.llm.arrow import stored
from tickerloom.session import checkpoint_ready, small_side

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Dropped ids that are sent to the documents instead of shuffling the texts, at most.
FEW_IDS = 400_000


def set_apart(docs: DataFrame) -> DataFrame:
    """The columns under names that no operator gives to its results, so that further columns of any name pass through."""
    return docs.select(*[F.col(c).alias(f"in_{c}") for c in docs.columns])


def named_back(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"in_{c}").alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; lang becomes the predicted language, where one was learned. Further columns stay as they are."""
    rows = set_apart(docs)
    profiles = language.learn_profiles(rows, "in_text", "in_lang", "in_doc_id")
    known = language.identify(rows, profiles, "in_text", keep=rows.columns).where("is_text")
    lang = F.when(F.col("lang_pred") != language.UNKNOWN, F.col("lang_pred")).otherwise(F.col("in_lang"))
    return named_back(known.withColumn("in_lang", lang), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the least id (NULL last), then the least row key.

    Rows with equal or NULL ids are judged each by itself; rows without words stay.
    """
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4()}"
    docs.withColumn("__row", F.monotonically_increasing_id()).write.parquet(folder)
    keyed = spark.read.parquet(folder)
    groups = stored(jaccard.near_copies(keyed, row_col="__row").where(F.col("component").isNotNull()))
    best = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("n"))
    several = best.where("n > 1").select("component", F.col("best.rid").alias("stays"))
    dropped = groups.join(several, "component").where(F.col("rid") != F.col("stays")).select(F.col("rid").alias("__row"))
    return keyed.join(small_side(dropped, FEW_IDS), "__row", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in documents with smaller ids. Further columns stay as they are."""
    rows = set_apart(docs)
    others = tuple(c for c in rows.columns if c not in ("in_doc_id", "in_text", "in_n_chars"))
    cleaned = substrings.remove_repeats(rows, id_col="in_doc_id", text_col="in_text", keep=others)
    texts = {"in_doc_id": F.col("doc_id"), "in_text": F.col("clean_text"), "in_n_chars": F.length("clean_text").cast("bigint")}
    return named_back(cleaned.withColumns(texts), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [("language_id", language_id), ("jaccard_join", near_copies), ("substring_dedup", substring_dedup),
          ("decontamination", decontaminate), ("packing", pack)]
#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written to the shared folder and read again."""
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
