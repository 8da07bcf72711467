"""A training-data pipeline over ``documents``: every stage works on what the last one kept.

1. ``language_id``: the language of every text is predicted and becomes its ``lang``;
   documents without any (``und``) go.
2. ``near_dedup``: one row of each near-duplicate group stays, that of the smallest id (null
   only if all ids are); of rows without a word, one for each id and text.
3. ``substring_dedup``: words that repeated windows cover are cut out; documents of which
   nothing is left go. ``n_chars`` follows the text.
4. ``pii``: personal data is replaced by its kind in brackets; ``n_chars`` follows.
5. ``packing``: what is left is packed into sequences.

All but the last return the columns of ``documents``. Null ids and languages pass through;
a null text is rejected by the first stage. Other columns are dropped by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import language_id, near_dedup, packing, pii, substring_dedup
from tessella.llm.words import text_key
from tessella.runtime import materialize, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    profiles = language_id.learn(docs.where(language_id.remainder(3) != 1))
    found = language_id.identify(docs.select(*COLUMNS), profiles, "doc_id", "text", "source", "n_chars")
    kept = found.where(F.col("lang_pred") != language_id.UNDETERMINED)
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = docs.select(*COLUMNS)
    found = near_dedup.near_duplicates(docs)
    # the row of a group that stays: of its smallest id, null only if all are null, then by text
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "t1", "t2"))
    kept = found.where("group is not null").groupBy("group").agg(best.alias("k")).select("k.*")
    bare = found.where("group is null").select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "t1", "t2")
    kept = materialize(kept.unionByName(bare).distinct(), "kept")
    rows = docs.select("*", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), *text_key())
    return rows.join(kept, ["none", "id", "t1", "t2"], "left_semi").dropDuplicates(["none", "id", "t1", "t2"]).select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = docs.select(*COLUMNS)
    changed = substring_dedup.substring_dedup([docs], deal=substring_dedup.BATCHES).where("n_removed > 0").select("t1", "t2", "kept_text").dropDuplicates(["t1", "t2"])
    rows = docs.select("*", *text_key()).join(materialize(changed, "changed"), ["t1", "t2"], "left")
    text = F.coalesce("kept_text", "text")
    cut = rows.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")).alias("n_chars"))
    return cut.where("text <> ''")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.mask(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return packing.best_fit_pack(docs.select(*COLUMNS), public_tokenizers.path(packing.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
