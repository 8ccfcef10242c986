"""From raw documents to training shards in five stages.

Quality classifier, removal of near duplicates, benchmark decontamination,
mixing of the sources, sharding.  Every stage works on all rows that the one
before kept and reads them from a table, so a lost executor costs a stage at
most.  Stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm import catalog, leaks, mixing, ngrams, quality, shards
from postmill.session import remove, scratch, work_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality label is likelier 1 than 0.

    A null or empty text is scored as one without words.  Repeated rows get one
    score and stay or go together.
    """
    docs = docs.select(*COLUMNS)
    scored = quality.score(docs, catalog.quality_model(spark, docs, sf_dir))
    return scored.where("quality_score >= 0.5").select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group linked by 0.8 of their five-word shingles.

    Of rows that repeat an id one stays; rows without an id all stay.
    """
    docs = docs.select(*COLUMNS)
    groups = ngrams.near_sets(docs, width=5, threshold=80).where("doc_id <> component_id").select("doc_id").distinct()
    alone = F.when(F.col("doc_id").isNull(), F.xxhash64("text", "source"))
    row = F.row_number().over(W.partitionBy("doc_id", "_alone").orderBy("text", "lang", "source", "n_chars"))
    kept = docs.join(groups, "doc_id", "left_anti").withColumn("_alone", alone).withColumn("_row", row)
    return kept.where("_row = 1 OR doc_id IS NULL").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A null or empty text holds none.  Of an id's rows only those whose own text
    holds an item go; repeated rows go together.
    """
    keyed = docs.select(*COLUMNS).withColumn("_row", F.xxhash64("doc_id", "text"))
    found = leaks.find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
    return keyed.join(found.select("_row").distinct(), "_row", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources drawn to their target words; a document drawn twice has two rows.

    Null, empty and blank texts have no words and are not drawn.  Rows without a
    source are a source.  Repeated rows are drawn each for itself.
    """
    return mixing.drawn(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes, with the place of each row.

    A null text weighs one byte, as an empty one.  Repeated rows are in one shard.
    """
    return shards.shard(docs.select(*COLUMNS))


STAGES = [
    ("quality", good_quality), ("near duplicates", without_near_duplicates), ("decontamination", without_benchmark),
    ("mixing", mixed), ("sharding", sharded),
]

#: The first stages (a trained model, latent retrieval) cannot be written in SQL; tests compare the rest with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage read and wrote aside is deleted once its rows are stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{work_folder(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
