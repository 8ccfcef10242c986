"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import hosts, languages, leaks, lines, mixing, negatives, ngrams, phrases, quality, search, shards, suffixes, wrappers
from postmill.llm.oracle import SQL  # noqa: F401

#: Rules of the URL filter, as its contract fixes them: (verdict, host and path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of the document with a page's number is the page's outcome: bad if toxic or of low quality."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() & F.col("quality").isNotNull(), 0)
    outcomes = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return hosts.filter_urls(_table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth document is a query against all."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return search.top_k(docs, queries)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col("shard_size").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_sets(_table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no classifier learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    return quality.train(docs, _table(spark, sf_dir, "labels").where(~held_out()))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality_model(spark, docs, sf_dir)).withColumnRenamed("quality_score", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.drop_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def language_model(docs: DataFrame) -> languages.Model:
    return languages.train(docs.where(~held_out()))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = languages.identify(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector is an anchor; every seventh counts with the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_mixing, op3_url_filter, op4_ngram_join, op5_html_text, op6_quality, op7_topk_search, op8_sharding, op9_decontamination, op10_suffix_dedup, op11_language_id, op12_hard_negatives, op13_phrases)}
