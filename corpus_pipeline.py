"""From raw documents to training shards: language, near copies, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage
returns and gives it to the next.  All stages but the last return the columns of documents.
"""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.llm import decontaminate, jaccard, langid, mixing, sharding
from priceloom.llm.common import SMALL_BATCHES, table
from priceloom.session import collect_garbage, materialize, settings


def written_in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose texts go through Python, written in batches of some MB: what a task holds of them does not follow from
    the settings under which its reader runs.
    """
    with settings(df.sparkSession, SMALL_BATCHES):
        return materialize(df, "small-batches")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language.  Those without letters go, and those less certain than nearly all learnable texts
    of the language they are taken for.
    """
    names, network = langid.train(langid.labelled(docs))
    seen = written_in_small_batches(langid.predict(docs, names, network))
    # All learnable texts, with the scores just written.
    learnable = langid.labelled(seen, F.xxhash64("text").alias("_hash"), "lang", "lang_pred", "score")
    least = langid.least_scores(learnable, names).withColumnRenamed("lang", "_lang")
    return seen.join(F.broadcast(least), F.col("lang_pred") == F.col("_lang")).filter("score >= least").select(*[seen[x] for x in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of n-gram Jaccard links: the one with the smallest id.

    Rows that share an id are one document, of which one row stays: the one with the smallest hash.  Rows without an id are
    one document where their texts are equal; they come after all ids.
    """
    c = F.col
    # Above all ids but the numbers of further sets.
    marked = docs.withColumn("_id", F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 3) + F.lit(1 << 62)))
    groups = materialize(jaccard.similarity_groups(marked.select(c("_id").alias("doc_id"), "text")), "groups")
    copies = materialize(groups.filter("doc_id != component_id").select(c("doc_id").alias("_id")).distinct(), "copies")
    repeats = groups.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select(c("doc_id").alias("_id"))
    repeats = materialize(repeats, "repeats")
    kept = marked.join(copies, "_id", "left_anti")
    row = F.struct(F.xxhash64(*docs.columns).alias("_hash"), *docs.columns)
    one = kept.join(repeats, "_id", "left_semi").groupBy("_id").agg(F.min(row).alias("_row")).select("_row.*")
    return kept.join(repeats, "_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents that are mostly such passages go."""
    return decontaminate.removed(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents of wanted sources come up to twice, of others in part."""
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    return sharding.interleave(docs)


def _light(stage):
    """The stage, begun without what the stages before it left in the driver."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _light(stage)) for name, stage in (
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate_texts),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
)]

#: The trained language model and the sampler cannot be said in SQL.  tests/llm compares near copies and cut texts with brute force,
#: the mixture with its targets, the shards with the mixed rows, and run() with the stages; language ID by planted and held-out texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
