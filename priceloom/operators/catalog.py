"""Catalog of price books: search and ordering."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import catalog_key


def search_catalog(catalog: DataFrame, query: str = "", limit: int = 5) -> DataFrame:
    """Active books by relevance, recency (used, else created), use count and name."""
    c = F.col
    df = catalog.filter("status = 'active'").withColumn("recency", F.coalesce("last_used_at", "created_at"))
    order = [F.desc("recency"), F.desc("use_count"), F.asc("display_name")]
    wanted = catalog_key(F.lit(query))
    df = df.withColumns({"_q": wanted, "_name": catalog_key(c("display_name")), "_note": catalog_key(c("note")),
                         "_tags": F.array_join(F.transform("tags", catalog_key), " "), "_id": F.lower("key")})
    relevance = (
        F.when(c("_q") == "", 0).when(c("_name").startswith(c("_q")), 100).when(c("_name").contains(c("_q")), 60)
        .when(c("_id").contains(c("_q")), 40).when(c("_tags").contains(c("_q")), 25).when(c("_note").contains(c("_q")), 15).otherwise(0)
    )
    df = df.withColumn("relevance", relevance).filter((c("_q") == "") | (c("relevance") > 0))
    return df.drop("_q", "_name", "_note", "_tags", "_id").orderBy(F.desc("relevance"), *order).limit(limit)


def name_clashes(catalog: DataFrame) -> DataFrame:
    """Catalog keys shared by several books."""
    return catalog.groupBy(catalog_key(F.col("display_name")).alias("name_key")).agg(
        F.count(F.lit(1)).alias("books")).filter("books > 1")
