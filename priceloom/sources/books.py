"""Price books: seeds, consolidation, profiles, bindings."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import dedup_key
from ..functions.text import normalize_text
from ..operators.scoring import SCORING_QUALITY, data_quality

# Seed field names.
SEED_FIELDS = {
    "id": "id", "sourceFile": "source_file", "sourceSheet": "source_sheet", "sourceRow": "source_row", "name": "name",
    "spec": "spec", "productCode": "product_code", "model": "model", "brand": "brand", "manufacturer": "manufacturer",
    "unit": "unit", "quantity": "quantity", "price": "price", "quoteDate": "quote_date", "sourcePriority": "source_priority",
}


def load_seed(spark: SparkSession, path: str, records: str | None = None) -> DataFrame:
    """Seed records from JSON lines, or from the array field ``records`` of one document."""
    kinds = {"sourceRow": "int", "sourcePriority": "int", "quantity": "double", "price": "double"}
    schema = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in SEED_FIELDS)
    if records:
        raw = spark.read.schema(f"{records} array<struct<{schema.replace(' string', ': string').replace(' int', ': int').replace(' double', ': double')}>>")
        df = raw.option("multiLine", True).json(path).select(F.inline(records))
    else:
        df = spark.read.schema(schema).json(path)
    df = df.select(*[F.col(a).alias(b) for a, b in SEED_FIELDS.items()])
    text = [b for a, b in SEED_FIELDS.items() if a not in kinds]
    df = df.withColumns({**{f: F.coalesce(f, F.lit("")) for f in text}, "price": F.coalesce("price", F.lit(0.0))})
    return first_by_key(df, ["source_file", "source_sheet", "source_row", "id"]).withColumn(
        "data_quality", data_quality(SCORING_QUALITY))


def first_by_key(df: DataFrame, order: list[str]) -> DataFrame:
    """First record per dedup key in the given order (a combinable aggregate, no window)."""
    value = F.struct(*[F.col(x) for x in df.columns])
    first = df.withColumn("_key", dedup_key()).groupBy("_key").agg(F.min_by(value, F.struct(*order)).alias("_r"))
    return first.select("_r.*")


def consolidate_sources(sources: list[tuple[DataFrame, int, dict]]) -> DataFrame:
    """Stack layouts: (frame, priority, {field: [columns, first non-empty wins]}).

    Rows without a name or a positive price are dropped.
    """
    frames = []
    for df, priority, fields in sources:
        cols = []
        for field, names in fields.items():
            if field in ("price", "quantity", "source_row"):
                cols.append(F.coalesce(*[F.col(n) for n in names]).alias(field))
            else:
                cols.append(F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit("")).alias(field))
        frames.append(df.select(*cols, F.lit(priority).alias("source_priority")).filter("name != '' AND price > 0"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def source_profile(history: DataFrame) -> DataFrame:
    """Records and distinct name keys per source file and sheet."""
    return history.withColumn("k", normalize_text(F.col("name"))).groupBy("source_file", "source_sheet").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("k").alias("unique_names"))


def bind_books(jobs: DataFrame, history: DataFrame, default: str) -> DataFrame:
    """Records of the book each job names (else the default), counted per job and source.

    With books partitioned by ``database_key`` the join prunes to the books in use.
    """
    books = history.select("database_key").distinct()
    bound = jobs.withColumn("_want", F.trim(F.coalesce("database_key", F.lit("")))).drop("database_key")
    bound = bound.join(books.withColumnRenamed("database_key", "_have"), F.col("_want") == F.col("_have"), "left")
    return bound.withColumn("database_key", F.coalesce("_have", F.lit(default))).drop("_want", "_have")


def load_bound(bound: DataFrame, history: DataFrame) -> DataFrame:
    """History rows of the books that at least one bound job uses."""
    return history.join(bound.select("database_key").distinct(), "database_key", "left_semi")


def catalog_stats(history: DataFrame, jobs: DataFrame) -> DataFrame:
    """Records and jobs per price book."""
    a = history.groupBy("database_key").agg(F.count(F.lit(1)).alias("records"))
    b = jobs.groupBy("database_key").agg(F.count(F.lit(1)).alias("jobs"))
    zero = F.lit(0).cast("long")
    return a.join(b, "database_key", "full").select(
        "database_key", F.coalesce("records", zero).alias("records"), F.coalesce("jobs", zero).alias("jobs"))


def last_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
