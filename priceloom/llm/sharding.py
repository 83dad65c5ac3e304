"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; row r of a source of n
rows has the fractional rank (2r + 1) / 2n.  In the order of fractional ranks every stretch
has the mixture of the whole, so cutting that order into equal counts gives shards with
the same mixture, whose counts differ by one at most.

No source is ordered in one task: the hash range of a source is cut into buckets of about
``bucket_rows`` rows, and a row's rank is the size of the buckets before its own plus its
place in it.  The position among all sources needs no second sort: how many rows of
another source of m rows come before (2r + 1) / 2n is arithmetic.

Defined cases: NULL is a source of its own; equal fractional ranks go by source in code
point order, NULL last; rows that repeat each get their own slot; NULL text has no bytes
(size 8) and no checksum; an empty table gives an empty result.  Columns of the input whose
names clash with result columns are replaced.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS = 24
BUCKET_ROWS = 1024
#: Bytes of a row besides its text.
ROW_BYTES = 8


def interleave(rows: DataFrame, shards: int = SHARDS, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows (doc_id, source and any others) with ``shard`` (int) and ``slot`` (long, gapless from 0)."""
    c = F.col
    rows = rows.drop("shard", "slot")
    shuffled = F.xxhash64(F.lit(seed), c("doc_id"))
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    # One row with all sources in order: its size is the number of sources.
    order = sources.agg(F.array_sort(F.collect_list(F.struct(
        c("source").isNull().alias("last"), c("source").alias("name"), c("_n").alias("n")))).alias("_all"))
    place = F.expr("int(filter(transform(_all, (s, i) -> struct(s.name <=> source AS own, i AS i)), s -> s.own)[0].i)")
    rows = rows.withColumn("_all", order.scalar()).withColumn("_s", place).withColumns({
        "_n": F.expr("_all[_s].n"), "_all": F.transform("_all", lambda s: s["n"]), "_hash": shuffled})
    # Bucket by the upper bits of the hash, so that buckets follow the shuffled order.
    unit = F.shiftrightunsigned("_hash", 33).cast("long")
    rows = rows.withColumn("_bucket", F.floor(unit * F.ceil(c("_n") / bucket_rows) / F.lit(float(1 << 31))).cast("long"))
    counts = rows.groupBy("_s", "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_s", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_s", "_bucket").orderBy("_hash", "doc_id")
    ranked = rows.join(starts, ["_s", "_bucket"]).withColumn("_r", c("_start") + F.row_number().over(inside) - 1)
    # Rows of source t before (2r+1)/2n: q with (2q+1) n < (2r+1) m, or = m where t comes first.
    number = "decimal(18,0)"
    ranked = ranked.withColumns({"_odd": (2 * c("_r") + 1).cast(number), "_own": c("_n").cast(number)})
    position = F.expr("""aggregate(transform(_all, (m, t) -> CASE
        WHEN t = _s THEN _r
        WHEN _odd * cast(m AS decimal(18,0)) < _own THEN 0L
        WHEN t < _s THEN (_odd * cast(m AS decimal(18,0)) - _own) div (2 * _own) + 1
        ELSE (_odd * cast(m AS decimal(18,0)) - _own + 2 * _own - 1) div (2 * _own) END), 0L, (a, x) -> a + x)""")
    total = F.expr("aggregate(_all, 0L, (a, x) -> a + x)")
    ranked = ranked.withColumns({"_p": position, "_total": total})
    ranked = ranked.withColumn("shard", F.expr(f"(_p * {shards}) div _total").cast("int"))
    slot = F.expr(f"_p - (shard * _total + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", slot.cast("long")).drop(
        "_all", "_s", "_n", "_hash", "_bucket", "_start", "_r", "_odd", "_own", "_p", "_total")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts differ by one at most."""
    from .common import table

    c = F.col
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).cast("long").alias("text_crc32"))
    return interleave(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
