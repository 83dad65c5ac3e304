"""Structured Streaming forms of the batch jobs."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import dedup_key
from ..operators.changes import apply_changes
from ..operators.governance import derive, import_history
from ..plans.quote import quote
from ..sources.cells import read_cells
from ..sources.sheets import extract_history


class VersionedTable:
    """A table kept as one folder per version; the newest complete one is current.

    Every micro-batch writes ``v=<batch>`` under a fixed name, so a replayed batch
    rewrites its own version and the outcome does not change.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        done = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version (below ``before``); a table without one is an error that names its folder."""
        usable = [v for v in self._versions() if before is None or v < before]
        if not usable:
            raise ValueError(f"no complete version under {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={usable[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")


def stream_ingest(spark: SparkSession, path: str, book: VersionedTable, checkpoint: str, tax_rate: float = 0.10) -> StreamingQuery:
    """Price-book files join the book once per dedup key (version 0 is the starting book)."""
    files = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary").load(path)

    def merge(batch: DataFrame, number: int) -> None:
        # Names only; a file's text is read in byte ranges. Characters of path patterns stand for themselves.
        names = [re.sub(r"([*?{}\[\]\\])", r"\\\1", r.path) for r in batch.select("path").collect()]
        if not names:
            return
        rows = extract_history(read_cells(spark, names), tax_rate)
        suffix = F.when(F.coalesce("vendor_group", F.lit("")) != "", F.concat(F.lit("#"), "vendor_group")).otherwise("")
        rows = rows.withColumn("id", F.concat("file", F.lit(":"), "sheet_name", F.lit(":"), F.col("source_row").cast("string"), suffix))
        rows = rows.withColumns({"source_file": F.col("file"), "source_sheet": F.col("sheet_name"), "rowid": F.col("id"),
                                 "seq": F.struct("file", "sheet_name", "source_row", F.coalesce("vendor_group", F.lit("")))})
        merged, _ = import_history(book.read(before=number + 1), rows)
        book.write(merged, number + 1)

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_quotes(inquiries: DataFrame, history: DataFrame, lex, cfg, out: str, checkpoint: str) -> StreamingQuery:
    """Quote arriving inquiry lines against a fixed book, one folder per batch."""

    def run(batch: DataFrame, number: int) -> None:
        lines, options = quote(batch, history, lex, cfg)
        lines.write.mode("overwrite").parquet(f"{out}/lines/batch={number}")
        options.drop("component_scores").write.mode("overwrite").parquet(f"{out}/options/batch={number}")

    return inquiries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settle_drafts(drafts: DataFrame, book: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Review outcome of confirmed prices: (drafts with ``outcome``, promoted rows).

    ``drafts``: draft_id, line_id, confirmed_price, status and the product fields, in
    draft_id order.  A pending or approved draft holds its (line, price); a rejected one
    releases it.  Approved drafts enter the book once per dedup key with priority 2.
    """
    c = F.col
    live = drafts.filter(c("status") != "rejected").groupBy("line_id", "confirmed_price").agg(F.min("draft_id").alias("_first"))
    df = drafts.withColumn("price", c("confirmed_price")).withColumn("_key", dedup_key()).join(live, ["line_id", "confirmed_price"], "left")
    holds = (c("status") != "rejected") & (c("draft_id") == c("_first"))
    df = df.withColumn("_approved", holds & (c("status") == "approved"))
    known = book.select(dedup_key().alias("_key")).distinct().withColumn("_known", F.lit(True))
    firsts = df.filter("_approved").groupBy("_key").agg(F.min("draft_id").alias("_lead"))
    df = df.join(known, "_key", "left").join(firsts, "_key", "left")
    outcome = (
        F.when(c("status") == "rejected", "rejected").when(~holds, "repeated").when(c("status") == "pending", "pending")
        .when(c("_known") | (c("_lead") != c("draft_id")), "already_in_book").otherwise("promoted")
    )
    df = df.withColumn("outcome", outcome).drop("_key", "_first", "_approved", "_known", "_lead")
    promoted = df.filter("outcome = 'promoted'").withColumns({
        "id": F.concat(F.lit("draft:"), c("draft_id").cast("string")), "source_priority": F.lit(2)})
    return df.drop("price"), promoted.drop("outcome", "status", "confirmed_price")


def stream_drafts(confirmations: DataFrame, drafts: VersionedTable, book: DataFrame, checkpoint: str) -> StreamingQuery:
    """Queue confirmed prices; repeats of a live (line, price) are ignored.

    Each batch is settled together with all earlier drafts, because a rejection frees
    its key again.
    """

    def run(batch: DataFrame, number: int) -> None:
        every = drafts.read(before=number + 1).unionByName(batch, allowMissingColumns=True)
        newest = every.groupBy("draft_id").agg(F.max_by(F.struct(*[F.col(x) for x in every.columns]), "version").alias("r")).select("r.*")
        settled, _ = settle_drafts(newest.drop("outcome"), book)
        drafts.write(settled, number + 1)

    return confirmations.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_windows(events: DataFrame, width: str = "1 day", watermark: str = "2 hours") -> DataFrame:
    """Audit activity per action and time window; works on batch and streaming input."""
    df = events.withWatermark("ts", watermark) if events.isStreaming else events
    return df.groupBy(F.window("ts", width).alias("w"), "action").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), "action", "events")


def stream_changes(changes: DataFrame, book: VersionedTable, results: str, checkpoint: str, max_rows: int | None = None) -> StreamingQuery:
    """Apply change sets as they arrive, one book version per batch."""

    def run(batch: DataFrame, number: int) -> None:
        updated, outcome = apply_changes(book.read(before=number + 1), batch, max_rows)
        book.write(updated, number + 1)
        outcome.write.mode("overwrite").parquet(f"{results}/batch={number}")

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def starting_book(table: VersionedTable, history: DataFrame) -> None:
    table.write(derive(history), 0)
