"""Delimited price books and inquiries as long cell tables."""
from __future__ import annotations

import csv
import io
import re
from pathlib import PurePosixPath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, settings

CELLS = "file string, sheet string, row int, col int, value string"
#: A record longer than this (in bytes) is an error: mostly a quote that is never closed.
RECORD_BYTES = 16 << 20
#: Records numbered in one window.
RECORD_BUCKET = 1 << 16
_LINES = "path string, block long, line long, value binary, valid boolean, " + ", ".join(
    f"{way}_record long, {way}_starts boolean, {way}_open boolean" for way in ("outside", "inside"))
_RECORDS = "path string, record long, file string, sheet string, cells array<struct<col:int,value:string>>"


def _ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open after ``line``, if one was (``inside``) or was not before it.

    Quotes count at the start of a field only, as in the csv module.  Comma, quote and line feed are never part of a longer
    character in UTF-8 or GBK, so this needs no encoding.
    """
    at = 0
    while True:
        if not inside:
            if line[at:at + 1] != b'"':
                at = line.find(b",", at) + 1
                if at == 0:
                    return False
                continue
            at += 1
        at = line.find(b'"', at)
        while at >= 0 and line[at + 1:at + 2] == b'"':
            at = line.find(b'"', at + 2)
        if at < 0:
            return True
        inside = False
        at = line.find(b",", at + 1) + 1
        if at == 0:
            return False


def _numbered(batches):
    """Lines of each byte range in order, with the records they belong to if the range starts outside or inside a quoted field."""
    place, line = None, 0
    for batch in batches:
        out = []
        for path, block, value, valid in zip(batch["path"], batch["block"], batch["value"], batch["valid"]):
            if (path, block) != place:
                place, line, records, opened = (path, block), 0, [0, 0], [False, True]
            line += 1
            row = [path, block, line, value, valid]
            quoted = b'"' in value
            for way in (0, 1):
                starts = not opened[way]
                records[way] += starts
                if quoted:
                    opened[way] = _ends_inside(value, opened[way])
                row += [records[way], starts, opened[way]]
            out.append(row)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _LINES.split(", ")])


def _parse(text: str) -> list[str]:
    try:
        return next(csv.reader(io.StringIO(text, newline="\n")), [])
    except csv.Error:  # a carriage return within a line
        return next(csv.reader(io.StringIO(re.sub(r"\r(?!\n|$)", " ", text), newline="\n")), [])


def _cells(batches):
    csv.field_size_limit(2 * RECORD_BYTES)
    for batch in batches:
        out = []
        for path, record, value, utf in zip(batch["path"], batch["record"], batch["value"], batch["utf"]):
            try:
                text = bytes(value).decode("utf-8" if utf else "gbk")
            except UnicodeDecodeError:
                raise ValueError(f"unknown text encoding: {path}") from None
            cells = [(j, v) for j, v in enumerate(_parse(text.removeprefix("﻿") if record == 1 else text), start=1) if v.strip()]
            if cells:
                name = PurePosixPath(unquote(path))
                out.append((path, record, name.name, name.stem or "CSV", [{"col": j, "value": v} for j, v in cells]))
        yield pd.DataFrame(out, columns=["path", "record", "file", "sheet", "cells"])


def _entries(lines: DataFrame) -> DataFrame:
    """Per byte range: whether it starts inside a quoted field, the records begun before it, whether its file is UTF-8.

    What a range does to the state is one of four functions: it sets it (two), keeps it or flips it.  So the state is the last
    one set, flipped as often as ranges after that say.
    """
    c = F.col
    last = F.struct(*[f"{way}_{x}" for way in ("outside", "inside") for x in ("record", "open")])
    ranges = lines.groupBy("path", "block").agg(F.max_by(last, "line").alias("_l"), F.bool_and("valid").alias("_valid")).select(
        "path", "block", "_valid", "_l.*")
    order = Window.partitionBy("path").orderBy("block")
    through = order.rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("_flips", F.sum((c("outside_open") & ~c("inside_open")).cast("int")).over(through))
    fixed = F.when(c("outside_open") == c("inside_open"), c("outside_open").cast("int") + c("_flips"))
    ranges = ranges.withColumn("_after", (F.coalesce(F.last(fixed, ignorenulls=True).over(through), F.lit(0)) + c("_flips")) % 2 == 1)
    ranges = ranges.withColumn("entered", F.lag("_after", 1, False).over(order))
    begun = F.sum(F.when(c("entered"), c("inside_record")).otherwise(c("outside_record")))
    return ranges.select("path", "block", "entered", F.coalesce(begun.over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                         F.bool_and("_valid").over(Window.partitionBy("path")).alias("utf"))


def read_cells(spark: SparkSession, paths, range_bytes: int | None = None) -> DataFrame:
    """Non-empty cells of delimited files: file, sheet (the file's stem), row (counted over records that are not blank), col, value.

    Files are cut into byte ranges like any text, so one large file is read by many tasks.  Each range numbers its records for
    both cases, starting outside or inside a quoted field; a scan over the ranges (one short row each) then tells which case holds.
    Records of several lines are put together by their number.  A file is UTF-8 (a byte order mark goes) if all of it is valid,
    else GBK; neither is an error, and so is a record beyond ``RECORD_BYTES``.  A carriage return within an unquoted field
    reads as a space.  Files without lines give no rows.  ``range_bytes``: at most so much in a range, else as the session says.
    """
    c = F.col
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        c("_metadata.file_path").alias("path"), c("_metadata.file_block_start").alias("block"), c("value").cast("binary").alias("value"),
        F.is_valid_utf8("value").alias("valid"))
    with settings(spark, {"spark.sql.files.maxPartitionBytes": str(range_bytes)} if range_bytes else {}):
        lines = materialize(raw.mapInPandas(_numbered, _LINES), "lines")
    way = {x: F.when(c("entered"), c(f"inside_{x}")).otherwise(c(f"outside_{x}")) for x in ("record", "starts", "open")}
    placed = lines.join(materialize(_entries(lines), "ranges"), ["path", "block"]).select(
        "path", "utf", "block", "line", "value", (c("before") + way["record"]).alias("record"), (way["starts"] & ~way["open"]).alias("_whole"))
    parts = placed.filter("NOT _whole")
    long = parts.groupBy("path", "record").agg(F.sum(F.length("value") + 1).alias("size")).filter(c("size") > RECORD_BYTES).first()
    if long:
        raise ValueError(f"record {long.record} of {unquote(long.path)} has {long.size} bytes: is a quote left open?")
    joined = parts.groupBy("path", "utf", "record").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("_p")).select(
        "path", "record", F.aggregate(F.slice("_p", 2, RECORD_BYTES), F.get("_p", F.lit(0))["value"], lambda s, x: F.concat(
            s, F.lit("\n").cast("binary"), x["value"])).alias("value"), "utf")
    records = materialize(placed.filter("_whole").select("path", "record", "value", "utf").unionByName(joined).mapInPandas(_cells, _RECORDS), "records")
    bucketed = records.withColumn("_bucket", F.floor(c("record") / RECORD_BUCKET))
    earlier = Window.partitionBy("path").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    above = bucketed.groupBy("path", "_bucket").count().select("path", "_bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_above"))
    place = F.row_number().over(Window.partitionBy("path", "_bucket").orderBy("record"))
    return bucketed.withColumn("_place", place).join(above, ["path", "_bucket"]).select(
        "file", "sheet", (c("_above") + c("_place")).cast("int").alias("row"), F.inline("cells"))


def rows_of(cells: DataFrame) -> DataFrame:
    """One row per sheet row: cells sorted by column, and as a map for look-ups."""
    pairs = F.array_sort(F.collect_list(F.struct("col", "value")))
    return cells.groupBy("file", "sheet", "row").agg(pairs.alias("cells")).withColumn(
        "at", F.map_from_entries("cells"))
