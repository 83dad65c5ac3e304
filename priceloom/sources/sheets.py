"""Header detection and record extraction from cell tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    BOOK_SKIP_NAMES,
    HEADER_ALIASES,
    INQUIRY_SKIP_NAMES,
    PRICE_ALIASES,
    SECTION_MARKS,
    VENDOR_LABELS,
)
from ..functions.text import cell_name, cell_text, header_key, nfkc, number_value, standard_code
from ..session import materialize
from .cells import rows_of

#: Rows in which a header is looked for, the first included; a parameter of all that search.
SEARCH_ROWS = 41
#: Rows of a sheet that one window walks.
CHUNK_ROWS = 4096
# An isolated five-digit code; a code of a book; a plain number; a "total of N" remark.
LINE_CODE = r"(?<![\dA-Za-z])([0-8]\d{4})(?![0-9A-Za-z.:+])"
BOOK_CODE = r"^\d{5}$"
PLAIN_NUMBER = r"^\d[\d,，]*(?:\.\d+)?$"
TOTAL_REMARK = r"^共\s*\d+"
SHEET = ["file", "sheet"]


def _first(keys: Column, test) -> Column:
    return F.get(F.filter(keys, test), 0)["col"]


def _labelled(words):
    lowered = [w.lower() for w in words]
    return lambda x: x["key"].isin(lowered)


def header_columns(rows: DataFrame, aliases: dict | None = None, price: bool = False) -> DataFrame:
    """Rows that can serve as a header: adds ``cols`` (field -> column) and header ``keys``.

    Exact labels claim their columns first; fuzzy rules only take unclaimed ones.
    """
    names = dict(aliases or HEADER_ALIASES)
    if price:
        names["price"] = PRICE_ALIASES
    keys = F.transform("cells", lambda x: F.struct(x["col"].alias("col"), header_key(x["value"]).alias("key")))
    df = rows.withColumn("keys", keys)
    k = F.col("keys")
    df = df.withColumn("exact", F.struct(*[
        _first(k, _labelled(words)).alias(field)
        for field, words in names.items()
    ]))
    e = {field: F.col(f"exact.{field}") for field in names}
    df = df.withColumn("claimed", F.array_compact(F.array(*e.values())))

    def free(x: Column) -> Column:
        return (x["key"] != "") & ~F.array_contains("claimed", x["col"])

    fuzzy_name = _first(k, lambda x: free(x) & (x["key"].endswith("名称") | x["key"].contains("品目")))
    df = df.withColumn("name_col", F.coalesce(e["name"], fuzzy_name)).filter("name_col IS NOT NULL")
    label = F.get(F.filter(k, lambda x: x["col"] == F.col("name_col")), 0)["key"]
    fuzzy_spec = _first(k, lambda x: free(x) & (x["key"].startswith("规格") | x["key"].contains("性能要求")))
    repeated = _first(k, lambda x: free(x) & (x["col"] > F.col("name_col")) & (x["key"] == label))
    df = df.withColumn("spec_col", F.coalesce(e["spec"], fuzzy_spec, repeated, e["model"]))
    cols = [F.col("name_col").alias("name"), F.col("spec_col").alias("spec")]
    cols += [e[f].alias(f) for f in names if f not in ("name", "spec", "price")]
    if price:
        fuzzy_price = _first(k, lambda x: free(x) & (x["col"] != F.coalesce("spec_col", F.lit(0))) & (
            x["key"].contains("单价") | x["key"].endswith("价格") | x["key"].contains("报价")))
        cols.append(F.coalesce(e["price"], fuzzy_price).alias("price"))
    return df.withColumn("cols", F.struct(*cols)).drop("name_col", "spec_col", "exact")


def detect_headers(cells: DataFrame, aliases: dict | None = None, price: bool = False, search_rows: int = SEARCH_ROWS) -> DataFrame:
    """First header row of every sheet, looked for in its first ``search_rows`` rows: file, sheet, header_row, cols."""
    found = header_columns(rows_of(cells.filter(F.col("row") <= search_rows)), aliases, price)
    return found.groupBy(*SHEET).agg(
        F.min("row").alias("header_row"), F.min_by("cols", "row").alias("cols"), F.min_by("keys", "row").alias("keys"),
        F.min_by("claimed", "row").alias("claimed"))


def _text(col: Column) -> Column:
    return cell_text(F.try_element_at("at", F.coalesce(col, F.lit(0))))


def salvage_code(*texts: Column, pattern: str = LINE_CODE) -> Column:
    """First isolated five-digit code, not ending in 000, over the given texts.  ``pattern``: what a code is (its first group)."""
    found = [
        F.get(F.filter(F.regexp_extract_all(nfkc(t), F.lit(pattern), 1), lambda x: ~x.endswith("000")), 0) for t in texts
    ]
    return F.coalesce(*found, F.lit(""))


def repair_codes(df: DataFrame, code: str = BOOK_CODE) -> DataFrame:
    """Codes without float suffix; misplaced codes (``code``: five digits) and long texts leave ``model``."""
    c = F.col
    df = df.withColumns({"_code": standard_code(c("product_code")), "_model": standard_code(c("model"))})
    is_code = c("_model").rlike(code)
    is_text = ~is_code & (F.length("_model") > 20) & (F.coalesce(c("spec"), F.lit("")) == "")
    return df.withColumns({
        "product_code": F.when(is_code & (c("_code") == ""), c("_model")).otherwise(c("_code")),
        "spec": F.when(is_text, c("_model")).otherwise(c("spec")),
        "model": F.when(is_code | is_text, F.lit("")).otherwise(
            F.when(c("_model") == F.trim(c("model")), c("model")).otherwise(c("_model"))),
    }).drop("_code", "_model")


def extract_inquiry(cells: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Inquiry lines below each sheet's header."""
    headers = detect_headers(cells) if headers is None else headers
    c = F.col
    df = rows_of(cells).join(headers.select(*SHEET, "header_row", "cols"), SHEET).filter(c("row") > c("header_row"))
    fields = ["product_code", "model", "brand", "manufacturer", "unit"]
    raw_quantity = F.try_element_at("at", F.coalesce(c("cols.quantity"), F.lit(0)))
    df = df.withColumns({
        "name": cell_name(F.try_element_at("at", c("cols.name"))), "spec": _text(c("cols.spec")),
        **{f: _text(c(f"cols.{f}")) for f in fields},
        "quantity": number_value(raw_quantity), "_q": cell_text(raw_quantity),
    })
    detail = F.concat("spec", "product_code", "model", "brand", "manufacturer") != ""
    df = df.filter(
        (c("name") != "") & ~c("name").isin(INQUIRY_SKIP_NAMES)
        & ~c("spec").rlike(TOTAL_REMARK) & ~c("spec").contains("配置清单如下")
        & (detail | (F.coalesce("quantity", F.lit(0.0)) != 0)))
    swapped = c("quantity").isNull() & c("unit").rlike(PLAIN_NUMBER) & (c("_q") != "") & ~c("_q").rlike(PLAIN_NUMBER)
    df = df.withColumn("_swap", F.coalesce(swapped, F.lit(False)))
    df = df.withColumns({
        "quantity": F.when(c("_swap"), number_value(c("unit"))).otherwise(c("quantity")),
        "unit": F.when(c("_swap"), c("_q")).otherwise(c("unit")),
        "product_code": F.when(c("product_code") != "", c("product_code")).otherwise(salvage_code(c("spec"), c("model"), c("brand"))),
    })
    return df.select("file", c("sheet").alias("sheet_name"), c("row").alias("source_row"), "name", "spec", "product_code",
                     "model", "brand", "manufacturer", "unit", "quantity", c("quantity").alias("pricing_quantity"))


def _vendor_cells(pattern: str, field: str) -> Column:
    mine = F.filter("keys", lambda x: x["key"].rlike(pattern) & ~F.array_contains("claimed", x["col"]))
    return F.transform(mine, lambda x: F.struct(
        F.regexp_extract(x["key"], pattern, 1).alias("suffix"), F.lit(field).alias("field"), x["col"].alias("col")))


def vendor_groups(headers: DataFrame) -> DataFrame:
    """Add ``groups``: numbered vendor column groups of a wide sheet (empty for plain sheets)."""
    c = F.col
    item = "array<struct<suffix:string,field:string,col:int>>"
    parts = []
    for field, labels in VENDOR_LABELS.items():
        pattern = f"^(?:{'|'.join(labels)})(\\d*)$"
        parts.append(_vendor_cells(pattern, field).cast(item))
    df = headers.withColumn("_found", F.concat(*parts))
    numbered = F.exists("_found", lambda x: x["suffix"] != "")
    base = F.array_compact(F.array(*[
        F.when(c(f"cols.{f}").isNotNull(), F.struct(F.lit("").alias("suffix"), F.lit(f).alias("field"), c(f"cols.{f}").alias("col")))
        for f in VENDOR_LABELS])).cast(item)
    df = df.withColumn("_found", F.when(numbered, F.concat("_found", base)).otherwise(F.array().cast(item)))
    order = F.array_sort(F.array_distinct(F.transform("_found", lambda x: F.struct(
        F.when(x["suffix"] == "", F.lit(-1)).otherwise(x["suffix"].try_cast("int")).alias("n"), x["suffix"].alias("suffix")))))

    def column(suffix: Column, field: str) -> Column:
        return F.array_max(F.transform(
            F.filter("_found", lambda x: (x["suffix"] == suffix) & (x["field"] == field)), lambda x: x["col"]))

    groups = F.transform(order, lambda g: F.struct(
        F.when(g["suffix"] == "", F.lit("0")).otherwise(g["suffix"]).alias("suffix"),
        *[column(g["suffix"], f).alias(f) for f in VENDOR_LABELS]))
    return df.withColumn("groups", groups).drop("_found")


def _switches(rows: DataFrame, heads: DataFrame, first: DataFrame, search_rows: int) -> DataFrame:
    """Rows from which a header holds: file, sheet, row, head (the header's row); the first header of a sheet and all sections.

    A section begins where the name column *of the header that holds there* has a section mark and a header with a price follows
    within ``search_rows``.  Which column that is depends on the sections before, so each possible section points to the next
    row that would end it, and the chain from the first header is followed by doubling these pointers.
    """
    c = F.col
    texts = F.transform("cells", lambda x: F.struct(x["col"].alias("col"), cell_text(x["value"]).alias("text")))
    at = F.transform(F.filter(texts, lambda x: x["text"].isin(SECTION_MARKS)), lambda x: x["col"])
    marked = rows.select(*SHEET, "row", at.alias("at")).filter(F.size("at") > 0)
    # The header that a search from a marked row finds: the next one, whether it has a price or not.
    named = heads.select(*SHEET, "row", F.lit(None).cast("array<int>").alias("at"), c("row").alias("head"))
    below = Window.partitionBy(*SHEET).orderBy(c("row").desc()).rangeBetween(-(search_rows - 1), 0)
    found = marked.withColumn("head", F.lit(None).cast("int")).unionByName(named).withColumn("head", F.min("head").over(below)).filter("at IS NOT NULL")
    known = heads.select(*SHEET, c("row").alias("head"), c("cols.name").alias("name_col"), c("cols.price").isNotNull().alias("priced"))
    events = found.join(known.filter("priced"), [*SHEET, "head"]).join(
        first.filter("has_price_column").select(*SHEET, "header_row"), SHEET).filter(c("row") > c("header_row"))
    start = first.select(*SHEET, c("header_row").alias("row"), c("header_row").alias("head"), c("cols.name").alias("name_col"))
    nodes = start.unionByName(events.select(*SHEET, "row", "head", "name_col"))
    ends = events.select(*SHEET, F.explode("at").alias("name_col"), "row", c("row").alias("end"))
    later = Window.partitionBy(*SHEET, "name_col").orderBy(c("row").desc()).rangeBetween(Window.unboundedPreceding, -1)
    pointed = nodes.withColumn("end", F.lit(None).cast("int")).unionByName(ends, allowMissingColumns=True).withColumn(
        "next", F.min("end").over(later)).filter("end IS NULL")
    nodes = materialize(pointed.select(*SHEET, "row", "head", "next"), "nodes")
    jump, reached = nodes.filter("next IS NOT NULL").select(*SHEET, "row", "next"), start.select(*SHEET, "row")
    while True:
        further = materialize(reached.join(jump, [*SHEET, "row"]).select(*SHEET, c("next").alias("row")), "reached")
        if further.isEmpty():
            break
        reached = reached.unionByName(further)
        over = jump.select(*SHEET, c("row").alias("next"), c("next").alias("_beyond"))
        jump = materialize(jump.join(over, [*SHEET, "next"]).select(*SHEET, "row", c("_beyond").alias("next")), "jumps")
    return nodes.join(reached, [*SHEET, "row"], "left_semi").select(*SHEET, "row", "head")


def _carried(rows: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``value`` of the last of ``marks`` above them in their sheet; rows without one go.

    Two levels: the last mark of each chunk of rows is carried from chunk to chunk, and within a chunk from row to row.
    """
    c = F.col
    chunk = F.floor(c("row") / CHUNK_ROWS).alias("_chunk")
    last = marks.groupBy(*SHEET, chunk).agg(F.max_by(value, "row").alias("_last"))
    chunks = rows.select(*SHEET, chunk).distinct().join(last, [*SHEET, "_chunk"], "full")
    earlier = Window.partitionBy(*SHEET).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    entry = chunks.withColumn("_entry", F.last("_last", ignorenulls=True).over(earlier)).filter("_entry IS NOT NULL OR _last IS NOT NULL").drop("_last")
    within = Window.partitionBy(*SHEET, "_chunk").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    df = rows.withColumn("_chunk", chunk).join(entry, [*SHEET, "_chunk"]).join(marks, [*SHEET, "row"], "left")
    return df.withColumn("active", F.coalesce(F.last(value, ignorenulls=True).over(within), c("_entry"))).filter("active IS NOT NULL").drop(
        "_chunk", "_entry", value)


def headerless_sheets(cells: DataFrame, price: bool = False, search_rows: int = SEARCH_ROWS) -> DataFrame:
    """Sheets of which no row is read: file, sheet, reason (``no_header`` in the first rows, or ``no_columns``: neither price nor spec nor unit)."""
    found = detect_headers(cells, price=price, search_rows=search_rows)
    lacking = F.lit(price) & F.col("cols.spec").isNull() & F.col("cols.unit").isNull()
    if price:
        lacking &= F.col("cols.price").isNull()
    reason = F.when(F.col("cols").isNull(), "no_header").when(lacking, "no_columns")
    return cells.select(*SHEET).distinct().join(found, SHEET, "left").select(*SHEET, reason.alias("reason")).filter("reason IS NOT NULL")


def extract_history(cells: DataFrame, tax_rate: float = 0.10, search_rows: int = SEARCH_ROWS) -> DataFrame:
    """Price-book records of every sheet, following repeated header sections and vendor groups.

    A row whose name cell (by the header that holds there) is a section mark is no record; if a header with a price follows, it
    holds from the next row on.  Sheets without a header give nothing; ``headerless_sheets`` names them.
    """
    c = F.col
    # Written once: headers, section marks, chunks and records are all read from the same rows.
    rows = materialize(rows_of(cells).drop("at"), "sheet_rows").withColumn("at", F.map_from_entries("cells"))
    heads = materialize(vendor_groups(header_columns(rows, price=True)).select(*SHEET, "row", "cols", "groups", "keys"), "heads")
    first = heads.filter(c("row") <= search_rows).groupBy(*SHEET).agg(
        F.min("row").alias("header_row"), F.min_by("cols", "row").alias("cols")).withColumn("has_price_column", c("cols.price").isNotNull())
    first = first.filter(c("has_price_column") | c("cols.spec").isNotNull() | c("cols.unit").isNotNull())
    label = F.get(F.filter("keys", lambda x: x["col"] == c("cols.price")), 0)["key"]
    section = F.struct("cols", "groups", F.coalesce(label.contains("含税") & ~label.contains("不含"), F.lit(False)).alias("inclusive"), "has_price_column")
    switches = _switches(rows, heads, first, search_rows)
    described = heads.join(first.select(*SHEET, "has_price_column"), SHEET).select(*SHEET, c("row").alias("head"), section.alias("_section"))
    sections = materialize(switches.join(described, [*SHEET, "head"]).select(*SHEET, "row", "_section"), "sections")
    df = _carried(rows, sections, "_section").withColumn("has_price_column", c("active.has_price_column"))
    df = df.withColumn("cols", c("active.cols"))
    df = df.withColumns({
        "_raw": cell_text(F.try_element_at("at", c("cols.name"))), "name": cell_name(F.try_element_at("at", c("cols.name"))),
    }).filter(~c("_raw").isin(SECTION_MARKS) & (c("name") != "") & ~c("name").isin(BOOK_SKIP_NAMES))
    price = F.when(c("has_price_column"), number_value(F.try_element_at("at", F.coalesce(c("cols.price"), F.lit(0)))))
    df = df.withColumns({"price": price, **{f: _text(c(f"cols.{f}")) for f in ("spec", "product_code", "unit")}})
    df = df.withColumn("price", fold_tax(c("price"), c("active.inclusive"), tax_rate))
    plain = F.struct(F.lit(None).cast("string").alias("suffix"), c("cols.brand").alias("brand"),
                     c("cols.manufacturer").alias("manufacturer"), c("cols.model").alias("model"))
    emitted = F.filter("active.groups", lambda g: F.concat(_text(g["brand"]), _text(g["manufacturer"]), _text(g["model"])) != "")
    df = df.withColumn("vendor", F.explode(F.when(F.size(emitted) > 0, emitted).otherwise(F.array(plain))))
    df = df.withColumns({f: _text(c(f"vendor.{f}")) for f in ("brand", "manufacturer", "model")})
    df = df.select("file", c("sheet").alias("sheet_name"), c("row").alias("source_row"), "name", "spec", "product_code", "unit",
                   "price", "has_price_column", "brand", "manufacturer", "model", c("vendor.suffix").alias("vendor_group"))
    return repair_codes(df)


def fold_tax(price: Column, inclusive: Column, rate: float = 0.10) -> Column:
    """Tax-inclusive list prices brought back to the base price."""
    return F.when(inclusive & (price != 0), F.round(price / (1 + rate), 2)).otherwise(price)


def unpivot_vendors(df: DataFrame, groups: int) -> DataFrame:
    """Wide brand1/manufacturer1/model1 … columns to one record per non-empty group."""
    fields = ["brand", "manufacturer", "model"]

    def part(f: str, i: int) -> Column:
        return F.coalesce(F.col(f"{f}{i}"), F.lit("")) if f"{f}{i}" in df.columns else F.lit("")

    items = F.array(*[
        F.struct(F.lit(str(i)).alias("vendor_group"), *[part(f, i).alias(f) for f in fields]) for i in range(1, groups + 1)])
    filled = F.filter(items, lambda g: F.concat(g["brand"], g["manufacturer"], g["model"]) != "")
    empty = F.array(F.struct(F.lit("").alias("vendor_group"), *[F.lit("").alias(f) for f in fields]))
    keep = [x for x in df.columns if not any(x == f"{f}{i}" for f in fields for i in range(1, groups + 1))]
    return df.withColumn("_g", F.explode(F.when(F.size(filled) > 0, filled).otherwise(empty))).select(*keep, "_g.*")


def provided_fields(headers: DataFrame) -> DataFrame:
    """Fields each sheet's header offers: file, sheet, provided."""
    fields = ["name", "spec", "model", "brand", "manufacturer", "unit", "product_code", "price"]
    have = F.array_compact(F.array(*[F.when(F.col(f"cols.{f}").isNotNull(), F.lit(f)) for f in fields]))
    return headers.select(*SHEET, have.alias("provided"))
