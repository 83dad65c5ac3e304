"""Export tables: inquiry-aligned, detail, review list, price book."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_set, standard_code
from ..operators.pricing import tax_totals
from ..session import materialize

DETAIL_FIELDS = ["manufacturer", "brand", "model", "product_code", "spec", "unit"]
SLOT_FIELDS = ["price", "manufacturer", "brand", "model", "product_code", "spec"]
BOOK_FIELDS = ["name", "spec", "model", "brand", "manufacturer", "unit", "product_code", "price", "quantity", "quote_date"]


def resolve_option_fields(options: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Option text fields: stored snapshot, else the linked record, else the manual entry."""
    fields = DETAIL_FIELDS
    df = options
    if history is not None:
        linked = history.select(F.col("id").alias("history_id"), F.lit(True).alias("_linked"), *[F.col(f).alias(f"_h_{f}") for f in fields])
        df = df.join(linked, "history_id", "left").withColumn("_linked", F.coalesce("_linked", F.lit(False)))
    else:
        df = df.withColumn("_linked", F.lit(False))

    def pick(f: str) -> Column:
        snapshot = F.nullif(F.col(f"record_{f}"), F.lit("")) if f"record_{f}" in df.columns else F.lit(None)
        manual = F.col(f"manual_{f}") if f"manual_{f}" in df.columns else F.lit(None)
        record = F.when(F.col("_linked"), F.coalesce(F.col(f"_h_{f}"), F.lit(""))) if history is not None else F.lit(None)
        return F.coalesce(snapshot, record, manual, F.lit(""))

    out = df.withColumns({f: pick(f) for f in fields})
    return out.drop("_linked", *[f"_h_{f}" for f in fields])


def source_location(df: DataFrame, file="source_file", sheet="source_sheet", row="source_row", out="location") -> DataFrame:
    """file · sheet · row as a readable place."""
    c = F.col
    place = F.concat_ws(
        " · ", first_set(F.trim(F.coalesce(file, F.lit(""))), F.lit("（无来源）")), F.nullif(c(sheet), F.lit("")),
        F.when(F.coalesce(row, F.lit(0)) != 0, F.concat(F.lit("第"), c(row).cast("string"), F.lit("行"))))
    return df.withColumn(out, place)


def export_detail(lines: DataFrame, options: DataFrame, variant: str = "customer", rate: float | None = None) -> DataFrame:
    """One row per selected option with tax and totals."""
    c = F.col
    about = lines.select("line_id", "sheet_name", c("source_row").alias("line_row"), c("name").alias("line_name"), "quantity", "pricing_quantity")
    df = tax_totals(options.filter("selected").join(about, "line_id"), rate)
    df = df.withColumn("manufacturer", first_set(c("manufacturer"), F.lit("未记录制造商")))
    columns = ["sheet_name", c("line_row").alias("source_row"), "line_name", "rank", *DETAIL_FIELDS, "billing_quantity",
               "final_price", "tax_unit", "total", "tax_total"]
    if variant == "internal":
        place = F.when(c("record_source_file") != "", F.concat(
            "record_source_file", F.lit("｜"), "record_source_sheet", F.lit("｜第"), c("record_source_row").cast("string"), F.lit("行"))
        ).otherwise(F.lit("手工方案"))
        columns += ["score", F.array_join("warnings", "；").alias("risk"), place.alias("source")]
    return df.select(*columns)


def export_wide(lines: DataFrame, options: DataFrame, requested: int, variant: str = "customer",
                rate: float | None = None, history: DataFrame | None = None) -> DataFrame:
    """One row per line: the first option's prices, then a column group per further option.

    Options come with their fields, or as stored together with the ``history`` that fills them: then only shown options
    are looked up there.  The column groups go up to the largest number of options any exported line has, at
    most ``requested``; that single number is the only thing fetched to the driver.
    """
    c = F.col
    visible = F.lit(True) if variant == "internal" else c("confirmed")
    w = Window.partitionBy("line_id").orderBy("rank")
    chosen = options.filter("selected").join(lines.filter(visible).select("line_id"), "line_id", "left_semi")
    chosen = chosen.withColumn("slot", F.row_number().over(w)).filter(c("slot") <= max(1, requested))
    if history is not None:
        chosen = resolve_option_fields(chosen, history)
    code = standard_code(first_set(c("product_code"), c("model")))
    chosen = chosen.withColumns({"price": c("final_price"), "model": code, "product_code": standard_code(c("product_code"))})
    # Written once: the number of slots and the slots come from the same rows.
    chosen = materialize(chosen.select("line_id", "slot", *SLOT_FIELDS), "slots")
    most = chosen.agg(F.max("slot")).first()[0] or 1
    slots = chosen.groupBy("line_id").pivot("slot", list(range(1, most + 1))).agg(
        F.first(F.struct(*SLOT_FIELDS)))
    df = lines.join(slots, "line_id", "left").withColumn("final_price", c("`1`.price"))
    df = tax_totals(df.withColumn("_unit", c("unit")), rate)
    columns = ["line_id", "sheet_name", "source_row", "name", "billing_quantity", c("final_price").alias("option1_price"),
               "tax_unit", "total", "tax_total", *[F.coalesce(c(f"`1`.{f}"), F.lit("")).alias(f"option1_{f}") for f in SLOT_FIELDS[1:]]]
    for i in range(2, most + 1):
        columns += [c(f"`{i}`.{f}").alias(f"option{i}_{f}") for f in SLOT_FIELDS]
    if variant == "internal":
        columns += ["status", "recommended_score", F.array_join(lines["warnings"], "；").alias("risk")]
    return df.select(*columns)


def export_review(lines: DataFrame, options: DataFrame) -> DataFrame:
    """Unconfirmed lines with the price of their first selected estimate."""
    c = F.col
    estimates = options.filter(c("selected") & F.exists("warnings", lambda w: w.contains("估算价")))
    first = estimates.groupBy("line_id").agg(F.min_by("final_price", "rank").alias("estimate"))
    qty = F.coalesce(F.nullif(c("pricing_quantity"), F.lit(0.0)), c("quantity"))
    return lines.filter(~c("confirmed")).join(first, "line_id", "left").select(
        "line_id", "sheet_name", "source_row", "name", "spec", "unit", qty.alias("billing_quantity"), "estimate",
        F.array_join("warnings", "；").alias("risk"))


def export_book(history: DataFrame, edits: DataFrame) -> DataFrame:
    """Editable columns plus source, with pending edits laid over and removals left out.

    ``edits``: op (update, delete, create), id and the edited fields (NULL keeps the stored value).
    """
    c = F.col
    removed = edits.filter("op = 'delete'").select("id")
    changed = edits.filter("op = 'update'").select("id", *[c(f).alias(f"_e_{f}") for f in BOOK_FIELDS])
    df = history.join(removed, "id", "left_anti").join(changed, "id", "left")
    df = source_location(df, out="source")
    kept = df.select("id", *[F.coalesce(c(f"_e_{f}"), c(f)).alias(f) for f in BOOK_FIELDS], "source")
    new = edits.filter("op = 'create'").select("id", *BOOK_FIELDS, F.lit("表格编辑（未保存）").alias("source"))
    return kept.unionByName(new)
