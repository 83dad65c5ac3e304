"""Review of quoted lines: filters, actions, confirmation, decisions, counters."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_set, normalize_text

# Warning texts behind the line filters.
WARNING_FILTERS = {"unit_conflict": "单位不可直接换算", "parameter_conflict": "未满足客户要求",
                   "price_anomaly": "价格偏离", "score_tie": "同分多价"}
BOOK_SORTS = ["name", "spec", "model", "brand", "manufacturer", "unit", "product_code", "price", "quantity", "quote_date",
              "source_file", "source_row", "data_quality"]
DRAFT_TEXTS = ["spec", "model", "brand", "manufacturer", "unit"]


def contains_text(column: str, query: str) -> Column:
    """Case-insensitive literal search (no wildcard meaning)."""
    return F.lower(F.col(column)).contains(query.strip().lower())


def filter_lines(lines: DataFrame, row_filter: str = "all", query: str = "") -> DataFrame:
    c = F.col
    df = lines
    if row_filter == "confirmed":
        df = df.filter("confirmed")
    elif row_filter == "pending":
        df = df.filter(~c("confirmed"))
    elif row_filter in ("review", "unmatched", "suggested"):
        df = df.filter(c("status") == row_filter)
    elif row_filter in WARNING_FILTERS:
        df = df.filter(F.exists("warnings", lambda w: w.contains(WARNING_FILTERS[row_filter])))
    elif row_filter == "low_confidence":
        df = df.filter(c("confidence").isin("low", "unreliable", "review"))
    if query.strip():
        hit = c("source_row").cast("string") == query.strip()
        for f in ("name", "product_code", "model"):
            hit = hit | contains_text(f, query)
        df = df.filter(hit)
    return df


def list_lines(lines: DataFrame, page: int = 1, size: int = 50, sort: str = "source_row", **filters) -> DataFrame:
    """One page of filtered lines; a page past the end becomes the last page."""
    df = filter_lines(lines, **filters)
    total = df.count()
    page = min(max(page, 1), max(1, -(-total // size)))
    first = {"score_asc": [F.asc("recommended_score")], "score_desc": [F.desc("recommended_score")]}.get(sort, [])
    return df.orderBy(*first, "source_row", "line_id").offset((page - 1) * size).limit(size)


def search_history(history: DataFrame, query: str, limit: int = 30) -> DataFrame:
    hit = F.lit(False)
    for f in ("name", "spec", "model", "brand", "manufacturer"):
        hit = hit | contains_text(f, query)
    return history.filter(hit).orderBy(F.desc("source_priority"), "source_row", "rowid").limit(limit)


def list_rows(history: DataFrame, query: str = "", sort: str = "source", order: str = "asc", page: int = 1, size: int = 100) -> DataFrame:
    df = history
    if query.strip():
        hit = F.lit(False)
        for f in ("name", "spec", "model", "brand", "manufacturer", "product_code", "source_file"):
            hit = hit | contains_text(f, query)
        df = df.filter(hit)
    if sort in BOOK_SORTS:
        keys = [F.desc(sort) if order == "desc" else F.asc(sort), F.asc("id")]
    else:
        keys = [F.asc(x) for x in ("source_file", "source_sheet", "source_row", "id")]
    return df.orderBy(*keys).offset((page - 1) * size).limit(size)


def recent(df: DataFrame, time: str, limit: int, keep: Column | None = None, tie: str = "id") -> DataFrame:
    df = df.filter(keep) if keep is not None else df
    return df.orderBy(F.desc(time), tie).limit(limit)


def _blocks(column: str = "warnings") -> Column:
    return F.exists(column, lambda w: w.startswith("BLOCK:"))


def suggest_action(lines: DataFrame, options: DataFrame) -> DataFrame:
    """Next human step per line, first rule that fits."""
    c = F.col
    estimate = F.exists("warnings", lambda w: w.contains("估算价"))
    two = options.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(_blocks()).alias("blocking"), F.max("selected").alias("any_selected"),
        F.max(c("selected") & estimate).alias("estimated"),
        F.max(F.when(c("rank") == 1, c("score"))).alias("top"), F.max(F.when(c("rank") == 2, c("score"))).alias("second"))
    df = lines.join(two, "line_id", "left")
    strong = (c("confidence") == "high") & (c("recommended_score") >= 80) & c("second").isNull()
    clear = c("second").isNotNull() & (c("top") - c("second") >= 15)
    action = (
        F.when(c("confirmed"), "none").when(c("blocking"), "must_review").when(c("n").isNull(), "manual_quote")
        .when(~c("any_selected"), "pick_one").when(c("estimated"), "review_estimate").when(strong | clear, "auto_confirm_ok")
        .when(c("confidence").isin("low", "unreliable") | (c("recommended_score") < 55), "review_carefully").otherwise("confirm_or_pick")
    )
    return df.withColumn("action", action).drop("n", "blocking", "any_selected", "estimated", "top", "second")


def batch_confirm(lines: DataFrame, options: DataFrame) -> DataFrame:
    """Confirm high-confidence lines whose selected options carry no block."""
    c = F.col
    sel = options.filter("selected").groupBy("line_id").agg(F.max(_blocks()).alias("blocking"))
    df = lines.join(sel, "line_id", "left")
    ok = ~c("confirmed") & (c("confidence") == "high") & (c("recommended_score") >= 80) & (c("blocking") == F.lit(False))
    return df.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumns({
        "outcome": F.when(c("_ok"), "confirmed").otherwise("skipped"),
        "confirmed": c("confirmed") | c("_ok"), "status": F.when(c("_ok"), "confirmed").otherwise(c("status")),
    }).drop("_ok", "blocking")


def auto_confirm(lines: DataFrame, options: DataFrame) -> DataFrame:
    """Confirm lines with a safe default before export."""
    c = F.col
    risky = F.exists("warnings", lambda w: w.rlike("^(?:规格变体|规格量程|BLOCK:)"))
    estimate = F.exists("warnings", lambda w: w.contains("估算价"))
    sel = options.filter("selected").groupBy("line_id").agg(
        F.max(estimate).alias("estimated"), F.min_by(risky, "rank").alias("risky"), F.min_by("final_price", "rank").alias("p"))
    df = lines.join(sel, "line_id", "left")
    ok = F.coalesce(~c("confirmed") & ~c("estimated") & ~c("risky") & (c("p") != 0), F.lit(False))
    return df.withColumn("_ok", ok).withColumns({
        "confirmed": c("confirmed") | c("_ok"), "status": F.when(c("_ok"), "confirmed").otherwise(c("status")),
    }).drop("_ok", "estimated", "risky", "p")


def customer_policy(lines: DataFrame, options: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Margin approval of discounted VIP customers blocks their lines and options."""
    c = F.col
    need = customers.filter("customer_type = 'vip' AND discount_percent > 0 AND minimum_margin_percent > 0").select(
        "job_id", F.concat(F.lit("BLOCK: VIP折扣需核对最低毛利线（"),
                           F.regexp_replace(c("minimum_margin_percent").cast("string"), "\\.0$", ""), F.lit("%）")).alias("_note"))

    def mark(df: DataFrame) -> DataFrame:
        return df.join(need, "job_id", "left").withColumn(
            "warnings", F.when(c("_note").isNotNull(), F.concat("warnings", F.array("_note"))).otherwise(c("warnings")))

    marked = mark(lines).withColumn("status", F.when(c("_note").isNotNull() & (c("status") == "suggested"), "review").otherwise(c("status")))
    return marked.drop("_note"), mark(options).drop("_note")


def job_counters(lines: DataFrame) -> DataFrame:
    c = F.col
    one = lines.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if(c("status") == "suggested").alias("matched_lines"),
        F.count_if(c("status") == "review").alias("review_lines"), F.count_if(c("status") == "unmatched").alias("unmatched_lines"),
        F.count_if("confirmed").alias("confirmed_lines"))
    return one.withColumn("job_status", F.when(c("confirmed_lines") >= c("total_lines"), "confirmed").otherwise("review"))


def dashboard(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin("queued", "reserved", "matching", "review")).alias("active_jobs"),
                    F.sum(F.col("review_lines") + F.col("unmatched_lines")).alias("need_review"))


def coverage(lines: DataFrame, options: DataFrame) -> DataFrame:
    """Share of lines with neither an estimate nor no match."""
    est = options.filter(F.exists("warnings", lambda w: w.contains("估算价"))).select("line_id").distinct().withColumn("e", F.lit(True))
    c = F.col
    lost = F.count_if(F.coalesce("e", F.lit(False)) | (c("status") == "unmatched"))
    return lines.join(est, "line_id", "left").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("lines"), lost.alias("lost")).withColumn("coverage", (c("lines") - c("lost")) / c("lines"))


def option_identity() -> list[Column]:
    c = F.col
    vendor = normalize_text(first_set(c("manufacturer"), c("brand")))
    return [F.when(vendor == "", F.concat(F.lit("unknown:"), c("option_id").cast("string"))).otherwise(vendor).alias("k_vendor"),
            F.round(F.coalesce("override", "final_price"), 2).alias("k_price"),
            normalize_text(c("spec")).alias("k_spec"), normalize_text(c("model")).alias("k_model")]


def apply_review(lines: DataFrame, options: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, options, rejected) for ``decisions``: line_id, option_id, selected, price.

    A line's decision is rejected when it names an unknown option, a price that is not
    positive, or selects two fully identical options.
    """
    c = F.col
    d = decisions.select("line_id", "option_id", c("selected").alias("want"), c("price").alias("override"))
    known = options.select("line_id", "option_id", "manufacturer", "brand", "spec", "model", "final_price")
    seen = d.join(known.withColumn("_known", F.lit(True)), ["line_id", "option_id"], "left")
    simple = seen.groupBy("line_id").agg(
        F.max(c("_known").isNull()).alias("unknown"), F.max(F.coalesce(c("override") <= 0, F.lit(False))).alias("bad_price"))
    twins = seen.filter(c("want") & c("_known")).select("line_id", *option_identity()).groupBy(
        "line_id", "k_vendor", "k_price", "k_spec", "k_model").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("line_id").distinct()
    verdict = simple.join(twins.withColumn("twin", F.lit(True)), "line_id", "left").select("line_id", (
        F.when(c("unknown"), "unknown_option").when(c("twin"), "identical_options").when(c("bad_price"), "bad_price")).alias("reason"))
    rejected = verdict.filter("reason IS NOT NULL")
    accepted = verdict.filter("reason IS NULL").select("line_id").withColumn("_ok", F.lit(True))
    out = options.join(accepted, "line_id", "left").join(d, ["line_id", "option_id"], "left").withColumns({
        "selected": F.when(c("_ok"), F.coalesce("want", F.lit(False))).otherwise(c("selected")),
        "final_price": F.when(c("_ok"), F.coalesce(F.round("override", 2), c("final_price"))).otherwise(c("final_price")),
    }).drop("_ok", "want", "override")
    new_lines = lines.join(accepted, "line_id", "left").withColumns({
        "confirmed": c("confirmed") & c("_ok").isNull(), "status": F.when(c("_ok"), "review").otherwise(c("status"))}).drop("_ok")
    return new_lines, out, rejected


def add_manual_options(options: DataFrame, manual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(options, rejected): manual options follow the line's last rank, selected."""
    c = F.col
    named = (F.trim(F.coalesce("manual_manufacturer", F.lit(""))) != "") | (F.trim(F.coalesce("manual_brand", F.lit(""))) != "")
    ok = named | c("history_id").isNotNull()
    top = options.groupBy("line_id").agg(F.max("rank").alias("_top"))
    w = Window.partitionBy("line_id").orderBy("seq")
    new = manual.filter(ok).join(top, "line_id", "left").withColumns({
        "rank": F.coalesce("_top", F.lit(0)) + F.row_number().over(w), "score": F.lit(0.0), "confidence": F.lit("manual"),
        "unit_status": F.lit("manual"), "selected": F.lit(True), "final_price": F.round("price", 2),
        "warnings": F.array().cast("array<string>")}).drop("_top", "price")
    return options.unionByName(new.drop("seq"), allowMissingColumns=True), manual.filter(~ok)


def purge_job(lines: DataFrame, options: DataFrame, job_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove jobs' lines and the options that hang on them."""
    gone = lines.join(job_ids, "job_id", "left_semi").select("line_id")
    return lines.join(job_ids, "job_id", "left_anti"), options.join(gone, "line_id", "left_anti")


def attach_history(options: DataFrame, history: DataFrame, fields=("name", "spec", "price")) -> DataFrame:
    side = history.select(F.col("id").alias("history_id"), *[F.col(f).alias(f"history_{f}") for f in fields])
    return options.join(side, "history_id", "left")


def confirmed_drafts(lines: DataFrame, options: DataFrame, history: DataFrame) -> DataFrame:
    """One pending draft price per confirmed line: the price of its primary option and the product this option stands for.

    The primary is the selected option with the lowest rank (then the smallest option_id).  A line without one, or whose
    primary has no positive price, gives no draft; the next option does not step in.  Texts come from the linked record,
    empty ones too; without a record from the manual entry, then from the line (the code from the line only).
    ``suggested_price`` is the price of the line's first option, selected or not.
    """
    c = F.col
    place = F.struct("rank", "option_id")
    manual = [f"manual_{f}" for f in DRAFT_TEXTS if f"manual_{f}" in options.columns]
    primary = F.struct("history_id", "final_price", *manual)
    shown = options.groupBy("line_id").agg(
        F.min_by(primary, F.when(c("selected"), place)).alias("_primary"), F.min_by("final_price", place).alias("suggested_price"))
    records = history.select(c("id").alias("_id"), F.struct(*DRAFT_TEXTS, "product_code").alias("_record"))
    df = lines.filter("confirmed").join(shown, "line_id").filter("_primary.final_price > 0")
    df = df.withColumn("_id", c("_primary.history_id")).join(records, "_id", "left")
    linked = c("_record").isNotNull()

    def text(f: str) -> Column:
        own = c(f) if f in lines.columns else F.lit("")
        entry = c(f"_primary.manual_{f}") if f"manual_{f}" in manual else F.lit(None).cast("string")
        return F.when(linked, c(f"_record.{f}")).otherwise(first_set(entry, own)).alias(f)

    return df.select(
        "line_id", "job_id", "name", *[text(f) for f in DRAFT_TEXTS],
        F.when(linked, c("_record.product_code")).otherwise(c("product_code")).alias("product_code"),
        c("_primary.final_price").alias("confirmed_price"), "suggested_price", F.lit("pending").alias("status"))
