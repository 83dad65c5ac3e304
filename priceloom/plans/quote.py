"""Quote inquiry lines: match, choose options, price and rank them."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.keys import vendor_key
from ..functions.text import format_g, grade_of_key, normalize_text
from ..functions.category import infer_category
from ..operators import pricing as P
from ..operators import selection as X
from ..operators.candidates import name_gate
from ..session import materialize
from .match import Prepared, match, prepare

def per_line():
    return Window.partitionBy("line_id")
POLICY = {"customer_type": "ordinary", "discount_percent": 0.0, "minimum_margin_percent": 0.0}


def with_policy(lines: DataFrame, policy: DataFrame | None) -> DataFrame:
    """Customer terms per job; ordinary terms where a job names no customer."""
    if policy is not None:
        known = policy.withColumn("preferred", F.filter(F.transform("preferred", normalize_text), lambda v: v != ""))
        lines = lines.join(known.select("job_id", *POLICY, "preferred"), "job_id", "left")
    else:
        lines = lines.withColumn("preferred", F.array().cast("array<string>"))
    return lines.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) if policy is not None else F.lit(value)
        for name, value in POLICY.items()
    }).withColumn("needs_approval", (F.col("customer_type") == "vip") & (F.col("discount_percent") > 0)
                  & (F.col("minimum_margin_percent") > 0))


def quote(lines: DataFrame, history: DataFrame, lex, cfg: MatchConfig = MatchConfig(),
          policy: DataFrame | None = None, requirements=None) -> tuple[DataFrame, DataFrame]:
    """(lines, options) for inquiry ``lines`` with line_id and job_id against one book."""
    c = F.col
    p: Prepared = prepare(lines, history, lex, cfg)
    cands = match(lines, history, lex, cfg, requirements, prepared=p)
    terms = with_policy(p.lines, policy)
    grades = X.grade_vote(p.lines, p.history, lex)
    vendors = X.vendor_order(p.history).select(c("vendor"), c("first_rowid").alias("vendor_first"))
    cands = (
        cands.withColumn("vendor", vendor_key(c("r_manufacturer"), c("r_brand")))
        .join(terms.join(grades.select("job_id", "job_grade"), "job_id")
              .select("line_id", "job_id", "preferred", "discount_percent", "minimum_margin_percent",
                      "needs_approval", "job_grade"), "line_id")
        .join(vendors, "vendor", "left")
    )
    cands = X.prefer_vendors(cands)
    trusted = c("r_source_file").contains(lex.trusted_mark) if lex.trusted_mark else F.lit(False)
    sheet_or_name = F.when(c("r_source_sheet") != "", c("r_source_sheet")).otherwise(c("r_name"))
    cands = cands.withColumns({
        "trusted": trusted,
        "quality_rank": X.name_quality(),
        "gate": name_gate(c("l_core"), c("r_core"), c("dice"), trusted, lex, cfg),
        "flag_match": c("both_teaching") | c("both_grouped") | c("both_student") | c("both_branch"),
        "_grade_text": normalize_text(sheet_or_name),
    })
    cands = P.group_medians(cands, lex, cfg)
    floor = F.when(c("trusted"), F.lit(cfg.trusted_floor)).otherwise(F.lit(cfg.default_floor))
    cands = cands.withColumns({"guard_ok": P.price_guard(), "floor": floor, "blocked": X.default_blocked(c("quality_rank"))})
    cands = cands.withColumn("eligible", (c("score") >= c("floor")) & (c("r_price") != 0) & c("gate") & c("guard_ok"))
    cands = cands.withColumn("trusted_default", c("eligible") & c("trusted") & ~c("blocked")).withColumns(X.order_keys(lex))
    top_unpriced = F.max(
        (c("position") == 1) & (c("quality_rank") == 2) & (c("r_price") == 0) & c("trusted")).over(per_line())
    priced_exact = F.max(c("eligible") & (c("quality_rank") == 2)).over(per_line())
    cands = cands.withColumns({
        "any_trusted": F.max("trusted_default").over(per_line()),
        "suppress": top_unpriced & ~priced_exact,
    })
    keys = ["k_quality", "k_spec", "k_new", "k_mismatch", "k_variant", "k_grade", "k_score", "k_legacy"]
    cands = cands.withColumn("default_pool", F.when(c("any_trusted"), c("trusted_default")).otherwise(c("eligible")) & ~c("suppress"))
    cands = materialize(cands, "candidates")

    pool = cands.filter("default_pool").select(
        "line_id", c("r_id").alias("id"), c("r_core").alias("core"), c("r_price").alias("price"), "vendor", "score",
        "vendor_first", "position", *keys)
    pool = pool.withColumn("at", F.row_number().over(per_line().orderBy(*keys, "position")))
    chosen = X.distinct_vendors(pool, cfg.options, cfg.trusted_floor, [c("vendor_first").asc_nulls_last(), *keys, "position"])
    defaults = X.keep_defaults(chosen, cfg.price_gap).withColumn("is_default", F.lit(True))
    cands = cands.join(defaults.withColumnRenamed("id", "r_id"), ["line_id", "r_id"], "left").withColumn(
        "is_default", F.coalesce("is_default", F.lit(False)))
    base = F.row_number().over(per_line().orderBy((~c("is_default")).cast("int"), *keys, "position"))
    cands = cands.withColumn("base", base)
    line_cat = infer_category(c("l_core"), lex)
    shown = X.diversify(cands.select(
        "line_id", c("r_id").alias("id"), "base", "is_default", c("r_core").alias("core"), c("l_core").alias("line_core"),
        c("r_price").alias("price"),
        ((line_cat == "") | (c("r_category") == "") | (line_cat == c("r_category"))).alias("category_fits")), cfg.price_gap, cfg.keep)
    extra = P.surcharge(c("r_code_key"), P.line_text_key(c("l_name"), c("l_spec")), lex)
    options = cands.join(shown.withColumnRenamed("id", "r_id"), ["line_id", "r_id"]).withColumn("extra", extra)
    options = options.withColumns({
        "final_price": P.final_price(c("normalized_price"), c("r_price"), c("extra.delta"), c("discount_percent")),
        "spec_key": normalize_text(c("r_spec")), "model_key": c("r_model_key"),
        "selected": c("is_default") & (c("score") >= c("floor")),
    })
    options = X.dedup_options(options).withColumn("rank", F.row_number().over(per_line().orderBy("place")))
    notes = F.array_compact(F.array(
        F.when(c("extra.delta") != 0, F.concat(F.lit("配置加价："), c("extra.note"), F.lit("（"), format_g(c("r_price")), F.lit("→"),
               format_g(F.round(F.coalesce(F.nullif(c("normalized_price"), F.lit(0.0)), c("r_price")) + c("extra.delta"), 2)), F.lit("）"))),
        F.when(~c("guard_ok") & (c("group_median") != 0), F.concat(F.lit("价格异常：偏离同组中位数（¥"), format_g(c("group_median")), F.lit("）超过2倍，需人工核对"))),
        F.when(c("discount_percent") != 0, F.concat(F.lit("已应用客户折扣 "), format_g(c("discount_percent")), F.lit("% ，需核对毛利"))),
        F.when(c("needs_approval"), F.concat(F.lit("BLOCK: VIP折扣需核对最低毛利线（"), format_g(c("minimum_margin_percent")), F.lit("%）"))),
    ))
    favoured = F.when(c("preferred_hit"), F.array(F.lit("VIP偏好制造商"))).otherwise(F.array().cast("array<string>"))
    options = options.withColumns({"warnings": F.concat("warnings", notes), "reasons": F.concat("reasons", favoured)})
    options = materialize(options.select(
        "line_id", "job_id", "rank", "score", "confidence", "component_scores", "reasons", "warnings", "unit_status",
        "normalized_price", "selected", "final_price", "vendor_first", "discount_percent", "group_prices",
        c("r_id").alias("history_id"), c("r_price").alias("price"),
        *[c(f"r_{f}").alias(f"record_{f}") for f in ("name", "spec", "model", "brand", "manufacturer", "unit", "product_code",
                                                     "source_file", "source_sheet", "source_row", "quote_date")]), "options")

    estimates = _estimates(options, p, lex)
    columns = [x for x in options.columns if x not in ("vendor_first", "discount_percent", "group_prices")]
    ranked = X.final_rank(options.select(*columns, "vendor_first").unionByName(estimates, allowMissingColumns=True))
    ranked = ranked.drop("rank", "vendor_first").withColumnRenamed("new_rank", "rank")
    return _line_results(terms, cands, estimates, cfg, p), ranked


def _estimates(options: DataFrame, p: Prepared, lex) -> DataFrame:
    """One unselected estimate for lines without a selected option but with like-named prices."""
    c = F.col
    open_lines = (
        options.groupBy("line_id", "job_id").agg(
            F.max("selected").alias("has"), F.max("rank").alias("rank"),
            F.max("discount_percent").alias("discount_percent"), F.first("group_prices").alias("group_prices"))
        .filter(~c("has") & (F.size("group_prices") > 0))
    )
    about = p.lines.select("line_id", "category", grade_of_key(c("name_key"), lex).alias("grade"))
    open_lines = open_lines.join(about, "line_id")
    book = p.history.select("category", grade_of_key(c("name_key"), lex).alias("grade"), "price")
    pool = P.estimate_pool(book, open_lines.select("category", "grade").distinct(), lex)
    df = open_lines.join(pool, ["category", "grade"], "left")
    n = F.size("group_prices")
    low = F.get("group_prices", F.least(n - 1, F.floor(n / 4).cast("int")))
    enough = F.coalesce(c("pool_size") >= 5, F.lit(False))
    df = df.withColumns({
        "est": F.when(enough, c("estimate")).otherwise(low),
        "label": F.when(enough, F.concat(F.lit("类目第10分位(共"), c("pool_size").cast("string"), F.lit("条)"))).otherwise(F.lit("同核心词组低位分位")),
    })
    return df.select(
        "line_id", "job_id", (c("rank") + 1).alias("rank"), F.lit(0.0).alias("score"), F.lit("low").alias("confidence"),
        F.array(F.lit("估算")).alias("reasons"),
        F.array(F.concat(F.lit("估算价：按"), c("label"), F.lit("（¥"), format_g(c("est")), F.lit("）生成，需人工复核"))).alias("warnings"),
        F.lit("exact").alias("unit_status"), F.lit(False).alias("selected"),
        F.round(c("est") * (1 - c("discount_percent") / 100), 2).alias("final_price"))


def _line_results(terms: DataFrame, cands: DataFrame, estimates: DataFrame, cfg: MatchConfig, p: Prepared) -> DataFrame:
    c = F.col
    ties = X.tie_alert(cands.select("line_id", "score", "position", c("r_price").alias("price")))
    best = cands.filter("position = 1").select(
        "line_id", c("score").alias("recommended_score"), c("confidence").alias("best_confidence"),
        c("warnings").alias("best_warnings"), (c("quality_rank") == 2).alias("exact_best"), "suppress")
    estimated = estimates.select("line_id", F.get("warnings", F.lit(0)).alias("estimate_note"))
    df = terms.join(best, "line_id", "left").join(ties, "line_id", "left").join(estimated, "line_id", "left")
    status, shown = X.line_status(c("recommended_score"), F.coalesce("exact_best", F.lit(False)),
                                  c("best_confidence"), c("needs_approval"), cfg)
    warnings = F.concat(
        F.coalesce("best_warnings", F.array(F.lit("没有找到可靠候选"))),
        F.array_compact(F.array(
            F.when(c("tie"), F.lit("同分多价：最高分候选存在不同历史价格")),
            F.when(c("needs_approval"), F.concat(F.lit("BLOCK: VIP折扣需核对最低毛利线（"), format_g(c("minimum_margin_percent")), F.lit("%）"))),
            F.when(c("suppress"), F.lit("目录中同名配备标准条目无价格，需人工询价")),
            c("estimate_note"),
        )))
    df = df.withColumns({"status": status, "confidence": shown, "warnings": warnings,
                         "recommended_score": F.coalesce("recommended_score", F.lit(0.0))})
    keep = [x for x in ("line_id", "job_id", "sheet_name", "source_row", "name", "spec", "product_code", "model", "brand",
                        "manufacturer", "unit", "quantity", "pricing_quantity") if x in terms.columns]
    return df.select(*keep, "status", "confidence", "recommended_score", "warnings", F.lit(False).alias("confirmed"))
