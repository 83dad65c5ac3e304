"""Scores of candidate pairs and the price baseline they are judged by."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import specs as S
from ..functions.similarity import sequence_ratio
from ..functions.text import format_g, normalize_text
from ..session import materialize
from .stats import middle, values_inside, wanted_slots

# Weights of the score components.
WEIGHTS = {"参数": 40, "型号": 13, "名称": 13, "制造商/品牌": 9, "单位": 9, "数据质量": 4}
FAMILY_POINTS = 6.0
PRICE_POINTS = 6.0
SCORING_QUALITY = ["spec", "model", "manufacturer", "unit", "quote_date", "source_file"]
STORED_QUALITY = ["spec", "model", "manufacturer", "unit", "product_code", "source_file"]


def data_quality(fields, tag: str = "") -> Column:
    filled = [(F.coalesce(F.col(tag + f).cast("string"), F.lit("")) != "").cast("int") for f in fields]
    total = filled[0]
    for one in filled[1:]:
        total = total + one
    return total / F.lit(float(len(fields)))


def text_table(rows: DataFrame, lex) -> DataFrame:
    """Distinct (name, spec) texts with ids and facts; write it before using the ids."""
    texts = rows.select("name", "spec").distinct().withColumn("text_id", F.monotonically_increasing_id())
    both = F.concat(F.col("name"), F.lit(" "), F.col("spec"))
    texts = S.with_spec_facts(texts, both, "facts", lex)
    texts = S.with_spec_facts(texts, F.col("spec"), "spec_facts", lex, ("span", "caps"))
    return S.with_spec_text(texts, F.col("spec"), "spec_text")


def text_scores(pairs: DataFrame, line_texts: DataFrame, record_texts: DataFrame, rules) -> DataFrame:
    """Text-only score parts of distinct (l_text_id, r_text_id) pairs."""
    left = line_texts.select(
        F.col("text_id").alias("l_text_id"), F.col("facts").alias("lf"),
        F.col("spec_facts").alias("ls"), F.col("spec_text").alias("lt"))
    right = record_texts.select(
        F.col("text_id").alias("r_text_id"), F.col("facts").alias("rf"),
        F.col("spec_facts").alias("rs"), F.col("spec_text").alias("rt"))
    df = pairs.join(left, "l_text_id").join(right, "r_text_id")
    lf, rf = F.col("lf"), F.col("rf")
    return df.select(
        "l_text_id", "r_text_id",
        S.parameter_similarity(F.col("lt"), F.col("ls"), F.col("rt"), F.col("rs")).alias("spec_similarity"),
        S.variant_points(rules).alias("variant_points"),
        S.numeric_bonus(lf, rf).alias("numeric_bonus"),
        S.variant_token_match(lf, rf).alias("token_match"),
        *[(lf[f] & rf[f]).alias(f"both_{f}") for f in ("student", "teaching", "grouped", "branch")],
    )


def spec_similarity_of(pairs: DataFrame, line_texts: DataFrame, record_texts: DataFrame) -> DataFrame:
    """Add spec_similarity, computed once per distinct text pair."""
    ids = pairs.select("l_text_id", "r_text_id").distinct()
    left = line_texts.select(F.col("text_id").alias("l_text_id"), F.col("spec_facts").alias("ls"), F.col("spec_text").alias("lt"))
    right = record_texts.select(F.col("text_id").alias("r_text_id"), F.col("spec_facts").alias("rs"), F.col("spec_text").alias("rt"))
    scored = ids.join(left, "l_text_id").join(right, "r_text_id").select(
        "l_text_id", "r_text_id",
        S.parameter_similarity(F.col("lt"), F.col("ls"), F.col("rt"), F.col("rs")).alias("spec_similarity"))
    return pairs.join(scored, ["l_text_id", "r_text_id"])


def ratio_table(pairs: DataFrame, columns) -> DataFrame:
    """Sequence ratio of the distinct, non-trivial value pairs of several column pairs."""
    both = F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in columns]))
    distinct = (
        pairs.select(both.alias("p")).select("p.a", "p.b")
        .filter((F.col("a") != "") & (F.col("b") != "") & (F.col("a") != F.col("b"))).distinct()
    )
    return distinct.withColumn("ratio", sequence_ratio(F.col("a"), F.col("b")))


def with_ratio(pairs: DataFrame, table: DataFrame, left: str, right: str, out: str) -> DataFrame:
    names = table.select(F.col("a").alias(left), F.col("b").alias(right), F.col("ratio").alias("_ratio"))
    a, b = F.col(left), F.col(right)
    return pairs.join(names, [left, right], "left").withColumn(
        out, F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.coalesce("_ratio", F.lit(0.0)))
    ).drop("_ratio")


# --- customer requirements ---------------------------------------------------

def requirement_met(rule_value: Column, rule_unit: Column, operator: Column, raw: Column, key: Column) -> Column:
    """Does a record text satisfy one requirement?  ``raw`` is folded, ``key`` normalized."""
    value = F.trim(rule_value)
    unit = F.lower(F.trim(rule_unit))
    numeric = value.rlike(r"^-?\d+(\.\d+)?$") & (unit != "")
    target = F.when(numeric, value.try_cast("double"))
    pattern = F.concat(F.lit(r"(-?\d+(?:\.\d+)?)\s*\Q"), unit, F.lit(r"\E"))
    found = F.transform(F.regexp_extract_all(raw, pattern, 1), lambda v: v.try_cast("double"))
    contains = F.when(value == "", F.lit(True)).otherwise(key.contains(normalize_text(value)))
    near = F.exists(
        found, lambda v: F.abs(v - target) <= 0.01 * F.greatest(F.abs(v), F.abs(target))
    )
    return (
        F.when(numeric & operator.isin(">=", "≥"), F.exists(found, lambda v: v >= target))
        .when(numeric & operator.isin("<=", "≤"), F.exists(found, lambda v: v <= target))
        .when(numeric & operator.isin("=", "equals"), near)
        .otherwise(contains)
    )


def check_requirements(records: DataFrame, rules: DataFrame, on: str = "customer_id") -> DataFrame:
    """Records joined to their customer's rules: one row per unmet rule, with its warning.

    ``records`` carries ``on``, spec, model and brand.  Where records know their order only, give the rules by order:
    then the records move once.
    """
    from ..functions.text import nfkc

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    raw = F.lower(nfkc(F.concat(blank("spec"), F.lit(" "), blank("model"))))
    key = normalize_text(F.concat(blank("spec"), blank("model"), blank("brand")))
    df = records.withColumns({"_raw": raw, "_key": key}).join(rules, on)
    met = requirement_met(F.col("value"), F.col("rule_unit"), F.col("operator"), F.col("_raw"), F.col("_key"))
    warning = F.concat(
        F.when(F.col("required"), F.lit("BLOCK: ")).otherwise(F.lit("")), F.lit("未满足客户要求："),
        F.col("attribute_name"), F.lit(" "), F.col("operator"), F.lit(" "), F.col("value"), F.col("rule_unit"))
    return df.filter(~met).withColumn("warning", warning).drop("_raw", "_key")


# --- price baseline ----------------------------------------------------------

def price_bucket(price: Column) -> Column:
    """Price rounded to two significant digits (half to even)."""
    digits = F.length(F.floor(F.abs(price)).cast("string")) - 1
    step = F.greatest(F.pow(F.lit(10.0), (digits - 1).cast("double")), F.lit(0.01))
    return F.when(price <= 0, F.lit(0.0)).otherwise(F.bround(price / step, 0) * step)


def price_cell(price: Column) -> Column:
    """Monotone cell of a price, a tenth of a per cent wide: a two-digit bucket has ten to a hundred."""
    return F.when(price > 0, F.floor(F.log(F.when(price > 0, price)) * 1000)).otherwise(F.lit(-1_000_000))


def peer_baseline(lines: DataFrame, history: DataFrame, pairs: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Peer price median per (core, values) of the inquiry.

    ``lines`` and ``history`` carry ``core``, ``values`` (numbers by unit) and their text ``sig``, and history
    also ``price`` and ``rowid``.  Peers share a similar core and a reachable range;
    the baseline is the median of the fullest two-digit price bucket.  History is
    reduced to counts per (core, values, bucket) first, and summed over similar cores
    before values are compared, so the work follows the vocabulary.  Prices are counted in the
    buckets used only, and meet lines as narrow cells first; then only the cells that hold a median do.
    ``history`` is read three times: write it before if it is dear.
    """
    pairs = materialize(pairs.filter(F.col("dice") >= cfg.peer_floor).select("line_core", "record_core"), "peer_pairs")
    priced = history.filter(F.coalesce(F.col("price"), F.lit(0.0)) != 0).select(
        F.col("core").alias("record_core"), F.col("sig").alias("record_sig"), "values", "price", "rowid",
        price_bucket(F.col("price")).alias("bucket"))
    wanted = lines.select(F.col("core").alias("line_core"), F.col("sig").alias("line_sig"),
                          F.col("values").alias("line_values")).distinct()
    sums = materialize(priced.groupBy("record_core", "record_sig", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("rowid").alias("first")), "peer_sums")
    by_core = (
        sums.join(pairs, "record_core").groupBy("line_core", "record_sig", "bucket")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    )
    of_sig = priced.select("record_sig", F.col("values").alias("record_values")).distinct()
    reach = (
        sums.select("record_core", "record_sig").distinct().join(pairs, "record_core").select("line_core", "record_sig").distinct()
        .join(of_sig, "record_sig").join(wanted, "line_core")
        .filter(S.same_range(F.col("line_values"), F.col("record_values"), 0.6))
        .select("line_core", "line_sig", "record_sig")
    )
    reach = materialize(reach, "reach")
    buckets = (
        by_core.join(reach, ["line_core", "record_sig"]).groupBy("line_core", "line_sig", "bucket")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    )
    per = Window.partitionBy("line_core", "line_sig")
    buckets = buckets.withColumns({
        "peers": F.sum("n").over(per),
        "at": F.row_number().over(per.orderBy(F.desc("n"), "first")),
        "largest": F.max("n").over(per),
    }).filter(F.col("peers") >= 3)
    # Either the fullest bucket, or (all buckets hold one price) every bucket.
    used = buckets.filter((F.col("at") == 1) | (F.col("largest") < 2)).select(
        "line_core", "line_sig", "bucket", (F.col("largest") < 2).alias("thin"))
    used = materialize(used, "used_buckets")
    asked = used.select("line_core", "bucket").distinct().join(pairs, "line_core").select("record_core", "bucket").distinct()
    prices = materialize(
        priced.join(asked, ["record_core", "bucket"], "left_semi").groupBy("record_core", "record_sig", "bucket", "price")
        .agg(F.count(F.lit(1)).alias("_w")).withColumn("_slot", price_cell(F.col("price"))), "peer_prices")

    def positions(n: Column):
        lower = F.when(n >= 3, F.greatest(F.lit(3), F.floor(n * 3 / 4))).otherwise(n)
        return middle(F.when(F.col("thin"), lower).otherwise(n))

    keys = ["line_core", "line_sig", "thin"]
    cells = prices.groupBy("record_core", "record_sig", "bucket", "_slot").agg(F.sum("_w").alias("_w"))
    cells = (
        cells.join(pairs, "record_core").join(used.select("line_core", "bucket").distinct(), ["line_core", "bucket"], "left_semi")
        .groupBy("line_core", "record_sig", "bucket", "_slot").agg(F.sum("_w").alias("_w"))
        .join(reach, ["line_core", "record_sig"]).join(used, ["line_core", "line_sig", "bucket"])
        .groupBy(*keys, "_slot").agg(F.sum("_w").alias("_in"))
    )
    holding = materialize(wanted_slots(cells, keys, positions).join(used, keys), "peer_cells")
    inside = (
        prices.join(pairs, "record_core").join(holding.select("line_core", "bucket", "_slot").distinct(), ["line_core", "bucket", "_slot"], "left_semi")
        .groupBy("line_core", "record_sig", "bucket", "_slot", "price").agg(F.sum("_w").alias("_w"))
        .join(reach, ["line_core", "record_sig"]).join(holding, ["line_core", "line_sig", "bucket", "_slot"])
    )
    stats = values_inside(inside.withColumnRenamed("price", "_v"), keys)
    return stats.select("line_core", "line_sig", ((F.col("low") + F.col("high")) / 2).alias("peer_median"))


# --- row scores --------------------------------------------------------------

def item_scores(df: DataFrame, lex) -> DataFrame:
    """Score parts of (text, unit) pairs: needs both cores and stems, the line's and record's spec, dice, unit and the text scores."""
    c = F.col
    stems = c("l_core_stem") == c("r_core_stem")
    exact_name = ((c("l_core") != "") & (c("l_core") == c("r_core"))) | (
        S.swapped_suffix(c("l_core"), c("r_core"), lex.suffix_swap) & stems
    )
    df = df.withColumns({"exact_name": exact_name, "same_core": c("l_core") == c("r_core")})
    lifted = F.when(c("exact_name") & (c("r_spec") != ""), F.greatest(c("spec_similarity"), F.lit(0.4))).otherwise(c("spec_similarity"))
    agreed = sum((F.when(c(f"both_{f}"), F.lit(3.0)).otherwise(F.lit(0.0)) for f in ("student", "teaching", "grouped")), F.lit(0.0))
    return df.withColumns({
        "c_spec": F.round(lifted * WEIGHTS["参数"], 2),
        "c_name": F.round(c("dice") * WEIGHTS["名称"], 2),
        "c_unit": F.round(c("unit.score") * WEIGHTS["单位"], 2),
        "agreed": agreed,
    })


def party_scores(df: DataFrame) -> DataFrame:
    """Score parts of (model, brand, maker) pairs from their three similarities."""
    c = F.col
    return df.withColumns({
        "c_model": F.round(c("model_similarity") * WEIGHTS["型号"], 2),
        "c_maker": F.round((c("maker_similarity") + c("brand_similarity")) / 2 * WEIGHTS["制造商/品牌"], 2),
    })


def base_scores(df: DataFrame) -> DataFrame:
    """Score of pairs that carry their item and party scores, before price consistency.

    Needs codes, families and categories of both sides and the record's quality.
    """
    c = F.col
    exact_code = (c("l_code_key") != "") & (c("l_code_key") == c("r_code_key"))
    clash_major = (c("l_major") != "") & (c("r_major") != "") & (c("l_major") != c("r_major"))
    clash_cat = (c("l_category") != "") & (c("r_category") != "") & (c("l_category") != c("r_category"))
    df = df.withColumns({"exact_code": exact_code, "category_ok": ~(clash_major | clash_cat)})
    df = df.withColumns({
        "c_quality": F.round(c("r_quality") * WEIGHTS["数据质量"], 2),
        "c_family": F.when(c("category_ok"), F.lit(FAMILY_POINTS)).otherwise(F.lit(0.0)),
    })
    total = F.round(c("c_spec") + c("c_model") + c("c_name") + c("c_maker") + c("c_unit") + c("c_quality") + c("c_family"), 2)
    start = F.when(c("exact_code"), F.lit(100.0)).otherwise(
        total + F.when(c("exact_name"), F.lit(5.0)).otherwise(F.lit(0.0)) + c("agreed"))
    penalty = c("variant_points") + F.when(c("category_ok"), F.lit(0.0)).otherwise(F.lit(20.0))
    base = F.round(F.greatest(F.lit(0.0), start - penalty) + c("numeric_bonus"), 2)
    return df.withColumn("base_score", base).withColumn("score", c("base_score"))


def confidence(score: Column, blocked: Column, cfg: MatchConfig) -> Column:
    return (
        F.when(score < cfg.reliable, F.lit("unreliable")).when(blocked, F.lit("review"))
        .when(score >= cfg.high, F.lit("high")).when(score >= cfg.medium, F.lit("medium")).otherwise(F.lit("low"))
    )


def with_price_consistency(df: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Price agreement with the peer median, and the age of the quote."""
    c = F.col
    ratio = F.when((c("peer_median") != 0) & (c("r_price") != 0), c("r_price") / F.when(c("peer_median") != 0, c("peer_median")))
    same = c("same_core")
    extreme = same & ~c("token_match") & ((ratio > 4.0) | (ratio < 0.25))
    df = df.withColumn("price_extreme", F.coalesce(extreme, F.lit(False)))
    points = (
        F.when(c("price_extreme"), F.lit(0.0)).when(same | ratio.isNull(), F.lit(PRICE_POINTS))
        .when((ratio > 2.0) | (ratio < 0.5), F.lit(0.0)).when((ratio > 1.5) | (ratio < 0.67), F.lit(2.0))
        .when((ratio > 1.25) | (ratio < 0.8), F.lit(4.0)).otherwise(F.lit(PRICE_POINTS))
    )
    df = df.withColumns({"c_price": points, "c_age": c("r_age_bonus")})
    lowered = F.when(c("price_extreme"), F.round(c("score") - 8.0, 2)).otherwise(c("score"))
    return df.withColumn("score", F.round(lowered + c("c_price") + c("c_age"), 2))


def reasons() -> Column:
    c, text = F.col, F.lit
    wide = c("exact_code")
    rules = [
        (wide, "产品编码精确一致"), (c("exact_name") & ~wide, "名称完全一致"),
        (c("both_student"), "学生用定位一致"), (c("both_teaching"), "教学用定位一致"),
        (c("both_grouped"), "学生分组定位一致"),
        (c("dice") == 1, "名称一致"), ((c("dice") >= 0.6) & (c("dice") < 1), "名称相似"),
        (c("spec_similarity") >= 0.85, "参数高度一致"),
        ((c("spec_similarity") >= 0.45) & (c("spec_similarity") < 0.85), "参数部分一致"),
        ((c("model_similarity") >= 0.9) & (c("l_model") != ""), "型号一致"),
        (c("unit.status") == "exact", "单位一致"), (c("category_ok"), "类目一致"),
        (c("numeric_bonus") >= 4, "规格数值吻合"),
    ]
    return F.array_compact(F.array(*[F.when(cond, text(word)) for cond, word in rules]))


def flag_mid_price(price: Column, mid: Column) -> Column:
    """Warning when a price is over three times, or under a third of, the group's median."""
    off = (mid != 0) & ((price > mid * 3) | (price < mid / 3))
    return F.when(off, F.concat(F.lit("价格偏离同组中位数（¥"), format_g(mid), F.lit("）")))
