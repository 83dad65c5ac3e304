"""Review, selection and export operators over the sample tables."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.keys import vendor_key
from ..functions.text import normalize_text
from ..operators import pricing as P
from ..operators import review as RV
from ..operators import scoring as R
from ..operators import selection as X
from ..config import MatchConfig
from ..sources import exports as E
from ..streaming.jobs import settle_drafts
from . import views as V
from .registry import half_up, norm, query

c = F.col


def lines_options(spark, sf):
    return V.review_lines(spark, sf), V.review_options(spark, sf)


@query("filter_lines", V.with_views("""SELECT f, line_id FROM (SELECT 'confirmed' AS f, line_id FROM rlines WHERE confirmed UNION ALL SELECT 'pending', line_id FROM rlines WHERE NOT confirmed
 UNION ALL SELECT 'review', line_id FROM rlines WHERE status='review' UNION ALL SELECT 'unit_conflict', line_id FROM rlines WHERE list_contains(warnings,'BLOCK: 单位不可直接换算')
 UNION ALL SELECT 'price_anomaly', line_id FROM rlines WHERE list_contains(warnings,'价格偏离同组') UNION ALL SELECT 'score_tie', line_id FROM rlines WHERE list_contains(warnings,'同分多价')
 UNION ALL SELECT 'parameter_conflict', line_id FROM rlines WHERE list_contains(warnings,'未满足客户要求') UNION ALL SELECT 'low_confidence', line_id FROM rlines WHERE confidence IN ('low','unreliable','review')
 UNION ALL SELECT 'query', line_id FROM rlines WHERE contains(name,'12') OR contains(product_code,'12') OR source_row=12)"""))
def filter_lines(spark, sf):
    lines = V.review_lines(spark, sf)
    names = ["confirmed", "pending", "review", "unit_conflict", "price_anomaly", "score_tie", "parameter_conflict", "low_confidence"]
    out = RV.filter_lines(lines, "all", "12").select(F.lit("query").alias("f"), "line_id")
    for name in names:
        out = out.unionByName(RV.filter_lines(lines, name).select(F.lit(name).alias("f"), "line_id"))
    return out


@query("list_lines", V.with_views("SELECT line_id, recommended_score FROM (SELECT * FROM rlines WHERE NOT confirmed ORDER BY recommended_score DESC, source_row LIMIT 50 OFFSET 100)"))
def list_lines(spark, sf):
    return RV.list_lines(V.review_lines(spark, sf), 3, 50, "score_desc", row_filter="pending").select("line_id", "recommended_score")


@query("suggest_action", V.with_views("""WITH o AS (SELECT line_id, count(*) AS n, bool_or(list_contains(warnings,'BLOCK: 单位不可直接换算')) AS blocking, bool_or(selected) AS sel, bool_or(selected AND list_contains(warnings,'估算价：按类目')) AS est,
 max(CASE WHEN rank=1 THEN score END) AS top, max(CASE WHEN rank=2 THEN score END) AS second FROM ropts GROUP BY 1)
 SELECT l.line_id, CASE WHEN confirmed THEN 'none' WHEN blocking THEN 'must_review' WHEN n IS NULL THEN 'manual_quote' WHEN NOT sel THEN 'pick_one' WHEN est THEN 'review_estimate'
 WHEN (confidence='high' AND recommended_score>=80 AND second IS NULL) OR coalesce(top-second>=15,false) THEN 'auto_confirm_ok' WHEN confidence IN ('low','unreliable') OR recommended_score<55 THEN 'review_carefully' ELSE 'confirm_or_pick' END AS action
 FROM rlines l LEFT JOIN o ON o.line_id=l.line_id"""))
def suggest_action(spark, sf):
    return RV.suggest_action(*lines_options(spark, sf)).select("line_id", "action")


@query("batch_confirm", V.with_views("""WITH o AS (SELECT line_id, bool_or(list_contains(warnings,'BLOCK: 单位不可直接换算')) AS blocking FROM ropts WHERE selected GROUP BY 1)
 SELECT l.line_id, CASE WHEN NOT confirmed AND confidence='high' AND recommended_score>=80 AND NOT coalesce(blocking,true) THEN 'confirmed' ELSE 'skipped' END AS outcome FROM rlines l LEFT JOIN o ON o.line_id=l.line_id"""))
def batch_confirm(spark, sf):
    return RV.batch_confirm(*lines_options(spark, sf)).select("line_id", "outcome")


@query("auto_confirm", V.with_views("""WITH o AS (SELECT line_id, bool_or(list_contains(warnings,'估算价：按类目')) AS est, arg_min(list_contains(warnings,'BLOCK: 单位不可直接换算') OR list_contains(warnings,'规格量程不符'), rank) AS risky, arg_min(final_price, rank) AS p FROM ropts WHERE selected GROUP BY 1)
 SELECT l.line_id, confirmed OR coalesce(NOT est AND NOT risky AND p<>0, false) AS confirmed FROM rlines l LEFT JOIN o ON o.line_id=l.line_id"""))
def auto_confirm(spark, sf):
    return RV.auto_confirm(*lines_options(spark, sf)).select("line_id", "confirmed")


@query("customer_policy", V.with_views("""SELECT l.line_id, len(l.warnings)+CASE WHEN n.job_id IS NOT NULL THEN 1 ELSE 0 END AS warnings, CASE WHEN n.job_id IS NOT NULL AND l.status='suggested' THEN 'review' ELSE l.status END AS status
 FROM rlines l LEFT JOIN (SELECT customer_id AS job_id FROM cust WHERE customer_type='vip' AND discount_percent>0 AND minimum_margin_percent>0) n ON n.job_id=CAST(l.product_code AS BIGINT)"""))
def customer_policy(spark, sf):
    lines = V.review_lines(spark, sf).withColumn("job_id", c("product_code").cast("bigint"))
    terms = V.customers(spark, sf).withColumnRenamed("customer_id", "job_id")
    marked, _ = RV.customer_policy(lines, V.review_options(spark, sf).withColumn("job_id", F.lit(-1).cast("bigint")), terms)
    return marked.select("line_id", F.size("warnings").alias("warnings"), "status")


@query("customer_policy_options", V.with_views("""SELECT o.option_id, len(o.warnings)+CASE WHEN n.job_id IS NOT NULL THEN 1 ELSE 0 END AS warnings
 FROM ropts o JOIN rlines l ON l.line_id=o.line_id LEFT JOIN (SELECT customer_id AS job_id FROM cust WHERE customer_type='vip' AND discount_percent>0 AND minimum_margin_percent>0) n ON n.job_id=CAST(l.product_code AS BIGINT)"""))
def customer_policy_options(spark, sf):
    lines = V.review_lines(spark, sf).withColumn("job_id", c("product_code").cast("bigint"))
    options = V.review_options(spark, sf).join(lines.select("line_id", "job_id"), "line_id")
    _, marked = RV.customer_policy(lines, options, V.customers(spark, sf).withColumnRenamed("customer_id", "job_id"))
    return marked.select("option_id", F.size("warnings").alias("warnings"))


@query("job_counters", V.with_views("SELECT job_id, count(*) AS total_lines, count(*) FILTER (status='suggested') AS matched_lines, count(*) FILTER (status='review') AS review_lines, count(*) FILTER (status='unmatched') AS unmatched_lines, count(*) FILTER (confirmed) AS confirmed_lines, CASE WHEN count(*) FILTER (confirmed)>=count(*) THEN 'confirmed' ELSE 'review' END AS job_status FROM rlines GROUP BY 1"))
def job_counters(spark, sf):
    return RV.job_counters(V.review_lines(spark, sf))


@query("dashboard", V.with_views("SELECT count(*) AS active_jobs, CAST(sum(r+u) AS BIGINT) AS need_review FROM (SELECT job_id, count(*) FILTER (status='review') r, count(*) FILTER (status='unmatched') u FROM rlines GROUP BY 1)"))
def dashboard(spark, sf):
    return RV.dashboard(RV.job_counters(V.review_lines(spark, sf)).withColumnRenamed("job_status", "status"))


@query("coverage", V.with_views("""SELECT job_id, count(*) AS lines, count(*) FILTER (e IS NOT NULL OR status='unmatched') AS lost, round((count(*)-count(*) FILTER (e IS NOT NULL OR status='unmatched'))/CAST(count(*) AS DOUBLE), 6) AS coverage
 FROM rlines l LEFT JOIN (SELECT DISTINCT line_id AS e FROM ropts WHERE list_contains(warnings,'估算价：按类目')) ON e=l.line_id GROUP BY 1"""))
def coverage(spark, sf):
    return RV.coverage(*lines_options(spark, sf)).withColumn("coverage", F.round("coverage", 6))


@query("price_summary", V.with_views("SELECT line_id, min(p) AS lowest, max(p) AS highest, round(median(p),6) AS median_price FROM (SELECT line_id, coalesce(normalized_price, price) AS p FROM ropts) WHERE p>0 GROUP BY 1"))
def price_summary(spark, sf):
    return P.price_summary(V.review_options(spark, sf)).withColumn("median_price", F.round("median_price", 6))


@query("price_by_vendor", V.with_views("SELECT line_id, CASE WHEN manufacturer<>'' THEN manufacturer ELSE source_file END AS vendor, count(*) AS options, min(p) AS lowest, max(p) AS highest FROM (SELECT *, coalesce(normalized_price, price) AS p FROM ropts) WHERE p>0 GROUP BY 1,2"))
def price_by_vendor(spark, sf):
    return P.price_by_vendor(V.review_options(spark, sf))


DECIDE = "d AS (SELECT line_id, CASE WHEN CAST(round(price*100) AS BIGINT)%29=0 THEN 'no-'||option_id ELSE option_id END AS option_id, unit<>'g' AS want, CASE WHEN unit='kg' THEN floor(price)-100 END AS override FROM ropts)"


JUDGED = f"""{DECIDE}, s AS (SELECT d.*, o.option_id IS NOT NULL AS known, {norm('o.manufacturer')} AS v, round(coalesce(override, o.final_price),2) AS kp, {norm('o.spec')} AS ks FROM d LEFT JOIN ropts o ON o.line_id=d.line_id AND o.option_id=d.option_id),
 v AS (SELECT line_id, bool_or(NOT known) AS unknown, bool_or(coalesce(override<=0,false)) AS bad FROM s GROUP BY 1), t AS (SELECT DISTINCT line_id FROM (SELECT line_id FROM s WHERE want AND known GROUP BY line_id, v, kp, ks HAVING count(*)>1)),
 j AS (SELECT v.line_id, CASE WHEN unknown THEN 'unknown_option' WHEN t.line_id IS NOT NULL THEN 'identical_options' ELSE 'bad_price' END AS reason FROM v LEFT JOIN t ON t.line_id=v.line_id WHERE unknown OR t.line_id IS NOT NULL OR bad)"""


def reviewed(spark, sf):
    lines, options = V.review_lines(spark, sf), V.review_options(spark, sf, V.stored_rows(spark, sf))
    cents = F.round(c("price") * 100).cast("bigint")
    decisions = options.select(
        "line_id", F.when(cents % 29 == 0, F.concat(F.lit("no-"), "option_id")).otherwise(c("option_id")).alias("option_id"),
        (c("unit") != "g").alias("selected"), F.when(c("unit") == "kg", F.floor("price") - 100.0).alias("price"))
    return RV.apply_review(lines, options, decisions)


@query("apply_review", V.with_views(f"WITH {JUDGED} SELECT line_id, reason FROM j"))
def apply_review(spark, sf):
    return reviewed(spark, sf)[2]


@query("reviewed_lines", V.with_views(f"""WITH {JUDGED} SELECT l.line_id, l.confirmed AND (v.line_id IS NULL OR j.line_id IS NOT NULL) AS confirmed, CASE WHEN v.line_id IS NOT NULL AND j.line_id IS NULL THEN 'review' ELSE l.status END AS status
 FROM rlines l LEFT JOIN v ON v.line_id=l.line_id LEFT JOIN j ON j.line_id=l.line_id"""))
def reviewed_lines(spark, sf):
    return reviewed(spark, sf)[0].select("line_id", "confirmed", "status")


@query("reviewed_options", V.with_views(f"""WITH {JUDGED} SELECT o.option_id, CASE WHEN j.line_id IS NULL THEN d.want ELSE o.selected END AS selected, CASE WHEN j.line_id IS NULL THEN coalesce(round(d.override,2), o.final_price) ELSE o.final_price END AS final_price
 FROM ropts o LEFT JOIN j ON j.line_id=o.line_id LEFT JOIN d ON d.line_id=o.line_id AND d.option_id=o.option_id"""))
def reviewed_options(spark, sf):
    return reviewed(spark, sf)[1].select("option_id", "selected", "final_price")


def draft_parts(spark, sf):
    """Lines with a brand of their own; options priced by kg are manual entries."""
    lines, options = lines_options(spark, sf)
    by_hand = c("unit") == "kg"
    options = options.withColumns({
        "history_id": F.when(~by_hand, c("history_id")), "manual_manufacturer": F.when(by_hand, c("manufacturer")),
        "manual_spec": F.when(by_hand, "")})
    return lines.withColumn("brand", F.concat(F.lit("brand of "), "name")), options, V.history(spark, sf)


DRAFTED = """p AS (SELECT * FROM ropts WHERE selected QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY rank)=1), s AS (SELECT line_id, final_price AS suggested_price FROM ropts WHERE rank=1),
 drafted AS (SELECT l.line_id, l.job_id, l.name, coalesce(h.spec, l.spec) AS spec, coalesce(h.model, l.model) AS model, coalesce(h.brand, 'brand of '||l.name) AS brand, coalesce(h.manufacturer, p.manufacturer) AS manufacturer, coalesce(h.unit, l.unit) AS unit,
  coalesce(h.product_code, l.product_code) AS product_code, p.final_price AS confirmed_price, s.suggested_price, 'pending' AS status
  FROM rlines l JOIN p ON p.line_id=l.line_id JOIN s ON s.line_id=l.line_id LEFT JOIN hist h ON h.id=p.history_id AND p.unit<>'kg' WHERE l.confirmed AND p.final_price>0)"""


@query("confirmed_drafts", V.with_views(f"WITH {DRAFTED} SELECT * FROM drafted"))
def confirmed_drafts(spark, sf):
    return RV.confirmed_drafts(*draft_parts(spark, sf))


@query("promoted_drafts", V.with_views(f"""WITH {DRAFTED}, k AS (SELECT line_id, line_id%2=0 AS approved, {norm('name')} AS k1, {norm('spec')} AS k2, {norm('unit')} AS k3, {norm('manufacturer')} AS k4, round(confirmed_price,4) AS k5 FROM drafted)
 SELECT line_id, CASE WHEN NOT approved THEN 'pending' WHEN line_id<>min(line_id) FILTER (approved) OVER (PARTITION BY k1,k2,k3,k4,k5) THEN 'already_in_book' ELSE 'promoted' END AS outcome FROM k"""))
def promoted_drafts(spark, sf):
    """Every second draft is approved; one of each product and price enters the book."""
    lines, options, history = draft_parts(spark, sf)
    queue = RV.confirmed_drafts(lines, options, history).withColumns({
        "draft_id": c("line_id"), "status": F.when(c("line_id") % 2 == 0, "approved").otherwise("pending")})
    return settle_drafts(queue, history)[0].select("line_id", "outcome")


@query("add_manual_options", V.with_views("""SELECT line_id, CAST(rank AS INTEGER) AS rank, final_price FROM (SELECT o_orderkey AS line_id, coalesce(m,0)+1 AS rank, round(o_totalprice,2) AS final_price FROM orders LEFT JOIN (SELECT line_id, max(rank) AS m FROM ropts GROUP BY 1) ON line_id=o_orderkey WHERE o_custkey%5<>0)"""))
def add_manual_options(spark, sf):
    o = V.table(spark, sf, "orders")
    manual = o.select(c("o_orderkey").alias("line_id"), F.lit(1).alias("seq"), F.when(c("o_custkey") % 5 == 0, " ").otherwise("acme").alias("manual_brand"),
                      F.lit("").alias("manual_manufacturer"), F.lit(None).cast("string").alias("history_id"), c("o_totalprice").alias("price"))
    options = V.review_options(spark, sf)
    out, _ = RV.add_manual_options(options, manual)
    return out.filter("confidence = 'manual'").select("line_id", "rank", "final_price")


@query("purge_job", V.with_views("SELECT count(*) AS options FROM ropts WHERE line_id NOT IN (SELECT line_id FROM rlines WHERE job_id='1-URGENT')"))
def purge_job(spark, sf):
    lines, options = lines_options(spark, sf)
    gone = spark.createDataFrame([("1-URGENT",)], "job_id string")
    return RV.purge_job(lines, options, gone)[1].agg(F.count(F.lit(1)).alias("options"))


@query("attach_history", V.with_views("SELECT o.option_id, h.name AS history_name FROM ropts o LEFT JOIN hist h ON h.id=o.history_id"))
def attach_history(spark, sf):
    return RV.attach_history(V.review_options(spark, sf), V.history(spark, sf)).select("option_id", "history_name")


RESOLVED = """r AS (SELECT o.*, CASE WHEN record_manufacturer<>'' THEN record_manufacturer ELSE h.manufacturer END AS fm, CASE WHEN record_product_code<>'' THEN record_product_code ELSE h.product_code END AS fc,
 CASE WHEN record_spec<>'' THEN record_spec ELSE h.spec END AS fs, CASE WHEN record_unit<>'' THEN record_unit ELSE h.unit END AS fu FROM ropts o LEFT JOIN hist h ON h.id=o.history_id)"""


def stored(spark, sf):
    return V.review_options(spark, sf).drop("manufacturer", "brand", "spec", "model", "product_code", "unit")


def resolved(spark, sf):
    return E.resolve_option_fields(stored(spark, sf), V.history(spark, sf))


@query("resolve_option_fields", V.with_views(f"WITH {RESOLVED} SELECT option_id, fm AS manufacturer, fc AS product_code, fs AS spec, fu AS unit FROM r"))
def resolve_option_fields(spark, sf):
    return resolved(spark, sf).select("option_id", "manufacturer", "product_code", "spec", "unit")


Q = "coalesce(nullif(l.pricing_quantity,0), nullif(l.quantity,0))"


def money(p: str) -> str:
    unit = half_up(f"{p}*(1+0.10::DOUBLE)", 2)
    return f"{unit} AS tax_unit, {half_up(f'{p}*q', 2)} AS total, {half_up(f'({unit})*q', 2)} AS tax_total"


@query("export_detail", V.with_views(f"""WITH {RESOLVED}, x AS (SELECT l.sheet_name, l.source_row, l.name AS line_name, r.rank, r.fm AS manufacturer, r.fs AS spec, {Q} AS q, r.final_price, r.score FROM r JOIN rlines l ON l.line_id=r.line_id WHERE r.selected)
 SELECT sheet_name, source_row, line_name, CAST(rank AS INTEGER) AS rank, manufacturer, spec, q AS billing_quantity, final_price, {money('final_price')}, score FROM x"""))
def export_detail(spark, sf):
    df = E.export_detail(V.review_lines(spark, sf), resolved(spark, sf), "internal")
    return df.select("sheet_name", "source_row", "line_name", "rank", "manufacturer", "spec", "billing_quantity", "final_price",
                     "tax_unit", "total", "tax_total", "score")


@query("export_wide", V.with_views(f"""WITH {RESOLVED}, s AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY rank) AS slot FROM r WHERE selected),
 x AS (SELECT l.line_id, l.name, {Q} AS q, a.final_price AS p, coalesce(a.fm,'') AS m, b.final_price AS p2, b.fm AS m2, d.final_price AS p3 FROM rlines l LEFT JOIN s a ON a.line_id=l.line_id AND a.slot=1 AND l.confirmed LEFT JOIN s b ON b.line_id=l.line_id AND b.slot=2 AND l.confirmed LEFT JOIN s d ON d.line_id=l.line_id AND d.slot=3 AND l.confirmed)
 SELECT line_id, name, p AS option1_price, {money('p')}, m AS option1_manufacturer, p2 AS option2_price, m2 AS option2_manufacturer, p3 AS option3_price FROM x"""))
def export_wide(spark, sf):
    df = E.export_wide(V.review_lines(spark, sf), stored(spark, sf), 3, "customer", history=V.history(spark, sf))
    return df.select("line_id", "name", "option1_price", "tax_unit", "total", "tax_total", "option1_manufacturer", "option2_price",
                     "option2_manufacturer", "option3_price")


@query("export_review", V.with_views(f"""SELECT l.line_id, {Q.replace('nullif(l.quantity,0)', 'l.quantity')} AS billing_quantity, e.estimate, array_to_string(l.warnings,'；') AS risk FROM rlines l LEFT JOIN
 (SELECT line_id, arg_min(final_price, rank) AS estimate FROM ropts WHERE selected AND list_contains(warnings,'估算价：按类目') GROUP BY 1) e ON e.line_id=l.line_id WHERE NOT l.confirmed"""))
def export_review(spark, sf):
    return E.export_review(*lines_options(spark, sf)).select("line_id", "billing_quantity", "estimate", "risk")


def ranked(spark, sf):
    o = V.review_options(spark, sf)
    return o.select("line_id", c("option_id").alias("id"), "score", "price", vendor_key(c("manufacturer"), c("brand")).alias("vendor"),
                    c("rank").alias("position"), "spec", "brand", "final_price", "selected", "source_file")


@query("distinct_vendors", V.with_views(f"""WITH v AS (SELECT line_id, option_id, score, {norm('manufacturer')} AS vendor FROM ropts WHERE score>=20), f AS (SELECT *, row_number() OVER (PARTITION BY line_id, vendor ORDER BY score DESC, option_id) AS n FROM v),
 g AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, option_id) AS option FROM f WHERE n=1) SELECT line_id, option_id AS id, CAST(option AS INTEGER) AS option FROM g WHERE option<=3"""))
def distinct_vendors(spark, sf):
    return X.distinct_vendors(ranked(spark, sf), 3, 20.0, [F.desc("score"), "id"]).select("line_id", "id", "option")


@query("rank_candidates", V.with_views("SELECT * FROM (SELECT line_id, option_id AS id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY score DESC, rank DESC, option_id) AS INTEGER) AS position FROM ropts) WHERE position<=3"))
def rank_candidates(spark, sf):
    from ..plans.match import rank_candidates as top

    df = ranked(spark, sf).withColumns({"c_spec": c("position").cast("double"), "r_source_priority": F.lit(0), "origin": F.lit(0),
                                        "strength": F.lit(0.0), "r_rowid": c("id")})
    return top(df, 3).select("line_id", "id", "position")


@query("prefilter_topk", V.with_views("SELECT * FROM (SELECT product_code AS line_id, id AS rowid_, CAST(row_number() OVER (PARTITION BY product_code ORDER BY price DESC, id) AS INTEGER) AS position FROM hist) WHERE position<=5"))
def prefilter_topk(spark, sf):
    from ..operators.candidates import prefilter_topk as top

    df = V.history(spark, sf).select(c("product_code").alias("line_id"), "rowid", c("price").alias("strength"))
    return top(df, 5).select("line_id", c("rowid").alias("rowid_"), "position")


def recursive(sql: str, first: str) -> str:
    """with_views for a statement whose first own table is recursive."""
    return V.with_views(sql).replace("WITH hist AS", "WITH RECURSIVE hist AS").replace(f"), RECURSIVE {first} AS", f"), {first} AS")


@query("price_clusters", recursive("""WITH RECURSIVE s AS (SELECT line_id, option_id, price, row_number() OVER (PARTITION BY line_id ORDER BY price, rank) AS n FROM ropts),
 w AS (SELECT line_id, option_id, price, n, 1 AS cluster, 1 AS place, price AS leader FROM s WHERE n=1 UNION ALL
  SELECT s.line_id, s.option_id, s.price, s.n, CASE WHEN abs(s.price-w.leader)/greatest(w.leader,1e-9)<=0.3 THEN w.cluster ELSE w.cluster+1 END, CASE WHEN abs(s.price-w.leader)/greatest(w.leader,1e-9)<=0.3 THEN w.place+1 ELSE 1 END,
  CASE WHEN abs(s.price-w.leader)/greatest(w.leader,1e-9)<=0.3 THEN w.leader ELSE s.price END FROM w JOIN s ON s.line_id=w.line_id AND s.n=w.n+1)
 SELECT line_id, option_id AS id, cluster, place FROM w""", "s"))
def price_clusters(spark, sf):
    df = ranked(spark, sf).withColumn("base", c("position"))
    return X.price_clusters(df, ["line_id"]).select("line_id", "id", "cluster", "place")


@query("dedup_options", V.with_views(f"SELECT line_id, option_id AS id FROM (SELECT line_id, option_id, row_number() OVER (PARTITION BY line_id, {norm('manufacturer')}, floor(final_price/1000), brand ORDER BY rank) AS n FROM ropts) WHERE n=1"))
def dedup_options(spark, sf):
    df = ranked(spark, sf).withColumns({"spec_key": c("brand"), "model_key": F.lit(""), "final_price": F.floor(c("final_price") / 1000)})
    return X.dedup_options(df, "position").select("line_id", "id")


@query("final_rank", V.with_views(f"""WITH f AS (SELECT {norm('manufacturer')} AS vendor, min(id) AS first FROM hist GROUP BY 1) SELECT line_id, option_id AS id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY selected DESC, CASE WHEN selected THEN first END NULLS LAST, rank) AS INTEGER) AS new_rank FROM ropts LEFT JOIN f ON f.vendor={norm('manufacturer')}"""))
def final_rank(spark, sf):
    vendors = X.vendor_order(V.history(spark, sf)).select("vendor", c("first_rowid").alias("vendor_first"))
    df = ranked(spark, sf).join(vendors, "vendor", "left").withColumn("rank", c("position"))
    return X.final_rank(df).select("line_id", "id", "new_rank")


@query("tie_alert", V.with_views("""WITH o AS (SELECT line_id, floor(score/10) AS s, price AS p, row_number() OVER (PARTITION BY line_id ORDER BY floor(score/10) DESC, option_id) AS n FROM ropts)
 SELECT a.line_id, coalesce(abs(a.s-b.s)<0.01 AND a.p<>b.p, false) AS tie FROM o a LEFT JOIN o b ON b.line_id=a.line_id AND b.n=2 WHERE a.n=1"""))
def tie_alert(spark, sf):
    df = ranked(spark, sf).withColumn("score", F.floor(c("score") / 10).cast("double"))
    df = df.withColumn("position", F.row_number().over(X.per_line().orderBy(F.desc("score"), "id")))
    return X.tie_alert(df)


@query("prefer_vendors", V.with_views("""SELECT line_id, option_id AS id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY score+CASE WHEN manufacturer IN ('Supplier#000000001','Supplier#000000002') THEN 3.0 ELSE 0.0 END DESC, score DESC, rank) AS INTEGER) AS position FROM ropts"""))
def prefer_vendors(spark, sf):
    liked = F.array(*[normalize_text(F.lit(v)) for v in ("Supplier#000000001", "Supplier#000000002")])
    df = ranked(spark, sf).withColumns({"preferred": liked, "c_spec": F.lit(0.0)})
    return X.prefer_vendors(df).select("line_id", "id", "position")


@query("keep_defaults", recursive(f"""WITH RECURSIVE s AS (SELECT line_id, brand, row_number() OVER (PARTITION BY line_id ORDER BY rank, option_id) AS n, {{'id': option_id, 'core': brand, 'price': price, 'vendor': {norm('manufacturer')}}} AS x FROM ropts),
 k AS (SELECT line_id, n, [x] AS kept FROM s WHERE n=1 UNION ALL SELECT s.line_id, s.n, CASE WHEN len([y for y in k.kept if y.core=s.x.core AND abs(s.x.price-y.price)/greatest(y.price,1e-9)<=0.3 AND (s.x.vendor='' OR y.vendor='' OR s.x.vendor=y.vendor)])>0
  THEN k.kept ELSE list_append(k.kept, s.x) END FROM k JOIN s ON s.line_id=k.line_id AND s.n=k.n+1),
 e AS (SELECT line_id, arg_max(kept, n) AS kept FROM k GROUP BY 1) SELECT line_id, y.id AS id FROM (SELECT line_id, unnest(kept) AS y FROM e)""", "s"))
def keep_defaults(spark, sf):
    df = ranked(spark, sf).select("line_id", c("position").alias("at"), "id", c("brand").alias("core"), "price", "vendor")
    return X.keep_defaults(df)


@query("diversify", recursive("""WITH RECURSIVE d AS (SELECT line_id, option_id, rank AS base, brand AS core, price, length(spec)%2=0 AS fits, arg_min(brand, CASE WHEN rank>1 THEN rank END) OVER (PARTITION BY line_id) AS line_core FROM ropts),
 r AS (SELECT *, bool_or(fits) OVER (PARTITION BY line_id, core) AS some_fit FROM d WHERE base>1), s AS (SELECT *, row_number() OVER (PARTITION BY line_id, core ORDER BY price, base, option_id) AS n FROM r WHERE fits OR NOT some_fit),
 w AS (SELECT line_id, core, line_core, option_id, n, 1 AS cluster, 1 AS place, price AS leader FROM s WHERE n=1 UNION ALL
  SELECT s.line_id, s.core, s.line_core, s.option_id, s.n, CASE WHEN abs(s.price-w.leader)/greatest(w.leader,1e-9)<=0.3 THEN w.cluster ELSE w.cluster+1 END, CASE WHEN abs(s.price-w.leader)/greatest(w.leader,1e-9)<=0.3 THEN w.place+1 ELSE 1 END,
  CASE WHEN abs(s.price-w.leader)/greatest(w.leader,1e-9)<=0.3 THEN w.leader ELSE s.price END FROM w JOIN s ON s.line_id=w.line_id AND s.core=w.core AND s.n=w.n+1),
 f AS (SELECT line_id, core, min(base) AS first_base FROM r GROUP BY ALL),
 u AS (SELECT line_id, option_id AS id, 0 AS k1, base AS k2, 0 AS k3 FROM d WHERE base=1 UNION ALL SELECT w.line_id, option_id, CASE WHEN w.core=line_core THEN 1 ELSE 2 END, CASE WHEN w.core=line_core THEN place ELSE n END,
  CASE WHEN w.core=line_core THEN cluster ELSE first_base END FROM w JOIN f ON f.line_id=w.line_id AND f.core=w.core)
 SELECT line_id, id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY k1, k2, k3, id) AS INTEGER) AS place FROM u""", "d"))
def diversify(spark, sf):
    own = F.min_by("brand", F.when(c("position") > 1, c("position"))).over(Window.partitionBy("line_id"))
    df = ranked(spark, sf).select("line_id", "id", c("position").alias("base"), (c("position") == 1).alias("is_default"), c("brand").alias("core"),
                                  own.alias("line_core"), "price", (F.length("spec") % 2 == 0).alias("category_fits"))
    return X.diversify(df)


@query("line_status", V.with_views("""SELECT line_id, CASE WHEN recommended_score<40 THEN 'unmatched' WHEN confidence<>'high' THEN 'review' ELSE 'suggested' END AS new_status,
 CASE WHEN recommended_score<40 THEN 'unreliable' WHEN confidence='unreliable' THEN 'low' WHEN confidence<>'high' THEN confidence ELSE 'high' END AS new_confidence FROM rlines"""))
def line_status(spark, sf):
    status, shown = X.line_status(c("recommended_score"), F.lit(False), c("confidence"), F.lit(False), MatchConfig())
    return V.review_lines(spark, sf).select("line_id", status.alias("new_status"), shown.alias("new_confidence"))


@query("confidence", V.with_views("SELECT line_id, CASE WHEN recommended_score<55 THEN 'unreliable' WHEN list_contains(warnings,'BLOCK: 单位不可直接换算') THEN 'review' WHEN recommended_score>=80 THEN 'high' WHEN recommended_score>=65 THEN 'medium' ELSE 'low' END AS band FROM rlines"))
def confidence(spark, sf):
    blocked = F.exists("warnings", lambda w: w.startswith("BLOCK:"))
    return V.review_lines(spark, sf).select("line_id", R.confidence(c("recommended_score"), blocked, MatchConfig()).alias("band"))


@query("flag_mid_price", V.with_views("""WITH m AS (SELECT line_id, median(price) AS mid FROM ropts GROUP BY 1) SELECT o.option_id, price>mid*3 OR price<mid/3 AS off FROM ropts o JOIN m ON m.line_id=o.line_id"""))
def flag_mid_price(spark, sf):
    from ..operators.stats import group_median

    o = V.review_options(spark, sf)
    mids = group_median(o, ["line_id"], "price", "mid").select("line_id", "mid")
    return o.join(mids, "line_id").select("option_id", R.flag_mid_price(c("price"), c("mid")).isNotNull().alias("off"))


@query("price_guard", V.with_views("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY price) AS rn, count(*) OVER (PARTITION BY line_id) AS n FROM ropts),
 m AS (SELECT line_id, max(n) AS n, median(price) AS med, bool_or(source_file<>'book3') AS other FROM n WHERE rn<=CASE WHEN n>=5 THEN greatest(3,floor(n*0.75)) ELSE n END GROUP BY 1),
 a AS (SELECT line_id, bool_or(source_file<>'book3') AS other FROM ropts GROUP BY 1)
 SELECT o.option_id, CASE WHEN m.n<3 THEN true WHEN o.source_file='book3' THEN NOT a.other OR o.price<=m.med*3.5 ELSE o.price>=m.med/2 AND o.price<=m.med*2 END AS guard_ok
 FROM ropts o JOIN m ON m.line_id=o.line_id JOIN a ON a.line_id=o.line_id"""))
def price_guard(spark, sf):
    from ..config import DEMO
    from ..functions.specs import UNITS

    none = F.struct(*[F.array().cast("array<double>").alias(u) for u in UNITS])
    df = V.review_options(spark, sf).select(
        "line_id", "option_id", c("price").alias("r_price"), F.lit(1.0).alias("dice"), none.alias("l_values"), none.alias("r_values"),
        F.lit("x").alias("l_core"), F.lit("x").alias("r_core"), (c("source_file") == DEMO.trusted_mark).alias("trusted"))
    return P.group_medians(df, DEMO, MatchConfig()).select("option_id", P.price_guard().alias("guard_ok"))


@query("union_first", V.with_views("SELECT line_id, option_id AS id, CASE WHEN selected THEN 0 ELSE 1 END AS origin FROM ropts"))
def union_first(spark, sf):
    from ..operators.candidates import union_first as first

    o = V.review_options(spark, sf).select("line_id", c("option_id").alias("id"), "selected")
    return first([o.filter("selected").drop("selected"), o.drop("selected")], ["line_id", "id"])
