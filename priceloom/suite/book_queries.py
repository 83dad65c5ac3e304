"""Price-book operators over the sample tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import DEMO
from ..operators import changes as CH
from ..operators import governance as G
from ..operators import reconcile as RC
from ..operators import review as RV
from ..operators import selection as X
from ..operators.backfill import backfill_specs, cluster_specs, spec_key
from ..operators.catalog import name_clashes, search_catalog
from ..session import settings, shared_dir
from ..sources import books as B
from ..sources import sheets as SH
from ..sources.cells import read_cells
from ..sources.exports import export_book
from ..streaming.jobs import audit_windows, settle_drafts
from . import views as V
from .registry import norm, query
from .row_queries import keyed

c = F.col
KEY = f"{norm('name')} AS k1, {norm('spec')} AS k2, {norm('unit')} AS k3, {norm('manufacturer')} AS k4, round(coalesce(price,0),4) AS k5"


@query("governance", V.with_views(f"""SELECT CAST(sum(n) AS BIGINT) AS record_count, count(*) AS unique_name_count, count(*) FILTER (n>1) AS duplicate_name_groups,
 count(*) FILTER (u>1) AS unit_conflict_groups, count(*) FILTER (p>1) AS price_conflict_groups, CAST(sum(m) AS BIGINT) AS missing_manufacturer_count,
 (SELECT count(*) FROM events) AS audit_event_count
 FROM (SELECT {norm('name')} AS k, count(*) n, count(DISTINCT {norm('unit')}) u, count(DISTINCT price) p, count(*) FILTER (manufacturer='') m FROM hist GROUP BY 1)"""))
def governance(spark, sf):
    return G.governance(V.history(spark, sf), V.table(spark, sf, "events"))


def dirty(spark, sf):
    """The book followed by the feed (same columns)."""
    h = V.history(spark, sf).select("id", "rowid", "name", "spec", "unit", "manufacturer", "brand", "model", "product_code", "price", "created_at")
    f = V.feed(spark, sf).filter("price IS NOT NULL").withColumn("created_at", F.lit("2030-01-01").cast("timestamp"))
    return h.unionByName(f.select(h.columns))


DIRTY = f"""dirty AS (SELECT id, name, spec, unit, manufacturer, price, created_at FROM hist UNION ALL SELECT id, name, spec, unit, manufacturer, price, TIMESTAMP '2030-01-01' FROM feed WHERE price IS NOT NULL),
 d AS (SELECT id, first_value(id) OVER (PARTITION BY k1,k2,k3,k4,k5 ORDER BY created_at, id) AS kept_id FROM (SELECT id, created_at, {KEY} FROM dirty))"""


@query("dedup_history", V.with_views(f"WITH {DIRTY} SELECT id AS removed_id, kept_id FROM d WHERE id<>kept_id"))
def dedup_history(spark, sf):
    return G.dedup_history(dirty(spark, sf))[1]


@query("redirect_refs", V.with_views(f"WITH {DIRTY} SELECT kept_id AS history_id, count(*) AS options FROM d WHERE id LIKE 'feed-%' GROUP BY kept_id"))
def redirect_refs(spark, sf):
    book = dirty(spark, sf)
    _, mapping = G.dedup_history(book)
    options = book.filter(c("id").startswith("feed-")).select(c("id").alias("history_id"))
    return G.redirect_refs(options, mapping).groupBy("history_id").agg(F.count(F.lit(1)).alias("options"))


IMPORT = f"""f AS (SELECT id, seq, price, has_price_column, {KEY}, (coalesce(price<=0,false) OR (price IS NULL AND has_price_column)) AS bad FROM feed),
 b AS (SELECT DISTINCT k1,k2,k3,k4,k5 FROM (SELECT {KEY} FROM hist)),
 o AS (SELECT f.id, CASE WHEN f.bad THEN 'invalid' WHEN b.k1 IS NOT NULL OR row_number() OVER (PARTITION BY f.k1,f.k2,f.k3,f.k4,f.k5,f.bad ORDER BY f.seq)>1 THEN 'duplicate' ELSE 'inserted' END AS outcome
  FROM f LEFT JOIN b ON b.k1=f.k1 AND b.k2=f.k2 AND b.k3=f.k3 AND b.k4=f.k4 AND b.k5=f.k5)"""


@query("import_history", V.with_views(f"WITH {IMPORT} SELECT id, outcome FROM o"))
def import_history(spark, sf):
    return G.classify_import(V.history(spark, sf), V.feed(spark, sf)).select("id", "outcome")


@query("imported_book", V.with_views(f"""WITH {IMPORT} SELECT id, name, spec, unit, manufacturer, product_code, price, source_file FROM hist UNION ALL
 SELECT n.id, n.name, n.spec, n.unit, n.manufacturer, n.product_code, coalesce(n.price,0), n.source_file FROM feed n JOIN o ON o.id=n.id WHERE outcome='inserted'"""))
def imported_book(spark, sf):
    rows = V.stored_rows(spark, sf)
    return G.import_history(V.history(spark, sf, rows), V.feed(spark, sf, rows))[0].select(
        "id", "name", "spec", "unit", "manufacturer", "product_code", "price", "source_file")


@query("import_report", V.with_views(f"WITH {IMPORT} SELECT outcome, count(*) AS rows FROM o GROUP BY outcome"))
def import_report(spark, sf):
    return G.import_history(V.history(spark, sf), V.feed(spark, sf))[1]


@query("anti_known", V.with_views(f"WITH {IMPORT} SELECT f.id FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k1=f.k1 AND b.k2=f.k2 AND b.k3=f.k3 AND b.k4=f.k4 AND b.k5=f.k5)"))
def anti_known(spark, sf):
    return G.anti_known(V.feed(spark, sf), V.history(spark, sf)).select("id")


def offer(spark, sf, rows=None):
    """The feed as a file whose sheets offer different identity columns."""
    f = V.feed(spark, sf, rows)
    full = F.array(*[F.lit(x) for x in RC.FILE_FIELDS])
    some = F.array(*[F.lit(x) for x in ("name", "spec", "unit", "price", "brand")])
    return f.withColumns({
        "name": F.when(c("source_row") == 6, F.concat("name", F.lit("x"))).otherwise(c("name")),
        "provided": F.when(c("source_sheet") == "legacy", full).otherwise(some)})


def offered(spark, sf):
    """(file, book) of rows that are joined once: both are read several times."""
    rows = V.stored_rows(spark, sf)
    return offer(spark, sf, rows), V.history(spark, sf, rows)


def ambiguous(spark, sf):
    file_rows, book = offered(spark, sf)
    return RC.ambiguous_targets(RC.reconcile(file_rows, book), book)


RECON = f"""f AS (SELECT seq, price, brand, source_sheet='legacy' AS fl, {norm("CASE WHEN source_row=6 THEN name||'x' ELSE name END")} AS k1, {norm('spec')} AS k2, {norm('unit')} AS k3, CASE WHEN source_sheet='legacy' THEN {norm('manufacturer')} ELSE '' END AS k4,
  CASE WHEN source_row=6 THEN name||'x' ELSE name END AS name, coalesce(price>0,false) AS ok FROM feed),
 h AS (SELECT id, name, price, brand, {norm('name')} AS k1, {norm('spec')} AS k2, {norm('unit')} AS k3, {norm('manufacturer')} AS k4 FROM hist),
 b AS (SELECT true AS fl, k1,k2,k3,k4, count(*) AS targets, min(id) AS target FROM h GROUP BY ALL UNION ALL SELECT false, k1,k2,k3,'', count(*), min(id) FROM h GROUP BY ALL),
 x AS (SELECT f.*, b.targets, b.target, min(CASE WHEN f.ok THEN f.seq END) OVER (PARTITION BY f.fl,f.k1,f.k2,f.k3,f.k4) AS first FROM f LEFT JOIN b ON b.fl=f.fl AND b.k1=f.k1 AND b.k2=f.k2 AND b.k3=f.k3 AND b.k4=f.k4),
 a1 AS (SELECT *, CASE WHEN NOT ok THEN 'invalid' WHEN seq<>first THEN 'duplicate' WHEN targets IS NULL THEN 'create' WHEN targets>1 THEN 'ambiguous' ELSE 'update' END AS a FROM x),
 a2 AS (SELECT *, CASE WHEN a='update' AND seq<>min(CASE WHEN a='update' THEN seq END) OVER (PARTITION BY CASE WHEN a='update' THEN target END) THEN 'duplicate' ELSE a END AS action FROM a1)"""


@query("reconcile", V.with_views(f"WITH {RECON} SELECT seq, action, CASE WHEN action='ambiguous' THEN greatest(targets-5,0) END AS hidden_targets, CASE WHEN targets=1 AND seq=first AND action IN ('update','duplicate') THEN target END AS target_id FROM a2"))
def reconcile(spark, sf):
    out = RC.reconcile(*offered(spark, sf))
    return out.select("seq", "action", "hidden_targets", "target_id")


@query("reconcile_summary", V.with_views(f"WITH {RECON} SELECT t.action, count(a2.seq) AS rows FROM (VALUES ('create'),('update'),('unchanged'),('ambiguous'),('duplicate'),('invalid')) t(action) LEFT JOIN a2 ON a2.action=t.action GROUP BY t.action"))
def reconcile_summary(spark, sf):
    return RC.action_summary(RC.reconcile(*offered(spark, sf)))


@query("ambiguous_targets", V.with_views(f"""WITH {RECON}, r AS (SELECT true AS fl, k1,k2,k3,k4, id, row_number() OVER (PARTITION BY k1,k2,k3,k4 ORDER BY id) AS position FROM h
  UNION ALL SELECT false, k1,k2,k3,'', id, row_number() OVER (PARTITION BY k1,k2,k3 ORDER BY id) FROM h)
 SELECT seq, CAST(position AS INTEGER) AS position, id FROM a2 JOIN r ON r.fl=a2.fl AND r.k1=a2.k1 AND r.k2=a2.k2 AND r.k3=a2.k3 AND r.k4=a2.k4 WHERE action='ambiguous' AND position<=5"""))
def ambiguous_targets(spark, sf):
    return ambiguous(spark, sf).select("seq", "position", "id")


@query("ambiguous_merges", V.with_views(f"""WITH {RECON}, r AS (SELECT true AS fl, *, row_number() OVER (PARTITION BY {norm('name')},{norm('spec')},{norm('unit')},{norm('manufacturer')} ORDER BY id) AS position FROM hist
  UNION ALL SELECT false, *, row_number() OVER (PARTITION BY {norm('name')},{norm('spec')},{norm('unit')} ORDER BY id) FROM hist),
 m AS (SELECT a2.seq, r.position, r.id, r.source_file, r.source_row, r.fl, a2.name AS fname, a2.price AS fprice, a2.brand AS fbrand, o.manufacturer AS fman, o.product_code AS fcode, r.name, r.price, r.brand, r.manufacturer, r.product_code
  FROM a2 JOIN feed o ON o.seq=a2.seq JOIN r ON r.fl=a2.fl AND {norm('r.name')}=a2.k1 AND {norm('r.spec')}=a2.k2 AND {norm('r.unit')}=a2.k3 AND (NOT r.fl OR {norm('r.manufacturer')}=a2.k4) WHERE action='ambiguous' AND r.position<=5)
 SELECT seq, CAST(position AS INTEGER) AS position, id, source_file, source_row, fname AS merged_name, fprice AS merged_price, CASE WHEN fl THEN fman ELSE manufacturer END AS merged_manufacturer, price AS current_price,
  array_to_string(list_filter([CASE WHEN fname IS DISTINCT FROM name THEN 'name' END, CASE WHEN fl AND fman IS DISTINCT FROM manufacturer THEN 'manufacturer' END, CASE WHEN fbrand IS DISTINCT FROM brand THEN 'brand' END, CASE WHEN fl AND fcode IS DISTINCT FROM product_code THEN 'product_code' END,
   CASE WHEN fprice IS DISTINCT FROM price THEN 'price' END], lambda x: x IS NOT NULL), ',') AS changed FROM m"""))
def ambiguous_merges(spark, sf):
    found = ambiguous(spark, sf)
    order = F.array(*[F.lit(f) for f in ("name", "manufacturer", "brand", "product_code", "price")])
    changed = F.filter(order, lambda f: F.array_contains("changed", f))
    return found.select("seq", "position", "id", "source_file", "source_row", "merged_name", "merged_price", "merged_manufacturer", "current_price",
                        F.array_join(changed, ",").alias("changed"))


@query("claim_targets", V.with_views("SELECT id AS seq, product_code AS target_id, min(id) OVER (PARTITION BY product_code) AS claimed_by FROM hist"))
def claim_targets(spark, sf):
    return RC.claim_targets(V.history(spark, sf).select(c("id").alias("seq"), c("product_code").alias("target_id"))).select("seq", "target_id", "claimed_by")


@query("diff_fields", V.with_views("""SELECT id, array_to_string(list_filter([CASE WHEN unit='kg' THEN 'name' END, CASE WHEN source_row=1 THEN 'brand' END, CASE WHEN price<>floor(price) THEN 'price' END], lambda x: x IS NOT NULL), ',') AS changed FROM hist"""))
def diff_fields(spark, sf):
    h = V.history(spark, sf).select("id", "name", "brand", "price", "unit", "source_row")
    df = h.select("id", *[c(f).alias(f"a_{f}") for f in ("name", "brand", "price")],
                  F.when(c("unit") == "kg", F.upper("name")).otherwise(c("name")).alias("b_name"),
                  F.when(c("source_row") != 1, c("brand")).alias("b_brand"), F.floor("price").cast("double").alias("b_price"))
    return df.select("id", F.array_join(RC.diff_fields("a_", "b_", ["name", "brand", "price"]), ",").alias("changed"))


def change_set(spark, sf, rows=None):
    """One change per book row: delete, move the price, clash with itself, stale or invalid."""
    h = V.history(spark, sf, rows)
    none = F.lit(None)
    kind = c("source_row")
    same = {f: none.cast("double" if f in ("price", "quantity") else "string") for f in CH.EDITABLE}
    return h.select(
        F.xxhash64("id").alias("_h"), "id", kind.alias("kind"), c("price").alias("old"), "rowid").select(
        c("rowid").alias("seq"), F.when(c("kind") == 1, "delete").otherwise("update").alias("op"),
        F.when(c("kind") == 2, F.concat(F.lit("no-"), "id")).otherwise(c("id")).alias("id"),
        F.when(c("kind") == 3, 7).when(c("kind") == 4, 1).cast("int").alias("revision"),
        F.when(c("kind") == 5, 1).otherwise(0).alias("bad_fields"),
        *[(F.when(c("kind") == 6, -c("old")).when(c("kind") == 7, c("old") + 200000.0) if f == "price" else v).alias(f) for f, v in same.items()])


CHANGED = """SELECT rowid AS seq, op, id, status, reason FROM (SELECT id AS rowid, CASE WHEN source_row=1 THEN 'delete' ELSE 'update' END AS op,
 CASE WHEN source_row=2 THEN 'no-'||id ELSE id END AS id,
 CASE source_row WHEN 2 THEN 'rejected' WHEN 3 THEN 'conflict' WHEN 5 THEN 'rejected' WHEN 6 THEN 'rejected' ELSE 'ok' END AS status,
 CASE source_row WHEN 2 THEN 'missing' WHEN 3 THEN 'revision_mismatch' WHEN 5 THEN 'invalid' WHEN 6 THEN 'invalid' END AS reason FROM hist) t"""


@query("apply_changes", V.with_views(CHANGED))
def apply_changes(spark, sf):
    rows = V.stored_rows(spark, sf)
    book = V.history(spark, sf, rows).withColumn("revision", F.lit(1))
    _, results = CH.apply_changes(book, change_set(spark, sf, rows))
    return results.select("seq", "op", "id", "status", "reason")


def second_edits(spark, sf, rows=None):
    """A further update of deleted and of moved rows, with the revision both had at the start."""
    h = V.history(spark, sf, rows).filter("source_row IN (1, 7)")
    return h.select(F.concat("rowid", F.lit("#2")).alias("seq"), F.lit("update").alias("op"), "id", F.lit(1).alias("revision"), F.lit(0).alias("bad_fields"),
                    *[(c("price") + 1.0 if f == "price" else F.lit(None).cast("double" if f == "quantity" else "string")).alias(f) for f in CH.EDITABLE])


def changed(spark, sf):
    rows = V.stored_rows(spark, sf)
    book = V.history(spark, sf, rows).withColumn("revision", F.lit(1))
    return CH.apply_changes(book, change_set(spark, sf, rows).unionByName(second_edits(spark, sf, rows)))


@query("changed_book", V.with_views("""SELECT id, name, spec, unit, manufacturer, CASE WHEN source_row=7 THEN price+200000.0 ELSE price END AS price,
 CAST(CASE WHEN source_row=7 THEN 2 ELSE 1 END AS INTEGER) AS revision FROM hist WHERE source_row<>1"""))
def changed_book(spark, sf):
    return changed(spark, sf)[0].select("id", "name", "spec", "unit", "manufacturer", "price", "revision")


@query("repeated_edits", V.with_views("""SELECT id||'#2' AS seq, CASE WHEN source_row=1 THEN 'missing' ELSE 'revision_mismatch' END AS reason,
 CASE WHEN source_row=1 THEN 'rejected' ELSE 'conflict' END AS status FROM hist WHERE source_row IN (1,7)"""))
def repeated_edits(spark, sf):
    return changed(spark, sf)[1].filter(c("seq").endswith("#2")).select("seq", "reason", "status")


@query("add_manual_rows", V.with_views("SELECT source_priority, count(*) AS rows, CAST(round(sum(price),2) AS DECIMAL(20,2))::VARCHAR AS total FROM (SELECT source_priority, price FROM hist UNION ALL SELECT 0, CAST(round(p_retailprice,2) AS DOUBLE) FROM part) GROUP BY 1"))
def add_manual_rows(spark, sf):
    pt = V.table(spark, sf, "part")
    rows = pt.select(F.concat(F.lit("manual:"), c("p_partkey").cast("string")).alias("id"), c("p_name").alias("name"), c("p_type").alias("spec"),
                     F.lit("").alias("model"), c("p_brand").alias("brand"), F.lit("").alias("manufacturer"), F.lit("pc").alias("unit"),
                     F.lit("").alias("product_code"), F.lit("manual").alias("source_file"), c("p_retailprice").alias("price"))
    out = G.add_manual_rows(V.history(spark, sf), rows)
    total = F.sum(F.round("price", 2).cast("decimal(18,2)")).cast("decimal(20,2)").cast("string")
    return out.groupBy("source_priority").agg(F.count(F.lit(1)).alias("rows"), total.alias("total"))


@query("code_grades", V.with_views("SELECT product_code AS code_key, array_to_string(list_sort(list_distinct(list(CASE WHEN source_sheet LIKE 'new%' THEN 'new' ELSE '' END))), ',') AS grades FROM hist GROUP BY 1"))
def code_grades(spark, sf):
    return G.code_grades(V.history(spark, sf), DEMO).select("code_key", F.array_join("grades", ",").alias("grades"))


@query("grade_vote", V.with_views("""WITH codes AS (SELECT DISTINCT product_code FROM hist WHERE source_sheet='new standard'), v AS (SELECT job_id, count(*) AS votes FROM inq WHERE product_code<>'' AND product_code IN (SELECT product_code FROM codes) GROUP BY job_id)
 SELECT j.job_id, coalesce(votes,0) AS votes, CASE WHEN votes>=3 THEN 'new' ELSE '' END AS job_grade FROM (SELECT DISTINCT job_id FROM inq) j LEFT JOIN v ON v.job_id=j.job_id"""))
def grade_vote(spark, sf):
    return X.grade_vote(keyed(V.inquiry(spark, sf)), keyed(V.history(spark, sf)), DEMO)


@query("vendor_order", V.with_views(f"SELECT {norm('manufacturer')} AS vendor, min(id) AS first_rowid, CAST(row_number() OVER (ORDER BY min(id)) AS INTEGER) AS position FROM hist GROUP BY 1"))
def vendor_order(spark, sf):
    return X.vendor_order(V.history(spark, sf))


@query("source_profile", V.with_views(f"SELECT source_file, source_sheet, count(*) AS records, count(DISTINCT {norm('name')}) AS unique_names FROM hist GROUP BY 1,2"))
def source_profile(spark, sf):
    return B.source_profile(V.history(spark, sf))


@query("consolidate_sources", """SELECT source_priority, name, count(*) AS rows FROM (SELECT 1 AS source_priority, p_name AS name FROM part WHERE p_retailprice>0
 UNION ALL SELECT 2, s_name FROM supplier WHERE s_acctbal>0) GROUP BY 1,2""")
def consolidate_sources(spark, sf):
    pt, su = V.table(spark, sf, "part"), V.table(spark, sf, "supplier")
    out = B.consolidate_sources([
        (pt.withColumn("empty", F.lit("")), 1, {"name": ["empty", "p_name"], "price": ["p_retailprice"], "brand": ["p_brand"]}),
        (su, 2, {"name": ["s_name"], "price": ["s_acctbal"]})])
    return out.groupBy("source_priority", "name").agg(F.count(F.lit(1)).alias("rows"))


def jobs(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select(c("o_orderkey").alias("job_id"), F.when(c("o_custkey") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit("book"), (c("o_custkey") % 12).cast("string"))).alias("database_key"))


BOUND = "bound AS (SELECT o_orderkey AS job_id, CASE WHEN o_custkey%3=0 OR o_custkey%12>9 THEN 'book0' ELSE 'book'||(o_custkey%12) END AS database_key FROM orders)"


@query("bind_books", f"WITH {BOUND} SELECT job_id, database_key FROM bound")
def bind_books(spark, sf):
    hist = V.history(spark, sf).withColumn("database_key", c("source_file"))
    return B.bind_books(jobs(spark, sf), hist, "book0").select("job_id", "database_key")


@query("bound_history", V.with_views(f"WITH {BOUND} SELECT source_file AS database_key, count(*) AS rows FROM hist WHERE source_file IN (SELECT database_key FROM bound) GROUP BY 1"))
def bound_history(spark, sf):
    hist = V.history(spark, sf).withColumn("database_key", c("source_file"))
    return B.load_bound(B.bind_books(jobs(spark, sf), hist, "book0"), hist).groupBy("database_key").agg(F.count(F.lit(1)).alias("rows"))


@query("catalog_stats", V.with_views(f"WITH {BOUND} SELECT h.database_key, h.records, coalesce(j.jobs,0) AS jobs FROM (SELECT source_file AS database_key, count(*) AS records FROM hist GROUP BY 1) h LEFT JOIN (SELECT database_key, count(*) AS jobs FROM bound GROUP BY 1) j ON j.database_key=h.database_key"))
def catalog_stats(spark, sf):
    hist = V.history(spark, sf).withColumn("database_key", c("source_file"))
    return B.catalog_stats(hist, B.bind_books(jobs(spark, sf), hist, "book0"))


def catalog(spark, sf):
    s = V.table(spark, sf, "supplier")
    k = c("s_suppkey")
    return s.select(
        F.concat(F.lit("db_"), k.cast("string")).alias("key"), c("s_name").alias("display_name"),
        F.when(k % 9 == 0, "see supplier 7").otherwise("").alias("note"), F.array(F.concat(F.lit("t"), (k % 8).cast("string"))).alias("tags"),
        F.when(k % 11 == 0, "archived").otherwise("active").alias("status"), (k % 6).cast("int").alias("use_count"),
        F.when(k % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 50).cast("int"))).alias("last_used_at"),
        F.date_add(F.lit("2024-01-15").cast("date"), (k % 40).cast("int")).alias("created_at"))


@query("search_catalog", """SELECT key, relevance FROM (SELECT *, CASE WHEN n LIKE 'supplier#000000007%' THEN 100 WHEN contains(n,'supplier#000000007') THEN 60 WHEN contains(key,'supplier#000000007') THEN 40 WHEN note<>'' AND contains('seesupplier7','supplier#000000007') THEN 15 ELSE 0 END AS relevance
 FROM (SELECT 'db_'||s_suppkey AS key, lower(s_name) AS n, CASE WHEN s_suppkey%9=0 THEN 'x' ELSE '' END AS note, s_suppkey%11=0 AS archived FROM supplier)) WHERE relevance>0 AND NOT archived""")
def search_catalog_query(spark, sf):
    return search_catalog(catalog(spark, sf), "Supplier# 000000007", 5).select("key", "relevance")


@query("recent_catalog", """SELECT key FROM (SELECT 'db_'||s_suppkey AS key, s_name, s_suppkey%6 AS uses, CASE WHEN s_suppkey%5<>0 THEN DATE '2024-01-01'+CAST(s_suppkey%50 AS INTEGER) ELSE DATE '2024-01-15'+CAST(s_suppkey%40 AS INTEGER) END AS r FROM supplier WHERE s_suppkey%11<>0 ORDER BY r DESC, uses DESC, s_name LIMIT 5)""")
def recent_catalog(spark, sf):
    return search_catalog(catalog(spark, sf), "", 5).select("key")


@query("name_clashes", "SELECT regexp_replace(lower(p_name),'[ _.-]+','','g') AS name_key, count(*) AS books FROM part GROUP BY 1 HAVING count(*)>1")
def clashes(spark, sf):
    return name_clashes(V.table(spark, sf, "part").select(c("p_name").alias("display_name")))


def sheet_cells(spark, sf):
    """part as ragged sheets: one file per brand, a header row, then one row per part."""
    pt = V.table(spark, sf, "part")
    labels = ["序号", "产品名称", "参数", "单位", "含税单价", "品牌1", "厂家1", "品牌2"]
    keys = pt.select(c("p_brand").alias("file"), c("p_type").alias("sheet"))
    head = keys.distinct().select("file", "sheet", F.lit(1).alias("row"), F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("at", "value"))
    body = pt.select(c("p_brand").alias("file"), c("p_type").alias("sheet"), (c("p_partkey") + 2).cast("int").alias("row"), F.posexplode(F.array(
        c("p_partkey").cast("string"), c("p_name"), F.concat(c("p_size").cast("string"), F.lit("mm")), F.lit("个"), c("p_retailprice").cast("string"),
        c("p_brand"), F.when(c("p_size") % 2 == 0, "acme").otherwise(""), F.when(c("p_size") % 3 == 0, "other").otherwise(""))).alias("at", "value"))
    return head.unionByName(body).filter("value != ''").select("file", "sheet", "row", (c("at") + 1).alias("col"), "value")


@query("detect_headers", "SELECT DISTINCT p_brand AS file, p_type AS sheet, CAST(1 AS INTEGER) AS header_row, CAST(2 AS INTEGER) AS name_col, CAST(5 AS INTEGER) AS price_col FROM part")
def detect_headers(spark, sf):
    found = SH.detect_headers(sheet_cells(spark, sf), price=True)
    return found.select("file", "sheet", "header_row", c("cols.name").alias("name_col"), c("cols.price").alias("price_col"))


BOOKED = """SELECT p_brand AS file, CAST(p_partkey+2 AS INTEGER) AS source_row, p_name AS name, CAST(p_size AS VARCHAR)||'mm' AS spec, CAST(round(CAST(CAST(p_retailprice/1.1::DOUBLE AS VARCHAR) AS DECIMAL(38,18)),2) AS DOUBLE) AS price, vendor_group, brand, manufacturer FROM (
 SELECT *, '1' AS vendor_group, p_brand AS brand, CASE WHEN p_size%2=0 THEN 'acme' ELSE '' END AS manufacturer FROM part UNION ALL SELECT *, '2', 'other', '' FROM part WHERE p_size%3=0)"""


@query("extract_history", BOOKED)
def extract_history(spark, sf):
    df = SH.extract_history(sheet_cells(spark, sf))
    return df.select("file", "source_row", "name", "spec", "price", "vendor_group", "brand", "manufacturer")


@query("extract_inquiry", "SELECT p_brand AS file, CAST(p_partkey+2 AS INTEGER) AS source_row, p_name AS name, CAST(p_size AS VARCHAR)||'mm' AS spec, '个' AS unit FROM part")
def extract_inquiry(spark, sf):
    return SH.extract_inquiry(sheet_cells(spark, sf)).select("file", "source_row", "name", "spec", "unit")


@query("headerless_sheets", "SELECT DISTINCT p_brand AS file, p_type AS sheet, 'no_header' AS reason FROM part WHERE p_brand LIKE '%1'")
def headerless_sheets(spark, sf):
    """The sheets of part, of which some lost their header row."""
    return SH.headerless_sheets(sheet_cells(spark, sf).filter((c("row") > 1) | ~c("file").endswith("1")), price=True)


def long_sheet(spark, sf):
    """part as one sheet with a section of other columns every 100 parts."""
    pt = V.table(spark, sf, "part").withColumn("_section", F.floor(c("p_partkey") / 100))
    odd = c("_section") % 2 == 1
    labels = F.when(odd, F.array(*map(F.lit, ["序号", "品名", "参数", "含税单价"]))).otherwise(F.array(*map(F.lit, ["名称", "名称", "参数", "单价"])))
    head = pt.select("_section").distinct().select((c("_section") * 101 + 1).cast("int").alias("row"), F.posexplode(labels).alias("at", "value"))
    body = pt.select((c("p_partkey") + c("_section") + 2).cast("int").alias("row"), F.posexplode(F.array(
        F.when(odd, c("p_partkey").cast("string")).otherwise(c("p_name")), F.when(odd, c("p_name")).otherwise(""),
        F.concat(c("p_size").cast("string"), F.lit("mm")), c("p_retailprice").cast("string"))).alias("at", "value"))
    return head.unionByName(body).filter("value != ''").select(F.lit("part.csv").alias("file"), F.lit("part").alias("sheet"), "row", (c("at") + 1).alias("col"), "value")


@query("sheet_sections", """SELECT CAST(p_partkey+p_partkey//100+2 AS INTEGER) AS source_row, p_name AS name, CAST(p_size AS VARCHAR)||'mm' AS spec,
 CASE WHEN (p_partkey//100)%2=1 THEN CAST(round(CAST(CAST(p_retailprice/1.1::DOUBLE AS VARCHAR) AS DECIMAL(38,18)),2) AS DOUBLE) ELSE p_retailprice END AS price FROM part""")
def sheet_sections(spark, sf):
    return SH.extract_history(long_sheet(spark, sf)).select("source_row", "name", "spec", "price")


@query("read_book_files", "SELECT p_name AS name, CAST(p_size AS VARCHAR)||'mm' AS spec, p_retailprice AS price, p_brand AS brand FROM part")
def read_book_files(spark, sf):
    """part written as GBK and UTF-8 files, then read back through cells."""
    root = f"{shared_dir(spark)}/books-{uuid.uuid4().hex}"
    pt = V.table(spark, sf, "part")
    out = pt.select(c("p_name").alias("器材名称"), F.concat(c("p_size").cast("string"), F.lit("mm")).alias("规格参数"), c("p_retailprice").alias("单价"), c("p_brand").alias("品牌"))
    older = F.xxhash64("器材名称") % 2 == 0
    out.filter(older).repartition(2, "器材名称").write.option("header", True).csv(f"{root}/utf-8")
    with settings(spark, {"spark.sql.legacy.javaCharsets": "true"}):
        out.filter(~older).repartition(2, "器材名称").write.option("header", True).option("encoding", "GBK").csv(f"{root}/gbk")
    cells = read_cells(spark, f"{root}/*/*.csv")
    return SH.extract_history(cells).select("name", "spec", "price", "brand")


@query("load_seed", V.with_views(f"SELECT source_file, count(*) AS records FROM (SELECT source_file, row_number() OVER (PARTITION BY k1,k2,k3,k4,k5 ORDER BY source_file, source_sheet, source_row, id) AS n FROM (SELECT source_file, source_sheet, source_row, id, {KEY} FROM hist)) WHERE n=1 GROUP BY 1"))
def load_seed(spark, sf):
    root = f"{shared_dir(spark)}/seed-{uuid.uuid4().hex}"
    h = V.history(spark, sf)
    h.select(*[c(b).alias(a) for a, b in B.SEED_FIELDS.items()]).write.option("compression", "gzip").option("maxRecordsPerFile", 1_000_000).json(root)
    return B.load_seed(spark, root).groupBy("source_file").agg(F.count(F.lit(1)).alias("records"))


@query("export_book", V.with_views("""SELECT id, name, CASE WHEN source_row=2 THEN 1.5 ELSE price END AS price, source_file||' · '||source_sheet||' · 第'||source_row||'行' AS source FROM hist WHERE source_row<>1
 UNION ALL SELECT 'new-'||s_suppkey, s_name, 2.0, '表格编辑（未保存）' FROM supplier"""))
def export_book_query(spark, sf):
    h = V.history(spark, sf)
    fields = {"name": "string", "spec": "string", "model": "string", "brand": "string", "manufacturer": "string", "unit": "string",
              "product_code": "string", "price": "double", "quantity": "double", "quote_date": "string"}
    blank = [F.lit(None).cast(t).alias(f) for f, t in fields.items()]
    gone = h.filter("source_row = 1").select(F.lit("delete").alias("op"), "id", *blank)
    moved = h.filter("source_row = 2").select(F.lit("update").alias("op"), "id", *blank).withColumn("price", F.lit(1.5))
    new = V.table(spark, sf, "supplier").select(F.lit("create").alias("op"), F.concat(F.lit("new-"), c("s_suppkey").cast("string")).alias("id"), *blank).withColumn("price", F.lit(2.0))
    new = new.withColumn("name", F.concat(F.lit("Supplier#"), F.lpad(F.substring_index("id", "-", -1), 9, "0")))
    return export_book(h, gone.unionByName(moved).unionByName(new)).select("id", "name", "price", "source")


@query("search_history", V.with_views("SELECT id, name, source_priority FROM (SELECT * FROM hist WHERE contains(lower(name),'ring') OR contains(lower(spec),'ring') OR contains(lower(brand),'ring') OR contains(lower(manufacturer),'ring') ORDER BY source_priority DESC, source_row, id LIMIT 30)"))
def search_history(spark, sf):
    return RV.search_history(V.history(spark, sf), "Ring", 30).select("id", "name", "source_priority")


@query("list_rows", V.with_views("SELECT id, price FROM (SELECT * FROM hist WHERE contains(lower(brand),'brand#1') ORDER BY price DESC, id LIMIT 100 OFFSET 100)"))
def list_rows(spark, sf):
    return RV.list_rows(V.history(spark, sf), "Brand#1", "price", "desc", page=2, size=100).select("id", "price")


@query("audit_windows", "SELECT date_trunc('day', ts) AS window_start, event_type AS action, count(*) AS events FROM events GROUP BY 1,2")
def audit(spark, sf):
    return audit_windows(V.table(spark, sf, "events").select("ts", c("event_type").alias("action")), "1 day")


@query("recent_audit", "SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 50)")
def recent_audit(spark, sf):
    return RV.recent(V.table(spark, sf, "events"), "ts", 50, tie="event_id").select("event_id", "event_type")


def drafts(spark, sf):
    ev = V.table(spark, sf, "events")
    kind = c("event_type")
    return ev.select(
        c("event_id").alias("draft_id"), (c("user_id") % 20).alias("line_id"), F.floor("value").cast("double").alias("confirmed_price"),
        F.when(kind == "purchase", "approved").when(kind == "error", "rejected").otherwise("pending").alias("status"),
        kind.alias("name"), F.lit("").alias("spec"), F.lit("pc").alias("unit"), (c("user_id") % 3).cast("string").alias("manufacturer"))


@query("settle_drafts", """WITH d AS (SELECT event_id AS draft_id, user_id%20 AS line_id, floor(value) AS p, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS status, event_type AS name, user_id%3 AS m FROM events),
 f AS (SELECT *, min(CASE WHEN status<>'rejected' THEN draft_id END) OVER (PARTITION BY line_id, p) AS first FROM d),
 a AS (SELECT *, status='approved' AND draft_id=first AS ap FROM f), l AS (SELECT *, min(CASE WHEN ap THEN draft_id END) OVER (PARTITION BY name, m, p) AS lead FROM a)
 SELECT draft_id, CASE WHEN status='rejected' THEN 'rejected' WHEN draft_id<>first THEN 'repeated' WHEN status='pending' THEN 'pending' WHEN lead<>draft_id THEN 'already_in_book' ELSE 'promoted' END AS outcome FROM l""")
def drafts_query(spark, sf):
    return settle_drafts(drafts(spark, sf), V.history(spark, sf))[0].select("draft_id", "outcome")


@query("cluster_specs")
def cluster(spark, sf):
    h = V.history(spark, sf).groupBy(c("brand").alias("name"), spec_key(c("spec")).alias("key")).agg(F.min("rowid").alias("first"))
    return cluster_specs(h)


@query("backfill_specs")
def backfill(spark, sf):
    lines = V.inquiry(spark, sf)
    options = lines.select("line_id", F.substring_index("line_id", "/", 1).alias("record_name"), c("spec").alias("inquiry_spec"))
    book = V.history(spark, sf).withColumn("spec", F.upper("spec"))
    return backfill_specs(options, book).select("line_id", "record_name", "filled_spec")

