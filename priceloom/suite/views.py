"""The sample tables seen as a price book, inquiry lines, customers and so on.

Each view exists twice: as a DataFrame and as the same definition in SQL for the
correctness check.  All read whole tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pad(c, width: int):
    return F.lpad(c.cast("string"), width, "0")


def code5(c):
    text = c.cast("string")
    return F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)


def book_rows(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with what its part and supplier say, as it stands in the tables."""
    li, pt, su = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    c = F.col
    df = li.join(pt, c("l_partkey") == c("p_partkey")).join(su, c("l_suppkey") == c("s_suppkey"))
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate",
        "p_partkey", "p_name", "p_type", "p_size", "p_brand", "s_name")


def stored_rows(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The rows of ``book_rows`` written once, some columns or all, for queries that read the book several times.

    Each reading would join the three tables again, which moves every line item where parts are too many to broadcast.
    """
    rows = book_rows(spark, sf)
    return materialize(rows.select(*columns) if columns else rows, "book_rows", "zstd")


def history(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """lineitem with part and supplier as one price observation per row; ``rows``: where they are joined already."""
    c = F.col
    cents = F.round(c("l_extendedprice") * 100).cast("bigint")
    qty = c("l_quantity").cast("bigint")
    price = F.expr("(2 * cents + qty) div (2 * qty)").cast("double") / 100.0
    rowid = F.concat(_pad(c("l_orderkey"), 12), F.lit("-"), c("l_linenumber").cast("string"), F.lit("-"),
                     _pad(c("l_partkey"), 10), F.lit("-"), _pad(c("l_suppkey"), 8))
    df = (book_rows(spark, sf) if rows is None else rows).withColumns({"cents": cents, "qty": qty})
    return df.select(
        rowid.alias("id"), rowid.alias("rowid"), c("p_name").alias("name"),
        F.concat(c("p_type"), F.lit(" "), c("p_size").cast("string"), F.lit("mm")).alias("spec"),
        code5(c("p_partkey")).alias("product_code"), F.lit("").alias("model"),
        c("p_brand").alias("brand"), c("s_name").alias("manufacturer"),
        F.when(c("l_returnflag") == "A", "kg").when(c("l_returnflag") == "N", "g").otherwise("box").alias("unit"),
        price.alias("price"), c("l_quantity").alias("quantity"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("quote_date"),
        F.concat(F.lit("book"), (c("l_suppkey") % 10).cast("string")).alias("source_file"),
        F.when(c("l_linestatus") == "O", "new standard").otherwise("legacy").alias("source_sheet"),
        c("l_linenumber").alias("source_row"), (c("l_suppkey") % 3).cast("int").alias("source_priority"),
        c("l_shipdate").alias("created_at"), c("l_orderkey").alias("orderkey"),
    )


HISTORY_SQL = """
SELECT lpad(CAST(l_orderkey AS VARCHAR),12,'0')||'-'||CAST(l_linenumber AS VARCHAR)||'-'||lpad(CAST(l_partkey AS VARCHAR),10,'0')||'-'||lpad(CAST(l_suppkey AS VARCHAR),8,'0') AS id,
 lpad(CAST(l_orderkey AS VARCHAR),12,'0')||'-'||CAST(l_linenumber AS VARCHAR)||'-'||lpad(CAST(l_partkey AS VARCHAR),10,'0')||'-'||lpad(CAST(l_suppkey AS VARCHAR),8,'0') AS rowid_,
 p_name AS name, p_type||' '||CAST(p_size AS VARCHAR)||'mm' AS spec,
 CASE WHEN length(CAST(p_partkey AS VARCHAR))<5 THEN lpad(CAST(p_partkey AS VARCHAR),5,'0') ELSE CAST(p_partkey AS VARCHAR) END AS product_code,
 '' AS model, p_brand AS brand, s_name AS manufacturer,
 CASE l_returnflag WHEN 'A' THEN 'kg' WHEN 'N' THEN 'g' ELSE 'box' END AS unit,
 ((2*CAST(round(l_extendedprice*100) AS BIGINT)+CAST(l_quantity AS BIGINT))//(2*CAST(l_quantity AS BIGINT)))/100.0::DOUBLE AS price,
 l_quantity AS quantity, strftime(l_shipdate,'%Y-%m-%d') AS quote_date,
 'book'||CAST(l_suppkey%10 AS VARCHAR) AS source_file,
 CASE WHEN l_linestatus='O' THEN 'new standard' ELSE 'legacy' END AS source_sheet,
 l_linenumber AS source_row, CAST(l_suppkey%3 AS INTEGER) AS source_priority, l_shipdate AS created_at, l_orderkey AS orderkey
FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey"""


def inquiry(spark: SparkSession, sf: str) -> DataFrame:
    """One inquiry line per (name, brand) asked for in ``part``, written untidily."""
    pt = table(spark, sf, "part")
    c = F.col
    brand_no = F.regexp_extract("p_brand", "(\\d+)$", 1).cast("int")
    g = pt.groupBy("p_name", "p_brand").agg(
        F.min("p_type").alias("t"), F.min("p_size").alias("s"), F.min("p_partkey").alias("k"),
        F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("q")).withColumn("b", brand_no)
    noun = F.substring_index("p_name", " ", -1)
    adjective = F.substring_index("p_name", " ", 1)
    return g.select(
        F.concat("p_name", F.lit("/"), "p_brand").alias("line_id"),
        F.concat(F.upper(adjective), F.lit("-"), noun,
                 F.when(c("b") % 7 == 0, "s").when(c("b") % 2 == 0, F.concat(F.lit(" "), (c("b") % 10).cast("string"))).otherwise("")).alias("name"),
        F.concat(F.lower("t"), F.lit(", "), c("s").cast("string"), F.lit(" mm")).alias("spec"),
        F.when(c("b") % 3 == 0, code5(c("k"))).otherwise("").alias("product_code"),
        F.lit("").alias("model"), c("p_brand").alias("brand"), F.lit("").alias("manufacturer"),
        F.when(c("b") % 4 == 0, "g").when(c("b") % 4 == 1, "kg").when(c("b") % 4 == 2, "box").otherwise("").alias("unit"),
        c("q").cast("double").alias("quantity"), c("k").alias("source_row"),
        F.concat(F.lit("job"), (c("b") % 5).cast("string")).alias("job_id"),
        F.concat(F.lit("sheet"), (c("b") % 3).cast("string")).alias("sheet_name"),
    )


INQUIRY_SQL = """
SELECT p_name||'/'||p_brand AS line_id,
 upper(split_part(p_name,' ',1))||'-'||split_part(p_name,' ',2)||CASE WHEN b%7=0 THEN 's' WHEN b%2=0 THEN ' '||CAST(b%10 AS VARCHAR) ELSE '' END AS name,
 lower(t)||', '||CAST(s AS VARCHAR)||' mm' AS spec,
 CASE WHEN b%3<>0 THEN '' WHEN length(CAST(k AS VARCHAR))<5 THEN lpad(CAST(k AS VARCHAR),5,'0') ELSE CAST(k AS VARCHAR) END AS product_code,
 '' AS model, p_brand AS brand, '' AS manufacturer,
 CASE b%4 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'box' ELSE '' END AS unit,
 CAST(q AS DOUBLE) AS quantity, k AS source_row, 'job'||CAST(b%5 AS VARCHAR) AS job_id, 'sheet'||CAST(b%3 AS VARCHAR) AS sheet_name
FROM (SELECT p_name,p_brand,min(p_type) t,min(p_size) s,min(p_partkey) k,count(*) n,sum(p_size) q,
 CAST(regexp_extract(p_brand,'(\\d+)$',1) AS INTEGER) b FROM part GROUP BY p_name,p_brand)"""


def review_lines(spark: SparkSession, sf: str) -> DataFrame:
    """orders as quoted lines under review."""
    o = table(spark, sf, "orders")
    c = F.col
    cents = F.round(c("o_totalprice") * 100).cast("bigint")
    warn = F.array_compact(F.array(
        F.when(c("o_custkey") % 4 == 0, "BLOCK: 单位不可直接换算"), F.when(c("o_custkey") % 5 == 0, "价格偏离同组"),
        F.when(c("o_custkey") % 6 == 0, "同分多价"), F.when(c("o_custkey") % 9 == 0, "未满足客户要求")))
    return o.select(
        c("o_orderkey").alias("line_id"), c("o_orderpriority").alias("job_id"), c("o_orderstatus").alias("sheet_name"),
        c("o_orderkey").alias("source_row"), F.concat(F.lit("item "), c("o_custkey").cast("string")).alias("name"),
        F.lit("").alias("spec"), c("o_custkey").cast("string").alias("product_code"), F.lit("").alias("model"), F.lit("pc").alias("unit"),
        (cents % 40).cast("double").alias("quantity"), F.when(c("o_custkey") % 2 == 0, (cents % 7).cast("double")).alias("pricing_quantity"),
        F.when(c("o_orderstatus") == "F", "suggested").when(c("o_orderstatus") == "O", "review").otherwise("unmatched").alias("status"),
        F.when(c("o_orderpriority") == "1-URGENT", "high").when(c("o_orderpriority") == "2-HIGH", "high")
        .when(c("o_orderpriority") == "3-MEDIUM", "low").when(c("o_orderpriority") == "5-LOW", "unreliable").otherwise("review").alias("confidence"),
        ((cents % 10000) / 100.0).alias("recommended_score"), warn.alias("warnings"), (c("o_custkey") % 7 == 0).alias("confirmed"))


REVIEW_LINES_SQL = """
SELECT o_orderkey AS line_id, o_orderpriority AS job_id, o_orderstatus AS sheet_name, o_orderkey AS source_row, 'item '||o_custkey AS name,
 '' AS spec, CAST(o_custkey AS VARCHAR) AS product_code, '' AS model, 'pc' AS unit,
 CAST(CAST(round(o_totalprice*100) AS BIGINT)%40 AS DOUBLE) AS quantity,
 CASE WHEN o_custkey%2=0 THEN CAST(CAST(round(o_totalprice*100) AS BIGINT)%7 AS DOUBLE) END AS pricing_quantity,
 CASE o_orderstatus WHEN 'F' THEN 'suggested' WHEN 'O' THEN 'review' ELSE 'unmatched' END AS status,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'low' WHEN '5-LOW' THEN 'unreliable' ELSE 'review' END AS confidence,
 (CAST(round(o_totalprice*100) AS BIGINT)%10000)/100.0::DOUBLE AS recommended_score,
 list_filter([CASE WHEN o_custkey%4=0 THEN 'BLOCK: 单位不可直接换算' END, CASE WHEN o_custkey%5=0 THEN '价格偏离同组' END,
  CASE WHEN o_custkey%6=0 THEN '同分多价' END, CASE WHEN o_custkey%9=0 THEN '未满足客户要求' END], lambda x: x IS NOT NULL) AS warnings,
 o_custkey%7=0 AS confirmed FROM orders"""


def review_options(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """lineitem as scored options of those lines (a few per order)."""
    from pyspark.sql import Window

    h = history(spark, sf, rows)
    c = F.col
    cents = F.round(c("price") * 100).cast("bigint")
    rank = F.row_number().over(Window.partitionBy("orderkey").orderBy("id"))
    warn = F.array_compact(F.array(
        F.when(cents % 11 == 0, "估算价：按类目"), F.when(cents % 13 == 0, "BLOCK: 单位不可直接换算"), F.when(cents % 17 == 0, "规格量程不符")))
    return h.select(
        c("orderkey").alias("line_id"), c("id").alias("option_id"), rank.alias("rank"), ((cents % 10000) / 100.0).alias("score"),
        c("price").alias("final_price"), F.when(c("unit") == "kg", c("price")).alias("normalized_price"), c("price"),
        (c("unit") != "box").alias("selected"), warn.alias("warnings"), c("id").alias("history_id"),
        F.when(c("unit") == "g", "").otherwise(c("manufacturer")).alias("record_manufacturer"), c("brand").alias("record_brand"),
        F.lit("").alias("record_model"), F.when(c("unit") == "kg", "").otherwise(c("product_code")).alias("record_product_code"),
        F.when(c("source_sheet") == "legacy", "").otherwise(c("spec")).alias("record_spec"), F.lit("").alias("record_unit"),
        c("source_file").alias("record_source_file"), c("source_sheet").alias("record_source_sheet"), c("source_row").alias("record_source_row"),
        c("manufacturer"), c("brand"), c("spec"), F.lit("").alias("model"), c("product_code"), c("source_file"), c("unit"))


REVIEW_OPTIONS_SQL = """
SELECT orderkey AS line_id, id AS option_id, row_number() OVER (PARTITION BY orderkey ORDER BY id) AS rank,
 (CAST(round(price*100) AS BIGINT)%10000)/100.0::DOUBLE AS score, price AS final_price, CASE WHEN unit='kg' THEN price END AS normalized_price, price,
 unit<>'box' AS selected,
 list_filter([CASE WHEN CAST(round(price*100) AS BIGINT)%11=0 THEN '估算价：按类目' END, CASE WHEN CAST(round(price*100) AS BIGINT)%13=0 THEN 'BLOCK: 单位不可直接换算' END,
  CASE WHEN CAST(round(price*100) AS BIGINT)%17=0 THEN '规格量程不符' END], lambda x: x IS NOT NULL) AS warnings,
 id AS history_id, CASE WHEN unit='g' THEN '' ELSE manufacturer END AS record_manufacturer, brand AS record_brand, '' AS record_model,
 CASE WHEN unit='kg' THEN '' ELSE product_code END AS record_product_code, CASE WHEN source_sheet='legacy' THEN '' ELSE spec END AS record_spec,
 '' AS record_unit, source_file AS record_source_file, source_sheet AS record_source_sheet, source_row AS record_source_row,
 manufacturer, brand, spec, '' AS model, product_code, source_file, unit FROM hist"""


def feed(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """The whole book sent again, untidily: repeats, changed prices, invalid and unpriced rows."""
    h = history(spark, sf, rows)
    c = F.col
    return h.select(
        F.concat(F.lit("feed-"), c("id")).alias("id"), c("id").alias("seq"), c("id").alias("rowid"),
        F.concat(F.upper("name"), F.lit(".")).alias("name"), c("spec"), c("unit"), c("manufacturer"), c("brand"), c("model"),
        c("product_code"), F.lit("feed.csv").alias("source_file"), c("source_sheet"), c("source_row"),
        F.when(c("unit") == "kg", c("price")).when(c("unit") == "g", F.floor("price").cast("double"))
        .when(c("source_sheet") == "legacy", F.lit(0.0)).alias("price"),
        (c("source_row") > 2).alias("has_price_column"))


FEED_SQL = """
SELECT 'feed-'||id AS id, id AS seq, upper(name)||'.' AS name, spec, unit, manufacturer, brand, model, product_code, 'feed.csv' AS source_file, source_sheet, source_row,
 CASE WHEN unit='kg' THEN price WHEN unit='g' THEN CAST(floor(price) AS DOUBLE) WHEN source_sheet='legacy' THEN 0.0 END AS price,
 source_row>2 AS has_price_column FROM hist"""


def customers(spark: SparkSession, sf: str) -> DataFrame:
    cu = table(spark, sf, "customer")
    c = F.col
    seg = c("c_mktsegment")
    return cu.select(
        c("c_custkey").alias("customer_id"),
        F.when(seg == "BUILDING", "vip").when(seg == "MACHINERY", "special").otherwise("ordinary").alias("customer_type"),
        (c("c_custkey") % 4 * 5).cast("double").alias("discount_percent"), (c("c_custkey") % 3 * 10).cast("double").alias("minimum_margin_percent"))


CUSTOMERS_SQL = """
SELECT c_custkey AS customer_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'vip' WHEN 'MACHINERY' THEN 'special' ELSE 'ordinary' END AS customer_type,
 CAST(c_custkey%4*5 AS DOUBLE) AS discount_percent, CAST(c_custkey%3*10 AS DOUBLE) AS minimum_margin_percent FROM customer"""


def with_views(sql: str) -> str:
    """Prefix a statement with the view definitions it names."""
    parts = {"hist": HISTORY_SQL, "inq": INQUIRY_SQL, "rlines": REVIEW_LINES_SQL, "ropts": REVIEW_OPTIONS_SQL,
             "feed": FEED_SQL, "cust": CUSTOMERS_SQL}
    needs_hist = any(f" {v}" in sql for v in ("ropts", "feed"))
    used = [v for v in parts if f" {v}" in sql or (v == "hist" and needs_hist)]
    ctes = ", ".join(f"{v} AS MATERIALIZED ({parts[v]})" for v in used)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
