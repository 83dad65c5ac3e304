"""Golden values of the text, unit, date and specification functions."""
from pyspark.sql import functions as F

from priceloom.config import ZH, MatchConfig
from priceloom.functions import specs as S
from priceloom.functions.category import code_major, infer_category
from priceloom.functions.dates import recency_bonus
from priceloom.functions.similarity import bigram_dice, is_subsequence, sequence_ratio
from priceloom.functions.text import cell_name, cell_text, format_g, name_core, normalize_code, normalize_text, number_value
from priceloom.functions.units import compare_units, package_content
from priceloom.operators.candidates import name_gate
from priceloom.operators.governance import validate_rows
from priceloom.sources.sheets import repair_codes, salvage_code
from priceloom.suite import all_queries

c = F.col
CFG = MatchConfig()


def one_column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *[e(c("x")) for e in exprs]).orderBy("i").collect()]


def test_text_keys(spark):
    got = one_column(spark, ["Φ7～8mm", "ＡＢ－１（甲）", "㎜Ⅷ", "a b\tc", None], normalize_text)
    assert [g[0] for g in got] == ["φ7~8mm", "ab1甲", "mmviii", "abc", ""]


def test_name_core_and_codes(spark):
    core = lambda x: name_core(x, ZH)
    got = [g[0] for g in one_column(spark, [
        "初中化学坩埚钳7", "声波的叠加、干涉演示台d", "UV灯管b", "环状磁铁", "电动离心钻台", "35", "高中教学挂图"], core)]
    assert got == ["坩埚钳", "声波的叠加、干涉演示台", "uv灯管", "环状磁体", "电动离心转台", "35", "高中教学挂图"]
    codes = one_column(spark, ["40518330207.0", "02618", "", "K4409"], normalize_code, lambda x: code_major(x, ZH))
    assert codes == [("40518330207", ""), ("02618", "通用仪器"), ("", ""), ("k4409", "")]
    cats = [g[0] for g in one_column(spark, ["温度计套", "托盘天平", "冰箱"], lambda x: infer_category(x, ZH))]
    assert cats == ["th_thermo", "mech_scale", ""]


def test_cells_and_numbers(spark):
    got = one_column(spark, ["中学物理\n演示台", " a  b ", "￥1,234.5", "nan", "12"], cell_name, cell_text, number_value)
    assert got == [("中学物理演示台", "中学物理 演示台", None), ("a b", "a b", None), ("￥1,234.5", "￥1,234.5", 1234.5),
                   ("nan", "nan", None), ("12", "12", 12.0)]
    assert [g[0] for g in one_column(spark, ["编码05027，带指针", "流量≥25000L/h，亮度31000cd", "k05027"], salvage_code)] == ["05027", "", ""]
    df = spark.createDataFrame([(12.0,), (0.02,), (2026.19,), (1234567.0,)], "x double")
    assert [r[0] for r in df.select(format_g(c("x"))).collect()][:3] == ["12", "0.02", "2026.19"]


def test_recency(spark):
    dates = ["2025-06-01", "2024年3月1日", "2023Q2", "2019", "2030/1/1", "bad", "2025-13-40"]
    got = [g[0] for g in one_column(spark, dates, lambda x: recency_bonus(x, "2026-01-01"))]
    assert got == [1.5, 0.5, 0.0, -0.5, 0.0, 0.0, 0.0]


def test_dice_properties(spark):
    df = spark.createDataFrame([("塑料球", "塑料小球"), ("abab", "baba"), ("a", "a"), ("a", "b"), ("", "x"), ("电子天平", "电子天平")], "a string, b string")
    rows = df.select(bigram_dice(c("a"), c("b")).alias("x"), bigram_dice(c("b"), c("a")).alias("y"), is_subsequence(c("a"), c("b")).alias("s"),
                     sequence_ratio(c("a"), c("b")).alias("r")).collect()
    assert all(r.x == r.y and 0 <= r.x <= 1 for r in rows)
    assert [round(r.x, 4) for r in rows] == [0.4, 0.6667, 1.0, 0.0, 0.0, 1.0]
    assert [r.s for r in rows] == [True, False, True, False, True, True]


def test_units(spark):
    cases = [("克", "千克", 100.0, "", ""), ("克", "瓶", 100.0, "", ""), ("克", "瓶", 20.0, "", "每瓶净含量100克"), ("克", "瓶", 20.0, "", "试剂一瓶"),
             ("支", "盒", 20.0, "", "10支/盒"), ("盒", "支", 2.0, "10支/盒", ""), ("把", "个", 3.0, "", ""), ("", "个", 3.0, "", ""), ("台", "台", 5.0, "", "")]
    df = spark.createDataFrame(cases, "t string, s string, p double, ts string, ss string")
    rows = [r.unit for r in compare_units(df, "t", "s", "p", "ts", "ss").collect()]
    assert [(r.status, r.normalized_price) for r in rows] == [
        ("convertible", 0.1), ("incompatible", None), ("convertible", 0.2), ("incompatible", None), ("convertible", 2.0),
        ("convertible", 20.0), ("convertible", 3.0), ("missing", None), ("exact", 5.0)]
    assert rows[1].warning.startswith("BLOCK:")
    content = df.limit(3).select(package_content(c("ss"), c("s")).alias("x")).collect()
    assert content[2].x.amount == 100.0


def facts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.f for r in S.with_spec_facts(df, c("x"), "f", ZH).orderBy("i").collect()]


def test_spec_facts(spark):
    f = facts(spark, ["Φ11～13mm", "320mm×210mm×90mm", "-15～65℃", "175mm", "φ3～φ4mm", "冷凝管 U型，φ22mm×260mm", "量杯 高硼硅玻璃材质",
                      "望远镜 60×，双筒", "放大镜 15×20", "5 倍自然大", "自然大", "9件 学生分组用", "量程300g，精度0.02g"])
    span = lambda x, u: x.span[u] and (x.span[u].lo, x.span[u].hi)
    assert span(f[0], "mm") == (11.0, 13.0)
    assert span(f[1], "mm") == (90.0, 320.0) and f[1].dims == [90.0, 210.0, 320.0]
    assert span(f[2], "c") == (-15.0, 65.0)
    assert span(f[3], "mm") == (175.0, 175.0)
    assert span(f[4], "mm") == (3.0, 4.0)
    assert (f[5].shape, f[6].material, f[7].magnification, f[8].magnification) == ("U型", "高硼硅", "60×", "15×20")
    assert (f[9].scale, f[10].scale, f[11].pieces, f[11].grouped) == (5.0, 1.0, 9.0, True)
    assert span(f[12], "g") == (300.0, 300.0)


def test_long_facts(spark):
    texts = ["φ3～φ4mm，300g", "320mm×210mm×90mm", "9件 5倍", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    rows = S.long_facts(S.with_spec_facts(df, c("x"), "f", ZH), ["i"]).collect()
    got = {(r.i, r.kind, r.unit, r.lo, r.hi) for r in rows}
    assert {(0, "span", "mm", 3.0, 4.0), (0, "span", "g", 300.0, 300.0), (0, "capacity", "g", 300.0, 300.0), (0, "value", "g", 300.0, 300.0)} <= got
    assert {(1, "dimension", "mm", v, v) for v in (90.0, 210.0, 320.0)} <= got and {(2, "pieces", "", 9.0, 9.0), (2, "scale", "", 5.0, 5.0)} <= got
    assert not any(r[0] > 2 for r in got)


def pair_scores(spark, cases):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    for side in ("a", "b"):
        df = S.with_spec_facts(df, c(side), f"{side}f", ZH)
        df = S.with_spec_text(df, c(side), f"{side}t")
    rules = S.variant_rules(c("af"), c("bf"), ZH)
    return df.select("i", S.parameter_similarity(c("at"), c("af"), c("bt"), c("bf")).alias("sim"), S.variant_points(rules).alias("points"),
                     S.variant_warnings(rules).alias("warnings"), S.numeric_bonus(c("af"), c("bf")).alias("bonus")).orderBy("i").collect()


def test_pair_scores(spark):
    r = pair_scores(spark, [
        ("Φ11～13mm", "φ11mm～13mm"), ("-10~70℃", "-15～65℃"), ("320mm×210mm×90mm", "320mm×210mm×90mm"), ("滴瓶 60ml", "滴瓶 60ml，棕色"),
        ("导轨两端立柱间距≥260mm，底座螺孔≥Ф12mm", "螺孔直径 12 mm，间距 260 mm"), ("绘图工具 9件", "绘图工具 6件"), ("演示气垫滑块", "气垫滑块"),
        ("数显转速表", "转速表"), ("", "abc")])
    assert r[0].sim >= 0.5 and r[1].sim >= 0.3 and r[2].sim == 1.0 and r[8].sim == 0.0
    assert r[3].points == 0 and r[3].warnings == []
    assert not any("量程不符" in w for w in r[4].warnings)
    assert r[5].points == 8 and r[5].warnings == ["规格件数不符：询价9件，候选6件"]
    assert r[6].points == 12 and r[6].warnings == ["修饰词变体不符：询价含[演示]，候选含[∅]"]
    assert r[7].points == 9 + 12


# Same name; level prefix and trailing number dropped; another object; one word more.
GATE = [
    ("测角仪", "测角仪", "", True), ("高中化学滴定台", "滴定台", "", True), ("高中物理滑动变阻器2", "滑动变阻器", "", True),
    ("高中生物显微镜", "水准尺", "", False), ("初中物理凸透镜", "酒精灯", "T", False), ("演示滑轨", "演示滑轨", "T", True),
    ("演示滑轨", "滑轨", "T", False), ("光的折射规律演示器", "光的折射规律实验器", "T", True),
]


def test_name_gate(spark):
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(GATE)], "i int, a string, b string, t string, want boolean")
    df = df.select("i", "want", "t", name_core(c("a"), ZH).alias("l"), name_core(c("b"), ZH).alias("r"))
    df = df.withColumn("dice", bigram_dice(c("l"), c("r")))
    rows = df.select("i", "want", name_gate(c("l"), c("r"), c("dice"), c("t") == "T", ZH, CFG).alias("got")).collect()
    assert [(r.i, r.got) for r in rows if r.got != r.want] == []


def parts(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(
        f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_a_price_with_a_minus_sign_is_negative(spark):
    df = spark.createDataFrame([(i, p, "", "bolt") for i, p in enumerate(["0.0", "-0.0", "-1", " -0 ", "2"])], "id int, price string, quantity string, name string")
    ok, bad = validate_rows(df)
    assert sorted(r.id for r in ok.collect()) == [0, 4]
    assert {(r.id, r.reason) for r in bad.collect()} == {(1, "price_negative"), (2, "price_negative"), (3, "price_negative")}


def test_salvaged_codes_of_parts_begin_with_any_digit(spark, tmp_path):
    sf = parts(spark, tmp_path, [(k, "red ring", "b", "t", 5, 1.0) for k in (7, 90001, 99000, 100001)])
    got = {r.id: r.code for r in all_queries()[0]["salvage_code"](spark, sf).collect()}
    assert got == {7: "00007", 90001: "90001", 99000: "", 100001: ""}
    assert one_column(spark, ["code 90001, code 05027"], salvage_code) == [("05027",)]


def test_codes_of_parts_beyond_five_digits_leave_the_model(spark, tmp_path):
    sf = parts(spark, tmp_path, [(k, "red ring", "b", "t", 3, 1.0) for k in (7, 99999, 100001, 7654321)])
    got = {r.id: (r.product_code, r.model) for r in all_queries()[0]["repair_codes"](spark, sf).collect()}
    assert got == {7: ("00007", ""), 99999: ("99999", ""), 100001: ("100001", ""), 7654321: ("7654321", "")}
    plain = repair_codes(spark.createDataFrame([("", "", "100001.0")], "spec string, product_code string, model string")).first()
    assert (plain.product_code, plain.model) == ("", "100001")


def test_ascii_keys_take_one_pass(spark):
    """ASCII texts give the key of the general way; their branch has no regular expression."""
    from priceloom.functions import text as T

    rows = [(f"A{chr(p)}z{chr(p)}",) for p in range(1, 0x3000)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "x string").select("x", F.regexp_replace(T.folded(F.col("x")), T.KEY_CLASS, "").alias("general"), T.normalize_text(F.col("x")).alias("key"))
    assert df.filter(~F.col("general").eqNullSafe(F.col("key"))).count() == 0
    plan = df.select("key")._jdf.queryExecution().analyzed().toString()
    assert "ELSE translate(" in plan
