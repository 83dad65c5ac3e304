"""Rule packs and thresholds.

Everything domain specific is data: jobs take a :class:`Lexicon` (words, codes,
units) and a :class:`MatchConfig` (numbers).  ``ZH`` is the pack for Chinese
teaching-instrument lists; ``DEMO`` fits the English product names of the sample
tables.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values (must equal the published behaviour for right results)
# ---------------------------------------------------------------------------

HEADER_ALIASES = {
    "name": ["采购品目", "货物名称", "产品名称", "品名", "器材名称", "设备名称", "仪器名称", "名称"],
    "product_code": ["产品编码", "编码", "编号", "货号", "分类代码", "品牌型号"],
    "quantity": ["数量", "需求数量", "采购数量", "配置数量", "每套数量", "套数"],
    "unit": ["单位", "计量单位"],
    "spec": ["参数", "技术参数", "主要技术参数", "主要性能要求", "技术性能要求", "性能要求",
             "规格", "规格参数", "规格说明", "技术要求"],
    "model": ["规格型号", "型号", "规格"],
    "brand": ["品牌", "商标"],
    "manufacturer": ["制造商名称", "制造商", "制造厂家", "厂家", "生产厂家"],
}
PRICE_ALIASES = ["单价", "含税单价", "报价", "价格"]
VENDOR_LABELS = {
    "brand": ["品牌", "商标"],
    "manufacturer": ["厂家", "生产厂家", "制造商", "制造厂家", "制造商名称", "制造商/产地"],
    "model": ["型号", "规格型号"],
}
SECTION_MARKS = ["序号", "名称", "目录", "器材名称", "品名"]
INQUIRY_SKIP_NAMES = ["小计", "合计", "总计", "配置班额", "一般", "合计金额"]
BOOK_SKIP_NAMES = INQUIRY_SKIP_NAMES + ["单套合计", "单套金额", "目录"]

CODE_MAJORS = {
    "00": "通用仪器", "01": "通用仪器", "02": "通用仪器", "03": "通用仪器",
    "04": "计量", "05": "计量", "06": "计量",
    "10": "力学", "11": "力学", "12": "力学", "13": "力学",
    "14": "力学", "15": "力学", "16": "力学", "17": "力学",
    "20": "热学", "21": "热学", "22": "热学",
    "23": "电学", "24": "电磁学", "25": "电磁学", "26": "电磁学",
    "27": "电子", "28": "电子",
    "30": "光学", "31": "光学", "32": "光学", "33": "声学",
    "40": "化学仪器", "41": "化学药品", "42": "化学玻璃", "43": "化学玻璃",
    "50": "生物仪器", "51": "生物仪器", "60": "生物标本模型", "61": "生物标本模型",
    "70": "地理仪器", "71": "地理仪器", "80": "数学", "81": "数学",
    "90": "其他", "99": "其他",
}

# Keyword rules in order; the first keyword found in the name decides.
CATEGORY_RULES = [
    # mechanics
    ("小车", "mech_cart"), ("斜面", "mech_cart"), ("滑轮", "mech_cart"),
    ("杠杆", "mech_lever"), ("轮轴", "mech_lever"), ("天平", "mech_scale"),
    ("弹簧测力", "mech_spring"), ("测力计", "mech_spring"),
    ("量筒", "mech_volume"), ("量杯", "mech_volume"),
    # electricity and magnetism
    ("电源", "em_power"), ("电池", "em_power"), ("电压表", "em_meter"),
    ("电流表", "em_meter"), ("万用表", "em_meter"), ("多用电表", "em_meter"),
    ("演示电表", "em_meter"), ("滑动变阻器", "em_resistor"), ("电阻箱", "em_resistor"),
    ("焦耳定律", "em_joule"), ("起电机", "em_generator"), ("发电机", "em_generator"),
    ("电磁继电器", "em_relay"), ("磁铁", "em_magnet"), ("强磁体", "em_magnet"),
    ("电磁铁", "em_magnet"), ("蹄形", "em_magnet"), ("条形", "em_magnet"),
    # optics
    ("透镜", "opt_lens"), ("棱镜", "opt_lens"), ("平面镜", "opt_mirror"),
    ("潜望镜", "opt_mirror"), ("放大镜", "opt_magnifier"), ("显微镜", "opt_scope"),
    ("望远镜", "opt_scope"), ("光具座", "opt_bench"),
    # heat
    ("温度计", "th_thermo"), ("干湿泡", "th_thermo"), ("热量计", "th_heat"), ("比热容", "th_heat"),
    # acoustics
    ("音叉", "ac_fork"), ("发音齿轮", "ac_gear"), ("共鸣", "ac_fork"),
    # chemistry
    ("烧杯", "ch_beaker"), ("烧瓶", "ch_beaker"), ("锥形瓶", "ch_beaker"),
    ("试管", "ch_tube"), ("滴管", "ch_tube"), ("漏斗", "ch_tube"),
    ("集气瓶", "ch_gas"), ("广口瓶", "ch_gas"), ("细口瓶", "ch_gas"),
    ("酒精灯", "ch_lamp"), ("温度计套", "ch_lamp"),
    # biology
    ("载玻片", "bio_slide"), ("盖玻片", "bio_slide"), ("计数板", "bio_slide"),
    ("解剖", "bio_dissect"), ("手术剪", "bio_dissect"), ("刀片", "bio_dissect"),
    ("离心机", "bio_centri"), ("恒温箱", "bio_incub"), ("培养皿", "bio_slide"),
    # supports
    ("支架", "mech_cart"), ("铁架台", "mech_cart"), ("演示台", "mech_cart"),
    ("升降台", "mech_cart"), ("三脚架", "mech_cart"),
]

# Unit -> (dimension, factor to the base unit): mass in g, volume in ml, length in mm.
UNIT_DIMENSIONS = {
    "g": ("mass", 1.0), "克": ("mass", 1.0),
    "kg": ("mass", 1000.0), "千克": ("mass", 1000.0), "公斤": ("mass", 1000.0),
    "mg": ("mass", 0.001), "毫克": ("mass", 0.001),
    "ml": ("volume", 1.0), "毫升": ("volume", 1.0),
    "l": ("volume", 1000.0), "升": ("volume", 1000.0),
    "mm": ("length", 1.0), "毫米": ("length", 1.0),
    "cm": ("length", 10.0), "厘米": ("length", 10.0),
    "m": ("length", 1000.0), "米": ("length", 1000.0),
}
BASE_UNITS = ["个", "支", "件", "只", "条", "根"]
PACK_UNITS = ["套", "盒", "包", "箱"]
OTHER_COUNT_UNITS = ["台", "把", "块", "张", "副", "付", "对", "组", "辆", "架", "部", "片", "枚",
                     "颗", "粒", "节", "双", "串", "排", "捆", "卷", "瓶", "袋", "桶", "罐"]
CONTENT_UNITS = ["瓶", "盒", "袋", "桶", "罐", "支", "包", "套"]

MODIFIERS_SCORING = [
    "演示", "实验", "图形", "内能", "新型", "高中", "初中", "小学", "学生用", "教师用", "教学用",
    "数显", "指针", "液晶", "高压", "低压", "可调", "精密", "简易", "普通", "袖珍", "微量", "便携",
    "台式", "立式", "手持", "不锈钢", "铜质", "铁质", "塑料", "玻璃", "木质", "单面", "双面",
    "电磁式", "永磁式", "数字式", "模拟式", "普通型", "高精度",
]
MODIFIERS_GATE = [word for word in MODIFIERS_SCORING if word != "教学用"]

SHAPES = [("u型|u形", "U型"), ("直型|直形", "直型"), ("单球", "单球"), ("双球", "双球"),
          ("弯管|弯形", "弯管"), ("方形", "方形"), ("圆形", "圆形")]
MATERIALS = [("高硼硅", "高硼硅"), ("钠钙", "钠钙"), ("石英", "石英"), ("硼硅", "硼硅"),
             ("塑料", "塑料"), ("不锈钢", "不锈钢"), ("铜制|铜质", "铜"), ("铁制|铁质", "铁"),
             ("铝制|铝质", "铝"), ("玻璃", "玻璃"), ("木质|木制", "木")]
FLAG_PATTERNS = {
    "digital": "数显|数字式|数字|液晶",
    "analog": "指针式|指针|模拟式",
    "half": r"\d\s*-\s*1\s*/\s*2\s*位|四位半|三位半",
    "student": "学生用|学生型",
    "teaching": "教师用|演示用|教学用(?!磁钢)",
    "grouped": "分组用|学生分组|分组学生|分组实验",
    "round_bottom": "圆底|圆长|圆、长|圆形底",
    "flat_bottom": "平底|平长|平、长|扁平底",
    "branch": "支杆",
    "stop": "止动|可卡",
}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    subject_prefixes: tuple = ()
    term_swaps: tuple = ()
    grade_marks: tuple = ()
    modifiers: tuple = ()
    gate_modifiers: tuple = ()
    category_rules: tuple = ()
    code_majors: dict = field(default_factory=dict)
    suffix_swap: tuple = ("", "")
    infix_swap: tuple = ("", "")
    trusted_mark: str = ""
    new_standard_mark: str = ""
    vote_grade: str = ""
    legacy_sheets: tuple = ((), ())
    surcharges: tuple = ()  # (record_code, (keywords,), delta, note) in rule order


ZH = Lexicon(
    subject_prefixes=("高中物理", "高中生物", "高中化学", "初中物理", "初中生物", "初中化学"),
    term_swaps=(("磁铁", "磁体"), ("离心钻台", "离心转台")),
    grade_marks=("高中", "初中", "小学"),
    modifiers=tuple(MODIFIERS_SCORING),
    gate_modifiers=tuple(MODIFIERS_GATE),
    category_rules=tuple(CATEGORY_RULES),
    code_majors=CODE_MAJORS,
    suffix_swap=("演示器", "实验器"),
    infix_swap=("包埋", "浸制"),
    trusted_mark="",
    new_standard_mark="新课标",
    vote_grade="高中",
    legacy_sheets=(
        ("初中物理", "高中物理"),
        ("初中化学", "初中生物", "初中地理", "初中数学", "高中化学", "高中生物", "高中地理",
         "高中数学", "小学数学", "小学科学"),
    ),
    surcharges=(("21032", ("止动", "可止动", "可卡"), 6.0, "含可止动滑轮，+6元/套"),),
)

DEMO = Lexicon(
    subject_prefixes=("hot", "cold"),
    term_swaps=(("gizmo", "gadget"),),
    grade_marks=("new", "old"),
    modifiers=("small", "large", "red", "blue"),
    gate_modifiers=("small", "large", "red", "blue"),
    category_rules=tuple((noun, noun) for noun in
                         ("ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod")),
    code_majors=CODE_MAJORS,
    suffix_swap=("ring", "rod"),
    infix_swap=("red", "blue"),
    trusted_mark="book3",
    new_standard_mark="standard",
    vote_grade="new",
    legacy_sheets=(("legacy",), ()),
    surcharges=(("00032", ("economy", "promo"), 6.0, "fitting kit"),
                ("00045", ("mm",), 2.5, "cut to size"),
                ("", ("21mm",), 1.25, "odd size")),
)


@dataclass(frozen=True)
class MatchConfig:
    as_of: str = "2026-01-01"
    name_floor: float = 0.15
    peer_floor: float = 0.30
    gate_floor: float = 0.30
    trusted_gate_floor: float = 0.65
    min_category_pool: int = 8
    prefilter: int = 250
    keep: int = 30
    reliable: float = 55.0
    high: float = 80.0
    medium: float = 65.0
    option_floor: float = 40.0
    exact_option_floor: float = 25.0
    default_floor: float = 30.0
    trusted_floor: float = 20.0
    price_gap: float = 0.30
    options: int = 3
    tax_rate: float = 0.10

    def with_(self, **changes) -> "MatchConfig":
        return replace(self, **changes)
