"""Fixed values the results depend on: vocabularies, rate tables, patterns, formats.

Everything in this module is a constant that has to equal the published value
for results to agree; there is no logic here beyond deriving short province
names from the full ones.
"""

from __future__ import annotations

# --- fixed values: strings that mean "no value" -------------------------------
EMPTY_TOKENS = (
    "", "-", "--", "—", "–", "无", "null", "none", "n/a", "na", "/", "\\",
    "暂无", "未知", "nan", "null值", "*", "**", "???",
)
# fixed values: the shorter vocabulary of the lead-scoring pipeline
SCORING_EMPTY_TOKENS = (
    "", "-", "—", "–", "无", "无。", "none", "null", "n/a", "na", "/", "\\",
    "暂无", "未知",
)

# --- fixed values: patterns ---------------------------------------------------
# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
HAN = r"[\x{4e00}-\x{9fff}]"
MULTI_SPLIT = r"[,，;；、\s\p{Z}|]+"
SCORING_SPLIT = r"[;；,，、|/\s\p{Z}]+"
HONOR_SPLIT = r"[,，;；、|/]"
SCORING_HONOR_SPLIT = r"[,，;；、]"
MAIL_ADDRESS_SPLIT = r"\t*;\t*|\t"
CREDIT_CODE = r"^[0-9A-Z]{18}$"
QUERY_CREDIT_CODE = r"^[0-9A-Za-z]{15,18}$"
MOBILE = r"^1[3-9]\p{Nd}{9}$"
PHONE_DIGITS = r"^\p{Nd}{7,12}$"
PERSON_NAME = r"^[\x{4e00}-\x{9fff}·•]{2,4}$"
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
EMAIL_ANYWHERE = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
CAPITAL = (
    r"([0-9]+(?:\.[0-9]+)?)[\s\p{Z}]*(万|亿)?[\s\p{Z}]*([\x{4e00}-\x{9fa5}]{2,4})?"
)
SCORING_CAPITAL = (
    r"([0-9]+(?:\.[0-9]+)?)[\s\p{Z}]*(万|亿)?[\s\p{Z}]*"
    r"(人民币|美元|美金|港元|港币|欧元|日元|英镑|新加坡元|澳元|加元|韩元|台币|新台币)?"
)
DATE_TEXT = r"(\p{Nd}{4})[-/年.](\p{Nd}{1,2})[-/月.](\p{Nd}{1,2})"
VALID_TO = (
    r"至[\s\p{Z}]*(\p{Nd}{4})[\s\p{Z}]*年[\s\p{Z}]*(\p{Nd}{1,2})[\s\p{Z}]*月"
    r"[\s\p{Z}]*(\p{Nd}{1,2})[\s\p{Z}]*日"
)
PROVINCE_FOLDER = r"^(.+?)所有企业"
REPAIR_CANDIDATE = r"^[0-9]{7,}(\.[0-9]+)?万"

# --- fixed values: exchange rates to CNY, for capital in units of 10 000 CNY --
FX = {
    "人民币": "1.0", "美元": "7.2", "美金": "7.2", "港元": "0.92", "港币": "0.92",
    "欧元": "8.0", "日元": "0.048", "英镑": "9.5", "新加坡元": "5.5", "新元": "5.5",
    "澳元": "4.7", "加元": "5.3", "韩元": "0.0052", "台币": "0.23", "新台币": "0.23",
    "瑞士法郎": "8.1", "瑞典克朗": "0.68", "泰铢": "0.2", "卢布": "0.075",
}
# fixed values: currencies the scoring pipeline recognises (same rates)
SCORING_CURRENCIES = (
    "人民币", "美元", "美金", "港元", "港币", "欧元", "日元", "英镑", "新加坡元",
    "澳元", "加元", "韩元", "台币", "新台币",
)

# --- fixed values: names treated as state-owned by the capital rules ----------
STATE_OWNED = (
    "国家电网", "中央汇金", "中国石油", "中国石化", "中国海油", "国家开发银行", "中国铁路",
    "中国烟草", "中国移动", "中国电信", "中国联通", "工商银行", "建设银行", "农业银行",
    "中国银行股份", "交通银行", "国家能源", "南方电网", "中国华能", "华能集团", "大唐集团",
    "中国华电", "华电集团", "国家电投", "中核集团", "航天科技", "航天科工", "航空工业",
    "中国中车", "中国建筑", "中国中铁", "中国铁建", "中国交建", "中国电建", "中国能建",
    "中国铝业", "中国宝武", "招商局", "中粮集团", "保利集团", "华润集团",
    "中国人寿", "中国平安", "中国人保", "中国邮政", "全国社保", "国家管网",
    "国家石油天然气", "中国投资有限责任", "国家集成电路", "产业投资基金",
    "山东高速", "中国融通", "中国诚通", "中国国新", "中国烟草总公司",
    "中国铁路投资", "中国铁路发展基金", "中国工商银行", "中国农业银行",
    "中国建设银行", "中国银行有限",
)
# fixed values: one more state-owned marker, known to the parser but not to repair
STATE_OWNED_PARSER_ONLY = ("华润\\(",)
# fixed values: affiliated bodies that copy their parent's capital
AFFILIATED_BODIES = (
    "工会", "委员会", "营业厅", "小学", "中学", "幼儿园", "学校", "体育馆", "卫生院",
    "村委会", "居委会", "党支部", "派出所", "养护段", "用水协会",
)

# --- fixed values: the 31 mainland provinces, in facet order ------------------
PROVINCES = (
    "江苏省", "浙江省", "上海市", "安徽省", "北京市", "天津市", "重庆市", "广东省",
    "福建省", "山东省", "河南省", "河北省", "湖北省", "湖南省", "江西省", "四川省",
    "云南省", "贵州省", "山西省", "陕西省", "辽宁省", "吉林省", "黑龙江省", "海南省",
    "甘肃省", "青海省", "广西壮族自治区", "内蒙古自治区", "新疆维吾尔自治区",
    "宁夏回族自治区", "西藏自治区",
)
MUNICIPALITIES = ("上海市", "北京市", "天津市", "重庆市")
CORE_PROVINCES = ("江苏省", "浙江省", "上海市", "安徽省")
REGION_SUFFIXES = (
    "特别行政区", "维吾尔自治区", "壮族自治区", "回族自治区", "自治区", "省", "市",
    "地区", "盟",
)


def short_region(name: str) -> str:
    for suffix in REGION_SUFFIXES:
        if name.endswith(suffix) and len(name) > len(suffix):
            return name[: -len(suffix)]
    return name


# Short and full spelling both map to the full name.
PROVINCE_BY_NAME = {short_region(p): p for p in PROVINCES} | {p: p for p in PROVINCES}

# --- fixed values: registration status spellings ------------------------------
STATUS_BY_TEXT = {
    "存续": "存续", "正常": "存续", "在业": "存续", "存续（在营、开业、在册）": "存续",
    "存续/在业": "存续", "开业": "存续", "在营": "存续", "在册": "存续",
    "迁出": "迁出", "迁入": "存续",
    "注销": "注销", "已注销": "注销",
    "吊销": "吊销", "吊销，未注销": "吊销", "吊销未注销": "吊销",
    "吊销，已注销": "吊销", "撤销": "吊销", "清算": "清算", "停业": "停业",
}
# fixed values: status words that identify a headerless registry section
SECTION_STATUS_WORDS = (
    "存续", "在业", "注销", "吊销", "迁出", "撤销", "停业", "清算", "歇业",
    "吊销，未注销", "注销企业",
)

# --- fixed values: industry sections offered as facets ------------------------
INDUSTRY_SECTIONS = (
    "批发和零售业", "制造业", "租赁和商务服务业", "科学研究和技术服务业",
    "建筑业", "信息传输、软件和信息技术服务业", "农、林、牧、渔业",
    "文化、体育和娱乐业", "交通运输、仓储和邮政业", "房地产业",
    "居民服务、修理和其他服务业", "住宿和餐饮业", "教育", "金融业",
    "水利、环境和公共设施管理业", "卫生和社会工作",
    "电力、热力、燃气及水生产和供应业", "公共管理、社会保障和社会组织",
    "采矿业", "国际组织",
)

# --- fixed values: city names that denote the same place ----------------------
CITY_ALIASES = {
    "北京市": ("北京市", "北京城区"),
    "北京城区": ("北京城区", "北京市"),
    "上海市": ("上海市", "上海城区"),
    "上海城区": ("上海城区", "上海市"),
    "天津市": ("天津市", "天津城区"),
    "天津城区": ("天津城区", "天津市"),
    "重庆市": ("重庆市", "重庆城区", "重庆郊县"),
    "重庆城区": ("重庆城区", "重庆市", "重庆郊县"),
    "重庆郊县": ("重庆郊县", "重庆市", "重庆城区"),
    "伊犁州": ("伊犁哈萨克自治州", "伊犁州"),
    "昌吉州": ("昌吉回族自治州", "昌吉州"),
    "巴州": ("巴音郭楞蒙古自治州", "巴州"),
    "恩施州": ("恩施土家族苗族自治州", "恩施州"),
    "湘西州": ("湘西土家族苗族自治州", "湘西州"),
    "黔东南州": ("黔东南苗族侗族自治州", "黔东南州"),
    "黔南州": ("黔南布依族苗族自治州", "黔南州"),
    "黔西南州": ("黔西南布依族苗族自治州", "黔西南州"),
    "大理州": ("大理白族自治州", "大理州"),
    "红河州": ("红河哈尼族彝族自治州", "红河州"),
    "楚雄州": ("楚雄彝族自治州", "楚雄州"),
    "文山州": ("文山壮族苗族自治州", "文山州"),
    "西双版纳州": ("西双版纳傣族自治州", "西双版纳州"),
    "德宏州": ("德宏傣族景颇族自治州", "德宏州"),
    "怒江州": ("怒江傈僳族自治州", "怒江州"),
    "迪庆州": ("迪庆藏族自治州", "迪庆州"),
    "雄安新区": ("雄安新区", "保定市"),
}
PLACEHOLDER_CITIES = ("省直辖县级行政区划", "自治区直辖县级行政区划")

# --- fixed values: street vocabulary ------------------------------------------
STREET_SUFFIXES = ("街道办事处", "街道", "镇", "乡", "苏木")
STREET_ALIAS_SUFFIXES = ("镇", "乡", "街道", "街道办事处", "苏木")
LEADING_PUNCTUATION = r"[·，,、. ]"
ZONE_MARKERS = (
    "高新技术产业开发区", "经济技术开发区", "国家高新区", "高新区", "开发区",
    "工业园区", "科学园", "新区", "园区",
)
# What may follow a street name inside an address.
AFTER_STREET = (
    r"^(?:[零一二三四五六七八九十百千万号弄巷村组队楼栋室层东南北中路街道]"
    r"|办事处|[^\x{4e00}-\x{9fff}])"
)

# --- fixed values: words that mark a search text as a company name ------------
COMPANY_WORDS = (
    "公司", "厂", "店", "中心", "部", "行", "社", "院", "所", "集团", "工作室",
    "有限", "股份", "合伙", "银行", "大学", "学校", "医院",
)
QUERY_DIMENSIONS = ("company", "person", "mobile", "email", "credit", "scope", "address")

# --- fixed values: certificates -----------------------------------------------
HIGH_TECH_HONOR = "高新技术企业"
HIGH_TECH_TYPE = "hightech"
NOT_REVOKED = ("", "否", "无", "0", "N", "n", "false", "False")

# --- fixed values: industry-chain tags ----------------------------------------
RELATEDNESS_RANK = {"强": 3, "较强": 2, "中": 1, "弱": 0}
POSITIONS = ("上游", "中游", "下游")
LISTED_WORDS = ("上市", "主板", "创业板", "科创板", "北交所", "港股", "美股")
SCORING_LISTED_WORDS = ("上市", "A股", "港股", "美股", "科创板", "创业板", "北交所")
SCORING_FUNDED_WORDS = ("融资", "股权", "战略投资", "VC", "PE", "独角兽")
FINANCING_WORDS = ("上市", "融资", "股权", "投资", "未融资")
CLOSED_WORDS = ("注销", "吊销", "撤销", "停业", "清算")
HONOR_SECTIONS = (
    "雏鹰企业", "瞪羚企业", "独角兽企业", "高新技术企业", "科技型中小企业",
    "创新型中小企业", "专精特新企业", "专精特新小巨人企业", "专精特新小巨人",
    "隐形冠军企业", "单项冠军企业", "单项企业冠军", "技术创新示范企业",
    "企业技术中心",
)
OTHER_HONOR_SECTIONS = ("荣誉匹配", "类似相关企业", "相关企业", "机器人全部企业")
HONOR_HEADERS = ("荣誉", "企业荣誉", "荣誉资质", "资质荣誉", "资质")

# --- fixed values: business lines (label -> chain words, national-industry words)
# The labels are ours; pass another table to ``scoring.business_fit`` to change them.
BUSINESS_LINES = {
    "数据智能": (
        ("人工智能", "大数据", "云计算", "数据要素", "数据服务", "数据创意", "数字经济",
         "国产软件", "区块链", "边缘计算", "智能语音", "智能语音识别", "智能视觉",
         "智能物联", "服务器", "IDC", "网络安全"),
        ("软件和信息技术", "互联网和相关", "信息传输", "数据处理", "人工智能"),
    ),
    "高端装备": (
        ("高端装备", "高端装备制造", "工业机器人", "机器人", "人形机器人", "数控机床",
         "机械设备", "智能物联", "物联网", "半导体", "半导体设备", "半导体材料",
         "集成电路", "激光", "空天装备", "航空航天"),
        ("专用设备", "通用设备", "仪器仪表", "电气机械", "汽车制造", "铁路", "船舶", "航空"),
    ),
    "生命科学": (
        ("医药生物", "化学药品", "生物药品", "体外诊断", "医疗器械", "医疗数字化",
         "医疗机器人"),
        ("医药制造", "卫生", "医学", "医疗仪器", "生物药品", "化学药品"),
    ),
}

# --- fixed values: centre points (lat, lng) -----------------------------------
PROVINCE_CENTRES = {
    "北京市": (39.90, 116.41), "天津市": (39.13, 117.20), "河北省": (38.04, 114.51),
    "山西省": (37.87, 112.55), "内蒙古自治区": (40.82, 111.77), "辽宁省": (41.80, 123.43),
    "吉林省": (43.90, 125.33), "黑龙江省": (45.75, 126.64), "上海市": (31.23, 121.47),
    "江苏省": (32.06, 118.80), "浙江省": (30.27, 120.15), "安徽省": (31.86, 117.28),
    "福建省": (26.08, 119.30), "江西省": (28.68, 115.86), "山东省": (36.67, 117.02),
    "河南省": (34.76, 113.65), "湖北省": (30.59, 114.31), "湖南省": (28.23, 112.94),
    "广东省": (23.13, 113.26), "广西壮族自治区": (22.82, 108.37), "海南省": (20.02, 110.35),
    "重庆市": (29.56, 106.55), "四川省": (30.67, 104.07), "贵州省": (26.65, 106.63),
    "云南省": (25.04, 102.71), "西藏自治区": (29.65, 91.12), "陕西省": (34.27, 108.95),
    "甘肃省": (36.06, 103.83), "青海省": (36.62, 101.78), "宁夏回族自治区": (38.47, 106.27),
    "新疆维吾尔自治区": (43.83, 87.62), "香港特别行政区": (22.32, 114.17),
    "澳门特别行政区": (22.20, 113.55), "台湾省": (25.03, 121.57),
}
CITY_CENTRES = {
    "北京市": (39.90, 116.41), "天津市": (39.13, 117.20), "上海市": (31.23, 121.47),
    "重庆市": (29.56, 106.55), "广州市": (23.13, 113.26), "深圳市": (22.54, 114.06),
    "东莞市": (23.04, 113.75), "佛山市": (23.02, 113.12), "珠海市": (22.27, 113.58),
    "中山市": (22.52, 113.39), "惠州市": (23.11, 114.42), "汕头市": (23.35, 116.69),
    "杭州市": (30.27, 120.15), "宁波市": (29.87, 121.55), "温州市": (28.00, 120.70),
    "嘉兴市": (30.75, 120.76), "绍兴市": (30.00, 120.58), "金华市": (29.08, 119.65),
    "台州市": (28.66, 121.42), "湖州市": (30.89, 120.09), "南京市": (32.06, 118.80),
    "苏州市": (31.30, 120.62), "无锡市": (31.49, 120.31), "常州市": (31.81, 119.97),
    "南通市": (32.02, 120.86), "徐州市": (34.26, 117.18), "扬州市": (32.39, 119.42),
    "镇江市": (32.19, 119.45), "盐城市": (33.35, 120.16), "成都市": (30.67, 104.07),
    "绵阳市": (31.47, 104.68), "德阳市": (31.13, 104.40), "武汉市": (30.59, 114.31),
    "襄阳市": (32.01, 112.12), "宜昌市": (30.69, 111.29), "长沙市": (28.23, 112.94),
    "株洲市": (27.83, 113.13), "郑州市": (34.75, 113.63), "洛阳市": (34.62, 112.45),
    "济南市": (36.67, 117.02), "青岛市": (36.07, 120.38), "烟台市": (37.54, 121.39),
    "潍坊市": (36.71, 119.16), "临沂市": (35.10, 118.36), "淄博市": (36.81, 118.05),
    "合肥市": (31.82, 117.23), "芜湖市": (31.35, 118.38), "福州市": (26.08, 119.30),
    "厦门市": (24.48, 118.09), "泉州市": (24.87, 118.68), "南昌市": (28.68, 115.86),
    "石家庄市": (38.04, 114.51), "唐山市": (39.63, 118.18), "太原市": (37.87, 112.55),
    "沈阳市": (41.80, 123.43), "大连市": (38.91, 121.61), "长春市": (43.82, 125.32),
    "哈尔滨市": (45.80, 126.53), "西安市": (34.27, 108.95), "兰州市": (36.06, 103.83),
    "昆明市": (25.04, 102.71), "贵阳市": (26.65, 106.63), "南宁市": (22.82, 108.37),
    "海口市": (20.02, 110.35), "乌鲁木齐市": (43.83, 87.62), "银川市": (38.47, 106.27),
    "西宁市": (36.62, 101.78), "拉萨市": (29.65, 91.12), "呼和浩特市": (40.82, 111.77),
}

# --- fixed values: histogram edges of the data-quality report -----------------
LENGTH_EDGES = (0, 1, 50, 100, 200, 400, 800, 1600)
CAPITAL_EDGES = (0, 10, 50, 100, 500, 1000, 5000, 10000)
INSURED_EDGES = (1, 5, 20, 50, 200, 1000)

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_000.0
