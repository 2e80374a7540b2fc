"""Word lists from which the registry tables are made, for Spark and for SQL."""

from __future__ import annotations

AS_OF = "2026-01-01"

# Province, city as registered, city as the division tree spells it; by nation key.
PLACES = (
    ("江苏省", "南京市", "南京市"), ("江苏省", "苏州市", "苏州市"),
    ("浙江省", "杭州市", "杭州市"), ("浙江省", "宁波市", "宁波市"),
    ("上海市", "上海市", "上海城区"), ("安徽省", "合肥市", "合肥市"),
    ("北京市", "北京市", "北京城区"), ("天津市", "天津市", "天津城区"),
    ("重庆市", "重庆市", "重庆郊县"), ("广东省", "广州市", "广州市"),
    ("广东省", "深圳市", "深圳市"), ("福建省", "厦门市", "厦门市"),
    ("山东省", "青岛市", "青岛市"), ("河南省", "郑州市", "郑州市"),
    ("河南省", "省直辖县级行政区划", ""), ("湖北省", "恩施州", "恩施土家族苗族自治州"),
    ("湖北省", "武汉市", "武汉市"), ("湖南省", "长沙市", "长沙市"),
    ("江西省", "南昌市", "南昌市"), ("四川省", "成都市", "成都市"),
    ("云南省", "大理州", "大理白族自治州"), ("贵州省", "贵阳市", "贵阳市"),
    ("陕西省", "西安市", "西安市"), ("新疆维吾尔自治区", "自治区直辖县级行政区划", ""),
    ("浙江省", "舟山市", "舟山市"),
)
PROVINCES = tuple(p[0] for p in PLACES)
CITIES = tuple(p[1] for p in PLACES)
TREE_CITIES = tuple(p[2] for p in PLACES)
PLACEHOLDERS = (14, 23)
DISTRICTS = ("东城区", "西湖区", "南山区", "北辰区")
COUNTY_CITIES = ("济源市", "仙桃市", "潜江市", "石河子市")
STREETS = ("新华街道", "城关镇", "和平街道", "南湖乡", "新华镇", "红旗街道办事处")

BRANDS = ("恒信", "远大", "明德", "天工", "瑞丰", "华美", "东方")
KINDS = ("科技有限公司", "贸易有限公司", "建设集团", "工会委员会", "中国铁路服务部", "食品厂")
SURNAMES = ("王", "李", "张", "刘", "陈", "杨", "赵", "黄")
GIVEN = ("伟", "芳", "秀英", "强", "敏", "小明")
STATUS_RAW = (
    "存续（在营、开业、在册）", "在业", "存续", "注销", "吊销，未注销", "迁出", "正常", "-",
)
STATUS = ("存续", "存续", "存续", "注销", "吊销", "迁出", "存续", None)
SCALES = ("大型", "中型", "小型", "微型", None, "小型")
SEGMENTS = {
    "AUTOMOBILE": "制造业", "BUILDING": "建筑业", "FURNITURE": "批发和零售业",
    "HOUSEHOLD": "居民服务、修理和其他服务业", "MACHINERY": "科学研究和技术服务业",
}
SCOPES = (
    "软件开发；人工智能技术服务", "医疗器械销售", "半导体设备制造 IDC", "食品批发零售",
    "道路货物运输", "信息咨询 cloud service",
)
CHAINS = (
    "人工智能", "大数据", "工业机器人", "医疗器械", "新材料", "集成电路", "云计算",
    "生物药品", "食品加工", "网络安全",
)
FITS = ("数据智能", "高端装备", "生命科学", "其他")
HONORS = ("高新技术企业", "瞪羚企业", "专精特新企业", "企业技术中心", "雏鹰企业")
RELATIONS = ("强", "较强", "中", "弱")
FINANCINGS = ("A股主板上市", "A轮融资", "未融资", "-", "战略投资")
POSITION_TEXTS = ("上游", "中游/下游", "下游、上游", "其他")
FOLDERS = ("江苏所有企业", "上海所有企业-新版", "广东所有企业（上）", "内蒙古所有企业", "其他资料")
EMPTY_SPELLINGS = ("", " - ", "无", "NULL", "　", "???", "N/A", "值")
