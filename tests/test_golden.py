"""Known inputs and results of the cleaning rules."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from leadlake.functions import capital, contacts, dates, identity, region, tags, text

A, B, C, D = (F.col(c) for c in "abcd")


def test_sentinels_are_empty(column):
    raw = ["nan", "null值", "???", "**", "*", "—", "  ", "　", None, "杭州某某科技", " N/A ", "无。"]
    got = column([(r,) for r in raw], text.clean(A))
    assert got == [None] * 9 + ["杭州某某科技", None, "无。"]
    assert column([(r,) for r in raw], text.is_empty(A)) == [True] * 9 + [False, True, False]


def test_capital(column):
    raw = ["1000万美元", "500万元", "5000", "1亿", "200000000万美元", "-", None, "9万亿", "1,000万"]
    got = column([(r, "某贸易公司") for r in raw], capital.capital_wan(A, B))
    assert got[:4] == [Decimal("7200.00"), Decimal("500.00"), Decimal("0.50"), Decimal("10000.00")]
    assert got[4] == Decimal("144000.00")
    assert got[5:7] == [None, None] and got[8] == Decimal("1000.00")
    currencies = column([(r,) for r in raw], capital.capital_currency(A))
    assert currencies[:7] == ["美元", "人民币", "人民币", "人民币", "美元", None, None]


def test_capital_thresholds(column):
    rows = [("10000000万元", "甲公司"), ("10000000万元", "国家电网公司"), ("100000000万元", "国家电网公司"),
            ("9999999万元", "甲公司"), ("600000000000000元", "甲公司"), ("6000000万亿", "甲公司")]
    got = column(rows, capital.capital_wan(A, B))
    assert got[:4] == [Decimal("1000.00"), Decimal("10000000.00"), Decimal("10000.00"), Decimal("9999999.00")]
    assert got[4] is None
    assert column(rows[4:5], capital.capital_currency(A)) == ["人民币"]


def test_capital_repair(spark):
    rows = [
        ("甲公司", "20000000万元", "20000000", "大型"), ("国家电网", "20000000万元", "20000000", "大型"),
        ("乙工会", "2000000万元", "2000000", None), ("丙公司", "无", "5000000", None), ("丁公司", "100万元", "100", None),
    ]
    df = spark.createDataFrame(rows, "n string, r string, w string, s string")
    wan = F.col("w").cast("decimal(20,2)")
    got = df.select(capital.repair_decision(F.col("r"), wan, F.col("n"), F.col("s")).alias("x")).collect()
    found = [(x[0]["capital_wan"], x[0]["reason"]) if x[0] else None for x in got]
    assert found == [
        (Decimal("2000.00"), "ge1000yi_non_soe"), None, (Decimal("200.00"), "branch_as_yuan"),
        (None, "nullify"), None,
    ]


def test_dates(column):
    raw = ["2020-06-15", "2020年6月15日", "44000", "not-a-date", "2020-02-30", "1700-01-01", "成立于2020.6.15", "２０２０-06-15"]
    day = date(2020, 6, 15)
    assert column([(r,) for r in raw], dates.parse_date(A)) == [
        day, day, date(2020, 6, 18), None, None, None, day, day,
    ]
    assert column([("2019年12月1日至2022年11月30日",), ("2021-01-02",)], dates.parse_valid_to(A)) == [
        date(2022, 11, 30), date(2021, 1, 2),
    ]
    as_of = F.lit("2026-01-01").cast("date")
    ages = column([("2016-01-01",), ("2027-01-01",), (None,)], dates.company_age(dates.parse_date(A), as_of))
    assert ages == [Decimal("10.0"), None, None]


def test_phones(column):
    assert column([("13812345678",), ("1381234567",), ("010-12345678",)], contacts.is_mobile(A)) == [True, False, False]
    assert column([("13812345678",), ("010-1234 5678",), ("12345",)], contacts.landline(A)) == [None, "010-1234 5678", None]
    cells = [("138 1234；13812345678、13812345678", "010-12345678 13900000000"), ("-", "无")]
    assert column(cells, contacts.mobiles(A, B)) == [["13812345678", "13900000000"], []]
    assert column(cells, contacts.landlines(B)) == [["010-12345678"], []]


def test_emails(column):
    cells = [("A.B+c@Example.com;not-an-email", "x@y.cn. a.b+c@example.com")]
    assert column(cells, contacts.emails(A, B)) == [["a.b+c@example.com", "x@y.cn"]]
    assert column([("写信 a@b.com 或 A@B.com, q@example.com",)], contacts.scoring_emails(A)) == [["a@b.com"]]


def test_identity(column):
    code = "91330100MA2ABCDEFG"
    got = column([(code, "甲"), (code.lower(), "甲"), ("无", "杭州某某科技有限公司")], identity.entity_code(A, B))
    assert got[:2] == [code, code]
    assert got[2].startswith("N") and len(got[2]) == 18
    assert column([(code.lower(),)], identity.is_credit_code(A)) == [False]
    assert column([("0" * 18, "甲"), ("", "")], identity.scoring_key(A, B)) == ["N:甲", None]


def test_regions(column):
    assert column([("存续（在营、开业、在册）",), ("开业",), ("怪",), ("-",)], region.status(A)) == ["存续", "存续", "怪", None]
    assert column([("上海-宝山区",), ("江苏-苏州市-吴中区",), ("",)], region.region_parts(A)) == [
        ("上海市", "上海市", "宝山区"), ("江苏省", "苏州市", "吴中区"), (None, None, None),
    ]
    folders = [("广东所有企业（上）",), ("上海所有企业-新版",), ("内蒙古所有企业",), ("其他",)]
    assert column(folders, region.folder_province(A)) == ["广东省", "上海市", "内蒙古自治区", None]
    names = [("省直辖县级行政区划", "济源市"), ("北京市", ""), ("南京市", "x"), ("", "")]
    assert column(names, region.city_names(A, B)) == [
        ["济源市", "省直辖县级行政区划"], ["北京市", "北京城区"], ["南京市"], [],
    ]


def test_byte_truncate(column):
    got = column([("杭州科技",), ("abc",), (None,), ("杭州科技x",)], text.byte_truncate(A, 5))
    assert got == ["杭", "abc", None, "杭"]


def test_tag_rules(column):
    assert column([("A股主板上市",), ("未融资",), ("未知",), ("天使轮",), (None,)], tags.finance_tag(A)) == [
        "已上市", "未融资", "未知", "有融资信号", None,
    ]
    assert column([("已撤",), ("否",), ("",), ("是",)], tags.is_revoked(A)) == [1, 0, 0, 1]
    assert column([('["a | b","c"]',), ("x | y",), ("z",), ("",)], tags.text_list(A)) == [["a", "b", "c"], ["x", "y"], ["z"], []]
    levels = tags.chain_levels(A, B, C)
    assert column([("一", "-", "三", "四")], tags.chain_path(levels, D)) == ["一 / 三 / 四"]
    assert column([("一", "", "三", "三")], tags.chain_path(levels, D)) == ["一 / 三"]


def test_bucket_label(column):
    got = column([("0",), ("49",), ("1600",), ("7",)], text.bucket_label(A.cast("int"), (0, 1, 50, 1600)))
    assert got == ["0-0", "1-49", ">=1600", "1-49"]
