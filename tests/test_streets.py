"""Street matching against a brute-force reading of the same rules."""

import re

from pyspark.sql import functions as F

from leadlake.functions import street
from leadlake.operators.divisions import geocode, match_streets, same_city

STREETS = ["新华街道", "新华镇", "城关镇", "南湖乡", "红旗街道办事处"]
DIVISIONS = [(f"s{i}", "street", "江苏省", "南京市", "玄武区", s, 118.0 + i, 32.0) for i, s in enumerate(STREETS)]
DIVISIONS += [("d", "district", "江苏省", "南京市", "玄武区", "", 118.5, 32.5), ("b", "street", "北京市", "北京城区", "东城区", "东华门街道", 116.4, 39.9)]
DIVISION_SCHEMA = "row_key string, level string, province string, city string, district string, street string, center_lng double, center_lat double"
ADDRESSES = {
    "江苏省南京市玄武区新华街道1号": "新华街道",
    "南京玄武区城关镇": "城关镇",
    "玄武区中山路8号（南湖乡）": "南湖乡",
    "玄武区城关街道2号": "城关镇",
    "玄武区新华乡3号": "新华街道",
    "玄武区大城关镇政府": "",
    "玄武区一二三四五六七八九十一二三四五六七八九十一二三四五六七八九十城关镇1号": "",
    "高新区红旗街道办事处": "红旗街道办事处",
    "玄武区红旗街道7号": "红旗街道办事处",
    "": "",
}


def companies(spark, rows):
    schema = "credit_code string, province string, city string, district string, address string, street string, lng double, lat double, status string, fill_score int, geo_precision string"
    return spark.createDataFrame(rows, schema)


def test_address_book(spark):
    rows = [(str(i), "江苏省", "南京市", "玄武区", a, None, None, None, "存续", 1, None) for i, a in enumerate(ADDRESSES)]
    rows.append(("x", "北京市", "北京市", "东城区", "北京市东城区东华门街道1号", "东华门街道", None, None, "存续", 1, None))
    rows.append(("y", "湖南省", "长沙市", None, "芙蓉街道", None, None, None, "注销", 1, None))
    c = companies(spark, rows)
    divisions = spark.createDataFrame(DIVISIONS, DIVISION_SCHEMA)
    got = {r["credit_code"]: r["matched_street"] for r in match_streets(c, divisions).collect()}
    assert [got[str(i)] for i in range(len(ADDRESSES))] == list(ADDRESSES.values())
    assert got["x"] == "东华门街道" and got["y"] == ""
    # Another spelling of the city is still the same city.
    assert same_city(c, divisions, "street", ["district", "street"]).select("credit_code").collect() == [("x",)]
    placed = {r["credit_code"]: r["geo_precision"] for r in geocode(c, divisions).collect()}
    assert placed["x"] == "street" and placed["0"] == "district" and placed["y"] is None


def brute_scan(body):
    """Every start and kind, tried one by one."""
    found = []
    for i in range(min(len(body), 32)):
        for rank, kind in enumerate(["街道办事处", "街道", "镇", "乡", "苏木"]):
            for n in range(2, 6):
                prefix, rest = body[i : i + n], body[i + n :]
                if len(prefix) == n and re.fullmatch("[一-鿿0-9]+", prefix) and rest.startswith(kind):
                    if not re.search("街道办事处|街道|镇|乡|苏木", prefix):
                        name = (prefix + kind).replace("街道办事处", "街道")
                        if 3 <= len(name) <= 12:
                            found.append(((-99 if i == 0 else -i), len(name), rank, name))
                    break
    return min(found)[3] if found else ""


def test_scan_equals_brute_force(spark):
    bodies = ["新华街道1号", "中山路城关镇8号", "八里庄南里红旗街道办事处", "abc路12号", "大王乡小李镇", "一号院和平里街道东土城", "镇", "白音苏木3组", "人民镇街道"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    none = F.array().cast("array<string>")
    got = [r[0] for r in df.select(street.scanned_street(F.col("body"), F.lit("^$"), none)).collect()]
    assert got == [brute_scan(b) for b in bodies]


def test_scan_reads_the_whole_text(spark):
    filler = "甲，" * 60
    bodies = [filler + "红旗街道1号", filler + "南湖乡，" + filler + "城关镇", "新华镇" + filler + "城关镇", filler, "", None]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    none = F.array().cast("array<string>")
    got = [r[0] for r in df.select(street.scanned_street(F.col("body"), F.lit("^$"), none)).collect()]
    assert got == ["红旗街道", "城关镇", "新华镇", "", "", ""]


def test_prefix_and_zone(spark):
    df = spark.createDataFrame(
        [("江苏省·南京市,玄武区高新区新华路", "江苏省", "南京市", "玄武区"), ("江苏南京新华路", "江苏省", "南京市", "玄武区"), ("新华路", None, None, None)],
        "a string, p string, c string, d string",
    )
    pattern = street.prefix_pattern(F.col("p"), F.col("c"), F.col("d"))
    body = street.without_zone(street.without_prefix(F.col("a"), pattern))
    assert [r[0] for r in df.select(body).collect()] == ["新华路"] * 3
