"""The ranked lookup of map centres, with every kind of fallback."""

import pytest

from pyspark.sql import functions as F

from leadlake.operators import divisions as div
from leadlake.operators.divisions import admin_centres

DIVISIONS = "row_key string, level string, province string, city string, district string, street string, center_lng double, center_lat double"
TREE = [
    ("1", "province", "浙江省", "", "", "", 120.0, 29.0),
    ("2", "city", "浙江省", "宁波市", "", "", 121.5, 29.8),
    ("3", "city", "浙江省", "杭州市", "", "", 120.2, 30.2),
    ("4", "district", "浙江省", "杭州市", "西湖区", "", 120.1, 30.3),
    ("5", "district", "浙江省", "杭州市", "滨江区", "", None, 30.1),
    ("6", "street", "浙江省", "杭州市", "西湖区", "北山街道", 120.14, 30.26),
    ("7", "street", "浙江省", "杭州市", "滨江区", "西兴街道", 120.22, 30.18),
    ("8", "province", "重庆市", "", "", "", 107.0, 29.5),
    ("9", "city", "重庆市", "重庆郊县", "", "", 108.0, 30.0),
    ("91", "city", "重庆市", "重庆城区", "", "", 106.5, 29.5),
    ("92", "district", "重庆市", "重庆郊县", "城口县", "", 108.6, 31.9),
    ("93", "city", "无纬省", "某市", "", "", 100.0, None),
    ("94", "city", "河南省", "济源市", "", "", 112.6, 35.0),
]
ASKED = [
    # province, city, district, street; longitude, zoom, name
    (("浙江省", "杭州市", "西湖区", "北山街道"), (120.14, 15, "北山街道")),
    (("浙江省", "杭州市", "无此区", "北山街道"), (120.14, 15, "北山街道")),
    (("", "杭州市", "西湖区", "北山街道"), (120.14, 15, "北山街道")),
    (("浙江省", "杭州市", "西湖区", "无此街道"), (120.1, 13, "无此街道")),
    (("浙江省", "未知市", "西湖区", ""), (120.1, 13, "西湖区")),
    (("", "未知市", "西湖区", ""), (None, 11, "西湖区")),
    (("浙江省", "杭州市", "滨江区", ""), (120.2, 11, "滨江区")),
    (("浙江省", "杭州市", "", "北山街道"), (120.2, 11, "北山街道")),
    (("浙江省", "未知市", "", ""), (121.5, 11, "未知市")),
    (("重庆市", "未知市", "", ""), (106.5, 11, "未知市")),
    (("重庆市", "重庆市", "城口县", ""), (108.6, 13, "城口县")),
    (("浙江省", "", "西湖区", ""), (120.0, 8, "西湖区")),
    (("浙江省", None, None, None), (120.0, 8, "浙江省")),
    (("火星省", "", "", ""), (None, 8, "火星省")),
    (("无纬省", "某市", "", ""), (None, 11, "某市")),
    (("河南省", "省直辖县级行政区划", "济源市", ""), (112.6, 11, "济源市")),
    ((None, None, None, None), (None, 10, "")),
]


@pytest.fixture(scope="module")
def answers(spark):
    rows = [(i, *place) for i, (place, _) in enumerate(ASKED)] + [(0, *ASKED[0][0])]
    asked = spark.createDataFrame(rows, "id int, province string, city string, district string, street string")
    return admin_centres(asked, spark.createDataFrame(TREE, DIVISIONS))


def test_every_fallback(answers):
    got = {r["id"]: ((r["lng"], r["zoom"], r["name"])) for r in answers.collect()}
    assert got == {i: expected for i, (_, expected) in enumerate(ASKED)}
    assert answers.count() == len(ASKED) + 1


def test_found_place_and_flag(answers):
    got = {r["id"]: r for r in answers.collect()}
    assert got[1]["ok"] and got[1]["found_district"] == "西湖区" and got[9]["found_city"] == "重庆城区"
    assert not got[14]["ok"] and not got[13]["ok"] and got[4]["found_city"] == "杭州市"


def test_one_shuffle(spark, tmp_path):
    spark.createDataFrame(TREE, DIVISIONS).write.parquet(f"{tmp_path}/divisions")
    spark.createDataFrame([p for p, _ in ASKED], "province string, city string, district string, street string").write.parquet(f"{tmp_path}/asked")
    stored = admin_centres(spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/divisions"))
    assert stored._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("sent", [50_000, 0])
def test_every_place_is_looked_up_once(spark, monkeypatch, sent):
    looked, keep = [], div.place_centres

    def counted(places, divisions):
        looked.append(places.count())
        return keep(places, divisions)

    monkeypatch.setattr(div, "place_centres", counted)
    monkeypatch.setattr(div, "SENT_PLACES", sent)
    rows = [(i, *place) for i, (place, _) in enumerate(ASKED)] + [(99, " 浙江省", "杭州市 ", "西湖区", "北山街道"), (99, "", "", None, "")]
    columns = "`rank` int, province string, city string, district string, street string"
    asked = spark.createDataFrame(rows, columns).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50))))
    found = admin_centres(asked, spark.createDataFrame(TREE, DIVISIONS))
    assert found.columns[:6] == asked.columns
    got = [(r["rank"], r["copy"], r["lng"], r["zoom"], r["name"], r["province"]) for r in found.collect()]
    want = [(i, *expected, place[0]) for i, (place, expected) in enumerate(ASKED)] + [(99, *ASKED[0][1], " 浙江省"), (99, None, 10, "", "")]
    assert sorted(got, key=repr) == sorted(((w[0], c, *w[1:]) for w in want for c in range(1, 51)), key=repr)
    assert looked == [len(ASKED) + 2]
