"""Files in, files out, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from leadlake.plans import load
from leadlake.sources import exports, files, headers
from leadlake.streaming import increments


def test_registry_file_end_to_end(spark, tmp_path):
    folder = tmp_path / "江苏所有企业"
    folder.mkdir()
    text = "﻿ 公司名称,统一社会信用代码,登记状态,有效手机号,更多电话,邮箱,所属省份,未知列\n"
    text += '甲公司,91330100MA2ABCDEFG,开业,"13812345678;1",010-12345678 13900000000,A@B.cn,,x\n'
    text += "甲公司,91330100ma2abcdefg,,13812345678,,,,\n乙公司,无,注销\n,91330100MA2ABCDEFH,,,,,,\n"
    (folder / "a.csv").write_text(text, encoding="utf-8")
    rows = files.read_registry(spark, str(folder))
    assert "未知列" not in rows.columns and rows.count() == 4
    keyed = load.keyed_registry(rows)
    as_of = F.lit("2026-01-01").cast("date")
    got = {r["company_name"]: r for r in load.registry_companies(keyed, as_of, ["src_file"]).collect()}
    assert set(got) == {"甲公司", "乙公司"}
    assert got["甲公司"]["status"] == "存续" and got["甲公司"]["mobile_count"] == 2
    assert got["甲公司"]["province"] == "江苏省" and got["乙公司"]["credit_code"].startswith("N")
    points = load.registry_contacts(keyed, ["src_file"], "registry", as_of)
    primary = {r["contact_value"]: r["is_primary"] for r in points.collect()}
    assert primary == {"13812345678": 1, "13900000000": 0, "010-12345678": 1, "a@b.cn": 1}


def test_required_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("登记状态\nx\n", encoding="utf-8")
    with pytest.raises(ValueError, match="credit, name"):
        files.read_registry(spark, str(tmp_path))


def test_monthly_and_certificates(spark, tmp_path):
    month = tmp_path / "month.csv"
    month.write_text('甲,王,2020-01-01,路,企业,91330100MA2ABCDEFG,100万,制造业,上海-宝山区,销售,13812345678\n', encoding="utf-8")
    rows = files.read_positional(spark, str(month))
    assert rows.columns[:2] == ["name", "legal"] and rows.first()["region"] == "上海-宝山区"
    certs = tmp_path / "certs"
    certs.mkdir()
    head = "公司名称,统一信用代码,证书编号,认定年度,发证日期,证书有效期,是否取消资格\n"
    (certs / "2021.csv").write_text(head + "甲,91330100MA2ABCDEFG,,2021,2021-12-01,至2024年11月30日,否\n乙,123,,2021,,,\n", encoding="utf-8")
    (certs / "2020.csv").write_text(head + "甲,91330100MA2ABCDEFG,GR1,2020,,,是\n", encoding="utf-8")
    table = files.read_certificate_table(spark, str(certs), years=[2021])
    good, rejects = files.split_rejects(table)
    made = load.certificates(good, "table", ["src_file"]).collect()
    assert [(r["cert_no"], str(r["valid_to"]), r["revoked"]) for r in made] == [("HT-2021-2ABCDEFG", "2024-11-30", 0)]
    assert [(r["name"], r["reason"]) for r in rejects.collect()] == [("乙", "credit_not_18")]
    files.write_rejects(rejects, str(tmp_path / "rejects"))
    assert spark.read.csv(str(tmp_path / "rejects"), header=True).count() == 1


def test_sections(spark):
    rows = [
        ("基础信息", ["登记状态", "注册资本", "公司名称", "公司名称"], ["存续", "1", "-", "甲"]),
        ("x", ["甲", "存续"], ["甲", "存续"]), ("链", ["一级分类", "公司 "], ["a", "b"]),
        ("瞪羚企业", ["a"], ["b"]), ("Sheet3", ["登记状态", "注册资本"], []), ("y", ["荣誉", "ID"], []), ("z", ["q"], []),
    ]
    df = spark.createDataFrame(rows, "section string, header array<string>, cells array<string>")
    kinds = [r[0] for r in df.select(files.section_kind(F.col("section"), F.col("header"))).collect()]
    assert kinds == ["base", "base_no_header", "chain", "honor", "skip", "honor", "skip"]
    base = files.route_sections(df)["base"]
    picked = files.pick_cell(F.col("header"), F.col("cells"), "系统匹配企业名称", "公司名称")
    assert base.select(picked).first()[0] == "甲"


def test_division_tree(spark, tmp_path):
    tree = {"level": "province", "name": "江苏省", "adcode": "32", "center": "118.7,32.0", "districts": [
        {"level": "city", "name": "南京市", "adcode": "3201", "center": "bad", "districts": [
            {"level": "district", "name": "玄武区", "adcode": "320102", "center": "", "districts": [
                {"level": "street", "name": "新华街道", "adcode": "320102", "center": "1,2"}]}]}]}
    (tmp_path / "t.json").write_text(json.dumps(tree, ensure_ascii=False), encoding="utf-8")
    rows = {r["level"]: r for r in files.read_division_tree(spark, str(tmp_path)).collect()}
    assert rows["street"]["row_key"] == "street|320102|320102|新华街道"
    assert (rows["street"]["province"], rows["street"]["city"], rows["street"]["district"]) == ("江苏省", "南京市", "玄武区")
    assert rows["city"]["center_lng"] is None and rows["province"]["center_lat"] == 32.0


def test_export_file(spark, tmp_path):
    df = spark.createDataFrame([("c1", None)], "credit_code string, company_name string")
    table = exports.export_table(df)
    assert table.columns == list(headers.EXPORT.values()) and len(table.columns) == 45
    exports.write_csv(table, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿统一社会信用代码,企业名称")


def test_resumed_stream_reads_every_file_once(spark, tmp_path):
    source, check, out = (str(tmp_path / n) for n in ("in", "check", "out"))
    schema = "k int, seq int, v string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)

    def run():
        stream = increments.file_stream(spark, source, schema, format="json")
        increments.upsert_stream(stream, check, out, ["k"], "seq", ["v"]).awaitTermination()
        return {r["k"]: r["v"] for r in increments.read_upserted(spark, out, ["k"], "seq", ["v"]).collect()}

    arrive([(1, 1, "a"), (1, 3, "b"), (2, 1, "c")])
    assert run() == {1: "b", 2: "c"}
    assert run() == {1: "b", 2: "c"}
    arrive([(1, 2, "late"), (2, 1, "again"), (3, 0, "d")])
    assert run() == {1: "b", 2: "again", 3: "d"}
    increments.compact(spark, out, str(tmp_path / "compact"), ["k"], "seq", ["v"], 2)
    assert increments.read_upserted(spark, str(tmp_path / "compact"), ["k"], "seq", ["v"]).count() == 3


def test_only_new_files_are_listed(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("x", encoding="utf-8")
    none = spark.createDataFrame([], "file_key string")
    first = files.new_files(spark, str(tmp_path), none)
    ledger = spark.createDataFrame([(r["file_key"],) for r in first.collect()], "file_key string")
    assert ledger.count() == 2
    (tmp_path / "a.csv").write_text("xy", encoding="utf-8")
    left = files.new_files(spark, str(tmp_path), ledger).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in left] == ["a.csv"]


def test_contact_flags_over_batches_and_a_compaction(spark, tmp_path):
    schema = "credit_code string, contact_type string, contact_value string, op string, at long"
    source, target, folded = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "folded")

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = increments.file_stream(spark, source, schema)
        increments.contact_change_stream(stream, str(tmp_path / "check"), target, ["at"]).awaitTermination()

    def flags(where, **options):
        return {r["credit_code"]: (r["mobile_count"], r["email_count"]) for r in increments.current_flags(spark, where, ["at"], **options).collect()}

    arrive(("a", "mobile", "1", "add", 1), ("a", "mobile", "2", "add", 2), ("b", "email", "x", "add", 3), ("c", "mobile", "9", "add", 4))
    arrive(("a", "mobile", "1", "delete", 5), ("c", "mobile", "9", "delete", 6))
    assert flags(target) == {"a": (1, 0), "b": (0, 1), "c": (0, 0)}
    assert flags(target, after_batch=0) == {"a": (1, 0), "c": (0, 0)}
    increments.compact_contacts(spark, target, folded, ["at"], 2)
    assert flags(folded) == flags(target)
    assert spark.read.parquet(f"{folded}/delta").count() == 4
