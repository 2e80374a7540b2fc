"""Nothing is cut or lost: long lists, large exports, rejected rows, division files of any form."""

import json

from pyspark.sql import functions as F

from leadlake.functions import tokens
from leadlake.operators import upsert
from leadlake.operators.lists import distinct_lists, key_lists, value_rows
from leadlake.operators.search_index import best_any, build_postings, match_all
from leadlake.plans import load
from leadlake.sources.exports import export_rows, export_table
from leadlake.sources.files import division_rejects, read_division_tree


def test_a_company_keeps_all_honours(spark):
    honors = [f"h{i}" for i in range(50)]
    have = spark.createDataFrame([("c1", "n", honors)], "credit_code string, company_name string, honors array<string>")
    got = load.add_honor(have, spark.createDataFrame([("c1", "n"), ("c2", "m")], "credit_code string, company_name string"), "new")
    assert {r["credit_code"]: r["honors"] for r in got.collect()} == {"c1": [*honors, "new"], "c2": ["new"]}


def test_lists_hold_all_values_in_order(spark):
    rows = spark.createDataFrame([("k", i, [f"v{i}", "v0"]) for i in range(300)], "key string, at int, xs array<string>")
    built = distinct_lists(value_rows(rows, "key", [("a", F.col("xs"), 0), ("b", F.col("xs"), 0)], F.col("at")), "key", ("a",), ("b",))
    assert tuple(built.first()) == ("k", [f"v{i}" for i in range(300)], "v0")


def test_export_has_every_company_and_line(spark):
    companies = spark.range(60_000).select(
        F.format_string("c%05d", "id").alias("credit_code"), F.lit(1).alias("has_mobile"), F.lit(1.0).alias("capital_wan"),
    )
    contacts = spark.range(2500).select(
        F.lit("c00001").alias("credit_code"), F.lit("mobile").alias("contact_type"),
        F.format_string("1%010d", "id").alias("contact_value"), F.lit(0).alias("is_primary"),
    )
    table = export_table(export_rows(companies, contacts))
    assert table.count() == 60_001
    lines = table.filter(F.col("统一社会信用代码") == "c00001").select("续行", F.size(F.split("手机", ";")).alias("n")).collect()
    assert sorted(map(tuple, lines)) == [("1", 2000), ("2", 500)]
    assert export_rows(companies, contacts, 10).select("credit_code").distinct().count() == 10


def test_rejects_have_reasons(spark):
    companies = spark.createDataFrame([("c1", "n", None, None, 0, 0, 0, 0, 0)], "credit_code string, company_name string, website string, "
                                      "scope string, fill_score int, has_mobile int, mobile_count int, email_count int, has_contact int")
    edits = spark.createDataFrame([("c1", "website", " w ", 1), ("c1", "website", "x" * 501, 2), ("c1", "scope", "y" * 1999, 3), ("c1", None, "v", 4)],
                                  "credit_code string, field string, value string, at int")
    checked = {r["at"]: r["reject_reason"] for r in upsert.checked_edits(edits).collect()}
    assert checked == {1: None, 2: "value too long", 3: None, 4: "field not editable"}
    edited = upsert.edit_companies(companies, edits, ["at"]).first()
    assert edited["website"] == "w" and len(edited["scope"]) == 1999
    states = spark.createDataFrame([("c", "u", "blocked", "n" * 501), ("c", "u", "odd", ""), ("c", "u", None, ""), ("c", "u", "contacted", None)],
                                   "credit_code string, user_id string, status string, note string")
    assert [r["reject_reason"] for r in upsert.checked_status(states).collect()] == ["note too long", "unknown state", "unknown state", None]


def tree(name, **more):
    return {"level": "province", "name": name, "adcode": "1", "center": "1,2", "districts": [{"level": "city", "name": f"{name}市", "districts": []}], **more}


def test_division_files_of_any_form(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(tree(n), ensure_ascii=False) for n in "甲乙"))
    (tmp_path / "pretty.json").write_text(json.dumps(tree("丙"), ensure_ascii=False, indent=2))
    (tmp_path / "list.json").write_text(json.dumps([tree("丁"), tree("戊")], ensure_ascii=False, indent=1))
    (tmp_path / "named.json").write_text(json.dumps({"己": tree("己"), "庚": tree("庚")}, ensure_ascii=False, indent=1))
    (tmp_path / "mixed.json").write_text(json.dumps(tree("辛"), ensure_ascii=False) + "\nnot json\n")
    (tmp_path / "broken.json").write_text("{ \"level\": \n")
    got = {(r["level"], r["name"]) for r in read_division_tree(spark, str(tmp_path)).collect()}
    assert got == {(level, n + ("市" if level == "city" else "")) for n in "甲乙丙丁戊己庚辛" for level in ("province", "city")}
    rejected = {r["src_file"]: r["bad_lines"] for r in division_rejects(spark, str(tmp_path)).collect()}
    assert rejected == {"mixed.json": 1, "broken.json": 1}


def test_tokens_of_all_scripts(spark):
    text = "Élan vital, über-Straße 12½ Ωμέγα слово 人工x智"
    got = spark.createDataFrame([(text,)], "t string").select(tokens.tokens(F.col("t")).alias("x")).first()["x"]
    assert {"élan", "vital", "über", "straße", "ωμέγα", "слово", "x", "人", "工", "人工", "智"} <= set(got)


def test_token_queries_read_whole_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b"), (3, "a f é")], "id long, text string")
    queries = spark.createDataFrame([(1, "a b c d e f"), (2, "a"), (3, "é a")], "query_id long, query string")
    index = build_postings(docs, "id", "text")
    assert sorted(map(tuple, match_all(index, queries, "id").collect())) == [(1, 1), (2, 1), (2, 2), (2, 3), (3, 3)]
    assert sorted(map(tuple, best_any(index, queries, "id", 1).collect())) == [(1, 1, 6), (2, 1, 1), (3, 3, 2)]


def test_loads_keep_whole_values_unless_limited(spark):
    fields = ("name", "credit", "address", "website", "former", "insured", "mobile", "landline", "email", "email2")
    row = ("名" * 150, "91330100MA2ABCDEFG", "路" * 400, "w" * 700, "f" * 900, "3000000", "", "", "", "")
    rows = spark.createDataFrame([(*row, "a")], ", ".join(f"{f} string" for f in (*fields, "src_file")))
    as_of = F.lit("2026-01-01").cast("date")
    columns = ["company_name", "address", "website", "former_name", "insured_count"]
    whole = load.registry_companies(load.keyed_registry(rows), as_of, ["src_file"]).select(columns).first()
    assert tuple(whole) == (row[0], row[2], row[3], row[4], 3_000_000)
    cut = load.registry_companies(load.keyed_registry(rows, limits=True), as_of, ["src_file"], limits=True).select(columns).first()
    assert [len(v.encode()) for v in cut[:4]] == [300, 498, 300, 500] and cut["insured_count"] == 2_000_000
    certs = rows.selectExpr("*", "repeat('c', 90) as cert_no")
    assert load.certificates(certs, "table", ["src_file"]).first()["company_name"] == row[0]


def test_lists_made_at_the_key_are_those_of_values(spark):
    import random

    chance = random.Random(7)
    word = lambda: chance.choice([None, "", "a", "b", "c", "甲", "x\x1ey", "\x1f0", "\x1d\x1fb"])
    rows = [
        (chance.choice([None, "hot", "hot", *[f"k{i}" for i in range(30)]]), chance.choice([None, 1, 2, 3]), word(), chance.choice([None, [], [word(), word()]]), chance.randrange(3))
        for _ in range(3000)
    ] + [("empty", 1, None, None, 0), ("blank", 2, "", [""], 0)]
    df = spark.createDataFrame(rows, "key string, at int, x string, xs array<string>, rank int")
    given = df.withColumn("xs", F.coalesce("xs", F.array().cast("array<string>")))
    items = [("many", F.array("x"), 1), ("many", F.col("xs"), 0), ("one", F.col("xs"), F.col("rank")), ("last", F.array("x"), 0), ("other", F.array("x"), 2)]
    args = (F.struct("at"), ("many", "other"), ("one",), ("last",))
    want = sorted(map(repr, distinct_lists(value_rows(given, "key", items, args[0]), "key", *args[1:]).collect()))
    usual = key_lists(df, "key", items, *args)
    assert sorted(map(repr, usual.collect())) == want
    # One move of the rows as they are, none of their values.
    plan = lambda df: df.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan(usual) and plan(usual).count("Exchange hash") == 1
    hot = key_lists(df, "key", items, *args, rows=100)
    assert sorted(map(repr, hot.collect())) == want
    assert "Generate" in plan(hot)
