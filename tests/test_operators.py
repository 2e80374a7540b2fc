"""Upserts, ranking and search semantics on small tables, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from leadlake.operators import aggregates as agg
from leadlake.operators import predicates as pred
from leadlake.operators import upsert
from leadlake.operators.predicates import CompanyFilter, select_companies
from leadlake.operators.ranking import exact_percentiles, keep_best
from leadlake.operators.search_index import build_postings, match_all, match_any
from leadlake.plans import search
from leadlake.schemas import COMPANIES, Tables, conform
from leadlake.sources.exports import export_rows

ROWS = "credit_code string, name string, fill_score int, no int"


def test_first_of_equal_rows_is_kept(spark):
    df = spark.createDataFrame([("a", "x", 5, 2), ("a", "y", 5, 1), ("a", "z", 4, 0), ("b", "u", 1, 3), ("c", "v", None, 4), ("c", "w", 0, 5)], ROWS)
    got = {r["credit_code"]: r["name"] for r in keep_best(df, ["credit_code"], "fill_score", ["no"]).collect()}
    assert got == {"a": "y", "b": "u", "c": "w"}


def test_upsert_takes_the_greater_sequence(spark):
    old = spark.createDataFrame([("a", "old", 5, 0), ("b", "old", 5, 0), ("c", "old", 1, 0)], ROWS)
    new = spark.createDataFrame([("a", "new", 4, 1), ("b", "new", 5, 1), ("b", "newer", 5, 2), ("d", "new", 0, 1)], ROWS)
    got = {r["credit_code"]: r["name"] for r in upsert.upsert_rows(old, new, arrival=["no"]).collect()}
    assert got == {"a": "old", "b": "newer", "c": "old", "d": "new"}


def test_partial_patch_sets_null_but_not_absent_columns(spark):
    target = spark.createDataFrame([("a", "x", 1, 7), ("b", "x", 9, 7)], ROWS)
    patch = spark.createDataFrame([("a", None, 2), ("b", "y", 3)], "credit_code string, name string, fill_score int")
    got = {r["credit_code"]: (r["name"], r["no"], r["fill_score"]) for r in upsert.patch_columns(target, patch, ["name"]).collect()}
    assert got == {"a": (None, 7, 2), "b": ("x", 7, 9)}


def test_fill_blanks_never_overwrites(spark):
    schema = "credit_code string, city string, scope string, fill_score int"
    target = spark.createDataFrame([("a", None, "kept", 3), ("b", "", "", 1), ("c", "x", "y", 9)], schema)
    source = spark.createDataFrame([("a", "new", "no", 0), ("b", "p", "q", 0), ("d", "r", None, 0)], schema)
    merged = upsert.fill_blanks(target, source, ["city", "scope"], 50)
    got = {r["credit_code"]: tuple(r)[1:] for r in merged.collect()}
    assert got == {"a": ("new", "kept", 4), "b": ("p", "q", 3), "c": ("x", "y", 9), "d": ("r", None, 50)}
    assert upsert.changed_cells(target, merged, ["city", "scope"]).count() == 0


def test_anti_join_survives_null_keys(spark):
    companies = spark.createDataFrame([("a", "存续"), ("b", "存续")], "credit_code string, status string")
    marks = spark.createDataFrame([("a", "u", "blocked"), (None, "u", "blocked")], "credit_code string, user_id string, status string")
    left = pred.without_status(companies, marks, "u", ("blocked",))
    assert [r[0] for r in left.collect()] == ["b"]


def people(spark):
    rows = [
        ("A" * 18, "杭州智能科技有限公司", "王伟", "浙江省杭州市", "软件开发", 1), ("B" * 18, "智能", "李明", "上海市", "半导体 Chip", 0),
        ("C" * 18, "杭州餐饮店", "王伟", None, None, 1),
    ]
    c = spark.createDataFrame(rows, "credit_code string, company_name string, legal_person string, address string, scope string, has_mobile int")
    c = conform(c.withColumn("status", F.lit("存续")), COMPANIES)
    contacts = spark.createDataFrame(
        [("A" * 18, "mobile", "13812345678", 1), ("A" * 18, "email", "Info@x.cn", 0), ("B" * 18, "mobile", "13812345678", 0)],
        "credit_code string, contact_type string, contact_value string, is_primary int",
    )
    return Tables(c, contacts)


@pytest.mark.parametrize(
    "text, dimensions, found",
    [
        ("138-1234-5678", "", "AB"), ("info@X.cn", "", "A"), ("a" * 18, "", "A"), ("王伟", "", "AC"),
        ("智能科技有限公司", "", "A"), ("杭州", "company", "AC"), ("13812345678", "mobile，email", "AB"),
        ("王伟", "email", ""), ("info@x.cn", "company,email", "A"), ("chip", "scope", "B"), ("杭州", "address,person", "A"),
        ("智店", "", ""),
    ],
)
def test_search_text(spark, text, dimensions, found):
    tables = people(spark)
    got = select_companies(tables, CompanyFilter(), text, dimensions)
    assert sorted(r["credit_code"][0] for r in got.select("credit_code").collect()) == list(found)
    total = search.search(tables, CompanyFilter(), text, dimensions)["total"].first()[0]
    assert total == search.statistics(tables, CompanyFilter(), text, dimensions)["summary"].first()["total"] == len(found)


def test_search_texts_have_one_kind(spark):
    texts = ["a@b.c", "138 1234 5678", "0086-13812345678", "91330100ma2abcdefg", "王伟", "王伟公司", "钢", "abcdef", "", "钢材贸易商"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(pred.query_kind(F.col("t"))).collect()]
    assert got == [pred.classify_text(t) for t in texts]
    assert got == ["email", "phone", "phone", "credit", "person", "company", "keyword", "company", "", "company"]


def test_boxes():
    with pytest.raises(ValueError):
        pred.checked_box((2, 0, 1, 1))
    with pytest.raises(ValueError):
        pred.checked_box((0, 0, 9, 1), pred.LIST_SPAN)
    assert pred.too_wide((0, 0, 13, 1)) and not pred.too_wide((0, 0, 12, 9))


def test_large_company_continues_in_parts(spark):
    """One company holds most contacts; every value is exported once, in order."""
    rows = [("hot", "mobile", f"139{i:08d}", i % 2) for i in range(500)] + [("cold", "email", "a@b.c", 1)]
    random.Random(1).shuffle(rows)
    contacts = spark.createDataFrame(rows + rows[:50], "credit_code string, contact_type string, contact_value string, is_primary int")
    parts = agg.contact_lists(contacts, cell_values=90).filter("credit_code = 'hot'").orderBy("part").collect()
    assert [len(p["mobiles"].split(";")) for p in parts] == [90] * 5 + [50]
    want = sorted((-r[3], r[2]) for r in rows if r[0] == "hot")
    assert ";".join(p["mobiles"] for p in parts).split(";") == [v for _, v in want]


def test_export_keeps_companies_without_contacts(spark):
    tables = people(spark)
    rows = {r["credit_code"][0]: (r["part"], r["mobiles"]) for r in export_rows(tables.companies, tables.contacts).collect()}
    assert rows == {"A": (1, "13812345678"), "B": (1, "13812345678"), "C": (1, None)}


def test_percentiles_with_an_outlier_and_a_hot_key(spark):
    values = {"hot": [float(i % 5000) for i in range(9000)] + [1e18], "cold": [3.0, 3.0, 1.0], "one": [7.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    fractions = {"low": 0.01, "p50": 0.5, "p99": 0.99, "max": 1.0}
    got = {(r["g"], r["stat"]): r["value"] for r in exact_percentiles(df, ["g"], "v", fractions).collect()}
    assert got == {(g, s): sorted(vs)[min(int(len(vs) * p), len(vs) - 1)] for g, vs in values.items() for s, p in fractions.items()}


def test_percentiles_equal_sorted_lists(spark):
    random.seed(3)
    data = [("a", random.gauss(0, 50)) for _ in range(400)] + [("b", 7.0)] * 300 + [("c", 1.0)]
    data += [("a", 0.5)] * 400
    df = spark.createDataFrame(data, "g string, v double")
    got = {(r["g"], r["stat"]): r["value"] for r in exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "max": 1.0}).collect()}
    for g in "abc":
        values = sorted(v for k, v in data if k == g)
        for stat, p in (("p50", 0.5), ("p95", 0.95), ("max", 1.0)):
            assert got[g, stat] == values[min(int(len(values) * p), len(values) - 1)]


def test_postings_equal_brute_force(spark):
    docs = {1: "the red fox", 2: "the the dog", 3: "Red dog 人工智能", 4: "", 5: "智能 fox"}
    queries = {10: "the", 11: "red dog", 12: "智能", 13: "fox missing", 14: ""}
    words = lambda t: set(t.lower().replace("人工智能", "人 工 智 能 人工 工智 智能").replace("智能 fox", "智 能 智能 fox").split())
    d = spark.createDataFrame(list(docs.items()), "id int, text string")
    q = spark.createDataFrame(list(queries.items()), "query_id int, query string")
    index = build_postings(d, "id", "text")
    split = {10: {"the"}, 11: {"red", "dog"}, 12: {"智", "能", "智能"}, 13: {"fox", "missing"}, 14: set()}
    everything = {(i, k) for i, w in split.items() for k, t in docs.items() if w and w <= words(t)}
    assert {tuple(r) for r in match_all(index, q, "id").collect()} == everything
    some = {(i, k): len(w & words(t)) for i, w in split.items() for k, t in docs.items() if w & words(t)}
    assert {(r["query_id"], r["id"]): r["hits"] for r in match_any(index, q, "id").collect()} == some


def test_territory_wildcards(spark):
    rules = spark.createDataFrame([("浙江省", "", "", ""), ("", "南京市", "", "新华街道")], "province string, city string, district string, street string")
    companies = spark.createDataFrame(
        [("1", "浙江省", "杭州市", "x", None), ("2", "江苏省", "南京市", "y", "新华街道"), ("3", "江苏省", "南京市", "y", None), ("4", None, None, None, None)],
        "credit_code string, province string, city string, district string, street string",
    )
    assert sorted(r["credit_code"] for r in search.in_territory(companies, rules).collect()) == ["1", "2"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_limit_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("credit_code"), F.col("id").alias("fill_score"), F.col("id").alias("no"))
    plan = plan_of(keep_best(df, ["credit_code"], "fill_score", ["no"]))
    assert "WindowGroupLimit" in plan and "Partial" in plan
