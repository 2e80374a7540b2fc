"""Queries whose rows meet in crowded places, beside brute force."""

import math
import random

from pyspark.sql import functions as F

from leadlake.catalog import entry
from leadlake.fixed_values import EARTH_RADIUS_M
from leadlake.operators import nearby, ranking, search_index
from leadlake.plans import leads


def metres(lng1, lat1, lng2, lat2):
    x = math.sin(math.radians(lng2 - lng1) / 2) ** 2 * math.cos(math.radians(lat1)) * math.cos(math.radians(lat2))
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(math.sin(math.radians(lat2 - lat1) / 2) ** 2 + x))


def test_nearest_of_crowds_and_lonely_places(spark):
    crowd = [(f"c{i:04}", 120 + (i % 40) ** 2 / 20000, 30 + (i % 23) ** 2 / 9000) for i in range(1200)]
    same = [(f"s{i:03}", 120.001, 30.001) for i in range(300)]
    lonely = [("far1", 120.9, 30.4), ("far2", 121.4, 30.1), ("north", 20.0, 69.97), ("none", None, 30.0)]
    rows = crowd + same + lonely
    centres = [(1, 120.0, 30.0, 6000.0), (2, 120.001, 30.001, 500.0), (3, 121.1, 30.2, 60000.0), (4, 20.02, 70.0, 9000.0), (5, 10.0, 10.0, 9000.0), (6, 120.04, 30.03, 30000.0), (7, 120.0, 30.0, None)]
    companies = spark.createDataFrame(rows, "credit_code string, lng double, lat double")
    asked = spark.createDataFrame(centres, "centre_id long, lng double, lat double, radius_m double")
    found = nearby.nearest(asked, companies, "credit_code", 5)
    got = sorted((r["centre_id"], r["distance_m"], r["credit_code"]) for r in found.collect())
    want = []
    for centre, lng, lat, radius in centres:
        if radius is not None:
            away = [(metres(lng, lat, x, y), code) for code, x, y in rows if x is not None]
            near = sorted((math.floor(m + 0.5), code) for m, code in away if m <= radius)
            want += [(centre, m, code) for m, code in near[:5]]
    assert got == sorted(want)


def test_nearest_does_not_pair_all_within_the_radius(spark):
    """2000 companies and 200 centres in one town: far fewer pairs than 400 000 are ranked."""
    town = spark.range(2000).select(F.format_string("%05d", "id").alias("credit_code"), (120 + F.rand(1) / 50).alias("lng"), (30 + F.rand(2) / 50).alias("lat")).localCheckpoint()
    centres = spark.range(200).select(F.col("id").alias("centre_id"), (120 + F.rand(3) / 50).alias("lng"), (30 + F.rand(4) / 50).alias("lat"), F.lit(5000.0).alias("radius_m")).localCheckpoint()
    ranked = []
    keep = nearby.top_per_key

    def counted(df, keys, order, n):
        if keys == ["centre_id"]:
            ranked.append(df.count())
        return keep(df, keys, order, n)

    nearby.top_per_key = counted
    try:
        assert nearby.nearest(centres, town, "credit_code", 5).count() == 1000
    finally:
        nearby.top_per_key = keep
    assert ranked[0] < 80_000


def test_best_of_frequent_words_is_that_of_all_pairs(spark, monkeypatch):
    random.seed(5)
    words = [f"w{i}" for i in range(25)]
    texts = [(i // 2, " ".join(w for j, w in enumerate(words) if random.random() < 1 / (1 + j / 2))) for i in range(240)]
    asked = [(i % 33, " ".join(random.sample(words, random.randint(0, 6)) + [f"unknown{i}"])) for i in range(40)] + [(None, "w0 w1 w20"), (90, None)]
    index = search_index.build_postings(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    queries = spark.createDataFrame(asked, "query_id int, query string")
    want = {}
    for q, a in asked:
        for k, t in texts:
            hits = len(set(t.split()) & set((a or "").split()))
            if hits:
                want[q, k] = want.get((q, k), 0) + hits
    best = set()
    for q in {q for q, _ in want}:
        ranked = sorted((-h, k) for (p, k), h in want.items() if p == q)[:7]
        best |= {(q, k, -h) for h, k in ranked}

    def all_pairs(*_):
        raise AssertionError("every row with any word meets its queries")

    monkeypatch.setattr(search_index, "match_any", all_pairs)
    assert {tuple(r) for r in search_index.best_any(index, queries, "id", 7).collect()} == best


def test_queries_compile_wide_projections_in_any_session(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    kept = spark.conf.get(limit)
    spark.conf.unset(limit)
    try:
        entry.query("__probe")(lambda s, _: s.range(1))
        entry.QUERIES.pop("__probe")(spark, "")
        assert spark.conf.get(limit) == "8000"
    finally:
        spark.conf.set(limit, kept)


def test_pool_stages_base_rows_once_and_lists_their_values_first(spark):
    base = spark.createDataFrame(
        [("甲公司", "91" + "0" * 15 + "1", "f2", "大数据", 1), ("乙公司", "91" + "0" * 15 + "2", "f9", "", 1), ("丙公司", "无", None, None, 1)],
        "name string, credit string, source_file string, source_industry string, row_no int",
    )
    chain = spark.createDataFrame(
        [("甲公司", "91" + "0" * 15 + "1", "人工智能", "f1", "新材料", 2), ("甲公司", "91" + "0" * 15 + "1", "大数据", "f2", "新材料", 3), ("丁公司", "无", "大数据", "f3", "", 4)],
        "name string, credit string, l1 string, source_file string, source_industry string, row_no int",
    )
    for c in ("l2", "l3", "l4", "node", "position", "relatedness", "financing"):
        chain = chain.withColumn(c, F.lit(""))
    honor = spark.createDataFrame([], "credit_key string, honor string")
    order = ["source_file", "row_no"]
    staged = leads.stage_base(base.withColumns({c: F.lit("") for c in ("phone", "email")}), order)
    merged = leads.merge_pool(staged, leads.stage_chain(chain, order), honor, order)
    got = {r["company_name"]: (r["chain_industries"], r["source_files"]) for r in merged.collect()}
    assert got == {
        "甲公司": (["大数据", "人工智能", "新材料"], "f2 | f1"), "乙公司": ([], "f9"), "丙公司": ([], ""), "丁公司": (["大数据"], "f3"),
    }
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number()") == 1


def test_percentiles_move_only_the_values_around_them(spark, tmp_path, monkeypatch):
    values = {g: random.Random(n).sample(range(10 * n), n) for g, n in (("hot", 20_000), ("cold", 300), ("one", 1))}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("hot", None), (None, 5.0), ("none", None)]
    spark.createDataFrame(rows, "g string, v double").repartition(5).write.parquet(f"{tmp_path}/values")
    df, fractions = spark.read.parquet(f"{tmp_path}/values"), {"first": 0.0, "p50": 0.5, "p5001": 0.5001, "max": 1.0}
    want = {(g, s, float(sorted(vs)[min(int(len(vs) * p), len(vs) - 1)])) for g, vs in values.items() for s, p in fractions.items()}
    found = ranking.exact_percentiles(df, ["g"], "v", fractions)
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "lambdafunction" not in plan
    for poor in (2, 7):
        monkeypatch.setattr(ranking, "SKETCH", poor)
        assert {tuple(r) for r in ranking.exact_percentiles(df, ["g"], "v", fractions).collect()} == want
