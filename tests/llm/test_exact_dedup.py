import hashlib
import random
from collections import defaultdict

from leadlake.llm.exact_dedup import ContentTable, exact_groups, grace_buckets
from leadlake.session import work_dir

SPACES = " \t\n\x0b\x0c\r"


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups["".join(c for c in text or "" if c not in SPACES)].append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for content, members in groups.items():
        best = min(members)
        for _, _, doc_id, i in members:
            keep = None if best[1] else best[2]
            out.append((rows[i][0], keep, len(members), hashlib.sha256(content.encode()).hexdigest()))
    return sorted(out, key=repr), len(groups)


def test_groups_over_several_levels(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \nä\U0001f600") for _ in range(rng.randrange(12))) for _ in range(400)]
    rows = [(rng.choice([None, *range(500)]), rng.choice([None, *texts])) for _ in range(1500)] + [(i, "hot copy") for i in range(2000, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as kept", "1 as hash", "2 as content").repartition(6)
    got = exact_groups(docs, limit=600, fan_out=4).collect()
    want, n = brute(rows)
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == want
    assert sum(r["kept"] for r in got) == n
    assert exact_groups(docs.limit(0)).collect() == []


def test_buckets_fit_or_hold_one_hash(spark):
    rows = [(i % 97, 100) for i in range(1000)] + [(7, 100)] * 500
    records = spark.createDataFrame(rows, "hash long, bytes long").selectExpr("hash * 64 as hash", "bytes")
    got = grace_buckets(records, work_dir(spark), limit=20_000, fan_out=2)
    sizes = got.groupBy("bucket").agg({"bytes": "sum", "hash": "approx_count_distinct"}).collect()
    assert sum(r["sum(bytes)"] for r in sizes) == 150_000
    assert all(r["sum(bytes)"] <= 20_000 or r["approx_count_distinct(hash)"] == 1 for r in sizes)


def test_table_compares_contents_not_hashes():
    table = ContentTable()
    assert [table.find_or_add(5, f"{i % 300}".encode(), i) for i in range(900)] == [i % 300 for i in range(900)]


def test_one_row_of_repeated_rows_stays(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a ")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in exact_groups(docs).collect())
    assert got == [(1, 2, False), (1, 2, False), (2, 2, True)]
    assert sum(r["kept"] for r in exact_groups(docs.limit(2)).collect()) == 1
