import zlib
from collections import defaultdict

import pytest

from leadlake.llm import mixing, sharding
from leadlake.llm.queries import op1_mix_sources, op4_shard_bytes

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string"


def filled(sizes):
    """Targets by repeated sharing, as the rule is worded."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_draws(spark):
    rows = op1_mix_sources(spark, SF).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    sizes, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        target[s] = r["target"]
        taken[s] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = filled(sizes)
    assert target == pytest.approx(want)
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.1)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op1_mix_sources(spark, SF).collect()))


def test_reshared_excess_needs_rounds(spark):
    sizes = [("a", 1), ("b", 10), ("c", 100), ("d", 2), ("e", 1000), (None, 0), ("f", 7)]
    got = mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(filled(dict(sizes)))


def test_mixing_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (2, None, "y"), (3, "", "y"), (4, " \t", "z")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as size", "'k' as target", "2 as copies", "3 as source_size")
    planned = mixing.plan_mixture(docs).collect()
    assert len(planned) == 6
    assert {r["size"] for r in planned if r["_doc"]["source"] in ("y", "z")} == {0}
    assert len({r["copies"] for r in planned if r["_doc"]["doc_id"] == 1}) == 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in planned)
    assert mixing.mix(docs.limit(0)).collect() == []


def test_shards_against_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    total = sum(len((t or "").encode()) + 1 for _, t in docs)
    want, start, slots = {}, 0, defaultdict(int)
    for doc_id, text in docs:
        size = len((text or "").encode()) + 1
        shard = min(15, int((start + size / 2) * 16 / total))
        want[doc_id] = (size, zlib.crc32((text or "").encode()), "bytes", shard, slots[shard], None)
        slots[shard] += 1
        start += size
    got = {r["doc_id"]: tuple(r)[1:] for r in op4_shard_bytes(spark, SF).collect()}
    assert got == want


def test_shard_edges(spark):
    rows = [(None, None)] * 40 + [(5, "x" * 10)] * 40 + [(1, "")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as shard", "0 as slot", "7 as part", "'n' as `odd name.x`")
    out = sharding.shard_documents(docs, shards=4)
    assert set(out.columns) == {"doc_id", "text", "part", "odd name.x", "size", "shard", "slot"}
    got = defaultdict(list)
    for r in out.collect():
        got[r["shard"]].append((r["slot"], r["size"]))
    assert sorted(got) == [0, 1, 2, 3]
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in got.values())
    assert max(sum(b for _, b in v) for v in got.values()) - min(sum(b for _, b in v) for v in got.values()) <= 22
    assert sharding.shard_documents(docs.limit(0)).collect() == []
    one = sharding.shard_documents(spark.createDataFrame([(1, "a" * 1000), (2, "b")], "doc_id long, text string"), shards=4).collect()
    assert [(r["doc_id"], r["slot"]) for r in one] == [(1, 0), (2, 0)]


@pytest.mark.parametrize(("shards", "rows"), [(500, 3000), (20_000, 30_000), (20_000, 700)])
def test_many_shards_against_brute_force(spark, shards, rows):
    docs = [(i, "x" * (i * 7919 % 23)) for i in range(rows)]
    total = sum(len(t) + 1 for _, t in docs)
    want, start, slots = {}, 0, defaultdict(int)
    for doc_id, text in docs:
        shard = min(shards - 1, int((start + (len(text) + 1) / 2) * shards / total))
        want[doc_id] = (shard, slots[shard])
        slots[shard] += 1
        start += len(text) + 1
    out = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), shards=shards)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in out.collect()} == want


def test_shards_with_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b" * 3_000_000), (3, "c"), (4, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_documents(docs, shards=4).orderBy("doc_id").collect()] == [
        (1, 0, 0), (2, 1, 0), (3, 3, 0), (4, 3, 1),
    ]


def test_mixing_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 1_000_000, "x"), (2, "a", "y")], DOCS)
    assert {r["_doc"]["doc_id"]: r["size"] for r in mixing.plan_mixture(docs).collect()} == {1: 1_000_000, 2: 1}
