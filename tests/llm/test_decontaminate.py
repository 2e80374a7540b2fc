import random
import re
from itertools import combinations

import pytest

from leadlake.llm import decontaminate
from leadlake.llm.decontaminate import EQUAL, MASKS, WINDOW, overlaps, without_overlaps

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(docs, items):
    """All aligned windows, without seeds, over items of at least WINDOW tokens."""
    out = {}
    for doc_id, text in docs:
        t = re.findall(r"[a-z0-9]+", (text or "").lower())
        for item_id, item in items:
            b = item.lower().split()
            for shift in range(-len(b), len(t)):
                same = [0 <= shift + i < len(t) and t[shift + i] == b[i] for i in range(len(b))]
                best = max(sum(same[i : i + WINDOW]) for i in range(-WINDOW, len(b)) if i >= 0)
                if best >= EQUAL:
                    out[doc_id, item_id] = max(best, out.get((doc_id, item_id), 0))
    return out


def test_masks_lose_no_window():
    for pair in combinations(range(WINDOW), WINDOW - EQUAL):
        assert any(not {p + at for p in mask} & set(pair) for mask in MASKS for at in range(WINDOW - mask[-1]))


@pytest.mark.parametrize("broadcast_seeds", [0, 10_000])
def test_substitutions(spark, broadcast_seeds):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(13, 24)))) for i in range(20)]
    docs = []
    for i in range(150):
        passage = rng.choice(items)[1].split()
        for at in rng.sample(range(len(passage)), rng.randrange(6)):
            passage[at] = "other"
        around = [[rng.choice(vocabulary) for _ in range(rng.randrange(20))] for _ in range(2)]
        words = around[0] + passage[rng.randrange(4) :] + around[1]
        docs.append((i, ", ".join(words).upper() if i % 2 else "\n".join(words)))
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' as tokens", "1 as at", "2 as item_id", "3 as `key`").repartition(4)
    got = overlaps(frame, spark.createDataFrame(items, ITEMS), broadcast_seeds=broadcast_seeds).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]): r["equal_tokens"] for r in got} == want and 20 < len(want)
    clean = without_overlaps(frame, spark.createDataFrame(items, ITEMS))
    assert clean.columns == frame.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(150)) - {d for d, _ in want}


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(20))
    items = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "one two three"), (5, "a b c d e f g h i"), (6, long), (None, "k1 k2 k3 k4 k5 k6 k7 k8")], ITEMS)
    rows = [(1, long), (1, long), (None, "x " + long), (2, None), (3, ""), (4, "one two three four five six seven eight nine ten"),
            (5, "z a b c d e f g h i z"), (6, "a b c d X f g h i"), (7, "k1 k2 k3 k4 k5 k6 k7 k8"), (8, "w " * 300_000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["item_id"], r["equal_tokens"]) for r in overlaps(docs, items).collect()}
    assert got == {(1, 1, 13), (1, 6, 13), (None, 1, 13), (None, 6, 13), (5, 5, 9), (7, None, 8)}
    assert sorted(str(r["doc_id"]) for r in without_overlaps(docs, items).collect()) == ["2", "3", "4", "6", "8"]
    assert overlaps(docs.limit(0), items).collect() == [] and overlaps(docs, items.limit(0)).collect() == []
    assert decontaminate.without_overlaps(docs, items.limit(0)).count() == len(rows)


@pytest.mark.parametrize("broadcast_seeds", [0, 10_000])
def test_short_items_match_whole(spark, broadcast_seeds):
    items = spark.createDataFrame([(1, "one two three"), (2, "Yes"), (3, "a b c d e f g"), (4, ""), (5, None), (6, "three four"), (7, " ".join(f"t{i}" for i in range(9)))], ITEMS)
    rows = [(1, "One, two, three!"), (2, "zero one two three four"), (3, "one two four three"), (4, "yes yes"), (5, "a b c d e f"), (6, "x a b c d e f g"),
            (7, None), (8, " ".join(f"t{i}" for i in range(9))), (1, "One, two, three!"), (None, "yesterday yes")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = overlaps(docs, items, match_short=True, broadcast_seeds=broadcast_seeds).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["equal_tokens"]) for r in got) == [
        ("1", 1, 3), ("2", 1, 3), ("2", 6, 2), ("4", 2, 1), ("6", 3, 7), ("8", 7, 9), ("None", 2, 1),
    ]
    assert sorted(r["doc_id"] for r in without_overlaps(docs, items, match_short=True).collect()) == [3, 5, 7]
    assert overlaps(docs, items.filter("item_id = 7"), match_short=True).count() == 1
