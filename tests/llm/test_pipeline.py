"""The corpus pipeline: every stage against a brute-force version of its decisions."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from leadlake.llm import language_id, mixing
from leadlake.llm.common import table

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def first_of_groups(rows):
    """Smallest ids of the components of similarity 0.8."""
    sets, holders = {d: shingles(t) for d, t in rows}, defaultdict(list)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, own in sets.items():
        for x in own:
            holders[x].append(d)
    for d, own in sets.items():
        for other in {o for x in own for o in holders[x] if o > d}:
            both = len(own & sets[other])
            if 100 * both >= 80 * (len(own) + len(sets[other]) - both):
                a, b = root(d), root(other)
                parent[max(a, b)] = min(a, b)
    return {root(d) for d in sets}


def leaked(rows, items):
    """Ids of texts with 13 aligned tokens of an item of which 11 are equal."""
    out = set()
    for doc_id, text in rows:
        t = re.findall(r"[^\W_]+", text.lower())
        at = defaultdict(list)
        for i, token in enumerate(t):
            at[token].append(i)
        for item in items:
            shifts = {p - i for i, token in enumerate(item) for p in at.get(token, ())}
            for shift in shifts:
                same = [0 <= shift + i < len(t) and t[shift + i] == item[i] for i in range(len(item))]
                if sum(same) >= 11 and max(sum(same[i : i + 13]) for i in range(len(item))) >= 11:
                    out.add(doc_id)
                    break
    return out


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    (_, language), (_, near), (_, clean), (_, mixed), (_, sharded) = corpus_pipeline.STAGES

    known = language(spark, docs, SF)
    assert known.columns == docs.columns
    scores = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    stay = {d for d, r in scores.items() if r["lang_pred"] != "und" and r["score"] >= language_id.LEAST_SCORE}
    assert {r["doc_id"] for r in known.collect()} == stay and len(stay) > 0.95 * len(rows)

    single = near(spark, known, SF)
    want = first_of_groups([(d, rows[d]) for d in stay])
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == want and len(want) < len(stay)

    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in table(spark, SF, "benchmark").collect()]
    rest = clean(spark, single, SF)
    bad = leaked([(d, rows[d]) for d in want], items)
    assert rest.columns == docs.columns and {r["doc_id"] for r in rest.collect()} == want - bad and bad

    mixture = mixed(spark, rest, SF)
    taken = Counter(r["doc_id"] for r in mixture.collect())
    planned = {r["_doc"]["doc_id"]: r["copies"] for r in mixing.plan_mixture(rest).collect()}
    assert mixture.columns == docs.columns and dict(taken) == {d: n for d, n in planned.items() if n}

    out = sharded(spark, mixture, SF).collect()
    assert Counter(r["doc_id"] for r in out) == taken
    order = [r["doc_id"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += len(r["text"].encode()) + 1
    longest = max(len(r["text"].encode()) + 1 for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * longest


def test_run_and_edges(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert {"doc_id", "text", "lang", "source", "size", "shard", "slot"} <= set(corpus_pipeline.run(spark, SF).columns)


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_rows(spark, number):
    """Nulls in every column, repeats, an empty table and further columns of clashing names."""
    name, stage = corpus_pipeline.STAGES[number]
    given = table(spark, SF, "documents").limit(30)
    odd = [(None, None, None, None, None), (1, None, "en", "src0", 0), (1, None, "en", "src0", 0), (2, "", "de", None, 0), (None, "the of and in", None, "src1", 9)]
    docs = given.unionByName(spark.createDataFrame(odd, given.schema)).selectExpr("*", "'x' as k1", "1 as copies", "2 as `row`", "3 as score")
    out = stage(spark, docs, SF)
    if name != "sharding":
        assert out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, docs.limit(0), SF).collect() == []
