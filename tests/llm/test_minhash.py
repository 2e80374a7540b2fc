import random
from collections import defaultdict

import numpy as np
import pytest

from leadlake.llm import minhash
from leadlake.llm.graph import components
from leadlake.llm.minhash import band_keys, keep_first, near_groups, sketch
from leadlake.llm.shingles import shingle_set
from leadlake.session import work_dir

DOCS = "doc_id long, text string"


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lower.replace("\t", " ").replace("\n", " ").split(" ") if w]


def brute(rows, percent):
    sets = {}
    for doc_id, text in rows:
        w = words_of(text)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    inverted = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            inverted[x].add(d)
    for d, s in sets.items():
        for other in {o for x in s for o in inverted[x] if o > d}:
            both = len(s & sets[other])
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                a, b = root(d), root(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def corpus(rng):
    """Chains of small edits, copies and documents that share a long passage without being similar."""
    vocabulary, rows = [f"v{i}" for i in range(400)], []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))]
        for _ in range(rng.randrange(1, 12)):
            text = list(text)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    for _ in range(60):
        rows.append((len(rows), " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(2, 40))])))
    rows += [(len(rows) + i, "Same  text\tof six WORDS here") for i in range(30)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A b"), (1005, "a b c"), (1006, "É x"), (1007, "é x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_against_brute_force(spark, percent):
    rows = corpus(random.Random(percent))
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as k1", "1 as class", "2 as stays", "3 as component_id").repartition(5)
    got = {r["doc_id"]: r for r in near_groups(docs, percent=percent).collect()}
    want = brute(rows, percent)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == r["stays"] == (d == r["component_id"]) for d, r in got.items())
    kept = keep_first(docs, percent=percent)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_false_buckets_go_through_rounds_of_pivots(spark):
    """One band of one bin puts nearly everything into few buckets; no link is lost within them."""
    rows = []
    common = [f"c{i}" for i in range(40)]
    for i in range(20):
        text = common + [f"u{i}-{j}" for j in range(8)]
        rows += [(10 * i + j, " ".join(text + (["tail"] if j else []))) for j in range(3)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    wide = {r["doc_id"]: r["component_id"] for r in near_groups(docs, percent=90).collect()}
    narrow = {r["doc_id"]: r["component_id"] for r in near_groups(docs, percent=90, bands=300, rows=1).collect()}
    assert wide == narrow == {d: c for d, (_, c) in brute(rows, 90).items()}


def test_large_group_of_near_copies_is_not_listed_pair_by_pair(spark):
    """Copies with edits of their own: those near the original are linked through it, the others with nothing."""
    rng = random.Random(9)
    base, rows = [f"b{i}" for i in range(150)], []
    for i in range(250):
        text = list(base)
        for _ in range(rng.randrange(9)):
            text[rng.randrange(150)] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(text[rng.randrange(3) :])))
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_groups(docs).collect()}
    assert got == {d: c for d, (_, c) in brute(rows, 85).items()} and 1 < len(set(got.values())) < 200


def test_repeated_rows_and_missing_ids(spark):
    text = "one two three four five six"
    rows = [(3, text), (3, text), (None, text), (None, "alone here"), (None, None), (7, None), (7, None), (9, "x " * 200_000)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "5 as number")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_groups(docs).collect()), key=repr)
    assert got == sorted([
        (3, 3, True), (3, 3, True), (None, 3, False), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (9, 9, True),
    ], key=repr)
    assert sorted(str(r["doc_id"]) for r in keep_first(docs).collect()) == ["3", "7", "9", "None", "None"]
    assert near_groups(docs.limit(0)).collect() == [] and keep_first(docs.limit(0)).collect() == []


def test_sketch_fills_every_bin_and_estimates_similarity():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    for share in (0.5, 0.8, 0.95):
        n = int(len(base) * share)
        other = np.unique(np.concatenate([base[:n], rng.integers(0, 1 << 63, len(base) - n).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        jaccard = both / (len(base) + len(other) - both)
        a, b = sketch([base, other], 2000)
        assert abs((a == b).mean() - jaccard) < 0.05
    tiny = sketch([base[:1], base[:2], base[:1]], 64)
    assert (tiny != minhash._EMPTY).all() and (tiny[0] == tiny[2]).all()
    together, alone = sketch([base, base[:7]], 240), sketch([base[:7]], 240)
    assert (together[1] == alone[0]).all()
    assert (band_keys(together, 40, 6)[1] == band_keys(alone, 40, 6)[0]).all()


def test_shingles_of_short_texts():
    assert len(shingle_set(None)) == len(shingle_set(b" \n\x0b")) == 0
    assert len(shingle_set(b"a b c d")) == len(shingle_set(b"a b c d e")) == 1
    assert shingle_set(b"a b") != shingle_set(b"b a")
    assert (shingle_set(b"A b\tc d E") == shingle_set(b"a b c  d e")).all()


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(5, 5), (149, 300)]
    links += [(500 + rng.randrange(80), 500 + rng.randrange(80)) for _ in range(70)]
    parent = {n: n for l in links for n in l}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long"), work_dir(spark)).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: root(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long"), work_dir(spark)).collect() == []
