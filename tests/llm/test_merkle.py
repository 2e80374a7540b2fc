import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from leadlake.llm.merkle import climb, fold, height, missing_coordinates, parents, prove_documents, siblings, width

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(*values):
    texts = [None if v is None else str(v) for v in values]
    return H(*["-" if t is None else f"{len(t.encode())}:{t}" for t in texts])


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i & 1))
        i >>= 1
    return out


def folded(node, path):
    for other, left in path:
        node = H(node) if other is None else H(other, node) if left else H(node, other)
    return node


def brute(rows):
    """rows: doc_id, text, lang, source, n_chars; tampered where 7 divides the checksum of the id."""
    def leaf(r, more=0):
        return coded(r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs]
    trees = [levels_of([leaf(r) for r in group]) for group in groups]
    top = levels_of([t[-1][0] for t in trees]) if trees else []
    out = []
    for rank, (group, tree) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(group):
            path = path_of(tree, i) + path_of(top, rank)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            end = folded(leaf(r, 1) if bad else leaf(r), path)
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], H(*[s for s, _ in path if s]), end, end == top[-1][0]))
    return sorted(out, key=repr)


def proofs(docs, **options):
    docs = docs.selectExpr("*", "1 as tree", "'x' as hash", "2 as other", "3 as index", "4 as n", "5 as block")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = prove_documents(docs, tampered=tampered, changed={"n_chars": F.col("n_chars") + 1}, **options)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("bits", [1, 2, 3, 10])
def test_against_brute_force(spark, bits):
    rng = random.Random(bits)
    rows = [(i, rng.choice(["", None, f"text {i}", "ß\n" * i]), rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s", None]), rng.choice([i, None])) for i in range(150)]
    rows += [(-5, "one", "alone", "s", 3), (None, "a", "en", "s", 1), (None, "a", "en", "s", 1), (4, rows[4][1], *rows[4][2:]), (4, "other", rows[4][2], "s", 1)]
    rows += [(1000 + i, "é", f"lang{i}", "s", 1) for i in range(9)]
    assert proofs(spark.createDataFrame(rows, DOCS).repartition(5), bits=bits) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17])
def test_one_group_of_any_size(spark, n):
    rows = [(i, "t", None, None, i) for i in range(n)]
    assert proofs(spark.createDataFrame(rows, DOCS), bits=2) == brute(rows)


def test_long_text_and_empty_table(spark):
    rows = [(1, "long " * 400_000, "en", "s", 2_000_000), (2, "", "en", "s", 0)]
    assert proofs(spark.createDataFrame(rows, DOCS)) == brute(rows)
    assert proofs(spark.createDataFrame([], DOCS)) == []


def test_missing_coordinates_are_the_fewest_that_give_the_root():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 40)
        known = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        have, missing = {(0, i) for i in known}, missing_coordinates(known, n)
        assert missing == sorted(missing) and not have & set(missing)

        def derive(have):
            have = set(have)
            for level in range(height(n)):
                for i in range(width(n, level + 1)):
                    if {(level, c) for c in (2 * i, 2 * i + 1) if c < width(n, level)} <= have:
                        have.add((level + 1, i))
            return have

        root = (height(n), 0)
        assert root in derive(have | set(missing))
        assert all(root not in derive(have | set(missing) - {m}) for m in missing)


def test_a_run_of_leaves_expands_to_the_proofs_of_the_whole_tree():
    for n in (1, 2, 5, 12, 13):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        whole = [leaves]
        while len(whole[-1]) > 1:
            whole.append(parents(whole[-1]))
        for first in range(n):
            for last in range(first + 1, n + 1):
                fetched = [whole[level][i] for level, i in missing_coordinates(range(first, last), n)]
                levels, begins = climb(first, leaves[first:last], n, fetched)
                assert not fetched and levels[-1] == whole[-1]
                for i in range(first, last):
                    assert fold(leaves[i], siblings(i, levels, begins)) == whole[-1][0]
