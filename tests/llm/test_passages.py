import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from leadlake.llm import passages
from leadlake.llm.passages import find_passages, passage_digests, remove_passages, word_hashes

DOCS = "doc_id long, text string"


def brute(rows, window):
    texts, seen = [(i, (t or "").encode().split()) for i, t in rows], {}
    for _, words in texts:
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for doc_id, words in texts:
        gone = {p + i for p in range(len(words) - window + 1) if seen[tuple(words[p : p + window])] > 1 for i in range(window)}
        out.append((doc_id, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=repr)


def removed(docs, window=35, **options):
    """Results of texts and of digests, which must agree."""
    docs = docs.selectExpr("*", "1 as k1", "'x' as anchors", "2 as begin", "3 as live", "4 as prefix", "5 as no", "6 as spans")
    texts = sorted((tuple(r) for r in remove_passages(docs, window=window, **options).collect()), key=repr)
    digests = [tuple(r) for r in passage_digests(find_passages(docs, window=window, **options)).collect()]
    out = sorted(((i, len(re.findall(r"[^\x20\x09-\x0D]+", k or "")) + n, n, " ".join(re.findall(r"[^\x20\x09-\x0D]+", k or ""))) for i, n, k in texts), key=repr)
    assert sorted(((i, w, n, hashlib.sha256(k.encode()).hexdigest()) for i, w, n, k in out), key=repr) == sorted(digests, key=repr)
    return out


@pytest.mark.parametrize(("window", "prefix", "limit", "lead_docs"), [(4, 2, 1 << 18, 2048), (5, 1, 16, 3), (6, 5, 1, 1), (35, 16, 64, 20)])
def test_against_brute_force(spark, window, prefix, limit, lead_docs):
    rng = random.Random(window)
    rows = []
    for i in range(250):
        words = [rng.choice("abcde") if rng.random() < 0.3 else f"w{rng.randrange(60 * window)}" for _ in range(rng.randrange(0, 6 * window))]
        rows.append((i, rng.choice([" ", "\t", "\n ", "\x0b", "\x0c\r"]).join(words)))
    passage = [f"p{i}" for i in range(3 * window)]
    for i in range(80):
        at = rng.randrange(2 * window)
        own = [f"o{i}_{k}" for k in range(rng.randrange(window))]
        rows.append((1000 + i, " ".join(own + passage[at : at + rng.randrange(1, 2 * window)] + own[::-1])))
    rows += [(2000, None), (2001, ""), (2002, " \n "), (None, rows[0][1]), (5, rows[5][1]), (3000, "same " * (3 * window)), (3001, "　".join("ab" * window))]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    assert removed(docs, window=window, prefix=prefix, limit=limit, lead_docs=lead_docs) == brute(rows, window)


def test_a_passage_that_most_documents_share(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(400)] + [(i, f"c{i} d{i}") for i in range(400, 450)]
    got = removed(spark.createDataFrame(rows, DOCS).repartition(7), limit=8, lead_docs=50)
    assert got == brute(rows, 35) and sum(r[2] for r in got) == 400 * 60


def test_exact_windows_at_the_border(spark):
    words = [f"w{i}" for i in range(35)]
    near = [*words[:20], "x", *words[21:]]
    rows = [(1, " ".join(words)), (2, "y " + " ".join(words)), (3, " ".join(near)), (4, " ".join(words[:34])), (5, " ".join(words[1:]) + " z")]
    assert [(r[0], r[2]) for r in removed(spark.createDataFrame(rows, DOCS))] == [(1, 35), (2, 35), (3, 0), (4, 0), (5, 0)]


def test_empty_table_and_repeated_rows(spark):
    assert removed(spark.createDataFrame([], DOCS)) == []
    text = " ".join(f"w{i}" for i in range(40))
    assert removed(spark.createDataFrame([(1, text), (1, text), (2, "short")], DOCS)) == [(1, 40, 40, ""), (1, 40, 40, ""), (2, 1, 0, "short")]


def test_texts_above_a_piece_and_a_chunk(spark, monkeypatch):
    rng = random.Random(9)
    texts = [rng.choice([" ", "  "]).join(rng.choice(["a", "bb", "c" * 400, f"w{i}"]) for i in range(rng.randrange(200))) for _ in range(60)]
    texts += ["x" * 1000, " " * 1000, "", None, "y" * 700 + " z", " " + "v" * 300]
    plain = word_hashes(pa.array([t and t.encode() for t in texts], pa.binary()))
    monkeypatch.setattr(passages, "PIECE_BYTES", 128)
    pieces = word_hashes(pa.array([t and t.encode() for t in texts], pa.binary()))
    assert all(np.array_equal(a, b) for a, b in zip(plain, pieces, strict=True))
    assert plain[1].tolist() == [len((t or "").split()) for t in texts]
    counts = np.array([3, 0, 50, 7, 120, 1])
    monkeypatch.setattr(passages, "CHUNK_WORDS", 40)
    begun = {(row, at + i) for row, n, at, size in passages._slices(counts, 5) if n == 1 for i in range(size - 4)}
    assert {(2, i) for i in range(46)} | {(4, i) for i in range(116)} <= begun


def test_a_very_long_text(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(1 << 30)}" for _ in range(1_300_000)]
    again = long[1_048_560:1_048_660]
    rows = [(1, " ".join(long)), (2, "u " + " ".join(again) + " v"), (3, "k" * 5_000_000)]
    got = removed(spark.createDataFrame(rows, DOCS))
    assert [r[:3] for r in got] == [(1, 1_300_000, 100), (2, 102, 100), (3, 1, 0)]
    assert got[1][3] == "u v" and got[0][3] == " ".join(long[:1_048_560] + long[1_048_660:])
