import random

from leadlake.llm.line_dedup import dedup_lines

DOCS = "doc_id long, text string"


def brute(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        lines, covered = (text or "").split("\n"), set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if window in seen:
                covered |= {i, i + 1, i + 2}
            seen.add(window)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in covered)
        out.append((doc_id, len(lines), len(covered), kept if covered else text))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "a"]) if i % 40 == 0 else "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))) for i in range(300)]
    rows += [(1000 + i, f"x{i}\nhot\nhot passage\nhot\ny{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as at", "'x' as lines", "2 as gaps", "3 as first").repartition(5)
    assert sorted(map(tuple, dedup_lines(docs).collect()), key=repr) == brute(rows)


def test_repeated_rows_and_edges(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc\nd"), (3, "\n" * 5000)]
    got = sorted(map(tuple, dedup_lines(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert [r for r in got if r[0] is None] == [(None, 3, 0, "a\nb\nc")]
    assert [r for r in got if r[0] == 1] == [(1, 3, 3, "")] * 2
    assert [r for r in got if r[0] == 2] == [(2, 4, 3, "d")]
    assert [r[1:3] for r in got if r[0] == 3] == [(5001, 5000)]
    assert dedup_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_short_documents_as_windows(spark):
    rows = [(1, "one line"), (2, "one line"), (3, "a\nb"), (4, "a\nb"), (5, "a"), (6, "a\nb\n"), (7, "x\na\nb\ny"), (8, ""), (9, ""), (10, None), (11, "b"), (12, "\n"), (13, "\n")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in dedup_lines(docs, short=True).collect()}
    assert {k for k, v in got.items() if v[1]} == {2, 4, 13} and got[2] == (1, 1, "") and got[4] == (2, 2, "") and got[13] == (2, 2, "")
    assert all(got[k][2] == text for k, text in rows if k not in (2, 4, 13))
    assert not any(r["n_removed"] for r in dedup_lines(docs).collect())
