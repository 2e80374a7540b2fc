import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from leadlake.llm.filter_audit import audit, audit_documents, games, marked, scaled_potential

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def failed(rows):
    """Sets of failed filters, by row."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words, fails = WORDS.findall(text), ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * any(doc_id is not None and i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        out.append(set(fails))
    return out


def brute(rows, labels, filters="ABCDE"):
    """Every order applied to every document, filter by filter."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    parts, out, fails = sorted({r[2] or "" for r in rows}), {}, failed(rows)
    for part in parts:
        docs = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        total = Counter()
        for order in map("".join, permutations(filters)):
            left = list(docs)
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                total[name] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(name in f for _, f in docs) - len(gone), sum(f == {name} for _, f in docs),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def sample():
    rng = random.Random(3)

    def text():
        words = [rng.choice(["alpha", "beta", "gamma"]) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 3, 150, 199, 200, 260, 600]))]
        text = rng.choice([" ", "\t", "\n ", "\x0b"]).join(words)
        return text + rng.choice(["", "", " $", " ÀÉ", " ABCDEFGHIJKLMNOPQRSTUVWXYZ ABCDEFGH", "|"])

    texts = [text() for _ in range(40)] + [None, "", "　"]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", "ä", "", None])) for i in range(250)]
    rows += [(None, texts[0], "a"), (None, texts[0], "a"), (7, rows[7][1], "a"), (300, "x " * 40_000, "long"), (300, "x " * 40_000, "long")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 250, 2)] + [(8, 1, 1), (8, None, None), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_against_every_order_applied(spark):
    rows, labels = sample()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as part", "2 as failed", "'x' as words", "3 as good", "4 as digest", "5 as first").repartition(4)
    told = spark.createDataFrame(labels, LABELS).selectExpr("*", "'z' as text", "'q' as part")
    got = result(audit_documents(docs, told))
    assert got == brute(rows, labels) and len(got) == 600 * 5


def test_shapley_values_share_out_all_removed(spark):
    rows, labels = sample()
    marks = marked(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    total = {r["part"]: r["rows"][31] for r in games(marks, "ABCDE").collect()}
    shares = audit(marks, "ABCDE").filter("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("s")).collect()
    assert {r["part"]: r["s"] for r in shares} == {part: 120 * n for part, n in total.items()}


def test_potential_of_a_game_with_known_values(spark):
    # Two players; v = 0, 4, 2, 10: P(1) = 4, P(2) = 2, P(12) = (10 + 4 + 2) / 2 = 8, scaled by 2! = 16.
    frame = spark.createDataFrame([([0, 4, 2, 10],)], "v array<long>")
    assert frame.select(scaled_potential(F.col("v"), 2).alias("p")).first()["p"] == [0, 4, 2, 16]


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit_documents(none, labels).collect() == []
    got = result(audit_documents(spark.createDataFrame([(1, None, None)], DOCS), labels))
    assert got == brute([(1, None, None)], [])
