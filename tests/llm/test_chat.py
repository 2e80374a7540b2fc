import random

from leadlake.llm import chat
from pyspark.sql import functions as F

TURNS = "conv_id long, turn long, role string, text string"


def formatted(spark, rows):
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as turns", "1 as segments", "2 as state"))
    return {
        r["conv_id"]: r for r in out.select(
            "*", chat.read_turns(F.col("formatted")).alias("read"), chat.trained_text(F.col("segments")).alias("loss"),
        ).collect()
    }


def test_round_trip_of_control_strings(spark):
    rng = random.Random(3)
    parts = ["\\", "</turn>", "### ", "\n", "#", "<", "/turn>", "\\s", "\\l", "\\h", "\\n", "user", " ", "é", "\U0001f600", ":"]
    rows = []
    for conv in range(300):
        for turn in range(rng.randrange(1, 5)):
            role = rng.choice(["user", "assistant", "system", "".join(rng.choice(parts) for _ in range(3))])
            rows.append((conv, turn, role, "".join(rng.choice(parts) for _ in range(rng.randrange(10)))))
    got = formatted(spark, rows)
    for conv in range(300):
        turns = [(r, t) for c, _, r, t in rows if c == conv]
        assert [tuple(t) for t in got[conv]["read"]] == turns
        assert got[conv]["loss"] == "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["formatted"] == "".join(s["text"] for s in got[conv]["segments"])
        assert got[conv]["formatted"].count("</turn>") == len(turns)


def test_machine_and_edges(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", ""),
        (3, 0, "user", "a"), (4, 0, "assistant", "x"), (5, 0, None, None), (None, None, "user", "q"), (None, 1, "assistant", "r"),
        (6, 0, "user", "u"), (6, 0, "user", "u"), (7, 0, "user", "z" * 200_000), (7, 1, "assistant", "y"),
    ]
    got = formatted(spark, rows)
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, None: True, 6: False, 7: True}
    assert got[1]["formatted"] == "### user\na</turn>\n### assistant\nb</turn>\n"
    assert [tuple(t) for t in got[5]["read"]] == [("", "")]
    assert len(got[6]["read"]) == 2 and len(got[7]["read"][0]["text"]) == 200_000
    assert formatted(spark, [(1, 0, "user", "a")]) and chat.format_conversations(spark.createDataFrame([], TURNS)).collect() == []


def test_other_template(spark):
    template = chat.Template(
        head="[", head_end="]", tail="[end]", escapes=(("~", "~t"), ("[", "~b"), ("]", "~c")), role_escapes=(),
        moves={("start", "q"): "q", ("q", "a"): "a"}, final=("a",), trained=("a", "q"),
    )
    rows = [(1, 0, "q", "x[end]~b"), (1, 1, "a", "]~[")]
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS), template).select(
        "valid", chat.read_turns(F.col("formatted"), template).alias("t"), chat.trained_text(F.col("segments"), template).alias("l"),
    ).first()
    assert out["valid"] and [tuple(t) for t in out["t"]] == [("q", "x[end]~b"), ("a", "]~[")] and out["l"] == "x[end]~b]~["


def test_rows_without_id_can_stand_alone(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (None, 1, "assistant", "r")]
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS).repartition(3), split_unnamed=True).collect()
    assert sorted((str(r["conv_id"]), r["formatted"], r["valid"]) for r in out) == [
        ("1", "### user\na</turn>\n### assistant\nb</turn>\n", True), ("None", "### assistant\nr</turn>\n", False),
        ("None", "### assistant\nr</turn>\n", False), ("None", "### user\nq</turn>\n", False),
    ]
