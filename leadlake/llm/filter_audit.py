"""How document filters interact: an audit of every order in which they can run.

A document is reduced to the set of filters that it fails, so a part (a source)
becomes at most 2^f counts. They define three games on coalitions of filters: the
documents, the good ones and the toxic ones that a coalition removes. The potential
of Hart and Mas-Colell is computed over the coalitions from the empty one upwards,

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,

and the Shapley value of a filter is P(all) - P(all without it). What a filter does
at a step of an order is the difference of two coalitions.

|S|! P(S) is an integer; it is what is computed here, so nothing is rounded.

Defined results: a null text counts as empty; a null part is the part ''; a document
repeats if a smaller id has the identical text, so rows that share an id and a text
don't repeat each other, and rows without id neither repeat nor are repeated; a label
row without id belongs to nothing; of several label rows of an id one is enough; rows
that repeat count each; an empty table gives no rows. Only id, part, text and labels
are read, in whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import WORD, column, folder, stored

#: Letter of the filter that looks at the whole table; the others look at one text.
REPEATED = "E"
COUNTS = ("rows", "good", "toxic")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the filters."""

    least_words: int = 200
    least_distinct_percent: int = 50
    most_capital_percent: int = 2
    signs: str = "[#$%&*|]"


def text_filters(text: Column, words: Column, limits: Limits = Limits()) -> dict[str, Column]:
    """Whether a text fails each of the filters A to D; ``words`` are its words."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < limits.least_words,
        "B": 100 * F.size(F.array_distinct(words)) < limits.least_distinct_percent * F.size(words),
        "C": 100 * capitals > limits.most_capital_percent * F.length(text),
        "D": text.rlike(limits.signs),
    }


def marked(
    docs: DataFrame, labels: DataFrame, *, limits: Limits = Limits(), work: str | None = None,
    id_column: str = "doc_id", text_column: str = "text", part_column: str = "source",
) -> DataFrame:
    """One narrow row per row of ``docs``: doc_id, part, failed (bits of the filters A to E), good, toxic.

    Each text is read once. Texts are compared by their SHA-256. Only digests that
    occur under several ids are joined back: one row each, however many copies a text has.
    """
    path = folder(docs.sparkSession, work)
    text = F.coalesce(column(docs, text_column, "string"), F.lit(""))
    read = docs.select(
        column(docs, id_column, "long").alias("doc_id"), F.coalesce(column(docs, part_column, "string"), F.lit("")).alias("part"),
        text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
    )
    fails = text_filters(F.col("text"), F.col("words"), limits)
    bits = sum((F.when(fails[name], 1 << at).otherwise(0) for at, name in enumerate(fails)), F.lit(0))
    narrow = stored(read.select("doc_id", "part", bits.alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest")), f"{path}/read")
    firsts = stored(
        narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first"),
        f"{path}/firsts",
    )
    label_id = column(labels, "doc_id", "long").alias("doc_id")
    told = labels.select(label_id, column(labels, "quality", "long").alias("quality"), column(labels, "toxic", "long").alias("toxic"))
    told = told.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    again = F.when(F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)), 1 << len(fails)).otherwise(0)
    return (
        narrow.join(firsts, "digest", "left").withColumn("failed", F.col("failed") + again)
        .join(told, "doc_id", "left")
        .select("doc_id", "part", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    )


def games(marks: DataFrame, filters: str) -> DataFrame:
    """One row per part: its totals, and the value of every coalition (by its bits) in the three games."""
    counts = marks.groupBy("part", "failed").agg(
        F.count("*").alias("rows"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"),
    )
    # At most one cell per set of failed filters.
    cells = counts.groupBy("part").agg(F.sum("rows").alias("total"), F.collect_list(F.struct("failed", *COUNTS)).alias("cells"))

    def value(name: str) -> Column:
        def of(coalition: Column) -> Column:
            hit = lambda total, cell: total + F.when(cell["failed"].bitwiseAND(coalition) != 0, cell[name]).otherwise(F.lit(0))
            return F.aggregate("cells", F.lit(0).cast("long"), hit)

        return F.transform(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1)), of).alias(name)

    return cells.select("part", "total", *[value(name) for name in COUNTS])


def scaled_potential(values: Column, players: int) -> Column:
    """|S|! P(S) of every coalition S, by the bits of S, from the values of the coalitions."""
    earlier = F.array(*[F.lit(factorial(size)).cast("long") for size in range(players)])

    def extend(known: Column, coalition: Column) -> Column:
        own = F.get(earlier, F.bit_count(coalition) - 1) * F.get(values, coalition)
        without = [
            F.when(coalition.bitwiseAND(1 << i) != 0, F.get(known, coalition.bitwiseXOR(1 << i))).otherwise(F.lit(0)) for i in range(players)
        ]
        return F.concat(known, F.array(sum(without, own)))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << players) - 1)), F.array(F.lit(0).cast("long")), extend)


def audit(marks: DataFrame, filters: str) -> DataFrame:
    """One row per part, order of the filters and step.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, and shapley: the Shapley value of the step's filter times the number
    of orders. ``filters`` names the bits of ``failed`` from the lowest on.
    """
    players, every = len(filters), (1 << len(filters)) - 1
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    bit_of = lambda name: F.get(F.array(*[F.lit(1 << i) for i in range(players)]), F.instr(F.lit(filters), name) - 1)
    order, step = F.col("filter_order"), F.col("step")
    before = F.aggregate(F.slice(F.split(order, ""), 1, step - 1), F.lit(0), lambda bits, name: bits.bitwiseOR(bit_of(name)))
    steps = (
        games(marks, filters).withColumn("potential", scaled_potential(F.col("rows"), players))
        .select("*", F.explode(orders).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(players))).alias("step"))
        .withColumn("bit", bit_of(F.substring(order, step, F.lit(1)))).withColumn("before", before)
        .withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    )
    gain = lambda name: F.get(name, F.col("after")) - F.get(name, F.col("before"))
    rest = F.lit(every).bitwiseXOR(F.col("bit"))
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("rows", F.col("after"))).alias("kept"), gain("rows").alias("removed"),
        (F.get("rows", F.col("bit")) - gain("rows")).alias("redundant"),
        (F.get("rows", F.lit(every)) - F.get("rows", rest)).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(every)) - players * F.get("potential", rest)).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The audit of the filters A to D of ``text_filters`` and of E, repeated texts."""
    return audit(marked(docs, labels, **options), f"ABCD{REPEATED}")
