"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive tokens: the tokens at its positions are
hashed, those between are ignored. Hashes of the benchmark and of the documents
are joined, and around each hit the aligned tokens are compared one by one: a
document overlaps an item if, of ``WINDOW`` aligned tokens, at least ``EQUAL``
are equal. The two masks together hit every such window: whichever two of 13
positions are substituted, one mask fits between them at some offset. So the
search loses nothing.

Tokens are runs of letters and digits in lower case. Beyond the end of a text
nothing is equal. Items of fewer than ``EQUAL`` tokens must match as a whole;
items shorter than the shortest mask (8 tokens) match nothing, as they can't be
told from ordinary prose, unless ``match_short`` asks for them: then a document
overlaps one if it holds all its tokens in a row.

Defined results: null and empty texts overlap nothing; rows that repeat id and
text share their result; equal items are reported each; empty tables give no
rows. Only id and text are read, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import column, folder, packed, small, stored
from leadlake.llm.minhash import row_key

TOKEN = r"[\p{L}\p{N}]+"
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW, EQUAL = 13, 11
SHORTEST = min(m[-1] for m in MASKS) + 1
#: Tokens before a hit at which a window around it may begin.
FLANK = WINDOW - SHORTEST
#: Seeds of a benchmark, and ids of documents, that are broadcast: up to so many rows.
BROADCAST_SEEDS, BROADCAST_DOCS = 200_000, 300_000


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.xxhash64(t))


def seeded(rows: DataFrame) -> DataFrame:
    """A row (key, at) for each mask at each position of the array ``tokens`` where the mask fits.

    Callers go on with few columns: rows with the whole array each would grow with
    the square of a text.
    """
    begun = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("tokens") - SHORTEST, F.lit(0)))).alias("at"))
    keys = [
        F.when(
            F.col("at") + mask[-1] < F.size("tokens"),
            F.xxhash64(F.lit(number), *[F.get("tokens", F.col("at") + p) for p in mask]),
        )
        for number, mask in enumerate(MASKS)
    ]
    return begun.select("*", F.explode(F.array(*keys)).alias("key")).filter(F.col("key").isNotNull())


def around(at: Column) -> Column:
    """The tokens of all windows around a hit at ``at``; null beyond the ends."""
    return F.array(*[F.get("tokens", at + i) for i in range(-FLANK, WINDOW)])


def most_equal() -> Column:
    """The most equal tokens in one of the windows of ``doc_tokens`` and ``item_tokens`` around a hit."""
    flags = F.zip_with("doc_tokens", "item_tokens", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    return F.array_max(F.transform(
        F.sequence(F.lit(1), F.lit(FLANK + 1)),
        lambda start: F.aggregate(F.slice(flags, start, WINDOW), F.lit(0), lambda total, one: total + one),
    ))


def _short_overlaps(read: DataFrame, items: DataFrame, path: str, broadcast: int) -> DataFrame:
    """Overlaps with items shorter than the shortest mask, by the runs of their lengths."""
    short = items.filter(F.size("tokens").between(1, SHORTEST - 1)).select("item_id", F.col("tokens").alias("run"))
    short = stored(short, f"{path}/short")
    lengths = sorted(r["n"] for r in short.select(F.size("run").alias("n")).distinct().collect())
    begun = read.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)))).alias("at"))
    runs = [F.when(F.col("at") + n <= F.size("tokens"), F.slice("tokens", F.col("at") + 1, n)) for n in lengths]
    found = begun.select("doc_id", "k1", "k2", F.explode(F.array(*runs) if runs else F.array().cast("array<array<bigint>>")).alias("run"))
    return (
        found.filter(F.col("run").isNotNull()).join(small(short, broadcast), "run")
        .groupBy("doc_id", "k1", "k2", "item_id").agg(F.max(F.size("run")).cast("long").alias("equal_tokens"))
    )


def overlaps(
    docs: DataFrame, benchmark: DataFrame, *, work: str | None = None, broadcast_seeds: int = BROADCAST_SEEDS, match_short: bool = False,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """(doc_id, k1, k2, item_id, equal_tokens) for each document and item that overlap.

    With a benchmark of up to ``broadcast_seeds`` seeds, counted first, documents
    are read once and nothing but verified overlaps is shuffled. Above it, seeds
    are joined by a shuffle of narrow rows, and the documents with hits are read again.
    """
    path = folder(docs.sparkSession, work)
    doc_id, text = column(docs, id_column, "long"), column(docs, text_column, "string")
    read = docs.select(doc_id.alias("doc_id"), *row_key(doc_id, text), tokens(text).alias("tokens"))
    items = benchmark.select(
        column(benchmark, item_column, "long").alias("item_id"), tokens(column(benchmark, item_text_column, "string")).alias("tokens"),
    )
    seeds = stored(
        seeded(items).select(
            "key", "item_id", around(F.col("at")).alias("item_tokens"), F.least(F.size("tokens"), F.lit(EQUAL)).alias("needed"),
        ),
        f"{path}/seeds",
    )
    known = small(seeds, broadcast_seeds)
    if known is seeds:
        hits = seeded(read).select("k1", "k2", "at", "key").join(seeds, "key")
        hits = read.dropDuplicates(["k1", "k2"]).join(hits, ["k1", "k2"])
    else:
        hits = seeded(read).join(known, "key")
    found = (
        # The explode keeps Spark from moving the cut behind the join's output, where each hit would hold all tokens.
        hits.select("doc_id", "k1", "k2", "item_id", "needed", "item_tokens", F.explode(F.array(around(F.col("at")))).alias("doc_tokens"))
        .select("doc_id", "k1", "k2", "item_id", "needed", most_equal().alias("equal_tokens"))
        .groupBy("doc_id", "k1", "k2", "item_id", "needed").agg(F.max("equal_tokens").cast("long").alias("equal_tokens"))
        .filter(F.col("equal_tokens") >= F.col("needed")).drop("needed")
    )
    return found.unionByName(_short_overlaps(read, items, path, broadcast_seeds)) if match_short else found


def without_overlaps(
    docs: DataFrame, benchmark: DataFrame, *, work: str | None = None, match_short: bool = False,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """The columns of ``docs``, without the documents that overlap a benchmark item."""
    path = folder(docs.sparkSession, work)
    found = overlaps(docs, benchmark, work=path, match_short=match_short, id_column=id_column, text_column=text_column)
    found = small(stored(found.select("k1", "k2").distinct(), f"{path}/found"), BROADCAST_DOCS)
    keys = row_key(F.col(f"_doc.`{id_column}`").cast("long"), F.col(f"_doc.`{text_column}`").cast("string"))
    return packed(docs).select("_doc", *keys).join(found, ["k1", "k2"], "left_anti").select("_doc.*")
