"""Near duplicates by fast similarity sketching, banding and exact verification.

Sketch. Coordinates are bins. In each round every shingle is thrown into a hashed
bin with a hashed value; a bin keeps the least (round, value). Rounds go on until
no bin is empty; from round ``t`` on, round t + i throws all shingles into bin i,
so 2t rounds fill every bin. A bin agrees in two sketches with the probability of
the Jaccard similarity, with the concentration of sampling without replacement,
and a text of n words costs about n + t log t throws instead of n t.

Bands. ``ROWS`` bins form a band; documents that agree in a band share a bucket.
With 40 bands of 6 rows a pair of similarity 0.85 shares none with probability
6e-9, of 0.8 with 6e-6.

Links. Documents with equal shingle sets are one class; only classes are compared.
In a bucket all classes are compared with the bucket's pivot on their full sets,
and confirmed links are closed to components. Pairs inside a component need no
test, and pivots leave their bucket.

Buckets that still hold several components go on. The shingles of their classes
are counted. A pair to be linked either has a rare shingle in common, one of at
most ``RARE`` classes, or none. Pairs of the first kind are found by their rarest
shingles: the rarest one in common is among the first n - 0.85n + 1 of either
class in the order of counts, and a rare shingle has few classes. Pairs of the
second kind can only have their frequent shingles in common, min(s, t) of them at
most, which rules most pairs out without a look at them. If both classes of a pair
had too few frequent shingles to be linked with a class of their own size, the
pair itself would be ruled out; so one of them is *central*, and only central
classes become pivots, those with most frequent shingles first, more from round to
round. So every pair that shares a bucket is tested, connected or ruled out by its
bound, without listing all pairs of a group, and nothing is capped.

Defined results: a null or blank text has the empty set and is linked with
nothing; texts of fewer than five words have one shingle, the whole; rows that
repeat id and text are one document; a row without doc_id can join a group, but
the group takes its id from rows that have one; an empty table gives no rows.
Only id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm.common import column, folder, map_arrow, packed, small, stored
from leadlake.llm.graph import components
from leadlake.llm.shingles import mixed, shingle_set

BANDS, ROWS = 40, 6
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Pivots per bucket in the first round over undecided buckets, and the factor from round to round.
FIRST_PIVOTS, MORE_PIVOTS = 8, 64
#: Classes that a rare shingle may have; any number gives the same links.
RARE = 8
#: Key lists of up to so many rows are broadcast.
BROADCAST_KEYS = 300_000
#: Shingles that a task sketches together.
TOGETHER = 1 << 20

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW40 = np.uint64((1 << 40) - 1)


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` coordinates for each non-empty set."""
    out = np.full(len(sets) * bins, _EMPTY, np.uint64)
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for turn in range(2 * bins):
        h = mixed(x ^ mixed(np.full(1, turn + 1, np.uint64)))
        bin_ = ((h >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64) if turn < bins else turn - bins
        np.minimum.at(out, owner * bins + bin_, np.uint64(turn << 40) | (h & _LOW40))
        unfilled = (out.reshape(-1, bins) == _EMPTY).any(axis=1)
        if not unfilled.any():
            break
        stay = unfilled[owner]
        x, owner = x[stay], owner[stay]
    return out.reshape(-1, bins)


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    parts = coordinates.reshape(-1, bands, rows)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for i in range(rows):
        key = mixed(key ^ parts[:, :, i]) + np.uint64(i + 1)
    return key


SKETCHED = "doc_id long, k1 long, k2 long, n_shingles long, class binary, bands array<long>"


def _sketches(bands: int, rows: int):
    """(doc_id, k1, k2, text) to SKETCHED; the bands of a class are given where the task first meets it."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        met = set()
        for batch in batches:
            sizes, classes, keys = [], [], [None] * batch.num_rows
            waiting: list[tuple[int, np.ndarray]] = []

            def flush():
                if waiting:
                    found = band_keys(sketch([s for _, s in waiting], bands * rows), bands, rows).view(np.int64)
                    for (at, _), key in zip(waiting, found, strict=True):
                        keys[at] = key
                    waiting.clear()

            held = 0
            for at, text in enumerate(batch.column(3)):
                own = shingle_set(text.as_py())
                sizes.append(len(own))
                classes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                if len(own) and classes[-1] not in met:
                    if len(met) >= 1_000_000:
                        met.clear()
                    met.add(classes[-1])
                    waiting.append((at, own))
                    held += len(own)
                    if held > TOGETHER:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()),
                 pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "n_shingles", "class", "bands"],
            )

    return run


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that stand for the id and the text of a row."""
    return F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit("row"), doc_id).alias("k2")


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    doc_id, text = column(docs, id_column, "long"), column(docs, text_column, "string")
    return docs.select(doc_id.alias("doc_id"), *row_key(doc_id, text), text.cast("binary").alias("text"))


def _full_sets(batches):
    """(cid, text) to (cid, shingles)."""
    import pyarrow as pa

    def batch_of(cids, sets):
        return pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cid", "shingles"])

    for batch in batches:
        cids, sets, held = [], [], 0
        for cid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            cids.append(cid)
            sets.append(shingle_set(text.as_py()).view(np.int64))
            held += len(sets[-1])
            if held > TOGETHER:
                yield batch_of(cids, sets)
                cids, sets, held = [], [], 0
        if cids:
            yield batch_of(cids, sets)


def _admissible(percent: int) -> Column:
    """Whether a and b, of n shingles each and with at most s in common with others, can be linked."""
    common = F.least("s_a", "s_b")
    return 100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)


class _Search:
    """The rounds of pivots over the classes of one table."""

    def __init__(self, docs: DataFrame, classes: DataFrame, path: str, percent: int):
        self.docs, self.classes, self.path, self.percent = docs, classes, path, percent

    def full_sets(self, cids: DataFrame) -> DataFrame:
        """(cid, shingles) of classes, from the texts of their first rows."""
        needed = stored(cids.join(self.classes.select("cid", "first.k1", "first.k2"), "cid"), f"{self.path}/needed")
        texts = self.docs.join(small(needed, BROADCAST_KEYS), ["k1", "k2"]).select("cid", "text")
        return stored(map_arrow(texts, _full_sets, "cid long, shingles array<long>").dropDuplicates(["cid"]), f"{self.path}/sets")

    def confirmed(self, pairs: DataFrame, sets: DataFrame, turn) -> DataFrame:
        """Links among stored pairs (a, b) of class ids, by their full sets."""
        left, right = (sets.select(F.col("cid").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
        both = pairs.join(right, "b").join(left, "a")
        # 100 common >= percent union, with union = sizes - common. Compared one by one, however long the texts.
        common = F.size(F.array_intersect("s_a", "s_b"))
        alike = (100 + self.percent) * common >= self.percent * (F.size("s_a") + F.size("s_b"))
        return stored(both.filter(alike).select("a", "b"), f"{self.path}/links-{turn}")

    def common_shingles(self, contested: DataFrame, sets: DataFrame) -> DataFrame:
        """(cid, shingle, classes) of the shingles that several of the contested classes have."""
        own = sets.join(contested.select("cid"), "cid").select("cid", F.explode("shingles").alias("shingle"))
        counts = own.groupBy("shingle").agg(F.count("*").alias("classes")).filter("classes > 1")
        return stored(own.join(counts, "shingle").select("cid", "shingle", "classes"), f"{self.path}/common")

    def rare_pairs(self, common: DataFrame, info: DataFrame) -> DataFrame:
        """Pairs (a, b) of different labels with a rare shingle in common, by the rarest of either class."""
        rank = F.row_number().over(Window.partitionBy("cid").orderBy("classes", "shingle"))
        place = F.col("n") - F.col("shared") + rank
        first = common.filter(F.col("classes") <= RARE).join(info, "cid").withColumn("place", place)
        first = first.filter(100 * (F.col("n") + 1 - F.col("place")) >= self.percent * F.col("n"))
        a, b = (first.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("cid", "n", "label")]) for x in "ab")
        alike = 100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")
        pairs = a.join(b, "shingle").filter((F.col("cid_a") < F.col("cid_b")) & (F.col("label_a") != F.col("label_b")) & alike)
        return pairs.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).distinct()

    def labels(self) -> DataFrame:
        """(node, label) of all classes that are linked."""
        percent = self.percent
        members = self.classes.select("cid", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
        several = members.groupBy("bucket").agg(F.min("cid").alias("pivot"), F.max("cid").alias("last")).filter("pivot < last")
        live = stored(members.join(several.select("bucket", "pivot"), "bucket"), f"{self.path}/live-0")
        sets = self.full_sets(live.select("cid").distinct())

        sizes = self.classes.select(F.col("cid").alias("a"), F.col("n_shingles").alias("n_a"))
        pairs = live.filter("cid > pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b"), "n").distinct()
        alike = 100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")
        tested = stored(pairs.join(sizes, "a").filter(alike).select("a", "b"), f"{self.path}/pairs-0")
        links = self.confirmed(tested, sets, 0)
        found = stored(components(links, f"{self.path}/components-0"), f"{self.path}/labels-0")

        live = self._labelled(live.filter("cid > pivot").select("bucket", "cid", "n"), found)
        undecided = live.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        live = stored(live.join(undecided.select("bucket"), "bucket", "left_semi"), f"{self.path}/undecided")
        contested = stored(live.select("cid", "n", "label").distinct(), f"{self.path}/contested")
        common = self.common_shingles(contested, sets)
        frequent = F.count(F.when(F.col("classes") > RARE, True))
        counted = common.groupBy("cid").agg(F.count("*").alias("shared"), frequent.alias("s"))
        info = stored(contested.join(counted, "cid", "left").fillna(0, ["shared", "s"]), f"{self.path}/info")
        pairs = stored(self.rare_pairs(common, info).join(tested, ["a", "b"], "left_anti"), f"{self.path}/pairs-rare")
        if not pairs.isEmpty():
            tested = tested.unionByName(pairs)
            found = self._joined(found, self.confirmed(pairs, sets, "rare"), "rare")
        live = self._labelled(live.drop("label"), found).join(info.select("cid", "s"), "cid")
        # ``percent`` times the most shingles that a partner can have.
        reach = (100 + percent) * F.col("s") - percent * F.col("n")
        live = live.filter(100 * F.col("s") >= percent * F.col("n")).withColumn("reach", reach)
        live = live.withColumn("central", F.col("reach") >= percent * F.col("n"))

        turn, pivots = 1, FIRST_PIVOTS
        while True:
            central = F.col("central")
            open_ = live.groupBy("bucket").agg(
                F.min("label").alias("low"), F.max("label").alias("high"),
                F.min(F.when(central, F.col("n"))).alias("least"), F.max(F.when(central, F.col("reach"))).alias("most"),
            ).filter("low < high and least is not null")
            # A class that isn't central needs a central one which its sizes allow.
            live = live.join(open_.select("bucket", "least", "most"), "bucket").filter(f"central or ({percent} * n <= most and {percent} * least <= reach)")
            live = stored(live.select("bucket", "cid", "n", "s", "reach", "central", "label"), f"{self.path}/live-{turn}")
            if live.isEmpty():
                return found
            rank = F.row_number().over(Window.partitionBy("bucket").orderBy((F.col("n") - F.col("s")) / F.col("n"), "cid"))
            chosen = live.filter("central").withColumn("rank", rank).filter(F.col("rank") <= pivots)
            chosen = stored(chosen.select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("cid", "n", "s", "label")]), f"{self.path}/pivots-{turn}")
            against = live.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("cid", "n", "s", "label")])
            pairs = chosen.join(against, "bucket").filter((F.col("label_a") != F.col("label_b")) & _admissible(percent))
            pairs = pairs.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()
            pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), f"{self.path}/pairs-{turn}")
            live = live.join(chosen.select("bucket", F.col("cid_a").alias("cid")), ["bucket", "cid"], "left_anti")
            if not pairs.isEmpty():
                tested = tested.unionByName(pairs)
                found = self._joined(found, self.confirmed(pairs, sets, turn), turn)
                live = self._labelled(live.drop("label"), found)
            turn, pivots = turn + 1, pivots * MORE_PIVOTS

    def _joined(self, found: DataFrame, links: DataFrame, turn) -> DataFrame:
        """The labels with further links."""
        if links.isEmpty():
            return found
        stars = found.filter("node > label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        return stored(components(stars.unionByName(links), f"{self.path}/components-{turn}"), f"{self.path}/labels-{turn}")

    @staticmethod
    def _labelled(live: DataFrame, found: DataFrame) -> DataFrame:
        return live.join(found, live["cid"] == found["node"], "left").withColumn("label", F.coalesce("label", "cid")).drop("node")


def near_groups(
    docs: DataFrame, *, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, work: str | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, k1, k2, n_shingles, component_id, kept, stays.

    ``kept``: the id is that of its component. ``stays``: the row is the first of
    its component, by id, rows without id last; rows without words all stay.
    """
    path = folder(docs.sparkSession, work)
    keyed = _keyed(docs, id_column, text_column)
    sketched = stored(map_arrow(keyed, _sketches(bands, rows), SKETCHED), f"{path}/sketches")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    classes = stored(
        sketched.filter(F.col("class").isNotNull()).groupBy("class")
        .agg(F.min(order).alias("first"), F.first("bands", ignorenulls=True).alias("bands"), F.first("n_shingles").alias("n_shingles"))
        .withColumn("cid", F.monotonically_increasing_id()),
        f"{path}/classes",
    )
    labels = _Search(keyed, classes, path, percent).labels()
    narrow = classes.select("class", "cid", "first")
    labelled = narrow.join(labels, narrow["cid"] == labels["node"], "left").withColumn("label", F.coalesce("label", "cid"))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("stay"))
    result = labelled.join(firsts, "label").select("class", "stay")
    joined = sketched.drop("bands").join(result, "class", "left")
    is_first = F.col("stay").isNull() | ((F.col("k1") == F.col("stay.k1")) & (F.col("k2") == F.col("stay.k2")))
    component = F.when(F.col("stay").isNull(), F.col("doc_id")).otherwise(F.col("stay.doc_id"))
    return joined.select(
        "doc_id", "k1", "k2", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), is_first.alias("stays"),
    )


def keep_first(docs: DataFrame, *, percent: int = PERCENT, work: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The columns of ``docs``, one row of each group of near duplicates."""
    path = folder(docs.sparkSession, work)
    groups = near_groups(docs, percent=percent, work=path, id_column=id_column, text_column=text_column)
    stay = groups.filter("stays").select("k1", "k2").distinct()
    whole = packed(docs)
    keys = row_key(F.col(f"_doc.`{id_column}`").cast("long"), F.col(f"_doc.`{text_column}`").cast("string"))
    number = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))
    return whole.select("_doc", *keys).join(stay, ["k1", "k2"]).withColumn("number", number).filter("number = 1").select("_doc.*")
