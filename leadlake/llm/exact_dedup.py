"""Grace hash deduplication by complete content.

1. Every input partition folds its own copies: an open-addressing table, emptied
   whenever it is full, compares complete contents. Only the first row of each
   content carries the content on; so a content that a third of all rows share
   leaves a partition a few times only.
2. The carried contents, stored in spill files, are partitioned by hash. Buckets
   above the limit are partitioned again by further digits of the hash, level by
   level, until every bucket fits or holds one hash value.
3. Each bucket is read into an open-addressing table that compares complete
   contents. One hash value more often than the limit allows does no harm: copies
   stream through the table and add nothing to it.

Defined results: a null text counts as empty, and empty texts equal each other;
of equal texts the longest original stays, then the smallest doc_id, with null
ids last, then the first row read; rows that repeat id and text are one group of
which one row stays; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import column, folder, map_arrow, small, stored

#: Bytes of distinct contents that one table may hold, and the partitions of one level.
TABLE_BYTES, FAN_OUT = 32 << 20, 64
#: Lists of up to so many overfull buckets are broadcast.
BROADCAST_BUCKETS = 100_000
#: Bytes that Python's delete step removes: white space of ASCII.
DELETED = b"\x20\x09\x0a\x0b\x0c\x0d"

SPILL = "doc_id long, points long, text_sha256 string, row_key long, rep_key long, hash long, bytes long, content binary"


class ContentTable:
    """Open addressing with linear probing; equality is that of the complete content."""

    def __init__(self, room: int = TABLE_BYTES):
        self.room = room
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 64
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[int] = []
        self.bytes = 0

    def full(self) -> bool:
        return self.bytes >= self.room

    def _free(self, hash_: int) -> int:
        mask = len(self.slots) - 1
        at = hash_ & mask
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        for entry, hash_ in enumerate(self.hashes):
            self.slots[self._free(hash_)] = entry

    def find_or_add(self, hash_: int, content: bytes, value: int) -> int:
        """The value of an equal content, or else ``value``, which is then kept for it."""
        mask = len(self.slots) - 1
        at = hash_ & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == hash_ and self.contents[entry] == content:
                return self.values[entry]
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(hash_)
        self.contents.append(content)
        self.values.append(value)
        self.bytes += len(content) + 64
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return value


def _fold(room: int):
    """Rows (doc_id, text) of a partition to rows of SPILL; a repeated content stays behind."""

    def fold(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        seen, key = ContentTable(room), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, points, digests, rows, reps, hashes, contents = batch.column(0).to_pylist(), [], [], [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                content = text.encode("utf-8", "surrogatepass").translate(None, DELETED)
                hash_ = xxhash.xxh3_64_intdigest(content)
                rep = seen.find_or_add(hash_, content, key)
                points.append(len(text))
                digests.append(hashlib.sha256(content).hexdigest())
                rows.append(key)
                reps.append(rep)
                hashes.append(hash_ - (1 << 64) if hash_ >> 63 else hash_)
                contents.append(content if rep == key else None)
                key += 1
                if seen.full():
                    seen.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(points, pa.int64()), pa.array(digests, pa.string()), pa.array(rows, pa.int64()),
                 pa.array(reps, pa.int64()), pa.array(hashes, pa.int64()),
                 pa.array([None if c is None else len(c) + 64 for c in contents], pa.int64()), pa.array(contents, pa.binary())],
                names=["doc_id", "points", "text_sha256", "row_key", "rep_key", "hash", "bytes", "content"],
            )

    return fold


def grace_buckets(records: DataFrame, path: str, *, limit: int = TABLE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """Records (hash, bytes, …) with a bucket whose contents fit ``limit`` or share one hash.

    The first level has as many buckets as the total asks for. Buckets that are
    still too large are divided by further digits of the hash, level by level.
    Only hashes and sizes are read here; contents move once, in the end.
    """
    total = records.agg(F.sum("bytes")).first()[0] or 0
    records = records.withColumn("bucket", F.pmod("hash", F.lit(max(fan_out, 2 * total // limit))).cast("string"))
    level = 1
    while True:
        sizes = records.groupBy("bucket").agg(F.sum("bytes").alias("held"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        over = stored(
            sizes.filter((F.col("held") > limit) & (F.col("low") < F.col("high"))).select("bucket", F.lit(True).alias("over")),
            f"{path}/over-{level}",
        )
        if over.isEmpty():
            return records
        digit = F.pmod(F.xxhash64(F.col("hash"), F.lit(level)), F.lit(fan_out)).cast("string")
        records = (
            records.join(small(over, BROADCAST_BUCKETS), "bucket", "left")
            .withColumn("bucket", F.when(F.col("over"), F.concat_ws(".", "bucket", digit)).otherwise(F.col("bucket")))
            .drop("over")
        )
        level += 1


def _match(room: int):
    """Rows (bucket, rep_key, hash, content), sorted by bucket, to (rep_key, group_key)."""

    def match(batches):
        import pyarrow as pa

        seen, current = ContentTable(room), None
        for batch in batches:
            buckets, reps = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hashes, groups = batch.column(2).to_pylist(), []
            for at, content in enumerate(batch.column(3)):
                if buckets[at] != current:
                    seen.clear()
                    current = buckets[at]
                groups.append(seen.find_or_add(hashes[at] & ((1 << 64) - 1), content.as_py(), reps[at]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(groups, pa.int64())], names=["rep_key", "group_key"])

    return match


def exact_groups(
    docs: DataFrame, *, work: str | None = None, limit: int = TABLE_BYTES, fan_out: int = FAN_OUT,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    path = folder(docs.sparkSession, work)
    narrow = docs.select(column(docs, id_column, "long").alias("doc_id"), column(docs, text_column, "string").alias("text"))
    spill = stored(map_arrow(narrow, _fold(limit), SPILL), f"{path}/spill")
    carried = spill.filter(F.col("content").isNotNull()).select("rep_key", "hash", "bytes", "content")
    buckets = grace_buckets(carried, path, limit=limit, fan_out=fan_out)
    # Tasks follow the bytes of the contents, not a setting: about one bucket of the limit each.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (carried.agg(F.sum("bytes")).first()[0] or 0) // limit)
    groups = stored(
        map_arrow(
            buckets.repartition(parts, "bucket").sortWithinPartitions("bucket").select("bucket", "rep_key", "hash", "content"),
            _match(limit), "rep_key long, group_key long",
        ),
        f"{path}/groups",
    )
    rows = spill.select("doc_id", "points", "text_sha256", "row_key", "rep_key")
    rank = F.struct((-F.col("points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    folded = rows.groupBy("rep_key").agg(F.min(rank).alias("best"), F.count("*").alias("rows")).join(groups, "rep_key")
    merged = folded.groupBy("group_key").agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))
    result = groups.join(merged, "group_key").select(
        "rep_key", F.col("best.doc_id").alias("keep_id"), F.col("best.row_key").alias("keep_key"), F.col("rows").alias("group_size"),
    )
    return rows.join(result, "rep_key").select(
        "doc_id", "keep_id", F.col("group_size").cast("long"), (F.col("row_key") == F.col("keep_key")).alias("kept"), "text_sha256",
    )
