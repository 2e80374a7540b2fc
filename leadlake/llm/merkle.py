"""Merkle manifest of a dataset, with proofs by Octopus multiproofs.

Rows are leaves of one tree per group, ordered by id. Consecutive pairs of nodes,
and a last node without partner alone, are hashed into their parent until one node
is left, the subroot. The subroots, in the order of their groups, are the leaves of
one more tree, whose last node is the root.

Building. Leaves are numbered by a range sort and one total per partition. A block
is 2^``SPAN_BITS`` consecutive leaves at an aligned place, so it is a whole subtree:
a task reduces it to its top node. Blocks of tops are reduced in the same way, tier
by tier, so that no task ever holds more than one block, whatever the size of a
group.

Proving. A leaf partition (a block) computes the minimal union of the coordinates
that the proofs of all its leaves need and that its own leaves don't give: the
Octopus algorithm. The coordinates of all blocks are fetched by one join with the
stored nodes. Each block then derives the interior nodes that its proofs share, and
expands the proof of every leaf locally.

H is the lowercase hex SHA-256 of its inputs in a row, digests as hex text. Nodes
travel as 32 bytes.

Defined results: null fields are written as ``-``; the null group comes first, then
groups by their UTF-8 bytes; rows without id come before the others of their group;
rows of one id are ordered by their leaf, so that rows which are equal are
interchangeable; a group of one leaf has that leaf as subroot, and a single subroot is
the root; a proof without siblings is H of nothing; an empty table has no rows and
no root. Only the fields named are read, in whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm.common import column, folder, map_arrow, stored

#: Levels of a block of leaves.
SPAN_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the subroots; keys of groups are empty or begin with "=".
TOP = "^"

NODES = "tree string, level int, index long, n long, hash binary"
REQUESTS = "tree string, block long, step int, of_tree string, level int, index long"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def leaf(fields: list[Column]) -> Column:
    """H of the fields in a row: ``-`` for null, else the number of bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tree_key(group: Column) -> Column:
    """A text that is ordered like the group: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    return (n - 1).bit_length()


def width(n: int, level: int) -> int:
    return -(-n >> level)


def joined(*hashes: bytes) -> bytes:
    return hashlib.sha256("".join(h.hex() for h in hashes).encode()).digest()


def parents(nodes: list[bytes]) -> list[bytes]:
    """The next level of consecutive nodes that begin at an even place."""
    return [joined(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def missing_coordinates(indices, n: int, level: int = 0) -> list[tuple[int, int]]:
    """(level, index), ascending: the fewest nodes that together with the nodes at ``indices`` of ``level`` give the root.

    ``n`` is the number of leaves of the tree. A node is missing if it is the
    sibling of a known or derived node and is neither known nor derived itself.
    """
    import numpy as np

    known, missing = np.unique(np.asarray(indices, np.int64)), []
    while (size := width(n, level)) > 1:
        siblings = known ^ 1
        wanted = siblings[(siblings < size) & ~np.isin(siblings, known, assume_unique=True)]
        missing += [(level, int(i)) for i in wanted]
        known, level = np.unique(known >> 1), level + 1
    return missing


def numbered(rows: DataFrame, order: list[Column], path: str) -> DataFrame:
    """``rows`` (tree, …) with index, the place inside the tree, and n, the rows of the tree.

    Rows are range-partitioned, so a tree of any size is dealt out over many tasks.
    Windows see one total per (tree, partition).
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id()
    ranged = stored(
        rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
        .select("*", F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")),
        f"{path}/ranged",
    )
    runs = ranged.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("place").alias("begin"))
    every = Window.partitionBy("tree")
    earlier = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(
        runs.select("tree", "part", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("begin")).alias("shift"), F.sum("rows").over(every).alias("n")),
        f"{path}/runs",
    )
    return ranged.join(runs, ["tree", "part"]).withColumn("index", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _reduce(bits: int, base: int, interior: bool):
    """Sorted (tree, index, n, hash) of ``base`` to NODES: the tops of blocks, and all nodes of the block if ``interior``."""

    def reduce(batches):
        import pyarrow as pa

        block, held, rows = None, [], []

        def close():
            tree, number, n = block
            nodes, level, first = held, base, number << bits
            top = min(base + bits, height(n))
            if interior:
                rows.extend((tree, level, first + i, n, h) for i, h in enumerate(nodes))
            while level < top:
                nodes, level, first = parents(nodes), level + 1, first >> 1
                if interior and level < top:
                    rows.extend((tree, level, first + i, n, h) for i, h in enumerate(nodes))
            if not (interior and level == base):
                rows.append((tree, level, first, n, nodes[0]))

        def batch_of():
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(5)]
            rows.clear()
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in NODES.split(", ")])

        for batch in batches:
            for tree, index, n, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != (tree, index >> bits, n):
                    if block:
                        close()
                    block, held = (tree, index >> bits, n), []
                held.append(node)
            if len(rows) >= 4096:
                yield batch_of()
        if block:
            close()
        yield batch_of()

    return reduce


def _blocks(nodes: DataFrame, bits: int, base: int, interior: bool) -> DataFrame:
    """Reduce (tree, index, n, hash) of one level; tasks read whole blocks in order."""
    dealt = nodes.select("tree", "index", "n", "hash", F.shiftright("index", bits).alias("block")).repartition("tree", "block")
    return map_arrow(dealt.sortWithinPartitions("tree", "index").select("tree", "index", "n", "hash"), _reduce(bits, base, interior), NODES)


def _height(n: str) -> Column:
    return F.when(F.col(n) == 1, 0).otherwise(F.length(F.bin(F.col(n) - 1)))


def build(leaves: DataFrame, path: str, *, bits: int = SPAN_BITS, leaf_levels: bool = False) -> DataFrame:
    """Nodes of every tree of ``leaves`` (tree, index, n, hash), from the tops of the blocks of leaves upwards.

    ``leaf_levels`` adds the leaves and all nodes between them and those tops.
    """
    nodes = stored(_blocks(leaves, bits, 0, leaf_levels), f"{path}/tier-0")
    most, base = leaves.agg(F.max("n")).first()[0] or 0, bits
    while most > 1 and height(most) > base:
        tops = nodes.filter((F.col("level") == base) & (_height("n") > base))
        upper = stored(_blocks(tops, bits, base, True).filter(F.col("level") > base), f"{path}/tier-{base}")
        nodes, base = nodes.unionByName(upper), base + bits
    return nodes


@dataclass
class Manifest:
    """Stored tables: leaves, nodes of all trees, and one row per tree (tree, subroot, rank, n_trees, root)."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    path: str
    bits: int


def manifest(leaves: DataFrame, *, work: str | None = None, bits: int = SPAN_BITS) -> Manifest:
    """The trees over ``leaves`` (tree, doc_id, hash, other; ``other``: a further leaf to prove instead, or null)."""
    spark, path = leaves.sparkSession, folder(leaves.sparkSession, work)
    read = stored(leaves, f"{path}/read")
    placed = stored(numbered(read, [F.col("doc_id"), F.col("hash")], f"{path}/leaves"), f"{path}/placed")
    low = build(placed, f"{path}/low", bits=bits)
    subroots = low.filter(F.col("level") == _height("n")).select(F.lit(TOP).alias("tree"), F.col("tree").alias("group"), "hash")
    ranked = stored(numbered(subroots, [F.col("group")], f"{path}/groups"), f"{path}/ranked")
    high = build(ranked, f"{path}/high", bits=bits, leaf_levels=True)
    root = high.filter(F.col("level") == _height("n")).select("tree", F.col("hash").alias("root"))
    trees = ranked.join(root, "tree").select(
        F.col("group").alias("tree"), F.col("hash").alias("subroot"), F.col("index").alias("rank"), F.col("n").alias("n_trees"), "root",
    )
    return Manifest(placed, low.unionByName(high), stored(trees, f"{path}/trees"), path, bits)


def _request(bits: int):
    """Blocks (tree, block, n, rank, n_trees) to REQUESTS."""

    def request(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for tree, block, n, rank, n_trees in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = missing_coordinates(range(block << bits, min(n, (block + 1) << bits)), n)
                above = missing_coordinates([rank], n_trees)
                wanted = [(tree, *c) for c in own] + [(TOP, *c) for c in above]
                rows += [(tree, block, step, *c) for step, c in enumerate(wanted)]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(6)]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in REQUESTS.split(", ")])

    return request


def climb(first: int, nodes: list[bytes], n: int, fetched: list[bytes]) -> tuple[list[list[bytes]], list[int]]:
    """All known nodes of every level below the top, and the index of the first of each.

    ``nodes`` are consecutive; ``fetched`` gives the missing coordinates in ascending order and is used up.
    """
    levels, begins, level = [], [], 0
    while width(n, level) > 1:
        if first & 1:
            nodes, first = [fetched.pop(0), *nodes], first - 1
        if len(nodes) & 1 and first + len(nodes) < width(n, level):
            nodes = [*nodes, fetched.pop(0)]
        levels.append(nodes)
        begins.append(first)
        nodes, first, level = parents(nodes), first >> 1, level + 1
    levels.append(nodes)
    begins.append(first)
    return levels, begins


def siblings(index: int, levels: list[list[bytes]], begins: list[int]) -> list[tuple[bytes | None, bool]]:
    """(sibling or None, whether it is on the left) of each level on the way up."""
    out = []
    for nodes, begin in zip(levels[:-1], begins[:-1], strict=True):
        at = (index ^ 1) - begin
        out.append((nodes[at] if at < len(nodes) else None, bool(index & 1)))
        index >>= 1
    return out


def fold(node: bytes, path: list[tuple[bytes | None, bool]]) -> bytes:
    for other, left in path:
        node = joined(node) if other is None else joined(other, node) if left else joined(node, other)
    return node


def _prove(bits: int):
    """Sorted rows of blocks, fetched nodes before leaves, to PROVED."""

    def prove(batches):
        import pyarrow as pa

        block, head, fetched, held, rows = None, None, [], [], []

        def close():
            n, rank, n_trees, subroot, root = head
            levels, begins = climb(held[0][0], [h for _, _, h, _ in held], n, fetched)
            above = siblings(rank, *climb(rank, levels[-1], n_trees, fetched))
            if levels[-1][0] != subroot:
                raise ValueError("fetched nodes don't belong to the leaves")
            for index, doc_id, node, other in held:
                path = siblings(index, levels, begins) + above
                proof = joined(*[s for s, _ in path if s is not None])
                rows.append((doc_id, node.hex(), subroot.hex(), root.hex(), proof.hex(), fold(other or node, path).hex()))

        def batch_of():
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(6)]
            rows.clear()
            names = [f.split()[0] for f in PROVED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "doc_id" else pa.string()) for c, k in zip(columns, names, strict=True)], names=names)

        for batch in batches:
            for tree, number, place, doc_id, node, other, n, rank, n_trees in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != (tree, number):
                    if block:
                        close()
                    block, head, fetched, held = (tree, number), None, [], []
                if n is not None:
                    head = (n, rank, n_trees, node, other)
                elif place < 0:
                    fetched.append(node)
                else:
                    held.append((place, doc_id, node, other))
            if len(rows) >= 4096:
                yield batch_of()
        if block:
            close()
        yield batch_of()

    return prove


def prove(made: Manifest) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root (from ``other`` where it is given), verified."""
    nothing, bits = F.lit(None), made.bits
    blocks = made.leaves.filter(F.col("index") % (1 << bits) == 0).select("tree", F.shiftright("index", bits).alias("block"), "n")
    blocks = stored(blocks.join(made.trees, "tree"), f"{made.path}/blocks")
    requests = map_arrow(blocks.select("tree", "block", "n", "rank", "n_trees"), _request(bits), REQUESTS)
    at = F.col("c.of_tree") == F.col("v.tree"), F.col("c.level") == F.col("v.level"), F.col("c.index") == F.col("v.index")
    fetched = requests.alias("c").join(made.nodes.alias("v"), [*at])

    def row(df: DataFrame, tree, block, place, doc_id, node, other, n, rank, n_trees) -> DataFrame:
        return df.select(
            tree.alias("tree"), block.alias("block"), place.cast("long").alias("place"), doc_id.cast("long").alias("doc_id"), node.alias("node"),
            other.cast("binary").alias("other"), n.cast("long").alias("n"), rank.cast("long").alias("rank"), n_trees.cast("long").alias("n_trees"),
        )

    c = F.col
    rows = (
        row(blocks, c("tree"), c("block"), F.lit(-(1 << 20)), nothing, c("subroot"), c("root"), c("n"), c("rank"), c("n_trees"))
        .unionByName(row(fetched, c("c.tree"), c("c.block"), c("c.step") - 1000, nothing, c("v.hash"), nothing, nothing, nothing, nothing))
        .unionByName(row(made.leaves, c("tree"), F.shiftright("index", bits), c("index"), c("doc_id"), c("hash"), c("other"), nothing, nothing, nothing))
    )
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    return map_arrow(dealt, _prove(bits), PROVED).withColumn("verified", c("folded_root") == c("root"))


def prove_documents(
    docs: DataFrame, *, tampered: Column | None = None, changed: dict[str, Column] | None = None, work: str | None = None, bits: int = SPAN_BITS,
    id_column: str = "doc_id", group_column: str = "lang", fields: tuple[str, ...] = FIELDS,
) -> DataFrame:
    """Proofs of all rows of ``docs``; rows for which ``tampered`` holds are folded with the ``changed`` values."""
    given = {name: docs[f"`{name}`"] for name in fields}
    other = nothing = F.lit(None).cast("string")
    if tampered is not None:
        other = F.when(tampered, leaf([(changed or {}).get(name, value) for name, value in given.items()])).otherwise(nothing)
    leaves = docs.select(
        tree_key(docs[f"`{group_column}`"]).alias("tree"), column(docs, id_column, "long").alias("doc_id"),
        F.unhex(leaf(list(given.values()))).alias("hash"), F.unhex(other).alias("other"),
    )
    return prove(manifest(leaves, work=work, bits=bits))
