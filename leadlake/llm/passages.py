"""Remove repeated passages of words by prefix-partitioned suffix trees.

A suffix begins at each word of a document. Its label is cut after ``WINDOW`` words;
a node of that depth with two leaves or more is a window that repeats, and runs of
such windows are the maximal repeats. A label is written as two edges: the prefix,
its first ``PREFIX`` words, and the rest, each a 64-bit hash of its words.

1. Prefix census. Every window holds a sampled prefix: the one of least hash that
   begins and ends inside it. Equal windows hold equal ones. Sampled prefixes are
   counted over all documents; a window whose sampled prefix occurs once has no
   partner, and its suffix is put into no tree. A task announces a prefix once,
   however often it occurs there.
2. Local trees. Documents are dealt out by the least of their repeated prefixes, so
   that copies meet; documents of a frequent one are spread. A task sorts the
   labels of its remaining suffixes. What repeats inside the task is known then, and
   each node leaves the task as one row, however many copies it has.
3. Partitioned trees. Nodes are split into groups by prefix. Groups above the
   limit take longer prefixes, up to the whole label, so that only copies of one
   window stay together: one per task that has it. A group's tree is its
   labels in order with the depth of the branch between neighbours; suffixes below
   its deep nodes go back to their documents.
4. Words covered by a repeated window are cut out.

Texts move by their keys to meet their repeated prefixes; only documents that have
some are kept then, and what the others hold is known from the census.

Defined results: a null or empty text has no words; a document of fewer than
``WINDOW`` words has no window; rows that repeat id and text repeat each other's
windows; a passage loses all its occurrences, the first one too; overlapping
occurrences in one document count; an empty table gives no rows. Words are compared
as they are, separated by ASCII white space. Only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.llm.common import column, folder, map_arrow, stored
from leadlake.llm.minhash import row_key

WINDOW, PREFIX = 35, 16
#: Bytes of text that are hashed together, and words whose windows are looked at together.
PIECE_BYTES, CHUNK_WORDS = 4 << 20, 1 << 20
#: Nodes of a group.
GROUP_NODES = 1 << 18
#: Documents that the same prefix brings together.
LEAD_DOCS = 2048

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; distinct values stay distinct."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE_BYTES)
        _POWERS[:] = [
            np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _POWERS[0], _POWERS[1]


def _hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one behind the other, and the number of words of each text."""
    letter = ~_SPACE[data]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = letter[inner]
    last[inner - 1] = letter[inner - 1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(len(data))
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=running[1:])
    hashes = mixed((running[ends] - running[begins]) * inverse[begins])
    return hashes, np.diff(np.searchsorted(begins, bounds))


def _long_text(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text above a piece, piece by piece."""
    out, at, size = [], 0, len(data)
    while at < size:
        end = min(at + PIECE_BYTES, size)
        if end < size:
            blank = np.flatnonzero(_SPACE[data[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:
                # A word that a piece can't hold: its hash is summed up over pieces.
                total, begin, power, piece = 0, at, 1, _powers(PIECE_BYTES)[0]
                while at < size and not len(blank):
                    part = data[at : at + PIECE_BYTES]
                    blank = np.flatnonzero(_SPACE[part])
                    part = part[: blank[0]] if len(blank) else part
                    total += power * int((_BYTE[part] * piece[: len(part)]).sum(dtype=np.uint64))
                    at += len(part)
                    power = pow(_BASE, at - begin, 1 << 64)
                out.append(mixed(np.array([total % (1 << 64)], np.uint64)))
                continue
        out.append(_hashed_words(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of an Arrow array of binary texts, and the number of words of each."""
    out, counts, held, begin = [], [], [], 0

    def flush():
        if held:
            bounds = np.cumsum([0, *map(len, held)])
            data = np.concatenate(held)
            hashes, n = _hashed_words(data, bounds) if len(data) else (np.empty(0, np.uint64), np.zeros(len(held), np.int64))
            out.append(hashes)
            counts.append(n)
            held.clear()

    for text in texts:
        data = np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.empty(0, np.uint8)
        if begin + len(data) > PIECE_BYTES:
            flush()
            begin = 0
        if len(data) > PIECE_BYTES:
            hashes = _long_text(data)
            out.append(hashes)
            counts.append(np.array([len(hashes)]))
        else:
            held.append(data)
            begin += len(data)
    flush()
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.concatenate(counts) if counts else np.empty(0, np.int64)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(_BASE) + right)


class Spans:
    """Hashes of runs of words, by their first word; made by doubling."""

    def __init__(self, words: np.ndarray):
        self._double = [words]

    def of(self, length: int) -> np.ndarray:
        out, left = None, length
        for order in range(length.bit_length()):
            while len(self._double) <= order:
                last, half = self._double[-1], 1 << (len(self._double) - 1)
                self._double.append(_joined(last[:-half], last[half:]) if len(last) > half else last[:0])
            if length >> order & 1:
                left -= 1 << order
                own = self._double[order][left:]
                out = own if out is None else _joined(own[: len(out)], out[: len(own)])
        return out


def _sliding(values: np.ndarray, span: int, best) -> np.ndarray:
    """Least or greatest of each ``span`` consecutive values, by doubling."""
    have = 1
    while have < span:
        step = min(have, span - have)
        values = best(values[:-step], values[step:]) if len(values) > step else values[:0]
        have += step
    return values


class Windows:
    """Windows of texts whose words lie one behind the other."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, window: int, prefix: int):
        self.ends = np.cumsum(counts)
        self.n = max(0, len(words) - window + 1)
        self._spans, self._window, self._prefix = Spans(words), window, prefix
        self.prefixes = self._spans.of(prefix)
        owner = np.repeat(np.arange(len(counts)), counts)[: self.n]
        self.valid = np.arange(self.n) + window <= self.ends[owner]
        #: The sampled prefix of each window.
        self.sampled = _sliding(self.prefixes, window - prefix + 1, np.minimum)[: self.n]

    def anchors(self) -> np.ndarray:
        """Places of the prefixes that are sampled by some window."""
        span = self._window - self._prefix + 1
        held = np.where(self.valid, self.sampled, np.uint64(0))
        padded = np.concatenate([np.zeros(span - 1, np.uint64), held, np.zeros(span - 1, np.uint64)])
        return np.flatnonzero(_sliding(padded, span, np.maximum) == self.prefixes[: self.n + span - 1]) if self.n else np.empty(0, np.int64)

    def rest(self) -> np.ndarray:
        """Hashes of the words of each window behind its prefix."""
        return self._spans.of(self._window - self._prefix)[self._prefix :][: self.n]


def _slices(counts: np.ndarray, window: int):
    """Runs of texts for one look: (first text, texts, first word inside a text, words).

    A text above a chunk is cut into overlapping slices; each window begins in one of them.
    """
    row = 0
    while row < len(counts):
        if counts[row] > CHUNK_WORDS:
            for at in range(0, int(counts[row]) - window + 1, CHUNK_WORDS):
                yield row, 1, at, min(CHUNK_WORDS + window - 1, int(counts[row]) - at)
            row += 1
            continue
        end, held = row, 0
        while end < len(counts) and held + counts[end] <= CHUNK_WORDS:
            held += int(counts[end])
            end += 1
        yield row, end - row, 0, held
        row = end


def _looks(texts, window: int, prefix: int):
    """(rows, first word, counts, Windows) over an Arrow array of texts."""
    words, counts = word_hashes(texts)
    begins = np.concatenate([[0], np.cumsum(counts)])
    for row, n, at, size in _slices(counts, window):
        own = np.array([size]) if n == 1 else counts[row : row + n]
        begin = int(begins[row]) + at
        yield np.arange(row, row + n), at, own, Windows(words[begin : begin + size], own, window, prefix)


CENSUS = (
    "doc_id long, k1 long, k2 long, n_words long, whole_sha256 string, once array<long>, twice array<long>, told array<long>"
)


def _lists(values: np.ndarray, owners: np.ndarray, n: int):
    """Values by owner, as an Arrow array of ``n`` lists; owners ascend."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(n + 1)), pa.int32()), pa.array(values.view(np.int64)))


def _census(window: int, prefix: int):
    """(doc_id, k1, k2, text) to CENSUS.

    once: sampled prefixes that no other place of the batch samples; twice: those that
    some place does; told: of the latter, those that this row announces for the batch.
    """

    def census(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            n, n_words, digests, values, owners = batch.num_rows, [], [], [], []
            for text in batch.column(3):
                words = (text.as_py() or b"").split()
                n_words.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            for rows, _, counts, found in _looks(batch.column(3), window, prefix):
                places = found.anchors()
                values.append(found.prefixes[places])
                owners.append(rows[np.searchsorted(np.cumsum(counts), places, "right")])
            value, owner = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((values, np.uint64), (owners, np.int64)))
            order = np.lexsort((owner, value))
            value, owner = value[order], owner[order]
            new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.empty(0, bool)
            single = new & np.append(new[1:], True)
            first_of_row = new | np.concatenate([[True], owner[1:] != owner[:-1]]) if len(value) else new
            lists = []
            for chosen in (single, ~single & first_of_row, ~single & new):
                own = np.flatnonzero(chosen)
                own = own[np.argsort(owner[own], kind="stable")]
                lists.append(_lists(value[own], owner[own], n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n_words, pa.int64()), pa.array(digests, pa.string()), *lists],
                names=[f.split()[0] for f in CENSUS.split(", ")],
            )

    return census


#: A node (prefix and rest given; no and begin if it has one leaf), or a run of repeated windows (prefix null).
LOCAL = "prefix long, rest long, no long, begin long, length long"
NODES = ("prefix", "rest", "no", "begin")


def _local(window: int, prefix: int):
    """(no, text, live), copies close together, to LOCAL: the trees of a task's documents, chunk by chunk."""

    def local(batches):
        import pyarrow as pa

        def made(*columns):
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in LOCAL.split(", ")])

        for batch in batches:
            numbers, live = np.asarray(batch.column(0)), batch.column(2)
            for rows, at, counts, found in _looks(batch.column(1), window, prefix):
                wanted = np.unique(np.asarray(live.slice(int(rows[0]), len(rows)).flatten()).view(np.uint64))
                starts = np.flatnonzero(found.valid & np.isin(found.sampled, wanted))
                if not len(starts):
                    continue
                first, rest = found.prefixes[starts], found.rest()[starts]
                order = np.lexsort((rest, first))
                first, rest, starts = first[order], rest[order], starts[order]
                node = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])]))
                leaves = np.diff(np.append(node, len(first)))
                many = leaves > 1
                bounds = np.concatenate([[0], np.cumsum(counts)])
                owner = np.searchsorted(bounds, starts[node], "right") - 1
                yield made(
                    first[node].view(np.int64), rest[node].view(np.int64), pa.array(numbers[rows[owner]], mask=many),
                    pa.array(starts[node] - bounds[owner] + at, pa.int64(), mask=many), pa.nulls(len(node), pa.int64()),
                )
                runs = np.sort(starts[np.repeat(many, leaves)])
                if len(runs):
                    owner = np.searchsorted(bounds, runs, "right") - 1
                    new = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1] + 1) | (owner[1:] != owner[:-1])]))
                    none = pa.nulls(len(new), pa.int64())
                    yield made(
                        none, none, numbers[rows[owner[new]]], runs[new] - bounds[owner[new]] + at, np.diff(np.append(new, len(runs))).astype(np.int64),
                    )

    return local


def deep_leaves(prefix: np.ndarray, rest: np.ndarray, many: np.ndarray, window: int, head: int) -> np.ndarray:
    """Leaves below deep nodes of the tree with these labels, which are in order.

    The depth of the branch between neighbours is the number of words that their labels share.
    """
    depth = np.where(prefix[1:] != prefix[:-1], 0, np.where(rest[1:] != rest[:-1], head, window))
    deep = np.concatenate([[False], depth >= window, [False]])
    return deep[1:] | deep[:-1] | many


def _trees(window: int, head: int):
    """Nodes in order of their labels to (no, begin): single leaves below deep nodes."""

    def trees(batches):
        import pyarrow as pa

        held = None

        def hits(nodes):
            prefix, rest = (np.asarray(nodes.column(i)) for i in (0, 1))
            single = np.asarray(nodes.column(2).is_valid())
            chosen = nodes.filter(pa.array(single & deep_leaves(prefix, rest, ~single, window, head)))
            return pa.RecordBatch.from_arrays([chosen.column(2), chosen.column(3)], names=["no", "begin"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            prefix, rest = (np.asarray(batch.column(i)) for i in (0, 1))
            # The last node may go on in the next batch.
            open_ = len(prefix) - int(((prefix == prefix[-1]) & (rest == rest[-1])).sum())
            if open_:
                yield hits(batch.slice(0, open_))
            held = batch.slice(open_)
            if held.num_rows > 2:
                yield hits(held)
                # What was sent need not be sent again: one row that stands for many.
                one, none = held.slice(0, 1), pa.nulls(1, pa.int64())
                held = pa.RecordBatch.from_arrays([one.column(0), one.column(1), none, none], schema=held.schema)
        if held is not None:
            yield hits(held)

    return trees


def grouped(nodes: DataFrame, path: str, limit: int = GROUP_NODES) -> DataFrame:
    """Nodes dealt out by group: a prefix of one length for groups that fit ``limit``, a longer one for the others.

    Sizes are counted per group, in the map tasks first. Behind the longer
    prefix only rows of one label can't be told apart.
    """
    stem = F.pmod("prefix", F.lit(max(1, 4 * nodes.count() // limit)))
    over = stored(
        nodes.groupBy(stem.alias("stem")).count().filter(F.col("count") > limit)
        .select("stem", F.ceil(2 * F.col("count") / limit).cast("long").alias("parts")),
        f"{path}/over",
    )
    split = nodes.join(over, stem == F.col("stem"), "left")
    return split.repartition(stem, F.coalesce(F.pmod("rest", F.col("parts")), F.lit(-1))).select(*NODES)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    doc_id, text = column(docs, id_column, "long"), column(docs, text_column, "string")
    return docs.select(doc_id.alias("doc_id"), *row_key(doc_id, text), text.cast("binary").alias("text"))


def _live(census: DataFrame, path: str, most: int = LEAD_DOCS) -> DataFrame:
    """k1, k2, no, live, lead, salt of the documents with repeated sampled prefixes; rows of one key share a number.

    A prefix has one row per batch of documents, so the groups that are counted
    here are bounded by the batches, whatever the number of copies.
    """
    once = census.select(F.explode("once").alias("anchor"), "no")
    told = census.select(F.explode("told").alias("anchor"), F.lit(None).cast("long").alias("no"))
    met = once.unionByName(told).withColumn("n", F.count("*").over(Window.partitionBy("anchor")))
    shared = met.filter("n > 1 AND no IS NOT NULL").groupBy("no").agg(F.collect_list("anchor").alias("shared"))
    none = F.array().cast("array<long>")
    own = census.select("no", "k1", "k2", "twice").join(shared, "no", "left")
    live = (
        own.select("no", "k1", "k2", F.concat("twice", F.coalesce("shared", none)).alias("live")).filter(F.size("live") > 0)
        .groupBy("k1", "k2").agg(F.min("no").alias("no"), F.array_distinct(F.flatten(F.collect_list("live"))).alias("live"))
        .withColumn("lead", F.array_min("live"))
    )
    live = stored(live, f"{path}/live")
    hot = stored(
        live.groupBy("lead").count().filter(F.col("count") > most).select("lead", F.ceil(F.col("count") / most).cast("long").alias("parts")),
        f"{path}/hot-leads",
    )
    return live.join(hot, "lead", "left").withColumn("salt", F.coalesce(F.pmod("no", F.col("parts")), F.lit(0))).drop("parts")


@dataclass
class Passages:
    """Stored tables.

    rows: CENSUS without the prefixes, one row per row of the documents; touched: k1, k2, no
    and text of documents with repeated prefixes; hits: no and spans (begin, length):
    words at which repeated windows begin.
    """

    rows: DataFrame
    touched: DataFrame
    hits: DataFrame
    window: int


def find_passages(
    docs: DataFrame, *, window: int = WINDOW, prefix: int = PREFIX, limit: int = GROUP_NODES, lead_docs: int = LEAD_DOCS, work: str | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> Passages:
    """Where the repeated windows of ``docs`` begin."""
    if not 0 < prefix < window:
        raise ValueError("a prefix has at least one word and fewer than a window")
    path, keyed = folder(docs.sparkSession, work), _keyed(docs, id_column, text_column)
    census = stored(map_arrow(keyed, _census(window, prefix), CENSUS).withColumn("no", F.monotonically_increasing_id()), f"{path}/census")
    met = keyed.select("k1", "k2", "text").join(_live(census, path, lead_docs), ["k1", "k2"])
    touched = stored(met.repartition("lead", "salt").sortWithinPartitions("lead").select("k1", "k2", "no", "text", "live"), f"{path}/touched")
    local = stored(map_arrow(touched.select("no", "text", "live"), _local(window, prefix), LOCAL), f"{path}/local")
    dealt = grouped(local.filter(F.col("prefix").isNotNull()).select(*NODES), path, limit).sortWithinPartitions("prefix", "rest")
    shared = map_arrow(dealt, _trees(window, prefix), "no long, begin long").withColumn("length", F.lit(1).cast("long"))
    inside = local.filter(F.col("prefix").isNull()).select("no", "begin", "length")
    hits = shared.unionByName(inside).groupBy("no").agg(F.collect_list(F.struct("begin", "length")).alias("spans"))
    return Passages(census.select("doc_id", "k1", "k2", "n_words", "whole_sha256"), touched.select("k1", "k2", "no", "text"), stored(hits, f"{path}/hits"), window)


CUT = "k1 long, k2 long, n_removed long, kept binary"


def _cut(window: int):
    """(k1, k2, text, begins, lengths) to CUT: the words that no repeated window covers, joined by one space."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            n_removed, kept = [], []
            for text, begins, lengths in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True):
                words = text.as_py().split()
                begin, length = np.asarray(begins.values), np.asarray(lengths.values)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + length + window - 1, -1)
                stay = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                n_removed.append(len(words) - len(stay))
                kept.append(b" ".join([words[i] for i in stay.tolist()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=[f.split()[0] for f in CUT.split(", ")],
            )

    return cut


def changed_texts(found: Passages) -> DataFrame:
    """k1, k2, n_removed, kept of the documents that lose words; rows that repeat id and text are one row."""
    texts = found.touched.dropDuplicates(["no"]).join(found.hits, "no")
    cut = map_arrow(texts.select("k1", "k2", "text", F.col("spans.begin").alias("begins"), F.col("spans.length").alias("lengths")), _cut(found.window), CUT)
    return cut.withColumn("kept", F.col("kept").cast("string"))


def passage_digests(found: Passages) -> DataFrame:
    """One row per row of the documents: doc_id, n_words, n_removed and the digest of the words that stay, joined by one space."""
    changed = changed_texts(found).select("k1", "k2", "n_removed", F.sha2("kept", 256).alias("cut_sha256"))
    return found.rows.join(changed, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"),
    )


def remove_passages(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_removed, kept; a text without repeated passage stays as it is."""
    found = find_passages(docs, id_column=id_column, text_column=text_column, **options)
    keyed = _keyed(docs, id_column, text_column)
    return keyed.join(changed_texts(found), ["k1", "k2"], "left").select(
        "doc_id", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.when(F.col("n_removed").isNull(), F.col("text").cast("string")).otherwise(F.col("kept")).alias("kept"),
    )
