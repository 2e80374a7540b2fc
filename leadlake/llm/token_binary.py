"""Token ids in binary files: one id array, document boundaries in Elias-Fano code.

Documents are range-partitioned by id. A task appends segments to one file: the
ids of some documents as little-endian integers of 16 bits, or of 32 if the
vocabulary needs them, then the boundaries (the first id of each document and the
end) and the document ids, both in Elias-Fano code. A segment is closed before
it exceeds 32-bit places, so that its select structure needs no 64-bit table, and
is what a reading task opens.

    segment = magic, counts (ids, documents, documents without id), bytes of an id,
              code lengths, ids, boundaries, document ids

Texts are encoded whole, unless the tokenizer's file shows that it drops ASCII white
space and joins nothing across it (``splits_at_space``). Then the ids of a text are
those of its words in a row. A worker remembers the ids of two generations of words
that aren't long; words that neither holds are encoded.

Defined results: a null text is empty and has the end id alone; rows without id
come first, then ascending ids; equal ids are ordered by the hash of their text;
repeated rows are written each; an empty table gives no rows. Only id and text
are read.
"""

from __future__ import annotations

import re
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import column, folder, map_arrow, stored
from leadlake.llm.files import Writer, dealt, open_at, with_base

END_ID = 2
#: A segment is closed at so many bytes of ids or documents.
SEGMENT_BYTES, SEGMENT_DOCS = 16 << 20, 1 << 16
#: Words of one generation that a worker remembers, the bytes of the longest of them, and the bytes of text taken together.
REMEMBERED, LONG_WORD, PIECE_BYTES = 800_000, 64, 4 << 20
#: Patterns whose matches hold no white space, so that a split into matches drops it.
SPACELESS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)

MAGIC = b"EFTOKENS"
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_HEAD = struct.Struct("<8sQQQQQQ")
WRITTEN = "part long, segment long, uri string, offset long, length long, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bundled_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _steps(part: dict | None, key: str) -> list[dict]:
    return [] if part is None else part[key] if part["type"] == "Sequence" else [part]


def splits_at_space(definition: dict) -> bool:
    """Whether the ids of a text are those of its words, by the definition of the tokenizer.

    True only if every step is known not to look across white space: anything else is taken to.
    """
    plain = {"NFC", "NFD", "Lowercase"}
    for step in _steps(definition.get("normalizer"), "normalizers"):
        one_blank = step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " "
        if step["type"] not in plain and not one_blank:
            return False
    splitters = _steps(definition.get("pre_tokenizer"), "pretokenizers")
    dropping = [
        step["type"] in ("WhitespaceSplit", "BertPreTokenizer")
        or (step["type"] == "Split" and step["behavior"] == "Removed" and step["invert"] and step["pattern"].get("Regex") in SPACELESS)
        for step in splitters
    ]
    marked = [step.get("add_prefix_space", False) or step["type"] == "Metaspace" for step in splitters]
    tokens = definition.get("added_tokens") or []
    bound = any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in tokens)
    return bool(dropping) and dropping[0] and not any(marked) and not bound


class TextEncoder:
    """Ids of whole texts, as bytes; from the remembered ids of their words where that is the same."""

    _kept: dict[str, TextEncoder] = {}

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.by_words = splits_at_space(json.load(file))
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> TextEncoder:
        """The encoder that this worker has used before, or a new one."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _coded(self, texts: list[bytes]) -> list[bytes]:
        form = "H" if self.width == 2 else "I"
        coded = self._tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [struct.pack(f"<{len(c.ids)}{form}", *c.ids) for c in coded]

    def encode(self, text: bytes) -> bytes:
        if not self.by_words:
            return self._coded([text])[0]
        return b"".join([self._words(piece) for piece in _pieces(text)])

    def _words(self, text: bytes) -> bytes:
        words = text.split()
        new = set(words).difference(self._young)
        if not new:
            return b"".join(map(self._young.__getitem__, words))
        if len(self._young) + len(new) > REMEMBERED:
            self._old, self._young, new = self._young, {}, set(words)
        young, old, long = self._young, self._old, {}
        unknown = []
        for word in new:
            if (ids := old.get(word)) is None:
                unknown.append(word)
            else:
                young[word] = ids
        if unknown:
            for word, ids in zip(unknown, self._coded(unknown), strict=True):
                (young if len(word) <= LONG_WORD else long)[word] = ids
        if long:
            return b"".join([long[w] if w in long else young[w] for w in words])
        return b"".join(map(young.__getitem__, words))


def _pieces(text: bytes):
    """A text in pieces that end at white space."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        blank = _BLANK.search(text, at + PIECE_BYTES)
        if not blank:
            break
        yield text[at : blank.start()]
        at = blank.end()
    yield text[at:]


def pack_segment(doc_ids: list[int | None], docs: list[bytes], width: int) -> bytes:
    """Documents in ascending order of id, those without id first; ``width``: bytes of a token id."""
    import numpy as np

    from leadlake.llm import elias_fano

    known = np.array([d for d in doc_ids if d is not None], np.int64)
    # Signed ids in the order of unsigned ones.
    shifted = known.view(np.uint64) ^ np.uint64(1 << 63)
    bounds = np.concatenate([[0], np.cumsum([len(d) // width for d in docs])]).astype(np.uint64)
    coded, ids = elias_fano.encode(bounds), elias_fano.encode(shifted)
    head = _HEAD.pack(MAGIC, int(bounds[-1]), len(docs), len(docs) - len(known), width, len(coded), len(ids))
    return head + b"".join(docs) + coded + ids


class Segment:
    """A segment read back: boundaries by ``select``, or all of them."""

    def __init__(self, data: bytes):
        import numpy as np

        from leadlake.llm.elias_fano import EliasFano

        view = memoryview(data)
        magic, n_ids, self.n_docs, self.unnamed, width, coded, _ = _HEAD.unpack(view[: _HEAD.size])
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = _HEAD.size + width * n_ids
        self.ids = np.frombuffer(view[_HEAD.size : at], f"<u{width}")
        self.bounds = EliasFano(view[at : at + coded])
        self._named = EliasFano(view[at + coded :])
        self.flip = np.uint64(1 << 63)

    def doc_ids(self) -> list[int | None]:
        import numpy as np

        return [None] * self.unnamed + (self._named.all() ^ self.flip).view(np.int64).tolist()

    def document(self, i: int):
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def _write(target: str, tokenizer: str, end_id: int):
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, file, rows = TextEncoder.of(tokenizer), None, []
        part, ids, docs, held = TaskContext.get().partitionId(), [], [], 0
        end = end_id.to_bytes(encoder.width, "little")

        def close():
            nonlocal file, held
            if docs:
                file = file or Writer(target, ".tokens")
                data = pack_segment(ids, docs, encoder.width)
                rows.append((part, len(rows), file.uri, file.at, len(data), len(docs), sum(map(len, docs)) // encoder.width))
                file.write(data)
                ids.clear()
                docs.clear()
                held = 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                coded = encoder.encode(text.as_py() or b"") + end
                if docs and (held + len(coded) > SEGMENT_BYTES or len(docs) >= SEGMENT_DOCS):
                    close()
                ids.append(doc_id)
                docs.append(coded)
                held += len(coded)
        close()
        if file:
            file.close()
        names = [f.split()[0] for f in WRITTEN.split(", ")]
        arrays = [pa.array(list(c), pa.string() if n == "uri" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)] if rows else []
        if rows:
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return write


def _read(batches):
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            with open_at(row["uri"], row["offset"]) as file:
                segment = Segment(file.read(row["length"]))
            bounds = [segment.bounds.select(i) for i in range(segment.n_docs + 1)]
            wide = segment.ids.astype("<u4")
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment.doc_ids(), pa.int64()), pa.array([row["base"] + a for a in bounds[:-1]], pa.int64()),
                 pa.array([b - a for a, b in zip(bounds, bounds[1:], strict=False)], pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def write_tokens(
    docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, work: str | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Write the files; returns their segments (WRITTEN), part and segment giving the order."""
    path = folder(docs.sparkSession, work)
    text = column(docs, text_column, "string")
    narrow = docs.select(column(docs, id_column, "long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("hash"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    written = map_arrow(ordered, _write(f"{path}/tokens", tokenizer or bundled_tokenizer(), end_id), WRITTEN)
    return stored(written, f"{path}/segments")


def read_tokens(segments: DataFrame) -> DataFrame:
    """READ rows of all documents of the files; start counts the ids of all documents before."""
    based = stored(with_base(segments, "n_ids"), f"{folder(segments.sparkSession, None)}/based")
    return map_arrow(dealt(based), _read, READ)
