import random
import zlib

import numpy as np
import pytest

from leadlake.llm import elias_fano, token_binary
from leadlake.llm.queries import op5_token_binary

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def whole_encoder(path=None):
    tokenizer = tokenizers.Tokenizer.from_file(path or token_binary.bundled_tokenizer())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def brute(rows, path=None):
    encode, start, out = whole_encoder(path), 0, []
    for doc_id, text in rows:
        ids = encode(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, op5_token_binary(spark, sf).collect())) == brute(docs)


def test_edges_and_small_segments(spark, monkeypatch):
    monkeypatch.setattr(token_binary, "SEGMENT_BYTES", 200)
    texts = [
        "", None, "It's the\x0bend\x0cof\r\nline", "<|endoftext|>a<|startoftext|> b", "ÉCOLE été ΑΣ ΒΣ ς", "a b c\x85d", "é ́x",
        "12 345,6!? :-) don't", "\U0001f600\U0001f600 漢字 한글", "\x1c\x1d x\x1e", "word " * 5000, "İstanbul ǅ ﬁ", "​‍ zero",
    ]
    rows = [(i * 10**12 - 5, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as hash", "1 as part", "2 as start").repartition(3)
    got = sorted(map(tuple, token_binary.read_tokens(token_binary.write_tokens(docs)).collect()), key=lambda r: r[1])
    assert got == brute(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert token_binary.read_tokens(token_binary.write_tokens(docs.limit(0))).collect() == []


def test_select_equals_decoding():
    rng = random.Random(1)
    for n, span in [(0, 1), (1, 1), (1, 1 << 60), (2000, 1), (2000, 50), (3000, 10**6), (700, 1 << 62)]:
        values = sorted(rng.randrange(span) + 17 for _ in range(n))
        data = elias_fano.encode(np.array(values, np.uint64))
        code = elias_fano.EliasFano(data)
        assert code.all().tolist() == values == [code.select(i) for i in range(n)] and code.size == len(data)
        if n:
            width = max(0, (values[-1] - values[0] + 1) // n).bit_length()
            assert 8 * len(data) <= n * (3 + width) + n // 8 + 400
    with pytest.raises(IndexError):
        code.select(700)


def test_segment_documents():
    docs = [[1, 2], [2], [7, 8, 9, 2]]
    for width in (2, 4):
        packed = [np.array(d, f"<u{width}").tobytes() for d in docs]
        segment = token_binary.Segment(token_binary.pack_segment([None, -5, 8], packed, width))
        assert segment.doc_ids() == [None, -5, 8]
        assert [segment.document(i).tolist() for i in range(3)] == docs


def test_reader_takes_offsets_from_select(monkeypatch):
    import io

    import pyarrow as pa

    docs = [np.arange(1 + i % 7, dtype="<u2").tobytes() for i in range(1000)]
    data = token_binary.pack_segment(list(range(1000)), docs, 2)
    asked, select = [], elias_fano.EliasFano.select
    monkeypatch.setattr(elias_fano.EliasFano, "select", lambda self, i: asked.append(i) or select(self, i))
    monkeypatch.setattr(token_binary, "open_at", lambda uri, offset: io.BytesIO(data))
    (out,) = token_binary._read([pa.RecordBatch.from_pylist([{"uri": "x", "offset": 0, "length": len(data), "base": 10}])])
    sizes = [1 + i % 7 for i in range(1000)]
    assert set(asked) == set(range(1001)) and out.column(2).to_pylist() == sizes
    assert out.column(1).to_pylist() == [10 + sum(sizes[:i]) for i in range(1000)]


TEXTS = [
    "", None, " two  blanks ", "It's the\x0bend\x0cof\r\nline", "<|endoftext|>a b", "ÉCOLE ΑΣ ς", "x " + "long" * 50 + " y " + "long" * 50, "12 345,6!? don't",
    "\U0001f600 漢字 한글", "word " * 3000, "\t\n", "tail ",
]


def test_tokenizers_that_keep_white_space_encode_whole_texts(spark):
    import public_tokenizers

    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        assert token_binary.TextEncoder(path).by_words is by_words
        got = token_binary.read_tokens(token_binary.write_tokens(docs, tokenizer=path)).collect()
        assert sorted(map(tuple, got)) == brute(rows, path)


def test_only_known_steps_are_taken_to_split_at_space():
    split = {"type": "Split", "pattern": {"Regex": token_binary.SPACELESS[0]}, "behavior": "Removed", "invert": True}
    assert token_binary.splits_at_space({"normalizer": None, "pre_tokenizer": split})
    assert token_binary.splits_at_space({"normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []})
    for other in (
        {"normalizer": None, "pre_tokenizer": None}, {"normalizer": {"type": "Prepend"}, "pre_tokenizer": split},
        {"normalizer": None, "pre_tokenizer": {"type": "Metaspace"}}, {"normalizer": None, "pre_tokenizer": {**split, "invert": False}},
        {"normalizer": None, "pre_tokenizer": {**split, "pattern": {"Regex": ".+"}}},
        {"normalizer": None, "pre_tokenizer": split, "added_tokens": [{"lstrip": True, "rstrip": False, "single_word": False, "content": "a"}]},
    ):
        assert not token_binary.splits_at_space(other)


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(token_binary, "REMEMBERED", 50)
    monkeypatch.setattr(token_binary, "PIECE_BYTES", 100)
    encoder, whole = token_binary.TextEncoder(token_binary.bundled_tokenizer()), whole_encoder()
    rng = random.Random(6)
    for _ in range(40):
        text = " ".join(rng.choice([f"w{rng.randrange(200)}", "long" * rng.randrange(17, 30)]) for _ in range(rng.randrange(200)))
        assert np.frombuffer(encoder.encode(text.encode()), "<u2").tolist() == whole(text)[:-1]
        assert len(encoder._young) <= 60 and max(map(len, encoder._young), default=0) <= token_binary.LONG_WORD


def test_segments_are_read_by_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from leadlake.llm.files import dealt

    monkeypatch.setattr(token_binary, "SEGMENT_DOCS", 20)
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('some words ', cast(id % 50 AS int)) AS text")
    segments = token_binary.write_tokens(docs)
    shares = dealt(segments).groupBy(F.spark_partition_id().alias("p")).agg(F.sum("length").alias("bytes"), F.count("*").alias("n")).collect()
    mean = sum(r["bytes"] for r in shares) / len(shares)
    assert len(shares) > 8 and max(r["bytes"] for r in shares) <= 2 * mean
    assert sum(r["n"] for r in shares) == segments.count()
