import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from leadlake.llm import warc

PAGES = "page_id long, url string, html string"


def test_chunks_carry_running_digests(spark):
    rng = random.Random(1)
    big = "".join(rng.choice("ab\r\néWARC/1.1") for _ in range(40_000))
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * rng.randrange(1, 200)) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nWARC-Type: x", ""), (102, "u", big), (103, "u", big), (104, "v", big), (None, "n", big), (105, "w", "short"), (106, "w", "short")]
    rows += [(107, "r", big + "2"), (107, "r", big + "2"), (None, "z", None)]
    docs = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as digest", "1 as payload", "2 as `first`").repartition(4)
    segments = warc.write_archives(docs, segment_bytes=3000)
    assert segments.count() > 8
    records = defaultdict(list)
    for r in warc.read_chunks(segments, chunk_bytes=1000).collect():
        records[r["page_id"], r["record_type"]].append(r)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        copy = html == big and page_id != 104
        chunks = sorted(records[page_id, "revisit" if copy else "response"], key=lambda r: (r["chunk"], r["payload_bytes"]))
        if copy:
            assert [(r["refers_to"], r["bytes_so_far"], r["sha1_so_far"], r["data"]) for r in chunks] == [(104, len(payload), hashlib.sha1(payload).hexdigest(), b"")]
        elif page_id == 107:
            assert len(chunks) == 2 * -(-len(payload) // 1000) and all(r["refers_to"] is None for r in chunks)
        else:
            assert b"".join(bytes(r["data"]) for r in chunks) == payload and [r["chunk"] for r in chunks] == list(range(max(1, -(-len(payload) // 1000))))
            done = b""
            for r in chunks:
                done += bytes(r["data"])
                assert r["sha1_so_far"] == hashlib.sha1(done).hexdigest() and r["bytes_so_far"] == len(done)
            assert [r["last"] for r in chunks] == [False] * (len(chunks) - 1) + [True]
    assert warc.read_chunks(warc.write_archives(docs.limit(0))).collect() == []


def test_archives_are_gzip_members(spark):
    docs = spark.createDataFrame([(1, "http://a", "x" * 5), (2, "http://b", "y" * 2000), (3, "http://c", "y" * 2000)], PAGES).coalesce(1)
    (row,) = warc.write_archives(docs).collect()
    with warc.open_at(row["uri"], 0) as file:
        data = file.read()
    text = gzip.decompress(data).decode()
    assert text.count("WARC/1.1\r\n") == 3 and text.count("WARC-Type: revisit") == 1 and row["length"] == len(data)
    assert "WARC-Refers-To: <urn:leadlake:page:3>" in text and text.endswith("y\r\n\r\n")


def test_damage_is_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "http://a", "x" * 5000)], PAGES).coalesce(1)
    (row,) = warc.write_archives(docs).collect()
    with warc.open_at(row["uri"], 0) as file:
        data = gzip.decompress(file.read()).replace(b"xxxxx", b"xxxyx", 1)
    path = tmp_path / "bad.warc.gz"
    for bad in (data, data[:3000]):
        path.write_bytes(zlib_member(bad))
        with warc.open_at(str(path), 0) as file, pytest.raises((ValueError, EOFError)):
            list(warc.records(file, path.stat().st_size))


def zlib_member(data):
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(data) + member.flush()
