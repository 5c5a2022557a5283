import gzip
import hashlib
import random

import pytest

from tallyloom.llm import scratch, warc_table


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("n_chunks").collect()), key=str)


def brute(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = data in first and first[data] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


def test_round_trip_of_awkward_payloads(spark):
    rng = random.Random(2)
    rows = [(1, "http://a/\r\nb", None), (2, None, ""), (3, "http://a", "é" * 60), (4, "http://b", "é" * 60), (None, "http://c", "é" * 60), (5, "u", "x" * 99), (6, "u", "x" * 99), (4, "http://b", "é" * 60), (3, "u", "é" * 60)]
    for k in range(60):
        rows.append((100 + k, "http://x", "".join(rng.choice(["\r\n", "\r", "\n", "\r\n\r\n", "a", "é", "WARC/1.1\r\n", "Content-Length: 5\r\n"]) for _ in range(rng.randrange(80)))))
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    for size in (7, 64, 1 << 16):
        path = scratch.new_path(spark, "warc")
        assert rows_of(warc_table.round_trip(df, path, chunk_bytes=size)) == brute(rows)
        chunks = [r for r in warc_table.read_chunks(spark, path).collect() if r.record_type == "response"]
        texts = {}
        for r in sorted(chunks, key=lambda r: r.chunk_no):
            assert len(r.data) <= size
            key = (r.record_id, r.page_id)
            texts[key] = texts.get(key, b"") + r.data if r.chunk_no else r.data
            if r.chunk_no == 0 and not r.is_last:
                assert r.digest_so_far == hashlib.sha256(r.data).hexdigest()
        wanted = {(str(i), html.encode()) for i, _, html in rows if i is not None and i >= 100}
        assert wanted <= {(page, data) for (_, page), data in texts.items()}


def test_shared_payloads_are_not_shuffled_or_are_split(spark, monkeypatch):
    from tallyloom.llm import hot

    rows = [(k, "u", "shared " * 40 if k % 3 else f"own {k} " * 40) for k in range(300)] + [(None, "u", "shared " * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    plan = warc_table.records(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(warc_table, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(hot, "SLICE_ROWS", 20)
    assert rows_of(warc_table.round_trip(df, scratch.new_path(spark, "warc"))) == brute(rows)


def test_archives_are_plain_warc(spark, tmp_path):
    path = scratch.new_path(spark, "warc")
    warc_table.write_archives(warc_table.records(spark.createDataFrame([(1, "http://a/", "y" * 200)], "page_id long, url string, html string")), path)
    stream = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}/*.gz").collect())
    data = gzip.decompress(stream)
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"y" * 200 + b"\r\n\r\n")


def test_damage_is_noticed():
    reader = warc_table.ChunkReader()
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1:aa>\r\nWARC-Payload-Digest: sha256:00\r\nX-Payload-Bytes: 1\r\nContent-Length: 5\r\n\r\n\r\n\r\nx\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(reader.feed(good))
    reader = warc_table.ChunkReader()
    list(reader.feed(good[:-6]))
    with pytest.raises(ValueError, match="inside"):
        reader.close()


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_table.round_trip(df, scratch.new_path(spark, "warc")).collect() == []
