import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from tallyloom.llm import bpe_stream, packing, scratch


def naive(sizes, length):
    rows, left = [], []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [r for r in range(len(rows)) if left[r] >= sizes[k]]
        if fits:
            r = min(fits, key=lambda r: left[r])
        else:
            rows.append([])
            left.append(length)
            r = len(rows) - 1
        rows[r].append(k)
        left[r] -= sizes[k]
    return sorted(left)


def test_best_fit_like_a_plain_search():
    rng = random.Random(3)
    for length in (1, 2, 7, 64, 100):
        for _ in range(60):
            sizes = [rng.randint(1, length) for _ in range(rng.randrange(60))]
            rows = packing.best_fit(sizes, length)
            assert sorted(k for r in rows for k in r) == list(range(len(sizes)))
            assert sorted(length - sum(sizes[k] for k in r) for r in rows) == naive(sizes, length)


def test_documents_come_back_whole(spark):
    rng = random.Random(4)
    texts = ["", None, "a", "long " * 30_000] + [" ".join(rng.choice(["the", "quick", "ciónñ", "<|endoftext|>", "x" * 90]) for _ in range(rng.choice([1, 5, 40, 400]))) for _ in range(60)]
    df = spark.createDataFrame([(k if k else None, t, k) for k, t in enumerate(texts)] + [(7, texts[7], 0)], "doc_id long, text string, ids long").repartition(3)
    library = Tokenizer.from_file(bpe_stream.default_vocabulary())
    for length, block in ((16, 100), (64, 10**6)):
        docs = {}
        for r in packing.pack(df, length=length, block_tokens=block).collect():
            ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
            assert len(ids) == len(places) == length and r.cu_seqlens[-1] == r.n_tokens <= length and r.n_segments == len(r.doc_ids) == len(r.doc_starts)
            for i, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
                assert places[a:b].tolist() == list(range(b - a))
                docs.setdefault(i, []).append((start, ids[a:b].tolist()))
            assert not ids[r.n_tokens :].any()
        for k, text in enumerate(texts):
            wanted = library.encode(text or "", add_special_tokens=False).ids
            parts = sorted(docs.get(k, []))
            # A repeated document is there twice.
            for parts in (parts[::2], parts[1::2]) if k == 7 else (parts,):
                joined = []
                for start, part in parts:
                    assert start == len(joined)
                    joined += part
                assert joined == wanted
    assert packing.pack(df.limit(0)).collect() == []


def test_shards_come_back_as_packed(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 5)
    rng = random.Random(6)
    rows = [(k if k else None, None if k == 1 else " ".join(rng.choice(["the", "\n", "ciónñ", "x" * 40]) for _ in range(rng.randrange(150)))) for k in range(80)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(3)
    kept = scratch.materialize(df, "packing-test")
    wanted = {(r.task, r.block, r.row): r for r in packing.pack(kept, length=64, block_tokens=1500).collect()}
    to = scratch.new_path(spark, "packed")
    index = packing.write_shards(kept, to, length=64, block_tokens=1500)
    assert index.schema["doc_ids"].dataType.simpleString() == "array<bigint>"
    whole = {(r.task, r.block, r.row): r for r in packing.read_shards(spark, f"{to}/shards").collect()}
    found = {(r.task, r.block, r.row): r for r in index.collect()}
    assert set(found) == set(whole) == set(wanted) and len({r.shard for r in found.values()}) > len(wanted) / 6
    for key, r in found.items():
        other = wanted[key]
        assert (r.cu_seqlens, r.doc_ids, r.doc_starts, r.n_tokens, r.n_segments) == (other.cu_seqlens, other.doc_ids, other.doc_starts, other.n_tokens, other.n_segments)
        assert bytes(whole[key].ids) == bytes(other.ids) and bytes(whole[key].position_ids) == bytes(other.position_ids)
        with open(r.shard.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            ids = f.read(128)
        assert ids == bytes(other.ids) and hashlib.sha256(ids).hexdigest() == r.ids_sha256
    assert packing.write_shards(kept.limit(0), scratch.new_path(spark, "packed")).collect() == []


def test_shards_hold_position_ids(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(k, " ".join(rng.choice(["the", "x" * 40, "ñ"]) for _ in range(rng.randrange(1, 90)))) for k in range(40)], "doc_id long, text string")
    found = packing.write_shards(df, scratch.new_path(spark, "packed"), length=64, block_tokens=1500).collect()
    assert max(r.n_segments for r in found) > 1
    for r in found:
        with open(r.shard.removeprefix("file:"), "rb") as f:
            f.seek(r.positions_offset)
            places = f.read(128)
        wanted = [k for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for k in range(b - a)]
        assert np.frombuffer(places, "<u2").tolist() == wanted + [0] * (64 - r.n_tokens)
        assert hashlib.sha256(places).hexdigest() == r.positions_sha256
