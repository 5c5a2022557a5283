import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import bpe_stream

PIECES = ["a", "the", "ing", " ", "  ", "\n", "'s", "'", "é", "ñ", "1", "23", "!", "<|endoftext|>", "漢", "\x85", "\x1c", "　", "́", "²", "Ⅷ", "😀", "\t", "_", "aaaa", "​", "İ", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_stream.default_vocabulary())


@pytest.fixture(scope="module")
def ours():
    return bpe_stream.Tokenizer(bpe_stream.default_vocabulary())


def ids_of(ours, text):
    return np.frombuffer(b"".join(ours.encode(text)), "<u4").tolist()


def test_like_the_library(library, ours):
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(ours, text) == ids, text
        assert "".join(ours.decode([np.array(ids, "<u4").tobytes()])) == library.decode(ids, skip_special_tokens=False)


def test_long_pieces_are_streamed_in_bounded_memory(library, ours):
    rng = random.Random(4)
    for letters in ("ab=", "aetionsrhdl", "x", "- ", "éa"):
        text = "".join(rng.choice(letters) for _ in range(30_000))
        assert ids_of(ours, text) == library.encode(text, add_special_tokens=False).ids
    encoder, most = bpe_stream.Encoder(ours.vocab), 0
    data = "".join(rng.choice("etaoin") for _ in range(50_000)).encode()
    out = []
    for k in range(0, len(data), 100):
        out += encoder.feed(data[k : k + 100])
        most = max(most, len(encoder.pending))
    assert most <= 5 * ours.vocab.lookahead + 100
    assert out + encoder.finish() == library.encode(data.decode(), add_special_tokens=False).ids


def test_spans_do_not_change_the_result(library, ours, monkeypatch):
    monkeypatch.setattr(bpe_stream, "SPAN_CHARS", 5)
    rng = random.Random(6)
    for _ in range(1000):
        text = "".join(rng.choice(PIECES) for _ in range(40))
        assert ids_of(ours, text) == library.encode(text, add_special_tokens=False).ids, text


def test_all_pieces_pass_through_the_encoder(library, monkeypatch):
    ours = bpe_stream.Tokenizer(bpe_stream.default_vocabulary())
    fed, merged = [], bpe_stream.merged
    inner = ours.encoder.finish
    monkeypatch.setattr(ours.encoder, "finish", lambda: fed.append(ours.encoder.pending) or inner())
    calls = []
    monkeypatch.setattr(bpe_stream, "merged", lambda v, p: calls.append(p) or merged(v, p))
    text = "short and longer words, 1234 and " + "abc" * 400 + " again: short and longer words"
    assert ids_of(ours, text) == library.encode(text, add_special_tokens=False).ids
    distinct = set(ours.find(text))
    assert ours.encoder.streamed == len(distinct) == len(fed) and set(ours.encoder) == distinct
    assert len(calls) > len(distinct) and max(map(len, calls)) <= 4 * ours.vocab.lookahead + 4 * bpe_stream.STEP_CHARS


def test_memory_of_pieces_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe_stream, "MEMO_BYTES", 2000)
    ours = bpe_stream.Tokenizer(bpe_stream.default_vocabulary())
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    assert ids_of(ours, text) == library.encode(text, add_special_tokens=False).ids
    assert sum(4 * len(k) + len(v) for k, v in ours.encoder.items()) <= 2000


@pytest.mark.parametrize("unit", ["a", "1", "=", " ", "漢", "a'", "'s", "x1"])
def test_long_texts_without_blanks(library, ours, monkeypatch, unit):
    monkeypatch.setattr(bpe_stream, "SPAN_CHARS", 50)
    text = unit * 700 + "'ll" + unit * 300
    assert ids_of(ours, text) == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, ours.encode(text))) <= 4 * 1100


def test_ids_cut_inside_a_character_decode(ours):
    data = b"".join(ours.encode("漢字😀"))
    parts = [data[k : k + 4] for k in range(0, len(data), 4)]
    assert "".join(ours.decode(iter(parts))) == "漢字😀"
    assert "".join(ours.decode(iter(parts[:1]))) == "�"


def test_rows(spark, library):
    texts = ["Hello  world", None, "", "naïve <|endoftext|> x" * 50, "Hello  world"]
    df = spark.createDataFrame([(k if k else None, t, "old", k) for k, t in enumerate(texts)], "doc_id long, text string, token_ids string, rank int")
    got = bpe_stream.encode_documents(df)
    assert got.columns == ["doc_id", "rank", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]
    short = {r["rank"]: r for r in bpe_stream.encode_documents(df.withColumnRenamed("rank", "doc"), digests_only=True).join(df.select("doc_id", "rank"), "doc_id").collect()}
    for r in got.collect():
        text = texts[r["rank"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if r["rank"]:
            assert short[r["rank"]].ids_sha256 == r.ids_sha256
    assert bpe_stream.encode_documents(df.limit(0)).collect() == []


def test_pieces_learnt_together_are_as_streamed(ours, library, monkeypatch):
    rng = random.Random(12)
    pieces = ["a", "é", " ", *{"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for alphabet in ("ab", " theringot", "éñß中🙂", "x01 .") for _ in range(300)}]
    data = [p.encode() for p in pieces]
    assert bpe_stream.merged_together(ours.vocab, data) == [bpe_stream.pack(bpe_stream.merged(ours.vocab, p)) for p in data]
    assert bpe_stream.merged_together(ours.vocab, []) == []

    monkeypatch.setattr(bpe_stream, "LEARN_CHARS", 500)
    monkeypatch.setattr(bpe_stream, "MEMO_BYTES", 2000)
    texts = ["", "the <|endoftext|> end", "word " * 20_000, "x" * 70_000, *(" ".join(rng.sample(pieces, 30)) for _ in range(40))]
    ours.encoder.clear()
    fed = []
    merged = bpe_stream.merged
    monkeypatch.setattr(bpe_stream, "merged", lambda v, p: fed.append(p) or merged(v, p))
    found = [b"".join(parts) for parts in ours.encode_all(texts)]
    assert found == [bpe_stream.pack(library.encode(t, add_special_tokens=False).ids) for t in texts]
    fed.clear()
    ours.encoder.clear()
    assert [b"".join(parts) for parts in ours.encode_all(["some short words", "and others"])] and not fed
