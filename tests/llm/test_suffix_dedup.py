import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import suffix_dedup, suffix_groups


def test_suffix_arrays_like_sorting():
    rng = random.Random(1)
    for k in range(1500):
        strings = [bytes(rng.choice(b"ab\x00" if k % 2 else b"abcdef\xff") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 5))]
        order, starts = suffix_groups.suffix_array(strings)
        wanted = sorted((s[i:], n, i) for n, s in enumerate(strings) for i in range(len(s)))
        assert [int(starts[n] + i) for _, n, i in wanted] == order.tolist()


def brute(rows, length):
    """Figures of each row by looking at every string of ``length`` bytes in order."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        data, gone = (text or "").encode(), set()
        for s in range(len(data) - length + 1):
            part = data[s : s + length]
            if part in seen:
                gone.update(range(s, s + length))
            seen.add(part)
        rest = bytes(b for k, b in enumerate(data) if k not in gone)
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((i, len(data), len(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("etaoiné") for _ in range(rng.randrange(1, 7))) for _ in range(80)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, rows = [line(60) for _ in range(6)], []
    for _ in range(60):
        parts = [rng.choice([line(rng.randrange(30)), rng.choice(base), rng.choice(base)[rng.randrange(90) :], "ab" * rng.randrange(120), "x" * rng.randrange(150)]) for _ in range(rng.randrange(5))]
        text = list("".join(parts))
        for _ in range(rng.choice([0, 0, 1, 3])):
            if text:
                text[rng.randrange(len(text))] = rng.choice("éz")
        rows.append((len(rows) * 13 % 997, "".join(text)))
    return rows + [(2000, None), (2001, ""), (2002, rows[3][1]), (2003, "y" * 99), (2004, "y" * 99), (2005, "y" * 101)]


@pytest.mark.parametrize(("seed", "many", "block"), [(1, 1000, 1 << 18), (2, 2, 300)])
def test_against_every_string(spark, monkeypatch, seed, many, block):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, v int").repartition(5)
    got = suffix_dedup.cut_repeats(df)
    assert sorted(tuple(r) for r in got.drop("kept").collect()) == brute(rows, 100)
    for r in got.collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_odd_rows(spark):
    a, b = "".join(chr(97 + k % 23) for k in range(150)), "q" * 30 + "é" * 100
    df = spark.createDataFrame([(None, a, 1), (4, a, 2), (4, a, 3), (4, b, 4), (9, "zz" + a, 5), (None, None, 6)], "doc_id long, text string, n_chars long")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.cut_repeats(df).collect()), key=str)
    # b repeats itself: é is two bytes, so strings of 100 bytes recur every two bytes.
    assert got == sorted([(None, 150, 0), (4, 150, 127), (4, 150, 127), (4, 230, 198), (9, 152, 150), (None, 0, 0)], key=str)
    kept = suffix_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=str) == sorted([(None, a, 150), (4, a[:23], 23), (4, a[:23], 23), (4, "q" * 30 + "é", 31), (9, "zz", 2), (None, None, None)], key=str)
    assert suffix_dedup.cut_repeats(df.limit(0)).collect() == [] and suffix_dedup.deduplicate(df.limit(0)).collect() == []


def test_equal_pieces_are_settled_before_the_shuffle():
    text = "".join(random.Random(4).choices("abcdefghij", k=250))
    g, _, start, count, own = (c.tolist() for c in suffix_dedup.strands(np.frombuffer(text.encode(), np.uint8)))
    wanted = [{"mark": int(suffix_dedup._mark(0, s, o - s, c)), "g": int(np.uint64(k).view(np.int64)), "many": True} for k, s, c, o in zip(g, start, count, own)]
    kind = pa.list_(pa.struct([("mark", pa.int64()), ("g", pa.int64()), ("many", pa.bool_())]))
    batches = [pa.RecordBatch.from_arrays([pa.array([i, i]), pa.array([text] * 2), pa.array([wanted] * 2, kind)], ["id", "text", "wanted"]) for i in (9, 3, 5)]
    out = [r for b in suffix_dedup._fetch(iter(batches)) for r in b.to_pylist()]
    assert {r["id"] for r in out if r["body"] is not None} == {3}
    kept, gone = ({(r["id"], r["mark"]) for r in out if (r["body"] is None) == none} for none in (False, True))
    assert gone == {(i, m) for i in (5, 9) for _, m in kept}
    ranges = [r for b in suffix_dedup._resolve(iter([pa.RecordBatch.from_pylist(sorted(out, key=lambda r: r["key"]), schema=pa.schema([("key", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("body", pa.binary())]))])) for r in b.to_pylist()]
    assert {i: {b for r in ranges if r["id"] == i for b in range(r["lo"], r["hi"])} for i in (3, 5, 9)} == {3: set(), 5: {*range(len(text))}, 9: {*range(len(text))}}


def test_contracted_windows_are_equal_where_their_bytes_are():
    length, most = suffix_dedup.LENGTH, suffix_dedup.PIECE
    rng = random.Random(9)
    base = bytes(rng.choice(b"etaoin ") for _ in range(400))
    texts = [base[rng.randrange(120) : 400 - rng.randrange(120)] for _ in range(20)] + [b"ab" * 80, b"x" * 150]
    for k in range(0, 20, 3):
        at = rng.randrange(len(texts[k]))
        texts[k] = texts[k][:at] + b"z" + texts[k][at + 1 :]
    g, bodies, lead = [], [], []
    for text in texts:
        h, _, start, count, own = suffix_dedup.strands(np.frombuffer(text, np.uint8))
        g += h.view(np.int64).tolist()
        bodies += [text[s : s + c + length - 1] for s, c in zip(start, count)]
        lead += (own - start).tolist()
    data, bounds = np.frombuffer(b"".join(bodies), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    _, of, lo, n, core = suffix_dedup._cut(np.array(g), data, bounds, np.array(lead))
    assert n.sum() == sum(len(b) - length + 1 for b in bodies)
    begin = bounds[of] + lo
    symbols = suffix_dedup._contracted(data, begin, bounds[of] + core, n)
    # 2 * PIECE - 1 symbols for a piece at most, where it has LENGTH + PIECE - 1 bytes.
    assert len(symbols) == (n + most - 1).sum()
    first = np.cumsum(n + most - 1) - (n + most - 1)
    pairs = {(bytes(data[b + k : b + k + length]), tuple(symbols[f + k : f + k + most].tolist())) for b, f, c in zip(begin.tolist(), first.tolist(), n.tolist()) for k in range(c)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 300
    piece, at, run = suffix_groups.symbol_runs(symbols, n + most - 1, most)
    assert sorted(zip(piece.tolist(), at.tolist())) == [(p, k) for p, c in enumerate(n.tolist()) for k in range(c)]
    assert len({(r, bytes(data[begin[p] + a : begin[p] + a + length])) for p, a, r in zip(piece.tolist(), at.tolist(), run.tolist())}) == run.max() + 1 == len(pairs)
