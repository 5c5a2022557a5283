import hashlib
import math
import random

from tallyloom.llm import quartile_digest as q


def plain_digest(data):
    """The digest by plain loops over windows and triplets, in integers of 32 bits."""
    most, counts = (1 << 32) - 1, [0] * 128
    salts = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D]
    for end in range(4, len(data)):
        for salt, (j, k) in zip(salts, [(1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4)]):
            h = data[end] * 0x2C1B3C6D & most ^ data[end - j] * 0x297A2D39 + salt & most
            h = h * 0x85EBCA6B + data[end - k] * 0x7FEB352D & most
            h = (h ^ h >> 15) * 0x846CA68B & most
            counts[h >> 25] += 1
    ordered = sorted(counts)
    q1, q2, q3 = ordered[31], ordered[63], ordered[95]
    digits = [sum(c > q for q in (q1, q2, q3)) for c in counts]
    body = "".join(f"{a * 64 + b * 16 + c * 4 + d:02x}" for a, b, c, d in zip(*[iter(digits)] * 4))
    return f"{min(255, round(8 * math.log2(1 + len(data)))):02x}" + "".join(f"{15 * q // q3 if q3 else 0:x}" for q in (q1, q2)) + body


def plain_likeness(a, b):
    """One less the bounded differences of the parts, in shares of the greatest: length, quartile shares, buckets."""
    lost = min(24, abs(int(a[:2], 16) - int(b[:2], 16))) + sum(min(12, abs(int(a[k], 16) - int(b[k], 16))) for k in (2, 3))
    for x, y in zip(a[4:], b[4:]):
        for shift in (2, 0):
            lost += {0: 0, 1: 1, 2: 2, 3: 6}[abs((int(x, 16) >> shift & 3) - (int(y, 16) >> shift & 3))]
    return 1 - lost / (24 + 12 + 12 + 6 * 128)


def test_digests_against_plain_loops():
    rng = random.Random(9)
    texts = [b"", b"abcd", b"abcde"] + [bytes(rng.choice(b"etaoin shr\xc3\xa9") for _ in range(rng.choice([5, 40, 900, 5000]))) for _ in range(30)]
    digests = [q.fingerprint(t) for t in texts]
    assert digests == [plain_digest(t) for t in texts]
    for a in digests:
        for b in digests[:12]:
            assert abs(q.likeness(a, b) - plain_likeness(a, b)) < 1e-12


def test_rows_against_a_plain_loop(spark):
    rng = random.Random(8)
    rows = [(k * 3, "".join(rng.choice("abc déf漢 ") for _ in range(rng.choice([0, 1, 2, 5, 300])))) for k in range(90)]
    rows += [(1000, None), (1001, "x" * 5000), (1001, "y"), (None, "z z z z z")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, part string, edge int").repartition(7)
    got = {}
    for r in q.compare_with_edits(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    single = sorted((r for r in rows if r[0] is not None and r[0] < 1000), reverse=True)
    for (i, text), (_, after) in zip(single, single[1:]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        (r,) = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_digest(text.encode()), plain_digest(edited.encode()))
        assert abs(r.near_edited - plain_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - plain_likeness(r.fingerprint, plain_digest(after.encode()))) < 1e-12
    # The row without an id is last, so the first, one of 1001, follows it.
    (r,) = got[None]
    assert r.edited_sha256 in {hashlib.sha256(("z z z" + a[:4]).encode()).hexdigest() for a in ("x" * 5000, "y")}


def test_single_row_and_empty_table(spark):
    df = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    (r,) = q.compare_with_edits(df).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0
    assert q.compare_with_edits(df.limit(0)).collect() == []


def test_likeness():
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    base = [rng.choice(words) for _ in range(800)]
    near = list(base)
    for k in range(20):
        near[rng.randrange(800)] = rng.choice(words)
    other = ["".join(rng.choice("xyzqwk0123") for _ in range(6)) for _ in range(800)]
    a, b, c = (q.fingerprint(" ".join(t).encode()) for t in (base, near, other))
    assert q.likeness(a, a) == 1.0 and q.likeness(a, b) == q.likeness(b, a)
    assert q.likeness(a, b) > 0.9 > q.likeness(a, c) >= 0
    ends = "ff" + "00" + "00" * 32, "00" + "ff" + "ff" * 32
    assert q.likeness(*ends) == 0.0
    assert q.fingerprint(b"") == "00" * 2 + "00" * 32
    data = bytes(rng.randrange(256) for _ in range(10_000))
    old, q._STEP = q._STEP, 777
    try:
        assert q.fingerprint(data) == (lambda: (setattr(q, "_STEP", old), q.fingerprint(data))[1])()
    finally:
        q._STEP = old
