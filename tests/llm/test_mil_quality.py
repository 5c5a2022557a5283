import collections
import math
import re
import random
import zlib

import numpy as np

from tallyloom.llm import mil_quality as m


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    model, first = m.Model(3), np.array([0, 3, 4, 9])
    x, y, cost = rng.normal(size=(9, m.FEATURES)), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        s = model.forward(x, first)["score"][:, 0]
        return -(cost * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean()

    found = model.gradients(x, first, y, cost)
    for k, w in model.w.items():
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(6)]:
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-5 - found[k][at]) < 1e-6, k


def test_features_do_not_depend_on_neighbours():
    texts = [b"", b"Hello there, hello", b"x" * 2000, "é ".encode() * 400, b"  "]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, first = m.passage_features(data, offsets)
    assert np.diff(first).tolist() == [max(1, -(-len(t) // m.PASSAGE)) for t in texts]
    for k, t in enumerate(texts):
        alone, _ = m.passage_features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.array_equal(alone, x[first[k] : first[k + 1]])


def test_held_out_documents_and_odd_rows(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for k in range(500):
        good = rng.random() < 0.8
        text = [rng.choice(vocabulary) for _ in range(rng.choice([30, 200, 900]))]
        if not good:
            kind = rng.randrange(3)
            text = [w.upper() + "!!" for w in text] if kind == 0 else [text[0]] * len(text) if kind == 1 else [w + "%%" for w in text]
        docs.append((k, " ".join(text), "x", 0.5))
        labels.append((k, int(good), 0))
    docs += [(9000, None, None, None), (None, "abc", None, None), (9001, "", None, None), (3, docs[3][1], None, None)]
    labels += [(None, 1, 1), (9000, 1, 0), (9001, None, 0), (77, 1, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, label string, score double").repartition(4)
    got = m.grade(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    right = n = 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id < 500:
            right, n = right + (r.predicted == labels[r.doc_id][1]), n + 1
    assert n > 60 and right / n > 0.95


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in m.grade(d, none).collect()] == [0.5]
    assert m.grade(d.limit(0), none).collect() == []


def test_the_sample_has_all_passages_and_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(m, "fit", lambda bags, labels: seen.append(sorted(len(b) for b in bags)))
    ids = [k for k in range(20) if zlib.crc32(str(k).encode()) % 5][:3]
    long, short = "some words " * 5000, "some words " * 100
    docs = spark.createDataFrame([(ids[0], long), (ids[1], short), (ids[2], short), (ids[1], short)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in [*ids, ids[1]]], "doc_id long, quality int")
    for bound in ({}, {"passages": 10}, {"sample": 1}):
        m.learn(docs, labels, **bound)
    size = lambda t: -(-len(t) // m.PASSAGE)
    assert seen[0] == [size(short), size(short), size(long)] and seen[1] == [size(short)] * 2 and len(seen[2]) == 1


def plain_features(text):
    """The features of one passage, counted by plain loops."""
    data, out = text, [0.0] * m.FEATURES
    for b in data:
        out[b if b < 128 else 128 if b >= 192 else 129] += 1
    out[:130] = [math.sqrt(c / max(1, len(data))) for c in out[:130]]
    parts = re.findall(rb"[^\x20\x09-\x0d]+", data)
    if parts:
        counts = collections.Counter(p.lower() for p in parts)
        plain = re.compile(rb"[0-9A-Za-z\x80-\xff]")
        out[130:] = [len(counts) / len(parts), max(counts.values()) / len(parts), sum(65 <= p[0] <= 90 for p in parts) / len(parts), sum(not plain.fullmatch(p[-1:]) for p in parts) / len(parts), math.log1p(sum(map(len, parts)) / len(parts)), math.log1p(len(parts))]
    return out


def logistic(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def plain_score(model, bag):
    """The forward pass with scalars: encode every passage, weigh, sum, score."""
    w, hidden, logits = model.w, [], []
    for x in bag:
        z = [(v - a) / d for v, a, d in zip(x, model.mean, model.dev)]
        h = [max(0.0, sum(z[i] * w["e"][i][j] for i in range(len(z))) + w["eb"][0][j]) for j in range(m.HIDDEN)]
        gate = [math.tanh(sum(h[i] * w["v"][i][j] for i in range(m.HIDDEN))) * logistic(sum(h[i] * w["u"][i][j] for i in range(m.HIDDEN))) for j in range(m.ATTENTION)]
        hidden.append(h)
        logits.append(sum(g * w["a"][j][0] for j, g in enumerate(gate)))
    most = max(logits)
    weights = [math.exp(s - most) for s in logits]
    z = [sum(a * h[j] for a, h in zip(weights, hidden)) / sum(weights) for j in range(m.HIDDEN)]
    return logistic(sum(z[j] * w["c"][j][0] for j in range(m.HIDDEN)) + w["cb"][0][0])


def test_scores_against_plain_loops(spark):
    rng = random.Random(5)
    texts = ["", None, "One two, two THREE!", " \t ", "é漢 word" * 20] + [" ".join("".join(rng.choice("abcdXYZ.,!1é ") for _ in range(9)) for _ in range(rng.choice([3, 70, 200]))) for _ in range(12)] + ["long text. " * 2000]
    # Passages are cut between bytes, words at their edges.
    bags = [[plain_features((t or "").encode()[a : a + m.PASSAGE]) for a in range(0, max(1, len((t or "").encode())), m.PASSAGE)] for t in texts]
    data = [(t or "").encode() for t in texts]
    x, first = m.passage_features(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in data])]))
    model = m.fit([x[a:b] for a, b in zip(first, first[1:])], [k % 2 for k in range(len(texts))])
    whole = [k for k, b in enumerate(bags) if len(b) == 1]
    for k in whole:
        assert np.allclose(x[first[k]], bags[k][0], atol=1e-5), texts[k]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in m.score(df, model).collect()}
    for k in range(len(texts)):
        assert abs(got[k] - plain_score(model, x[first[k] : first[k + 1]].tolist())) < 1e-6, k
