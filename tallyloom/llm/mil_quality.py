"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Every passage is encoded from its byte and word statistics by a
hidden layer; a gated attention, learnt from document labels alone, weighs the encodings; the weighted sum is scored by a
logistic layer. The model is fitted on the driver on a sample of bounded size and applied to all passages of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import words
from tallyloom.llm.hd_language import held_out
from tallyloom.llm.scratch import text_batches

#: Bytes in a passage; labelled documents at most, and passages of all of them together at most, that the model is fitted on.
PASSAGE, SAMPLE, SAMPLE_PASSAGES = 512, 6000, 100_000
#: Sizes of the encoding and of the attention; passes over the sample.
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE = 32, 16, 30, 128, 0.01
#: Bytes 0-127 by value, lead bytes of longer characters as one, continuation bytes as one; then word statistics.
_CLASSES, _STATS = 130, 6
FEATURES = _CLASSES + _STATS


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages in order, and each row's first passage (one more than rows). An empty row has one passage of zeros."""
    sizes = np.diff(offsets)
    per_row = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per_row)])
    n = int(first[-1])
    out = np.zeros((n, FEATURES), np.float32)
    if not len(data):
        return out, first
    row = np.repeat(np.arange(len(sizes)), sizes)
    passage = first[row] + (np.arange(len(data)) - offsets[row]) // PASSAGE
    kind = np.where(data < 128, data, np.where(data >= 192, 128, 129)).astype(np.int64)
    counts = np.bincount(passage * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES)
    total = np.maximum(1, counts.sum(1))
    out[:, :_CLASSES] = np.sqrt(counts / total[:, None])
    hashes, _, starts, ends = words.word_hashes(data, offsets)
    if len(hashes):
        of = passage[starts]
        found = np.bincount(of, minlength=n)
        number = np.maximum(1, found)
        order = np.lexsort((hashes, of))
        new = np.ones(len(order), bool)
        new[1:] = (of[order][1:] != of[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        distinct = np.bincount(of[order][new], minlength=n)
        runs = np.diff(np.append(np.flatnonzero(new), len(order)))
        most = np.zeros(n)
        np.maximum.at(most, of[order][new], runs)
        upper = (data[starts] >= 65) & (data[starts] <= 90)
        last = data[ends - 1]
        odd = ~(((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | ((last >= 48) & (last <= 57)) | (last >= 128))
        length = np.bincount(of, weights=ends - starts, minlength=n) / number
        out[:, _CLASSES:] = np.stack([distinct / number, most / number, np.bincount(of, weights=upper, minlength=n) / number, np.bincount(of, weights=odd, minlength=n) / number, np.log1p(length), np.log1p(found)], 1)
    return out, first


class Model:
    """Weights of encoder, gated attention and scorer, with the means and deviations that features are scaled by."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.dev = np.zeros(FEATURES), np.ones(FEATURES)
        self.w = {k: rng.normal(0, 1 / np.sqrt(a), (a, b)) for k, a, b in (("e", FEATURES, HIDDEN), ("v", HIDDEN, ATTENTION), ("u", HIDDEN, ATTENTION), ("a", ATTENTION, 1), ("c", HIDDEN, 1))}
        self.w |= {"eb": np.zeros((1, HIDDEN)), "cb": np.zeros((1, 1))}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """All steps for scaled passages ``x`` whose bags start at ``first``."""
        w, starts, sizes = self.w, first[:-1], np.diff(first)
        h = np.maximum(0, x @ w["e"] + w["eb"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-np.clip(h @ w["u"], -30, 30)))
        s = (t * g) @ w["a"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes, 0))
        weight = s / np.repeat(np.add.reduceat(s, starts), sizes, 0)
        z = np.add.reduceat(weight * h, starts)
        return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["cb"], -30, 30)))}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, each bag weighted by ``cost``."""
        w, f, sizes = self.w, self.forward(x, first), np.diff(first)
        d = (f["score"] - y[:, None]) * cost[:, None] / len(y)
        dz = np.repeat(d @ w["c"].T, sizes, 0)
        dweight = (dz * f["h"]).sum(1, keepdims=True)
        mean = np.repeat(np.add.reduceat(f["weight"] * dweight, first[:-1]), sizes, 0)
        ds = f["weight"] * (dweight - mean)
        dt, dg = ds @ w["a"].T * f["g"] * (1 - f["t"] ** 2), ds @ w["a"].T * f["t"] * f["g"] * (1 - f["g"])
        dh = (dz * f["weight"] + dt @ w["v"].T + dg @ w["u"].T) * (f["h"] > 0)
        return {"e": x.T @ dh, "eb": dh.sum(0, keepdims=True), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ d, "cb": d.sum(0, keepdims=True)}

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.dev, first)["score"][:, 0]


def fit(bags: list[np.ndarray], labels: list[int], seed: int = 7) -> Model:
    """A model from bags of passage features and their labels 0 or 1, by Adam; the same for the same input."""
    model, rng = Model(seed), np.random.default_rng(seed)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the score is that label, or a half
        model.w["c"][:] = 0
        model.w["cb"][:] = 0 if not len(y) else (4 if y[0] else -4)
        return model
    whole = np.concatenate(bags).astype(float)
    model.mean, model.dev = whole.mean(0), whole.std(0) + 1e-3
    scaled = [(b - model.mean) / model.dev for b in bags]
    moments, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            part, step = order[at : at + BATCH], step + 1
            first = np.concatenate([[0], np.cumsum([len(scaled[k]) for k in part])])
            found = model.gradients(np.concatenate([scaled[k] for k in part]), first, y[part], np.ones(len(part)))
            for k, g in found.items():
                m, v = moments[k]
                m += 0.1 * (g + 1e-4 * model.w[k] - m)
                v += 0.001 * (g * g - v)
                model.w[k] -= RATE * 0.9**epoch * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to (label, features of all passages as bytes)."""
    for batch in batches:
        data, offsets = words.text_buffers(batch.column(0))
        out = []
        for a, b in words.chunks(offsets):
            x, first = passage_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out += [x[lo:hi].tobytes() for lo, hi in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], ["label", "x"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> Model:
    """A model of ``labels.quality`` from labelled documents, none of them held out, with all of their passages.

    Documents are taken in the order of a hash of their ids, ``sample`` of them at most; one that would bring more than
    ``passages`` passages together is passed over. These two bound what reaches the driver. Null ids, texts and labels are
    left out; equal labels of a document count once, different ones once each, as do rows that repeat a document.
    """
    text_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")
    chosen = known.orderBy(*order).limit(sample)
    mark = F.xxhash64("text").alias("mark")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", mark, "text")
    # The chosen labels are ``sample`` rows of two numbers; so are the sizes that come back, with a hash of the text.
    sizes = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "mark", F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).alias("n")).distinct()
    taken, total = [], 0
    for r in sizes.orderBy(*order, "mark").limit(sample).collect():
        if total + r["n"] <= passages:
            total += r["n"]
            taken.append((r["doc_id"], r["label"], r["mark"]))
    if not taken:
        return fit([], [])
    wanted = docs.sparkSession.createDataFrame(taken, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, mark long")
    rows = texts.join(F.broadcast(wanted), ["doc_id", "mark"]).groupBy("doc_id", "mark", "label").agg(F.first("text").alias("text")).select("text", "label")
    found = sorted((r["label"], bytes(r["x"])) for r in rows.mapInArrow(_bags, "label int, x binary").collect())
    return fit([np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, x in found], [label for label, _ in found])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Columns ``id_col``, held_out, score and predicted for each row, from all passages of its text alone.

    Null and empty texts are scored as a passage without bytes. Null and repeated ids are kept as they are. No shuffle.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.text_buffers(batch.column(2))
            scores = [np.zeros(0)]
            for a, b in words.chunks(offsets):
                scores.append(model.scores(*passage_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
            s = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from ``labels`` and score all of ``docs``: doc_id, held_out, score, predicted."""
    return score(docs, learn(docs, labels))
