"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +-1 that follows from its code point. A letter trigram is the product of its
letters' vectors, permuted by two, one and no places; a document is the sum of its trigrams' vectors, a language the
sum of its documents' unit vectors, and a document gets the language whose prototype has the largest cosine with it.
Runs of other characters count as one word boundary. Prototypes are learnt from all labelled documents: each task sums
its documents into one vector for each language, in whole numbers, so that the result does not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scratch import text_batches
from tallyloom.llm.words import constants

#: Length of the vectors; characters handled at a time; the language of texts without letters.
DIM, SPAN_CHARS, NONE = 1024, 1 << 19, "und"
#: Least cosine of a text in a learnt language: two standard deviations of the cosine of unrelated vectors of length DIM.
MIN_SCORE = 2 / DIM**0.5
_UNIT = 1 << 24


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(4096)
def _letter(code: int, dim: int) -> np.ndarray:
    """The vector of a letter; of the word boundary for code 0."""
    bits = np.unpackbits(constants(2 * dim // 64, 1_000_003 * (code + 1)).view(np.uint8).reshape(-1, 8)[:, 4:].reshape(-1))
    return bits[:dim].astype(np.int8) * 2 - 1


def _sequence(text: str) -> np.ndarray:
    """Lower-cased letters with a 0 for each run of other characters and at both ends; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return codes[:0]
    codes = np.where(letter, codes, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    inner = codes[keep]
    return np.concatenate([[0] * int(inner[0] != 0), inner, [0] * int(inner[-1] != 0)]).astype(np.uint32)


def document_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """A row of ``dim`` sums for each text; zeros for a text without letters."""
    sequences = [_sequence(t) for t in texts]
    sizes = np.array([max(0, len(s) - 2) for s in sequences])
    out = np.zeros((len(texts), dim), np.float32)
    if not sizes.sum():
        return out
    kept = [s for s in sequences if len(s) > 2]
    symbols = np.unique(np.concatenate([np.unique(s) for s in kept]))
    p = len(symbols)
    place = np.zeros(int(symbols[-1]) + 1, np.int64)
    place[symbols] = np.arange(p)
    grams = np.concatenate([(place[s[:-2]] * p + place[s[1:-1]]) * p + place[s[2:]] for s in kept])
    doc = np.repeat(np.arange(len(texts)), sizes)
    if p**3 <= 1 << 22:
        seen = np.flatnonzero(np.bincount(grams, minlength=p**3))
        index = np.zeros(p**3, np.int64)
        index[seen] = np.arange(len(seen))
        index = index[grams]
    else:
        seen, index = np.unique(grams, return_inverse=True)
    letters = np.stack([_letter(int(c), dim) for c in symbols])
    twice, once = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    for at in range(0, len(seen), 4096):  # a block of distinct trigrams at a time
        block = seen[at : at + 4096]
        vectors = (twice[block // p // p] * once[block // p % p] * letters[block % p]).astype(np.float32)
        here = (index >= at) & (index < at + len(block)) if len(seen) > 4096 else slice(None)
        counts = np.bincount(doc[here] * len(block) + index[here] - at, minlength=len(texts) * len(block))
        out += counts.reshape(len(texts), -1).astype(np.float32) @ vectors
    return out


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Start and texts of runs of rows with about SPAN_CHARS characters and 128 rows at most; null is empty."""
    start, run, size = 0, [], 0
    for k, text in enumerate(texts.to_pylist()):
        run.append(text or "")
        size += len(run[-1])
        if size >= SPAN_CHARS or len(run) >= 128:
            yield start, run
            start, run, size = k + 1, [], 0
    if run:
        yield start, run


def _units(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1, keepdims=True))
    return vectors / np.where(length > 0, length, 1)


def held_out(id_col: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves no remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, one unit vector of ``dim`` each, from all rows with text and language.

    What reaches the driver is one vector for each language.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for at, texts in _groups(batch.column(0)):
                whole = np.rint(_units(document_vectors(texts, dim)) * _UNIT).astype(np.int64)
                for lang in set(langs[at : at + len(texts)]):
                    sums[lang] = sums.get(lang, 0) + whole[langs[at : at + len(texts)] == lang].sum(0)
        if sums:
            values = pa.array(np.concatenate(list(sums.values())))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.ListArray.from_arrays(np.arange(len(sums) + 1, dtype=np.int32) * dim, values)], ["lang", "v"])

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    parts = rows.mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("k", "x"))
    summed = parts.groupBy("lang", "k").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v"))
    found = sorted((r["lang"], [x["x"] for x in r["v"]]) for r in summed.collect())
    vectors = np.array([v for _, v in found], np.float64).reshape(len(found), dim)
    full = np.abs(vectors).sum(1) > 0
    return [lang for (lang, _), f in zip(found, full, strict=True) if f], _units(vectors[full]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (cosine, 0 to 1), which replace columns of these names.

    Null texts and texts without a letter, and all texts if no language was learnt, are "und" with score 0. Of languages
    of equal cosine the first in order of their names is taken. Every row stays, with its id, null or repeated as it may be. No shuffle.
    """
    text_batches(docs.sparkSession)
    langs, prototypes = model
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    dim = prototypes.shape[1] if len(langs) else DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, texts in _groups(batch.column(len(keep))):
                vectors = document_vectors(texts, dim) if langs else np.zeros((len(texts), dim), np.float32)
                alike = _units(vectors) @ prototypes.T if langs else np.zeros((len(texts), 1))
                for best, row, some in zip(alike.argmax(1), alike, np.abs(vectors).sum(1) > 0, strict=True):
                    names.append(langs[best] if some else NONE)
                    scores.append(float(min(1.0, max(0.0, row[best]))) if some else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text")).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of ``documents``: learnt from the rows that are not held out, applied to all."""
    rows = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = learn(rows.where("NOT held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those that are in no learnt language: that have no letter, or whose best prototype's cosine is less
    than ``min_score``; columns as they are.

    Null and empty texts have no letter. If no language was learnt, every text with a letter stays. Repeated and null ids
    are judged row by row; columns may have any names.
    """
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    if not model[0]:
        model, min_score = (["any"], np.zeros((1, DIM), np.float32)), 0.0
    found = predict(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}), model, "in_text")
    return found.where((F.col("lang_pred") != NONE) & (F.col("score") >= min_score)).select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])
