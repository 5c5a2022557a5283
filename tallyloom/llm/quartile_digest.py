"""Document fingerprints by quartile bucket digests.

All byte triplets of a sliding window of five bytes that include its last byte are hashed into 128 buckets. A digest
writes, for each bucket, in which quarter of the bucket counts its count lies (two bits), preceded by the logarithm of
the length and by the first two quartiles as shares of the third. Two digests are compared by a difference that is
bounded for each of its parts, so that their likeness is a number from 0 to 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.scratch import materialize, text_batches

BUCKETS = 128
#: Offsets before the last byte of a window of the two other bytes of its triplets.
_PAIRS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
_SALTS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)
#: Bytes counted at a time.
_STEP = 1 << 18
#: Greatest difference of the header (length, quartile shares) and of a bucket: 0, 1, 2 or, from end to end, 6.
_HEADER_MOST, _BUCKET = (24, 12, 12), np.array([0, 1, 2, 6])


def counts_of(data: bytes) -> np.ndarray:
    """How many triplets of the text fall into each bucket."""
    out, b = np.zeros(BUCKETS, np.int64), np.frombuffer(data, np.uint8)
    for at in range(4, len(b), _STEP):
        w = b[at - 4 : at + _STEP].astype(np.uint32)
        n = len(w) - 4
        last = w[4:] * np.uint32(0x2C1B3C6D)
        for salt, (j, k) in zip(_SALTS, _PAIRS, strict=True):
            h = (last ^ (w[4 - j : 4 - j + n] * np.uint32(0x297A2D39) + salt)) * np.uint32(0x85EBCA6B) + w[4 - k : 4 - k + n] * np.uint32(0x7FEB352D)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
            out += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return out


def fingerprint(data: bytes) -> str:
    """Hexadecimal digest: length code (2 digits), quartile shares (1 digit each), quarters of the buckets (64 digits).

    Depends on the bytes alone. Texts of under five bytes have no triplets, and so a digest of their length only.
    """
    counts = counts_of(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    quarters = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(8 * np.log2(1 + len(data))))
    shares = [15 * q // q3 if q3 else 0 for q in (q1, q2)]
    packed = (quarters.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    return f"{length:02x}{shares[0]:x}{shares[1]:x}{packed.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0 for the greatest difference."""
    parts = [abs(int(a[i:j], 16) - int(b[i:j], 16)) for i, j in ((0, 2), (2, 3), (3, 4))]
    header = sum(min(x, most) for x, most in zip(parts, _HEADER_MOST, strict=True))
    x, y = (np.frombuffer(bytes.fromhex(t[4:]), np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3 for t in (a, b))
    body = int(_BUCKET[np.abs(x.astype(np.int8) - y.astype(np.int8))].sum())
    return 1.0 - (header + body) / (sum(_HEADER_MOST) + 6 * BUCKETS)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col`` and fingerprint for each row; null texts count as empty. No shuffle."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint((t or "").encode()) for t in batch.column(1).to_pylist()], pa.string())], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _edited(text: str, after: str) -> str:
    """The last half of the characters replaced by as many from the start of the next text, or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_ROW = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and how near they and the next document's are.

    The next document is that of the next smaller id; after the last, the first. Rows of one id follow each other in the
    order of a hash of their texts, rows without an id come last; null texts are empty; a single row is next to itself.
    An empty table gives an empty table.

    The table is range-partitioned by descending id, so a task sees its rows in order and holds two of them. Each task's
    last row waits for the first of the next task; only these rows, two for each task, meet in one place.
    """
    text_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def row(i, text: str, mark: str, after: str, after_mark: str) -> tuple:
        edited = _edited(text, after).encode("utf-8")
        edited_mark = fingerprint(edited)
        return (i, len(text), hashlib.sha256(edited).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, after_mark))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edge", "part", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, id_kind = None, 0, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [id_kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            rows, id_kind = [], batch.schema.field(0).type
            for i, text, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                mark = fingerprint(text.encode())
                if held is None:
                    rows.append((i, None, None, None, None, None, None, "first", part, text))
                else:
                    rows.append((*row(*held, text, mark), None, part, None))
                held = (i, text, mark)
            if rows:
                yield out(rows)
        if held is not None:
            yield out([(held[0], None, None, None, None, None, None, "last", part, held[1])])

    ids = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    spread = ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    made = materialize(spread.mapInArrow(run, _ROW.format(id=id_type) + ", edge string, part int, text string"), "digest-rows")

    # Of a task's two edge rows, the first is what precedes, the last what waits; the ring closes from last to first.
    edges = made.where("edge IS NOT NULL").select("doc_id", "edge", "part", "text")
    firsts, lasts = edges.where("edge = 'first'"), edges.where("edge = 'last'")
    following = F.lead("part").over(Window.orderBy("part"))
    ring = firsts.select("part").withColumn("next", F.coalesce(following, F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    pairs = lasts.join(ring, "part").join(firsts.select(F.col("part").alias("next"), F.col("text").alias("after")), "next").select("doc_id", "text", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(i, t, fingerprint(t.encode()), a, fingerprint(a.encode())) for i, t, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names[:7])

    inner = made.where("edge IS NULL").select(*names[:7])
    return inner.unionByName(pairs.mapInArrow(close, _ROW.format(id=id_type))).withColumnRenamed("doc_id", id_col)
