"""Token-id output: documents packed into rows of fixed length by best-fit decreasing.

Each task encodes its documents and packs them block by block, a block being the documents of about ``block_tokens``
tokens. Within a block, pieces are placed from long to short into the row with the least room that still takes them;
a segment tree over capacities, which counts the open rows of each, finds that room in logarithmic time. Documents that
exceed a row are split into full rows and a rest, so no token is lost. There is no shuffle, and memory is bounded by a block.

``write_shards`` writes the rows as binary shards to any store that Spark can write, and then their index from what it
reads back. A shard is a run of records, each HEADER (big-endian), the id matrix's row, its position ids (u16), cumulative
segment lengths (u32), the segments' first tokens (u64), their documents (a JSON list of texts) and a line feed, which Spark's
text writer adds.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bpe_stream import default_vocabulary, tokenizer
from tallyloom.llm.scratch import text_batches

#: Tokens in a row, tokens that are packed together, and the id that fills a row's end.
LENGTH, BLOCK_TOKENS, PAD = 2048, 2_000_000, 0
#: Of a record: marker, task, block, row, ids in the row, bytes of an id, tokens, segments, bytes of the documents' list. Records in a shard at most.
HEADER, MARKER, SHARD_ROWS = ">4sIIIIIIII", b"PCK2", 1024


class CapacityTree:
    """How many open rows have each free capacity 0..most; ``fitting`` finds the least capacity of at least ``need``."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def fitting(self, need: int) -> int:
        """-1 if no open row has that much room."""
        node = need + self.size
        if self.count[node]:
            return need
        while node > 1:  # up to the first right sibling that holds a row, then down its left side
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows as lists of piece numbers, for pieces of 1..length tokens, longest first and in given order where equal."""
    tree, rooms, rows = CapacityTree(length), {}, []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        room = tree.fitting(sizes[k])
        if room < 0:
            rows.append([k])
            row, room = len(rows) - 1, length
        else:
            row = rooms[room].pop()
            rows[row].append(k)
            tree.add(room, -1)
        if left := room - sizes[k]:
            rooms.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


#: A packed row in a task: task, block, row, ids, segment ends from 0, documents, their first tokens.
Row = tuple[int, int, int, np.ndarray, list[int], list, list[int]]


def _packed(path: str, length: int, block_tokens: int, pad: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[list[Row]]]:
    """A function from batches (id, text) of a task to lists of its packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Row]]:
        from pyspark import TaskContext

        tok, task = tokenizer(path), TaskContext.get().partitionId()
        kind = np.dtype("<u2") if max(tok.vocab.bytes_of) < 1 << 16 else np.dtype("<u4")
        pieces: list[tuple] = []  # (document, its first token, ids)
        held, block = 0, 0

        def flush() -> Iterator[list[Row]]:
            nonlocal pieces, held, block
            rows = best_fit([len(p[2]) for p in pieces], length)
            for at in range(0, len(rows), 512):
                out: list[Row] = []
                for number, members in enumerate(rows[at : at + 512], at):
                    row, ends = np.full(length, pad, kind), [0]
                    for k in members:
                        ends.append(ends[-1] + len(pieces[k][2]))
                        row[ends[-2] : ends[-1]] = pieces[k][2]
                    out.append((task, block, number, row, ends, [pieces[k][0] for k in members], [pieces[k][1] for k in members]))
                yield out
            pieces, held, block = [], 0, block + 1

        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column(1))
            for i, parts in zip(batch.column(0).to_pylist(), tok.encode_all(texts), strict=True):
                start = 0
                rest = np.zeros(0, kind)
                for part in parts:
                    rest = np.concatenate([rest, np.frombuffer(part, "<u4").astype(kind)])
                    full = len(rest) // length * length
                    for at in range(0, full, length):
                        pieces.append((i, start, rest[at : at + length]))
                        start += length
                    held += full
                    rest = rest[full:]
                    if held >= block_tokens:
                        yield from flush()
                if len(rest):
                    pieces.append((i, start, rest))
                    held += len(rest)
                if held >= block_tokens:
                    yield from flush()
        if pieces:
            yield from flush()

    return run


def positions(ends: list[int], length: int) -> np.ndarray:
    """Position ids of a row of segments that end there: each starts again at 0; what fills the row has 0."""
    out, steps = np.zeros(length, "<u2"), np.arange(length, dtype="<u2")
    for a, b in zip(ends, ends[1:]):
        out[a:b] = steps[: b - a]
    return out


def _checked(length: int) -> None:
    if not 0 < length <= 1 << 16:
        raise ValueError("length must be from 1 to 65536")


SCHEMA = "task int, block int, row int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{id}>, doc_starts array<long>, n_tokens int, n_segments int"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS, pad: int = PAD) -> DataFrame:
    """A row of the packed matrix for each row: SCHEMA.

    ``ids`` and ``position_ids`` are ``length`` little-endian unsigned integers of 16 bits (ids of 32 where the
    vocabulary needs them); positions start again at 0 with each segment. ``cu_seqlens`` are the cumulative segment
    lengths from 0; the ids after its last are ``pad``, with position 0. ``doc_ids`` and ``doc_starts`` tell which document a
    segment is of and at which of its tokens it starts, so documents can be put together again.
    Null and empty texts have no tokens and so no segment. Null and repeated ids are segments like others. An empty table
    gives an empty table.
    """
    _checked(length)
    text_batches(docs.sparkSession)
    packed = _packed(path or default_vocabulary(), length, block_tokens, pad)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), None, pa.list_(pa.int64()), pa.int32(), pa.int32()]

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[6] = pa.list_(batch.schema.field(0).type)
                yield batch

        for rows in packed(seen(batches)):
            columns = zip(*[(task, block, row, ids.tobytes(), positions(ends, length).tobytes(), ends, of, starts, ends[-1], len(of)) for task, block, row, ids, ends, of, starts in rows], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, SCHEMA.format(id=id_type))


def write_shards(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS, pad: int = PAD) -> DataFrame:
    """Pack ``docs``, see ``pack``, into binary shards under ``to``/shards and their index, Parquet, under ``to``/index; returns the index.

    The index has for each packed row its shard, the offsets of its ids and of its position ids there, and the columns of
    ``read_shards`` other than these two, whose SHA-256 it holds as they were read back. Ids of documents come back in the type
    they had. Nulls, repeats and empty tables are as in ``pack``.
    """
    _checked(length)
    spark = docs.sparkSession
    text_batches(spark)
    packed = _packed(path or default_vocabulary(), length, block_tokens, pad)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in packed(batches):
            out = []
            for task, block, row, ids, ends, of, starts in rows:
                names = json.dumps(of).encode()
                head = struct.pack(HEADER, MARKER, task, block, row, length, ids.itemsize, ends[-1], len(of), len(names))
                out.append(head + ids.tobytes() + positions(ends, length).tobytes() + struct.pack(f"<{len(ends)}I", *ends) + struct.pack(f"<{len(starts)}Q", *starts) + names)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(records, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", SHARD_ROWS).option("lineSep", "\n").text(f"{to}/shards")
    found = read_shards(spark, f"{to}/shards", with_ids=False)
    found.withColumn("doc_ids", F.col("doc_ids").cast(f"array<{docs.schema[id_col].dataType.simpleString()}>")).write.parquet(f"{to}/index")
    return spark.read.parquet(f"{to}/index")


_READ = "shard string, offset long, positions_offset long, task int, block int, row int, cu_seqlens array<int>, doc_ids array<string>, doc_starts array<long>, n_tokens int, n_segments int, ids_sha256 string, positions_sha256 string"


def read_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """What the shards under ``path`` hold: their records' columns, the digests of ids and position ids and, if asked for, both as in ``pack``.

    Documents come back as texts. A task holds one shard at a time, SHARD_ROWS records at most. A damaged shard is an error.
    """
    text_batches(spark)
    names = [c.split()[0] for c in _READ.split(", ")] + ["ids", "position_ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, out = content.as_buffer(), 0, []
                while at < len(data):
                    marker, task, block, row, length, size, tokens, n, listed = struct.unpack_from(HEADER, data, at)
                    offset = at + struct.calcsize(HEADER)
                    second = offset + length * size
                    a = second + 2 * length
                    b = a + 4 * (n + 1)
                    c = b + 8 * n
                    if marker != MARKER or data[c + listed : c + listed + 1].to_pybytes() != b"\n":
                        raise ValueError(f"{shard}: no record at {at}")
                    ids, places, ends = data[offset:second], data[second:a], list(struct.unpack(f"<{n + 1}I", data[a:b]))
                    digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(places).hexdigest()
                    out.append((shard, offset, second, task, block, row, ends, json.loads(data[c : c + listed].to_pybytes()), list(struct.unpack(f"<{n}Q", data[b:c])), tokens, n, *digests, *((ids.to_pybytes(), places.to_pybytes()) if with_ids else ())))
                    at = c + listed + 1
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=False)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _READ + ", ids binary, position_ids binary" * with_ids)
