"""Benchmark decontamination by spaced-seed hashing.

A mask of ones and zeros laid over a run of tokens hashes the tokens under its ones and ignores those under its zeros,
so that a passage with substituted words still shares seeds with its source. Seeds of the benchmark are a table; seeds of
the corpus that may be among them (a bit table of fixed size says so) are joined with it by hash. Every hit fixes a
document, an item and how they lie against each other; the overlap around it is then verified token by token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import words
from tallyloom.llm.hot import spread_join
from tallyloom.llm.scratch import materialize, text_batches

#: Ones are compared, zeros ignored, by the least number of tokens of an item. However 4 of 20 tokens, 3 of 15, 2 of 10 or 1 of 5
#: are substituted, one of that row's masks finds a place (tests try all ways); shorter items must agree in full.
MASKS = {15: ("1111001", "110001011"), 10: ("11101", "110011"), 5: ("1101", "1011"), 4: ("1101",), 3: ("101",), 2: ("11",), 1: ("1",)}
ALL_MASKS = tuple(dict.fromkeys(m for row in MASKS.values() for m in row))
#: A window of so many tokens (all, if an item has fewer) must agree in this percentage of its places; those beyond an edge differ.
WINDOW, PERCENT = 20, 80
#: Bits of the table of benchmark seeds: 2 MB, however many items there are. Items that are verified beside one copy of a document.
TABLE_BITS, ITEMS = 24, 64


def _seeds(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of mask k at every start of a row's token run that holds it, and whether each start is one."""
    ones = [j for j, c in enumerate(ALL_MASKS[k]) if c == "1"]
    span, n = len(ALL_MASKS[k]), len(hashes)
    out = np.zeros(max(0, n - span + 1), np.uint64)
    for c, j in zip(words.constants(len(ones), 101 + k), ones, strict=True):
        out += hashes[j : j + len(out)] * c
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return words.mix64(out), row[: len(out)] == row[n - len(out) :] if len(out) else np.zeros(0, bool)


def _uses(sizes: np.ndarray, k: int) -> np.ndarray:
    """Whether items of these numbers of tokens are found by mask k."""
    least = sorted(MASKS)
    at = np.searchsorted(least, sizes, "right") - 1
    return np.array([ALL_MASKS[k] in MASKS[n] for n in least])[at] & (at >= 0)


def _seed_rows(table: np.ndarray | None, masks: list[int]):
    """A function for mapInArrow over (id, text): rows (id, seed, at, mask) of seeds whose bit is set; without a table, of all
    seeds of the masks that find an item of this length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(table).view(bool) if table is not None else None
        for batch in batches:
            data, offsets = words.text_buffers(batch.column(1))
            for a, b in words.chunks(offsets):
                hashes, first, _, _ = words.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row = np.repeat(np.arange(b - a), np.diff(first))
                seeds, rows, starts, kinds = ([np.zeros(0, t)] for t in (np.uint64, np.int64, np.int64, np.int32))
                for k in masks:
                    found, inside = _seeds(hashes, first, k)
                    if bits is not None:
                        inside &= bits[(found >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
                    else:
                        inside &= _uses(np.diff(first), k)[row[: len(inside)]]
                    at = np.flatnonzero(inside)
                    seeds.append(found[at])
                    rows.append(row[at])
                    starts.append(at - first[row[at]])
                    kinds.append(np.full(len(at), k, np.int32))
                of = pa.array(np.concatenate(rows) + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(np.concatenate(seeds).view(np.int64)), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(kinds))], ["id", "seed", "at", "mask"])

    return run


def _bit_table(seeds: DataFrame) -> np.ndarray:
    """The packed bits of the seeds' leading TABLE_BITS bits, or-ed by word on the executors: 2**TABLE_BITS bits at most."""
    place = seeds.select(F.shiftrightunsigned("seed", 64 - TABLE_BITS).alias("p"))
    packed = place.groupBy(F.expr("CAST(p DIV 32 AS INT) AS w")).agg(F.expr("bit_or(shiftleft(1L, CAST(31 - p % 32 AS INT))) AS b"))
    table = np.zeros(1 << (TABLE_BITS - 5), ">u4")
    found = packed.toArrow()
    table[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return table.view(np.uint8)


def best_run(d: np.ndarray, q: np.ndarray, shifts: list[int]) -> tuple[int, int, int, int] | None:
    """Of the runs of a document's tokens ``d`` and an item's ``q`` at any of the shifts (of the item's first token in the
    document), the one with most agreeing tokens, then the earliest in the item, then in the document: doc_start, item_start, n_tokens, n_same.

    A run is what windows that pass cover without a break, from its first agreeing token to its last.
    """
    window, best = min(WINDOW, len(q)), None
    for shift in shifts:
        lo, hi = max(0, -shift), min(len(q), len(d) - shift)
        same = d[lo + shift : hi + shift] == q[lo:hi]
        inside = min(window, len(same))  # places of the window beyond an edge of the document or the item differ
        sums = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(100 * (sums[inside:] - sums[: len(sums) - inside]) >= PERCENT * window)
        agreeing = np.flatnonzero(same)
        for part in np.split(good, np.flatnonzero(np.diff(good) > inside) + 1) if len(good) else ():
            start, end = (int(agreeing[k]) for k in (np.searchsorted(agreeing, part[0]), np.searchsorted(agreeing, part[-1] + inside) - 1))
            found = (int(sums[end + 1] - sums[start]), -(lo + start), -(lo + shift + start), end + 1 - start)
            best = max(best, found) if best else found
    return (-best[2], -best[1], best[3], best[0]) if best else None


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, items (key, item, shifts)) to the best runs of each document and item, if any."""
    for batch in batches:
        out = []
        for i, text, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data, offsets = words.text_buffers(pa.array([text, *[x["item"] for x in items]]))
            hashes, first, _, _ = words.word_hashes(data, offsets)
            for k, x in enumerate(items, 1):
                if found := best_run(hashes[: first[1]], hashes[first[k] : first[k + 1]], x["shifts"]):
                    out.append((i, x["key"], *found))
        kinds = [batch.schema.field(0).type, pa.int64(), *[pa.int32()] * 4]
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "key", "doc_start", "item_start", "n_tokens", "n_same"])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns doc_id, item_id, doc_start, item_start, n_tokens and n_same: one row for each document and item that
    overlap, with the place (in tokens) of their best run, see ``best_run``. A window has WINDOW tokens, or all of a shorter item,
    and passes if PERCENT of its places agree; it may reach over an edge of the document or the item, where its places differ.

    Tokens are runs of characters other than ASCII white space, with A-Z as a-z. Items of any length count; those of one
    to four tokens overlap wherever they stand in full. Null, empty and blank texts overlap with nothing, nor do rows
    without an id. Rows that repeat an id count as versions of one document or item; a pair is reported once. Empty tables
    give an empty table. Equal items are looked up once; seeds that very many places share are split before they are joined.
    """
    text_batches(docs.sparkSession)
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    q = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).distinct()
    # Equal texts are one item, told apart from others by a hash.
    members = q.select(F.xxhash64("text").alias("key"), F.col("item").alias("item_id"))
    items = materialize(q.select(F.xxhash64("text").alias("key"), "text").distinct(), "seeds-items")
    d_type = d.schema["id"].dataType.simpleString()
    row = "seed long, at int, mask int"
    seeds = materialize(items.mapInArrow(_seed_rows(None, list(range(len(ALL_MASKS)))), f"key long, {row}"), "seeds-benchmark")
    masks = sorted(r["mask"] for r in seeds.select("mask").distinct().collect())  # of the few there are
    # The table travels as a broadcast variable of a fixed 2 MB, whatever the benchmark's size.
    shared = docs.sparkSession.sparkContext.broadcast(_bit_table(seeds))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _seed_rows(shared.value, masks)(batches)

    probes = materialize(d.mapInArrow(probe, f"id {d_type}, {row}").drop("mask"), "seeds-probes")
    hits = spread_join(probes, seeds.select("seed", "key", F.col("at").alias("item_at")), ["seed"], ["id", "at"])
    shifts = hits.select("id", "key", (F.col("at") - F.col("item_at")).alias("shift")).groupBy("id", "key").agg(F.sort_array(F.collect_set("shift")).alias("shifts"))
    pairs = materialize(shifts.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("id").orderBy("key")) - 1) / ITEMS)), "seeds-pairs")
    texts = d.join(pairs.select("id").distinct(), "id", "left_semi").distinct()
    beside = pairs.join(items.select("key", F.col("text").alias("item")), "key").groupBy("id", "part").agg(F.collect_list(F.struct("key", "item", "shifts")).alias("items"))
    verified = beside.join(texts, "id").select(F.col("id").alias("doc_id"), "text", "items").mapInArrow(_verify, f"doc_id {d_type}, key long, doc_start int, item_start int, n_tokens int, n_same int")
    best = F.max(F.struct("n_same", (-F.col("item_start")).alias("is"), (-F.col("doc_start")).alias("ds"), "n_tokens")).alias("m")
    found = verified.join(members, "key").groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", (-F.col("m.ds")).alias("doc_start"), (-F.col("m.is")).alias("item_start"), "m.n_tokens", "m.n_same")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that overlap with an item; columns as they are. Rows without an id stay."""
    found = overlaps(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(found, docs[id_col] == found["__leaked"], "left_anti")
