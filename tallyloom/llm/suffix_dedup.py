"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a document of smaller id, or earlier
in its own. Every window of ``LENGTH`` bytes is assigned to its minimizer, the k-gram of ``GRAM`` bytes in it that hashes
lowest, so equal windows have the same one and meet under its hash:

1. consecutive windows with one minimizer form a strand. Strands that repeat in whole are settled by their hash, first
   within each task and then by a minimum for each hash, so that no group of copies meets in one task;
2. minimizers with several different strands are where copies differ, begin or end. The bytes of each different strand are
   fetched, and blocks of whole minimizer groups get a suffix array (``suffix_groups``), in which equal windows are
   neighbours; all but the first of each run go. The strands are sorted in pieces of PIECE windows, in which the CORE bytes
   that all these windows share stand as one symbol, the same for the same bytes. Very large groups are dealt out in pieces by
   that text; equal pieces are settled first, in a task before the dealing by their bytes and after it by their hash;
3. what goes is gathered by document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import words
from tallyloom.llm.scratch import materialize, text_batches, unused
from tallyloom.llm.suffix_groups import symbol_runs

#: Bytes of a window and of the k-grams of which each window has one as its minimizer.
LENGTH, GRAM = 100, 32
#: Windows in a piece of a strand; strands of a minimizer from which its pieces are dealt out one by one; bytes of strands that are sorted together.
PIECE, MANY, BLOCK_BYTES = 8, 1000, 1 << 18
#: Bytes that PIECE successive windows share.
CORE = LENGTH - PIECE + 1
#: Different pieces that a task holds before the shuffle.
HELD = 50_000

#: Values of bytes in a polynomial hash.
_VALUES = words.constants(256, 5)


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * words._power_tables(len(data))[0][: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of data[lo:hi], the same wherever those bytes stand."""
    inverse = words._power_tables(len(sums))[1]
    return words.mix64((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def strands(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one text, for each strand: minimizer hash, strand hash, first window's start, number of windows, and where the
    minimizer starts. A window with several equal k-grams of least hash takes the first."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    sums = _sums(data)
    grams = np.arange(len(data) - GRAM + 1)
    h = _hash(sums, grams, grams + GRAM)
    # The leading half of the hash, and then the place, decide; both are the same in equal windows.
    ranked = (h & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
    place = (_slide(ranked, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = place[1:] != place[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    own = place[start]
    whole = _hash(sums, start, start + count + LENGTH - 1) ^ words.mix64((own - start).astype(np.uint64))
    return h[own], whole, start, count, own


def _mark(v: int, start: np.ndarray, lead: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A strand's place in its document as one number, in order of v (17 bits), start (31), and then of where in it the
    minimizer starts and how many windows it has (7 each)."""
    return (np.int64(v) << 45) | (start << 14) | (lead << 7) | count


def _unmark(mark):
    """v, start, lead and count."""
    return mark >> 45, (mark >> 14) & 0x7FFFFFFF, (mark >> 7) & 127, mark & 127


def _strand_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v, text) to (g, x, id, mark, again): strands; ``again`` if an earlier one in the same part of the task equals it."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        g, x, d, m = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((m, d, x, g))
        g, x, d, m = g[order], x[order], d[order], m[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
        again = (d != d[first]) | (m != m[first])
        keep = new | again  # a repeated row's strand is the same occurrence
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (g.view(np.int64), x.view(np.int64), d, m, again)], ["g", "x", "id", "mark", "again"])

    for batch in batches:
        data, offsets = words.text_buffers(batch.column(2))
        for k, (i, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            g, x, start, count, own = strands(data[offsets[k] : offsets[k + 1]])
            if len(g):
                held.append((g, x, np.full(len(g), i, np.int64), _mark(v, start, own - start, count)))
                size += len(g)
                if size > 500_000:
                    yield flush()
                    held, size = [], 0
    if held:
        yield flush()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, x, id, mark), sorted, to (id, mark, g, many): strands that an earlier one equals, with null g, and the first of each
    strand of a minimizer that has several, with ``many`` if it has more than MANY. Holds MANY rows of a minimizer at most."""
    g0 = x0 = first = None
    waiting: list[tuple] = []
    count = 0

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["id", "mark", "g", "many"])

    def close() -> list[tuple]:
        return [(*w, g0, False) for w in waiting] if 1 < count <= MANY else []

    for batch in batches:
        g = batch.column(0).to_numpy()
        if not len(g):
            continue
        same = g[1:] == g[:-1]
        keep = np.ones(len(g), bool)  # rows of a minimizer that occurs once need no look; those at the ends may go on
        keep[1:-1] = same[:-1] | same[1:]
        out: list[tuple] = []
        for gi, xi, i, m in zip(*(c.to_numpy()[keep].tolist() for c in batch.columns), strict=True):
            if gi != g0:
                out += close()
                g0, x0, waiting, count = gi, None, [], 0
            if xi == x0:
                if (i, m) != first:
                    out.append((i, m, None, False))
                continue
            x0, first, count = xi, (i, m), count + 1
            if count <= MANY:
                waiting.append(first)
            else:
                out += [(*w, g0, True) for w in waiting]
                waiting = []
                out.append((i, m, g0, True))
        yield rows(out)
    yield rows(close())


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, wanted (mark, g, many)) to (key, id, mark, body) with the bytes of strands, or of pieces of strands of large groups.

    Of pieces that are equal byte by byte only the earliest goes on, as far as HELD of them are held at a time; the others
    repeat it. Their rows have no body, and keys that spread them.
    """
    held: dict[tuple[int, bytes], tuple[int, int]] = {}

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "id", "mark", "body"])

    def earliest() -> list[tuple]:
        out = [(k, *place, piece) for (k, piece), place in held.items()]
        held.clear()
        return out

    for batch in batches:
        out: list[tuple] = []
        for i, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode()
            for w in wanted:
                v, start, lead, count = _unmark(w["mark"])
                body = data[start : start + count + LENGTH - 1]
                if not w["many"]:
                    out.append((w["g"], i, w["mark"], body))
                    continue
                key, _, lo, n, _ = _cut(np.array([w["g"]]), np.frombuffer(body, np.uint8), np.array([0, len(body)]), np.array([lead]))
                marks = _mark(v, start + lo, lead - lo, n)
                for k, m, a, c in zip(key.view(np.int64).tolist(), marks.tolist(), lo.tolist(), n.tolist(), strict=True):
                    piece, place = (k, body[a : a + c + LENGTH - 1]), (i, m)
                    known = held.setdefault(piece, place)
                    if place != known:  # a repeated row's piece is the same occurrence
                        held[piece] = min(known, place)
                        out.append((hash(max(known, place)), *max(known, place), None))
            if len(held) >= HELD:
                out += earliest()
        yield rows(out)
    if held:
        yield rows(earliest())


def _cut(g: np.ndarray, data: np.ndarray, bounds: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of strands: key, strand, first window in it, number of windows, start of the core in it. Pieces hold windows whose distances to the
    minimizer lie in one run of PIECE; the key is of the bytes that all windows of such a run share."""
    windows = np.diff(bounds) - LENGTH + 1
    first, last = own // PIECE, (own - windows + 1) // PIECE  # runs of distances, from the first window's down
    n = first - last + 1
    of = np.repeat(np.arange(len(g)), n)
    run = first[of] - (np.arange(len(of)) - (np.cumsum(n) - n)[of])
    lo = np.maximum(0, own[of] - (run * PIECE + PIECE - 1))
    hi = np.minimum(windows[of] - 1, own[of] - run * PIECE)
    sums = _sums(data)
    # Shared by all windows of a whole run, cut where the strand ends: then the windows there are share more.
    a, b = own[of] - run * PIECE, own[of] - (run * PIECE + PIECE - 1) + LENGTH
    key = words.mix64(_hash(sums, bounds[of] + a, bounds[of] + b) + g.view(np.uint64)[of] * np.uint64(3) + run.astype(np.uint64))
    return key, of, lo, hi - lo + 1, a


def _contracted(data: np.ndarray, begin: np.ndarray, core: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Symbols of pieces of ``n`` windows that begin there in ``data``: their bytes, and one symbol from 256 on, which names
    the bytes, for the CORE bytes at ``core``. So a window has PIECE symbols, and equal symbols are equal bytes."""
    whole, names = data.tobytes(), {}
    named = np.array([names.setdefault(whole[c : c + CORE], len(names)) for c in core.tolist()], np.int32)
    sizes = n + PIECE - 1
    of = np.repeat(np.arange(len(n)), sizes)
    at = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of] + begin[of]
    out = data[at + np.where(at > core[of], CORE - 1, 0)].astype(np.int32)
    out[at == core[of]] = named + 256
    return out


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, mark, body), sorted by key, to (id, v, lo, hi): the windows that repeat an earlier one, as byte ranges of the text."""
    held: list[tuple] = []
    size, last = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        rows = list({h[:3]: h for h in held}.values())  # repeated rows of a document give the same strand again
        g, d, m = (np.array([h[k] for h in rows], np.int64) for k in range(3))
        bodies = [h[3] for h in rows]
        bounds = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        data = np.frombuffer(b"".join(bodies), np.uint8)
        own_v, own_start, lead, _ = _unmark(m)
        key, of, lo, n, core = _cut(g, data, bounds, lead)
        core += bounds[of]
        sums = _sums(data)
        body = _hash(sums, bounds[of] + lo, bounds[of] + lo + n + LENGTH - 1)
        v, start = own_v[of], own_start[of] + lo
        order = np.lexsort((start, v, d[of], body, key))
        key, of, lo, n, core, body, v, start = (c[order] for c in (key, of, lo, n, core, body, v, start))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (body[1:] != body[:-1])
        gone = [(d[of[~new]], v[~new], start[~new], start[~new] + n[~new] + LENGTH - 1)]  # whole pieces that an earlier one equals
        key, of, lo, n, core, v, start = (c[new] for c in (key, of, lo, n, core, v, start))
        edge = np.ones(len(key) + 1, bool)
        edge[1:-1] = key[1:] != key[:-1]
        several = ~(edge[:-1] & edge[1:])
        # Within a piece a text can repeat itself, too: then it holds its minimizer again, and that would be nearer.
        of, lo, n, core, v, start = (c[several] for c in (of, lo, n, core, v, start))
        if len(of):
            piece, at, run = symbol_runs(_contracted(data, bounds[of] + lo, core, n), n + PIECE - 1, PIECE)
            begin = start[piece] + at
            order = np.lexsort((begin, v[piece], d[of[piece]], run))
            piece, begin, run = piece[order], begin[order], run[order]
            later = np.zeros(len(run), bool)
            later[1:] = run[1:] == run[:-1]
            who, ver, begin = d[of[piece[later]]], v[piece[later]], begin[later]
            order = np.lexsort((begin, ver, who))
            who, ver, begin = who[order], ver[order], begin[order]
            if len(who):
                head = np.ones(len(who), bool)
                head[1:] = (who[1:] != who[:-1]) | (ver[1:] != ver[:-1]) | (begin[1:] > begin[:-1] + 1)
                tail = np.append(np.flatnonzero(head)[1:] - 1, len(who) - 1)
                gone.append((who[head], ver[head], begin[head], begin[tail] + LENGTH))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*gone, strict=True)], ["id", "v", "lo", "hi"])

    for batch in batches:
        gone = pc.is_null(batch.column(3))
        if pc.any(gone).as_py():  # pieces that equal an earlier one
            v, start, _, n = _unmark(batch.column(2).filter(gone).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(gone), *[pa.array(c) for c in (v, start, start + n + LENGTH - 1)]], ["id", "v", "lo", "hi"])
        for row in zip(*(c.to_pylist() for c in batch.filter(pc.invert(gone)).columns), strict=True):
            if row[0] != last and size >= BLOCK_BYTES:
                yield from flush()
                held, size = [], 0
            held.append(row)
            size, last = size + len(row[3]), row[0]
    if held:
        yield from flush()


def _ranges(column: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """Of each row its ranges (lo, hi); null has none."""
    pairs = list(zip(*(c.to_pylist() for c in column.flatten().flatten()), strict=True))
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()
    return (pairs[a:b] for a, b in zip([0, *ends], ends))


def _without(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text without these ranges [lo, hi), how many bytes go, and in how many runs."""
    kept, at, removed, spans = [], 0, 0, 0
    for lo, hi in sorted(ranges):
        if lo > at or not spans:
            kept.append(data[at:lo])
            spans, removed, at = spans + 1, removed + hi - lo, hi
        elif hi > at:
            removed, at = removed + hi - at, hi
    kept.append(data[at:])
    return b"".join(kept), removed, spans


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, ranges) to the text without those bytes and its figures."""
    for batch in batches:
        out = []
        for text, ranges in zip(batch.column(1).to_pylist(), _ranges(batch.column(2)), strict=True):
            data = text.encode()
            rest, removed, spans = _without(data, ranges)
            out.append((len(data), removed, spans, hashlib.sha256(rest).hexdigest(), rest))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """Columns id, v, lo, hi: byte ranges of texts that earlier strings of LENGTH bytes cover; they may overlap.

    ``docs`` has id (long, not null), v (17 bits of the text's hash) and text (not null).
    """
    rows = docs.select("id", "v", "text").mapInArrow(_strand_rows, "g long, x long, id long, mark long, again boolean")
    met = rows.where("NOT again").select("g", "x", "id", "mark").repartition("g").sortWithinPartitions("g", "x", "id", "mark").mapInArrow(_settle, "id long, mark long, g long, many boolean")
    again = rows.where("again").select("id", "mark", F.lit(None).cast("long").alias("g"), F.lit(False).alias("many"))
    found = materialize(met.unionByName(again).withColumn("v", F.shiftright("mark", 45)), "strands")

    wanted = found.where("g IS NOT NULL").groupBy("id", "v").agg(F.collect_list(F.struct("mark", "g", "many")).alias("wanted"))
    fetched = docs.join(wanted, ["id", "v"]).select("id", "text", "wanted").mapInArrow(_fetch, "key long, id long, mark long, body binary")
    resolved = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(_resolve, "id long, v long, lo long, hi long")
    start = F.shiftright("mark", 14).bitwiseAND(F.lit(0x7FFFFFFF))
    whole = found.where("g IS NULL").select("id", "v", start.alias("lo"), (start + F.col("mark").bitwiseAND(F.lit(127)) + (LENGTH - 1)).alias("hi"))
    return whole.unionByName(resolved)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col``, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes), for each row.

    Null texts are empty. Texts under LENGTH bytes lose nothing. Of rows that repeat an id, equal texts are one document
    and lose the same bytes; different ones follow each other in the order of a hash. Rows without an id stand apart: they
    lose nothing and nothing is lost to them. An empty table gives an empty table.
    """
    text_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.xxhash64(text).bitwiseAND(F.lit((1 << 17) - 1))).alias("v"), text.alias("text"))
    found = repeated_ranges(rows.where(f"id IS NOT NULL AND octet_length(text) >= {LENGTH}"))
    ranges = materialize(found.groupBy("id", "v").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "strands-ranges")
    joined = rows.join(ranges, ["id", "v"], "left").select("id", "text", "ranges")
    out = joined.mapInArrow(_remove, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated strings cut out of their texts, and ``length_col`` (if there) set to what is left in characters.

    Cuts fall between bytes; where one splits a character, its stray bytes go, too. A null text stays null; a text of which
    nothing is left stays as an empty one. Columns may have any names.
    """
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    v = F.xxhash64(text).bitwiseAND(F.lit((1 << 17) - 1))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), text.alias("text"))
    found = repeated_ranges(rows.where(f"id IS NOT NULL AND octet_length(text) >= {LENGTH}"))
    ranges = materialize(found.groupBy("id", "v").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "strands-ranges")
    names = docs.columns
    other_id, other_v, cuts = (unused(c, names) for c in ("other_id", "other_v", "cuts"))
    found = ranges.select(F.col("id").alias(other_id), F.col("v").alias(other_v), F.col("ranges").alias(cuts))
    joined = docs.join(found, (F.col(id_col).cast("long") == F.col(other_id)) & (v == F.col(other_v)), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column(at).to_pylist(), _ranges(batch.column(batch.num_columns - 1)), strict=True):
                texts.append(text if not ranges else _without(text.encode(), ranges)[0].decode("utf-8", "ignore"))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.select(*[F.col(f"`{c}`") for c in names], cuts).mapInArrow(cut, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out
