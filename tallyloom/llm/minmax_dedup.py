"""Near-duplicate documents by min-max hashing.

Each of ``bands * rows / 2`` permutations of the 32-bit shingle hashes is evaluated once and gives two signature
values, the smallest and the largest image. Bands of ``rows`` values, the first half of them minima and the second
half maxima of the same permutations, are the keys under which candidates meet. All links are confirmed on full sets:

1. documents with the same set are one class, found by a 128-bit hash of the set;
2. in each band bucket every class is compared with the smallest, and confirmed links are joined to components;
3. buckets that still hold several components get an exact prefix-filtered join of the classes across components,
   so that no link depends on which class happened to lead a bucket, and no bucket is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import words
from tallyloom.llm.components import connected_components
from tallyloom.llm.hot import spread_join
from tallyloom.llm.scratch import materialize, text_batches, unused

#: Words in a shingle and percent of likeness from which documents are linked.
WIDTH, PERCENT = 5, 80
#: A pair at a likeness of 0.8 shares no band with probability (1 - 0.8**5)**32, 3 in a million.
BANDS, ROWS = 32, 5


def _set_columns(rows: list[np.ndarray], bands: int, per_band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, two commutative 64-bit hashes and the band keys of non-empty sets."""
    sizes = np.array([len(x) for x in rows], np.int64)
    values, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h1 = np.add.reduceat(words.mix64(values + np.uint64(0x51ED270B)), starts)
    h2 = np.add.reduceat(words.mix64(values ^ np.uint64(0xA24BAED4963EE407)), starts)
    x = (values >> np.uint64(32)).astype(np.uint32)
    n = bands * per_band // 2
    times, plus = (words.constants(n, seed).astype(np.uint32) for seed in (31, 37))
    both = np.empty((2 * n, len(rows)), np.uint32)
    y = np.empty_like(x)
    for k in range(n):
        np.multiply(x, times[k], out=y)
        y += plus[k]
        np.minimum.reduceat(y, starts, out=both[k])
        np.maximum.reduceat(y, starts, out=both[n + k])
    keys, mixed = np.zeros((bands, len(rows)), np.uint64), words.constants(per_band, 41)
    for j in range(per_band):
        keys += both[j::per_band].astype(np.uint64) * mixed[j]
    keys = words.mix64(keys + words.constants(bands, 43)[:, None])
    return sizes, h1, h2, keys.T


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Columns id, n, h1, h2 and keys (one long for each band); a row for each row of ``docs``.

    Null and blank texts have n = 0 and no keys; texts shorter than ``width`` words are one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.text_buffers(batch.column(1))
            for a, b in words.chunks(offsets):
                hashes, first, _, _ = words.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sets = list(words.shingle_hashes(hashes, first, width))
                full = np.array([len(s) > 0 for s in sets], bool)
                n, h1, h2 = (np.zeros(b - a, t) for t in (np.int64, np.uint64, np.uint64))
                keys = np.zeros((0, bands), np.uint64)
                if full.any():
                    n[full], h1[full], h2[full], keys = _set_columns([s for s in sets if len(s)], bands, rows)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32), keys.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], ["id", "n", "h1", "h2", "keys"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {id_type}, n long, h1 long, h2 long, keys array<long>")


#: Longs of a parity sketch: bit h of it tells whether an odd number of the set's shingles hash to h.
SKETCH = 16


def _sketch(values: np.ndarray) -> np.ndarray:
    odd = np.bincount((values >> np.uint64(7)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """Columns id, shingles (distinct 64-bit hashes) and sketch (SKETCH longs) of a table of ids and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.text_buffers(batch.column(1))
            for a, b in words.chunks(offsets):
                hashes, first, _, _ = words.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sets = list(words.shingle_hashes(hashes, first, width))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32), np.concatenate(sets).view(np.int64))
                sketches = pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * SKETCH, np.concatenate([_sketch(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, sketches], ["id", "shingles", "sketch"])

    id_type = docs.schema[docs.columns[0]].dataType.simpleString()
    return docs.mapInArrow(run, f"id {id_type}, shingles array<long>, sketch array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of ids whose sets are alike by ``percent`` or more."""
    pairs = materialize(pairs, "minmax-pairs")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = spread_join(pairs, left, ["a"], ["b"]).join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _across(sets: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of ``sets`` (id, shingles) in different components (id, component), complete by prefix filtering.

    Shingles are ordered by how many of these sets hold them, rarest first; sets that are alike by ``percent`` share
    one of the first n - ceil(n * percent / 100) + 1. In each shingle's group only what lies outside its largest
    component is paired with the rest, so that a large group of copies is not paired with itself. A pair leaves the
    join only if the bits in which its parity sketches differ, which are never more than the shingles in which the sets
    differ, are no more than ``percent`` allows. A shingle that very many sets hold is split before every join.
    """
    rows = sets.join(of, "id").select("id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("t"))
    shared = rows.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("c > 1")
    held = spread_join(rows, shared, ["t"], ["id"], counts=shared.select("t", F.col("c").alias("n")))
    place = F.row_number().over(Window.partitionBy("id").orderBy("c", "t"))
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("id"))
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    prefix = held.withColumn("place", place + alone).where(F.col("place") <= length).where("lo <> hi").select("t", "id", "component", "n")
    parts = [F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)]
    prefix = materialize(prefix.join(sets.select("id", *parts), "id"), "minmax-prefix")
    groups = prefix.groupBy("t", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("t").agg(F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
    groups = materialize(groups.select("t", F.col("most.component").alias("main"), "n"), "minmax-groups")
    several = spread_join(prefix, groups.select("t", "main"), ["t"], ["id"], counts=groups.select("t", "n"))
    outside = several.where("component <> main").select("t", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), *[F.col(f"s{k}").alias(f"o{k}") for k in range(SKETCH)])
    apart = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"o{k}"))) for k in range(SKETCH)), F.lit(0))
    near = (F.col("ca") != F.col("component")) & (100 * F.least("na", "n") >= percent * F.greatest("na", "n")) & ((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("n")))
    return spread_join(several.drop("main"), outside, ["t"], ["id"], counts=groups.select("t", "n")).where(near).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Columns ``id_col``, n_shingles, component_id (the smallest id that it reaches) and kept (that id is its own).

    One row for each row of ``docs``, whatever other columns it has. Null, empty and blank texts have no shingles and
    are linked with nothing. Rows without an id are linked with nothing either: their component_id is null and they are
    kept. Rows that repeat an id are one node, which has the links of all its texts. An empty table gives an empty table.
    """
    text_batches(docs.sparkSession)
    signed = materialize(signatures(docs, id_col, text_col, width, bands, rows), "minmax-signatures")
    full = signed.where("n > 0 AND id IS NOT NULL")
    classes = materialize(full.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "minmax-classes")

    entries = classes.select(F.explode("keys").alias("key"), "rep")
    buckets = entries.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader <> last").select("key", "leader")
    members = materialize(entries.join(buckets, "key"), "minmax-buckets")
    pairs = members.where("leader <> rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    # A text for each id that the buckets name; an id that is repeated has the texts of all its classes.
    named = members.select(F.col("rep").alias("id")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(named, "id", "left_semi")
    sets = materialize(shingle_sets(texts, width).where(F.size("shingles") > 0), "minmax-sets")
    links = materialize(_confirmed(pairs, sets, percent), "minmax-links")

    # An id in several classes links them.
    several = full.join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"]).groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("reps")).where("a <> b")
    links = links.unionByName(several.select("a", F.explode("reps").alias("b")).where("a <> b"))
    found = materialize(connected_components(links), "minmax-components")

    of = named.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    mixed = members.join(of, F.col("rep") == F.col("id")).select("key", "rep", "component")
    split = mixed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ids = materialize(mixed.join(split, "key", "left_semi").select(F.col("rep").alias("id"), "component").distinct(), "minmax-open")
    more = _confirmed(_across(sets.join(open_ids, "id", "left_semi"), open_ids, percent), sets, percent)
    found = connected_components(links.select("a", "b").unionByName(more))

    of_class = classes.select("n", "h1", "h2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    joined = signed.drop("keys").join(of_class, ["n", "h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that of the smallest id.

    Of rows that repeat an id, one row stays. Rows without an id, and rows without words, stay as they are.
    """
    found = near_duplicates(docs, id_col, text_col, width, percent)
    gone, again, place = (unused(c, docs.columns) for c in ("gone", "again", "place"))
    left = docs.join(found.where("NOT kept").select(F.col(id_col).alias(gone)).distinct(), F.col(id_col) == F.col(gone), "left_anti")
    repeated = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1").select(F.col(id_col).alias(again))
    once = left.join(repeated, F.col(id_col) == F.col(again), "left_anti")
    twice = left.join(repeated, F.col(id_col) == F.col(again), "left_semi")
    order = Window.partitionBy(id_col).orderBy(F.length(text_col).desc_nulls_last(), F.xxhash64(text_col))
    return once.unionByName(twice.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place))
