"""Operator 8: benchmark decontamination by size-partitioned MinHash containment search.

Items are sets of five-word shingles. They are partitioned by size into classes whose upper size u doubles from
one to the next. For a class every document is read as overlapping windows of 2u shingles, one starting at
every u, so that a short item meets a set of about its own size however long the document is, and its
containment in the window turns into a Jaccard similarity that has a lower bound. A window and an item
are a candidate if one of PERMUTATIONS minwise values agrees; the number follows from that bound and RECALL.
Candidates are verified by exact containment of the item's shingles in the whole document.

Tasks sketch the benchmark, each text once, and write sketches and sets to the shared folder; their number and bytes are
counted there. The documents are read once, however many items there are, and never shuffled:

  - up to BROADCAST_BYTES of sketches and sets travel to the tasks, which search and verify on the spot;
  - beyond, only two bitmaps of bounded size do: one of the sketches' values, one of the items' shingles (hashed). A task
    passes on the values and shingles of a document that may be an item's, as rows of integers. They are joined to
    sketches and sets, which drops what the bitmaps let through by chance, and counted. Both ways give the same rows.

Defined results: words are folded by Unicode's lower case; items of fewer than five words have no shingle and match nothing,
and so do shorter, null and empty texts; null doc_id and item_id are kept; repeated rows match each on their own; items of
equal text match alike; empty tables give no matches; a very long text is searched whole, in memory of about 40 bytes
for each of its own; other columns are ignored by contained() and kept by decontaminated(), whatever their names.
"""

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.storage import free_name, removed, saved
from quarterdeck.llm.words import SHINGLE, chunks, mixed, shingle_hashes, text_buffer, word_hashes, words

THRESHOLD = 0.8
RECALL = 0.999
#: Sketches and sets up to this size are broadcast.
BROADCAST_BYTES = 64 << 20
#: Bits of a bitmap: the least, and the most, which are 64 MB.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 29
_BUCKET = 4096 * 8  # bits of one row of bitmap_construct_agg


def permutations_needed(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Minwise values for the recall: an item of u / 2 shingles, of which the threshold's share is in a window of 2u."""
    shared = threshold / 2
    jaccard = shared / (2 + 0.5 - shared)
    return ceil(log(1 - recall) / log(1 - jaccard))


def seeds(threshold: float, recall: float) -> np.ndarray:
    return mixed(np.arange(1, permutations_needed(threshold, recall) + 1, dtype=np.uint64)) | np.uint64(1)


def tagged(values: np.ndarray, upper: int, k: int) -> np.ndarray:
    """Minwise values of one class and permutation as keys of their own."""
    return mixed(values ^ mixed(np.array([upper * 4096 + k + 1], np.uint64)))


def sketched(benchmark: DataFrame, threshold: float, recall: float, n: int) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Tables (item, item_id), (item, upper, shingles) and (item, upper, key) of the benchmark, and their folders.

    item numbers the distinct texts with a shingle; key has the tagged minwise values."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    digest = F.struct(F.xxhash64("text"), F.md5(F.col("text").cast("binary")))
    texts, texts_path = saved(rows.select("text", digest.alias("digest")).groupBy("digest").agg(F.min("text").alias("text")).withColumn("item", F.monotonically_increasing_id()), "item-texts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in chunks(offsets):
                found = words(data, offsets[first : last + 1])
                shingles, at = shingle_hashes(word_hashes(found), found.bounds, n)
                own = [np.unique(shingles[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                full = [k for k, x in enumerate(own) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first).take(pa.array(full, pa.int64())), pa.array([1 << len(own[k]).bit_length() for k in full], pa.int64()), pa.array([own[k].astype("<u8").tobytes() for k in full], pa.binary())],
                    names=["item", "upper", "shingles"],
                )

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, upper, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = np.frombuffer(raw, "<u8")
                key = [tagged(np.array([int((own * seed).min())], np.uint64), upper, k)[0] for k, seed in enumerate(seeds(threshold, recall))]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(key)), pa.array([upper] * len(key)), pa.array(np.array(key, np.uint64).view(np.int64))], names=["item", "upper", "key"])

    item_sets, sets_path = saved(texts.select("item", "text").mapInArrow(sets, "item long, upper long, shingles binary"), "item-sets")
    sketches, sketches_path = saved(item_sets.mapInArrow(keys, "item long, upper long, key long"), "item-sketches")
    ids = rows.withColumn("digest", digest).join(texts.select("digest", "item"), "digest").select("item", "item_id")
    return ids, item_sets, sketches, [texts_path, sets_path, sketches_path]


def window_keys(shingles: np.ndarray, at: np.ndarray, uppers: list[int], scale: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of every window of the rows' shingles, by class and permutation."""
    sizes, plans = np.diff(at), []
    for upper in uppers:
        n_blocks = -(-sizes // upper)
        row = np.repeat(np.arange(len(sizes)), n_blocks)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        plans.append((upper, at[:-1][row] + nth * upper, row, row[1:] == row[:-1]))
    for k, seed in enumerate(scale):
        values = shingles * seed
        for upper, starts, row, same in plans:
            least = np.minimum.reduceat(values, starts)
            least[:-1] = np.where(same, np.minimum(least[:-1], least[1:]), least[:-1])
            yield row, tagged(least, upper, k)


class Filter:
    """A bitmap of hashed 64-bit values that lets every value of the table pass, and others by chance."""

    def __init__(self, bits: int, buckets: list[tuple[int, bytes]]):
        self.bits = np.uint64(bits - 1)
        self.map = np.zeros(bits // 8, np.uint8)
        for bucket, raw in buckets:
            first = (bucket - 1) * (_BUCKET // 8)
            self.map[first : first + len(raw)] = np.frombuffer(raw, np.uint8)

    def passes(self, values: np.ndarray) -> np.ndarray:
        place = values & self.bits
        return (self.map[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def filter_of(values: DataFrame, n: int) -> Filter:
    """The bitmap of column `value`, built by Spark; only its rows of 4 KB, at most MOST_BITS together, come to the driver."""
    bits = min(max(LEAST_BITS, 1 << (16 * n).bit_length()), MOST_BITS)
    place = F.col("value").bitwiseAND(F.lit(bits - 1))
    # bit positions and bucket numbers as Spark's bitmap functions count them: bucket 1 holds positions 0 to 32767
    rows = values.select((F.floor(place / _BUCKET) + 1).alias("bucket"), (place % _BUCKET).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    return Filter(bits, [(r["bucket"], bytes(r["map"])) for r in rows.collect()])


class Items:
    """The whole benchmark in a task: the items of each key, and their sets."""

    def __init__(self, sets: list[tuple[int, int, bytes]], sketches: list[tuple[int, int]], ids: list[tuple[int, int | None]], threshold: float, recall: float):
        self.threshold, self.seeds = threshold, seeds(threshold, recall)
        self.sets = {item: np.frombuffer(raw, "<u8") for item, _, raw in sets}
        self.uppers = sorted({upper for _, upper, _ in sets})
        key = np.array([k for _, k in sketches], np.int64).view(np.uint64)
        order = np.argsort(key, kind="stable")
        self.keys, at = np.unique(key[order], return_index=True)
        self.owner, self.at = np.array([x for x, _ in sketches], np.int64)[order], np.r_[at, len(key)]
        self.top = np.zeros(1 << 16, bool)
        self.top[self.keys >> np.uint64(48)] = True
        self.ids: dict[int, list] = {}
        for item, item_id in ids:
            self.ids.setdefault(item, []).append(item_id)

    def matches(self, column: pa.Array, n: int) -> Iterator[tuple[int, int, float]]:
        """Yields (row, item, containment)."""
        if not len(self.keys):
            return
        data, offsets = text_buffer(column)
        for first, last in chunks(offsets):
            found = words(data, offsets[first : last + 1])
            shingles, at = shingle_hashes(word_hashes(found), found.bounds, n)
            if not len(shingles):
                continue
            candidates: set[tuple[int, int]] = set()
            for row, key in window_keys(shingles, at, self.uppers, self.seeds):
                hit = np.flatnonzero(self.top[key >> np.uint64(48)])
                number = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
                same = self.keys[number] == key[hit]
                for r, k in zip(row[hit[same]].tolist(), number[same].tolist(), strict=True):
                    candidates.update((r, item) for item in self.owner[self.at[k] : self.at[k + 1]].tolist())
            held, of = np.empty(0, np.uint64), -1
            for r, item in sorted(candidates):
                if r != of:
                    held, of = np.unique(shingles[at[r] : at[r + 1]]), r
                own = self.sets[item]
                place = np.minimum(np.searchsorted(held, own), len(held) - 1)
                share = float((held[place] == own).mean())
                if share >= self.threshold - 1e-9:
                    yield first + r, item, share


def _small(item_sets: DataFrame, limit: int) -> tuple[int, int, bool]:
    """(items, shingles, whether sets and sketches are within the limit)."""
    row = item_sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("shingles")), F.lit(0))).first()
    return row[0], row[1] // 8, row[1] + 16 * permutations_needed() * row[0] <= limit


def _collected(ids: DataFrame, item_sets: DataFrame, sketches: DataFrame, threshold: float, recall: float) -> Items:
    return Items([tuple(r) for r in item_sets.collect()], [tuple(r) for r in sketches.select("item", "key").collect()], [tuple(r) for r in ids.collect()], threshold, recall)


def _by_joins(rows: DataFrame, item_sets: DataFrame, sketches: DataFrame, counts: tuple[int, int], threshold: float, recall: float, n: int) -> tuple[DataFrame, list[str]]:
    """(uid, item, containment) for rows of uid and text, with no more than the bitmaps in a task."""
    uppers = [r["upper"] for r in item_sets.select("upper").distinct().collect()]  # powers of two: 64 at most

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), item)), pa.array(own)], names=["item", "value"])

    flat = item_sets.select("item", "shingles").mapInArrow(flatten, "item long, value long")
    flat, flat_path = saved(flat, "item-shingles")
    shared = rows.sparkSession.sparkContext.broadcast((filter_of(sketches.select(F.col("key").alias("value")), counts[0] * permutations_needed(threshold, recall)), filter_of(flat.select("value"), counts[1])))
    scale = seeds(threshold, recall)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key, by_shingle = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in chunks(offsets):
                found = words(data, offsets[first : last + 1])
                shingles, at = shingle_hashes(word_hashes(found), found.bounds, n)
                if not len(shingles):
                    continue
                kept = [(row[ok], key[ok]) for row, key in window_keys(shingles, at, uppers, scale) if (ok := by_key.passes(key)).any()]
                if not kept:
                    continue
                row, key = (np.concatenate(x) for x in zip(*kept, strict=True))
                near = np.zeros(last - first, bool)
                near[row] = True
                of = np.repeat(np.arange(last - first), np.diff(at))
                own = np.flatnonzero(near[of] & by_shingle.passes(shingles))
                pairs = np.unique(np.rec.fromarrays([of[own], shingles[own]], names="row,value"))
                uid = batch.column(0).slice(first, last - first).to_numpy()
                for kind, r, x in ((0, row, key), (1, pairs["row"], pairs["value"])):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), kind, np.int32)), pa.array(uid[r]), pa.array(x.astype(np.uint64).view(np.int64))], names=["kind", "uid", "value"])

    hits, hits_path = saved(rows.select("uid", F.col("text").cast("string")).mapInArrow(search, "kind int, uid long, value long"), "hits")
    candidates = hits.where("kind = 0").join(sketches.withColumnRenamed("key", "value"), "value").select("uid", "item").distinct()
    shared_shingles = hits.where("kind = 1").join(flat, "value").groupBy("uid", "item").agg(F.count(F.lit(1)).alias("shared"))
    sizes = item_sets.select("item", (F.octet_length("shingles") / 8).alias("size"))
    # a document's window may pass by chance; the count over the whole document decides
    matched = shared_shingles.join(candidates, ["uid", "item"]).join(sizes, "item").select("uid", "item", (F.col("shared") / F.col("size")).alias("containment"))
    return matched.where(F.col("containment") >= threshold - 1e-9), [flat_path, hits_path]


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each document and item that it contains: doc_id, item_id, containment."""
    ids, item_sets, sketches, paths = sketched(benchmark, threshold, recall, n)
    n_items, n_shingles, small = _small(item_sets, broadcast_bytes)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if small:
        shared = docs.sparkSession.sparkContext.broadcast(_collected(ids, item_sets, sketches, threshold, recall))
        removed(docs.sparkSession, *paths)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                found = [(r, item_id, share) for r, item, share in items.matches(batch.column(1), n) for item_id in items.ids[item]]
                if found:
                    row, item_id, share = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item_id, pa.int64()), pa.array(share)], names=["doc_id", "item_id", "containment"])

        return texts.mapInArrow(search, "doc_id long, item_id long, containment double")
    rows, _ = saved(texts.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    matched, _ = _by_joins(rows, item_sets, sketches, (n_items, n_shingles), threshold, recall, n)
    return matched.join(rows.select("uid", "doc_id"), "uid").join(ids, "item").select("doc_id", "item_id", "containment")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    ids, item_sets, sketches, paths = sketched(benchmark, threshold, recall, n)
    n_items, n_shingles, small = _small(item_sets, broadcast_bytes)
    if small:
        at = docs.columns.index("text")
        shared = docs.sparkSession.sparkContext.broadcast(_collected(ids, item_sets, sketches, threshold, recall))
        removed(docs.sparkSession, *paths)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _, _ in items.matches(batch.column(at).cast(pa.string()), n)]] = False
                yield batch.filter(pa.array(clean))

        return docs.mapInArrow(search, docs.schema)
    row, other = free_name("row_id", docs.columns), free_name("found_id", docs.columns)
    docs_rows, _ = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    matched, _ = _by_joins(docs_rows.select(F.col(row).alias("uid"), "text"), item_sets, sketches, (n_items, n_shingles), threshold, recall, n)
    return docs_rows.join(matched.select(F.col("uid").alias(other)).distinct(), F.col(row) == F.col(other), "left_anti").drop(row)
