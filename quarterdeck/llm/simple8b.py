"""Operator 7: token ids in Simple-8b words, written in doc_id order and read back.

File format. A file is a Parquet file of segments, one a row; a segment holds whole documents in
ascending doc_id order. `words` is a run of little-endian 64-bit words. A word's top four bits are its
selector; selector s packs COUNTS[s] ids of 60 // COUNTS[s] bits each, the first in the lowest bits. Selector
ESCAPE announces one id over 60 bits, stored whole in the next word. Ids are cut into blocks of
BLOCK ids; a block starts on a word of its own and `block_words` has each block's first word, so blocks decode
independently and all words of one selector decode at once. doc_ids and doc_lens give the documents,
first_id the ids that the shard holds before the segment. The number of shards follows from the texts' bytes.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; documents of one doc_id
are ordered by their text's hash; no documents give no rows; a very long text is one segment, encoded piece by
piece; texts are cut at the tokenizer's added tokens as the library does; other columns are ignored.
"""

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.llm.bpe import encoder
from quarterdeck.llm.storage import new_path

COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
WIDTHS = 60 // COUNTS
ESCAPE = 15
BLOCK = 1024
SEGMENT = 1 << 18
#: Text of one shard, about.
SHARD_BYTES = 256 << 20
END_ID = 2

SEGMENTS = "shard int, segment int, first_id long, n_ids long, doc_ids array<long>, doc_lens array<long>, block_words array<int>, words binary"


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 1 at least."""
    if int(ids.max(initial=0)) < 1 << 53:  # exact as doubles
        return np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)
    out = np.ones(ids.shape, np.uint8)
    for bits in range(1, 64):
        out += ids >> np.uint64(bits) > 0
    return out


def encoded(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned ids."""
    n = len(ids)
    if not n:
        return np.empty(0, "<u8"), np.empty(0, np.int32)
    rows = -(-n // block)
    room = np.zeros((rows, block + COUNTS[-1]), np.uint64)
    flat = np.zeros(rows * block, np.uint64)
    flat[:n] = ids
    room[:, :block] = flat.reshape(rows, block)
    bits = bit_lengths(room)
    widest = {1: bits}  # most bits of the next c ids; beyond a block there are zeros
    best = np.where(bits > 60, ESCAPE, 0).astype(np.uint8)
    for k, c in enumerate(COUNTS.tolist()[1:], 1):
        half = int(COUNTS[COUNTS <= c // 2].max()) if c > 3 else 1
        rest = c - half
        have = widest.get(rest)
        if have is None:
            rest = int(COUNTS[COUNTS <= rest].max())
            have = widest[rest]
        now = widest[half].copy()
        now[:, : now.shape[1] - (c - rest)] = np.maximum(widest[half][:, : now.shape[1] - (c - rest)], have[:, c - rest :])
        if half + rest < c:  # the two spans leave a gap in the middle
            middle = widest[half]
            now[:, : now.shape[1] - half] = np.maximum(now[:, : now.shape[1] - half], middle[:, half:])
        widest[c] = now
        best[now <= WIDTHS[k]] = k
    ends = np.full(rows, block)
    ends[-1] = n - (rows - 1) * block
    at, live, walked = np.zeros(rows, np.int64), np.arange(rows), []
    while len(live):
        chosen = best[live, at[live]]
        walked.append((live, at[live], chosen))
        at[live] += np.where(chosen == ESCAPE, 1, COUNTS[np.minimum(chosen, len(COUNTS) - 1)])
        live = live[at[live] < ends[live]]
    row, start, chosen = (np.concatenate(x) for x in zip(*walked, strict=True))
    order = np.argsort(row, kind="stable")
    row, start, chosen = row[order], start[order], chosen[order]
    escaped = chosen == ESCAPE
    place = np.cumsum(1 + escaped) - 1 - escaped
    words = np.zeros(len(row) + int(escaped.sum()), np.uint64)
    for k in np.unique(chosen).tolist():
        own = np.flatnonzero(chosen == k)
        if k == ESCAPE:
            words[place[own]] = np.uint64(ESCAPE) << np.uint64(60)
            words[place[own] + 1] = room[row[own], start[own]]
            continue
        c, w = int(COUNTS[k]), np.uint64(WIDTHS[k])
        word = np.full(len(own), np.uint64(k) << np.uint64(60))
        for j in range(c):
            word |= room[row[own], start[own] + j] << (w * np.uint64(j))
        words[place[own]] = word
    return words.astype("<u8"), place[np.searchsorted(row, np.arange(rows))].astype(np.int32)


def decoded(words: np.ndarray, block_words: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids that encoded() packed."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == ESCAPE).any():
        for at in range(len(words)):  # a raw word may look like any selector
            if not raw[at] and selector[at] == ESCAPE:
                raw[at + 1] = True
    count = np.where(raw, 1, np.where(selector == ESCAPE, 0, COUNTS[np.minimum(selector, len(COUNTS) - 1)]))
    before = np.cumsum(count) - count
    of = np.searchsorted(block_words, np.arange(len(words)), "right") - 1
    start = of * block + before - before[block_words][of]
    end = np.minimum((of + 1) * block, n)
    out = np.zeros(n, np.uint64)
    out[start[raw]] = words[raw]
    plain = ~raw & (selector != ESCAPE)
    for k in np.unique(selector[plain]).tolist():
        own = np.flatnonzero(plain & (selector == k))
        mask, w = np.uint64((1 << int(WIDTHS[k])) - 1), np.uint64(WIDTHS[k])
        for j in range(int(COUNTS[k])):
            inside = start[own] + j < end[own]
            out[start[own][inside] + j] = (words[own][inside] >> (w * np.uint64(j))) & mask
    return out


def written(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, n_shards: int | None = None) -> None:
    """Writes the ids of all documents under path, in shards of ascending doc_id."""
    spark = docs.sparkSession
    if not n_shards:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")), F.lit(0))).first()[0]
        n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / SHARD_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, first_id = TaskContext.get().partitionId(), 0, 0
        ids_of = encoder(tokenizer_path)
        doc_ids: list = []
        lens: list[int] = []
        parts: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            nonlocal segment, first_id
            ids = np.concatenate(parts)
            words, at = encoded(ids)
            row = {"shard": shard, "segment": segment, "first_id": first_id, "n_ids": len(ids), "doc_ids": list(doc_ids), "doc_lens": list(lens), "block_words": at, "words": words.tobytes()}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            segment, first_id = segment + 1, first_id + len(ids)
            for x in (doc_ids, lens, parts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

        held = 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, ids, at in ids_of(batch.column(1)):
                for k in range(len(at) - 1):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id))
                    doc_ids.append(names[first + k])
                    lens.append(len(own))
                    parts.append(own)
                    held += len(own)
                    if held >= SEGMENT:
                        yield closed()
                        held = 0
        if parts:
            yield closed()

    # equal rows differ by their number, so that even one repeated document is dealt to several shards
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"digest": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(n_shards, "doc_id", "digest", "nth").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENTS).write.option("compression", "zstd").parquet(path)


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, first_id, n_ids = (batch.column(k)[row].as_py() for k in range(3))
                doc_ids, lens = batch.column(3)[row].values, batch.column(4)[row].values.to_numpy()
                block_words = batch.column(5)[row].values.to_numpy()
                ids = decoded(np.frombuffer(batch.column(6)[row].as_buffer(), "<u8"), block_words, n_ids).astype("<u4")
                at = np.r_[0, np.cumsum(lens)]
                raw = memoryview(ids).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lens), shard, np.int32)), doc_ids, pa.array(first_id + at[:-1]), pa.array(lens), pa.array(sums, pa.int64())],
                    names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    sizes = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    rows = segments.select("shard", "first_id", "n_ids", "doc_ids", "doc_lens", "block_words", "words").mapInArrow(decode, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(sizes, "shard").select("doc_id", (F.col("start") + F.col("earlier")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    path = new_path(docs.sparkSession, "ids")
    written(docs, path, tokenizer_path, end_id)
    return documents_of(docs.sparkSession, path)
