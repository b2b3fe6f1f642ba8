"""Operator 2: minimum-bin-slack packing of tokenised documents into fixed windows.

Every document is cut at multiples of the window's length, so all its pieces but the last fill a window.
The lengths of all pieces are counted (at most `capacity` counts, whatever the input's size). Windows are
planned on those counts alone: the largest length left opens a window, a bitset subset-sum over the
remaining multiset finds the fill closest to the capacity, backtracking gives the counts of each length, and
the pattern is repeated as often as the counts allow. Each piece then takes the place that its rank
among the pieces of its length has in the plan, so no task ever gathers pieces.

Defined results: a null or empty text is one piece that holds the end id alone; a null doc_id is kept;
repeated rows are packed each on their own; no documents give no rows; a very long text is encoded piece by piece and cut into
windows as any other; pieces of one length that tie for a place take it in the order of the tasks; other columns are ignored.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.llm.bpe import encoder, release
from quarterdeck.llm.storage import saved

CAPACITY = 1024
END_ID = 0

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth int"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenises whole texts and cuts them; nth counts a task's pieces of one length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode = encoder(tokenizer_path)
        for batch in batches:
            doc_ids = batch.column(0)
            for first, ids, at in encode(batch.column(1)):
                rows, starts, lengths, sums, totals = [], [], [], [], []
                for k in range(len(at) - 1):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    raw = memoryview(own).cast("B")
                    for start in range(0, len(own), capacity):
                        length = min(capacity, len(own) - start)
                        rows.append(first + k)
                        starts.append(start)
                        lengths.append(length)
                        sums.append(zlib.crc32(raw[4 * start : 4 * (start + length)]))
                        totals.append(len(own))
                size = np.array(lengths, np.int32)
                order = np.argsort(size, kind="stable")
                by_size = size[order]
                new = np.r_[True, by_size[1:] != by_size[:-1]]
                group = np.flatnonzero(new)
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - group[np.cumsum(new) - 1] + seen[by_size]
                seen += np.bincount(size, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(rows)), pa.array(starts, pa.int64()), pa.array(size), pa.array(sums, pa.int64()), pa.array(totals, pa.int64()), pa.array(np.full(len(size), part, np.int32)), pa.array(nth.astype(np.int32))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def closest_fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length make the largest sum up to room: bit s of a bitset tells if s can be reached."""
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        most = min(counts[length], room // length)
        layers.append((length, most, reach))
        left, step = most, 1
        while left:
            step = min(step, left)
            reach |= (reach << (length * step)) & mask
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, most, before in reversed(layers):
        for n in range(most + 1):
            if total >= n * length and before >> (total - n * length) & 1:
                if n:
                    used[length] = n
                total -= n * length
                break
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(windows, pieces of each length in every one of them), until nothing is left."""
    left, out = {x: n for x, n in counts.items() if n}, []
    while left:
        largest = max(left)
        left[largest] -= 1
        used = closest_fill(capacity - largest, left)
        left[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        out.append((times, used))
        for x, n in used.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
    return out


def places(windows: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first window, pieces in a window, offset of the first of them)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    window = 0
    for times, used in windows:
        offset = 0
        for length in sorted(used, reverse=True):
            out.setdefault(length, []).append((taken.get(length, 0), window, used[length], offset))
            taken[length] = taken.get(length, 0) + times * used[length]
            offset += used[length] * length
        window += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its window (sequence_id) and its place there (offset)."""
    cut, _ = saved(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = places(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(tokenizer_path)  # all is encoded
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                table = where[size]
                row = table[np.searchsorted(table[:, 0], rank[own], "right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + nth // row[:, 2]
                offset[own] = row[:, 3] + nth % row[:, 2] * size
            kept = [batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            kept[2] = kept[2].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # a task's share of the offsets is small, and two sorts would take a page of memory each in every task
    ranked = cut.join(offsets.drop("n").hint("shuffle_hash"), ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, PLACED)
