"""Operator 11: nearest neighbours by largest inner product through an inverted multi-index.

Each half of the vectors is quantised by a codebook of its own, so K centroids a half make K * K cells. A query's inner
product with a half's centroids falls short of the best one by a distance; centroid pairs are traversed in order of the
two distances' sum, by a heap, until the cells hold the budgeted number of entries. The entries of the cells traversed
are reranked by their inner product in double precision.

Fit. At most SAMPLE rows, drawn by a hash of the whole row, train the codebooks (Lloyd's iterations) and calibrate the budget:
the share of all entries after which a query has met the cell of a near neighbour, at the TARGET share of neighbours, with as
many neighbours a query as keeps their depth that of `nearest` among all rows. On vectors without structure that share is large
and the work grows with queries times rows, as for any index; on clustered ones it is small. Every row is indexed.

Distribution. Cells in order are cut into parts of about equal numbers of entries; a cell larger than a part is dealt to
several by row, so no cell, however hot, is more than its share of a task. A query goes once to each part that holds a cell
it traversed, with a bit for each of the part's cells. A task holds one part's entries and streams the queries past them.
Through the driver go the sample, the counts of the cells (K * K at most) and of the vector lengths.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, neither ask nor are found;
vectors are compared with those of their own length; a repeated row is a candidate, and a query, of its own; a null vec_id asks
nothing and is found last among ties; equal scores go by vec_id, then by place; an empty table gives no rows; a vector of any length
is in memory whole; other columns are ignored, whatever their names.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterdeck.llm.storage import saved

NEAREST, EVERY = 20, 20
#: Rows at most that the index is fitted on, and those of them that calibrate it.
SAMPLE, PROBES = 16_384, 512
TARGET = 0.95
#: Centroids of a half at most; entries of a cell on average, where that allows it; entries of a part at most.
CENTROIDS, CELL, PART = 256, 12, 32_768
#: Parts at least, so that small tables keep several executors busy.
PARTS = 16


@dataclass
class Index:
    """Codebooks of the two halves, entries by cell, and the places of cells in parts."""

    first: np.ndarray
    second: np.ndarray
    share: float = 1.0
    sizes: np.ndarray | None = None
    part: np.ndarray | None = None  # the first part of each cell
    blocks: np.ndarray | None = None  # the parts that a cell is dealt to
    ranges: list[tuple[int, int, int]] | None = None  # (part, first cell, cell after the last)

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = x.shape[1] // 2
        own = [(y @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1) for y, c in ((x[:, :half], self.first), (x[:, half:], self.second))]
        return own[0] * len(self.second) + own[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        near = [y @ c.T for y, c in ((x[:, :half], self.first), (x[:, half:], self.second))]
        return tuple(y.max(axis=1, keepdims=True) - y for y in near)


def centroids(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    """Lloyd's iterations from distinct rows; an empty centroid moves to a random row."""
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds if len(distinct) > k else 0):
        own = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        n = np.bincount(own, minlength=len(c))
        sums = np.add.reduceat(x[order], np.minimum(np.r_[0, np.cumsum(n)[:-1]], len(x) - 1), axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(c))])
    return c


def fitted(sample: np.ndarray, n: int, nearest: int, target: float, seed: int = 11) -> Index:
    """Codebooks from the sample and the share of entries that a query traverses; n is the number of all rows."""
    if sample.shape[1] < 2 or len(sample) < 64:  # one cell, of all rows
        dim = sample.shape[1]
        return Index(np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))
    rng, half = np.random.default_rng(seed), sample.shape[1] // 2
    k = int(np.clip(np.sqrt(n / CELL), 4, min(CENTROIDS, len(sample) // 8)))
    index = Index(centroids(sample[:, :half], k, rng), centroids(sample[:, half:], k, rng))
    probes = rng.permutation(len(sample))[:PROBES]
    depth = max(1, -(-nearest * len(sample) // n))
    scores = sample[probes] @ sample.T
    scores[np.arange(len(probes)), probes] = -np.inf
    near = np.argpartition(-scores, min(depth, len(sample) - 1) - 1, axis=1)[:, :depth]
    own = index.cells(sample)
    sizes = np.bincount(own, minlength=len(index.first) * len(index.second))
    needs = []
    for row in range(len(probes)):
        d1, d2 = index.distances(sample[probes[row] : probes[row] + 1])
        total = (d1[0][:, None] + d2[0][None, :]).ravel()
        order = np.argsort(total, kind="stable")
        met = np.empty(len(order))
        met[order] = np.cumsum(sizes[order]) / len(sample)
        needs.append(met[own[near[row]]])
    index.share = float(np.quantile(np.concatenate(needs), target))
    return index


def placed(index: Index, sizes: np.ndarray, part_rows: int, first_part: int) -> int:
    """Cuts the cells into parts of about part_rows entries; returns the number of the part after them."""
    index.sizes, index.part, index.blocks, index.ranges = sizes, np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), []
    part, start, held = first_part, 0, 0
    for cell, size in enumerate(sizes.tolist()):
        if size > part_rows:
            if start < cell:
                index.ranges.append((part, start, cell))
                part += 1
            n = -(-size // part_rows)
            index.part[cell], index.blocks[cell] = part, n
            index.ranges += [(part + i, cell, cell + 1) for i in range(n)]
            part, start, held = part + n, cell + 1, 0
            continue
        if held + size > part_rows:
            index.ranges.append((part, start, cell))
            part, start, held = part + 1, cell, 0
        index.part[cell] = part
        held += size
    if start < len(sizes):
        index.ranges.append((part, start, len(sizes)))
        part += 1
    return part


def traversed(d1: np.ndarray, d2: np.ndarray, sizes: list[int], budget: int) -> list[int]:
    """Cells by the sum of the distances of their two centroids, until they hold the budgeted entries.

    A row of the sorted table enters the heap when the row above is first taken, a cell when its left neighbour is."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, n2 = d1[o1].tolist(), d2[o2].tolist(), len(d2)
    rows, columns = (o1 * n2).tolist(), o2.tolist()
    heap, out, seen = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and seen < budget:
        _, a, b = heap[0]
        cell = rows[a] + columns[b]
        out.append(cell)
        seen += sizes[cell]
        if b + 1 < n2:
            heapreplace(heap, (s1[a] + s2[b + 1], a, b + 1))
        else:
            heappop(heap)
        if b == 0 and a + 1 < len(s1):
            heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))
    return out


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)


def usable(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, dim, x) of the vectors that take part, and numpy's name of their components' type."""
    single = isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    x = F.col("embedding").cast("array<float>" if single else "array<double>")
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(whole, x).alias("x")).where("x IS NOT NULL")
    return rows.select("vec_id", F.size("x").alias("dim"), "x"), "<f4" if single else "<f8"


def _flat(column: pa.Array, kind: str) -> list[bytes]:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    ends = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].tolist()
    return [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def built(rows: DataFrame, kind: str, nearest: int, target: float) -> dict[int, Index]:
    """An index for each vector length, fitted on a hashed sample."""
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return {}
    drawn = rows if total <= SAMPLE else rows.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 30)) < int(SAMPLE / total * (1 << 30)))
    found = drawn.limit(SAMPLE + SAMPLE // 8).toArrow()
    dims = np.asarray(found["dim"])
    raw = _flat(found["x"].combine_chunks(), kind) if found.num_rows else []
    out = {}
    for dim, n in sorted(counts.items()):
        own = np.flatnonzero(dims == dim)
        sample = _matrix([raw[i] for i in own.tolist()], kind) if len(own) else np.zeros((0, dim))
        out[dim] = fitted(sample, n, nearest, target)
    return out


def coded(rows: DataFrame, kind: str, indexes: dict[int, Index]) -> DataFrame:
    """(uid, vec_id, dim, cell, x): x as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = _flat(batch.column(3), kind), batch.column(2).to_numpy()
            cell = np.zeros(len(raw), np.int32)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                cell[own] = indexes[dim].cells(_matrix([raw[i] for i in own.tolist()], kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell), pa.array(raw, pa.binary())], names=["uid", "vec_id", "dim", "cell", "x"])

    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "dim", "x").mapInArrow(run, "uid long, vec_id long, dim int, cell int, x binary")


def _dealt(batches: Iterator[pa.RecordBatch], indexes: dict[int, Index]) -> Iterator[pa.RecordBatch]:
    """Entries with their part, and the cell's number within it."""
    for batch in batches:
        uid, dims, cell = (batch.column(k).to_numpy() for k in (0, 2, 3))
        part, low = np.zeros(len(uid), np.int32), np.zeros(len(uid), np.int64)
        for dim in np.unique(dims).tolist():
            own, index = np.flatnonzero(dims == dim), indexes[dim]
            starts = {p: a for p, a, _ in index.ranges}
            mixed = (uid[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            part[own] = index.part[cell[own]] + (mixed % index.blocks[cell[own]].astype(np.uint64)).astype(np.int64)
            low[own] = [starts[p] for p in part[own].tolist()]
        none = pa.nulls(len(uid), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(uid), np.int32)), batch.column(0), batch.column(1), batch.column(4), pa.array((cell - low).astype(np.int32)), none], names=_NAMES)


def _asked(batches: Iterator[pa.RecordBatch], indexes: dict[int, Index], kind: str, nearest: int) -> Iterator[pa.RecordBatch]:
    """Queries, once for each part that holds a cell they traverse, with a bit for each of its cells."""
    lists = {dim: index.sizes.tolist() for dim, index in indexes.items()}
    for batch in batches:
        raw, dims, rows = batch.column(4).to_pylist(), batch.column(2).to_numpy(), []
        for dim in np.unique(dims).tolist():
            own, index = np.flatnonzero(dims == dim), indexes[dim]
            budget = max(int(np.ceil(index.share * index.sizes.sum())), nearest + 1)
            d1, d2 = index.distances(_matrix([raw[i] for i in own.tolist()], kind))
            for k, i in enumerate(own.tolist()):
                met = np.zeros(len(index.sizes), bool)
                met[traversed(d1[k], d2[k], lists[dim], budget)] = True
                met &= index.sizes > 0
                rows += [(p, i, np.packbits(met[a:b]).tobytes()) for p, a, b in index.ranges if met[a:b].any()]
        for first in range(0, len(rows), 20_000):
            part, at, bits = zip(*rows[first : first + 20_000], strict=True)
            own = pa.array(at, pa.int64())
            one = pa.array(np.ones(len(at), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), one, batch.column(0).take(own), batch.column(1).take(own), batch.column(4).take(own), one, pa.array(bits, pa.binary())], names=_NAMES)


_NAMES = ["part", "asks", "uid", "vec_id", "x", "cell", "bits"]
_ROUTED = "part int, asks int, uid long, vec_id long, x binary, cell int, bits binary"
_FOUND = "query_uid long, query_id long, vec_id long, uid long, score double"


def _best(x: np.ndarray, uid: np.ndarray, ids: np.ndarray, asking: np.ndarray, own: np.ndarray, open_: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of each query's nearest among the entries open to it."""
    near = np.where(open_, asking @ x.T, -np.inf)
    near[own[:, None] == uid[None, :]] = -np.inf
    if near.shape[1] > nearest:
        last = -np.partition(-near, nearest - 1, axis=1)[:, nearest - 1]
        size = np.sqrt((asking * asking).sum(axis=1) * (x * x).sum(axis=1).max())
        near[near < (last - 1e-9 * size)[:, None]] = -np.inf  # what rounding may still reorder stays
    q, e = np.nonzero(near > -np.inf)
    score = np.einsum("ij,ij->i", asking[q], x[e])
    order = np.lexsort((uid[e], ids[e], -score, q))
    q, e, score = q[order], e[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    kept = place < nearest
    return q[kept], e[kept], score[kept]


def _reranked(batches: Iterator[pa.RecordBatch], kind: str, nearest: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, entries before queries: the entries of a part are held, queries pass by."""
    current, held, x = None, [], None
    for whole in batches:
        parts, asks = whole.column(0).to_numpy(), whole.column(1).to_numpy()
        cuts = np.r_[0, np.flatnonzero((parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])) + 1, len(parts)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            if parts[a] != current:
                current, held, x = parts[a], [], None
            piece = whole.slice(a, b - a)
            if not asks[a]:
                held.append(piece)
                continue
            if x is None:
                if not held:  # a dealt cell may leave one of its parts empty
                    continue
                entries = pa.Table.from_batches(held)
                x, uid, cell = _matrix(entries["x"].to_pylist(), kind), np.asarray(entries["uid"]), np.asarray(entries["cell"])
                ids = np.asarray(entries["vec_id"].fill_null(np.iinfo(np.int64).max))
                given = entries["vec_id"].combine_chunks()
                held = []
            for first in range(0, piece.num_rows, 128):
                some = piece.slice(first, 128)
                met = np.unpackbits(np.frombuffer(b"".join(some.column(6).to_pylist()), np.uint8).reshape(some.num_rows, -1), axis=1)
                q, e, score = _best(x, uid, ids, _matrix(some.column(4).to_pylist(), kind), some.column(2).to_numpy(), met[:, cell] == 1, nearest)
                at = pa.array(q)
                yield pa.RecordBatch.from_arrays([some.column(2).take(at), some.column(3).take(at), given.take(pa.array(e)), pa.array(uid[e]), pa.array(score)], names=["query_uid", "query_id", "vec_id", "uid", "score"])


def searched(vectors: DataFrame, nearest: int = NEAREST, every: int = EVERY, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row whose vec_id is divisible by `every`."""
    rows, kind = usable(vectors)
    indexes = built(rows, kind, nearest, target)
    entries, _ = saved(coded(rows, kind, indexes), "multi-index")
    sizes = {dim: np.zeros(len(i.first) * len(i.second), np.int64) for dim, i in indexes.items()}
    for r in entries.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["dim"]][r["cell"]] = r["n"]
    part_rows = max(1, min(PART, -(-sum(int(s.sum()) for s in sizes.values()) // PARTS)))
    parts = 0
    for dim, index in sorted(indexes.items()):
        parts = placed(index, sizes[dim], part_rows, parts)
    asking = entries.where(F.col("vec_id") % every == 0)
    routed = entries.mapInArrow(partial(_dealt, indexes=indexes), _ROUTED).unionByName(asking.mapInArrow(partial(_asked, indexes=indexes, kind=kind, nearest=nearest), _ROUTED))
    found = routed.repartition(max(parts, 1), "part").sortWithinPartitions("part", "asks").mapInArrow(partial(_reranked, kind=kind, nearest=nearest), _FOUND)
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
