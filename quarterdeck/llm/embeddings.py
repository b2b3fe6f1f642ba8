"""Operator 6: near-duplicate vectors by collision counting over one-dimensional projections.

Vectors of one label and equal components are one class and go on as its representative. Unit vectors are
projected on PROJECTIONS random Gaussian directions. Two vectors collide on a projection if each lies in the window
of half-width WINDOW centred at the other. The vectors of a cell are sorted by the first projection, so that
a query's partners are a slice (of half-width REACH distances, which nearly all pairs keep to); collisions with the
slice are counted over all projections, and pairs with at least as many as calibration asks for are verified
by their cosine in double precision.

A label of at most CELL vectors is one cell. A larger one is dealt to cells several times: each time by the
shifted intervals of some projections, more of them the larger the label, so that cells stay about the same
size and the work grows about as the number of vectors. The number of times follows from RECALL. A pair
is counted only in the first cell that its vectors share. A cell that nothing splits is compared in pairs of blocks.

Calibration. Two vectors at the threshold differ by `distance`; on a Gaussian direction their difference is
normal with that deviation. That gives the chance of a collision, hence the count that a pair reaches with
probability COUNT_RECALL, and the chance to share an interval, hence the number of dealings.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and vectors with
a null label link with nothing (n_links 0, component_id their own vec_id, kept); vectors of different length don't link;
repeated rows link with each other; a label that is no integer is told by a 64-bit hash of its text; vectors of any
length do, one at a time being in memory whole; no vectors give no rows; other columns are ignored.

A group of near copies that no interval splits costs its square, because n_links counts every link and
most of its pairs lie near the threshold; its tiles are counted and verified densely, as matrix products.
"""

import hashlib
from collections.abc import Iterator
from functools import cache
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterdeck.llm.components import components
from quarterdeck.llm.groups import block_pairs, map_groups
from quarterdeck.llm.storage import removed, saved
from quarterdeck.llm.words import mixed

THRESHOLD = 0.98
PROJECTIONS = 32
#: Chance that a pair at the threshold is dealt to one cell, and that it then collides often enough.
RECALL, COUNT_RECALL = 0.999, 0.99999
#: Labels up to this number (16 bytes each) are broadcast with their sizes.
LABELS = 1 << 20
#: Vectors of a cell, and of one block of a cell that is larger than twice that.
CELL = 4096
#: Width of the intervals that deal large labels, in deviations of a random unit vector's projection.
INTERVAL = 2.0
#: Half-width of the slice and of the windows, in distances of two vectors at the threshold.
REACH, WINDOW = 4, 2
_FIRST = 8  # projections that are counted densely before pairs are listed
_DENSE = 16  # a tile with more than one pair in so many goes on densely


def distance(threshold: float) -> float:
    return sqrt(2 - 2 * threshold)


def window(threshold: float) -> float:
    return WINDOW * distance(threshold)


def collisions_needed(m: int = PROJECTIONS, recall: float = COUNT_RECALL) -> int:
    """The count that a pair at the threshold reaches with the given probability."""
    p, tail = erf(WINDOW / sqrt(2)), 0.0
    for count in range(m, -1, -1):
        tail += comb(m, count) * p**count * (1 - p) ** (m - count)
        if tail >= recall:
            return count
    return 0


def dealing(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(projections of a cell's key, times that a label of n vectors is dealt)."""
    if n <= CELL:
        return 0, 1
    # chance that two random vectors, and that two at the threshold, share a shifted interval
    d = INTERVAL / sqrt(2)
    apart = erf(d / sqrt(2)) - 2 / (sqrt(2 * pi) * d) * (1 - exp(-d * d / 2))
    d = INTERVAL / distance(threshold)
    near = erf(d / sqrt(2)) - 2 / (sqrt(2 * pi) * d) * (1 - exp(-d * d / 2))
    keys = min(PROJECTIONS, ceil(log(n / CELL) / log(1 / apart)))
    return keys, ceil(log(1 - recall) / log(1 - near**keys))


@cache
def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, PROJECTIONS))


def units(raw: list[bytes]) -> np.ndarray:
    """Rows of unit vectors in double precision; the largest component is scaled first, so nothing over- or underflows."""
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classed(vectors: DataFrame) -> DataFrame:
    """uid, vec_id, label, dim, two keys of the components (null if it can't link) and the components as doubles."""
    values = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & F.coalesce(F.size(values) > 0, F.lit(False)) & ~F.coalesce(F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) & F.coalesce(F.exists(values, lambda x: x != 0), F.lit(False))
    whole = isinstance(vectors.schema["label"].dataType, T.IntegralType)
    label = F.col("label").cast("long") if whole else F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string")))
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.when(usable, values).alias("x"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # -0 becomes 0
            sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            ends = np.cumsum(sizes)
            raw = [flat[e - n : e].tobytes() if n else None for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            sums = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in raw]
            keys = [pa.array([int.from_bytes(s[a : a + 8], "big", signed=True) if s else None for s in sums], pa.int64()) for a in (0, 8)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(sizes, pa.int32()), *keys, pa.array(raw, pa.binary())], names=["uid", "vec_id", "label", "dim", "key1", "key2", "x"])

    return rows.mapInArrow(keyed, "uid long, vec_id long, label long, dim int, key1 long, key2 long, x binary")


def cells(reps: DataFrame, threshold: float) -> DataFrame:
    """(uid, cell, nth, earlier) for each dealing of each vector; earlier has the cells of the dealings before."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, label, dim, n = (batch.column(k).to_numpy() for k in range(4))
            plans = [dealing(int(x), threshold) for x in n]
            for d, (keys, times) in sorted({(int(a), b) for a, b in zip(dim, plans, strict=True)}):
                own = np.array([k for k in range(len(uid)) if dim[k] == d and plans[k] == (keys, times)])
                projected = np.einsum("ij,jk->ik", units(batch.column(4).take(pa.array(own)).to_pylist()), directions(d))
                base = mixed(mixed(label[own].astype(np.uint64)) + np.uint64(d))
                found = np.empty((len(own), times), "<u8")
                for t in range(times):
                    rng = np.random.default_rng([d, t])
                    used, shift = rng.permutation(PROJECTIONS)[:keys], rng.random(PROJECTIONS) * INTERVAL
                    cell = mixed(base ^ np.uint64(t + 1))
                    for j in used.tolist():
                        cell = mixed(cell ^ np.floor((projected[:, j] + shift[j]) / INTERVAL).astype(np.int64).astype(np.uint64))
                    found[:, t] = cell
                for t in range(times):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(uid[own]), pa.array(found[:, t].view(np.int64) if times == 1 else np.ascontiguousarray(found[:, t]).view(np.int64)), pa.array([x.tobytes() for x in found[:, :t]], pa.binary())],
                        names=["uid", "cell", "earlier"],
                    )

    return reps.select("uid", "label", "dim", "n", "x").mapInArrow(deal, "uid long, cell long, earlier binary")


def colliding_pairs(projected: np.ndarray, side: np.ndarray, half: float, needed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Pairs of rows (of the two sides, if there are two) with enough collisions: lists of both rows, or, where
    most of a tile collides, the tile's rows and columns and a mask of pairs."""
    order = np.argsort(projected[:, 0], kind="stable")
    p, of = np.ascontiguousarray(projected[order].T), side[order]
    two = bool(side.any())
    last = np.searchsorted(p[0], p[0] + half * REACH / WINDOW, "right")
    for first in range(0, len(order), 256):
        rows = slice(first, min(first + 256, len(order)))
        end = int(last[rows].max())

        def collisions(j: int, rows=rows, first=first, end=end) -> np.ndarray:
            return np.abs(p[j, rows, None] - p[j, None, first:end]) <= half

        count = np.zeros((rows.stop - first, end - first), np.int8)
        for j in range(_FIRST):
            count += collisions(j)
        enough = count >= needed - (PROJECTIONS - _FIRST)
        enough &= np.arange(first, end)[None, :] > np.arange(first, rows.stop)[:, None]
        if two:
            enough &= of[rows, None] != of[None, first:end]
        if int(enough.sum()) > enough.size // _DENSE:
            for j in range(_FIRST, PROJECTIONS):
                count += collisions(j)
            yield order[rows], order[first:end], enough & (count >= needed)
            continue
        a, b = np.nonzero(enough)
        for k in range(0, len(a), 1 << 18):
            i, j = a[k : k + (1 << 18)] + first, b[k : k + (1 << 18)] + first
            total = (np.abs(p[:, i] - p[:, j]) <= half).sum(axis=0)
            keep = total >= needed
            yield order[i[keep]], order[j[keep]], None


class Roots:
    """The smallest row that links lead to, link by link."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:  # the smaller root of each link, and of that root, until nothing changes
            new = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        self.root = root

    def join_tile(self, rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> None:
        """A row's links all get one root; in a dense tile few rows still bring a new one."""
        for r in np.flatnonzero(linked.any(axis=1)).tolist():
            found = self.root[columns[linked[r]]]
            own = self.root[rows[r]]
            if (found != own).any():
                met = np.unique(np.r_[found, own])
                self.root[np.isin(self.root, met)] = met[0]


def _cell_links(threshold: float):
    half, needed = window(threshold), collisions_needed()

    def each(group: pa.RecordBatch) -> dict | None:
        """Keys cell, i, j; then uid, side, weight, earlier, x. Rows (uid, links, root): weight of links, local root."""
        if group.num_rows < 2:
            return None
        uid, side, weight = (group.column(k).to_numpy() for k in (3, 4, 5))
        x = units(group.column(7).to_pylist())
        earlier = group.column(6).to_pylist()
        before = np.frombuffer(b"".join(earlier), "<u8").reshape(len(uid), -1)
        links, roots, a, b = np.zeros(len(uid)), Roots(len(uid)), [], []
        for i, j, near in colliding_pairs(x @ directions(x.shape[1]), side, half, needed):
            if near is not None:
                cosine = x[i] @ x[j].T
                close = np.argwhere(near & (np.abs(cosine - threshold) < 1e-9))  # decided by the same sum as elsewhere
                near &= cosine >= threshold
                if len(close):
                    near[close[:, 0], close[:, 1]] = np.einsum("ij,ij->i", x[i[close[:, 0]]], x[j[close[:, 1]]]) >= threshold
                for t in range(before.shape[1]):
                    near &= before[i, t][:, None] != before[j, t][None, :]
                links[i] += near @ weight[j]
                np.add.at(links, j, weight[i] @ near)
                roots.join_tile(i, j, near)
                continue
            near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[near], j[near]
            fresh = ~(before[i] == before[j]).any(axis=1) if before.shape[1] else np.ones(len(i), bool)
            i, j = i[fresh], j[fresh]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            a.append(i)
            b.append(j)
        if a:
            roots.join(np.concatenate(a), np.concatenate(b))
        own = np.flatnonzero(links)
        if not len(own):
            return None
        return {"uid": uid[own], "links": links[own], "root": uid[roots.root[own]]}

    return each


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows, _ = saved(classed(vectors), "vectors")
    full = rows.where("key1 IS NOT NULL")
    classes = full.groupBy("label", "key1", "key2").agg(F.min("uid").alias("uid"), F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("weight"))
    classes, _ = saved(classes, "classes")
    reps = full.select("uid", "label", "dim", "x").join(classes.select("uid", "weight"), "uid")
    reps, reps_path = saved(reps, "representatives")
    sizes = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sizes, sizes_path = saved(sizes, "label-sizes")
    if sizes.count() <= LABELS:  # a label may hold most rows: they then stay where they are
        sizes = F.broadcast(sizes)
    dealt, dealt_path = saved(cells(reps.join(sizes, "label"), threshold), "cells")
    counts = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.when(F.col("n") <= 2 * CELL, F.lit(1)).otherwise(F.ceil(F.col("n") / CELL)).cast("long").alias("blocks")
    found = dealt.join(counts.select("cell", blocks), "cell").join(reps.select("uid", "weight", "x"), "uid")
    pairs = block_pairs(found, "blocks", "uid").select("cell", "i", "j", "uid", "side", "weight", "earlier", "x")
    links, links_path = saved(map_groups(pairs, ["cell", "i", "j"], _cell_links(threshold), "uid long, links double, root long"), "links")
    removed(spark, reps_path, dealt_path, sizes_path)
    groups = components(links.where("uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("uid").agg(F.sum("links").cast("long").alias("links"))
    by_class = classes.join(counted, "uid", "left").join(groups.withColumnRenamed("id", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    smallest = by_class.groupBy("root").agg(F.min("class_id").alias("component_id"))
    by_class = by_class.join(smallest, "root").select("label", "key1", "key2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "label", "key1", "key2").join(by_class, ["label", "key1", "key2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
