"""Groups of rows that a sorted partition holds one after the other, read from its Arrow batches."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consecutive(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Yields the rows of each key (the first n_keys columns, of integers) as one batch; the rows arrive sorted by key."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(n_keys)])
        cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = tuple(keys[:, a].tolist())
            if own != key and held:
                yield _joined(held)
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def map_groups(df: DataFrame, keys: list[str], each: Callable[[pa.RecordBatch], dict | None], schema: str, rows: int = 20_000) -> DataFrame:
    """Calls each on every group's rows; it returns columns of the schema (or None), which are gathered into batches."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")]
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([np.asarray(p[x]) for p in parts]), t) for x, t in zip(names, types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for group in consecutive(batches, n_keys):
            found = each(group)
            if found is not None and len(found[names[0]]):
                parts.append(found)
                held += len(found[names[0]])
                if held >= rows:
                    yield flushed()
                    parts, held = [], 0
        if parts:
            yield flushed()

    others = [c for c in df.columns if c not in keys]
    return df.select(*keys, *others).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def block_pairs(rows: DataFrame, blocks: str, item: str) -> DataFrame:
    """Deals each group's rows to blocks by a hash of item and repeats a row for each pair of blocks (i <= j) with its own; side tells which of two it is in."""
    own = F.pmod(F.xxhash64(item), F.col(blocks)).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return rows.withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("own", "other", blocks)


def local_roots(adjacent: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component in a small symmetric boolean matrix."""
    root = np.arange(len(adjacent))
    while True:
        nearest = np.where(adjacent, root[None, :], len(root)).min(axis=1)
        new = np.minimum(root, nearest)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new
