"""Operator 10: Jaccard join of word n-gram sets by chosen paths.

Sets. A document is the set of its five-word shingles. Documents with equal sets are one class and go on as
its representative, so copies are never expanded into pairs.

Chosen paths. A set's signature has WIDTH minwise tokens. In each of RUNS independent runs every set goes from
a bucket to the child buckets of those of its tokens that a hash of run, path and token picks with
probability 1 / (THRESHOLD * WIDTH): two sets meet in a child through a shared token, so similar sets stay
together along some path and others part. A bucket of at most BUCKET sets is compared by brute force; a
larger one is split again, at most DEPTH times, and what is then still large is compared in pairs of
blocks. In a large bucket all sets are first held against one pivot: those very near to it leave with an edge to
it, and everything that could be linked to such a set gets an edge to the pivot too (by the triangle inequality
of the Jaccard distance), so a big group of near copies costs its size and not its square. The chance
that two sets at the threshold share no bucket in any run is below 1 - RECALL.

Verification. The buckets' candidate links (by signature) are gathered into candidate clusters. Within a
cluster the exact sets are compared, in pairs of blocks for a large cluster; exact links are counted
per class and hung on local roots, and connected components of those give the groups.

Defined results: a text of one to four words is one shingle of all its words; a null, empty or wordless text
links with nothing and stays; a null doc_id is kept as null and is the smallest of a group only if all are;
repeated rows are copies of each other; words are folded by Unicode's lower case, so texts that differ in case or punctuation
alone are one class; shingles are 64-bit hashes; no documents give no rows; a very long text is one set, in memory of about
40 bytes for each of its own; other columns are ignored.
"""

from collections.abc import Iterator
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.components import components
from quarterdeck.llm.groups import block_pairs, local_roots, map_groups
from quarterdeck.llm.storage import removed, saved
from quarterdeck.llm.words import SHINGLE, chunks, mixed, shingle_sets, text_buffer, word_hashes, words

THRESHOLD = 0.8
WIDTH = 64
BUCKET = 512
DEPTH = 3
RECALL = 0.99
#: Estimated similarity from which a pair is a candidate: four standard deviations below the threshold.
CANDIDATE = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / WIDTH) ** 0.5
#: Estimated similarity to a pivot at which a set leaves a large bucket, and at which it gets an edge.
LEAVES, NEAR = 0.93, 0.45
#: Large buckets up to this number (16 bytes each) are broadcast with their sizes.
HOT_BUCKETS = 1 << 20
#: So are their pivots with signatures (280 bytes each).
HOT_PIVOTS = 1 << 17
#: Sets and shingles of one block of a cluster.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000

_SEEDS = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def runs_needed(threshold: float = THRESHOLD, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Runs until two sets at the threshold meet with the given chance: paths branch as a Poisson process of mean 1."""
    q = 1.0
    for _ in range(depth):
        q = 1 - exp(-q)
    return ceil(log(1 - recall) / log(1 - q))


def _sets_of(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingles of each row, in chunks of rows."""
    data, offsets = text_buffer(column)
    for first, last in chunks(offsets):
        found = words(data, offsets[first : last + 1])
        shingles, at = shingle_sets(word_hashes(found), found.bounds, n)
        yield first, [np.unique(shingles[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def signatures(docs: DataFrame, n: int = SHINGLE, row: str | None = None) -> DataFrame:
    """uid (column row, if given), doc_id, text_hash, the set's two keys and size, and its signature; keys are null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _sets_of(batch.column(3), n):
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                key1, key2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                tokens = np.zeros((len(sets), WIDTH), "<u4")
                if len(full):
                    joined, at = np.concatenate(sets), np.r_[0, np.cumsum(sizes[full])[:-1]]
                    key1[full] = np.add.reduceat(mixed(joined), at)
                    key2[full] = np.add.reduceat(mixed(joined ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for k in range(WIDTH):
                        tokens[full, k] = np.minimum.reduceat(joined * _SEEDS[k], at) >> np.uint64(32)
                empty = sizes == 0
                rows = [batch.column(k).slice(first, len(sets)) for k in range(3)]
                keys = [pa.array(k.view(np.int64), mask=empty) for k in (key1, key2)]
                yield pa.RecordBatch.from_arrays([*rows, *keys, pa.array(sizes.astype(np.int32)), pa.array([t.tobytes() for t in tokens], pa.binary())], names=["uid", "doc_id", "text_hash", "key1", "key2", "size", "tokens"])

    rows = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sign, "uid long, doc_id long, text_hash long, key1 long, key2 long, size int, tokens binary")


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, WIDTH)


def children(rows: DataFrame, threshold: float, runs: int | None = None) -> DataFrame:
    """(uid, bucket) of the children of each row's bucket; from the root of each run if runs is given."""
    limit = np.uint64(int(2**64 / (threshold * WIDTH)))
    place = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                uid, tokens = part.column(0).to_numpy(), _tokens(part.column(1)).astype(np.uint64)
                if runs is None:
                    parents = [part.column(2).to_numpy().view(np.uint64)]
                else:
                    parents = [np.full(len(uid), x) for x in mixed(np.arange(1, runs + 1, dtype=np.uint64) << np.uint64(32))]
                for parent in parents:
                    path = mixed(tokens * np.uint64(0x9FB21C651E98DF25) + place ^ parent[:, None])
                    row, k = np.nonzero(path < limit)
                    yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(mixed(path[row, k] ^ np.uint64(0xA0761D6478BD642F)).view(np.int64))], names=["uid", "bucket"])

    columns = ["uid", "tokens"] + ([] if runs else ["bucket"])
    return rows.select(*columns).mapInArrow(split, "uid long, bucket long")


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal tokens of each row of a and each of b."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(WIDTH):
        out += a[:, k, None] == b[None, :, k]
    return out / WIDTH


def _bucket_edges(candidate: float):
    def each(group: pa.RecordBatch) -> dict | None:
        """Keys bucket, i, j; then uid, side, tokens. Edges from each set to its local root."""
        if group.num_rows < 2:
            return None
        uid, side = group.column(3).to_numpy(), group.column(4).to_numpy()
        tokens = _tokens(group.column(5))
        if len(uid) == 2:
            if (tokens[0] == tokens[1]).mean() < candidate:
                return None
            return {"a": uid[:1], "b": uid[1:]}
        near = similar(tokens, tokens) >= candidate
        if side.any():
            near &= side[:, None] != side[None, :]
        root = local_roots(near)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return {"a": uid[moved], "b": uid[root[moved]]}

    return each


def candidate_edges(reps: DataFrame, threshold: float, candidate: float, recall: float) -> tuple[DataFrame, list[str]]:
    """Edges (a, b) between representatives that some bucket shows to be near."""
    edges, paths = [], []
    frontier = children(reps, threshold, runs_needed(threshold, DEPTH, recall))
    for depth in range(1, DEPTH + 1):
        rows, path = saved(frontier, "paths")
        paths.append(path)
        sizes, path = saved(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        paths.append(path)
        hot = sizes.where(F.col("n") > BUCKET)
        if hot.count() <= HOT_BUCKETS:  # their rows then stay where they are; beyond, Spark splits the join's large keys
            hot = F.broadcast(hot)
        cold = rows.join(hot, "bucket", "left_anti").join(sizes.where(F.col("n") <= BUCKET), "bucket")
        rows = rows.join(hot, "bucket").unionByName(cold)
        rows, path = saved(rows.join(reps.select("uid", "tokens"), "uid"), "buckets")
        paths.append(path)
        large = rows.where(F.col("n") > BUCKET)
        at_end = depth == DEPTH
        whole = rows.where(F.col("n") <= BUCKET).withColumn("blocks", F.lit(1).cast("long"))
        done = large.isEmpty()
        if not done:
            pivots, path = saved(large.groupBy("bucket").agg(F.min(F.struct("uid", "tokens")).alias("p")).select("bucket", F.col("p.uid").alias("pivot"), F.col("p.tokens").alias("pivot_tokens")), "pivot-sets")
            paths.append(path)
            if pivots.count() <= HOT_PIVOTS:
                pivots = F.broadcast(pivots)
            held = large.join(pivots, "bucket")
            held, path = saved(against_pivot(held), "pivots")
            paths.append(path)
            edges.append(held.where((F.col("share") >= NEAR) & (F.col("uid") != F.col("pivot"))).select(F.col("uid").alias("a"), F.col("pivot").alias("b")))
            large = held.where((F.col("share") < LEAVES) | (F.col("uid") == F.col("pivot")))
            if at_end:
                whole = whole.unionByName(large.select("uid", "bucket", "n", "tokens", F.ceil(F.col("n") / BUCKET).alias("blocks")))
        found = block_pairs(whole.select("uid", "bucket", "tokens", "blocks"), "blocks", "uid")
        edges.append(map_groups(found.select("bucket", "i", "j", "uid", "side", "tokens"), ["bucket", "i", "j"], _bucket_edges(candidate), "a long, b long"))
        if done or at_end:
            break
        frontier = children(large, threshold)
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out, paths


def against_pivot(held: DataFrame) -> DataFrame:
    """Adds the share of tokens that each row has in common with its bucket's pivot."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = (_tokens(batch.column(3)) == _tokens(batch.column(5))).mean(axis=1) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(share, pa.float64())], names=["uid", "bucket", "n", "tokens", "pivot", "share"])

    return held.select("uid", "bucket", "n", "tokens", "pivot", "pivot_tokens").mapInArrow(compare, "uid long, bucket long, n long, tokens binary, pivot long, share double")


def _cluster_links(threshold: float):
    def each(group: pa.RecordBatch) -> dict | None:
        """Keys root, i, j; then uid, side, weight, shingles. Rows (uid, links, root): weight of exact links, local root."""
        uid, at = np.unique(group.column(3).to_numpy(), return_index=True)
        if len(uid) < 2:
            return None
        side, weight = group.column(4).to_numpy()[at], group.column(5).to_numpy()[at]
        sets = [np.frombuffer(x, "<u8") for x in group.column(6).take(pa.array(at)).to_pylist()]
        sizes = np.array([len(s) for s in sets])
        if len(uid) == 2:
            shared = np.zeros((2, 2))
            shared[0, 1] = shared[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        else:
            row = np.repeat(np.arange(len(sets)), sizes)
            _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]
            row, column = row[column >= 0], column[column >= 0]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            shared = np.zeros((len(sets), len(sets)), np.float32)
            step = max(256, 4_000_000 // len(sets))
            for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
                a, b = np.searchsorted(column, [first, first + step])
                part = np.zeros((len(sets), step), np.float32)
                part[row[a:b], column[a:b] - first] = 1
                shared += part @ part.T
        linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
        np.fill_diagonal(linked, False)
        if side.any():
            linked &= side[:, None] != side[None, :]
        root = local_roots(linked)
        return {"uid": uid, "links": linked @ weight, "root": uid[root]}

    return each


def shingle_rows(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """members with their exact sets (sorted 64-bit shingle hashes) in column shingles.

    Rows that repeat a member's doc_id and text come one after the other from the merge join; a task passes on the first.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            uid = batch.column(0).to_numpy()
            fresh = np.r_[uid[0] != last, uid[1:] != uid[:-1]]
            last = uid[-1]
            if not fresh.all():
                batch = batch.filter(pa.array(fresh))
            for first, sets in _sets_of(batch.column(4), n):
                rows = [batch.column(k).slice(first, len(sets)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["uid", "root", "weight", "blocks", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    same = texts["doc_id"].eqNullSafe(members["doc_id"]) & (texts["text_hash"] == members["text_hash"])
    # always a merge join: it moves the texts once, in proportion to the input, at every size
    found = texts.join(members.hint("merge"), same).select("uid", "root", "weight", "blocks", "text")
    return found.mapInArrow(gather, "uid long, root long, weight long, blocks long, shingles binary")


def joined(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, recall: float = RECALL, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), n_links (other documents linked
    directly, copies included), component_id (smallest doc_id reachable by links), kept (it is that document).

    row names a column of docs with a different long in each row. It is put in front of the result, and kept is then
    true for one row of each group only: that of the smallest doc_id (null is the largest), and of these of the smallest row."""
    spark = docs.sparkSession
    candidate = threshold - 4 * (threshold * (1 - threshold) / WIDTH) ** 0.5
    signed, signed_path = saved(signatures(docs, n, row), "signatures")
    full = signed.where(F.col("key1").isNotNull())
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first")] if row else []
    classes = full.groupBy("key1", "key2").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("weight"), *first)
    classes, classes_path = saved(classes, "classes")
    reps, reps_path = saved(full.select("uid", "tokens", "size", "doc_id", "text_hash").join(classes.select("uid", "weight"), "uid"), "representatives")
    edges, paths = candidate_edges(reps, threshold, candidate, recall)
    clusters, path = saved(components(edges), "clusters")
    removed(spark, *paths)
    totals = clusters.join(reps.select(F.col("uid").alias("id"), "size"), "id").groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    members = clusters.withColumnRenamed("id", "uid").join(totals.select("root", blocks), "root").join(reps.select("uid", "doc_id", "text_hash", "weight"), "uid")
    members, members_path = saved(members, "members")
    dealt = block_pairs(shingle_rows(docs, members, n), "blocks", "uid")
    links = map_groups(dealt.select("root", "i", "j", "uid", "side", "weight", "shingles"), ["root", "i", "j"], _cluster_links(threshold), "uid long, links double, root long")
    links, links_path = saved(links, "links")
    removed(spark, path, members_path, reps_path)
    groups = components(links.where("uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("uid").agg(F.sum("links").cast("long").alias("links"))
    by_class = classes.join(counted, "uid", "left").join(groups.withColumnRenamed("id", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    smallest = by_class.groupBy("root").agg(F.min("class_id").alias("component_id"), *([F.min("first").getField("uid").alias("first_row")] if row else []))
    by_class = by_class.join(smallest, "root").select("key1", "key2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", *(["first_row"] if row else []))
    rows = signed.select("uid", "doc_id", "key1", "key2").join(by_class, ["key1", "key2"], "left")
    kept = F.col("uid") == F.col("first_row") if row else F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id"))
    return rows.select(
        *([F.col("uid").alias(row)] if row else []),
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(kept, F.lit(True)).alias("kept"),
    )
