"""Operator 13: alignment of two tokenizers' ids over whole texts, by byte intervals.

Texts are cut before a blank that follows a visible ASCII character or a letter of two bytes. Both tokenizers start a token there
whatever stands around (no piece has a blank inside), so a text's tokens, links and groups are those of its segments in
order. A worker aligns each distinct segment once: for the new ones of an Arrow batch, DuckDB gets a table of token intervals
for each tokenizer. Two ASOF joins give the first and last token of B that an A token overlaps, a range join the links
between, a window sum over common ends the groups. Rows of documents are sums over their segments.

The corpus-wide count of an id pair: each task adds its own counts and Spark merges them. Pairs that hold a 2**20th or more of
all links are 2**20 at most and are broadcast; rarer ones, which no document repeats often, are joined by a shuffle. Documents
carry their distinct pairs with counts, never their links.

Defined results: null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have zeros and an empty
groups_sha256; a null doc_id is kept; repeated rows are documents of their own and all count; an empty table gives no rows; a very long
text is aligned whole, by segments, or as one segment if nothing cuts it, at about 100 bytes of memory a token; an id's highest counts may
tie, and all of them are highest; other columns are ignored, whatever their names.
"""

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.bpe import Encoder
from quarterdeck.llm.storage import saved
from quarterdeck.llm.words import chunks, span_keys, text_buffer

#: Id pairs at most whose counts are broadcast (17 bytes each).
COMMON = 1 << 20
#: Distinct segments that a worker keeps (about 200 bytes each) in a table of 2**SLOTS places, and pair counts that a task adds up
#: before it passes them on.
KEEP, SLOTS, HELD = 400_000, 20, 1_000_000
#: Segments that DuckDB aligns at once.
BATCH = 8192

_ALIGN = """
CREATE OR REPLACE TEMP TABLE spans AS
SELECT a.g, a.seg, a.id, f.g AS low, l.g AS high,
  coalesce(sum(CASE WHEN l.e = a.e THEN 1 ELSE 0 END) OVER (ORDER BY a.g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp, a.s
FROM a ASOF JOIN b f ON a.s >= f.s ASOF JOIN b l ON a.e > l.s"""
_LINKS = "SELECT x.seg, x.id AS a_id, b.id AS b_id, count(*) AS n FROM spans x JOIN b ON b.g BETWEEN x.low AND x.high GROUP BY ALL ORDER BY 1"
#: Ids in the order of a group's text, with side 1 for B; a group of A tokens takes the B tokens that start in it.
_GROUPS = """
SELECT seg, grp, 0 AS side, id, g FROM spans
UNION ALL SELECT b.seg, x.grp, 1 AS side, b.id, b.g FROM b ASOF JOIN spans x ON b.s >= x.s
ORDER BY grp, side, g"""


class _Plain(Encoder):
    """Special tokens' strings are plain text. Its words are parts of segments, which are kept too, so it keeps fewer."""

    SLOTS = 20

    def __init__(self, path: str):
        super().__init__(path, keep=KEEP)
        self.tokenizer.encode_special_tokens = True
        self.added = []


def byte_values() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: visible Latin-1 signs are themselves, the others follow from U+0100 in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments start; every row starts one."""
    start = np.zeros(len(data) + 1, bool)
    blank = np.flatnonzero(data[1:] == 32) + 1
    before = data[blank - 1]
    letter = np.zeros(len(blank), bool)
    wide = blank >= 2
    letter[wide] = (before[wide] >= 0x80) & (data[blank[wide] - 2] >= 0xC3) & (data[blank[wide] - 2] <= 0xDF)
    start[blank[((before > 32) & (before < 127)) | letter]] = True
    start[offsets[:-1]] = True
    return np.flatnonzero(start[:-1])


class Aligner:
    """Segments aligned so far: numbers of tokens, groups and links, the groups' text, and the id pairs with their counts."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = _Plain(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        signs = byte_values()
        names = {i: t for t, i in self.a.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(signs[c] for c in names.get(i, "")) if all(c in signs for c in names.get(i, "")) else names[i].encode() for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a blank inside: texts can't be cut before blanks")
        self.b_size, self.blank = len(pieces), self.b.piece_to_id("▁")
        self.a_sizes, self.b_sizes = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        numbers = [str(i) for i in range(max(len(self.a_bytes), self.b_size))]
        self.signed = [[sign + x for x in numbers] for sign in (",", ";", "|", "")]
        self.db = duckdb.connect(config={"threads": 1})
        self.forget()

    def forget(self) -> None:
        self.hashes, self.checks, self.numbers = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.uint64), np.full(1 << SLOTS, -1, np.int32)
        self.groups: list[str | None] = []  # None: a tokenizer does not give the bytes back
        self.counts = np.zeros((1024, 4), np.int64)  # tokens of A and B, groups, links
        self.first, self.pairs, self.weights = np.zeros(1025, np.int64), np.zeros(4096, np.int64), np.zeros(4096, np.int64)

    def refs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each segment; new ones are aligned first."""
        if len(self.groups) > KEEP:
            self.forget()
        one, two = span_keys(data, starts, ends)
        slots = (one >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self.numbers[slots].astype(np.int64)
        new = np.flatnonzero((out < 0) | (self.hashes[slots] != one) | (self.checks[slots] != two))
        if len(new):
            _, at, back = np.unique(one[new], return_index=True, return_inverse=True)
            if (two[new][at][back] != two[new]).any():  # segments that share 64 bits
                _, at, back = np.unique(np.rec.fromarrays([one[new], two[new]]), return_index=True, return_inverse=True)
            base, at = len(self.groups), new[at]
            for k in range(0, len(at), BATCH):
                own = at[k : k + BATCH]
                self._align([data[s:e].tobytes() for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            out[new] = base + back
            self.hashes[slots[at]], self.checks[slots[at]], self.numbers[slots[at]] = one[at], two[at], np.arange(base, base + len(at))
        return out

    def _encoded(self, segments: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """For A and B: ids of all segments, and how many each has."""
        found = list(self.a(pa.array(segments, pa.binary())))
        b_ids = self.b.encode([s[1:].decode("utf-8", "replace") for s in segments])
        b_ids = [x if len(s) > 1 else [self.blank] for x, s in zip(b_ids, segments, strict=True)]
        a_ids, a_counts = np.concatenate([ids for _, ids, _ in found]).astype(np.int64), np.concatenate([np.diff(at) for _, _, at in found])
        return (a_ids, a_counts), (np.fromiter(chain.from_iterable(b_ids), np.int64), np.fromiter(map(len, b_ids), np.int64, len(b_ids)))

    def _given_back(self, segments: list[bytes], ids: np.ndarray, counts: np.ndarray, values: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Whether each segment is the bytes of its ids."""
        ends = np.r_[0, np.cumsum(counts)]
        length = np.diff(np.r_[0, np.cumsum(sizes[ids])][ends])
        same = length == np.fromiter(map(len, segments), np.int64, len(segments))
        if same.all() and b"".join(map(values.__getitem__, ids.tolist())) == b"".join(segments):
            return same
        return np.array([b"".join(map(values.__getitem__, ids[a:b].tolist())) == s for s, a, b in zip(segments, ends[:-1].tolist(), ends[1:].tolist(), strict=True)], bool)

    def _align(self, segments: list[bytes]) -> None:
        both = self._encoded(segments)
        whole = self._given_back(segments, *both[0], self.a_bytes, self.a_sizes) & self._given_back(segments, *both[1], self.b_bytes, self.b_sizes)
        base, kept = len(self.groups), np.flatnonzero(whole)
        counts, texts = np.zeros((len(segments), 4), np.int64), [None] * len(segments)
        owners = keys = weights = np.empty(0, np.int64)
        if len(kept):
            for k, (ids, lengths) in enumerate(both):
                flat, name, sizes = ids[np.repeat(whole, lengths)], "ab"[k], (self.a_sizes, self.b_sizes)[k]
                ends = np.cumsum(sizes[flat])
                counts[kept, k] = lengths[kept]
                table = pa.table({"g": np.arange(len(flat)), "seg": np.repeat(kept, lengths[kept]), "id": flat, "s": ends - sizes[flat], "e": ends})
                self.db.register(f"{name}_arrow", table)
                self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM {name}_arrow")
                self.db.unregister(f"{name}_arrow")
            self.db.execute(_ALIGN)
            links, tokens = self.db.execute(_LINKS).fetchnumpy(), self.db.execute(_GROUPS).fetchnumpy()
            owners, weights = links["seg"], links["n"]
            keys = links["a_id"] * self.b_size + links["b_id"]
            counts[:, 3] = np.bincount(owners, weights, len(segments)).astype(np.int64)
            seg, new = tokens["seg"], np.r_[True, tokens["grp"][1:] != tokens["grp"][:-1]]
            first = np.r_[True, seg[1:] != seg[:-1]]
            counts[:, 2] = np.bincount(seg[new], minlength=len(segments))
            sign = np.where(first, 3, np.where(new, 1, np.where(np.r_[False, tokens["side"][1:] != tokens["side"][:-1]], 2, 0)))
            words = [self.signed[i][k] for i, k in zip(sign.tolist(), tokens["id"].tolist(), strict=True)]
            at = np.r_[np.flatnonzero(first), len(seg)].tolist()
            for k, a, b in zip(seg[first].tolist(), at[:-1], at[1:], strict=True):
                texts[k] = "".join(words[a:b])
        self.groups += texts
        n, used = len(self.groups), int(self.first[base])
        self.counts, self.first = _room(self.counts, n), _room(self.first, n + 1)
        self.pairs, self.weights = _room(self.pairs, used + len(keys)), _room(self.weights, used + len(keys))
        self.counts[base:n] = counts
        self.first[base : n + 1] = used + np.r_[0, np.cumsum(np.bincount(owners, minlength=len(segments)))]
        self.pairs[used : used + len(keys)], self.weights[used : used + len(keys)] = keys, weights


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) >= n else np.concatenate([x, np.zeros((max(n, 2 * len(x)) - len(x), *x.shape[1:]), x.dtype)])


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(weights, at) if len(at) else weights


_aligners: dict[tuple[str, str], Aligner] = {}

#: kind 0: a document; kind 1: a task's counts of pairs.
ALIGNED = "kind int, uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, n array<long>"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each document's alignment with its distinct id pairs, and each task's counts of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _aligners:
            _aligners[a_path, b_path] = Aligner(a_path, b_path)
        aligner, uid = _aligners[a_path, b_path], TaskContext.get().partitionId() << 33
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counts() -> pa.RecordBatch:
            keys, weights = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            zero = [0] * ((len(keys) - 1) // 100_000 + 1)
            at = np.r_[np.arange(len(zero)) * 100_000, len(keys)]
            held.clear()
            return _batch([1] * len(zero), [None] * len(zero), pa.nulls(len(zero), pa.int64()), np.zeros((len(zero), 4), np.int64), [""] * len(zero), at, keys, weights)

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in chunks(offsets):
                n = last - first
                at = offsets[first : last + 1] - offsets[first]
                filled = np.flatnonzero(np.diff(at))
                part = np.insert(data[offsets[first] : offsets[last]], at[filled], 32)
                bounds = np.r_[at[filled] + np.arange(len(filled)), len(part)]
                numbers, shas = np.zeros((n, 4), np.int64), [""] * n
                rows = keys = weights = np.empty(0, np.int64)
                if len(filled):
                    starts = cuts(part, bounds)
                    refs = aligner.refs(part, starts, np.r_[starts[1:], len(part)])
                    own = np.searchsorted(starts, bounds)
                    numbers[filled] = np.add.reduceat(aligner.counts[refs], own[:-1], axis=0)
                    texts = [aligner.groups[r] for r in refs.tolist()]
                    whole = np.ones(n, bool)
                    for k, a, b in zip(filled.tolist(), own[:-1].tolist(), own[1:].tolist(), strict=True):
                        try:
                            shas[k] = hashlib.sha256(";".join(texts[a:b]).encode()).hexdigest()
                        except TypeError:  # a segment without alignment
                            whole[k], numbers[k] = False, 0
                    row = np.repeat(filled, np.diff(own))
                    refs, row = refs[whole[row]], row[whole[row]]
                    sizes = aligner.first[refs + 1] - aligner.first[refs]
                    place = np.repeat(aligner.first[refs] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                    span = len(aligner.a_bytes) * aligner.b_size
                    keys, weights = _summed(np.repeat(row, sizes) * span + aligner.pairs[place], aligner.weights[place])
                    rows, keys = keys // span, keys % span
                ids = [uid + i for i in range(n)]
                uid += n
                yield _batch([0] * n, ids, batch.column(0).slice(first, n), numbers, shas, np.searchsorted(rows, np.arange(n + 1)), keys, weights)
                if len(keys):
                    held.append(_summed(keys, weights))
                    if sum(len(k) for k, _ in held) > HELD:
                        merged = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                        held[:] = [merged]
                        if len(merged[0]) > HELD // 2:
                            yield counts()
        if held:
            yield counts()

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ALIGNED)


def _batch(kind: list, uid: list, doc_id: pa.Array, numbers: np.ndarray, shas: list[str], at: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int64())) for x in (keys, weights)]
    columns = [pa.array(kind, pa.int32()), pa.array(uid, pa.int64()), doc_id, *(pa.array(numbers[:, k]) for k in range(4)), pa.array(shas, pa.string()), *lists]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ALIGNED.split(", ")])


def pair_counts(parts: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): how many links hold each id pair, and whether none of its B id's pairs has more."""
    counts = parts.select(F.inline(F.arrays_zip("pair", "n"))).groupBy("pair").agg(F.sum("n").alias("count"))
    counts, _ = saved(counts, "pair-counts")
    b = F.pmod("pair", F.lit(b_size)).alias("b_id")
    highest = counts.groupBy(b).agg(F.max("count").alias("highest"))
    out = counts.withColumn("b_id", b).join(F.broadcast(highest), "b_id")  # a row per id of B's vocabulary
    return out.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def compared(docs: DataFrame, a_path: str, b_path: str, common: int = COMMON) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = aligned(docs, a_path, b_path)
    table, _ = saved(rows, "alignments", compression="zstd")
    own = table.where("kind = 0")
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    counts, _ = saved(pair_counts(table.where("kind = 1"), b_size), "pairs")
    links = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    often = F.col("count") * common >= links  # of those there are `common` at most; the rest may be any number, of few pairs too
    held = own.select("uid", F.inline(F.arrays_zip("pair", "n")))
    met = held.join(F.broadcast(counts.where(often)), "pair", "left")
    rest = met.where("count IS NULL").select("uid", "pair", "n").join(counts.where(~often), "pair")
    sums = met.where("count IS NOT NULL").unionByName(rest)
    sums = sums.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = own.drop("pair", "n", "kind").join(sums, "uid", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
