"""Operator 12: repair of conversation structure by dynamic programming over a trie of signatures.

A conversation's rows become a signature, a letter for each row's role and first fault. Signatures are sorted by range
partitions, so that a task meets them as a depth-first walk of their prefix trie: the layers of the path down to the last
signature stay on a stack, the next signature keeps those of the shared prefix and adds its own, and its answer is read
back from its terminal node.

A layer has the cheapest way to each of four states of the grammar (s?(ua)+)? and, of equally cheap ones, the ASCII-least
edits. Every way in a layer ends with a row's letter (inserted turns come before the row that follows them), and the edits fix
the repaired roles, so no way is a prefix of another's and they can be told by their rank: a layer is four
small costs and four ranks, and its successor depends on these and a letter alone. Successors are computed once and kept;
states that cost over APART more than the best can't be part of a cheapest way, so there are few different layers.

Texts are shuffled once, past the edits, to be hashed as they stream by; the signatures are built from digests. A
conversation is hashed by one task whatever its length, since a hash is a chain, but is never held: the task keeps a letter
for each row.

Defined results: nulls count as one space, in the key of the damage too; a null conv_id is a conversation of its own; rows of equal turn go
by digest of role and text, null turns first; roles whose first character is none of s, u and a can't be kept; white space
is that of ASCII; repeated rows are duplicates; an empty table gives no rows; texts of any length are streamed one at a time; other columns
are ignored, whatever their names.
"""

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.llm.storage import saved

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Any state can go on as any other does for this much more, at most: two insertions and a deletion.
APART = 2 * INSERT + DELETE
#: States of the grammar: nothing yet, after s, after u, after a; the state after one more user or assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_SPACES = " \t\n\x0b\x0c\r"
NO_TEXT = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, the number of times that the row stands after the damage."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), (F.crc32(key) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("damage") == 0, 0).when(F.col("damage") == 3, 2).otherwise(1).alias("n"))


def digested(rows: DataFrame) -> DataFrame:
    """rows with a digest of role and text."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def described(rows: DataFrame) -> DataFrame:
    """Without texts: conv_id, turn, digest, initial, blank, cut, n, and first (the pair of role and text is met there first)."""
    body, initial = F.rtrim("text", F.lit(_SPACES)), F.substring("role", 1, 1)
    flags = digested(rows).select("conv_id", "turn", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"), "n")
    # a row that the damage drops stays as a mark of its conversation
    gone = F.col("n") == 0
    flags = flags.withColumns({c: F.when(~gone, F.col(c)) for c in ("turn", "digest", "initial", "blank", "cut")})
    flags = flags.groupBy("conv_id", "turn", "digest", "initial", "blank", "cut").agg(F.sum("n").alias("n"))
    same = Window.partitionBy("conv_id", "digest").orderBy(F.asc_nulls_first("turn"))
    return flags.withColumn("first", F.row_number().over(same) == 1)


SUMMARY = "signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


def _bounds(column: pa.Array) -> list[int]:
    """Where runs of equal values (or nulls) start, and the end."""
    if not len(column):
        return [0]
    before, after = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.if_else(pc.and_(before.is_valid(), after.is_valid()), pc.fill_null(pc.equal(before, after), False), pc.and_(before.is_null(), after.is_null()))
    return [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist(), len(column)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, bool, pa.RecordBatch]]:
    """(conv_id, whether it starts here, rows): a conversation's rows may come in several batches."""
    last = None
    for batch in batches:
        cuts = _bounds(batch.column(0))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                own = batch.column(0)[a]
                starts = last is None or not (own == last or not own.is_valid and not last.is_valid)
                last = own
                yield own, starts, batch.slice(a, b - a)


class _Signature:
    """What is known of a conversation so far."""

    def __init__(self, conv_id: pa.Scalar):
        self.conv_id, self.letters, self.turns, self.last = conv_id, [], [], None
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = None

    def add(self, rows: pa.RecordBatch) -> None:
        for turn, initial, blank, cut, n, first in zip(*(rows.column(k).to_pylist() for k in range(1, 7)), strict=True):
            if not n:
                continue
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.distinct = turn, self.distinct + 1
            if self.last is not None and self.last + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.last, self.illegal = initial, self.illegal + n - 1
            if blank:
                self.blank += n
                self.letters.append("d" * n)
                continue
            self.duplicate += n - first
            self.truncated += first and cut
            letter = (initial if cut else initial.upper()) if first else ""
            self.letters.append(letter + "d" * (n - first))

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return "".join(self.letters), gaps, self.blank, self.duplicate, self.truncated, self.illegal


def summarised(described_rows: DataFrame) -> DataFrame:
    """One row per conversation: its signature and the counts of its faults."""
    kind = described_rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *(x.split()[0] for x in SUMMARY.split(", "))]
        ids, rows, now, of = [], [], None, None

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(ids, of), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for own, starts, part in _runs(batches):
            if starts:
                if now:
                    ids.append(now.conv_id.as_py())
                    rows.append(now.row())
                now, of = _Signature(own), part.schema.field(0).type
                if len(rows) >= 10_000:
                    yield flushed()
                    ids, rows = [], []
            now.add(part)
        if now:
            ids.append(now.conv_id.as_py())
            rows.append(now.row())
            yield flushed()

    ordered = described_rows.select("conv_id", "turn", "initial", "blank", "cut", "n", F.col("first").cast("int").alias("first"), "digest")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "digest")
    return ordered.mapInArrow(run, f"conv_id {kind}, {SUMMARY}")


# --- the dynamic programme ----------------------------------------------------------------------------------------------


def _steps(state: int, letter: str) -> Iterator[tuple[int, int, str]]:
    """(state after, cost, edits) of a row after a state, with up to two turns inserted before it; a third would come back to the first's state."""
    inserted, cost, at = "", 0, state
    for _ in range(3):
        yield at, cost + DELETE, f"{inserted}D"
        if letter != "d":
            extra = TRUNCATED if letter.islower() else 0
            role = letter.lower()
            if role == "s" and at == EMPTY:
                yield SYSTEM, cost + KEEP + extra, f"{inserted}K"
            if role in "ua" and _NEXT[at] == (USER if role == "u" else ASSISTANT):
                yield _NEXT[at], cost + KEEP + extra, f"{inserted}K"
            yield _NEXT[at], cost + REROLE + extra, f"{inserted}R"
        inserted, cost, at = f"{inserted}I", cost + INSERT, _NEXT[at]


#: A layer: for each state the cost above the least and the rank of its edits, or None.
Layer = tuple[tuple[int, int] | None, ...]
ROOT: Layer = ((0, 0), None, None, None)


@cache
def successor(layer: Layer, letter: str) -> tuple[Layer, int, tuple]:
    """(the next layer, what its least cost adds, for each of its states the state before and the edits since)."""
    found: list[tuple | None] = [None] * 4
    for before, known in enumerate(layer):
        if known:
            for after, cost, edits in _steps(before, letter):
                way = (known[0] + cost, known[1], edits, before)
                if found[after] is None or way < found[after]:
                    found[after] = way
    least = min(way[0] for way in found if way)
    found = [way if way and way[0] <= least + APART else None for way in found]
    order = sorted(way[1:3] for way in found if way)
    ahead = tuple((way[0] - least, order.index(way[1:3])) if way else None for way in found)
    return ahead, least, tuple((way[3], way[2]) if way else None for way in found)


#: Turns to insert at the end of each state for the grammar to accept.
_CLOSING = (0, 2, 1, 0)


class Trie:
    """The path of the trie down to the last signature: a layer, its cost and the ways into it for each letter."""

    def __init__(self):
        self.path, self.layers, self.costs, self.ways = "", [ROOT], array("q", [0]), [None]

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of a signature; those that come in order share the layers of their common prefixes."""
        shared = 0
        for a, b in zip(self.path, signature):
            if a != b:
                break
            shared += 1
        del self.layers[shared + 1 :], self.costs[shared + 1 :], self.ways[shared + 1 :]
        for letter in signature[shared:]:
            layer, added, ways = successor(self.layers[-1], letter)
            self.layers.append(layer)
            self.costs.append(self.costs[-1] + added)
            self.ways.append(ways)
        self.path = signature
        cost, _, state = min((known[0] + INSERT * _CLOSING[s], known[1], s) for s, known in enumerate(self.layers[-1]) if known)
        edits = ["I" * _CLOSING[state]]
        total = self.costs[-1] + cost
        for ways in reversed(self.ways[1:]):
            state, word = ways[state]
            edits.append(word)
        return total, "".join(reversed(edits))


def audited(summary: DataFrame) -> DataFrame:
    """(conv_id, cost, audit): each task walks the trie of a range of signatures; equal ones are split by conv_id."""
    kind = summary.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, known = Trie(), None, None
        for batch in batches:
            found = []
            for signature in batch.column(1).to_pylist():
                if signature != last:
                    last, known = signature, trie.answer(signature)
                found.append(known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["conv_id", "cost", "audit"])

    ordered = summary.select("conv_id", "signature").repartitionByRange("signature", "conv_id").sortWithinPartitions("signature")
    return ordered.mapInArrow(run, f"conv_id {kind}, cost long, audit string")


# --- the repaired conversations -----------------------------------------------------------------------------------------


class Repair:
    """Applies edits to rows that stream by; gives the repaired rows as bytes."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY

    def inserted(self) -> Iterator[bytes]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self._turn() + b":"
            self.at += 1

    def _turn(self) -> bytes:
        self.state = _NEXT[self.state]
        return b"user" if self.state == USER else b"assistant"

    def row(self, role: bytes, text: bytes) -> Iterator[bytes]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = SYSTEM if role[:1] == b"s" else _NEXT[self.state]
            yield role + b":" + text
        elif edit == "R":
            yield self._turn() + b":" + text


class _Hash:
    def __init__(self):
        self.sum, self.any = hashlib.sha256(), False

    def add(self, parts: Iterator[bytes]) -> None:
        for part in parts:
            if self.any:
                self.sum.update(b"\n")
            self.any = True
            self.sum.update(part)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damaged(conversations)
    summary, _ = saved(summarised(described(rows)), "signatures")
    answers, _ = saved(audited(summary), "audits")
    kind = summary.schema["conv_id"].dataType.simpleString()
    named = [x.split()[0] for x in RESULT.split(", ")]
    heads = summary.drop("signature").join(answers, summary["conv_id"].eqNullSafe(answers["conv_id"])).drop(answers["conv_id"])
    heads = heads.select("conv_id", F.lit(0).alias("is_row"), F.struct(*named).alias("head"))
    lines = digested(rows).where("n > 0").select("conv_id", F.lit(1).alias("is_row"), "turn", "digest", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "n")
    both = heads.unionByName(lines, allowMissingColumns=True).select("conv_id", "is_row", "head", "role", "text", "n", "turn", "digest")
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", F.asc_nulls_first("turn"), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, heads, sums, now, of = [], [], [], None, None

        def flushed() -> pa.RecordBatch:
            table = pa.Table.from_pylist(heads)
            columns = [table[c].combine_chunks().cast(pa.string() if c == "audit" else pa.int64()) for c in named]
            return pa.RecordBatch.from_arrays([pa.array(ids, of), *columns, pa.array(sums, pa.string())], names=["conv_id", *named, "repaired_sha256"])

        def closed() -> None:
            own, head, repair, total = now
            total.add(repair.inserted())
            ids.append(own.as_py())
            heads.append(head)
            sums.append(total.sum.hexdigest())

        for own, starts, part in _runs(batches):
            if starts:
                if now:
                    closed()
                if len(ids) >= 10_000:
                    yield flushed()
                    ids, heads, sums = [], [], []
                head, of = part.column(2)[0].as_py(), part.schema.field(0).type
                now, part = (own, head, Repair(head["audit"]), _Hash()), part.slice(1)
            _, _, repair, total = now
            for role, text, n in zip(*(part.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                for _ in range(n):
                    total.add(repair.row(role, text))
        if now:
            closed()
            yield flushed()

    return both.mapInArrow(run, f"conv_id {kind}, {RESULT}, repaired_sha256 string")
