"""Operator 4: language identification by prediction by partial matching.

For each language there is a tree of contexts of up to ORDER bytes. A byte's code length is that of its frequency in
the longest context known in which it was seen, after the escapes of the longer contexts known; a byte seen in
none costs 8 bits after all escapes. A context of n bytes and k different ones gives a byte seen m times
m / (n + k) and the escape k / (n + k). The statistics are frozen after training, so a whole text's exact code
length under every language is a sum over its bytes, whatever their order. The language with the shortest code is predicted.
Bytes are coded as they are, and a text is preceded by ORDER blanks.

The trees are fitted on a bounded sample of the labelled rows that are not held out: texts drawn by their hash, about
SAMPLE_ROWS rows and SAMPLE_BYTES bytes per language, each text once. Spark counts the contexts and
groups the bytes of each. Every context of the sample is kept. The trees' size is checked before they are broadcast: while
they would take more than MODEL_BYTES, the sample is drawn again at half its size. All else covers all rows and whole texts.

In a task all trees together are tables of (context, byte) with a column of code lengths per language, found by
open addressing; a chunk of texts goes through the orders from the longest to the shortest.

Defined results: null texts and texts without a letter are `und` with score 0; a null doc_id is neither held out
nor learned from; rows with a null lang are predicted but not learned from; repeated rows get equal results; with no labelled
row everything is `und`; ties go to the first language in order; no documents give no rows; a very long text is scored
in parts, in bounded memory beside the text; other columns are ignored, or kept if whole_rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterdeck.llm.storage import free_name, removed, saved
from quarterdeck.llm.words import chunks, mixed, text_buffer

ORDER = 4
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8 << 20
#: Bound of the sample by the whole trees that it gives.
MODEL_BYTES = 64 << 20
#: Bytes of text that are scored at once, for one language.
SCORED_BYTES = 1 << 19
UNKNOWN = "und"

_BLANK = 0x20202020
_DRAWN = 1 << 30


def context_codes(data: np.ndarray, before: int = _BLANK) -> np.ndarray:
    """The ORDER bytes before each byte of one text, the last of them lowest, and the byte: ORDER + 1 bytes in one integer."""
    padded = np.r_[np.frombuffer(before.to_bytes(ORDER, "big"), np.uint8), data].astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(ORDER + 1):
        out = out << np.uint64(8) | padded[k : k + len(data)]
    return out


def chunk_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """context_codes() of texts that lie one after the other, each preceded by blanks."""
    out = context_codes(data)
    for k in range(ORDER):  # the k-th byte of a text: ORDER - k blanks before it
        at = (offsets[:-1] + k)[np.diff(offsets) > k]
        kept = np.uint64((1 << (8 * (k + 1))) - 1)
        out[at] = out[at] & kept | np.uint64((_BLANK << (8 * (k + 1))) & ((1 << (8 * (ORDER + 1))) - 1)) & ~kept
    return out


def grown(counts: DataFrame) -> DataFrame:
    """The trees of all languages from counts (lang, code, n) of contexts and bytes: lang, order, context, symbol (-1 is
    the escape) and bits.

    A context has 256 bytes at most, so no group of rows is larger, however much one language holds of the sample."""
    order = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("order")
    pairs = counts.select("lang", "code", "n", order)
    mask = F.element_at(F.array(*(F.lit((1 << (8 * (k + 1))) - 1).cast("long") for k in range(ORDER + 1))), F.col("order") + 1)
    pairs = pairs.groupBy("lang", "order", F.col("code").bitwiseAND(mask).alias("pair")).agg(F.sum("n").alias("n"))
    pairs = pairs.select("lang", "order", F.shiftright("pair", 8).alias("context"), F.col("pair").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n")
    keys = ["lang", "order", "context"]
    found = pairs.groupBy(*keys).agg(F.sum("n").alias("seen"), F.collect_list(F.struct("symbol", "n")).alias("bytes"))
    total = F.col("seen") + F.size("bytes")
    escape = F.struct(F.lit(-1).alias("symbol"), F.size("bytes").cast("long").alias("n"))
    rows = found.select(*keys, total.alias("total"), F.explode(F.array_append("bytes", escape)).alias("b"))
    return rows.select(*keys, "b.symbol", (-F.log2(F.col("b.n") / F.col("total"))).alias("bits"))


class Lookup:
    """Numbers of known 64-bit keys by open addressing; keys are distinct and below 2**63."""

    def __init__(self, keys: np.ndarray):
        bits = max((3 * len(keys) // 2).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_number = np.full(1 << bits, np.uint64(1) << np.uint64(63)), np.zeros(1 << bits, np.int32)
        pending, self.probes = np.arange(len(keys)), 0
        start = (mixed(keys) >> self.shift).astype(np.int64)
        while len(pending):
            slot = (start[pending] + self.probes) & self.mask
            free = self.slot_key[slot] == np.uint64(1) << np.uint64(63)
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.slot_key[slot[won]], self.slot_number[slot[won]] = keys[pending[won]], pending[won]
            pending = np.delete(pending, won)
            self.probes += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if unknown."""
        slot = (mixed(keys) >> self.shift).astype(np.int64)
        held = self.slot_key[slot]
        out = np.where(held == keys, self.slot_number[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held != np.uint64(1) << np.uint64(63)))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + probe) & self.mask
            held = self.slot_key[at]
            same = held == keys[open_]
            out[open_[same]] = self.slot_number[at[same]]
            open_ = open_[~same & (held != np.uint64(1) << np.uint64(63))]
        return out


class Trees:
    """Frozen code lengths of all languages: for each order the known (context, byte) codes and contexts, with a row of bits per language."""

    def __init__(self, langs: list[str], orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.langs, self.orders = langs, orders
        self._lookups: list[tuple[Lookup, Lookup]] = []

    def __getstate__(self):
        return {"langs": self.langs, "orders": self.orders, "_lookups": []}

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for order in self.orders for x in order)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text (rows) under each language (columns); only a lone text is scored in parts."""
        step = max(SCORED_BYTES // len(self.langs), 4096)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for first, last in chunks(offsets, step):
            a, b = int(offsets[first]), int(offsets[last])
            if last > first + 1:
                bits = self._bits(chunk_codes(data[a:b], offsets[first : last + 1] - a))
                full = np.flatnonzero(np.diff(offsets[first : last + 1]) > 0)
                out[first + full] = np.add.reduceat(bits, offsets[first + full] - a, axis=0, dtype=np.float64)
                continue
            before = _BLANK
            for k in range(a, b, step):
                part = data[k : min(k + step, b)]
                out[first] += self._bits(context_codes(part, before)).sum(axis=0, dtype=np.float64)
                before = int.from_bytes((before.to_bytes(ORDER, "big") + part[-ORDER:].tobytes())[-ORDER:], "big")
        return out

    def _bits(self, codes: np.ndarray) -> np.ndarray:
        if not self._lookups:
            self._lookups = [(Lookup(pairs), Lookup(contexts)) for pairs, _, contexts, _ in self.orders]
        out = np.zeros((len(codes), len(self.langs)), np.float32)
        live = np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            pair, context = self._lookups[order]
            own = codes[live] & np.uint64((1 << (8 * (order + 1))) - 1)
            number = pair.find(own)
            hit = number >= 0
            out[live[hit]] += self.orders[order][1][number[hit]]
            live, own = live[~hit], own[~hit] >> np.uint64(8)
            if not len(live):
                return out
            number = context.find(own)
            hit = number >= 0
            out[live[hit]] += self.orders[order][3][number[hit]]
        out[live] += 8
        return out


def merged(langs: list[str], lang: np.ndarray, order: np.ndarray, context: np.ndarray, symbol: np.ndarray, bits: np.ndarray) -> Trees:
    """One table per order of all languages' trees: what a language has not seen in a context costs its escape and the next shorter context's bits."""
    orders, below = [], None
    for k in range(ORDER + 1):
        own = order == k
        escape = own & (symbol < 0)
        contexts, of = np.unique(context[escape], return_inverse=True)
        escapes = np.zeros((len(contexts), len(langs)), np.float32)
        escapes[of, lang[escape]] = bits[escape]
        pair = own & (symbol >= 0)
        codes, of = np.unique(context[pair] << 8 | symbol[pair], return_inverse=True)
        table = np.full((len(codes), len(langs)), 8.0, np.float32)
        if below is not None:  # a language that lacks the shorter pair has its bits there too: 8 and the escapes on the way
            number = np.searchsorted(below[0], codes & ((1 << (8 * k)) - 1))
            table = below[1][number].copy()
        at = np.searchsorted(contexts, codes >> 8)
        table += escapes[at]
        table[of, lang[pair]] = bits[pair]
        below = (codes, table)
        orders.append((codes.astype(np.uint64), table, contexts.astype(np.uint64), escapes))
    return Trees(langs, orders)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, model_bytes: int = MODEL_BYTES) -> Trees:
    """Trees from about sample_rows texts and sample_bytes bytes of each language that are not held out; from fewer of each
    where the trees would take more than model_bytes."""
    spark = docs.sparkSession
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    labelled = docs.where(F.col("doc_id").isNotNull() & lang.isNotNull() & text.isNotNull() & ~held_out(F.col("doc_id"))).select(lang.alias("lang"), text.alias("text"))
    totals = {r["lang"]: (r["n"], r["bytes"]) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()}
    langs = sorted(totals)
    if not langs:
        return Trees([], [])
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            of = batch.column(0).to_numpy()
            for first, last in chunks(offsets):
                for number in np.unique(of[first:last]).tolist():
                    rows = np.flatnonzero(of[first:last] == number) + first
                    code, n = np.unique(np.concatenate([context_codes(data[offsets[r] : offsets[r + 1]]) for r in rows.tolist()]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), number, np.int32)), pa.array(code.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    share = 1.0
    while True:
        drawn = [(k, x, int(_DRAWN * share * min(1.0, sample_rows / totals[x][0], sample_bytes / max(totals[x][1], 1)))) for k, x in enumerate(langs)]
        rates = spark.createDataFrame(drawn, "number int, lang string, drawn long")  # a row per language
        sample = labelled.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("text"), F.lit(_DRAWN)) < F.col("drawn")).select("number", "text").distinct()
        counts = sample.mapInArrow(count, "lang int, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
        trees, path = saved(grown(counts), "trees")
        # a (context, byte) and an escape take a code and a float of each language
        size = trees.select("order", "context", "symbol").distinct().count() * (8 + 4 * len(langs))
        if size <= model_bytes and (size or share == 1):
            break
        removed(spark, path)
        if not size:
            raise ValueError(f"no sample gives trees of {model_bytes} bytes for {len(langs)} languages")
        share /= 2
    kept = trees.toArrow()
    removed(spark, path)
    return merged(langs, *(kept.column(x).to_numpy() for x in ("lang", "order", "context", "symbol", "bits")))


def identified(docs: DataFrame, model: Trees, whole_rows: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior of the language under equal priors); after all columns of docs if whole_rows
    (a name that docs has already gets an underscore)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_kept = len(docs.columns) if whole_rows else 1
    taken = docs.columns if whole_rows else ["doc_id"]
    out_name, text_name, letters_name, pred_name, score_name = (free_name(x, taken) for x in ("held_out", "_text", "_letters", "lang_pred", "score"))
    at_text = docs.columns.index("text") if whole_rows else n_kept + 2

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value  # a worker keeps it, with its lookups, until its next task has no use for the broadcast
        names = np.array([*own.langs, UNKNOWN], object)
        for batch in batches:
            data, offsets = text_buffer(batch.column(at_text))
            letters = batch.column(n_kept + 1).to_numpy(zero_copy_only=False)
            for first, last in chunks(offsets):
                at = offsets[first : last + 1] - offsets[first]
                known = letters[first:last] & (len(own.langs) > 0)
                best, score = np.zeros(last - first, np.int64), np.zeros(last - first)
                if own.langs:
                    bits = own.lengths(data[offsets[first] : offsets[last]], at)
                    best = bits.argmin(axis=1)
                    odds = np.exp2(-np.minimum(bits - bits.min(axis=1)[:, None], 1000.0))
                    score = np.where(known, 1.0 / odds.sum(axis=1), 0.0)
                picked = names[np.where(known, best, len(own.langs))]
                rows = [batch.column(k).slice(first, last - first) for k in range(n_kept + 1)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(picked, pa.string()), pa.array(score)], names=[*batch.schema.names[: n_kept + 1], pred_name, score_name])

    text = F.col("text").cast("string")
    kept = [F.col(f"`{c}`") for c in docs.columns] if whole_rows else [F.col("doc_id").cast("long").alias("doc_id")]
    letters_there = F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias(letters_name)
    rows = docs.select(*kept, held_out(F.col("doc_id")).alias(out_name), letters_there, *([] if whole_rows else [text.alias(text_name)]))
    schema = T.StructType([*rows.schema.fields[: n_kept + 1], T.StructField(pred_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    return rows.mapInArrow(score, schema)
