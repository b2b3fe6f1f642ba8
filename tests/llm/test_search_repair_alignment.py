"""Operators 11 to 13 against direct versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarterdeck.llm import alignment, multi_index, queries, repair

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


# --- operator 11 --------------------------------------------------------------------------------------------------------


def nearest(rows, every=20, k=20):
    out = {}
    use = [(i, v, np.array(x, float)) for i, (v, x) in enumerate(rows) if x is not None and len(x) and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    for i, v, x in use:
        if v is not None and v % every == 0:
            found = [(-float(np.einsum("j,j->", x, y)), (w is None, w or 0), j) for j, w, y in use if j != i and len(y) == len(x)]
            out.setdefault(v, []).append([(None if w[0] else w[1], -s) for s, w, _ in sorted(found)[:k]])
    return out


def recall(found: pd.DataFrame, truth: dict) -> float:
    hits = total = 0
    for v, (best,) in truth.items():
        own = found[found.query_id == v]
        worst = best[-1][1]
        total += len(best)
        hits += int((own.score >= worst - 1e-9).sum())
        assert list(own.sort_values("rank")["rank"]) == list(range(1, len(best) + 1))
        scores = own.sort_values("rank").score.to_numpy()
        assert (np.diff(scores) <= 0).all()
    return hits / total


def test_multi_index_recall(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op11_multi_index(spark, folder).toPandas()
    table = pd.read_parquet(f"{folder}/embeddings.parquet")
    truth = nearest(list(zip(table.vec_id.tolist(), table.embedding.tolist())))
    assert set(found.query_id) == set(truth) and len(found) == 20 * len(truth)
    assert recall(found, truth) >= 0.9
    vectors = {v: np.asarray(x, float) for v, x in zip(table.vec_id, table.embedding)}
    for r in found.itertuples():
        assert r.vec_id != r.query_id and r.score == np.einsum("i,i->", vectors[r.query_id], vectors[r.vec_id])


def test_multi_index_clusters_copies_and_hot_cells(spark, monkeypatch):
    """A third of the rows are copies of one vector: their cell is dealt to several parts, and ties go by vec_id."""
    monkeypatch.setattr(multi_index, "PART", 40)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 8)) * 3
    rows = [(k, (centres[k % 12] + 0.1 * rng.standard_normal(8)).tolist()) for k in range(400)] + [(k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for k in range(400, 600)]
    found = multi_index.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    truth = nearest(rows)
    assert recall(found, truth) >= 0.9
    for v in (400, 420, 580):
        own = found[found.query_id == v].sort_values("rank")
        assert own.vec_id.tolist() == [w for w in range(400, 600) if w != v][:20]


def test_multi_index_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (3, [2.0, 0.5]), (40, None), (60, []), (80, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (None, [3.0, 3.0]), (-20, [-1.0, 0.0]), (100, [1.0, 2.0, 3.0]), (101, [1.0, 0.0, 0.0]), (120, [4.0])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, x int, cell int")
    found = multi_index.searched(table).toPandas()
    expected = Counter()
    for v, lists in nearest(rows).items():
        for best in lists:
            expected.update((v, k + 1, w, s) for k, (w, s) in enumerate(best))
    got = Counter((int(r.query_id), int(r.rank), None if pd.isna(r.vec_id) else int(r.vec_id), r.score) for r in found.itertuples())
    assert got == expected
    empty = multi_index.searched(table.limit(0))
    assert empty.count() == 0 and [t for _, t in empty.dtypes] == ["bigint", "int", "bigint", "double"]


def test_traversal_is_in_order_of_the_summed_distance():
    rng = np.random.default_rng(0)
    for _ in range(20):
        d1, d2 = rng.integers(0, 5, 7).astype(float), rng.random(5)
        sizes = rng.integers(0, 4, 35).tolist()
        order = multi_index.traversed(d1, d2, sizes, 10**9)
        total = (d1[:, None] + d2[None, :]).ravel()
        assert sorted(order) == list(range(35)) and (np.diff(total[order]) >= 0).all()
        some = multi_index.traversed(d1, d2, sizes, 20)
        assert some == order[: len(some)] and sum(sizes[c] for c in some[:-1]) < 20 <= sum(sizes[c] for c in some)


# --- operator 12 --------------------------------------------------------------------------------------------------------


def repaired(rows):
    """The contract by a row loop and a recursion from the end."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        own = groups[conv]
        damage = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if damage == 1:
            text = ""
        if damage == 2:
            text = re.sub("[.!?]", "", text)
        if damage == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(damage, 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for turn, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = plain_best(own, faults)
        lines, i, done = [], 0, ""
        for edit in audit:
            after = "u" if done in ("", "s", "a") else "a"
            name = {"u": "user", "a": "assistant"}[after]
            if edit == "I":
                lines.append(f"{name}:")
                done = after
                continue
            _, role, text = own[i]
            i += 1
            if edit == "K":
                lines.append(f"{role}:{text}")
                done = role[0]
            if edit == "R":
                lines.append(f"{name}:{text}")
                done = after
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def plain_best(own, faults):
    """Cheapest, then ASCII-least edits, from the last row to the first; up to two turns are inserted in each place."""
    states = ("", "s", "u", "a")
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def with_inserts(table):
        out = {}
        for s in states:
            one, two = after[s], after[after[s]]
            out[s] = min(x for x in (table[s], (table[one][0] + 3, "I" + table[one][1]), (table[two][0] + 6, "II" + table[two][1])))
        return out

    table = with_inserts({s: (0, "") if s in ("", "a") else (10**9, "") for s in states})
    for (_, role, _), fault in zip(reversed(own), reversed(faults)):
        extra, now = 3 * (fault == "truncated"), {}
        for s in states:
            options = [(4 + table[s][0], "D" + table[s][1])]
            if fault not in ("blank", "duplicate"):
                options.append((3 + extra + table[after[s]][0], "R" + table[after[s]][1]))
                if role[:1] == after[s] or role[:1] == "s" and s == "":
                    options.append((extra + table[role[:1]][0], "K" + table[role[:1]][1]))
            now[s] = min(options)
        table = with_inserts(now)
    return table[""]


def test_repair_against_direct_version(spark):
    random.seed(3)
    table = pd.read_parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in table[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Hi.", "What", "", " \t\n", "Yes!", "no?  ", "Hi.", None, " ", "x" * 300_000 + "."]
    for conv in range(10_000, 10_300):
        for turn in range(random.randint(1, 9)):
            rows.append((conv, random.choice([turn, turn, turn, turn + 5, None]), random.choice(roles), random.choice(texts)))
    rows += [(None, 1, "user", "A."), (None, None, "assistant", "B."), (7_000_000, None, None, None)]
    rows += [(10_000_000, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(3000)]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, digest string, n int").repartition(5)
    found = repair.repaired(frame).collect()
    expected = repaired(rows)
    assert len(found) == len(expected)
    for r in found:
        assert tuple(r)[1:] == expected[r["conv_id"]], r["conv_id"]
    assert repair.NO_TEXT in {r["repaired_sha256"] for r in found}
    assert repair.repaired(frame.limit(0)).count() == 0


def test_trie_shares_layers_and_agrees_with_single_signatures():
    random.seed(1)
    signatures = sorted("".join(random.choice("SUAXsuaxd") for _ in range(random.randint(0, 30))) for _ in range(400))
    trie = repair.Trie()
    for s in signatures:
        assert trie.answer(s) == repair.Trie().answer(s)
        assert len(trie.layers) == len(s) + 1


# --- operator 13 --------------------------------------------------------------------------------------------------------


def direct(docs):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    signs = alignment.byte_values()

    def spans(parts):
        at, out = 0, []
        for i, x in parts:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    rows, counts = [], Counter()
    for doc_id, text in docs:
        ids = pairs = None
        if text:
            e = a.encode(" " + text, add_special_tokens=False).ids
            own = [(i, bytes(signs[c] for c in a.id_to_token(i))) if i != 50256 else (i, b"<|endoftext|>") for i in e]
            other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            raw = (" " + text).encode()
            if b"".join(x for _, x in own) == raw == b"".join(x for _, x in other):
                ids, pairs = (spans(own), spans(other)), Counter()
                low = 0
                for i, s, t in ids[0]:
                    while ids[1][low][2] <= s:
                        low += 1
                    k = low
                    while k < len(ids[1]) and ids[1][k][1] < t:
                        pairs[i, ids[1][k][0]] += 1
                        k += 1
                counts.update(pairs)
        rows.append((doc_id, ids, pairs))
    highest = defaultdict(int)
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    out = []
    for doc_id, ids, pairs in rows:
        if ids is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({t for _, _, t in ids[0]} & {t for _, _, t in ids[1]})
        text, low = [], [0, 0]
        for end in ends:
            both = []
            for k in (0, 1):
                own = []
                while low[k] < len(ids[k]) and ids[k][low[k]][2] <= end:
                    own.append(str(ids[k][low[k]][0]))
                    low[k] += 1
                both.append(",".join(own))
            text.append("|".join(both))
        best = sum(n for (i, j), n in pairs.items() if counts[i, j] == highest[j])
        out.append((doc_id, len(ids[0]), len(ids[1]), len(ends), sum(pairs.values()), best, sum(n * counts[p] for p, n in pairs.items()), hashlib.sha256(";".join(text).encode()).hexdigest()))
    return out


def odd_texts():
    random.seed(9)
    signs = list("ab cd  ef.,'!?\n\t\r0189éàüñçß ÅŒλжקה日本語👍🏽▁ \u0085　​\x00\x7f<>|s") + ["'s", "n't", "<|endoftext|>", "<s>", "the ", " of", "   ", "\n\n ", "caf́e"]
    return ["".join(random.choice(signs) for _ in range(random.randint(1, 60))) for _ in range(400)]


@pytest.mark.parametrize("common", [alignment.COMMON, 20])
def test_alignment_against_direct_version(spark, common, monkeypatch):
    monkeypatch.setattr(alignment, "KEEP", 3000)
    table = pd.read_parquet(f"{SMALL}/documents.parquet")
    docs = list(zip(table.doc_id.tolist(), table.text.tolist()))
    texts = [None, "", " ", "a", "▁", "ﬁ x", "<|endoftext|> and <s>", "lorem ipsum " * 3, "x" * 5000, "日本語" * 2000, "a  b   c\n  d "]
    docs += [(10**6 + k, t) for k, t in enumerate(texts + odd_texts())] + [(None, "the same"), (None, "the same")]
    frame = spark.createDataFrame([(*d, 1, "u") for d in docs], "doc_id long, text string, n long, uid string").repartition(3)
    found = alignment.compared(frame, A, B, common).collect()
    assert Counter(map(tuple, found)) == Counter(direct(docs))


def test_alignment_of_a_very_long_text_and_an_empty_table(spark):
    text = "The quick, brown fox – naïve; 3.14\n" * 40_000
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert list(map(tuple, alignment.compared(frame, A, B).collect())) == direct([(1, text)])
    assert alignment.compared(frame.limit(0), A, B).count() == 0


@pytest.mark.parametrize("common", [1, 40, 1000, alignment.COMMON])
def test_rare_pairs_count_whatever_is_broadcast(spark, common):
    """Fewer pairs than may be broadcast, and many more links: a pair of one link is no common one and still counts."""
    docs = [(k, "one and the same line of words\n" * 20) for k in range(30)] + [(99, "singular quixotic zephyr"), (100, "quixotic words")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, alignment.compared(frame, A, B, common).collect())) == Counter(direct(docs))
