import re

import numpy as np
import pytest

from quarterdeck.llm import embeddings, jaccard
from quarterdeck.llm.components import components

DOCS = "doc_id long, text string, lang string, uid string, weight int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(k, k + 1) for k in range(400, 440)] + [(5, 5)]
    expected = groups(500, edges)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: expected[x] for e in edges if e[0] != e[1] for x in e}


def near_copies():
    rng = np.random.default_rng(7)
    vocabulary = np.array([f"w{k}" for k in range(900)])
    texts = []
    for size in (30, 80, 400):
        for _ in range(6):
            base = rng.choice(vocabulary, size)
            texts.append(" ".join(base))
            for changes in (0, 1, 2, size // 40, size // 20):
                copy = base.copy()
                copy[rng.integers(0, size, changes)] = "changed"
                texts.append(" ".join(copy))
    hot = rng.choice(vocabulary, 120)
    for k in range(700):  # a group larger than a bucket
        copy = hot.copy()
        copy[k % 120] = f"v{k}"
        texts.append(" ".join(copy))
    return texts + ["Short one", "short ONE!", "other", None, "", "...", texts[0]] + ["same same same same same"] * 30


def test_jaccard_links_against_brute_force(spark):
    texts = near_copies()
    df = spark.createDataFrame([(k, t, "en", "u", 1) for k, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in jaccard.joined(df).collect()}
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    links, counts = set(), {}
    for k, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < k:
                    shared[j] = shared.get(j, 0) + 1
        links |= {(j, k) for j, n in shared.items() if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9}
    for pair in links:
        for x in pair:
            counts[x] = counts.get(x, 0) + 1
    expected = groups(len(texts), links)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * 2 * len(links)
    assert all(got[k]["n_links"] <= counts.get(k, 0) for k in got)
    assert sum(got[k]["component_id"] == expected[k] for k in got) >= 0.99 * len(texts)
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())
    hot = [k for k, t in enumerate(texts) if t and " v" in f" {t}"]
    assert len({got[k]["component_id"] for k in hot}) == 1


def test_jaccard_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, None), (4, None, None, None, None)], DOCS)
    got = sorted((tuple(r) for r in jaccard.joined(rows).collect()), key=repr)
    assert got == [(3, 3, 2, 3, True), (3, 3, 2, 3, True), (4, 4, 0, 4, True), (None, 3, 2, 3, False)]
    assert jaccard.joined(rows.limit(0)).collect() == []


def test_jaccard_passes_repeated_rows_once(spark):
    """Rows that repeat a document don't pile up in its cluster."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, None, None, None)] * 500 + [(2, text + " more", None, None, None)] * 2 + [(3, "other words", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    members = spark.createDataFrame([(10, 10, 500, 1, 1, text)], "uid long, root long, weight long, blocks long, doc_id long, text string").selectExpr("uid", "root", "weight", "blocks", "doc_id", "xxhash64(text) AS text_hash")
    assert jaccard.shingle_rows(df, members, 5).count() <= 8
    got = {(r["doc_id"], r["n_links"], r["component_id"]) for r in jaccard.joined(df).collect()}
    assert got == {(1, 501, 1), (2, 501, 1), (3, 0, 3)}


def test_runs_reach_the_recall():
    q = 1.0
    for _ in range(jaccard.DEPTH):
        q = 1 - np.exp(-q)
    assert 1 - (1 - q) ** jaccard.runs_needed() >= jaccard.RECALL


@pytest.mark.parametrize("cell", [4096, 60])
def test_vectors_against_brute_force(spark, cell, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 32))
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(np.concatenate([base, base * 7 + 0.02 * rng.standard_normal((60, 32)), base + 0.15 * rng.standard_normal((60, 32)), base[:5]]))]
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] + [1.0] * 31, 1), (903, [None] + [1.0] * 31, 1), (904, base[0].tolist(), None), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [], 1)]
    rows += [(1000 + k, (base[0] + 0.01 * rng.standard_normal(32)).tolist(), 0) for k in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embeddings, "dealing", lambda n, t, r=0.999: (0, 1) if n <= cell else (1, 4))
    got = {r["vec_id"]: r for r in embeddings.linked(df).collect()}
    good = [(i, k, np.array(v) / np.linalg.norm(v), l) for i, (k, v, l) in enumerate(rows) if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(i, j) for n, (i, _, a, la) in enumerate(good) for j, _, b, lb in good[n + 1 :] if la == lb and len(a) == len(b) and a @ b >= embeddings.THRESHOLD]
    expected = groups(len(rows), links)
    for i, (k, _, _) in enumerate(rows):
        assert got[k]["n_links"] == sum(i in pair for pair in links)
        assert got[k]["component_id"] == rows[expected[i]][0]
        assert got[k]["kept"] == (got[k]["component_id"] == k)
    assert embeddings.linked(df.limit(0)).collect() == []


def test_collisions_are_calibrated():
    rng = np.random.default_rng(0)
    angle = np.arccos(embeddings.THRESHOLD)
    a = rng.standard_normal((4000, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((4000, 24))
    side -= (side * a).sum(1, keepdims=True) * a
    b = a * np.cos(angle) + side / np.linalg.norm(side, axis=1, keepdims=True) * np.sin(angle)
    directions = embeddings.directions(24)
    count = (np.abs((a - b) @ directions) <= embeddings.window(embeddings.THRESHOLD)).sum(1)
    assert (count >= embeddings.collisions_needed()).mean() > 0.995


def test_vectors_with_labels_of_text(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [1.0, 2.01], "a"), (3, [1.0, 2.0], "b"), (4, [1.0, 2.0], None), (5, [1.0, 2.0], "a")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (0, 4), 5: (2, 1)}
