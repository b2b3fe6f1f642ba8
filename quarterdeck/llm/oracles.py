"""DuckDB SQL by brute force for operators whose results SQL can express."""

import re
from math import ceil

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAMS = "[array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]"

#: Operator 8: every document against every item by shared shingles.
CONTAINMENT = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest({_GRAMS}) AS g FROM d), bs AS (SELECT DISTINCT item_id, unnest({_GRAMS}) AS g FROM b),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1)
SELECT doc_id, item_id, count(*) / any_value(n) AS containment
FROM ds JOIN bs USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n) - 1e-9
"""

#: Operator 10: all pairs that share a shingle, then the closure of the links.
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN {_GRAMS} WHEN len(w) > 0 THEN [array_to_string(w, ' ') || '|' || len(w)] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, c = m.n AND c = o.n AS same FROM p JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE c >= 0.8 * (m.n + o.n - c) - 1e-9),
e AS (SELECT x, y, same FROM l UNION ALL SELECT y, x, same FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
k AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1),
f AS (SELECT x, count(*) AS n_links, min(y) FILTER (same) AS twin FROM e GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(twin, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, component_id, doc_id = component_id AS kept
FROM d JOIN k ON k.x = doc_id LEFT JOIN f ON f.x = doc_id
"""

#: Operator 6: all pairs of a label.
COSINE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
k AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1),
f AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN k ON k.x = vec_id LEFT JOIN f ON f.x = vec_id
"""


def licenses(templates, phrases: dict[str, str], threshold: float) -> str:
    """Operator 5: every line and paragraph against every template by shared pairs of adjacent words, every place against every phrase."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for label, scope, text in templates:
        words = re.findall(pattern, text.lower())
        tokens = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
        listed = ", ".join(f"'{t}'" for t in tokens)
        rows.append(f"('{label}', '{scope}', [{listed}], {ceil(threshold * len(tokens) - 1e-9)})")
    places = []
    for phrase, label in phrases.items():
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        places.append(f"SELECT r, '{label}' AS label, unnest([i - 1 FOR i IN range(1, len(w) + 1) IF {same}]) AS place FROM d")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS s, regexp_extract_all(s, '{pattern}') AS w FROM documents),
t(label, scope, tokens, need) AS (VALUES {", ".join(rows)}),
b AS (SELECT r, 'line' AS scope, unnest(string_split(s, chr(10))) AS block FROM d UNION ALL SELECT r, 'paragraph', unnest(regexp_split_to_array(s, '\\n[\\x00-\\x20]*\\n')) FROM d),
v AS (SELECT r, scope, regexp_extract_all(block, '{pattern}') AS h FROM b),
c AS (SELECT r, scope, [h[i] || ' ' || h[i + 1] FOR i IN range(1, len(h))] AS held FROM v),
m AS (SELECT r, label, len(list_intersect(tokens, held)) / len(tokens) AS share FROM c JOIN t USING (scope) WHERE len(list_intersect(tokens, held)) >= need),
p AS ({" UNION ALL ".join(places)}),
a AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM p GROUP BY r),
l AS (SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM (SELECT r, label, 1.0::DOUBLE AS share FROM p UNION ALL SELECT r, label, share FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN a USING (r) LEFT JOIN l USING (r)
"""
