"""DuckDB SQL of the rolling selection, on rows instead of moments: a few tables for each step, unrolled.

Each window's composites are standardised; a step takes the one most correlated with the residual, makes it orthogonal to
the earlier picks, and takes its part from the residual. The rows of the target quarter go along, so the last fit is the prediction.
"""

from quarterdeck.operators.stepwise import Knobs


def rolling(names: list[str], values: list[str], knobs: Knobs, targets: tuple[int, int], steps: int) -> str:
    """Common table expressions after one named zed (entity_id, quarter_idx, y and what values are made of); they end with log, steps_fit and predicted.

    values: SQL of each composite over zed."""
    long = " UNION ALL ".join(f"SELECT entity_id, quarter_idx, y, {i} AS f, {v} AS c FROM zed" for i, v in enumerate(values))
    listed = ", ".join(f"'{n}'" for n in names)
    out = [
        f"comps AS ({long})",
        f"rows0 AS (SELECT t, entity_id AS e, quarter_idx AS q, quarter_idx < t AS train, y, f, c FROM comps, (SELECT CAST(i AS INTEGER) AS t FROM range({targets[0]}, {targets[1] + 1}) r(i)) WHERE quarter_idx = t OR y IS NOT NULL AND quarter_idx BETWEEN t - {knobs.window} AND t - 1)",
        "mid AS (SELECT t, f, coalesce(median(c), 0) AS fill FROM rows0 WHERE train GROUP BY ALL)",
        "rows1 AS MATERIALIZED (SELECT rows0.* REPLACE (coalesce(c, fill) AS c) FROM rows0 JOIN mid USING (t, f))",
        "st AS MATERIALIZED (SELECT t, f, avg(c) AS mu, CASE WHEN stddev_pop(c) < 1e-12 THEN 1 ELSE stddev_pop(c) END AS sd FROM rows1 WHERE train GROUP BY ALL)",
        "xs AS MATERIALIZED (SELECT t, e, q, train, f, (c - mu) / sd AS x FROM rows1 JOIN st USING (t, f))",
        "own AS MATERIALIZED (SELECT t, count(*) AS n, avg(y) AS my, var_pop(y) AS total FROM rows1 WHERE train AND f = 0 GROUP BY 1)",
        "b0 AS MATERIALIZED (SELECT t, e, q, train, y, y - my AS r, CAST(0 AS DOUBLE) AS fit FROM rows1 JOIN own USING (t) WHERE f = 0)",
        "g0 AS (SELECT t, n >= " + str(knobs.least_rows) + " AS ok, total AS sse, CAST([] AS INTEGER[]) AS picks FROM own)",
    ]
    for k in range(1, steps + 1):
        qs = [f"q{j}" for j in range(1, k)]
        out += [
            f"c{k} AS (SELECT t, xs.f, CASE WHEN stddev_pop(x) * stddev_pop(r) > 1e-12 THEN abs(covar_pop(x, r)) / (stddev_pop(x) * stddev_pop(r)) ELSE 0 END AS corr FROM xs JOIN b{k - 1} USING (t, e, q) JOIN g{k - 1} USING (t) WHERE xs.train AND ok AND NOT list_contains(picks, xs.f) GROUP BY ALL)",
            f"k{k} AS MATERIALIZED (SELECT t, f, corr FROM c{k} QUALIFY row_number() OVER (PARTITION BY t ORDER BY corr DESC, f) = 1)",
            f"a{k} AS MATERIALIZED (SELECT b.*, coalesce(x, 0) AS x FROM b{k - 1} b LEFT JOIN k{k} USING (t) LEFT JOIN xs ON xs.t = b.t AND xs.e = b.e AND xs.q = b.q AND xs.f = k{k}.f)",
            f"s{k} AS (SELECT t" + "".join(f", coalesce(sum(x * {q}) FILTER (train) / nullif(sum({q} * {q}) FILTER (train), 0), 0) AS s{q}" for q in qs) + f" FROM a{k} GROUP BY 1)",
            f"o{k} AS MATERIALIZED (SELECT a.* EXCLUDE (x), x" + "".join(f" - s{q} * {q}" for q in qs) + f" AS q{k} FROM a{k} a JOIN s{k} USING (t))",
            f"proj{k} AS (SELECT t, coalesce(sum(q{k} * r) FILTER (train) / nullif(sum(q{k} * q{k}) FILTER (train), 0), 0) AS b, sum(q{k} * q{k}) FILTER (train) AS qq FROM o{k} GROUP BY 1)",
            f"""g{k} AS MATERIALIZED (SELECT t, {'went' if k == 1 else f'went AND gain >= {knobs.min_improvement!r}'} AS ok, sse - CASE WHEN went THEN gain * sse ELSE 0 END AS sse, list_append(picks, f) AS picks, f, b, corr, gain, total
FROM (SELECT g.t, g.ok AND k.f IS NOT NULL AS went, g.sse, g.picks, k.f, h.b, k.corr, CASE WHEN g.sse > 1e-12 THEN h.b * h.b * h.qq / n / g.sse ELSE 0 END AS gain, own.total FROM g{k - 1} g JOIN own USING (t) JOIN proj{k} h USING (t) LEFT JOIN k{k} k USING (t)))""",
            f"b{k} AS MATERIALIZED (SELECT o.* REPLACE (CASE WHEN ok THEN q{k} ELSE 0 END AS q{k}, r - CASE WHEN ok THEN b * q{k} ELSE 0 END AS r, fit + CASE WHEN ok THEN b * q{k} ELSE 0 END AS fit) FROM o{k} o JOIN g{k} USING (t))",
        ]
    out += [
        "log AS (" + " UNION ALL ".join(f"SELECT t AS quarter_idx, t - {knobs.window} AS window_start, t - 1 AS window_end, {k} AS step, [{listed}][f + 1] AS selected_feature, b AS coefficient, 1 - sse / total AS train_r2, corr AS selection_abs_corr, gain AS sse_improvement FROM g{k} WHERE ok" for k in range(1, steps + 1)) + ")",
        "fits AS (" + " UNION ALL ".join(f"SELECT t, {k} AS step, y, fit FROM b{k} JOIN g{k} USING (t) WHERE train AND ok" for k in range(1, steps + 1)) + ")",
        """ranked AS (SELECT t, step, rank() OVER (PARTITION BY t, step ORDER BY y) + (count(*) OVER (PARTITION BY t, step, y) - 1) / 2.0 AS a, rank() OVER (PARTITION BY t, step ORDER BY fit) + (count(*) OVER (PARTITION BY t, step, fit) - 1) / 2.0 AS b FROM fits)""",
        "train_ic AS (SELECT t AS quarter_idx, step, corr(a, b) AS train_rankic FROM ranked GROUP BY ALL)",
        "chosen AS (SELECT quarter_idx, string_agg(selected_feature, ';' ORDER BY step) AS selected_features, CAST(count(*) AS INTEGER) AS selected_feature_count FROM log GROUP BY 1)",
        f"predicted AS MATERIALIZED (SELECT q AS quarter_idx, e AS entity_id, y, round(my + fit, 9) + 0.0 AS prediction, selected_features, selected_feature_count FROM b{steps} JOIN own USING (t) JOIN chosen ON chosen.quarter_idx = t WHERE NOT train)",
    ]
    return ", ".join(out)


def signed(names: list[str]) -> str:
    """After rolling(): named picked, the composites selected for each target quarter, negated where the coefficient is negative."""
    listed = ", ".join(f"'{n}'" for n in names)
    return f"picked AS (SELECT q AS quarter_idx, e AS entity_id, selected_feature AS feature, CASE WHEN coefficient < 0 THEN -c ELSE c END AS value FROM rows1 JOIN log ON log.quarter_idx = t AND [{listed}][f + 1] = selected_feature WHERE NOT train)"
