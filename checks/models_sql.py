"""Linear and logistic models as SQL: columns are made orthogonal one after the other, Newton steps chained.

A fitted value is what a target loses by that, so no coefficients are needed: weighted sums over a partition take one column out of all later ones,
on train and test rows alike. Every part of the table named ``fold`` is a model of its own.
"""

from __future__ import annotations

from checks.catalog import full, layer
from checks.features import RETURN_LAYER, YEAR

FEATURES = {
    "f1": "Return",
    "f2": f"Close / nullif(({full('avg', 'Close', 20)}), 0) - 1",
    "f3": f"({full('stddev_samp', 'Log_Return', 20)}) * {YEAR}",
    "f4": full("avg", "Return", 5),
    "f5": f"(Close - ({full('avg', 'Close', 20)})) / nullif({full('stddev_samp', 'Close', 20)}, 0)",
}
X = list(FEATURES)
_AHEAD = {"y": "lead(Close) OVER w / nullif(Close, 0) - 1"} | {
    f"d{h}": f"CASE WHEN lead(Close, {h}) OVER w / nullif(Close, 0) - 1 > 0 THEN 1 ELSE 0 END" for h in (1, 5, 10, 21)
}

# Rows with all features and the next return, numbered by day and symbol.
MODEL_ROWS = ",\n".join(
    [
        RETURN_LAYER,
        layer("m", "r", FEATURES | _AHEAD, "Symbol, Date, Close, Volume"),
        "o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY Date, Symbol) - 1 AS rank, count(*) OVER () AS n FROM m WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in [*X, "y"])
        + ")",
    ]
)


def folds(n_splits: int, test_size: float, target: str, source: str = "o", total: str = "n") -> str:
    """``q``: rows once per walk-forward fold, ``tr`` for train rows."""
    cut = f"floor({total} * {test_size})"
    return (
        f"q AS MATERIALIZED (SELECT k + 1 AS fold, rank < a AS tr, {', '.join(X)}, {target} AS label FROM (SELECT *, {total} - {n_splits} * {cut} + k * {cut} AS a, {cut} AS f"
        f" FROM {source}, (SELECT unnest(range(0, {n_splits})) AS k)) WHERE rank < a + f)"
    )


def single(share: float, target: str) -> str:
    return f"q AS MATERIALIZED (SELECT 1 AS fold, rank < floor(n * {share}) AS tr, {', '.join(X)}, {target} AS label FROM o)"


def _projections(name: str, source: str, target: str) -> list[str]:
    """Layers that take g0 to gp out of the later ones and of ``target``, weighted by ``w``."""
    out, columns = [], [f"g{j}" for j in range(len(X) + 1)]
    for j, c in enumerate(columns):
        replaced = [
            f"{later} - {c} * coalesce(sum(w * {c} * {later}) OVER p / nullif(sum(w * {c} * {c}) OVER p, 0), 0) AS {later}" for later in [*columns[j + 1 :], target]
        ]
        out.append(f"{name}{j} AS (SELECT * REPLACE ({', '.join(replaced)}) FROM {source} WINDOW p AS (PARTITION BY fold))")
        source = f"{name}{j}"
    return out


def _pseudo(kind: str, ridge: str, weights: str) -> str:
    """Rows that stand for the penalty: one for each feature, without an intercept."""
    made = []
    for j, c in enumerate(X):
        spread = f"(sum(cw * {c} * {c}) FILTER (tr) - pow(sum(cw * {c}) FILTER (tr), 2) / sum(cw) FILTER (tr)) / {weights}"
        g = ", ".join(f"{f'sqrt({ridge} * ({spread}))' if i == j else '0.0'} AS {x}" for i, x in enumerate(X))
        made.append(f"SELECT fold, true AS tr, {g}, 0.0 AS label, 1.0 AS cw, 0.0 AS g0, true AS pseudo FROM {kind} GROUP BY fold")
    return " UNION ALL ".join(made)


def least_squares(ridge: float = 0.0) -> str:
    """``fit``: q with ``score``; the penalty is that of standardised features and target."""
    layers = ["base AS (SELECT *, 1.0 AS cw, 1.0 AS g0, false AS pseudo FROM q)"]
    rows = "SELECT * FROM base"
    if ridge:
        rows += " UNION ALL " + _pseudo("base", f"{ridge} / stddev_pop(label) FILTER (tr) * count(*) FILTER (tr)", "count(*) FILTER (tr)")
    g = ", ".join(f"{c} AS g{j + 1}" for j, c in enumerate(X))
    layers.append(f"ready AS (SELECT *, {g}, CASE WHEN tr THEN 1.0 ELSE 0.0 END AS w, label AS z FROM ({rows}))")
    layers += _projections("l", "ready", "z")
    layers.append(f"fit AS MATERIALIZED (SELECT fold, tr, label, label - z AS score FROM l{len(X)} WHERE NOT pseudo)")
    return ",\n".join(layers)


def logistic(ridge: float = 0.0, steps: int = 8, carry: str = "") -> str:
    """``fit``: q with ``score``, a logit; both classes carry the same total weight. ``carry`` names more columns of q, where there is no penalty."""
    carry = f", {carry}" if carry else ""
    weight = "CASE WHEN label > 0.5 THEN (count(*) FILTER (tr AND label <= 0.5) OVER p) * 1.0 / (count(*) FILTER (tr AND label > 0.5) OVER p) ELSE 1.0 END"
    layers = [f"base AS MATERIALIZED (SELECT *, {weight} AS cw, 1.0 AS g0, false AS pseudo FROM q WINDOW p AS (PARTITION BY fold))"]
    rows = "SELECT * FROM base"
    if ridge:
        rows += " UNION ALL " + _pseudo("base", f"{ridge} * sum(cw) FILTER (tr)", "(sum(cw) FILTER (tr) - sum(cw * cw) FILTER (tr) / sum(cw) FILTER (tr))")
    layers.append(f"e0 AS (SELECT *, 0.0 AS eta FROM ({rows}))")
    g = ", ".join(f"{c} AS g{j + 1}" for j, c in enumerate(X))
    for s in range(steps):
        layers.append(
            f"s{s} AS (SELECT * REPLACE (CASE WHEN pseudo THEN 0.0 ELSE 1.0 END AS g0), {g}, CASE WHEN pseudo THEN 1.0 WHEN tr THEN cw * p * (1 - p) ELSE 0.0 END AS w,"
            f" CASE WHEN pseudo OR NOT tr THEN 0.0 ELSE eta + (label - p) / (p * (1 - p)) END AS z0 FROM (SELECT *, 1 / (1 + exp(-eta)) AS p FROM e{s}))"
        )
        layers.append(f"t{s} AS (SELECT *, z0 AS z FROM s{s})")
        layers += _projections(f"n{s}_", f"t{s}", "z")
        layers.append(f"e{s + 1} AS MATERIALIZED (SELECT fold, tr, {', '.join(X)}, label, cw, g0, pseudo{carry}, z0 - z AS eta FROM n{s}_{len(X)})")
    layers.append(f"fit AS MATERIALIZED (SELECT fold, tr, label, eta AS score{carry} FROM e{steps} WHERE NOT pseudo)")
    return ",\n".join(layers)


_SOFT = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
BCE = f"(label * {_SOFT.format(x='(-score)')} + (1 - label) * {_SOFT.format(x='score')})"
# Quality of each fold's scores on ``seen`` rows.
QUALITY = (
    "seen AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r FROM fit WHERE {rows}),"
    "\nquality AS (SELECT fold, count(*) AS rows, count(*) FILTER ((score > 0) = (label > 0.5)) * 1.0 / count(*) AS accuracy,"
    " coalesce(count(*) FILTER (score > 0 AND label > 0.5) * 1.0 / nullif(count(*) FILTER (score > 0), 0), 0) AS precision,"
    " coalesce(count(*) FILTER (score > 0 AND label > 0.5) * 1.0 / nullif(count(*) FILTER (label > 0.5), 0), 0) AS recall,"
    " coalesce(2.0 * count(*) FILTER (score > 0 AND label > 0.5) / nullif(count(*) FILTER (score > 0) + count(*) FILTER (label > 0.5), 0), 0) AS f1,"
    " (sum(r) FILTER (label > 0.5) - count(*) FILTER (label > 0.5) * (count(*) FILTER (label > 0.5) + 1) / 2.0)"
    " / (count(*) FILTER (label > 0.5) * count(*) FILTER (label <= 0.5) * 1.0) AS roc_auc,"
    f" avg({BCE}) AS loss FROM seen GROUP BY fold)"
)
ERRORS = (
    "SELECT fold, count(*) AS rows, avg((label - score) * (label - score)) AS mse, sqrt(avg((label - score) * (label - score))) AS rmse,"
    " 1 - avg((label - score) * (label - score)) / var_pop(label) AS r2 FROM fit WHERE NOT tr GROUP BY fold"
)


# The newest row of every symbol with 35 bars, beside the rows the model is fitted on; unknown features take the column's median.
NEWEST = (
    "q AS MATERIALIZED (SELECT 1 AS fold, true AS tr, "
    + ", ".join(X)
    + ", d1 AS label, NULL::VARCHAR AS Symbol, NULL::DATE AS Date, NULL::DOUBLE AS Close FROM o UNION ALL SELECT 1, false, "
    + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM o))" for c in X)
    + ", 0, Symbol, Date, Close FROM (SELECT *, row_number() OVER (PARTITION BY Symbol ORDER BY Date DESC) AS age, count(*) OVER (PARTITION BY Symbol) AS bars FROM m) WHERE age = 1 AND bars >= 35)"
)
PREDICTED = (
    "SELECT Symbol, strftime(Date, '%Y-%m-%d') AS Date, round(Close, 2) AS Close, round(p, 4) AS Pred_Prob, CASE WHEN p > 0.5 THEN 'UP ▲' ELSE 'DOWN ▼' END AS Direction,"
    " round(abs(p - 0.5) * 2, 4) AS Confidence FROM (SELECT *, 1 / (1 + exp(-score)) AS p FROM fit WHERE NOT tr)"
)


def coefficients(steps: int = 8) -> str:
    """``slopes``: (j, slope) of ``logistic``'s scores, each feature's after all others have been taken out of it."""
    layers, parts = [], []
    for j in range(1, len(X) + 1):
        order = ["g0", *[f"g{k}" for k in range(1, len(X) + 1) if k != j], f"g{j}"]
        g = ", ".join(f"{c} AS g{k + 1}" for k, c in enumerate(X))
        source = f"c{j}_"
        layers.append(f"{source} AS (SELECT 1.0 AS g0, {g}, eta AS z FROM e{steps})")
        for k, c in enumerate(order[:-1]):
            replaced = ", ".join(f"{x} - {c} * (sum({c} * {x}) OVER () / nullif(sum({c} * {c}) OVER (), 0)) AS {x}" for x in [*order[k + 1 :], "z"])
            layers.append(f"c{j}_{k} AS (SELECT * REPLACE ({replaced}) FROM {source})")
            source = f"c{j}_{k}"
        parts.append(f"SELECT {j} AS j, sum(g{j} * z) / sum(g{j} * g{j}) AS slope FROM {source}")
    return ",\n".join([*layers, "slopes AS (" + " UNION ALL ".join(parts) + ")"])
