"""The catalogue's queries as SQL for DuckDB, written from the definitions and not from the Spark plans.

Left out are the queries whose answers SQL cannot find: clusterings, deep trees and the Huber regression.
"""

from __future__ import annotations

import math
import sys
from itertools import accumulate

LINE_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"


# First digit of the md5 that serves a purpose.
DIGITS = {"sample": 1, "split": 9, "fold": 17, "part": 25}


def _hash(purpose: str, ident: str, seed: int = 1) -> str:
    return f"CAST('0x' || substr(md5('{seed}-' || {ident}), {DIGITS[purpose]}, 8) AS BIGINT)"


def _within(purpose: str, ident: str, fraction) -> str:
    return f"{_hash(purpose, ident)} < {fraction} * 4294967296"


# Series

AVERAGES = """
    SELECT user_id, ts, event_id, value,
           avg(value) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id
                            ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS average,
           row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS rn
    FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL
"""

MOVING_AVERAGE = f"""
SELECT user_id, ts, event_id, round(average, 6) AS avg FROM ({AVERAGES}) WHERE rn >= 7
"""

MOVING_AVERAGE_DAILY = """
WITH daily AS (
    SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY ALL
), numbered AS (
    SELECT user_id, day,
           avg(total) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS average,
           row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn
    FROM daily
)
SELECT user_id, CAST(day AS VARCHAR) AS day, round(average, 6) AS avg FROM numbered WHERE rn >= 7
"""

ANSWERS = f"""
    SELECT user_id,
           CAST(count(*) FILTER (WHERE rn >= 7) AS INTEGER) AS n_values,
           round(arg_max(average, rn) FILTER (WHERE rn >= 7), 6) AS last_avg,
           arg_max(ts, rn) FILTER (WHERE rn >= 7) AS last_date,
           min(ts) AS start_date
    FROM ({AVERAGES}) GROUP BY user_id
"""

MOVING_AVERAGE_ARRAYS = f"""
SELECT user_id, 0 AS part, n_values, last_avg, last_date, 7 AS num_days, start_date FROM ({ANSWERS})
"""

MOVING_AVERAGE_REQUEST = f"""
WITH requested AS (
    SELECT c_custkey * 2 AS pos, c_custkey AS user_id FROM customer
    UNION ALL SELECT s_suppkey * 2 + 1, s_suppkey FROM supplier
), answers AS ({ANSWERS})
SELECT r.pos, r.user_id, 0 AS part, coalesce(a.n_values, 0) AS n_values, a.last_avg, a.start_date
FROM requested r LEFT JOIN answers a ON r.user_id = a.user_id
"""

SERIES = f"""
SELECT user_id, 0 AS part, CAST(count(*) AS INTEGER) AS n_values,
       arg_min(value, rn) AS first_value, min(ts) AS first_date, arg_max(value, rn) AS last_value
FROM ({AVERAGES}) GROUP BY user_id
"""

# Projections, predicates, sampling, JSON

FILTER_KEYS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice AS label
FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
"""

FIND_COMPARE = """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IS NOT NULL AND o_totalprice >= 100000 AND o_totalprice < 300000 AND o_orderstatus = 'F'
"""

AGGREGATE_STEPS = """
SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines
FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey ORDER BY revenue DESC, l_suppkey LIMIT 10
"""

JSON_ROWS = """
SELECT CAST(to_json({'p_partkey': p_partkey, 'p_name': p_name,
                     'p_size': CASE WHEN p_size >= 10 THEN p_size END}) AS VARCHAR) AS json
FROM part
"""

SAMPLED = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
FROM lineitem WHERE {_within("sample", LINE_ID, 0.3)}
"""

TRAIN_TEST_SPLIT = f"""
SELECT l_returnflag, CASE WHEN {_within("split", LINE_ID, 0.8)} THEN 'train' ELSE 'test' END AS role,
       count(*) AS n, sum(l_quantity) AS quantity
FROM lineitem GROUP BY 1, 2
"""

CUSTOMER_FEATURES = """
    SELECT c_custkey, c_acctbal, n_orders, spend
    FROM customer LEFT JOIN (
        SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend FROM orders GROUP BY o_custkey
    ) ON c_custkey = o_custkey
"""


def _scaled(column: str) -> str:
    lo, hi = f"min({column}) OVER ()", f"max({column}) OVER ()"
    return (
        f"CASE WHEN {column} IS NULL THEN NULL WHEN {lo} = {hi} THEN 0.5 "
        f"ELSE ({column} - {lo}) / CAST({hi} - {lo} AS DOUBLE) END"
    )


MINMAX_SCALED = f"""
SELECT c_custkey, {", ".join(f"round({_scaled(c)}, 9) AS {c}" for c in ("c_acctbal", "n_orders", "spend"))}
FROM ({CUSTOMER_FEATURES})
"""

# Counts and summaries

COUNT_TABLES = " UNION ALL ".join(
    f"SELECT {pos} AS pos, '{name}' AS \"table\", count(*) AS count FROM {name}"
    for pos, name in enumerate(("lineitem", "region", "nation", "customer", "orders", "customer"))
)

MEAN_BY_KEY = """
SELECT user_id, round(avg(value), 6) AS mean FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY user_id
"""

MEAN_OVER_DATES = """
WITH busiest AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)
SELECT user_id, round(avg(value), 6) AS mean FROM events
WHERE user_id = (SELECT user_id FROM busiest) AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
GROUP BY user_id
"""

CENTERS = "SELECT s_nationkey, min(s_suppkey) AS parent FROM supplier GROUP BY s_nationkey"

CHILDREN = f"""
    SELECT s.s_nationkey AS cluster_id, c.parent, s.s_suppkey AS child
    FROM supplier s JOIN ({CENTERS}) c USING (s_nationkey) WHERE s.s_suppkey <> c.parent
"""

KEY_SUMMARY = f"""
WITH stats AS (
    SELECT l_suppkey,
           round(stddev_samp(l_quantity), 4) AS stddev_l_quantity,
           round(avg(l_quantity), 4) AS avg_l_quantity,
           round(stddev_samp(l_extendedprice), 4) AS stddev_l_extendedprice,
           round(avg(l_extendedprice), 4) AS avg_l_extendedprice
    FROM lineitem GROUP BY l_suppkey
)
SELECT stats.*, coalesce(CAST(c.parent AS VARCHAR), 'none') AS parent
FROM stats LEFT JOIN ({CHILDREN}) c ON stats.l_suppkey = c.child
"""

CLUSTER_GROUPS = f"""
WITH sized AS (
    SELECT *, CAST(ceil(count(*) OVER (PARTITION BY cluster_id) / 10000) AS BIGINT) AS parts FROM ({CHILDREN})
)
SELECT cluster_id, parent, CAST({_hash("part", "child", 0)} % parts AS INTEGER) AS part,
       string_agg(CAST(child AS VARCHAR), ',' ORDER BY child) AS children, FALSE AS multiple_centers
FROM sized GROUP BY ALL
UNION ALL
SELECT s_nationkey, parent, 0, '', FALSE FROM ({CENTERS})
WHERE s_nationkey NOT IN (SELECT cluster_id FROM ({CHILDREN}))
"""

# Joins

LAST_ORDERS = """
    SELECT o_custkey AS id, o_totalprice AS amount, o_orderstatus AS status, o_orderdate, o_orderkey
    FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
"""
LAST_EVENTS = """
    SELECT user_id AS id, value AS amount, event_type, ts, event_id
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
"""
CUSTOMERS = "SELECT c_custkey AS id, c_acctbal AS amount, c_mktsegment AS segment FROM customer"
LABELS = "SELECT doc_id AS id, CAST(quality AS DOUBLE) AS amount, CAST(toxic AS DOUBLE) AS toxic FROM labels"

PURCHASES = f"""
    SELECT o.*, c.segment FROM ({LAST_ORDERS}) o JOIN ({CUSTOMERS}) c ON o.id = c.id
"""

COMPOUND_LEFT = f"""
SELECT c.id, c.amount, c.segment, e.event_type, e.ts, CAST(e.event_id AS VARCHAR) AS event_id
FROM ({CUSTOMERS}) c LEFT JOIN ({LAST_EVENTS}) e ON c.id = e.id
"""

COMPOUND_RIGHT = f"""
SELECT c.id, CASE WHEN e.id IS NOT NULL THEN e.amount ELSE c.amount END AS amount,
       e.event_type, e.ts, CAST(e.event_id AS VARCHAR) AS event_id, c.segment
FROM ({LAST_EVENTS}) e RIGHT JOIN ({CUSTOMERS}) c ON e.id = c.id
"""

COMPOUND_FULL = f"""
SELECT coalesce(e.id, l.id) AS id, CASE WHEN e.id IS NOT NULL THEN e.amount ELSE l.amount END AS amount,
       e.event_type, e.ts, CAST(e.event_id AS VARCHAR) AS event_id, l.toxic
FROM ({LAST_EVENTS}) e FULL JOIN ({LABELS}) l ON e.id = l.id
"""

COMPOUND_NESTED = f"""
SELECT p.*, e.event_type, e.ts, CAST(e.event_id AS VARCHAR) AS event_id, e.toxic
FROM ({PURCHASES}) p LEFT JOIN (
    SELECT e.*, l.toxic FROM ({LAST_EVENTS}) e JOIN ({LABELS}) l ON e.id = l.id
) e ON p.id = e.id
"""


# Linear regression


def _regression(
    x: str = "l_quantity",
    reg: float = 0.0,
    alpha: float = 0.0,
    standardized: bool = True,
    intercept: bool = True,
    slope_digits: int = 4,
    rmse_digits: int = 3,
    key: str = "l_suppkey",
) -> str:
    """Minimiser of the elastic-net objective in one variable, solved by hand."""
    xy, xx, yy = ("covar_pop(x, y)", "var_pop(x)", "var_pop(y)")
    if not intercept:
        xy, xx, yy = ("avg(x * y)", "avg(x * x)", "avg(y * y)")
    l1, l2 = f"{reg * alpha} * sx", f"{reg * (1 - alpha)} / sy"
    if standardized:
        l2 = f"{l2} * sx * sx"
    else:
        l1 = f"{reg * alpha}"
    return f"""
WITH m AS (
    SELECT {key}, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy,
           {xy} AS xy, {xx} AS xx, {yy} AS yy
    FROM (SELECT {key}, {x} AS x, l_extendedprice AS y FROM lineitem) GROUP BY {key}
), fit AS (
    SELECT *, sign(xy) * greatest(abs(xy) - {l1}, 0) / (xx + {l2}) AS b FROM m
)
SELECT {key}, round(sqrt(yy - 2 * b * xy + b * b * xx), {rmse_digits}) AS rmse,
       round(CASE WHEN b = 0 THEN 0 ELSE 1 - (yy - 2 * b * xy + b * b * xx) / yy END, 8) AS r2,
       round({"my - b * mx" if intercept else "0.0"}, 2) AS intercept,
       round(b, {slope_digits}) AS slope
FROM fit
"""


PREDICTION_METRICS = """
WITH fit AS (
    SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
    FROM lineitem GROUP BY l_suppkey
), pairs AS (
    SELECT l_returnflag, l_extendedprice AS y, a + b * l_quantity AS p FROM lineitem JOIN fit USING (l_suppkey)
), means AS (
    SELECT *, avg(y) OVER (PARTITION BY l_returnflag) AS my, avg(p) OVER (PARTITION BY l_returnflag) AS mp FROM pairs
)
SELECT l_returnflag, count(*) AS n, round(sqrt(avg((y - p) ** 2)), 3) AS rmse,
       round(1 - sum((y - p) ** 2) / sum((y - my) ** 2), 8) AS r2,
       round(1 - sum((y - p) ** 2) / sum((p - mp) ** 2), 4) AS r2_swapped
FROM means GROUP BY l_returnflag
"""

# Variance shares of three features: the eigenvalues of a symmetric 3 x 3 matrix in closed form

PRINCIPAL_COMPONENTS = f"""
WITH scaled AS (
    SELECT * FROM (
        SELECT {_scaled("c_acctbal")} AS x, {_scaled("n_orders")} AS y, {_scaled("spend")} AS z
        FROM ({CUSTOMER_FEATURES})
    ) WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL
), cov AS (
    SELECT var_samp(x) AS a, var_samp(y) AS b, var_samp(z) AS c,
           covar_samp(x, y) AS d, covar_samp(y, z) AS e, covar_samp(x, z) AS f FROM scaled
), norm AS (
    SELECT *, (a + b + c) / 3 AS q FROM cov
), spread AS (
    SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM norm
), angle AS (
    SELECT *, acos(greatest(-1, least(1, (
        (a - q) * ((b - q) * (c - q) - e * e) - d * (d * (c - q) - e * f) + f * (d * e - (b - q) * f)
    ) / (2 * p ** 3)))) / 3 AS phi FROM spread
), shares AS (
    SELECT (q + 2 * p * cos(phi)) / (3 * q) AS s1, (q + 2 * p * cos(phi + 2 * pi() / 3)) / (3 * q) AS s3 FROM angle
)
SELECT component, round(CASE component WHEN 1 THEN s1 WHEN 2 THEN 1 - s1 - s3 ELSE s3 END, 8) AS explained_variance,
       CASE WHEN s1 >= 0.95 THEN 1 WHEN 1 - s3 >= 0.95 THEN 2 ELSE 3 END AS n_components
FROM shares, (VALUES (1), (2), (3)) AS c(component)
"""

# Trees of one split. The best split of a group is found by trying the midpoints between neighbouring values.

LINES = f"""
lines AS (
    SELECT l_returnflag || '-' || l_linestatus AS k, l_returnflag, l_linestatus, {LINE_ID} AS id,
           l_quantity AS f0, l_discount AS f1, l_tax AS f2, CAST(l_linenumber AS DOUBLE) AS f3, l_extendedprice AS y
    FROM lineitem
)"""

FEATURES = ("f0", "f1", "f2", "f3")


def _stump(name: str, source: str, target: str = "y", least: str = "0.0") -> str:
    """CTE ``name (g, f, t, lo, hi)``: split feature and threshold and both means, per group ``g`` of ``source``.

    ``least`` is the smallest share of the rows a side may have, an expression over the columns of ``source``.
    """
    values = " UNION ALL ".join(
        f"SELECT g, '{f}' AS f, {f} AS v, {target} AS y, {least} AS least FROM {source}" for f in FEATURES
    )
    return f"""
{name} AS (
    SELECT g, f, (v + next_v) / 2 AS t, sl / nl AS lo, (s - sl) / (n - nl) AS hi
    FROM (
        SELECT g, f, v, max(least) AS least,
               sum(count(*)) OVER upto AS nl, sum(sum(y)) OVER upto AS sl, lead(v) OVER upto AS next_v,
               sum(count(*)) OVER whole AS n, sum(sum(y)) OVER whole AS s
        FROM ({values}) GROUP BY g, f, v
        WINDOW upto AS (PARTITION BY g, f ORDER BY v), whole AS (PARTITION BY g, f)
    )
    WHERE next_v IS NOT NULL AND nl >= least * n AND n - nl >= least * n
    QUALIFY row_number() OVER (PARTITION BY g ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, f, t) = 1
)"""


def _answer(stump: str) -> str:
    """Prediction of a joined stump for the current row."""
    value = "CASE " + " ".join(f"WHEN {stump}.f = '{f}' THEN {f}" for f in FEATURES) + " END"
    return f"CASE WHEN {value} <= {stump}.t THEN {stump}.lo ELSE {stump}.hi END"


def _boosted(name: str, train: str, test: str) -> str:
    """CTE ``name``: ``test`` with predictions ``p1`` and ``p2`` after one and two boosting steps (step size 0.1)."""
    return f"""
{_stump(f"{name}_one", train)},
{name}_rest AS (
    SELECT g, f0, f1, f2, f3, 2 * (y - {_answer("one")}) AS y FROM {train} JOIN {name}_one AS one USING (g)
),
{_stump(f"{name}_two", f"{name}_rest")},
{name} AS (
    SELECT {test}.*, {_answer("one")} AS p1, {_answer("one")} + 0.1 * ({_answer("two")}) AS p2
    FROM {test} JOIN {name}_one AS one USING (g) JOIN {name}_two AS two USING (g)
)"""


def _errors(name: str, pairs: str, prediction: str) -> str:
    """CTE ``name (g, rmse, r2)`` of the predictions in ``pairs``."""
    return f"""
{name} AS (
    SELECT g, sqrt(avg((y - p) ** 2)) AS rmse, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2
    FROM (SELECT g, y, {prediction} AS p FROM {pairs}) GROUP BY g
)"""


TRAIN = _within("split", "id", 0.8)
FOLD = f"{_hash('fold', 'id')} % 2"
ACCURACY = "SELECT {g} AS line_kind, round(rmse, 4) AS rmse, round(r2, 8) AS r2 FROM {errors}"

RANDOM_FOREST_STUMP = f"""
WITH {LINES},
train AS (SELECT k AS g, * FROM lines WHERE {TRAIN}),
test AS (SELECT k AS g, * FROM lines WHERE NOT {TRAIN}),
{_stump("stump", "train")},
tested AS (SELECT test.g, y, {_answer("stump")} AS p FROM test JOIN stump USING (g)),
{_errors("errors", "tested", "p")}
{ACCURACY.format(g="g", errors="errors")}
"""

GRADIENT_BOOST_STUMPS = f"""
WITH {LINES},
train AS (SELECT k AS g, * FROM lines WHERE {TRAIN}),
test AS (SELECT k AS g, * FROM lines WHERE NOT {TRAIN}),
{_boosted("boosted", "train", "test")},
{_errors("errors", "boosted", "p2")}
{ACCURACY.format(g="g", errors="errors")}
"""

# Parents: the lowest line status of every return flag; settings chosen over two folds.

PARENT_LINES = f"""
{LINES},
parents AS (SELECT l_returnflag, min(l_linestatus) AS center FROM lineitem GROUP BY l_returnflag),
of_parents AS (SELECT * FROM lines JOIN parents USING (l_returnflag) WHERE l_linestatus = center)"""

RF_SHARES = "(VALUES (0.1), (0.45)) AS s(share)"

RF_PARENTS = f"""
{PARENT_LINES},
folds AS (
    SELECT {{'k': k, 'share': share, 'fold': fold}} AS g, *, {FOLD} AS own_fold
    FROM of_parents, {RF_SHARES}, (VALUES (0), (1)) AS f(fold) WHERE {TRAIN}
),
fold_train AS (SELECT * FROM folds WHERE own_fold <> fold),
{_stump("fold_stump", "fold_train", least="share")},
fold_tested AS (
    SELECT folds.g, y, {_answer("fold_stump")} AS p FROM folds JOIN fold_stump USING (g) WHERE own_fold = fold
),
{_errors("fold_errors", "fold_tested", "p")},
scores AS (
    SELECT g.k AS k, CAST(g.share AS DOUBLE) AS setting, avg(rmse) AS avg_rmse FROM fold_errors GROUP BY 1, 2
),
chosen AS (
    SELECT k, min(setting) AS setting
    FROM (SELECT *, min(avg_rmse) OVER (PARTITION BY k) AS least FROM scores)
    WHERE avg_rmse <= least * (1 + 1e-9) GROUP BY k
),
final_rows AS (SELECT k AS g, * FROM of_parents JOIN chosen USING (k)),
final_train AS (SELECT * FROM final_rows WHERE {TRAIN}),
{_stump("final_stump", "final_train", least="setting")},
final_tested AS (
    SELECT g, y, {_answer("final_stump")} AS p FROM final_rows JOIN final_stump USING (g) WHERE NOT {TRAIN}
),
{_errors("final_errors", "final_tested", "p")}"""

GBT_PARENTS = f"""
{PARENT_LINES},
folds AS (
    SELECT {{'k': k, 'fold': fold}} AS g, *, {FOLD} AS own_fold
    FROM of_parents, (VALUES (0), (1)) AS f(fold) WHERE {TRAIN}
),
fold_train AS (SELECT * FROM folds WHERE own_fold <> fold),
fold_test AS (SELECT * FROM folds WHERE own_fold = fold),
{_boosted("fold_boosted", "fold_train", "fold_test")},
{_errors("fold_errors1", "fold_boosted", "p1")},
{_errors("fold_errors2", "fold_boosted", "p2")},
scores AS (
    SELECT g.k AS k, 1.0 AS setting, avg(rmse) AS avg_rmse FROM fold_errors1 GROUP BY 1
    UNION ALL SELECT g.k, 2.0, avg(rmse) FROM fold_errors2 GROUP BY 1
),
chosen AS (
    SELECT k, min(setting) AS setting
    FROM (SELECT *, min(avg_rmse) OVER (PARTITION BY k) AS least FROM scores)
    WHERE avg_rmse <= least * (1 + 1e-9) GROUP BY k
),
final_rows AS (SELECT k AS g, * FROM of_parents JOIN chosen USING (k)),
final_train AS (SELECT * FROM final_rows WHERE {TRAIN}),
final_test AS (SELECT * FROM final_rows WHERE NOT {TRAIN}),
{_boosted("final_boosted", "final_train", "final_test")},
{_errors("final_errors", "final_boosted", "CASE setting WHEN 1 THEN p1 ELSE p2 END")}"""

SCORES = "SELECT k AS line_kind, CAST(setting AS DOUBLE) AS setting, round(avg_rmse, 4) AS avg_rmse FROM scores"

# Children: rounds on growing samples, up to and including the first that beats the parent's rmse.


def _children_rows(fractions: tuple[float, ...]) -> str:
    rounds = ", ".join(f"({i}, {f})" for i, f in enumerate(fractions))
    return f"""
targets AS (
    SELECT l_returnflag, center, setting, rmse AS target
    FROM final_errors JOIN chosen ON final_errors.g = chosen.k JOIN parents ON g = l_returnflag || '-' || center
),
child_rows AS (
    SELECT {{'k': k, 'round': round}} AS g, * FROM lines JOIN targets USING (l_returnflag),
           (VALUES {rounds}) AS r(round, fraction)
    WHERE l_linestatus <> center AND {_within("sample", "id", "fraction")}
),
child_train AS (SELECT * FROM child_rows WHERE {TRAIN}),
child_test AS (SELECT * FROM child_rows WHERE NOT {TRAIN})"""


CHILD_ROUNDS = """
rounds AS (
    SELECT g.k AS line_kind, g.round AS round, fraction, rmse, r2, rmse < target AS reached
    FROM child_errors JOIN (SELECT DISTINCT g, fraction, target FROM child_rows) USING (g)
)
SELECT line_kind, 'child' AS phase, round, CAST(fraction AS DOUBLE) AS fraction,
       round(rmse, 4) AS rmse, round(r2, 8) AS r2, reached
FROM rounds a WHERE NOT EXISTS (
    SELECT 1 FROM rounds b WHERE b.line_kind = a.line_kind AND b.round < a.round AND b.reached
)"""

RANDOM_FOREST_TRANSFER = f"""
WITH {RF_PARENTS},
{_children_rows((0.3, 0.6))},
{_stump("child_stump", "child_train", least="setting")},
child_tested AS (SELECT g, y, {_answer("child_stump")} AS p FROM child_test JOIN child_stump USING (g)),
{_errors("child_errors", "child_tested", "p")},
{CHILD_ROUNDS}
"""

GRADIENT_BOOST_TRANSFER = f"""
WITH {GBT_PARENTS},
{_children_rows((0.15, 0.3, 0.6))},
{_boosted("child_boosted", "child_train", "child_test")},
{_errors("child_errors", "child_boosted", "CASE setting WHEN 1 THEN p1 ELSE p2 END")},
{CHILD_ROUNDS}
"""

# Children of the default search of forests of one tree: 81 settings and three folds. Settings that differ in depth are one tree.

DEPTHS = (3, 4, 5)
RATES = (0.25, 0.5, 1.0)
CHILD_FRACTIONS = (0.3, 0.6)
# A split or setting whose figure is the best up to so much is as good; the first of them is taken.
TIE, TIE_OF_GAINS = 1e-9, 1e-12


def _times_of(rate: float) -> str:
    """How often a row is drawn: a Poisson number, by its cumulated probabilities, from ``u``."""
    steps = [math.exp(-rate)]
    while steps[-1] > 1e-17 * rate:
        steps.append(steps[-1] * rate / len(steps))
    return " + ".join(f"(u >= {c:.17e})::INT" for c in accumulate(steps))


def _scrambled(z: str, shift: int, factor: int) -> str:
    return f"(xor({z}, {z} >> {shift})::UHUGEINT * {factor}::UHUGEINT % {2**64}::UHUGEINT)::UBIGINT"


# ``u``: a number in [0, 1) from all draws of a row, by the steps of splitmix64; the seed is 1 and the tree the first.
UNIFORM = f"""
seeds AS (
    SELECT *, (xor(xor({_hash("split", "id")}::UBIGINT * {2**32}, {_hash("sample", "id")}::UBIGINT), {_hash("fold", "id")}::UBIGINT * {2**16})::UHUGEINT
               + {1_000_004 * 0x9E3779B97F4A7C15 % 2**64}::UHUGEINT) % {2**64}::UHUGEINT AS seed
    FROM lines WHERE k IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in (*FEATURES, "y"))}
),
mixed_once AS (SELECT *, {_scrambled("seed::UBIGINT", 30, 0xBF58476D1CE4E5B9)} AS z FROM seeds),
mixed AS (SELECT * EXCLUDE (z), {_scrambled("z", 27, 0x94D049BB133111EB)} AS z FROM mixed_once),
drawn AS (
    SELECT *, {TRAIN} AS train, {_hash("fold", "id")} % 3 AS own_fold, l_linestatus = center AS is_parent,
           CASE WHEN {_within("sample", "id", CHILD_FRACTIONS[0])} THEN 0 WHEN {_within("sample", "id", CHILD_FRACTIONS[1])} THEN 1 ELSE 2 END AS part,
           (xor(z, z >> 31) >> 11)::DOUBLE / {2**53} AS u
    FROM mixed JOIN parents USING (l_returnflag)
)"""

# Rows that no tree tells apart: their number, labels less their key's mean, and the draws of every rate.
CELLS = f"""
means AS (SELECT k, coalesce(avg(y) FILTER (train), 0) AS mean FROM drawn GROUP BY k),
cells AS MATERIALIZED (
    SELECT row_number() OVER () AS cell, * FROM (
        SELECT k, {", ".join(FEATURES)}, train, CASE WHEN is_parent AND train THEN own_fold ELSE -1 END AS own_fold, CASE WHEN is_parent THEN -1 ELSE part END AS part,
               count(*) AS n, sum(y - mean) AS sy, sum((y - mean) ** 2) AS syy,
               {", ".join(f"sum(w{i}) AS w{i}, sum(w{i} * (y - mean)) AS s{i}" for i in range(len(RATES)))}
        FROM (SELECT *, {", ".join(f"{_times_of(rate)} AS w{i}" for i, rate in enumerate(RATES))} FROM drawn) JOIN means USING (k)
        GROUP BY ALL
    )
)"""

# Thresholds of a key's training rows: halfway between values, where there are more values than bins those nearest to even shares.
CUTS = f"""
of_values AS (
    SELECT *, sum(n) OVER (PARTITION BY k, f ORDER BY v) AS below, sum(n) OVER (PARTITION BY k, f) AS n_rows, count(*) OVER (PARTITION BY k, f) AS n_values,
           (v + lead(v) OVER (PARTITION BY k, f ORDER BY v)) / 2 AS t
    FROM (SELECT k, f, v, sum(n) AS n FROM ({" UNION ALL ".join(f"SELECT k, {i} AS f, {c} AS v, n FROM cells WHERE train" for i, c in enumerate(FEATURES))}) GROUP BY ALL)
),
binned AS (SELECT *, greatest(2, least(max_bins, n_rows)) AS bins FROM of_values, (VALUES (32), (50), (100)) AS b(max_bins)),
cuts AS (
    SELECT DISTINCT max_bins, k, f, t FROM binned WHERE t IS NOT NULL AND n_values <= bins
    UNION
    SELECT max_bins, k, f, arg_min(t, (abs(below - n_rows * share / bins), below))
    FROM binned, range(1, 100) AS s(share) WHERE t IS NOT NULL AND n_values > bins AND share < bins GROUP BY max_bins, k, f, share
),
bins_of AS MATERIALIZED (SELECT max_bins, k, f, v, (SELECT min(t) FROM cuts c WHERE c.max_bins = o.max_bins AND c.k = o.k AND c.f = o.f AND c.t >= o.v) AS t FROM binned o)"""


def _tree(name: str, tasks: str, inside: str, held_out: str) -> str:
    """CTEs ``name_errors (g, depth, rmse, r2)`` of the trees of ``tasks (g, k, max_bins, rate, share, ...)``.

    ``inside`` and ``held_out`` say which cells a tree is grown from and tested on. Nodes have the numbers of a heap.
    """
    rate = lambda kind: f"CASE rate {' '.join(f'WHEN {r} THEN {kind}{i}' for i, r in enumerate(RATES))} END"
    steps = f"""
{name}_tasks AS MATERIALIZED ({tasks}),
{name}_at0 AS MATERIALIZED (SELECT g, cell, 1 AS node, {inside} AS inside FROM {name}_tasks t JOIN cells c USING (k) WHERE ({inside}) OR ({held_out})),
{name}_least AS MATERIALIZED (
    SELECT g, greatest(1, any_value(share) * sum(n)) AS least FROM {name}_at0 JOIN {name}_tasks USING (g) JOIN cells USING (cell) WHERE inside GROUP BY g
)"""
    for level in range(max(DEPTHS)):
        steps += f""",
{name}_sums{level} AS (
    SELECT g, node, CASE {" ".join(f"WHEN grouping({c}) = 0 THEN {i}" for i, c in enumerate(FEATURES))} END AS f, coalesce({", ".join(FEATURES)}) AS v, sum(w) AS w, sum(s) AS s
    FROM (
        SELECT g, node, {", ".join(FEATURES)}, {rate("w")} AS w, {rate("s")} AS s
        FROM {name}_at{level} JOIN {name}_tasks USING (g) JOIN cells USING (cell) WHERE inside AND node >= {2**level}
    )
    WHERE w > 0 GROUP BY GROUPING SETS ({", ".join(f"(g, node, {c})" for c in FEATURES)})
),
{name}_sides{level} AS (
    SELECT g, node, f, t, sum(sum(w)) OVER upto AS wl, sum(sum(s)) OVER upto AS sl, sum(sum(w)) OVER whole AS w, sum(sum(s)) OVER whole AS s
    FROM {name}_sums{level} JOIN {name}_tasks USING (g) JOIN bins_of USING (k, max_bins, f, v) GROUP BY g, node, f, t
    WINDOW upto AS (PARTITION BY g, node, f ORDER BY t NULLS LAST), whole AS (PARTITION BY g, node, f)
),
{name}_gains{level} AS (
    SELECT g, node, f, t, (sl * sl / wl + (s - sl) * (s - sl) / (w - wl) - s * s / w) / w AS gain, greatest((sl / wl) ** 2, ((s - sl) / (w - wl)) ** 2) AS size
    FROM {name}_sides{level} JOIN {name}_least USING (g) WHERE t IS NOT NULL AND w > wl AND wl >= least AND w - wl >= least
),
{name}_of_feature{level} AS (
    SELECT * FROM (SELECT *, max(gain) OVER (PARTITION BY g, node, f) AS most FROM {name}_gains{level} WHERE gain > {16 * sys.float_info.epsilon:.17e} * size)
    WHERE gain >= most * (1 - {TIE_OF_GAINS}) QUALIFY row_number() OVER (PARTITION BY g, node, f ORDER BY t) = 1
),
{name}_split{level} AS (
    SELECT g, node, f, t FROM (SELECT * EXCLUDE (most), max(gain) OVER (PARTITION BY g, node) AS most FROM {name}_of_feature{level})
    WHERE gain >= most * (1 - {TIE_OF_GAINS}) QUALIFY row_number() OVER (PARTITION BY g, node ORDER BY f) = 1
),
{name}_at{level + 1} AS MATERIALIZED (
    SELECT a.g, cell, inside, CASE WHEN p.f IS NULL THEN a.node ELSE 2 * a.node + (CASE p.f {" ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(FEATURES))} END > p.t)::INT END AS node
    FROM {name}_at{level} a JOIN cells USING (cell) LEFT JOIN {name}_split{level} p ON a.g = p.g AND a.node = p.node
)"""
    errors = " UNION ALL ".join(
        f"""
    SELECT g, {depth} AS depth, sum(syy - 2 * p * sy + n * p * p) AS sse, sum(n) AS n, sum(sy) AS sy, sum(syy) AS syy
    FROM {name}_at{depth} JOIN cells USING (cell) JOIN (
        SELECT g, node, CASE WHEN sum({rate("w")}) > 0 THEN sum({rate("s")}) / sum({rate("w")}) ELSE 0 END AS p
        FROM {name}_at{depth} JOIN {name}_tasks USING (g) JOIN cells USING (cell) WHERE inside GROUP BY g, node
    ) USING (g, node) WHERE NOT inside GROUP BY g"""
        for depth in DEPTHS
    )
    return f"""{steps},
{name}_errors AS MATERIALIZED (
    SELECT g, depth, sqrt(sse / n) AS rmse, CASE WHEN syy - sy * sy / n > 0 THEN 1 - sse / (syy - sy * sy / n) END AS r2 FROM ({errors})
)"""


_SEARCHED = f"""
    SELECT row_number() OVER () AS g, * FROM (SELECT DISTINCT k FROM cells WHERE part = -1), (VALUES (32), (50), (100)) AS b(max_bins),
           (VALUES {", ".join(f"({r})" for r in RATES)}) AS r(rate), (VALUES (0.1), (0.25), (0.45)) AS s(share), (VALUES (0), (1), (2)) AS f(fold)"""
_FOLLOWED = f"""
    SELECT row_number() OVER () AS g, child.k, max_bins, depth, rate, share, round, fraction, target
    FROM (SELECT DISTINCT k, l_returnflag FROM drawn WHERE NOT is_parent) child JOIN parents USING (l_returnflag)
    JOIN targets ON targets.k = l_returnflag || '-' || center, (VALUES {", ".join(f"({i}, {f})" for i, f in enumerate(CHILD_FRACTIONS))}) AS r(round, fraction)"""

# An id leaves out what is null.
RANDOM_FOREST_WHOLE_TRANSFER = f"""
WITH {LINES.replace(LINE_ID, "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)")},
parents AS (SELECT l_returnflag, min(l_linestatus) AS center FROM lineitem GROUP BY l_returnflag),
{UNIFORM},
{CELLS},
{CUTS},
{_tree("search", _SEARCHED, "train AND own_fold <> fold", "train AND own_fold = fold")},
scores AS (
    SELECT k, max_bins, depth, rate, share, avg(rmse) AS avg_rmse
    FROM search_tasks CROSS JOIN (VALUES {", ".join(f"({d})" for d in DEPTHS)}) AS d(depth) LEFT JOIN search_errors USING (g, depth) GROUP BY ALL
),
chosen AS (
    SELECT * FROM (SELECT *, min(avg_rmse) OVER (PARTITION BY k) AS least FROM scores) WHERE least IS NULL OR avg_rmse <= least * (1 + {TIE})
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY max_bins, depth, rate, share) = 1
),
{_tree("final", "SELECT row_number() OVER () AS g, * FROM chosen", "train", "NOT train")},
targets AS (SELECT t.*, rmse AS target FROM final_tasks t JOIN final_errors USING (g, depth) WHERE rmse IS NOT NULL),
{_tree("child", _FOLLOWED, "train AND part <= round", "NOT train AND part <= round")},
rounds AS (
    SELECT k AS line_kind, round, fraction, rmse, r2, coalesce(rmse < target, FALSE) AS reached FROM child_tasks LEFT JOIN child_errors USING (g, depth)
)
SELECT line_kind, 'child' AS phase, round, CAST(fraction AS DOUBLE) AS fraction, round(rmse, 4) AS rmse, round(r2, 8) AS r2, reached
FROM rounds a WHERE NOT EXISTS (SELECT 1 FROM rounds b WHERE b.line_kind = a.line_kind AND b.round < a.round AND b.reached)
"""

GROWING = ((0, 0.05), (1, 0.1), (2, 0.2), (3, 0.4), (4, 0.8))
GROWING_ROWS = "(VALUES " + ", ".join(f"({i}, {f})" for i, f in GROWING) + ") AS r(round, fraction)"
TRAIN_MOST = _within("split", "id", 0.9)

GRADIENT_BOOST_FROM_FIRST = f"""
WITH {LINES},
opening_rows AS (SELECT k AS g, * FROM lines WHERE k = (SELECT min(k) FROM lines)),
opening_train AS (SELECT * FROM opening_rows WHERE {TRAIN_MOST}),
opening_test AS (SELECT * FROM opening_rows WHERE NOT {TRAIN_MOST}),
{_boosted("opening", "opening_train", "opening_test")},
{_errors("opening_errors", "opening", "p2")},
child_rows AS (
    SELECT {{'k': k, 'round': round}} AS g, lines.*, fraction, rmse AS target, 0 AS round
    FROM lines, opening_errors, {GROWING_ROWS}
    WHERE k <> opening_errors.g AND {_within("sample", "id", "fraction")}
),
child_train AS (SELECT * FROM child_rows WHERE {TRAIN_MOST}),
child_test AS (SELECT * FROM child_rows WHERE NOT {TRAIN_MOST}),
{_boosted("child_boosted", "child_train", "child_test")},
{_errors("child_errors", "child_boosted", "p2")},
{CHILD_ROUNDS}
UNION ALL
SELECT g, 'parent', 0, 1.0, round(rmse, 4), round(r2, 8), TRUE FROM opening_errors
"""

GRADIENT_BOOST_UNTIL = f"""
WITH {LINES},
child_rows AS (
    SELECT {{'k': 'all', 'round': round}} AS g, lines.*, fraction, 28850.0 AS target
    FROM lines, {GROWING_ROWS} WHERE {_within("sample", "id", "fraction")}
),
child_train AS (SELECT * FROM child_rows WHERE {TRAIN_MOST}),
child_test AS (SELECT * FROM child_rows WHERE NOT {TRAIN_MOST}),
{_boosted("child_boosted", "child_train", "child_test")},
{_errors("child_errors", "child_boosted", "p2")},
{CHILD_ROUNDS}
"""

ORACLES = {
    "moving_average": MOVING_AVERAGE,
    "moving_average_split": MOVING_AVERAGE,
    "moving_average_array": MOVING_AVERAGE,
    "moving_average_daily": MOVING_AVERAGE_DAILY,
    "moving_average_arrays": MOVING_AVERAGE_ARRAYS,
    "moving_average_request": MOVING_AVERAGE_REQUEST,
    "series": SERIES,
    "filter_keys": FILTER_KEYS,
    "find_compare": FIND_COMPARE,
    "aggregate_steps": AGGREGATE_STEPS,
    "json_rows": JSON_ROWS,
    "sampled": SAMPLED,
    "train_test_split": TRAIN_TEST_SPLIT,
    "minmax_scaled": MINMAX_SCALED,
    "count_tables": COUNT_TABLES,
    "mean_by_key": MEAN_BY_KEY,
    "mean_over_dates": MEAN_OVER_DATES,
    "key_summary": KEY_SUMMARY,
    "cluster_groups": CLUSTER_GROUPS,
    "cluster_file": CLUSTER_GROUPS,
    "cluster_members": CHILDREN,
    "last_orders": LAST_ORDERS,
    "compound_inner": PURCHASES,
    "compound_left": COMPOUND_LEFT,
    "compound_right": COMPOUND_RIGHT,
    "compound_full": COMPOUND_FULL,
    "compound_nested": COMPOUND_NESTED,
    "linear_regression_plain": _regression(),
    "linear_regression_ridge": _regression(reg=0.5, standardized=False),
    "linear_regression_elastic": _regression(reg=10.0, alpha=0.8, standardized=False),
    "linear_regression_origin": _regression(reg=0.5, intercept=False),
    "linear_regression_time": _regression("epoch(l_shipdate)", slope_digits=10),
    "linear_regression_history": _regression(
        reg=0.3, alpha=0.5, slope_digits=3, rmse_digits=2, key="l_returnflag"
    ),
    "prediction_metrics": PREDICTION_METRICS,
    "principal_components": PRINCIPAL_COMPONENTS,
    "random_forest_stump": RANDOM_FOREST_STUMP,
    "gradient_boost_stumps": GRADIENT_BOOST_STUMPS,
    "random_forest_parents": f"WITH {RF_PARENTS} {ACCURACY.format(g='g', errors='final_errors')}",
    "gradient_boost_parents": f"WITH {GBT_PARENTS} {ACCURACY.format(g='g', errors='final_errors')}",
    "random_forest_exhaustive": f"WITH {RF_PARENTS} {SCORES}",
    "gradient_boost_exhaustive": f"WITH {GBT_PARENTS} {SCORES}",
    "random_forest_transfer": RANDOM_FOREST_TRANSFER,
    "random_forest_saved": RANDOM_FOREST_TRANSFER,
    "gradient_boost_from_first": GRADIENT_BOOST_FROM_FIRST,
    "gradient_boost_until": GRADIENT_BOOST_UNTIL,
}
