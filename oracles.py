"""SQL that gives the results of the registered queries, for DuckDB."""

from __future__ import annotations

from itertools import combinations

# ------------------------------------------------------------------ inputs

READINGS = """r AS (
  SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS timestamp, ts, value,
         CAST(user_id AS DOUBLE) AS user_id,
         CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS k
  FROM events)"""
GAPPED = READINGS + """, g AS (
  SELECT event_id, timestamp, CASE WHEN event_id % 7 > 2 THEN value END AS value, user_id, k FROM r)"""
LINES = """l AS (SELECT *, l_quantity * 400 + l_extendedprice / 10 AS signal FROM lineitem)"""


FIELDS = ("value", "user_id", "k")


def key_fraction(key: str, seed: int) -> str:
    spread = f"((({key} % 2147483647) * 1327217885 + {seed}) % 2147483647)"
    return f"(CAST(({spread} * {spread}) % 2147483647 AS DOUBLE) / 2147483647.0)"


def fold(key: str, folds: int, seed: int) -> str:
    return f"CAST(floor({key_fraction(key, seed)} * {folds}) AS INTEGER)"


TRAIN = f"{key_fraction('l_orderkey', 7)} < 0.7"


def r4(x: str, digits: int = 4) -> str:
    return f"round({x}, {digits}) + 0.0"


# ------------------------------------------------------------------ models


def two_features(name: str, source: str, y: str, a: str, b: str) -> str:
    """Least squares of y on a and b: columns b0, ba, bb."""
    return f"""{name}_m AS (
  SELECT avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, var_pop({a}) AS va, var_pop({b}) AS vb,
         covar_pop({a}, {b}) AS cab, covar_pop({a}, {y}) AS cay, covar_pop({b}, {y}) AS cby
  FROM {source}),
{name}_w AS (
  SELECT *, (cay * vb - cby * cab) / (va * vb - cab * cab) AS ba,
            (cby * va - cay * cab) / (va * vb - cab * cab) AS bb FROM {name}_m),
{name} AS (SELECT ba, bb, my - ba * ma - bb * mb AS b0 FROM {name}_w)"""


def stump(name: str, points: str, by: str = "") -> str:
    """Best single split of (x, n, s) points: columns threshold, lo, hi (means)."""
    part = f"PARTITION BY {by}" if by else ""
    keep = f"{by}, " if by else ""
    pick = f"DISTINCT ON ({by}) " if by else ""
    order = f"ORDER BY {keep}gain DESC, x" + ("" if by else " LIMIT 1")
    return f"""{name}_run AS (
  SELECT {keep}x, sum(n) OVER (w ORDER BY x) AS nl, sum(s) OVER (w ORDER BY x) AS sl,
         sum(n) OVER w AS nt, sum(s) OVER w AS st, lead(x) OVER (w ORDER BY x) AS nx
  FROM {points} WINDOW w AS ({part})),
{name} AS (
  SELECT {pick}{keep}(x + nx) / 2 AS threshold, sl / nl AS lo, (st - sl) / (nt - nl) AS hi,
         sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) AS gain
  FROM {name}_run WHERE nx IS NOT NULL {order})"""


def points(name: str, source: str, y: str, by: str = "", where: str = "true") -> str:
    keep = f"{by}, " if by else ""
    return f"""{name} AS (
  SELECT {keep}l_quantity AS x, count(*) AS n, sum({y}) AS s FROM {source} WHERE {where}
  GROUP BY {keep}l_quantity)"""


def isotonic(name: str, pts: str, by: str = "", sign: int = 1) -> str:
    """Max-min formula on (x, n, s) points: column f per x. ``sign=-1`` decreases."""
    keep = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    same = f"AND i.{by} = j.{by} AND i.{by} = k.{by}" if by else ""
    ikeep = f"i.{by}, " if by else ""
    return f"""{name}_c AS (
  SELECT {keep}x, n, {sign} * s AS s, sum(n) OVER w AS cn, sum({sign} * s) OVER w AS cs
  FROM {pts} WINDOW w AS ({part} ORDER BY x)),
{name}_ij AS (
  SELECT {ikeep}i.x, j.x AS jx, min((k.cs - j.cs + j.s) / (k.cn - j.cn + j.n)) AS low
  FROM {name}_c i, {name}_c j, {name}_c k
  WHERE j.x <= i.x AND k.x >= i.x {same} GROUP BY {ikeep}i.x, j.x),
{name} AS (SELECT {keep}x, {sign} * max(low) AS f FROM {name}_ij GROUP BY {keep}x)"""


def by_quantity(ctes: str, prediction: str, joins: str) -> str:
    return f"""WITH {LINES}, {ctes}
SELECT q.l_quantity, {r4(prediction)} AS prediction, q.n
FROM (SELECT l_quantity, count(*) AS n FROM l GROUP BY 1) q {joins}"""


STUMP_SPLIT = "CASE WHEN l_quantity <= threshold THEN lo ELSE hi END"
ONE_STUMP = by_quantity(points("p", "l", "signal") + ",\n" + stump("t", "p"), STUMP_SPLIT, ", t")


def boosted(by: str = "", source: str = "p") -> str:
    """Two rounds on points: t1, then t2 on the doubled residuals."""
    keep = f"{by}, " if by else ""
    using = f"JOIN t1 USING ({by})" if by else ", t1"
    return f"""{stump("t1", source, by)},
p2 AS (
  SELECT {keep}x, n, 2 * (s - n * CASE WHEN x <= threshold THEN lo ELSE hi END) AS s
  FROM {source} {using}),
{stump("t2", "p2", by)}"""


BOOSTED = (
    "(CASE WHEN l_quantity <= t1.threshold THEN t1.lo ELSE t1.hi END"
    " + 0.1 * CASE WHEN l_quantity <= t2.threshold THEN t2.lo ELSE t2.hi END)"
)


def elastic(reg: str, alpha: str, stats: str) -> str:
    """Closed form of a one-feature elastic net from n, mx, my, sx, sy, rho."""
    return f"""SELECT *, my - weight * mx AS intercept FROM (
  SELECT *, sign(rho) * greatest(abs(rho) - {reg} / sy * {alpha}, 0)
            / (1 + {reg} / sy * (1 - {alpha})) * sy / sx AS weight FROM {stats}) e"""


QUANTITY_STATS = """avg(l_quantity) AS mx, avg(signal) AS my, stddev_pop(l_quantity) AS sx,
  stddev_pop(signal) AS sy, corr(l_quantity, signal) AS rho"""


def linear_cv() -> str:
    f = fold("l_orderkey", 5, 11)
    return f"""{LINES}, lf AS (SELECT *, {f} AS fold FROM l),
folds AS (SELECT DISTINCT fold FROM lf),
grid AS (SELECT reg_param, elastic_net FROM (VALUES (0.0::DOUBLE), (50.0), (500.0)) a(reg_param),
         (VALUES (0.0::DOUBLE), (0.5)) b(elastic_net)),
stats AS (SELECT folds.fold, {QUANTITY_STATS} FROM lf JOIN folds ON lf.fold <> folds.fold GROUP BY folds.fold),
sg AS (SELECT * FROM stats, grid),
fits AS ({elastic("reg_param", "elastic_net", "sg")}),
errors AS (
  SELECT fits.fold, reg_param, elastic_net, sqrt(avg(power(signal - weight * l_quantity - intercept, 2))) AS rmse
  FROM lf JOIN fits USING (fold) GROUP BY ALL),
means AS (SELECT reg_param, elastic_net, avg(rmse) AS mean_rmse FROM errors GROUP BY ALL)"""


def complement(folds: int) -> str:
    """Points of everything but each fold, with the fold's number."""
    f = fold("l_orderkey", folds, 11)
    return f"""{LINES}, lf AS (SELECT *, {f} AS fold FROM l),
pf AS (SELECT fold, l_quantity AS x, count(*) AS n, sum(signal) AS s FROM lf GROUP BY 1, 2),
p AS (SELECT g.fold, x, sum(n) AS n, sum(s) AS s
      FROM pf JOIN (SELECT DISTINCT fold FROM lf) g ON pf.fold <> g.fold GROUP BY 1, 2)"""


# -------------------------------------------------------------- aggregates

LINE_NUMBERS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]


def numeric_row(c: str, source: str, extra: str = "") -> str:
    q = ", ".join(f"{r4(f'quantile_cont(CAST({c} AS DOUBLE), {p})')} AS {n}" for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
    return f"""SELECT '{c}' AS "column", count({c}) AS count, {extra}{r4(f"avg({c})")} AS mean,
  {r4(f"stddev_samp({c})")} AS std, {r4(f"CAST(min({c}) AS DOUBLE)")} AS min, {q},
  {r4(f"CAST(max({c}) AS DOUBLE)")} AS max FROM {source}"""


def text_row(c: str, source: str, extra: str = "") -> str:
    return f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  arg_min(v, (-n, v)) AS top, max(n) AS freq{extra}
  FROM (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)"""


def described(source: str, numbers, texts, dates) -> str:
    """All rows of a profile, with every column of its schema."""
    no_text = 'CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, '
    no_ends = 'CAST(NULL AS VARCHAR) AS "first", CAST(NULL AS VARCHAR) AS "last", '
    no_number = ", NULL AS mean, NULL AS std, NULL AS min, NULL AS q25, NULL AS q50, NULL AS q75, NULL AS max"
    order = '"column", count, "unique", top, freq, mean, std, min, q25, q50, q75, max, "first", "last"'
    rows = [f"SELECT {order} FROM ({numeric_row(c, source, no_text + no_ends)})" for c in numbers]
    ends = ', CAST(NULL AS VARCHAR) AS "first", CAST(NULL AS VARCHAR) AS "last"'
    rows += [f"SELECT {order} FROM ({text_row(c, source, no_number + ends)})" for c in texts]
    for c in dates:
        both = f""", (SELECT CAST(min({c}) AS VARCHAR) FROM {source}) AS "first", (SELECT CAST(max({c}) AS VARCHAR) FROM {source}) AS "last\""""
        text = f"(SELECT CAST({c} AS VARCHAR) AS {c} FROM {source})"
        rows.append(f"SELECT {order} FROM ({text_row(c, text, no_number + both)})")
    return union(rows)


def union(rows) -> str:
    return "\nUNION ALL\n".join(rows)


def bin_of(c: str) -> str:
    share = f"(CAST({c} AS DOUBLE) - lo_{c}) / (hi_{c} - lo_{c})"
    return f"CASE WHEN {c} IS NOT NULL THEN CAST(least(floor({share} * 10), 9) AS INTEGER) END"


def binned(columns, source: str) -> str:
    """Bounds in b, bin numbers in c."""
    bounds = ", ".join(f"CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}" for c in columns)
    bins = ", ".join(f"{bin_of(c)} AS {c}" for c in columns)
    return f"b AS (SELECT {bounds} FROM {source}), c AS (SELECT {bins} FROM {source}, b)"


def pair_counts(columns) -> str:
    return union(
        f"""SELECT '{x}' AS x, '{y}' AS y, {x} AS x_bin, {y} AS y_bin, count(*) AS n FROM c
WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {x}, {y}"""
        for x, y in combinations(columns, 2)
    )


def histogram_rows(columns) -> str:
    return union(
        f"""SELECT '{c}' AS "column", bin, {r4(f"lo_{c} + bin * (hi_{c} - lo_{c}) / 10")} AS bin_low,
  {r4(f"lo_{c} + (bin + 1) * (hi_{c} - lo_{c}) / 10")} AS bin_high, coalesce(n, 0) AS n
FROM (SELECT CAST(i AS INTEGER) AS bin FROM generate_series(0, 9) t(i)) s
LEFT JOIN (SELECT {c} AS bin, count(*) AS n FROM c GROUP BY 1) h USING (bin), b"""
        for c in columns
    )


def corr_rows(label: str, columns, source: str, zero: bool) -> str:
    def v(c):
        return f"coalesce({c}, 0)" if zero else c

    def one(c):
        x, y = v(label), v(c)
        both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
        value = f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) FILTER ({both}) * stddev_pop({y}) FILTER ({both}), 0)"
        return f"""SELECT '{c}' AS "column", {r4(value, 8)} AS corr FROM {source}"""

    return union(one(c) for c in columns)


# ------------------------------------------------------------------ queries

MIXED_REASON = """CASE event_id % 13
  WHEN 1 THEN 'several_missing' WHEN 2 THEN 'timestamp_missing' WHEN 3 THEN 'not_numeric'
  WHEN 4 THEN 'bad_json' WHEN 5 THEN 'bad_json' WHEN 6 THEN 'unknown_field' END"""

VALUE_MODEL = two_features("m", "(SELECT * FROM g WHERE value IS NOT NULL)", "value", "user_id", "k")
FILLED_VALUES = f"""WITH {GAPPED}, {VALUE_MODEL}
SELECT event_id, {r4("coalesce(value, b0 + ba * user_id + bb * k)")} AS value, value IS NULL AS imputed FROM g, m"""

FIELD_MODELS = ",\n".join(
    two_features(name, "(SELECT * FROM r WHERE event_id % 11 > 2)", y, a, b)
    for name, y, a, b in (("mv", "value", "user_id", "k"), ("mk", "k", "value", "user_id"), ("mu", "user_id", "value", "k"))
)
FILLED_FIELDS = f"""WITH {READINGS}, {FIELD_MODELS}
SELECT event_id,
  CASE event_id % 11 WHEN 0 THEN 'value' WHEN 1 THEN 'k' WHEN 2 THEN 'user_id' END AS label,
  {r4("CASE WHEN event_id % 11 = 0 THEN mv.b0 + mv.ba * user_id + mv.bb * k ELSE value END")} AS value,
  {r4("CASE WHEN event_id % 11 = 2 THEN mu.b0 + mu.ba * value + mu.bb * k ELSE user_id END")} AS user_id,
  {r4("CASE WHEN event_id % 11 = 1 THEN mk.b0 + mk.ba * value + mk.bb * user_id ELSE k END")} AS k
FROM r, mv, mk, mu"""

SIGNAL_MODEL = f"""{LINES}, tr AS (SELECT * FROM l WHERE {TRAIN}), te AS (SELECT * FROM l WHERE NOT ({TRAIN})),
{two_features("m", "tr", "signal", "l_quantity", "l_discount")}"""

COMPARISON = f"""WITH {LINES}, tr AS (SELECT * FROM l WHERE {TRAIN}), te AS (SELECT * FROM l WHERE NOT ({TRAIN})),
{points("p", "tr", "signal")},
lin AS (SELECT regr_slope(signal, l_quantity) AS w, regr_intercept(signal, l_quantity) AS b FROM tr),
{isotonic("iso", "p")},
{boosted()},
e AS (
  SELECT signal - (b + w * l_quantity) AS linear, signal - f AS isotonic,
         signal - CASE WHEN l_quantity <= t1.threshold THEN t1.lo ELSE t1.hi END AS tree,
         signal - {BOOSTED} AS gbt
  FROM te JOIN iso ON iso.x = te.l_quantity, lin, t1, t2)
""" + union(
    f"SELECT '{a}' AS algorithm, 'signal' AS label, {r4(f'sqrt(avg({c} * {c}))')} AS rmse FROM e"
    for a, c in (
        ("linear", "linear"),
        ("isotonic", "isotonic"),
        ("decision_tree", "tree"),
        ("gbt", "gbt"),
        ("random_forest", "tree"),
    )
)


# Mean errors of a tree without splits and of one with a single split.
TREE_GRID = f"""{complement(2)}, {stump("t", "p", "fold")},
w AS (SELECT fold, sum(s) / sum(n) AS mean FROM p GROUP BY fold),
m AS (SELECT fold, sqrt(avg(power(signal - mean, 2))) AS e0, sqrt(avg(power(signal - {STUMP_SPLIT}, 2))) AS e1
      FROM lf JOIN t USING (fold) JOIN w USING (fold) GROUP BY fold),
a AS (SELECT avg(e0) AS e0, avg(e1) AS e1 FROM m)"""


def oracle_sql() -> dict[str, str]:
    events = f"WITH {READINGS} SELECT event_id, timestamp, value, user_id, k FROM r"
    gapped = f"WITH {GAPPED} SELECT event_id, timestamp, value, user_id, k FROM g"
    return {
        "csv_round_trip": events,
        "json_round_trip": gapped,
        "json_multiline": events,
        "parquet_round_trip": events,
        "decode_message": gapped,
        "preview_top5": f"WITH {READINGS} SELECT event_id, value, k FROM r ORDER BY value DESC, event_id LIMIT 5",
        "detect_missing": """SELECT event_id,
  CASE event_id % 11 WHEN 0 THEN 'value' WHEN 1 THEN 'k' WHEN 2 THEN 'user_id' END AS label,
  CASE WHEN event_id % 11 < 3 THEN 1 ELSE 0 END AS n_missing FROM events""",
        "detect_missing_all": """SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'value' WHEN 1 THEN 'value,user_id'
  WHEN 2 THEN 'timestamp' WHEN 6 THEN 'battery' ELSE '' END AS missing
FROM events WHERE event_id % 13 NOT IN (4, 5)""",
        "route_counts": f"""SELECT CASE WHEN {MIXED_REASON} IS NOT NULL THEN 'reject'
  WHEN event_id % 13 = 0 THEN 'impute' ELSE 'complete' END AS route, count(*) AS n FROM events GROUP BY 1""",
        "rejects": f"SELECT event_id, reason FROM (SELECT event_id, {MIXED_REASON} AS reason FROM events) WHERE reason IS NOT NULL",
        "rejects_non_finite": "SELECT event_id, 'not_numeric' AS reason FROM events WHERE event_id % 7 < 3",
        "stream_rejects": f"""SELECT reason, count(*) AS n FROM (SELECT {MIXED_REASON} AS reason FROM events)
WHERE reason IS NOT NULL GROUP BY reason""",
        "sample_properties": "SELECT count(*) > 0 AS is_part, count(*) > 0 AS share_holds, count(*) > 0 AS no_repeats FROM orders",
        "random_split_properties": "SELECT count(*) > 0 AS disjoint, count(*) > 0 AS whole FROM orders",
        "quartiles_approximate_error": union(
            f"""SELECT '{c}' AS "column", count({c}) > 0 AS q25_holds, count({c}) > 0 AS q50_holds, count({c}) > 0 AS q75_holds
FROM lineitem"""
            for c in LINE_NUMBERS
        ),
        "cast_label": f"WITH {GAPPED} SELECT event_id, value, k FROM g",
        "fill_label": f"WITH {GAPPED} SELECT event_id, coalesce(value, 0.0) AS value, k FROM g",
        "drop_and_select": f"WITH {READINGS} SELECT k, value, event_id FROM r",
        "numeric_only": "SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
        "calendar_features": """SELECT event_id, value, CAST(month(ts) AS INTEGER) AS month,
  CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) // 3 AS BIGINT) AS hour_range FROM events""",
        "calendar_features_zone": """SELECT event_id, CAST(month(t) AS INTEGER) AS month,
  CAST(day(t) AS INTEGER) AS day, CAST(hour(t) // 3 AS INTEGER) AS hour_range
FROM (SELECT event_id, ts + INTERVAL 9 HOUR AS t FROM events)""",
        "epoch_format": """SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS seconds,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(hour(ts) AS INTEGER) AS hour FROM events""",
        "hour_range_counts": """SELECT CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
  CAST(hour(ts) // 3 AS BIGINT) AS hour_range, count(*) AS n FROM events GROUP BY 1, 2, 3""",
        "describe_numeric": union(numeric_row(c, "lineitem") for c in LINE_NUMBERS),
        "describe_with_gaps": f"WITH {GAPPED} " + union(numeric_row(c, "g") for c in FIELDS),
        "describe_text": union(text_row(c, "documents") for c in ("text", "lang", "source")),
        "describe_lineitem": described("lineitem", LINE_NUMBERS, ("l_returnflag", "l_linestatus"), ("l_shipdate",)),
        "describe_orders": described(
            "orders", ("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderstatus", "o_orderpriority"), ("o_orderdate",)
        ),
        "quartiles": union(
            f"""SELECT '{c}' AS "column", """
            + ", ".join(
                f"{r4(f'quantile_cont(CAST({c} AS DOUBLE), {p})')} AS {n}"
                for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
            )
            + " FROM lineitem"
            for c in LINE_NUMBERS
        ),
        "corr_with_label": f"WITH {GAPPED} " + corr_rows("value", FIELDS, "g", True),
        "corr_with_label_drop": f"WITH {GAPPED} " + corr_rows("value", FIELDS, "g", False),
        "pair_density": f"WITH {binned(LINE_NUMBERS, 'lineitem')} {pair_counts(LINE_NUMBERS)}",
        "pair_density_with_gaps": f"WITH {GAPPED}, {binned(FIELDS, 'g')} {pair_counts(FIELDS)}",
        "histograms": f"WITH {binned(LINE_NUMBERS, 'lineitem')} {histogram_rows(LINE_NUMBERS)}",
        "histograms_with_gaps": f"WITH {GAPPED}, {binned(FIELDS, 'g')} {histogram_rows(FIELDS)}",
        "rmse_eval": f"""WITH {READINGS} SELECT count(value) AS n, {r4("sqrt(avg(power(value - k, 2)))")} AS rmse,
  {r4("1 - sum(power(value - k, 2)) / (var_pop(value) * count(value))")} AS r2 FROM r""",
        "sample_exact": """SELECT o_orderkey, o_custkey
FROM (SELECT *, row_number() OVER (ORDER BY md5('3:' || o_orderkey)) AS i, count(*) OVER () AS n FROM orders) WHERE i <= floor(0.8 * n + 0.5)""",
        "split_exact": """SELECT o_orderkey, CASE WHEN i <= floor(0.7 * n + 0.5) THEN 'train' ELSE 'test' END AS part
FROM (SELECT *, row_number() OVER (ORDER BY md5('3:' || o_orderkey)) AS i, count(*) OVER () AS n FROM orders)""",
        "hash_split_counts": f"""SELECT CASE WHEN {key_fraction("o_orderkey", 7)} < 0.7 THEN 'train' ELSE 'test' END AS part,
  count(*) AS n, {r4("avg(o_totalprice)")} AS mean_price FROM orders GROUP BY 1""",
        "fold_counts": f"""SELECT {fold("o_orderkey", 5, 11)} AS fold, count(*) AS n, max(o_orderkey) AS max_key
FROM orders GROUP BY 1""",
        "linear_fit": f"WITH {SIGNAL_MODEL} "
        + union(
            f"SELECT '{t}' AS term, {r4(c, 5)} AS weight FROM m"
            for t, c in (("l_quantity", "ba"), ("l_discount", "bb"), ("intercept", "b0"))
        ),
        "linear_predict": f"""WITH {SIGNAL_MODEL} SELECT l_orderkey, l_linenumber, {r4("signal")} AS signal,
  {r4("b0 + ba * l_quantity + bb * l_discount")} AS prediction FROM te, m""",
        "training_metrics": f"""WITH {SIGNAL_MODEL},
e AS (SELECT signal, signal - (b0 + ba * l_quantity + bb * l_discount) AS d FROM tr, m)
SELECT {r4("sqrt(avg(d * d))", 6)} AS train_rmse, {r4("1 - sum(d * d) / (var_pop(signal) * count(*))", 6)} AS train_r2 FROM e""",
        "elastic_net_fit": f"""WITH {LINES},
s AS (SELECT {QUANTITY_STATS} FROM l), p AS (SELECT * FROM s,
  (VALUES (0.1::DOUBLE, 0.0::DOUBLE), (50.0, 0.5), (500.0, 1.0)) v(reg_param, elastic_net)),
f AS ({elastic("reg_param", "elastic_net", "p")})
SELECT {r4("reg_param")} AS reg_param, {r4("elastic_net")} AS elastic_net, {r4("weight")} AS weight, {r4("intercept")} AS intercept FROM f""",
        "tree_stump": ONE_STUMP,
        "forest_no_bootstrap": ONE_STUMP,
        "save_load_predict": ONE_STUMP,
        "tree_rules": f"""WITH {LINES}, {points("p", "l", "signal")}, {stump("t", "p")}
SELECT 1 AS line, 'If (l_quantity <= ' || threshold || ')' AS rule FROM t
UNION ALL SELECT 3 AS line, 'Else (l_quantity > ' || threshold || ')' AS rule FROM t""",
        "gbt_two_rounds": by_quantity(points("p", "l", "signal") + ",\n" + boosted(), BOOSTED, ", t1, t2"),
        "isotonic_fit": by_quantity(
            points("p", "l", "l_extendedprice") + ",\n" + isotonic("iso", "p"), "f", "JOIN iso ON x = l_quantity"
        ),
        "isotonic_ranges": f"""WITH p AS (
  SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS DOUBLE) AS x, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1
), {isotonic("iso", "p")},
f AS (SELECT round(f, 6) AS f, x, n FROM iso JOIN p USING (x))
SELECT {r4("min(x)")} AS low, {r4("max(x)")} AS high, {r4("CAST(sum(n) AS DOUBLE)")} AS weight, {r4("f")} AS mean FROM f GROUP BY f""",
        "isotonic_decreasing": by_quantity(
            points("p", "l", "l_extendedprice") + ",\n" + isotonic("iso", "p", sign=-1), "f", "JOIN iso ON x = l_quantity"
        ),
        "isotonic_steps": f"""WITH {LINES}, {points("p", "l", "l_extendedprice")}, {isotonic("iso", "p")},
s AS (SELECT round(f, 6) AS f, min(x) AS a, max(x) AS b FROM iso GROUP BY 1)
SELECT {r4("a")} AS boundary, {r4("f")} AS prediction FROM s
UNION ALL SELECT {r4("b")} AS boundary, {r4("f")} AS prediction FROM s WHERE b > a""",
        "feature_importance": f"""WITH {LINES}, {points("p", "l", "signal")}, {stump("q", "p")},
pd AS (SELECT l_discount AS x, count(*) AS n, sum(signal) AS s FROM l GROUP BY 1), {stump("d", "pd")}
SELECT 0 AS position, 'l_quantity' AS feature, CASE WHEN q.gain > d.gain THEN 1.0::DOUBLE ELSE 0.0 END AS importance FROM q, d
UNION ALL SELECT 1 AS position, 'l_discount' AS feature, CASE WHEN q.gain > d.gain THEN 0.0::DOUBLE ELSE 1.0 END AS importance FROM q, d""",
        "cv_mean_rmse": f"""WITH {linear_cv()} SELECT {r4("reg_param", 5)} AS reg_param, {r4("elastic_net", 5)} AS elastic_net,
  {r4("mean_rmse", 5)} AS mean_rmse FROM means""",
        "best_grid_point": f"""WITH {linear_cv()},
best AS (SELECT * FROM means ORDER BY mean_rmse, reg_param, elastic_net LIMIT 1),
s AS (SELECT best.*, {QUANTITY_STATS} FROM l, best GROUP BY ALL),
f AS ({elastic("reg_param", "elastic_net", "s")})
SELECT {r4("reg_param")} AS reg_param, {r4("weight")} AS weight, {r4("intercept")} AS intercept FROM f""",
        "cv_isotonic": f"""WITH {complement(5)}, {isotonic("up", "p", "fold")}, {isotonic("down", "p", "fold", -1)},
m AS (SELECT lf.fold, sqrt(avg(power(signal - up.f, 2))) AS u, sqrt(avg(power(signal - down.f, 2))) AS d
      FROM lf JOIN up ON up.fold = lf.fold AND up.x = l_quantity
              JOIN down ON down.fold = lf.fold AND down.x = l_quantity GROUP BY lf.fold)
SELECT true AS isotonic, {r4("avg(u)")} AS mean_rmse FROM m
UNION ALL SELECT false AS isotonic, {r4("avg(d)")} AS mean_rmse FROM m""",
        "cv_decision_tree": f"""WITH {complement(2)}, {stump("t", "p", "fold")},
m AS (SELECT fold, sqrt(avg(power(signal - {STUMP_SPLIT}, 2))) AS e FROM lf JOIN t USING (fold) GROUP BY fold)
SELECT 0 AS point, {r4("avg(e)")} AS mean_rmse, true AS best FROM m""",
        "cv_tree_grid": f"""WITH {TREE_GRID}
SELECT 0 AS point, {r4("e0")} AS mean_rmse, e0 <= e1 AS best FROM a
UNION ALL SELECT 1 AS point, {r4("e1")} AS mean_rmse, e1 < e0 AS best FROM a""",
        "cv_forest_grid": f"""WITH {TREE_GRID}
SELECT point, CASE WHEN point < 2 THEN {r4("e0")} ELSE {r4("e1")} END AS mean_rmse
FROM a, (SELECT unnest([0, 1, 2, 3]) AS point)""",
        "cv_gbt": f"""WITH {complement(2)}, {boosted("fold")},
m AS (SELECT fold, sqrt(avg(power(signal - CASE WHEN l_quantity <= t1.threshold THEN t1.lo ELSE t1.hi END, 2))) AS e1,
             sqrt(avg(power(signal - {BOOSTED}, 2))) AS e2
      FROM lf JOIN t1 USING (fold) JOIN t2 USING (fold) GROUP BY fold),
a AS (SELECT avg(e1) AS e1, avg(e2) AS e2 FROM m)
SELECT 0 AS point, {r4("e1")} AS mean_rmse, e1 <= e2 AS best FROM a
UNION ALL SELECT 1 AS point, {r4("e2")} AS mean_rmse, e2 < e1 AS best FROM a""",
        "model_comparison": COMPARISON,
        "regression_run": f"""WITH {LINES}, tr AS (SELECT * FROM l WHERE {TRAIN}), te AS (SELECT * FROM l WHERE NOT ({TRAIN})),
{two_features("m", "tr", "signal", "l_orderkey", "l_quantity")}
SELECT {r4("sqrt(avg(power(signal - (b0 + ba * l_orderkey + bb * l_quantity), 2)))")} AS rmse FROM te, m""",
        "predict_missing": FILLED_VALUES,
        "predict_missing_table": FILLED_VALUES,
        "stream_impute": FILLED_VALUES,
        "stream_topic_resume": f"SELECT * FROM ({FILLED_VALUES}) WHERE event_id % 3 <> 0",
        "score_by_label": FILLED_FIELDS,
        "stream_score_by_label": FILLED_FIELDS,
        "correlation_report": f"""WITH {READINGS}, c AS (SELECT value, user_id, k, month(ts) AS month, day(ts) AS day,
  hour(ts) // 3 AS hour_range FROM r) """
        + corr_rows("value", ("value", "user_id", "k", "month", "day", "hour_range"), "c", True),
    }
