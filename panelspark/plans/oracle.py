"""The same results in plain SQL, one statement per query name."""

from __future__ import annotations

import re

from panelspark.operators.prompts import EXPLAIN_TEMPLATE, NUMBER_TEMPLATE, TOKEN_TEMPLATE
from panelspark.params import CONNECTORS, FACTOR_TERMS
from panelspark.params import FACTORS as CONFIG_FACTORS
from panelspark.plans.queries import LIMITS

SQL: dict[str, str] = {}

# --- panels -----------------------------------------------------------------------------


def _bars(name: str, src: str, series: str, ts: str, price: str, key: str) -> str:
    return f"""{name} AS (
  SELECT {series} AS series, CAST({ts} AS DATE) AS day,
         arg_min({price}, {key}) AS open, max({price}) AS high, min({price}) AS low,
         arg_max({price}, {key}) AS close, count(*) AS volume
  FROM {src} GROUP BY 1, 2)"""


ORDERS = _bars("bars", "orders", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
SUPPLIERS = _bars(
    "bars", "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_orderkey * 100 + l_linenumber"
)


def _fill(name: str = "panel", cols: tuple[str, ...] = ("close",), trading: bool = False) -> str:
    keep = "WHERE isodow(day) <= 5" if trading else ""
    carried = ", ".join(f"last_value(b.{c} IGNORE NULLS) OVER w AS {c}" for c in cols)
    return f"""{name}_days AS (
  SELECT series, day FROM (
    SELECT series, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
    FROM bars GROUP BY series) {keep}),
{name} AS (
  SELECT d.series, d.day, {carried}, b.day IS NULL AS is_filled,
         CAST(row_number() OVER w AS INTEGER) AS pos,
         CAST(count(*) OVER (PARTITION BY d.series) AS INTEGER) AS n
  FROM {name}_days d LEFT JOIN bars b ON b.series = d.series AND b.day = d.day
  WINDOW w AS (PARTITION BY d.series ORDER BY d.day))"""


ORDER_PANEL = f"WITH {ORDERS}, {_fill()}"
SUPPLIER_PANEL = f"WITH {SUPPLIERS}, {_fill()}"

# Rolling-origin windows of a panel; "keys" may add a policy.


def _origins(panel: str = "panel", key: str = "series") -> str:
    return f"""sizes AS (SELECT {key}, max(n) AS n FROM {panel} GROUP BY ALL),
counted AS (SELECT {key}, n, h, CASE WHEN n < 30 + (h + 10) * 30 THEN 1 ELSE 30 END AS w_count
  FROM sizes, (SELECT unnest([1, 5, 10]) AS h)),
wins AS (SELECT {key}, n, h AS horizon, CAST(w AS INTEGER) AS win, CAST(n - (w_count - w) * 10 - h AS INTEGER) AS window_end
  FROM (SELECT *, unnest(range(0, w_count)) AS w FROM counted)
  WHERE n - (w_count - w) * 10 - h >= 30)"""


SLIDING = """sizes AS (SELECT series, max(n) AS n FROM panel GROUP BY ALL),
wins AS (SELECT series, n, h AS horizon, CAST(w AS INTEGER) AS win, CAST(floor(n * 0.8::DOUBLE) + w + 30 AS INTEGER) AS window_end
  FROM (SELECT *, unnest(range(0, CAST(least(20, 50, n - floor(n * 0.8::DOUBLE)) AS BIGINT))) AS w
        FROM sizes, (SELECT unnest([1, 5, 10]) AS h))
  WHERE floor(n * 0.8::DOUBLE) + w + 30 + h <= n)"""

SUMMARY = """SELECT w.series, w.horizon, w.win AS "window", w.window_end,
  CAST(max(p.day) FILTER (p.pos = w.window_end) AS VARCHAR) AS window_day,
  CAST(count(*) FILTER (p.pos <= w.window_end) AS INTEGER) AS n_hist,
  round(sum(p.close) FILTER (p.pos <= w.window_end), 2) AS hist_sum,
  round(sum(p.close) FILTER (p.pos > w.window_end), 2) AS truth_sum,
  max(p.close) FILTER (p.pos = w.window_end) AS last_price
FROM wins w JOIN panel p ON p.series = w.series AND p.pos > w.window_end - {ctx} AND p.pos <= w.window_end + w.horizon
GROUP BY w.series, w.horizon, w.win, w.window_end"""

WINS = f"{ORDER_PANEL}, {_origins()}"
HIST = """hist AS (SELECT w.series, w.horizon, w.win, w.window_end, p.pos, p.day, p.close,
  lag(p.close) OVER (PARTITION BY w.series, w.horizon, w.win ORDER BY p.pos) AS prev
  FROM wins w JOIN panel p ON p.series = w.series AND p.pos > w.window_end - {ctx} AND p.pos <= w.window_end),
truth AS (SELECT w.series, w.horizon, w.win, p.pos - w.window_end AS step, p.close AS y
  FROM wins w JOIN panel p ON p.series = w.series AND p.pos > w.window_end AND p.pos <= w.window_end + w.horizon)"""
WINS30 = f"{WINS}, {HIST.format(ctx=30)}"


def _predictions(keys: str, hist: str = "hist", truth: str = "truth") -> str:
    """feat, then preds with one row per step and model; ``hist`` is cut to the lookback."""
    return f"""feat AS (SELECT {keys}, avg(close) AS m, arg_max(close, pos) AS last, arg_min(close, pos) AS first, count(*) AS k,
  CASE WHEN var_pop(prev) > 0 THEN regr_slope(close, prev) ELSE 0.0 END AS b,
  CASE WHEN var_pop(prev) > 0 THEN regr_intercept(close, prev) ELSE arg_max(close, pos) END AS a
  FROM {hist} GROUP BY {keys}),
steps AS (SELECT t.*, f.m, f.last, f.first, f.k, f.a, f.b FROM {truth} t JOIN feat f USING ({keys})),
made AS (SELECT *, unnest(['naive', 'mean', 'drift', 'ar1']) AS model,
  unnest([last, m, last + (last - first) / greatest(1, k - 1) * step,
          pow(b, step) * last + a * list_sum([pow(b, j) for j in range(0, step)])]) AS raw
  FROM steps),
preds AS (SELECT *, round(raw, 6) AS p FROM made),
moved AS (SELECT *, sign(y - before) AS up, sign(p - before) AS said,
  sign(y - y_before) AS up_step, sign(p - p_before) AS said_step FROM (
  SELECT *, coalesce(lag(y) OVER w, last) AS before, lag(y) OVER w AS y_before, lag(p) OVER w AS p_before
  FROM preds WINDOW w AS (PARTITION BY {keys}, model ORDER BY step))),
scored AS (SELECT {keys}, model, count(*) AS steps, sum((y - p) * (y - p)) AS sse, sum(abs(y - p)) AS sae,
  sum(abs((y - p) / y)) FILTER (y <> 0) AS sape, count(*) FILTER (y <> 0) AS steps_nonzero,
  sqrt(avg((y - p) * (y - p))) AS window_rmse,
  100.0 * avg(CASE WHEN up <> 0 THEN CAST(up = said AS INTEGER) END) AS window_da,
  100.0 * avg(CASE WHEN up_step <> 0 THEN CAST(up_step = said_step AS INTEGER) END) AS da_masked,
  100.0 * avg(CASE WHEN up_step IS NOT NULL THEN CAST(up_step = said_step AS INTEGER) END) AS da_unmasked,
  stddev_pop(p) AS sd_p, stddev_pop(y) AS sd_y
  FROM moved GROUP BY {keys}, model)"""


WKEYS = "series, horizon, win"
MADE = f"{WINS30}, {_predictions(WKEYS)}"

# --- study: both fill policies, two lookbacks ----------------------------------------------

STUDY = f"""WITH {ORDERS}, {_fill('cal')}, {_fill('trd', trading=True)},
panel AS (SELECT series, 'calendar' AS policy, day, close, pos, n FROM cal
  UNION ALL SELECT series, 'trading', day, close, pos, n FROM trd),
{_origins(key='series, policy')},
setups(config, policy, lookback, c) AS (VALUES ('baseline_llm', 'calendar', 30, 0), ('news_only', 'trading', 30, 1),
  ('prompt_only', 'calendar', 60, 2), ('full_model', 'trading', 60, 3)),
hist AS (SELECT w.series, w.horizon, w.win, s.config, s.c, p.pos, p.close,
  lag(p.close) OVER (PARTITION BY w.series, w.horizon, w.win, s.config ORDER BY p.pos) AS prev
  FROM wins w JOIN setups s USING (policy)
  JOIN panel p ON p.series = w.series AND p.policy = w.policy AND p.pos > w.window_end - s.lookback AND p.pos <= w.window_end),
truth AS (SELECT w.series, w.horizon, w.win, s.config, s.c, p.pos - w.window_end AS step, p.close AS y
  FROM wins w JOIN setups s USING (policy)
  JOIN panel p ON p.series = w.series AND p.policy = w.policy AND p.pos > w.window_end AND p.pos <= w.window_end + w.horizon),
{_predictions('series, horizon, win, config, c')},
kept AS (SELECT *, CASE WHEN model IN ('naive', 'mean') THEN 'baseline' ELSE 'llm' END AS type,
  list_position(['naive', 'mean', 'drift', 'ar1'], model) * 10 - 10 + c AS ord
  FROM scored WHERE model NOT IN ('naive', 'mean') OR config = 'baseline_llm'),
wres AS (SELECT type, model, CASE WHEN type = 'baseline' THEN 'baseline' ELSE config END AS config, series AS currency,
  horizon, win, ord, round(window_rmse, 4) AS window_rmse, round(window_da, 4) AS window_da FROM kept),
res AS (SELECT type, model, CASE WHEN type = 'baseline' THEN 'baseline' ELSE config END AS config, series AS currency,
  horizon, ord, round(sqrt(sum(sse) / sum(steps)), 4) AS rmse, round(sum(sae) / sum(steps), 4) AS mae,
  round(sum(sape) / sum(steps_nonzero) * 100, 4) AS mape, round(avg(window_da), 4) AS da, count(*) AS n_windows
  FROM kept GROUP BY ALL),
llm AS (SELECT * FROM res WHERE type = 'llm')"""

FACTORS = """factors(config, news, prompt) AS (VALUES ('baseline_llm', false, 'zero'), ('news_only', true, 'zero'),
  ('prompt_only', false, 'few'), ('full_model', true, 'few'))"""

# --- panels, quality, fill -------------------------------------------------------------------

SQL["bars_daily"] = f"""WITH {ORDERS}
SELECT series, CAST(day AS VARCHAR) AS day, open, high, low, close, volume FROM bars"""

_REPORT = """spans AS (SELECT series, min(day) AS a, max(day) AS b, count(*) AS actual_rows FROM {src} GROUP BY series),
expected AS (SELECT series, count(*) FILTER (isodow(d) <= 5) AS e FROM (
  SELECT series, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM spans) GROUP BY series)
SELECT series, CAST(a AS VARCHAR) AS start_date, CAST(b AS VARCHAR) AS end_date, actual_rows, e AS expected_trading_days,
  e - actual_rows AS missing_trading_days, round(actual_rows / nullif(e, 0) * 100, 2) AS completeness_pct
FROM spans JOIN expected USING (series)"""
SQL["quality_report"] = f"WITH {SUPPLIERS}, {_REPORT.format(src='bars')}"
SQL["quality_rows"] = f"""WITH rows AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day FROM orders),
{_REPORT.format(src='rows')}"""
SQL["missing_days"] = f"""WITH {SUPPLIERS}, days AS (
  SELECT series, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM bars GROUP BY series)
SELECT series, CAST(rank AS INTEGER) AS rank, CAST(day AS VARCHAR) AS missing_day FROM (
  SELECT d.series, d.day, row_number() OVER (PARTITION BY d.series ORDER BY d.day) AS rank
  FROM days d ANTI JOIN bars b ON b.series = d.series AND b.day = d.day WHERE isodow(d.day) <= 5)"""
SQL["missing_days_first10"] = SQL["missing_days"] + " WHERE rank <= 10"
SQL["fill_calendar"] = f"""WITH {ORDERS}, {_fill(cols=('open', 'high', 'low', 'close', 'volume'))}
SELECT series, CAST(day AS VARCHAR) AS day, open, high, low, close, volume, is_filled, pos, n FROM panel"""
SQL["fill_trading"] = f"""WITH {ORDERS.replace('bars AS', 'all_bars AS')},
bars AS (SELECT * FROM all_bars), {_fill(cols=('close', 'volume'), trading=True)}
SELECT series, CAST(day AS VARCHAR) AS day, close, volume, is_filled, pos, n FROM panel"""
SQL["fill_repeated_days"] = """WITH rows AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, o_orderkey,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders),
days AS (SELECT series, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM rows GROUP BY series),
filled AS (SELECT d.series, d.day, r.day IS NULL AS is_filled,
  last_value(r.price IGNORE NULLS) OVER (PARTITION BY d.series ORDER BY d.day, r.o_orderkey ROWS UNBOUNDED PRECEDING) AS price
  FROM days d LEFT JOIN rows r ON r.series = d.series AND r.day = d.day)
SELECT series, CAST(day AS VARCHAR) AS day, count(*) AS rows, count(*) FILTER (is_filled) AS filled, round(sum(price), 2) AS total
FROM filled GROUP BY series, day"""
SQL["fill_supplier_totals"] = f"""{SUPPLIER_PANEL}
SELECT series, count(*) AS days, count(*) FILTER (is_filled) AS filled_days, max(n) AS n, round(sum(close), 2) AS close_sum
FROM panel GROUP BY series"""
SQL["coerce_values"] = """SELECT event_type, count(k) AS numbers, count(TRY_CAST(event_type AS DOUBLE)) AS bad_numbers,
  sum(k) AS k_sum, count(DISTINCT day) AS days
FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(ts AS DATE) AS day FROM events)
WHERE day IS NOT NULL GROUP BY event_type"""

# --- features ----------------------------------------------------------------------------------

_LAGS = ", ".join(f"lag(close, {i}) OVER w AS lag_{i}" for i in range(1, 31))
SQL["lag_features"] = f"""{ORDER_PANEL}
SELECT series, pos, close, {', '.join(f'lag_{i}' for i in range(1, 31))} FROM (
  SELECT series, pos, close, {_LAGS} FROM panel WINDOW w AS (PARTITION BY series ORDER BY pos))
WHERE pos > 30"""
_ROLL = ", ".join(
    f"CASE WHEN count(close) OVER f{k} = {k} THEN avg(close) OVER f{k} END AS rolling_mean_{k}, "
    f"CASE WHEN count(close) OVER f{k} = {k} THEN stddev_samp(close) OVER f{k} END AS rolling_std_{k}"
    for k in (7, 14, 30)
)
_FRAMES = ", ".join(
    f"f{k} AS (PARTITION BY series ORDER BY pos ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (7, 14, 30)
)
_ROLLED = f"rolled AS (SELECT series, pos, {_ROLL} FROM panel WINDOW {_FRAMES})"
SQL["rolling_stats"] = f"""{ORDER_PANEL}, {_ROLLED}
SELECT series, pos, {', '.join(f'round(rolling_mean_{k}, 4) AS rolling_mean_{k}, round(rolling_std_{k}, 3) AS rolling_std_{k}' for k in (7, 14, 30))}
FROM rolled WHERE pos > 30"""
SQL["rolling_supplier_range"] = f"""{SUPPLIER_PANEL}, {_ROLLED}
SELECT series, count(*) AS rows, {', '.join(f'round(max(rolling_mean_{k}), 4) AS max_mean_{k}, round(max(rolling_std_{k}), 3) AS max_std_{k}' for k in (7, 14, 30))}
FROM rolled WHERE pos > 30 GROUP BY series"""
SQL["sequences"] = f"""{ORDER_PANEL}, texts AS (SELECT series, pos, n, printf('%.2f', close) AS v FROM panel)
SELECT series, pos, x, y FROM (
  SELECT series, pos, n,
    string_agg(v, ' ') OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS x,
    string_agg(v, ' ') OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS y
  FROM texts)
WHERE pos > 30 AND pos <= n - 4"""
_SCALE = """SELECT series, pos, round((close - shift) / width, 6) AS scaled,
  round((close - shift) / width * width + shift, 2) AS restored FROM panel JOIN fitted USING (series)"""
SQL["scale_minmax"] = f"""{ORDER_PANEL}, fitted AS (
  SELECT series, min(close) AS shift, coalesce(nullif(max(close) - min(close), 0), 1) AS width
  FROM panel WHERE pos <= floor(n * 0.8::DOUBLE) GROUP BY series) {_SCALE}"""
SQL["scale_standard"] = f"""{ORDER_PANEL}, fitted AS (
  SELECT series, avg(close) AS shift, coalesce(nullif(stddev_pop(close), 0), 1) AS width
  FROM panel WHERE pos <= floor(n * 0.8::DOUBLE) GROUP BY series) {_SCALE}"""
SQL["split_chrono"] = f"""{SUPPLIER_PANEL}
SELECT series, part, count(*) AS rows, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day
FROM (SELECT *, CASE WHEN pos <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM panel) GROUP BY series, part"""
SQL["tail_rows"] = f"""{SUPPLIER_PANEL}
SELECT series, CAST(day AS VARCHAR) AS day, pos, close FROM panel
QUALIFY row_number() OVER (PARTITION BY series ORDER BY day DESC) <= 5"""
SQL["row_positions"] = f"""WITH {SUPPLIERS}
SELECT series, CAST(day AS VARCHAR) AS day, row_number() OVER (PARTITION BY series ORDER BY day) AS pos,
  count(*) OVER (PARTITION BY series) AS n FROM bars"""
SQL["daily_volatility"] = f"""{SUPPLIER_PANEL}
SELECT series, round(stddev_pop(d), 3) AS daily_vol FROM (
  SELECT series, close - lag(close) OVER (PARTITION BY series ORDER BY pos) AS d FROM panel) GROUP BY series"""

# --- windows -----------------------------------------------------------------------------------

SQL["origin_windows"] = f"{SUPPLIER_PANEL}, {_origins()} {SUMMARY.format(ctx=500)}"
SQL["sliding_windows"] = f"{SUPPLIER_PANEL}, {SLIDING} {SUMMARY.format(ctx=30)}"
SQL["window_stats"] = f"""{WINS30}
SELECT series, horizon, win AS "window", arg_max(close, pos) AS current, round(avg(close), 4) AS mean,
  round(stddev_samp(close), 3) AS volatility,
  CASE WHEN arg_max(close, pos) > arg_min(close, pos) THEN 'upward' ELSE 'downward' END AS trend,
  round(stddev_pop(close - prev), 3) AS daily_vol
FROM hist GROUP BY series, horizon, win"""

# --- predictions ---------------------------------------------------------------------------------

SQL["ar1_prediction"] = f"""{SUPPLIER_PANEL},
diffs AS (SELECT *, close - lag(close) OVER w AS y FROM panel WHERE pos <= floor(n * 0.8::DOUBLE) WINDOW w AS (PARTITION BY series ORDER BY pos)),
pairs AS (SELECT *, lag(y) OVER (PARTITION BY series ORDER BY pos) AS x FROM diffs),
fits AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS pairs FROM pairs WHERE pos > 2 GROUP BY series),
ends AS (SELECT series, arg_max(close, pos) AS last, arg_max(y, pos) AS d FROM diffs GROUP BY series),
steps AS (SELECT *, unnest(range(1, 11)) AS step FROM fits JOIN ends USING (series)),
moves AS (SELECT *, pow(b, step) * d + a * list_sum([pow(b, j) for j in range(0, step)]) AS move FROM steps)
SELECT series, pairs, round(b, 6) AS slope, round(a, 4) AS intercept, CAST(step AS INTEGER) AS step,
  round(last + sum(move) OVER (PARTITION BY series ORDER BY step), 3) AS pred FROM moves"""


def _order_scores(max_p: int, max_d: int) -> str:
    """Residual variances of nested regressions by removing lag after lag from the covariances."""
    ctes, finals = [], []
    names = [f"l{i}" for i in range(1, max_p + 1)] + ["y"]
    size = max_p + 1
    for d in range(max_d + 1):
        y = {0: "close", 1: "close - lag(close) OVER w", 2: "close - 2 * lag(close) OVER w + lag(close, 2) OVER w"}[d]
        lags = ", ".join(f"lag(y, {i}) OVER w AS l{i}" for i in range(1, max_p + 1))
        cov = {(i, j): f"c_{i}_{j}" for i in range(size) for j in range(i, size)}
        sums = ", ".join(f"covar_pop({names[i]}, {names[j]}) AS {c}" for (i, j), c in cov.items())
        ctes.append(
            f"y{d} AS (SELECT series, pos, {y} AS y FROM panel WHERE pos <= floor(n * 0.8::DOUBLE) WINDOW w AS (PARTITION BY series ORDER BY pos))"
        )
        ctes.append(f"x{d} AS (SELECT *, {lags} FROM y{d} WINDOW w AS (PARTITION BY series ORDER BY pos))")
        ctes.append(f"m{d}_0 AS (SELECT series, count(*) AS pairs, {sums} FROM x{d} WHERE pos > {max_p + d} GROUP BY series)")
        for k in range(max_p + 1):
            finals.append(
                f"SELECT series, {k} AS p, {d} AS d, pairs, pairs * ln({cov[(max_p, max_p)]}) + 2 * ({k} + 1) AS aic FROM m{d}_{k}"
            )
            if k < max_p:
                new = {}
                for i in range(k + 1, size):
                    for j in range(i, size):
                        new[(i, j)] = f"s{k}_{i}_{j}"
                exprs = ", ".join(
                    f"{cov[(i, j)]} - {cov[(min(i, k), max(i, k))]} * {cov[(min(j, k), max(j, k))]} / {cov[(k, k)]} AS {name}"
                    for (i, j), name in new.items()
                )
                ctes.append(f"m{d}_{k + 1} AS (SELECT *, {exprs} FROM m{d}_{k})")
                cov = {**cov, **new}
    return ", ".join(ctes) + ", aics AS (" + " UNION ALL ".join(finals) + ")"


SQL["arp_prediction"] = f"""WITH RECURSIVE {ORDER_PANEL.removeprefix('WITH ')},
diffs AS (SELECT series, pos, close, close - lag(close) OVER w AS y FROM panel WHERE pos <= floor(n * 0.8::DOUBLE) WINDOW w AS (PARTITION BY series ORDER BY pos)),
pairs AS (SELECT *, lag(y) OVER w AS x1, lag(y, 2) OVER w AS x2 FROM diffs WINDOW w AS (PARTITION BY series ORDER BY pos)),
sums AS (SELECT series, count(*) AS pairs, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22,
  covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM pairs WHERE pos > 3 GROUP BY series),
fits AS (SELECT series, pairs, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS c1,
  (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS c2, my, m1, m2 FROM sums),
ends AS (SELECT series, arg_max(close, pos) AS level, arg_max(y, pos) AS y1, arg_max(x1, pos) AS y2 FROM pairs GROUP BY series),
path AS (SELECT series, pairs, c1, c2, my - c1 * m1 - c2 * m2 AS c0, 0 AS step, level, y1, y2 FROM fits JOIN ends USING (series)
  UNION ALL SELECT series, pairs, c1, c2, c0, step + 1, level + c0 + c1 * y1 + c2 * y2, c0 + c1 * y1 + c2 * y2, y1 FROM path WHERE step < 10)
SELECT series, pairs, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c0, 3) AS intercept, step, round(level, 3) AS pred FROM path WHERE step > 0"""


def _regression(source: str, names: list[str], to: str) -> str:
    """CTEs ``to``_0, ``to``_1, ... ending in ``to``: coefficients b0.. of the last name on the others, by elimination, and the intercept."""
    p = len(names) - 1
    cov = {(i, j): f"c_{i}_{j}" for i in range(p + 1) for j in range(i, p + 1)}
    sums = ", ".join([f"covar_pop({names[i]}, {names[j]}) AS {c}" for (i, j), c in cov.items()] + [f"avg({x}) AS m{i}" for i, x in enumerate(names)])
    ctes = [f"{to}_0 AS (SELECT series, count(*) AS pairs, {sums} FROM {source} GROUP BY series)"]
    for k in range(p):
        new = {(i, j): f"s{k}_{i}_{j}" for i in range(k + 1, p + 1) for j in range(i, p + 1)}
        made = ", ".join(f"{cov[i, j]} - {cov[k, i]} * {cov[k, j]} / {cov[k, k]} AS {x}" for (i, j), x in new.items())
        ctes.append(f"{to}_{k + 1} AS (SELECT *, {made} FROM {to}_{k})")
        cov |= new
    last = f"{to}_{p}"
    for k in reversed(range(p)):
        rest = "".join(f" - {cov[k, j]} * b{j}" for j in range(k + 1, p))
        ctes.append(f"{to}_b{k} AS (SELECT *, ({cov[k, p]}{rest}) / {cov[k, k]} AS b{k} FROM {last})")
        last = f"{to}_b{k}"
    slopes = "".join(f" - b{k} * m{k}" for k in range(p))
    return ", ".join([*ctes, f"{to} AS (SELECT series, pairs, m{p}{slopes} AS b, {', '.join(f'b{k}' for k in range(p))} FROM {last})"])


SQL["arma_prediction"] = f"""WITH RECURSIVE {ORDER_PANEL.removeprefix('WITH ')},
diffs AS (SELECT series, pos, close, close - lag(close) OVER (PARTITION BY series ORDER BY pos) AS y FROM panel WHERE pos <= floor(n * 0.8::DOUBLE)),
lags AS (SELECT *, {', '.join(f'lag(y, {i}) OVER w AS l{i}' for i in range(1, 6))} FROM diffs WINDOW w AS (PARTITION BY series ORDER BY pos)),
used AS (SELECT * FROM lags WHERE pos > 6), {_regression('used', ['l1', 'l2', 'l3', 'l4', 'y'], 'far')},
shocks AS (SELECT lags.*, y - b - b0 * l1 - b1 * l2 - b2 * l3 - b3 * l4 AS e, l1 - b - b0 * l2 - b1 * l3 - b2 * l4 - b3 * l5 AS e1 FROM lags JOIN far USING (series)),
later AS (SELECT * FROM shocks WHERE pos > 6), {_regression('later', ['l1', 'e1', 'y'], 'fit')},
ends AS (SELECT series, arg_max(close, pos) AS level, arg_max(y, pos) AS y, arg_max(e, pos) AS e FROM shocks GROUP BY series),
path AS (SELECT series, pairs, b, b0, b1, 0 AS step, level, y, e FROM fit JOIN ends USING (series)
  UNION ALL SELECT series, pairs, b, b0, b1, step + 1, level + b + b0 * y + b1 * e, b + b0 * y + b1 * e, 0.0 FROM path WHERE step < 10)
SELECT series, pairs, round(b0, 5) AS ar1, round(b1, 5) AS ma1, round(b, 3) AS intercept, step, round(level, 2) AS pred FROM path WHERE step > 0"""
SQL["order_select"] = f"""{ORDER_PANEL}, {_order_scores(3, 2)}
SELECT series, p, d, pairs, round(aic, 3) AS aic FROM aics
QUALIFY row_number() OVER (PARTITION BY series ORDER BY aic, p, d) = 1"""
SQL["direct_multi_step"] = f"""{ORDER_PANEL}, train AS (SELECT * FROM panel WHERE pos <= floor(n * 0.8::DOUBLE)),
pairs AS (SELECT a.series, b.pos - a.pos AS step, a.close AS x, b.close AS y FROM train a
  JOIN train b ON a.series = b.series AND b.pos > a.pos AND b.pos <= a.pos + 10),
ends AS (SELECT series, arg_max(close, pos) AS last_price FROM train GROUP BY series)
SELECT series, CAST(step AS INTEGER) AS step, last_price, round(regr_slope(y, x), 6) AS slope,
  round(regr_intercept(y, x) + regr_slope(y, x) * last_price, 3) AS pred
FROM pairs JOIN ends USING (series) GROUP BY series, step, last_price"""
SQL["gbt_prediction"] = f"""{ORDER_PANEL}, train AS (SELECT * FROM panel WHERE pos <= floor(n * 0.8::DOUBLE)),
lags AS (SELECT series, pos, lag(close, 30) OVER w AS lag_30, avg(close) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS mean_14
  FROM train WINDOW w AS (PARTITION BY series ORDER BY pos)),
sums AS (SELECT series, count(*) AS train_rows, round(sum(lag_30), 2) AS lag_30_sum, round(sum(mean_14), 2) AS mean_14_sum
  FROM lags WHERE pos > 30 GROUP BY series)
SELECT series, CAST(step AS INTEGER) AS step, train_rows, lag_30_sum, mean_14_sum, true AS in_range
FROM sums, (SELECT unnest(range(1, 6)) AS step)"""
SQL["naive_prediction"] = f"""{MADE}
SELECT series, horizon, win AS "window", model, CAST(step AS INTEGER) AS step, round(p, 3) AS pred FROM preds"""

# --- accuracy ----------------------------------------------------------------------------------

_MICRO = """round(sqrt(sum(sse) / sum(steps)), 4) AS rmse, round(sum(sae) / sum(steps), 4) AS mae,
  coalesce(round(sum(sape) / nullif(sum(steps_nonzero), 0) * 100, 4), 'Infinity'::DOUBLE) AS mape"""
SQL["metrics_micro"] = f"""{SUPPLIER_PANEL}, {_origins()}, {HIST.format(ctx=30)}, {_predictions(WKEYS)}
SELECT series, horizon, model, {_MICRO}, count(*) AS n_windows FROM scored GROUP BY series, horizon, model"""
SQL["metrics_rows"] = f"""{MADE}
SELECT series, horizon, model, {_MICRO}, CAST(sum(steps) AS BIGINT) AS steps FROM scored GROUP BY series, horizon, model"""
SQL["metrics_da"] = f"""{MADE}
SELECT series, horizon, model, round(avg(window_da), 4) AS da, count(*) AS n_windows FROM scored GROUP BY series, horizon, model"""
SQL["metrics_da_diff"] = f"""{MADE}
SELECT series, horizon, model, round(avg(da_masked), 4) AS da_masked, round(avg(da_unmasked), 4) AS da_unmasked,
  count(da_masked) AS defined FROM scored GROUP BY series, horizon, model"""
SQL["window_metrics"] = f"""{STUDY}
SELECT type, model, config, currency, horizon, win AS "window", window_rmse, window_da FROM wres"""

# --- comparisons -------------------------------------------------------------------------------

SQL["param_grid"] = f"""WITH {SUPPLIERS}, {FACTORS},
runs(type, model, config) AS (SELECT 'baseline', unnest(['naive', 'mean']), 'baseline'
  UNION ALL SELECT 'llm', m, config FROM factors, (SELECT unnest(['drift', 'ar1']) AS m))
SELECT b.series, b.bars, r.type, r.model, r.config, h.horizon, CAST(f.news AS VARCHAR) AS news, f.prompt
FROM (SELECT series, count(*) AS bars FROM bars GROUP BY series) b, runs r LEFT JOIN factors f USING (config),
  (SELECT unnest([1, 5, 10]) AS horizon) h"""
SQL["leaderboard"] = f"""{STUDY}
(SELECT 'rmse' AS metric, model, config, currency, horizon, rmse AS value FROM res ORDER BY rmse, ord, currency, horizon LIMIT 10)
UNION ALL
(SELECT 'da', model, config, currency, horizon, da FROM res WHERE da IS NOT NULL ORDER BY da DESC, ord, currency, horizon LIMIT 10)"""
_BEST_RMSE = "row_number() OVER (PARTITION BY currency, horizon ORDER BY rmse, ord) = 1"
_BEST_DA = "row_number() OVER (PARTITION BY currency, horizon ORDER BY da DESC NULLS LAST, ord) = 1"
SQL["best_per_group"] = f"""{STUDY}
SELECT 'rmse' AS metric, currency, horizon, model, config, rmse AS value FROM res QUALIFY {_BEST_RMSE}
UNION ALL SELECT 'da', currency, horizon, model, config, da FROM res QUALIFY {_BEST_DA}"""
SQL["best_by_mean"] = f"""{STUDY}
SELECT currency, horizon, model, config, round(m, 4) AS mean_metric FROM (
  SELECT currency, horizon, model, config, avg(window_rmse) AS m FROM wres WHERE type = 'llm' GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY currency, horizon, model ORDER BY m, config) = 1"""
SQL["best_summary"] = f"""{STUDY},
low AS (SELECT currency, horizon, model || ' (' || config || ')' AS best_model_rmse, rmse, mae, mape, da FROM res QUALIFY {_BEST_RMSE}),
high AS (SELECT currency, horizon, model || ' (' || config || ')' AS best_model_da, da AS best_da FROM res QUALIFY {_BEST_DA})
SELECT * FROM low LEFT JOIN high USING (currency, horizon)"""
DELTAS = """deltas AS (SELECT l.*, l.rmse - b.rmse AS rmse_delta, l.da - b.da AS da_delta FROM llm l
  LEFT JOIN llm b ON b.config = 'baseline_llm' AND b.currency = l.currency AND b.horizon = l.horizon AND b.model = l.model)"""
DSUM = f"""{DELTAS},
dsum AS (SELECT model, config, count(rmse_delta) AS n, avg(rmse_delta) AS mean_rmse_delta, avg(da_delta) AS mean_da_delta,
  median(rmse_delta) AS median_rmse_delta, median(da_delta) AS median_da_delta FROM deltas GROUP BY model, config)"""
SQL["delta_vs_base"] = f"""{STUDY}, {DELTAS}
SELECT currency, horizon, model, config, round(rmse_delta, 4) AS rmse_delta, round(da_delta, 4) AS da_delta FROM deltas"""
SQL["delta_summary"] = f"""{STUDY}, {DSUM}
SELECT model, config, n, round(mean_rmse_delta, 4) AS mean_rmse_delta, round(mean_da_delta, 4) AS mean_da_delta,
  round(median_rmse_delta, 4) AS median_rmse_delta, round(median_da_delta, 4) AS median_da_delta FROM dsum"""
SQL["best_config"] = f"""{STUDY}, {DSUM}
SELECT model, config, round(mean_rmse_delta, 4) AS mean_rmse_delta, round(mean_da_delta, 4) AS mean_da_delta, n FROM dsum
QUALIFY row_number() OVER (PARTITION BY model ORDER BY mean_rmse_delta, config) = 1"""
SQL["prefix_groups"] = f"""{STUDY}, {DSUM}
SELECT round(avg(mean_rmse_delta) FILTER (starts_with(config, 'news_')), 4) AS prefix_mean,
  round(avg(mean_rmse_delta) FILTER (NOT starts_with(config, 'news_') AND config <> 'baseline_llm'), 4) AS other_mean,
  count(*) FILTER (starts_with(config, 'news_')) AS prefix_rows,
  count(*) FILTER (NOT starts_with(config, 'news_') AND config <> 'baseline_llm') AS other_rows FROM dsum"""
SQL["union_results"] = f"""{STUDY}, {FACTORS}
SELECT type, model, config, currency, horizon, rmse, mae, mape, da, CASE WHEN type = 'llm' THEN n_windows END AS n_windows,
  CAST(news AS VARCHAR) AS news, prompt FROM res LEFT JOIN factors USING (config)"""
SQL["common_units"] = f"""{STUDY}, units AS (
  SELECT currency, horizon, model FROM res WHERE config = 'baseline_llm'
  INTERSECT SELECT currency, horizon, model FROM res WHERE config = 'news_only'
  INTERSECT SELECT currency, horizon, model FROM res WHERE config = 'prompt_only'
  INTERSECT SELECT currency, horizon, model FROM res WHERE config = 'full_model')
SELECT currency, horizon, model, max(da) FILTER (config = 'baseline_llm') AS baseline_llm, max(da) FILTER (config = 'news_only') AS news_only,
  max(da) FILTER (config = 'prompt_only') AS prompt_only, max(da) FILTER (config = 'full_model') AS full_model
FROM res JOIN units USING (currency, horizon, model) GROUP BY currency, horizon, model"""
SQL["aligned_pairs"] = f"""{STUDY}
SELECT a.currency, a.horizon, a.model, count(*) AS pairs, round(avg(a.window_rmse - b.window_rmse), 3) AS gap,
  count(*) AS rank_pairs, CAST(count(*) AS INTEGER) AS last_rank
FROM wres a JOIN wres b USING (currency, horizon, model, win)
WHERE a.config = 'baseline_llm' AND b.config = 'full_model' GROUP BY ALL"""
SQL["per_series_table"] = f"{STUDY} SELECT currency, model, config, horizon, rmse, mae, mape, da FROM res"
_F2 = """flat AS (SELECT config, CASE WHEN news THEN 'Yes' ELSE 'No' END AS news, prompt,
  round(avg(rmse), 3) AS mean_rmse, round(avg(mae), 3) AS mean_mae, round(avg(mape), 3) AS mean_mape, round(avg(da), 3) AS mean_da
  FROM llm JOIN factors USING (config) GROUP BY ALL)"""
SQL["factor_2x2"] = f"{STUDY}, {FACTORS}, {_F2} SELECT * FROM flat"
SQL["factor_pivot"] = f"""{STUDY}, {FACTORS}, {_F2}
SELECT news, max(mean_rmse) FILTER (prompt = 'few') AS few, max(mean_rmse) FILTER (prompt = 'zero') AS zero, 'rmse' AS metric FROM flat GROUP BY news
UNION ALL
SELECT news, max(mean_da) FILTER (prompt = 'few'), max(mean_da) FILTER (prompt = 'zero'), 'da' FROM flat GROUP BY news"""
_CFGS = ("baseline", "baseline_llm", "news_only", "prompt_only", "full_model")


def _wide(metric: str) -> str:
    return ", ".join(f"round(avg({metric}) FILTER (config = '{c}'), 3) AS {c}" for c in _CFGS)


SQL["config_means"] = f"""{STUDY}
SELECT 'rmse' AS metric, 0 AS horizon, model, {_wide('rmse')} FROM res GROUP BY model
UNION ALL SELECT 'da', 0, model, {', '.join(f"CASE WHEN avg(da) FILTER (config = '{c}') > 0 THEN round(avg(da) FILTER (config = '{c}'), 3) END AS {c}" for c in _CFGS)} FROM res GROUP BY model
UNION ALL SELECT 'rmse', horizon, model, {_wide('rmse')} FROM res GROUP BY model, horizon"""
_WIN = """SELECT currency, max(l) FILTER (horizon = 1) AS h1, max(l) FILTER (horizon = 5) AS h5, max(l) FILTER (horizon = 10) AS h10, '{m}' AS metric
FROM (SELECT currency, horizon, model || '::' || config AS l FROM res QUALIFY {best}) GROUP BY currency"""
SQL["winners_matrix"] = f"{STUDY} {_WIN.format(m='rmse', best=_BEST_RMSE)} UNION ALL {_WIN.format(m='da', best=_BEST_DA)}"
SQL["type_best"] = f"{STUDY} SELECT type, currency, min(rmse) AS best_rmse, max(da) AS best_da FROM res GROUP BY type, currency"
SQL["model_ranking"] = f"""{STUDY}, best AS (SELECT * FROM res WHERE type = 'baseline' UNION ALL
  SELECT * FROM llm QUALIFY row_number() OVER (PARTITION BY currency, horizon, model ORDER BY rmse, ord) = 1)
SELECT model, type, round(avg(rmse), 3) AS mean_rmse, round(avg(da), 3) AS mean_da FROM best GROUP BY model, type"""
SQL["factor_effects"] = f"""{STUDY}, {FACTORS}
SELECT 'news' AS factor, model, CAST(news AS VARCHAR) AS level, round(avg(rmse), 3) AS mean_rmse, round(avg(da), 3) AS mean_da
FROM llm JOIN factors USING (config) GROUP BY model, news
UNION ALL SELECT 'prompt', model, prompt, round(avg(rmse), 3), round(avg(da), 3) FROM llm JOIN factors USING (config) GROUP BY model, prompt"""
SQL["type_counts"] = f"{STUDY} SELECT type, count(*) AS rows FROM wres GROUP BY type"
SQL["label_text"] = f"""{STUDY}
SELECT currency, horizon, model || ' (' || config || ')' AS bracket_label, model || '::' || config AS colon_label,
  substring(currency, 1, 3) AS base, substring(currency, 4) AS quote,
  CASE WHEN model IN ('naive', 'mean') THEN 'Baseline' ELSE 'LLM' END AS type FROM res"""
SQL["result_documents"] = f"""{STUDY}
SELECT currency, CAST(count(*) FILTER (type = 'baseline') AS INTEGER) AS baselines, CAST(count(*) FILTER (type = 'llm') AS INTEGER) AS llms,
  arg_min(rmse, model || lpad(CAST(horizon AS VARCHAR), 3, '0')) FILTER (type = 'baseline') AS first_baseline,
  arg_min(rmse, model || config || lpad(CAST(horizon AS VARCHAR), 3, '0')) FILTER (type = 'llm') AS first_llm
FROM res GROUP BY currency"""

# --- significance ------------------------------------------------------------------------------

# Two-sided p of Student's t for whole degrees of freedom: finite sum over cos^2 of the angle.


def _t_p(t: str, df: str) -> str:
    c2 = f"(1.0 / (1.0 + {t} * {t} / {df}))"
    odd = f"list_sum([exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow({c2}, j) for j in range(0, CAST(({df} - 1) // 2 AS BIGINT))])"
    even = f"list_sum([exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow({c2}, j) for j in range(0, CAST({df} // 2 AS BIGINT))])"
    return f"""CASE WHEN {t} IS NULL OR {df} < 1 THEN NULL
  WHEN {df} % 2 = 1 THEN 1 - 2 / pi() * (atan(abs({t}) / sqrt({df})) + CASE WHEN {df} > 1 THEN sqrt((1 - {c2}) * {c2}) * {odd} ELSE 0 END)
  ELSE 1 - sqrt(1 - {c2}) * {even} END"""


QUESTIONS = """best AS (SELECT * FROM llm QUALIFY row_number() OVER (PARTITION BY currency, horizon, model ORDER BY rmse, ord) = 1),
base AS (SELECT * FROM res WHERE type = 'baseline' QUALIFY row_number() OVER (PARTITION BY currency, horizon ORDER BY rmse, ord) = 1),
cells AS (SELECT currency, horizon, model,
  max(rmse) FILTER (config = 'baseline_llm') AS r0, max(rmse) FILTER (config = 'news_only') AS rn,
  max(rmse) FILTER (config = 'prompt_only') AS rp, max(rmse) FILTER (config = 'full_model') AS rf,
  max(da) FILTER (config = 'baseline_llm') AS d0, max(da) FILTER (config = 'news_only') AS dn,
  max(da) FILTER (config = 'prompt_only') AS dp, max(da) FILTER (config = 'full_model') AS df
  FROM llm GROUP BY currency, horizon, model),
units AS (
  SELECT 'RQ1' AS rq, 'RMSE' AS metric, b.rmse - s.rmse AS d FROM best b JOIN base s USING (currency, horizon)
  UNION ALL SELECT 'RQ1', 'DA', b.da - s.da FROM best b JOIN base s USING (currency, horizon)
  UNION ALL SELECT 'RQ2', 'RMSE', (rn + rf) / 2 - (r0 + rp) / 2 FROM cells
  UNION ALL SELECT 'RQ2', 'DA', (dn + df) / 2 - (d0 + dp) / 2 FROM cells
  UNION ALL SELECT 'RQ3', 'RMSE', (rp + rf) / 2 - (r0 + rn) / 2 FROM cells
  UNION ALL SELECT 'RQ3', 'DA', (dp + df) / 2 - (d0 + dn) / 2 FROM cells
  UNION ALL SELECT 'RQ4', 'DA_interaction', (df - dp) - (dn - d0) FROM cells)"""
SQL["paired_t"] = f"""{STUDY}, {DELTAS}, sums AS (
  SELECT config, count(*) AS n_pairs, avg(rmse_delta) AS mr, median(rmse_delta) AS er, avg(da_delta) AS md, median(da_delta) AS ed,
    avg(rmse_delta) / nullif(stddev_samp(rmse_delta) / sqrt(count(rmse_delta)), 0) AS tr, count(rmse_delta) - 1 AS fr,
    avg(da_delta) / nullif(stddev_samp(da_delta) / sqrt(count(da_delta)), 0) AS td, count(da_delta) - 1 AS fd
  FROM deltas WHERE config <> 'baseline_llm' GROUP BY config)
SELECT config, n_pairs, round(mr, 3) AS mean_rmse_delta, round(er, 3) AS median_rmse_delta, round(md, 3) AS mean_da_delta,
  round(ed, 3) AS median_da_delta, round({_t_p('tr', 'fr')}, 6) AS t_p_rmse, round({_t_p('td', 'fd')}, 6) AS t_p_da FROM sums"""
SQL["rq_units"] = f"""{STUDY}, {QUESTIONS}, sums AS (
  SELECT rq, metric, count(d) AS n, avg(d) AS m, avg(d) / nullif(stddev_samp(d) / sqrt(count(d)), 0) AS t, count(d) - 1 AS f
  FROM units GROUP BY rq, metric)
SELECT rq, metric, n, round(m, 3) AS mean_delta, round({_t_p('t', 'f')}, 6) AS t_p FROM sums"""

WAYS = """ways AS (SELECT 0 AS k, [1.0::DOUBLE] AS w UNION ALL
  SELECT k + 1, [coalesce(w[s + 1], 0) + CASE WHEN s >= k + 1 THEN coalesce(w[s - k], 0) ELSE 0 END
    FOR s IN range(0, (k + 1) * (k + 2) // 2 + 1)] FROM ways WHERE k < 50)"""


def _signed_ranks(by: str, src: str) -> str:
    same = " AND ".join(f"s.{k.strip()} = z.{k.strip()}" for k in by.split(","))
    first = by.split(",")[0].strip()
    keys = ", ".join(f"z.{k.strip()}" for k in by.split(","))
    normal = """CASE WHEN abs(z) > 8 THEN 0.0 ELSE 1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * abs(z) *
      list_sum([pow(z * z / 2, j) * exp(lgamma(1.5) - lgamma(j + 1.5)) for j in range(0, 150)]) END"""
    return f"""ranked AS (SELECT {by}, d, rank() OVER w + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY {by}, abs(d)) AS tie
  FROM {src} WHERE d <> 0 WINDOW w AS (PARTITION BY {by} ORDER BY abs(d))),
sums AS (SELECT {by}, count(*) AS n_ranks, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus,
    sum(tie * tie - 1.0) AS t3 FROM ranked GROUP BY {by}),
zeros AS (SELECT {by}, count(*) FILTER (d = 0) AS n_zero FROM {src} WHERE d IS NOT NULL GROUP BY {by}),
tests AS (SELECT {keys}, z.n_zero, s.n_ranks, s.w_plus, s.w_minus, ways.w, CAST(floor(s.w_plus) AS BIGINT) AS k,
    (least(s.w_plus, s.w_minus) - s.n_ranks * (s.n_ranks + 1) / 4.0)
      / sqrt(s.n_ranks * (s.n_ranks + 1.0) * (2.0 * s.n_ranks + 1) / 24.0 - s.t3 / 48.0) AS z
  FROM zeros z LEFT JOIN sums s ON {same} LEFT JOIN ways ON z.n_zero = 0 AND ways.k = s.n_ranks)
SELECT {by}, n_zero, CAST(n_ranks AS BIGINT) AS n_ranks, CAST(w_plus AS DOUBLE) AS w_plus, CAST(w_minus AS DOUBLE) AS w_minus, round(CASE WHEN {first} IS NULL THEN NULL
    WHEN n_zero = 0 AND n_ranks <= 50 THEN least(1.0, 2 * least(list_sum(w[1:k + 1]), pow(2.0, n_ranks) - coalesce(list_sum(w[1:k]), 0)) / pow(2.0, n_ranks))
    WHEN n_ranks > 0 THEN {normal} END, 6) AS w_p FROM tests"""


SQL["wilcoxon"] = (
    f"WITH RECURSIVE {STUDY.removeprefix('WITH ')}, {QUESTIONS}, {WAYS}, rounded AS (SELECT rq, metric, round(d, 4) AS d FROM units), "
    + _signed_ranks("rq, metric", "rounded")
)
SQL["signed_ranks_lines"] = (
    f"WITH RECURSIVE {WAYS}, lines AS (SELECT l_returnflag, round(l_discount * 100) - round(l_tax * 100) AS d FROM lineitem), "
    + _signed_ranks("l_returnflag", "lines")
)

DM = f"""means AS (SELECT currency, horizon, model, type, config, avg(window_rmse) AS m FROM wres GROUP BY ALL),
bc AS (SELECT * FROM means WHERE type = 'llm' QUALIFY row_number() OVER (PARTITION BY currency, horizon, model ORDER BY m, config) = 1),
bb AS (SELECT * FROM means WHERE type = 'baseline' QUALIFY row_number() OVER (PARTITION BY currency, horizon ORDER BY m, model) = 1),
wide AS (SELECT currency, horizon, model, win,
  max(pow(window_rmse, 2)) FILTER (config = 'baseline_llm') AS l0, max(pow(window_rmse, 2)) FILTER (config = 'news_only') AS ln,
  max(pow(window_rmse, 2)) FILTER (config = 'prompt_only') AS lp, max(pow(window_rmse, 2)) FILTER (config = 'full_model') AS lf,
  max(window_da) FILTER (config = 'baseline_llm') AS a0, max(window_da) FILTER (config = 'news_only') AS an,
  max(window_da) FILTER (config = 'prompt_only') AS ap, max(window_da) FILTER (config = 'full_model') AS af
  FROM wres WHERE type = 'llm' GROUP BY currency, horizon, model, win),
losses AS (
  SELECT 'RQ1' AS rq, currency, horizon, bc.model, a.window_rmse * a.window_rmse - b.window_rmse * b.window_rmse AS d
  FROM bc JOIN bb USING (currency, horizon) JOIN wres a ON a.currency = bc.currency AND a.horizon = bc.horizon AND a.model = bc.model AND a.config = bc.config
  JOIN wres b ON b.currency = bb.currency AND b.horizon = bb.horizon AND b.model = bb.model AND b.type = 'baseline' AND b.win = a.win
  UNION ALL SELECT 'RQ2', currency, horizon, model, ln - l0 FROM wide UNION ALL SELECT 'RQ2', currency, horizon, model, lf - lp FROM wide
  UNION ALL SELECT 'RQ3', currency, horizon, model, lp - l0 FROM wide UNION ALL SELECT 'RQ3', currency, horizon, model, lf - ln FROM wide
  UNION ALL SELECT 'RQ4', currency, horizon, model, (an - a0) - (af - ap) FROM wide),
dm0 AS (SELECT rq, currency, horizon, model, count(d) AS n, avg(d) AS mean_d, var_samp(d) AS v FROM losses WHERE d IS NOT NULL GROUP BY rq, currency, horizon, model),
dm1 AS (SELECT *, CASE WHEN n >= 2 AND v > 0 THEN mean_d / sqrt(v / n) * sqrt((n - horizon) * (n - horizon + 1)) / n END AS dm, n - 1 AS f FROM dm0),
dm AS (SELECT *, {_t_p('dm', 'f')} AS p FROM dm1)"""
SQL["dm_pairs"] = f"""{STUDY}, {DM}
SELECT rq, currency, horizon, model, n, round(CASE WHEN n >= 2 THEN mean_d END, 2) AS mean_d, round(dm, 5) AS dm_hln, round(p, 5) AS p,
  CASE WHEN p IS NULL THEN 'n/a' WHEN p < 0.001 THEN 'p<0.001' ELSE printf('p=%.3f', p) END AS p_text FROM dm"""
SQL["dm_rollup"] = f"""{STUDY}, {DM}
SELECT rq, count(*) AS n_pairs, count(*) FILTER (p < 0.05) AS n_sig, round(avg(dm), 4) AS mean_dm, round(avg(mean_d), 2) AS mean_loss_diff,
  count(*) FILTER (round(mean_d, 6) < 0) AS n_negative, count(*) FILTER (round(mean_d, 6) > 0) AS n_positive FROM dm WHERE n >= 2 GROUP BY rq"""

# --- tokens ------------------------------------------------------------------------------------

_EDGE = "({k} * 0.0002::DOUBLE + -1.0::DOUBLE)"


def _snap(v: str) -> str:
    g = f"greatest(0, least(9999, ceil(({v} + 1.0) / 0.0002::DOUBLE) - 1))"
    k = (
        f"({g} + CASE WHEN {g} < 9999 AND {_EDGE.format(k=f'({g} + 1)')} < {v} THEN 1 ELSE 0 END"
        f" - CASE WHEN {g} > 0 AND {_EDGE.format(k=g)} >= {v} THEN 1 ELSE 0 END)"
    )
    return f"(({_EDGE.format(k=k)} + {_EDGE.format(k=f'({k} + 1)')}) / 2)"


SQL["token_encode"] = f"""{WINS30},
ranged AS (SELECT *, min(close) OVER w AS lo, max(close) OVER w AS hi FROM hist WINDOW w AS (PARTITION BY {WKEYS})),
scaled AS (SELECT *, CASE WHEN hi = lo THEN 0.0 ELSE (close - lo) / (hi - lo) - 0.5 END AS v FROM ranged)
SELECT series, horizon, win AS "window", string_agg(printf('###%.4f###', {_snap('v')}), '  ' ORDER BY pos) AS tokens,
  min(lo) AS low, max(hi) AS high FROM scaled GROUP BY {WKEYS}"""
FUTURE = f"""bounds AS (SELECT {WKEYS}, min(close) AS lo, max(close) AS hi, arg_max(close, pos) AS last FROM hist GROUP BY {WKEYS}),
coded AS (SELECT t.*, b.lo, b.hi, b.last,
  round_even(greatest(-0.5, least(0.5, (y - lo) / (hi - lo + 1e-8::DOUBLE) - 0.5)) * 10000, 0) / 10000 AS q FROM truth t JOIN bounds b USING ({WKEYS}))"""
SQL["future_tokens"] = f"""{WINS30}, {FUTURE}
SELECT series, horizon, win AS "window", string_agg(printf('###%.4f###', q), '  ' ORDER BY step) AS tokens FROM coded GROUP BY {WKEYS}"""
SQL["token_decode"] = f"""{WINS30}, {FUTURE},
usable AS (SELECT *, CASE WHEN win % 5 = 0 THEN 0 WHEN win % 5 = 1 AND horizon > 1 THEN horizon - 1 ELSE horizon END AS tokens FROM coded),
aligned AS (SELECT u.*, s.q AS used FROM usable u LEFT JOIN coded s ON s.series = u.series AND s.horizon = u.horizon AND s.win = u.win AND s.step = least(u.step, u.tokens))
SELECT series, horizon, win AS "window", tokens = 0 AS is_fallback, CAST(step AS INTEGER) AS step,
  round(CASE WHEN tokens = 0 THEN last WHEN hi = lo THEN lo ELSE (used + 0.5) * (hi - lo) + lo END, 3) AS pred FROM aligned"""

# --- news and text -----------------------------------------------------------------------------

ARTICLES = """articles AS (SELECT doc_id AS article_id,
  ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][doc_id % 5 + 1] AS series,
  DATE '1995-01-01' + CAST(doc_id * 7 % 2400 AS INTEGER) AS published_on, split_part(text, chr(10), 1) AS title,
  source AS publisher, text AS summary FROM documents)"""
_TOP = "row_number() OVER (PARTITION BY {by} ORDER BY published_on DESC, article_id)"
SQL["news_topk"] = f"""WITH {ARTICLES}
SELECT series, CAST(rank AS INTEGER) AS rank, article_id, CAST(published_on AS VARCHAR) AS published_on
FROM (SELECT *, {_TOP.format(by='series')} AS rank FROM articles) WHERE rank <= 10"""
FOUND = f"""days AS (SELECT series, horizon, win, max(day) AS window_day FROM hist GROUP BY {WKEYS}),
found AS (SELECT * FROM (SELECT d.series, d.horizon, d.win, a.article_id, a.published_on, a.title, a.publisher, a.summary,
  row_number() OVER (PARTITION BY d.series, d.horizon, d.win ORDER BY a.published_on DESC, a.article_id) AS rank
  FROM days d JOIN articles a ON a.series = d.series AND a.published_on < d.window_day AND a.published_on >= d.window_day - 7) WHERE rank <= 8)"""
SQL["news_asof"] = f"""{WINS30}, {ARTICLES}, {FOUND}
SELECT series, horizon, win AS "window", CAST(rank AS INTEGER) AS rank, article_id, CAST(published_on AS VARCHAR) AS published_on FROM found"""
SQL["news_leaky"] = f"""{WINS30}, {ARTICLES},
tops AS (SELECT series, {_TOP.format(by='series')} AS rank, article_id, published_on FROM articles)
SELECT w.series, w.horizon, w.win AS "window", CAST(t.rank AS INTEGER) AS rank, t.article_id, CAST(t.published_on AS VARCHAR) AS published_on
FROM wins w JOIN tops t ON t.series = w.series AND t.rank <= 8"""
SQL["news_lines"] = f"""{WINS30}, {ARTICLES}, {FOUND},
blocks AS (SELECT series, horizon, win, string_agg(rank || '. [' || CAST(published_on AS VARCHAR) || '] ' || title || chr(10) || '   Source: ' || publisher ||
  CASE WHEN summary <> '' THEN chr(10) || '   Summary: ' || CASE WHEN length(summary) > 200 THEN substring(summary, 1, 197) || '...' ELSE summary END ELSE '' END,
  chr(10) || chr(10) ORDER BY rank) AS news_text FROM found GROUP BY series, horizon, win)
SELECT w.series, w.horizon, w.win AS "window", coalesce(b.news_text, 'No recent news available.') AS news_text
FROM wins w LEFT JOIN blocks b USING (series, horizon, win)"""
SQL["price_lines"] = f"""{WINS30}
SELECT series, horizon, win AS "window", string_agg(CAST(day AS VARCHAR) || ': ' || printf('%.4f', close), chr(10) ORDER BY pos) AS prices
FROM hist GROUP BY {WKEYS}"""


def _examples(gap: int) -> str:
    return f"""cases AS (SELECT w.*, i, greatest(0, window_end - 500) + i * (30 + horizon + {gap}) AS start
  FROM wins w, (SELECT unnest([0, 1, 2]) AS i)
  WHERE i * (30 + horizon + {gap}) + 30 + horizon <= window_end - greatest(0, window_end - 500)),
vals AS (SELECT c.series, c.horizon, c.win, c.i, p.day, p.close, p.pos - c.start AS k
  FROM cases c JOIN panel p ON p.series = c.series AND p.pos > c.start AND p.pos <= c.start + 30 + c.horizon)"""


FEWSHOT = f"""{_examples(10)},
spans AS (SELECT *, min(CASE WHEN k <= 30 THEN close END) OVER w AS lo, max(CASE WHEN k <= 30 THEN close END) OVER w AS hi
  FROM vals WINDOW w AS (PARTITION BY series, horizon, win, i)),
coded AS (SELECT *, CASE WHEN hi = lo THEN 0.0 ELSE (close - lo) / (hi - lo) - 0.5 END AS v,
  round_even(greatest(-0.5, least(0.5, (close - lo) / (hi - lo + 1e-8::DOUBLE) - 0.5)) * 10000, 0) / 10000 AS q FROM spans),
blocks AS (SELECT series, horizon, win, i, 'Case ' || (i + 1) || chr(10) || '### Input:' || chr(10) ||
  string_agg(CASE WHEN k <= 30 THEN printf('###%.4f###', {_snap('v')}) END, '  ' ORDER BY k) || chr(10) || '### Response:' || chr(10) ||
  string_agg(CASE WHEN k > 30 THEN printf('###%.4f###', q) END, '  ' ORDER BY k) || chr(10) AS block FROM coded GROUP BY series, horizon, win, i),
tok AS (SELECT series, horizon, win, string_agg(block, chr(10) ORDER BY i) AS token_examples FROM blocks GROUP BY series, horizon, win),
{_examples(0).replace('cases AS', 'cases2 AS').replace('FROM cases c', 'FROM cases2 c').replace('vals AS', 'vals2 AS')},
blocks2 AS (SELECT series, horizon, win, i, 'Case ' || (i + 1) || chr(10) || 'Seen, 10 days at the end:' || chr(10) ||
  string_agg(CASE WHEN k > 20 AND k <= 30 THEN CAST(day AS VARCHAR) || ': ' || printf('%.4f', close) END, chr(10) ORDER BY k) || chr(10) ||
  'Followed by ' || horizon || ' value(s): [' || string_agg(CASE WHEN k > 30 THEN CAST(round(close, 4) AS VARCHAR) END, ', ' ORDER BY k) || ']' || chr(10) AS block
  FROM vals2 GROUP BY series, horizon, win, i),
num AS (SELECT series, horizon, win, string_agg(block, chr(10) ORDER BY i) AS price_examples FROM blocks2 GROUP BY series, horizon, win)"""
SQL["fewshot_examples"] = f"""{WINS}, {FEWSHOT}
SELECT w.series, w.horizon, w.win AS "window", coalesce(token_examples, 'No examples available.') AS token_examples,
  coalesce(price_examples, 'No examples available.') AS price_examples
FROM wins w LEFT JOIN tok USING (series, horizon, win) LEFT JOIN num USING (series, horizon, win)"""



def _filled(template: str, **parts: str) -> str:
    """A template as SQL text: literals and the named expressions in turn."""
    pieces = re.split(r"\{(" + "|".join(parts) + r")\}", template)
    return " || ".join(parts[x] if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(pieces) if x)


def _prompt(template: str, blocks: str) -> str:
    """One row per window, model and config; ``blocks`` has the worked examples, one row each."""
    limits = ", ".join(f"('{m}', {ex}, {k})" for m, (ex, k) in LIMITS.items())
    factors = ", ".join(f"('{c}', {str(n).lower()}, '{p}')" for c, (n, p) in CONFIG_FACTORS.items())
    text = _filled(
        template, base="substring(series, 1, 3)", quote="substring(series, 4)", horizon="horizon", lookback="'30'",
        current="printf('%.4f', last)", low="printf('%.4f', lo)", high="printf('%.4f', hi)", tokens="tokens", prices="prices",
        mean="printf('%.4f', mean)", deviation="printf('%.4f', sd)", trend="trend",
        examples="CASE WHEN style = 'few' THEN chr(10) || 'Past cases:' || chr(10) || shots || chr(10) ELSE '' END",
        news="CASE WHEN use_news THEN chr(10) || 'News:' || chr(10) || lines || chr(10) ELSE '' END",
    )
    return f"""{WINS30}, {ARTICLES}, {FOUND.replace('rank <= 8', 'rank <= 10')}, {FEWSHOT},
ranged AS (SELECT *, min(close) OVER w AS lo, max(close) OVER w AS hi FROM hist WINDOW w AS (PARTITION BY {WKEYS})),
scaled AS (SELECT *, CASE WHEN hi = lo THEN 0.0 ELSE (close - lo) / (hi - lo) - 0.5 END AS v FROM ranged),
facts AS (SELECT series, horizon, win, arg_max(close, pos) AS last, min(lo) AS lo, max(hi) AS hi, avg(close) AS mean, stddev_samp(close) AS sd,
  CASE WHEN arg_max(close, pos) > arg_min(close, pos) THEN 'upward' ELSE 'downward' END AS trend,
  string_agg(printf('###%.4f###', {_snap('v')}), '  ' ORDER BY pos) AS tokens,
  string_agg(CAST(day AS VARCHAR) || ': ' || printf('%.4f', close), chr(10) ORDER BY pos) AS prices FROM scaled GROUP BY ALL),
limits(model, n_examples, max_news) AS (VALUES {limits}), factors(config, use_news, style) AS (VALUES {factors}),
shots AS (SELECT series, horizon, win, model, string_agg(block, chr(10) ORDER BY i) AS shots
  FROM {blocks} b JOIN limits l ON b.i < l.n_examples GROUP BY series, horizon, win, model),
lined AS (SELECT series, horizon, win, model, string_agg(rank || '. [' || CAST(published_on AS VARCHAR) || '] ' || title, chr(10) ORDER BY rank) AS lines
  FROM found f JOIN limits l ON f.rank <= l.max_news GROUP BY series, horizon, win, model),
parts AS (SELECT f.*, l.model, c.config, c.use_news, c.style, coalesce(s.shots, 'No examples available.') AS shots,
  coalesce(n.lines, 'No recent news available.') AS lines
  FROM facts f, limits l, factors c LEFT JOIN shots s ON s.series = f.series AND s.horizon = f.horizon AND s.win = f.win AND s.model = l.model
  LEFT JOIN lined n ON n.series = f.series AND n.horizon = f.horizon AND n.win = f.win AND n.model = l.model)
SELECT series, horizon, win AS "window", model, config, {text} AS prompt FROM parts"""


SQL["prompt_table"] = _prompt(TOKEN_TEMPLATE, "blocks")
# with fewer fitting examples than asked for, all of them are shown
SQL["number_prompt_table"] = _prompt(NUMBER_TEMPLATE, "blocks2")
_ASKED = _filled(
    EXPLAIN_TEMPLATE, base="substring(series, 1, 3)", quote="substring(series, 4)", horizon="horizon", lookback="'30'",
    current="printf('%.4f', last)", news="coalesce(lines, 'No recent news available.')", prices="prices",
    example_path="list_reduce([printf('%.4f', CAST(round(CAST(CAST(last * (i * 0.001::DOUBLE + 1) AS VARCHAR) AS DECIMAL(28, 12)), 4) AS DOUBLE)) for i in range(1, horizon + 1)], lambda a, x: a || ', ' || x)",
)
SQL["explain_prompt_table"] = f"""{ORDER_PANEL}, {SLIDING}, {HIST.format(ctx=30)}, {ARTICLES}, {FOUND},
facts AS (SELECT series, horizon, win, arg_max(close, pos) AS last,
  string_agg(CAST(day AS VARCHAR) || ': ' || printf('%.4f', close), chr(10) ORDER BY pos) AS prices FROM hist GROUP BY ALL),
lined AS (SELECT series, horizon, win, string_agg('[' || rank || '] [' || CAST(published_on AS VARCHAR) || '] ' || title ||
  CASE WHEN summary <> '' THEN ' — ' || CASE WHEN length(summary) > 150 THEN substring(summary, 1, 147) || '...' ELSE summary END ELSE '' END,
  chr(10) ORDER BY rank) AS lines FROM found GROUP BY ALL)
SELECT series, horizon, win AS "window", {_ASKED} AS prompt FROM facts LEFT JOIN lined USING (series, horizon, win)"""

# --- responses ---------------------------------------------------------------------------------

SQL["scale_filter"] = f"""{WINS30}, lasts AS (SELECT {WKEYS}, window_end, arg_max(close, pos) AS s FROM hist GROUP BY ALL),
nums AS (SELECT {WKEYS}, y AS v FROM truth UNION ALL
  SELECT {WKEYS}, close FROM hist WHERE pos > window_end - 30 AND pos <= window_end - 25),
sums AS (SELECT {WKEYS}, s, count(*) AS n_all, count(*) FILTER (v >= s * 0.5 AND v <= s * 2.0) AS n_in, sum(v) AS total,
  sum(v) FILTER (v >= s * 0.5 AND v <= s * 2.0) AS total_in FROM nums JOIN lasts USING ({WKEYS}) GROUP BY {WKEYS}, s)
SELECT series, horizon, win AS "window", CAST(n_all AS INTEGER) AS n_all,
  CAST(CASE WHEN s > 0 AND n_in >= greatest(1, n_all // 2) THEN n_in ELSE n_all END AS INTEGER) AS n_kept,
  round(CASE WHEN s > 0 AND n_in >= greatest(1, n_all // 2) THEN total_in ELSE total END, 2) AS kept_sum FROM sums"""

_SP = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{_SP}]+'))"


def _has(term: str) -> str:
    return f"contains(low, '{term}')"


_FACTORS_SQL = ", ".join(
    f"CASE WHEN {' OR '.join(_has(k) for k in terms)} THEN '{c}' END" for c, terms in FACTOR_TERMS.items()
)
_COUNT = " + ".join(f"CAST({_has(k)} AS INTEGER)" for terms in FACTOR_TERMS.values() for k in terms)
_LINKS = " + ".join(f"CAST({_has(k)} AS INTEGER)" for k in CONNECTORS)
_MARKED = f"""marked AS (SELECT *, {_words('text')} AS words, list_filter([{_FACTORS_SQL}], lambda x: x IS NOT NULL) AS factors,
  CASE WHEN length(text) < 10 THEN 0.0 ELSE round(least(0.3::DOUBLE, {_words('text')} / 50 * 0.3::DOUBLE)
    + least(0.4::DOUBLE, ({_LINKS}) * 0.1::DOUBLE) + least(0.3::DOUBLE, ({_COUNT}) * 0.05::DOUBLE), 3) END AS score FROM docs)"""
DOCS = f"docs AS (SELECT doc_id, lang, text, lower(text) AS low FROM documents), {_MARKED}"
SQL["text_words"] = f"""SELECT 'document' AS kind, doc_id AS id, CAST({_words('text')} AS BIGINT) AS explanation_len FROM documents
UNION ALL SELECT 'conversation', CAST(conv_id AS BIGINT), CAST(sum({_words('text')}) AS BIGINT) FROM conversations GROUP BY conv_id"""
SQL["events_asof"] = """WITH found AS (SELECT p.event_id AS purchase_id, e.event_id, e.event_type,
  CAST(row_number() OVER (PARTITION BY p.event_id ORDER BY e.ts DESC, e.event_id) AS INTEGER) AS rank
  FROM events p JOIN events e ON e.user_id = p.user_id AND e.event_type <> 'purchase' AND e.ts < p.ts AND e.ts >= p.ts - INTERVAL 7 DAY
  WHERE p.event_type = 'purchase')
SELECT purchase_id, rank, event_id, event_type FROM found WHERE rank <= 8"""
SQL["factor_terms"] = f"""WITH {DOCS}
SELECT doc_id, CAST(len(factors) AS INTEGER) AS n_factors_cited, coalesce(array_to_string(factors, ','), '') AS factor_types FROM marked"""
SQL["coherence"] = f"WITH {DOCS} SELECT doc_id, score AS coherence_score FROM marked"
_ESCAPED = "replace(replace(replace(replace(replace({x}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r')"
# what each shape of response must yield; only the whole texts of the broken shapes are built again
EXPLAINED = f"""{WINS30}, {ARTICLES}, {FOUND},
offered AS (SELECT series, win, count(*) AS offered, list(list_slice(regexp_extract_all(lower(title), '[^{_SP}]+'), 1, 4) ORDER BY rank) AS heads
  FROM found WHERE horizon = 5 GROUP BY series, win),
truths AS (SELECT series, win, string_agg(printf('%.2f', y + step * 1.25), ', ' ORDER BY step) AS vals, count(*) AS steps,
  round(sum(round(y + step * 1.25, 2)), 2) AS vals_sum, avg(abs(round(y + step * 1.25, 2) - y)) AS err,
  100.0 * avg(CASE WHEN up IS NOT NULL THEN CAST(up = said AS INTEGER) END) AS da
  FROM (SELECT *, sign(y - lag(y) OVER w) AS up, sign(round(y + step * 1.25, 2) - lag(round(y + step * 1.25, 2)) OVER w) AS said
    FROM truth WHERE horizon = 5 WINDOW w AS (PARTITION BY series, win ORDER BY step)) GROUP BY series, win),
asked AS (SELECT a.*, CAST(article_id // 5 % 6 AS INTEGER) AS shape, t.vals, t.vals_sum, t.steps, t.err, t.da,
  coalesce(o.offered, 0) AS offered, coalesce(o.heads, []) AS heads, {_ESCAPED.format(x='summary')} AS body, {_ESCAPED.format(x='publisher')} AS factor
  FROM articles a JOIN truths t ON t.series = a.series AND t.win = a.article_id // 5 % 30
  LEFT JOIN offered o ON o.series = t.series AND o.win = t.win),
texts AS (SELECT *, CASE shape WHEN 0 THEN summary || ' ' || publisher || ' war'
  WHEN 1 THEN '{{"predictions": [' || vals || '], "explanation": "' || body || '"}}'
  WHEN 2 THEN '{{"predictions": [1.5, 2.5], "explanation": ' || body || '}}'
  WHEN 3 THEN '{{"predictions": [' || vals || '], "explanation": {{"summary": "' || body || '", "key_factors": ["' || factor || '"], "confidence": "high"}}}}'
  WHEN 4 THEN '' ELSE summary || '' END AS text FROM asked),
docs AS (SELECT *, lower(text) AS low FROM texts), {_MARKED},
graded AS (SELECT *, CASE WHEN offered > 0 AND shape = 0 THEN (CAST(offered >= 1 AS INTEGER) + CAST(offered >= 3 AS INTEGER) + CAST(offered >= 99 AS INTEGER)) / offered
  ELSE len(list_filter(heads, lambda ws: len(list_filter(ws, lambda h: contains(low, h))) > 0)) / greatest(offered, 1) END AS grounded FROM marked)"""
SQL["explanation_fields"] = f"""{EXPLAINED}
SELECT article_id, shape, CAST(words AS INTEGER) AS words, CAST(CASE WHEN shape IN (0, 1, 3) THEN steps WHEN shape = 2 THEN 2 ELSE 0 END AS INTEGER) AS n_predictions,
  CASE WHEN shape IN (0, 1, 3) THEN vals_sum WHEN shape = 2 THEN 4.0 ELSE 0.0 END AS pred_sum, shape = 5 AS bad_predictions,
  CASE shape WHEN 0 THEN 0.8 ELSE 0.5 END AS confidence_score, CASE shape WHEN 0 THEN 3 ELSE 0 END AS n_refs FROM marked"""
SQL["explanation_grounding"] = f"{EXPLAINED} SELECT article_id, shape, CAST(offered AS INTEGER) AS offered, round(grounded, 6) AS news_grounding_rate FROM graded"
SQL["explanation_errors"] = f"""{EXPLAINED}
SELECT article_id, shape, CASE WHEN shape IN (0, 1, 3) THEN round(err, 4) END AS abs_pred_error,
  CASE WHEN shape IN (0, 1, 3) THEN round(da, 4) END AS directional_accuracy FROM marked WHERE shape <> 5"""


def _cases(text: str, upto: str = "") -> str:
    """Extraction case and numbers of a text, branch by branch."""
    return f"""tried AS (SELECT *, regexp_extract_all(regexp_extract({text}, '^[\\d\\s.,]+'), '\\d+\\.?\\d*') AS c1,
  regexp_extract({text}, '\\{{[^{{}}]*predictions[^{{}}]*\\}}') AS o,
  [trim(x) for x in string_split(translate(regexp_extract({text}, '\\[([\\d.,\\s]+)\\]', 1), chr(10) || chr(13) || chr(9), '   '), ',') if trim(x) <> ''] AS c3,
  regexp_extract_all({text}, '\\b(\\d+\\.\\d+)\\b', 1){upto} AS c4 FROM src),
cased AS (SELECT *, CASE WHEN len(c1) > 0 THEN 1
  WHEN json_valid(o) AND json_type(json_extract(CASE WHEN json_valid(o) THEN o END, '$.predictions')) = 'ARRAY' THEN 2
  WHEN len(c3) > 0 AND len(list_filter(c3, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) = 0 THEN 3
  WHEN len(c4) > 0 THEN 4 ELSE 0 END AS parse_case FROM tried)"""


ANSWERED = """answered AS (SELECT conv_id, role, turn AS attempt, (conv_id * 7 + turn * 3) % 6 AS n,
  CAST(conv_id || '.' || (turn + 1) AS DOUBLE) AS v, text FROM conversations),
told AS (SELECT *, len(regexp_extract_all(text, '\\b(\\d+\\.\\d+)\\b', 1)[1:20]) AS own,
  TRY_CAST(regexp_extract(text, '\\b(\\d+\\.\\d+)\\b', 1) AS DOUBLE) AS own_first FROM answered),
read AS (SELECT *, CASE n WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 4 ELSE CASE WHEN own > 0 THEN 4 ELSE 0 END END AS parse_case FROM told)"""
SQL["response_quality"] = f"""WITH {ANSWERED}
SELECT role, attempt, count(*) AS responses, count(*) FILTER (n = 4) AS with_tokens,
  count(*) FILTER (parse_case = 1) AS case_1, count(*) FILTER (parse_case = 2) AS case_2, count(*) FILTER (parse_case = 3) AS case_3,
  count(*) FILTER (parse_case = 4) AS case_4, count(*) FILTER (parse_case = 0) AS unparsed FROM read GROUP BY role, attempt"""
SQL["response_numbers"] = f"""WITH {ANSWERED}
SELECT conv_id, attempt, parse_case, CAST(CASE WHEN n < 3 THEN 2 WHEN n = 3 THEN least(20, 2 + own) WHEN n = 4 THEN least(20, 1 + own) ELSE own END AS INTEGER) AS found,
  CASE WHEN n < 5 THEN v ELSE own_first END AS first_number FROM read"""
SQL["extracted_numbers"] = f"""WITH src AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages), {_cases('text')}
SELECT kind, id, parse_case, CAST(CASE parse_case WHEN 1 THEN len(c1) WHEN 2 THEN json_array_length(o, '$.predictions') WHEN 3 THEN len(c3) WHEN 4 THEN len(c4) ELSE 0 END AS INTEGER) AS found,
  CASE parse_case WHEN 1 THEN CAST(c1[1] AS DOUBLE) WHEN 2 THEN CAST(json_extract(o, '$.predictions[0]') AS DOUBLE) WHEN 3 THEN CAST(c3[1] AS DOUBLE) WHEN 4 THEN CAST(c4[1] AS DOUBLE) END AS first_number
FROM cased"""
SQL["retry_outcomes"] = f"""{WINS30}, {FUTURE},
texts AS (SELECT series, horizon, win, string_agg(printf('###%.4f###', q), '  ' ORDER BY step) AS s,
    string_agg(CASE WHEN step < horizon THEN printf('###%.4f###', q) END, '  ' ORDER BY step) AS short FROM coded GROUP BY {WKEYS}),
answers AS (SELECT series, horizon, win // 3 AS request, win % 3 AS attempt, win % 5 <> 0 AS ok,
  CASE WHEN win % 5 = 0 THEN 'no idea' WHEN win % 5 = 1 THEN CASE WHEN horizon = 1 THEN s ELSE short END
    ELSE 'Answer: ' || s || '  ###0.1234### and 0.5' END AS response FROM texts)
SELECT series, horizon, CAST(request AS BIGINT) AS request, count(*) AS attempts, bool_or(ok) AS valid,
  coalesce(arg_min(response, attempt) FILTER (ok), arg_max(response, attempt)) AS response FROM answers GROUP BY series, horizon, request"""
SQL["flat_predictions"] = f"""{MADE}
SELECT horizon, model, count(*) AS windows, count(*) FILTER (sd_p < sd_y * 0.001) AS flat FROM scored GROUP BY horizon, model"""


def _corr(x: str, y: str, name: str) -> str:
    return (
        f"CASE WHEN count(*) >= 5 AND var_pop({x}) > 0 AND var_pop({y}) > 0 THEN round(corr({x}, {y}), 4) END AS {name}"
    )


_PAIRS = [
    (x, y, f"corr_{f}_vs_{y}")
    for x, f in (("words", "explanation_len"), ("len(factors)", "n_factors_cited"), ("score", "coherence_score"))
    for y in ("quality", "toxic")
]
SQL["feature_corr"] = f"""WITH {DOCS}
SELECT lang AS model, count(*) AS n, {', '.join(_corr(*p) for p in _PAIRS)}
FROM marked JOIN labels USING (doc_id) GROUP BY lang HAVING count(*) >= 5"""
SQL["explanation_rollup"] = f"""{EXPLAINED}
SELECT CAST(shape AS VARCHAR) AS model, round(avg(grounded), 4) AS avg_news_grounding, round(avg(words), 4) AS avg_explanation_len,
  round(avg(score), 4) AS avg_coherence, round(avg(len(factors)), 4) AS avg_n_factors,
  round(avg(CASE shape WHEN 0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END), 4) AS avg_confidence, count(*) AS n_samples FROM graded GROUP BY shape"""
SQL["table_shapes"] = " UNION ALL ".join(
    f"SELECT '{n}' AS name, (SELECT count(*) FROM {n}) AS rows, CAST((SELECT count(*) FROM (DESCRIBE {n})) AS INTEGER) AS columns"
    for n in ("orders", "lineitem", "documents", "labels")
)
SQL["window_metrics_parity"] = f"""{MADE}
SELECT series, horizon, win AS "window", model, round(window_rmse, 4) AS window_rmse, round(coalesce(window_da, 0.0), 4) AS window_da FROM scored"""
SQL["unscorable_windows"] = f"""{WINS}
SELECT horizon, CASE win % 4 WHEN 0 THEN 'empty prediction' WHEN 1 THEN 'empty prediction' WHEN 2 THEN 'different lengths' ELSE 'valid' END AS reason,
  count(*) AS windows FROM wins GROUP BY ALL"""
SQL["news_flattened"] = f"""WITH {ARTICLES}, links AS (SELECT *, article_id % 3 = 0 AS nested, 'http://news.example.com/' || article_id AS url FROM articles)
SELECT article_id, title, publisher, url AS link, CASE WHEN nested THEN CAST(published_on AS VARCHAR) || ' 10:30:00' ELSE 'on ' || CAST(published_on AS VARCHAR) END AS published_at,
  CASE WHEN nested THEN 'STORY' ELSE '' END AS type, CASE WHEN nested THEN url || '/s.png' ELSE 'p.png' END AS thumbnail,
  CASE WHEN nested THEN 2 ELSE 0 END AS tickers, CAST(length(summary) AS INTEGER) AS summary_chars FROM links"""
SQL["walk_shape"] = f"""{WINS}
SELECT series, horizon, win AS "window", CAST(horizon AS INTEGER) AS steps, true AS near, true AS moves FROM wins"""
