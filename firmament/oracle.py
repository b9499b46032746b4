"""The same queries in plain SQL, written from the definitions for DuckDB."""

from __future__ import annotations

from firmament.functions.text import FUND_BUYER, JUNK_PATTERNS, RELATION_PATTERNS
from firmament.plans.derive import (
    BASE_DATE, LAYER_OF_CODE, LOOKBACK, PHRASES, REFIT_EVERY, RELATION_OF_CODE, UNIVERSE_N,
)

STUDY = ("DATE '1996-01-01'", "DATE '2001-06-30'")


def rd(expr: str, n: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {n}) + CAST(0 AS DOUBLE))"


def sql(*parts: str) -> str:
    """CTEs followed by the final select."""
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


CELLS = """cells AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_suppkey AS firm,
         sum(l_extendedprice) AS volume, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)"""
CALENDAR = """calendar AS (
  SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS t FROM (SELECT DISTINCT date FROM cells))"""
SECTORS = """sectors AS (
  SELECT s_suppkey AS firm, CASE WHEN s_acctbal >= 0 THEN r_name WHEN r_name <> 'MIDDLE EAST' THEN n_name
    ELSE 'Unknown' END AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def universe(n: int = UNIVERSE_N) -> str:
    return f"""universe AS (
  SELECT CAST(row_number() OVER (ORDER BY m DESC, firm) - 1 AS INT) AS pos, firm, m FROM (
    SELECT firm, avg(volume) AS m FROM cells
    WHERE firm IN (SELECT firm FROM sectors WHERE sector <> 'Unknown') GROUP BY firm ORDER BY m DESC, firm LIMIT {n}))"""


RETURNS = """priced AS (
  SELECT u.firm, k.t, k.date, c.volume, c.volume / c.qty AS price
  FROM universe u CROSS JOIN calendar k LEFT JOIN cells c ON c.firm = u.firm AND c.date = k.date),
returns AS (
  SELECT *, coalesce(price / last_value(price IGNORE NULLS) OVER (
      PARTITION BY firm ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS r FROM priced),
mkt AS (
  SELECT t, coalesce(price / last_value(price IGNORE NULLS) OVER (
      ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS r
  FROM (SELECT k.t, sum(volume) / sum(qty) AS price FROM cells JOIN calendar k USING (date) GROUP BY k.t)),
panel AS (SELECT returns.*, ln(1 + returns.r) - ln(1 + mkt.r) AS x FROM returns JOIN mkt USING (t))"""


def market(n: int = UNIVERSE_N) -> tuple[str, ...]:
    return CELLS, CALENDAR, SECTORS, universe(n), RETURNS


ALL_FIRMS = "universe AS (SELECT firm FROM sectors WHERE sector <> 'Unknown')"


def windows(lookback: int = LOOKBACK) -> str:
    return f"""refits AS (
  SELECT CAST(unnest(generate_series({lookback}, (SELECT max(t) FROM calendar), {REFIT_EVERY})) AS INT) AS refit),
raw_win AS (
  SELECT refit, firm, t, x FROM refits JOIN panel ON t BETWEEN refit - {lookback} AND refit - 1),
bounds AS (
  SELECT refit, firm, quantile_cont(x, CAST(0.01 AS DOUBLE)) AS lo, quantile_cont(x, CAST(0.99 AS DOUBLE)) AS hi
  FROM raw_win GROUP BY ALL),
win AS (
  SELECT refit, firm, t, greatest(lo, least(x, hi)) AS w FROM raw_win JOIN bounds USING (refit, firm)),
lagged AS (SELECT refit, firm, t, w, lag(w) OVER (PARTITION BY refit, firm ORDER BY t) AS z FROM win),
days AS (
  SELECT p.firm, p.t, p.x, lag(p.x) OVER (PARTITION BY p.firm ORDER BY p.t) AS x_last,
         CAST({lookback} + ((p.t - {lookback}) // {REFIT_EVERY}) * {REFIT_EVERY} AS INT) AS refit FROM panel p)"""


def ar_model(lookback: int = LOOKBACK) -> str:
    return f"""ar_coef AS (
  SELECT refit, firm, regr_slope(w, z) AS b, regr_intercept(w, z) AS a FROM lagged WHERE z IS NOT NULL GROUP BY ALL),
ar AS (
  SELECT 'AR' AS model, t, refit, firm, x, a + b * x_last AS pred FROM days JOIN ar_coef USING (refit, firm)
  WHERE t >= {lookback})"""


WINDOWS, AR = windows(), ar_model()


def normal_p(z: str) -> str:
    """Two-sided normal tail by Simpson's rule on [0, |z|]."""
    cap = f"least(abs({z}), 12.0::DOUBLE)"
    return (f"(1 - 2 * ({cap} / 3000) * list_sum(list_transform(range(0, 1001), lambda i: "
            f"(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
            f"exp(-0.5::DOUBLE * pow({cap} * i / 1000, 2)))) / sqrt(2 * pi()))")


def student_p(t: str, df: str) -> str:
    cap = f"abs({t})"
    front = f"exp(lgamma(({df} + 1) / 2.0::DOUBLE) - lgamma({df} / 2.0::DOUBLE)) / sqrt({df} * pi())"
    return (f"(1 - 2 * ({cap} / 6000) * list_sum(list_transform(range(0, 2001), lambda i: "
            f"(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
            f"pow(1 + pow({cap} * i / 2000, 2) / {df}, -({df} + 1) / 2.0::DOUBLE))) * {front})")


def stat_metrics(src: str, by: str = "model") -> str:
    return f"""stat AS (
  SELECT {by}, 1 - sum((x - pred) * (x - pred)) / sum(x * x) AS oos_r2, avg((x - pred) * (x - pred)) AS mse,
         avg(abs(x - pred)) AS mae,
         avg(CASE WHEN pred <> 0 THEN CAST(sign(pred) = sign(x) AS INT) END) AS dir_acc FROM {src} GROUP BY ALL)"""


def pnl(src: str, frac: float = 1.0, by: str = "model") -> str:
    keep = "sign(pred)" if frac >= 1 else (
        f"CASE WHEN rank() OVER (PARTITION BY {by}, t ORDER BY abs(pred) DESC) <= "
        f"greatest(1, ceil({frac}::DOUBLE * count(*) OVER (PARTITION BY {by}, t))) THEN sign(pred) ELSE 0 END")
    return f"""bets AS (SELECT {by}, t, x, {keep} AS bet FROM {src}),
pnl AS (
  SELECT {by}, t, sum(bet * x) AS pnl, count(*) FILTER (bet <> 0) AS trades,
         count(*) FILTER (bet <> 0 AND bet = sign(x)) AS hits FROM bets GROUP BY ALL)"""


MOMENTS = """centred AS (SELECT *, pnl - avg(pnl) OVER (PARTITION BY model) AS d FROM pnl),
m0 AS (
  SELECT model, count(*) AS n, avg(pnl) / stddev_samp(pnl) AS sharpe,
         avg(d * d * d) / pow(avg(d * d), 1.5::DOUBLE) AS skew, avg(d * d * d * d) / pow(avg(d * d), 2) AS kurt,
         sum(pnl) AS total, sum(trades) AS trades, sum(hits) AS hits FROM centred GROUP BY model),
mom AS (
  SELECT *, sharpe / sqrt((1 - skew * sharpe + (kurt - 1) * sharpe * sharpe / 4) / (n - 1)) AS z FROM m0)"""


def econ(periods: float = 52.0) -> str:
    return f"""econ AS (
  SELECT model, {rd(f"sharpe * sqrt({periods!r}::DOUBLE)")} AS ann_sharpe, {rd(normal_p("z"))} AS sharpe_p,
         {rd("total / greatest(trades, 1) * 1e4::DOUBLE", 4)} AS ppt_bps,
         {rd("hits / trades")} AS hit_ratio FROM mom)"""


ECON = econ()


def dm(src: str, pairs: list[tuple[str, str]], by: str = "", a_name="model_a better", b_name="model_b better") -> str:
    key = f"{by}, " if by else ""
    listed = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    using = "USING (t, firm)" if not by else f"USING ({by}, t, firm)"
    return f"""dm_pairs(model_a, model_b) AS (VALUES {listed}),
loss AS (
  SELECT {key}model_a, model_b, t, avg(pow(a.pred - a.x, 2) - pow(b.pred - b.x, 2)) AS d
  FROM dm_pairs JOIN {src} a ON a.model = model_a JOIN {src} b {using} WHERE b.model = model_b GROUP BY ALL),
dm0 AS (
  SELECT {key}model_a, model_b, count(*) AS days, avg(d) / sqrt(var_samp(d) / count(*)) AS dm FROM loss GROUP BY ALL),
dm AS (
  SELECT *, CASE WHEN dm < 0 AND p < 0.05 THEN '{a_name}' WHEN dm > 0 AND p < 0.05 THEN '{b_name}'
     ELSE 'no significant difference' END AS verdict FROM (SELECT *, {normal_p("dm")} AS p FROM dm0))"""


# Least squares of many small systems: the normal equations of one system are a
# list of rows, and each recursion step sweeps out one unknown.
def solve(name: str, design: str, target: str) -> str:
    """``design(sys, t, j, v)`` with j = 0.. dense, ``target(sys, t, k, y)``; gives ``name(sys, k, j, coef)``."""
    return f"""{name}_g AS (
  SELECT a.sys, a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM {design} a JOIN {design} b USING (sys, t) GROUP BY ALL
  UNION ALL
  SELECT d.sys, d.j AS i, 100000 + y.k AS j, sum(d.v * y.y) AS v FROM {design} d JOIN {target} y USING (sys, t) GROUP BY ALL),
{name}_rows AS (SELECT sys, i, list(v ORDER BY j) AS r FROM {name}_g GROUP BY ALL),
{name}_m AS (SELECT sys, 1 AS step, count(*) AS n, list(r ORDER BY i) AS m FROM {name}_rows GROUP BY sys),
{name}_gj AS (
  SELECT * FROM {name}_m
  UNION ALL
  SELECT sys, step + 1, n, list_transform(range(1, n + 1), lambda i: list_transform(range(1, len(m[1]) + 1), lambda j:
      CASE WHEN i = step THEN m[step][j] / m[step][step]
           ELSE m[i][j] - m[i][step] * m[step][j] / m[step][step] END))
  FROM {name}_gj WHERE step <= n),
{name}_last AS (SELECT sys, n, m FROM {name}_gj WHERE step = n + 1),
{name} AS (
  SELECT sys, CAST(j AS INT) AS j, CAST(k AS INT) AS k, m[j + 1][n + k + 1] AS coef
  FROM {name}_last, unnest(range(0, n)) AS u(j), unnest(range(0, len(m[1]) - n)) AS v(k))"""


VAR = f"""lag_rows AS (SELECT refit, pos, t, w, z FROM lagged JOIN universe USING (firm) WHERE z IS NOT NULL),
var_x AS (
  SELECT refit AS sys, t, pos + 1 AS j, z AS v FROM lag_rows
  UNION ALL SELECT DISTINCT refit, t, 0, CAST(1 AS DOUBLE) FROM lag_rows),
var_y AS (SELECT refit AS sys, t, pos AS k, w AS y FROM lag_rows),
{solve("var_b", "var_x", "var_y")},
var_in AS (
  SELECT refit, t, pos + 1 AS j, x_last AS v FROM days JOIN universe USING (firm) WHERE t >= {LOOKBACK}
  UNION ALL SELECT DISTINCT refit, t, 0, CAST(1 AS DOUBLE) FROM days WHERE t >= {LOOKBACK}),
var_pred AS (
  SELECT i.refit, i.t, b.k, sum(b.coef * i.v) AS pred FROM var_in i JOIN var_b b ON b.sys = i.refit AND b.j = i.j GROUP BY ALL),
var AS (
  SELECT 'VAR' AS model, d.t, d.refit, d.firm, d.x, p.pred FROM days d JOIN universe u USING (firm)
  JOIN var_pred p ON p.refit = d.refit AND p.t = d.t AND p.k = u.pos)"""


def graph_ols(out: str, links: str, lookback: int = LOOKBACK) -> str:
    """Hard-graph forecasts; ``links(model, refit, a, b)`` holds both directions of every edge in force."""
    return f"""{out}_models AS (SELECT DISTINCT model FROM {out}_names),
{out}_set AS (
  SELECT model, refit, a, b FROM {links}
  UNION SELECT model, refit, firm, firm FROM {out}_models, refits, universe),
{out}_cols AS (
  SELECT model, refit, a, b, concat_ws('|', model, refit, a) AS sys,
         row_number() OVER (PARTITION BY model, refit, a ORDER BY b) AS j FROM {out}_set),
{out}_x AS (
  SELECT c.sys, l.t, c.j, l.z AS v FROM {out}_cols c JOIN lagged l ON l.refit = c.refit AND l.firm = c.b WHERE l.z IS NOT NULL
  UNION ALL
  SELECT DISTINCT c.sys, l.t, 0, CAST(1 AS DOUBLE) FROM {out}_cols c JOIN lagged l ON l.refit = c.refit AND l.firm = c.a WHERE l.z IS NOT NULL),
{out}_y AS (
  SELECT DISTINCT c.sys, l.t, 0 AS k, l.w AS y FROM {out}_cols c JOIN lagged l ON l.refit = c.refit AND l.firm = c.a WHERE l.z IS NOT NULL),
{solve(out + "_b", out + "_x", out + "_y")},
{out} AS (
  SELECT c.model, d.t, d.refit, d.firm, any_value(d.x) AS x,
         any_value(b0.coef) + sum(b.coef * n.x_last) AS pred
  FROM {out}_cols c JOIN days d ON d.firm = c.a AND d.refit = c.refit
  JOIN days n ON n.firm = c.b AND n.t = d.t
  JOIN {out}_b b ON b.sys = c.sys AND b.j = c.j JOIN {out}_b b0 ON b0.sys = c.sys AND b0.j = 0
  WHERE d.t >= {lookback} GROUP BY ALL)"""


CODE = """(CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 2 ELSE 4 END
       + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END)"""
PAIRS = f"""slots AS (
  SELECT l_orderkey AS o, l_shipdate AS ts, {CODE} AS code, l_discount AS disc, l_suppkey AS firm,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_shipdate, l_partkey, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS ln FROM lineitem),
pairs AS (
  SELECT a.o, a.ln, a.ts, a.code, a.disc, a.firm AS firm_a, b.firm AS firm_b
  FROM slots a JOIN slots b ON a.o = b.o AND b.ln = a.ln + 1 WHERE a.firm <> b.firm)"""
_LAYER = "CASE code " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LAYER_OF_CODE)) + " END"


def snapshots(*wins: int) -> str:
    listed = ", ".join(f"({w})" for w in wins or (20, 60, 252))
    return PAIRS + f""",
edges AS (
  SELECT CAST(ts AS DATE) AS date, {_LAYER} AS layer, least(firm_a, firm_b) AS src, greatest(firm_a, firm_b) AS dst,
         1 - disc AS conf FROM pairs),
wins(win) AS (VALUES {listed}),
snap_list AS (SELECT DATE '{BASE_DATE}' + CAST(20 * i AS INT) AS snap_date FROM range(0, 200) g(i)),
snaps_all AS (
  SELECT snap_date, CAST(win AS INT) AS win, layer, src, dst, sum(conf) AS weight FROM edges, wins, snap_list
  WHERE date <= snap_date AND date > snap_date - CAST(win AS INT) GROUP BY ALL),
listing AS (SELECT DISTINCT snap_date, win FROM snaps_all)"""


NEWS_LAYERS = "('COMPETES_WITH', 'PARTNERS_WITH', 'SUPPLIES_TO', 'ACQUIRES')"
BUSINESS = f"""whole AS (
  SELECT snap_date, win, src, dst, sum(weight) AS weight FROM snaps_all WHERE layer IN {NEWS_LAYERS} GROUP BY ALL)"""
INSIDE = "src IN (SELECT firm FROM universe) AND dst IN (SELECT firm FROM universe)"
NEWS = f"""news AS (
  SELECT snap_date, win, src, dst, sum(weight) AS weight FROM snaps_all
  WHERE layer IN {NEWS_LAYERS} AND {INSIDE} GROUP BY ALL)"""
UNI = (CELLS, CALENDAR, SECTORS, universe())


def ends(src: str) -> str:
    return (f"(SELECT snap_date, win, src AS node, dst AS other FROM {src} "
            f"UNION ALL SELECT snap_date, win, dst, src FROM {src})")


SUMMARY = f"""deg AS (SELECT snap_date, win, node, count(*) AS degree FROM {ends("news")} GROUP BY ALL),
per AS (SELECT snap_date, win, CAST(sum(degree) / 2 AS BIGINT) AS edges, max(degree) AS max_degree, count(*) AS touched
        FROM deg GROUP BY ALL),
summary AS (
  SELECT l.snap_date, l.win, coalesce(edges, 0) AS edges, 2 * coalesce(edges, 0) / n AS mean_degree,
         coalesce(max_degree, 0) AS max_degree, n - coalesce(touched, 0) AS isolated,
         2 * coalesce(edges, 0) / (n * (n - 1)) AS density
  FROM listing l LEFT JOIN per USING (snap_date, win), (SELECT count(*) AS n FROM universe))"""


def persistence(listing: str = "listing") -> str:
    return f"""ordered AS (
  SELECT snap_date, win, lag(snap_date) OVER (PARTITION BY win ORDER BY snap_date) AS prev FROM {listing}),
persist AS (
  SELECT o.snap_date, o.win, CASE WHEN prev IS NOT NULL THEN
     (SELECT count(*) FROM news a JOIN news b ON a.src = b.src AND a.dst = b.dst AND a.win = b.win
        WHERE a.win = o.win AND a.snap_date = o.snap_date AND b.snap_date = o.prev)
     / greatest((SELECT count(*) FROM news b WHERE b.win = o.win AND b.snap_date = o.prev), 1) END AS edge_persistence
  FROM ordered o)"""


def share(src: str) -> str:
    return f"""shares AS (
  SELECT snap_date, win, 100 * avg(CAST(a.sector = b.sector AS INT)) AS pct_within_sector
  FROM {src} JOIN sectors a ON a.firm = src JOIN sectors b ON b.firm = dst GROUP BY ALL)"""


def cluster(src: str) -> str:
    return f"""both_ends AS (SELECT * FROM {ends(src)}),
cdeg AS (SELECT snap_date, win, node, count(*) AS degree FROM both_ends GROUP BY ALL),
tri AS (
  SELECT a.snap_date, a.win, a.node, count(*) AS closed
  FROM both_ends a JOIN both_ends b ON a.snap_date = b.snap_date AND a.win = b.win AND a.node = b.node AND a.other < b.other
  JOIN {src} e ON e.snap_date = a.snap_date AND e.win = a.win AND e.src = a.other AND e.dst = b.other GROUP BY ALL),
clus AS (
  SELECT snap_date, win, node, degree, CASE WHEN degree >= 2 THEN 2 * coalesce(closed, 0) / (degree * (degree - 1)) ELSE 0 END AS clustering
  FROM cdeg LEFT JOIN tri USING (snap_date, win, node))"""


def components(src: str) -> str:
    return f"""cc_ends AS (SELECT * FROM {ends(src)}),
reach AS (
  SELECT snap_date, win, node, node AS label FROM cc_ends
  UNION
  SELECT r.snap_date, r.win, e.other, r.label FROM reach r JOIN cc_ends e USING (snap_date, win, node)),
comp AS (SELECT snap_date, win, node, min(label) AS component FROM reach GROUP BY ALL)"""


def structure() -> tuple[str, ...]:
    return (
        *UNI, snapshots(252).replace("listing AS (SELECT DISTINCT snap_date, win FROM snaps_all)",
                                     "listing AS (SELECT DISTINCT snap_date, win FROM snaps_all "
                                     f"WHERE snap_date BETWEEN {STUDY[0]} AND {STUDY[1]})"),
        NEWS, SUMMARY, persistence(), share("news"), cluster("news"), components("news"),
        """cc AS (SELECT snap_date, win, count(DISTINCT component) AS components FROM comp GROUP BY ALL),
big AS (SELECT snap_date, win, max(n) AS largest_comp FROM (
   SELECT snap_date, win, component, count(*) AS n FROM comp GROUP BY ALL) GROUP BY ALL),
cl AS (SELECT snap_date, win, avg(clustering) AS clustering FROM clus GROUP BY ALL),
structure AS (
  SELECT snap_date, win, edges, density, mean_degree, max_degree, isolated, coalesce(components, 0) AS components,
         coalesce(largest_comp, 0) AS largest_comp, coalesce(clustering, 0) AS clustering, pct_within_sector, edge_persistence
  FROM summary LEFT JOIN cc USING (snap_date, win) LEFT JOIN big USING (snap_date, win) LEFT JOIN cl USING (snap_date, win)
  LEFT JOIN shares USING (snap_date, win) LEFT JOIN persist USING (snap_date, win))""")


ASOF = """force AS (
  SELECT d.t, d.date, CASE WHEN date_diff('day', s.snap_date, d.date) <= 183 THEN s.snap_date END AS snap_date
  FROM calendar d ASOF LEFT JOIN (SELECT DISTINCT snap_date FROM listing) s ON d.date > s.snap_date)"""


# Penalised equations: one coordinate per recursion step, all equations of all refits together.
def descend(name: str, alpha: float, l1_ratio: float, weight: str, sweeps: int = 60) -> str:
    """``weight`` is the penalty weight of column j in equation k; gives ``name(model, t, refit, firm, x, pred)``."""
    steps = sweeps * UNIVERSE_N
    return f"""{name}_c AS (
  SELECT refit, pos, t, z - avg(z) OVER (PARTITION BY refit, pos) AS z, w - avg(w) OVER (PARTITION BY refit, pos) AS w FROM lag_rows),
{name}_gl AS (
  SELECT a.refit, a.pos AS i, b.pos AS j, avg(a.z * b.z) AS g FROM {name}_c a JOIN {name}_c b USING (refit, t) GROUP BY ALL),
{name}_g AS (SELECT refit, list(r ORDER BY i) AS g FROM (
  SELECT refit, i, list(g ORDER BY j) AS r FROM {name}_gl GROUP BY ALL) GROUP BY refit),
{name}_q0 AS (
  SELECT a.refit, a.pos AS k, b.pos AS j, avg(a.w * b.z) AS c FROM {name}_c a JOIN {name}_c b USING (refit, t) GROUP BY ALL),
{name}_q AS (
  SELECT q.refit, q.k, list(c ORDER BY q.j) AS c, list({weight} ORDER BY q.j) AS pw FROM {name}_q0 q
  LEFT JOIN soft_pen s ON s.refit = q.refit AND s.k = q.k AND s.j = q.j GROUP BY ALL),
{name}_cd AS (
  SELECT refit, k, 0 AS step, list_transform(c, lambda v: CAST(0 AS DOUBLE)) AS b, c AS r FROM {name}_q
  UNION ALL
  SELECT refit, k, step + 1, list_transform(b, lambda v, i: CASE WHEN i = j THEN fresh ELSE v END),
         list_transform(r, lambda v, i: v - (fresh - b[j]) * g[j][i])
  FROM (
    SELECT *, sign(r[j] + g[j][j] * b[j]) * greatest(abs(r[j] + g[j][j] * b[j]) - {alpha * l1_ratio!r}::DOUBLE * pw[j], 0)
       / (g[j][j] + {alpha * (1 - l1_ratio)!r}::DOUBLE * pw[j] * pw[j]) AS fresh
    FROM (SELECT s.refit, s.k, s.step, s.b, s.r, m.g, q.pw, s.step % len(s.b) + 1 AS j
          FROM {name}_cd s JOIN {name}_g m USING (refit) JOIN {name}_q q ON q.refit = s.refit AND q.k = s.k WHERE s.step < {steps}))),
{name}_b AS (
  SELECT refit, k, CAST(u.j AS INT) AS j, b[u.j + 1] AS coef FROM {name}_cd, unnest(range(0, len(b))) AS u(j) WHERE step = {steps}),
{name}_mean AS (SELECT refit, pos, avg(z) AS mz, avg(w) AS mw FROM lag_rows GROUP BY ALL),
{name}_in AS (SELECT d.refit, d.t, u.pos AS j, d.x_last FROM days d JOIN universe u USING (firm) WHERE d.t >= {LOOKBACK}),
{name}_p AS (
  SELECT i.refit, i.t, b.k, sum(b.coef * (i.x_last - m.mz)) AS v FROM {name}_in i
  JOIN {name}_b b ON b.refit = i.refit AND b.j = i.j JOIN {name}_mean m ON m.refit = i.refit AND m.pos = i.j GROUP BY ALL),
{name} AS (
  SELECT d.t, d.refit, d.firm, d.x, p.v + m.mw AS pred FROM days d JOIN universe u USING (firm)
  JOIN {name}_p p ON p.refit = d.refit AND p.t = d.t AND p.k = u.pos JOIN {name}_mean m ON m.refit = d.refit AND m.pos = u.pos)"""


LAG_ROWS = "lag_rows AS (SELECT refit, pos, t, w, z FROM lagged JOIN universe USING (firm) WHERE z IS NOT NULL)"
NO_PEN = "soft_pen AS (SELECT CAST(NULL AS INT) AS refit, CAST(NULL AS INT) AS k, CAST(NULL AS INT) AS j WHERE false)"
EQUAL = "CAST(1 AS DOUBLE)"


def soft_pen(case: str) -> str:
    """Linked pairs of one graph, as positions; own lags included."""
    return f"""soft_pen AS (
  SELECT DISTINCT refit, ua.pos AS k, ub.pos AS j FROM hard_links JOIN universe ua ON ua.firm = a JOIN universe ub ON ub.firm = b
  WHERE model = '{case}' UNION SELECT refit, pos, pos FROM refits, universe)"""


def links(names: str, cases: dict[str, str]) -> str:
    """Edges in force on refit days, both ways, per model; ``cases`` maps a model to its layers."""
    parts = "\n  UNION ALL ".join(
        f"SELECT '{m}' AS model, refit, src, dst FROM refits JOIN force f ON f.t = refit JOIN snaps_all s USING (snap_date) "
        f"WHERE layer IN {layers} AND {INSIDE}" for m, layers in cases.items())
    listed = ", ".join(f"('{m}')" for m in cases)
    return f"""{names}_names(model) AS (VALUES {listed}),
{names}_e AS (SELECT DISTINCT * FROM ({parts})),
{names}_links AS (
  SELECT model, refit, src AS a, dst AS b FROM {names}_e UNION ALL SELECT model, refit, dst, src FROM {names}_e)"""


HARD_CASES = {"GraphVAR-news-hard": NEWS_LAYERS, "GraphVAR-sector-hard": "('SECTOR_PEER')"}
CORR_LINKS = f"""cg_names(model) AS (VALUES ('CorrGraphVAR-hard')),
cg_k AS (
  SELECT refit, count(*) AS k FROM (
    SELECT DISTINCT refit, src, dst FROM refits JOIN force f ON f.t = refit JOIN snaps_all s USING (snap_date)
    WHERE layer IN {NEWS_LAYERS} AND {INSIDE}) GROUP BY ALL),
cg_rank AS (
  SELECT refit, a, b, row_number() OVER (PARTITION BY refit ORDER BY round(abs(c), 12) DESC, least(pa, pb), greatest(pa, pb)) AS rk
  FROM (SELECT x.refit, x.firm AS a, y.firm AS b, any_value(ux.pos) AS pa, any_value(uy.pos) AS pb, corr(x.w, y.w) AS c
        FROM win x JOIN win y ON x.refit = y.refit AND x.t = y.t AND x.firm < y.firm
        JOIN universe ux ON ux.firm = x.firm JOIN universe uy ON uy.firm = y.firm GROUP BY ALL)),
cg_e AS (SELECT refit, a, b FROM cg_rank JOIN cg_k USING (refit) WHERE rk <= k),
cg_links AS (
  SELECT 'CorrGraphVAR-hard' AS model, refit, a, b FROM cg_e UNION ALL SELECT 'CorrGraphVAR-hard', refit, b, a FROM cg_e)"""

FORECAST = f"SELECT model, t, refit, firm, {rd('x')} AS x, {rd('pred')} AS pred FROM "
GRAPH_MARKET = (*market(), WINDOWS, snapshots(252), ASOF)

CORR_INPUT = f"""strided AS (
  SELECT snap_date, win FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY snap_date) AS i FROM listing
    WHERE snap_date BETWEEN {STUDY[0]} AND {STUDY[1]}) WHERE (i - 1) % 12 = 0),
ends AS (SELECT s.snap_date, s.win, count(*) AS e FROM strided s JOIN calendar c ON c.date < s.snap_date GROUP BY ALL),
cw AS (SELECT e.snap_date, e.win, r.firm, r.t, r.r FROM ends e JOIN returns r ON r.t < e.e AND r.t >= e.e - {LOOKBACK}),
cp AS (
  SELECT x.snap_date, x.win, x.firm AS src, y.firm AS dst, abs(coalesce(corr(x.r, y.r), 0)) AS c, count(*) AS n
  FROM cw x JOIN cw y USING (snap_date, win, t) WHERE x.firm < y.firm GROUP BY ALL)"""
CORR_TOP = """ck AS (SELECT n.snap_date, n.win, count(*) AS k FROM news n JOIN strided USING (snap_date, win) GROUP BY ALL),
corr_top AS (
  SELECT snap_date, win, src, dst, c AS weight FROM (
    SELECT cp.*, row_number() OVER (PARTITION BY cp.snap_date, cp.win
       ORDER BY round(c, 12) DESC, least(a.pos, b.pos), greatest(a.pos, b.pos)) AS rk
    FROM cp JOIN universe a ON a.firm = src JOIN universe b ON b.firm = dst) JOIN ck USING (snap_date, win) WHERE rk <= k)"""
GAP = f"""led AS (
  SELECT snap_date, win, 'ALL_NEWS' AS layer, src, dst FROM news
  UNION SELECT snap_date, win, layer, src, dst FROM snaps_all WHERE layer IN {NEWS_LAYERS} AND {INSIDE}),
lab AS (
  SELECT p.snap_date, p.win, y.layer, p.c, a.sector = b.sector AS same, l.src IS NOT NULL AS linked
  FROM cp p JOIN (SELECT DISTINCT layer FROM led) y ON true JOIN sectors a ON a.firm = p.src JOIN sectors b ON b.firm = p.dst
  LEFT JOIN led l ON l.snap_date = p.snap_date AND l.win = p.win AND l.layer = y.layer AND l.src = p.src AND l.dst = p.dst
  WHERE p.n >= 60),
gap AS (
  SELECT snap_date, win, layer, count(*) FILTER (linked) AS n_linked, avg(c) FILTER (linked) AS linked_corr,
    avg(c) FILTER (NOT linked) AS unlinked_corr, avg(c) FILTER (linked) - avg(c) FILTER (NOT linked) AS overall,
    CASE WHEN count(*) FILTER (linked AND same) >= 3 AND count(*) FILTER (NOT linked AND same) >= 3
      THEN avg(c) FILTER (linked AND same) - avg(c) FILTER (NOT linked AND same) END AS same_sector,
    CASE WHEN count(*) FILTER (linked AND NOT same) >= 3 AND count(*) FILTER (NOT linked AND NOT same) >= 3
      THEN avg(c) FILTER (linked AND NOT same) - avg(c) FILTER (NOT linked AND NOT same) END AS cross_sector
  FROM lab GROUP BY ALL HAVING count(*) FILTER (linked) >= 5)"""


def _phrase(i: int) -> str:
    return "CASE code " + " ".join(f"WHEN {c} THEN '{p[i]}'" for c, p in enumerate(PHRASES)) + " END"


_REL = "CASE code " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RELATION_OF_CODE)) + " END"
NAMED = "named AS (SELECT s_suppkey, replace(s_name, 'Supplier#', 'Vendor ') AS nm FROM supplier)"
HEAD = f"""{NAMED},
heads0 AS (
  SELECT concat('order/', o, '/', ln) AS article_id, ts, code, disc, firm_a, firm_b, a.nm AS name_a, b.nm AS name_b,
         {_phrase(0)} || a.nm || {_phrase(1)} || b.nm || {_phrase(2)} AS title,
         CASE WHEN code < 4 AND disc < 0.09::DOUBLE THEN {_REL} WHEN code = 4 AND disc <= 0.01::DOUBLE THEN 'partnership' END AS truth,
         CASE WHEN disc < 0.05::DOUBLE THEN 'low discount' ELSE 'high discount' END AS panel
  FROM pairs JOIN named a ON a.s_suppkey = firm_a JOIN named b ON b.s_suppkey = firm_b),
heads AS (SELECT *, coalesce(truth || ': ' || name_a || '-' || name_b, 'none') AS label FROM heads0)"""
NEWS_ROWS = f"""news_rows AS (
  SELECT CASE WHEN NOT (code = 5 AND disc >= 0.09::DOUBLE) THEN ts END AS "Date",
         CASE WHEN NOT (code = 4 AND disc >= 0.09::DOUBLE) THEN title END AS "Article_title",
         unnest([firm_a, firm_b]) AS "Stock_symbol",
         CASE WHEN disc < 0.08::DOUBLE THEN 'https://news.example/' || article_id END AS "Url",
         CASE WHEN disc > 0.02::DOUBLE THEN 'Desk ' || code END AS "Publisher", article_id AS source_row FROM heads),
kept AS (
  SELECT * FROM news_rows WHERE "Date" IS NOT NULL AND "Article_title" IS NOT NULL AND "Date" <= TIMESTAMP '2000-12-31'
    AND "Stock_symbol" IN (SELECT firm FROM sectors WHERE sector <> 'Unknown'))"""
ARTICLES = """articles AS (
  SELECT coalesce("Url", "Article_title") AS article_id, min("Date") AS date,
         first("Article_title" ORDER BY "Date", source_row, "Stock_symbol") AS title,
         first("Publisher" ORDER BY "Date", source_row, "Stock_symbol") FILTER ("Publisher" IS NOT NULL) AS publisher,
         list_sort(list(DISTINCT "Stock_symbol")) AS tags
  FROM kept GROUP BY 1)"""
TEXT = (SECTORS, PAIRS, HEAD)


def junk(col: str) -> str:
    return f"(regexp_matches({col}, '(?i){'|'.join(JUNK_PATTERNS)}') OR regexp_matches({col}, '(?i){FUND_BUYER}'))"


def relation(col: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({col}, '(?i){p}') THEN '{r}'" for r, p in RELATION_PATTERNS)
    return f"CASE {cases} END"


DICT = """dict AS (
  SELECT firm, pos, nm, CASE WHEN s_acctbal > 5000 THEN 'The ' ELSE '' END || nm
     || CASE WHEN s_nationkey < 8 THEN ', Inc.' WHEN s_nationkey < 16 THEN ' Corporation' ELSE ' Group plc' END AS official
  FROM universe JOIN supplier ON s_suppkey = firm JOIN named USING (s_suppkey)),
forms AS (
  SELECT firm, pos, 0 AS slot, official AS form FROM dict UNION ALL SELECT firm, pos, 1, nm FROM dict
  UNION ALL SELECT firm, pos, 2, 'House of ' || nm FROM dict UNION ALL SELECT firm, pos, 3, 'V' || firm FROM dict),
longs AS (SELECT firm, pos, slot, lower(form) AS name FROM forms WHERE length(form) >= 4)"""
MENTIONS = """hits AS (
  SELECT article_id, CAST(instr(title, nm) - 1 AS INT) AS start, CAST(instr(title, nm) - 1 + length(nm) AS INT) AS stop, firm
  FROM heads JOIN dict ON dict.firm IN (firm_a, firm_b))"""
RULES = f"""rule_edges AS (
  SELECT article_id, ts AS date, least(firm_a, firm_b) AS ticker_a, greatest(firm_a, firm_b) AS ticker_b,
         {relation('title')} AS relation, title AS headline
  FROM heads WHERE NOT {junk('title')} AND {relation('title')} IS NOT NULL
    AND firm_a IN (SELECT firm FROM universe) AND firm_b IN (SELECT firm FROM universe)
    AND instr(title, name_b) - instr(title, name_a) - length(name_a) <= 60)"""
MODEL = f"""model_edges AS (
  SELECT article_id, ts AS date, name_a AS firm_a, name_b AS firm_b, {relation('title')} AS relation, false AS rumor,
         title AS headline FROM heads WHERE code <> 4)"""
RESOLVED = """texts AS (
  SELECT name, trim(regexp_replace(regexp_replace(lower(trim(name)), '^the\\s+', ''),
     '([,\\s]+(inc|inc\\.|incorporated|corp|corp\\.|corporation|co|co\\.|company|ltd|ltd\\.|plc|llc|lp|l\\.p\\.|group|holdings?|nv|n\\.v\\.|sa|s\\.a\\.|ag))+$', ''),
     ' .,''"') AS txt FROM (SELECT DISTINCT name FROM written)),
matched AS (
  SELECT name, firm, least(length(txt), length(v.name2)) AS score, pos, slot FROM texts,
    (SELECT firm, pos, slot, name AS name2 FROM longs) v
  WHERE txt <> '' AND CASE WHEN length(txt) >= length(v.name2)
     THEN regexp_matches(txt, '\\b' || regexp_escape(v.name2) || '\\b') ELSE regexp_matches(v.name2, '\\b' || regexp_escape(txt) || '\\b') END),
resolved AS (
  SELECT t.name, m.firm FROM texts t LEFT JOIN (
    SELECT name, first(firm ORDER BY score DESC, pos, slot) AS firm FROM matched GROUP BY name) m USING (name))"""
PREDICTIONS = f"""rules_pred AS (SELECT DISTINCT article_id, relation FROM rule_edges),
model_pred AS (SELECT article_id, relation FROM model_edges)"""


def score_select(src: str) -> str:
    p, r = "tp / (tp + fp)", "tp / (tp + fn)"
    return f"""SELECT extractor, panel, found, tp, fp, fn, type_ok,
  CASE WHEN tp + fp > 0 THEN {rd(p)} END AS precision, CASE WHEN tp + fn > 0 THEN {rd(r)} END AS recall,
  CASE WHEN tp > 0 THEN {rd(f"2 * ({p}) * ({r}) / ({p} + {r})")} ELSE 0 END AS f1,
  CASE WHEN tp > 0 THEN type_ok || '/' || tp ELSE '-' END AS type_correct
FROM (SELECT extractor, coalesce(panel, 'all') AS panel, count(*) FILTER (predicted IS NOT NULL) AS found,
    count(*) FILTER (has AND predicted IS NOT NULL) AS tp, count(*) FILTER (NOT has AND predicted IS NOT NULL) AS fp,
    count(*) FILTER (has AND predicted IS NULL) AS fn, count(*) FILTER (has AND predicted = true_type) AS type_ok
  FROM {src} GROUP BY GROUPING SETS ((extractor, panel), (extractor)))"""


def target(kind: str, value: str) -> str:
    over = "PARTITION BY firm ORDER BY t ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING"
    return f"""act_{kind} AS ({value}),
lg_{kind} AS (SELECT t, firm, ln(v + 0.001::DOUBLE) AS l FROM act_{kind}),
tg0_{kind} AS (
  SELECT t, firm, l - CASE WHEN count(l) OVER ({over}) >= 21 THEN avg(l) OVER ({over}) END AS target FROM lg_{kind}),
tg_{kind} AS (
  SELECT t, firm, target FROM tg0_{kind} WHERE t IN (SELECT t FROM tg0_{kind} WHERE target IS NOT NULL))"""


ABSRET = target("absret", "SELECT t, firm, abs(ln(1 + r)) AS v FROM returns")
VOLUME = target("volume", "SELECT t, firm, volume AS v FROM returns")
RV = target("rv", """SELECT t, firm, CASE WHEN count(*) OVER w = 21 THEN sqrt(avg(pow(ln(1 + r), 2)) OVER w) END AS v
  FROM returns WINDOW w AS (PARTITION BY firm ORDER BY t ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")


def target_out(kind: str) -> str:
    return f"SELECT t, firm, {rd('target')} AS target FROM tg_{kind}"


METRIC_OUT = "SELECT model, {}, ann_sharpe, sharpe_p, ppt_bps, hit_ratio FROM stat JOIN econ USING (model)"
DAY_MARKET = tuple(p.replace("'week'", "'day'").replace("calendar", "day_calendar").replace("panel AS", "day_panel AS") for p in market())
DAY_RETURNS = "chosen AS (SELECT t, date, firm, x FROM day_panel)"
DAY_VOLUME = target("volume", "SELECT t, firm, coalesce(volume, 0) AS v FROM returns") + """,
chosen AS (SELECT t, date, firm, target AS x FROM tg_volume JOIN day_calendar USING (t))"""


def experiment(chosen: str, horizon: int, lookback: int, periods: float) -> str:
    """AR and the hard graphs on blocks of the chosen daily panel."""
    return sql(*DAY_MARKET, chosen, f"""panel AS (
  SELECT CAST((t - (SELECT min(t) FROM chosen)) // {horizon} AS INT) AS t, firm, min(date) AS date, sum(x) AS x FROM chosen GROUP BY ALL),
calendar AS (SELECT t, min(date) AS date FROM panel GROUP BY t)""", windows(lookback), snapshots(252), ASOF, ar_model(lookback),
               links("hard", HARD_CASES), graph_ols("hard", "hard_links", lookback),
               "everything AS (SELECT * FROM ar UNION ALL SELECT * FROM hard)", stat_metrics("everything"), pnl("everything"), MOMENTS,
               econ(periods), METRIC_OUT.format(STAT_OUT))


STRUCT_COLS = ["edges", "density", "mean_degree", "max_degree", "isolated", "components", "largest_comp", "clustering",
               "pct_within_sector", "edge_persistence"]
STAT_OUT = f"{rd('oos_r2')} AS oos_r2, {rd('mse')} AS mse, {rd('mae')} AS mae, {rd('dir_acc')} AS dir_acc"
SHIP = "ship AS (SELECT DISTINCT l_suppkey AS firm, CAST(l_shipdate AS DATE) AS date FROM lineitem)"
ORD = "ord AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"

ORACLES: dict[str, str] = {
    "panel_weekly": sql(CELLS, f"SELECT date, firm, {rd('volume', 2)} AS volume, {rd('qty', 2)} AS qty FROM cells"),
    "wide_unpivot": sql(CELLS, f"""SELECT k.date, f.firm, {rd('c.volume', 2)} AS value
FROM (SELECT DISTINCT firm FROM cells) f CROSS JOIN (SELECT DISTINCT date FROM cells) k LEFT JOIN cells c USING (firm, date)"""),
    "calendar_missing": sql(SHIP, ORD, """SELECT firm, date FROM (SELECT firm, min(date) AS lo, max(date) AS hi FROM ship GROUP BY 1) JOIN ord ON date BETWEEN lo AND hi
  WHERE (firm, date) NOT IN (SELECT (firm, date) FROM ship)"""),
    "calendar_extra": sql(SHIP, ORD, "SELECT DISTINCT date FROM ship WHERE date NOT IN (SELECT date FROM ord)"),
    "sector_coalesce": sql(SECTORS, "SELECT firm, sector FROM sectors"),
    "universe_topn": sql(CELLS, SECTORS, universe(), f"SELECT pos, firm, {rd('m', 3)} AS mean_value FROM universe"),
    "excess_returns": sql(*market(), f"SELECT t, date, firm, {rd('r')} AS r, {rd('x')} AS x FROM panel"),
    "horizon_blocks": sql(*market(), f"SELECT min(date) AS date, CAST(t // 5 AS INT) AS t, firm, {rd('sum(x)')} AS x FROM panel GROUP BY t // 5, firm"),
    "panel_slice": sql(*market(), f"""SELECT date, CAST(t - lo AS INT) AS t, firm, {rd('x')} AS x FROM panel, (
  SELECT greatest(0, count(*) FILTER (date < DATE '1998-01-01') - 30) AS lo, count(*) FILTER (date < DATE '1999-12-31') AS hi FROM calendar)
WHERE t BETWEEN lo AND hi"""),
    "target_absret": sql(*market(), ABSRET, target_out("absret")),
    "target_volume": sql(*market(), VOLUME, target_out("volume")),
    "target_rv": sql(*market(), RV, target_out("rv")),
    "lag1_autocorr": sql(*market(), ABSRET, VOLUME, RV, f"""SELECT name, {rd('avg(c)')} AS autocorr FROM (
  SELECT name, firm, corr(target, p) AS c FROM (
    SELECT *, lag(target) OVER (PARTITION BY name, firm ORDER BY t) AS p FROM (
      SELECT 'absret' AS name, * FROM tg_absret UNION ALL SELECT 'volume', * FROM tg_volume UNION ALL SELECT 'rv', * FROM tg_rv))
  GROUP BY ALL) GROUP BY name"""),
    "winsorized_windows": sql(*market(), WINDOWS, f"SELECT refit, firm, {rd('min(w)')} AS lo, {rd('max(w)')} AS hi, {rd('avg(w)')} AS mean FROM win GROUP BY ALL"),
    "ar_walkforward": sql(*market(), WINDOWS, AR, FORECAST + "ar"),
    "ar_all_firms": sql(CELLS, CALENDAR, SECTORS, ALL_FIRMS, RETURNS, WINDOWS, AR, f"""SELECT firm, count(*) AS days, {rd('avg(pred)')} AS mean_pred,
  {rd('avg(pow(x - pred, 2))')} AS mse FROM ar GROUP BY firm"""),
    "ar_statistical_metrics": sql(*market(), WINDOWS, AR, stat_metrics("ar"), f"SELECT model, {STAT_OUT} FROM stat"),
    "ar_pnl": sql(*market(), WINDOWS, AR, pnl("ar"), f"SELECT model, t, {rd('pnl')} AS pnl, trades, hits FROM pnl"),
    "ar_pnl_topfrac": sql(*market(), WINDOWS, AR, pnl("ar", 0.25), f"SELECT model, t, {rd('pnl')} AS pnl, trades, hits FROM pnl"),
    "sharpe_moments": sql(*market(), WINDOWS, AR, pnl("ar"), MOMENTS, f"""SELECT model, n, {rd('sharpe')} AS sharpe, {rd('skew')} AS skew,
  {rd('kurt')} AS kurt, {rd('z')} AS z FROM mom"""),
    "ar_economic_metrics": sql(*market(), WINDOWS, AR, pnl("ar"), MOMENTS, ECON, "SELECT * FROM econ"),
    "var_walkforward": sql(*market(), WINDOWS, VAR, FORECAST + "var"),
    "dm_test": sql(*market(), WINDOWS, AR, VAR, "both_models AS (SELECT * FROM ar UNION ALL SELECT * FROM var)",
                   dm("both_models", [("VAR", "AR")]),
                   f"SELECT model_a, model_b, days, {rd('dm')} AS dm, {rd('p')} AS p_value, verdict FROM dm"),
    "graph_snapshot_edges": sql(snapshots(), f"SELECT snap_date, win, layer, src, dst, {rd('weight')} AS weight FROM snaps_all"),
    "graph_layer_filter": sql(*UNI, snapshots(252), NEWS, f"SELECT snap_date, win, src, dst, {rd('weight')} AS weight FROM news"),
    "graph_asof_days": sql(CELLS, CALENDAR, snapshots(252), ASOF.replace(
        "(SELECT DISTINCT snap_date FROM listing)",
        "(SELECT DISTINCT snap_date FROM listing WHERE NOT snap_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31')"),
        "SELECT date, snap_date FROM force"),
    "time_audit": sql(CELLS, CALENDAR, snapshots(252), ASOF, f"""SELECT count(*) AS days, count(snap_date) AS days_with_graph,
  count(*) FILTER (snap_date IS NULL) AS days_without_graph, count(*) FILTER (snap_date >= date) AS violations,
  CAST(min(date - snap_date) AS INT) AS min_age, CAST(median(date - snap_date) AS DOUBLE) AS median_age,
  CAST(max(date - snap_date) AS INT) AS max_age FROM force WHERE date BETWEEN {STUDY[0]} AND {STUDY[1]}"""),
    "graph_summary": sql(*UNI, snapshots(252), NEWS, SUMMARY, f"""SELECT snap_date, win, edges, {rd('mean_degree')} AS mean_degree, max_degree,
  isolated, {rd('density')} AS density FROM summary"""),
    "edge_persistence": sql(*UNI, snapshots(252), NEWS, persistence(), f"SELECT snap_date, win, {rd('edge_persistence')} AS edge_persistence FROM persist"),
    "clustering_coefficient": sql(snapshots(60), BUSINESS, cluster("whole"), f"SELECT snap_date, win, node, degree, {rd('clustering')} AS clustering FROM clus"),
    "connected_components": sql(snapshots(20), BUSINESS, components("whole"), "SELECT snap_date, win, node, component FROM comp"),
    "sector_share": sql(SECTORS, snapshots(60), BUSINESS, share("whole"), f"SELECT snap_date, win, {rd('pct_within_sector')} AS pct_within_sector FROM shares"),
    "graph_structure": sql(*structure(), f"""SELECT snap_date, win, edges, {rd('density')} AS density, {rd('mean_degree')} AS mean_degree, max_degree,
  isolated, components, largest_comp, {rd('clustering')} AS clustering, {rd('pct_within_sector')} AS pct_within_sector,
  {rd('edge_persistence')} AS edge_persistence FROM structure"""),
    "structure_describe": sql(*structure(), "\nUNION ALL ".join(
        f"SELECT '{c}' AS metric, {rd(f'avg({c})')} AS mean, {rd(f'stddev_samp({c})')} AS std, {rd(f'min({c})')} AS min, "
        f"{rd(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS median, {rd(f'max({c})')} AS max FROM structure" for c in STRUCT_COLS)),
    "structure_by_year": sql(*structure(), "SELECT CAST(year(snap_date) AS INT) AS year, " + ", ".join(
        f"{rd(f'avg({c})')} AS {c}" for c in ("edges", "mean_degree", "isolated", "largest_comp", "clustering", "pct_within_sector"))
        + " FROM structure GROUP BY 1"),
    "window_length_study": sql(*UNI, snapshots(), NEWS, SUMMARY, f"""dense_list AS (
  SELECT * FROM listing WHERE snap_date BETWEEN {STUDY[0]} AND DATE '1998-12-31')""", persistence("dense_list"), share("news"),
        "SELECT win, count(*) AS snapshots, " + ", ".join(
            f"{rd(f'avg({c})')} AS {c}" for c in ("edges", "isolated", "pct_within_sector", "edge_persistence"))
        + """ FROM dense_list JOIN summary USING (snap_date, win) LEFT JOIN shares USING (snap_date, win)
LEFT JOIN persist USING (snap_date, win) GROUP BY win"""),
    "corr_graph_topk": sql(*market(), snapshots(252), NEWS, CORR_INPUT, CORR_TOP,
                           f"SELECT snap_date, win, src, dst, {rd('weight')} AS weight FROM corr_top"),
    "control_overlap": sql(*market(), snapshots(252), NEWS, CORR_INPUT, CORR_TOP, f"""gs AS (
  SELECT 'news' AS graph, snap_date, win, src, dst FROM news UNION ALL SELECT 'corr', snap_date, win, src, dst FROM corr_top
  UNION ALL SELECT DISTINCT 'sector', snap_date, win, src, dst FROM snaps_all WHERE layer = 'SECTOR_PEER' AND {INSIDE}),
gd AS (
  SELECT graph, snap_date, win, node, count(*) AS degree FROM (
    SELECT graph, snap_date, win, src AS node FROM gs UNION ALL SELECT graph, snap_date, win, dst FROM gs) GROUP BY ALL),
gp AS (SELECT graph, snap_date, win, sum(degree) / 2 AS edges, count(*) AS touched FROM gd GROUP BY ALL),
ov AS (
  SELECT n.snap_date, n.win, g.graph, count(*) AS hit FROM news n JOIN gs g USING (snap_date, win, src, dst) GROUP BY ALL),
rows_ AS (
  SELECT y.graph, coalesce(edges, 0) AS edges, n - coalesce(touched, 0) AS isolated, n,
         100 * coalesce(hit, 0) / greatest(coalesce((SELECT count(*) FROM news z WHERE z.snap_date = s.snap_date), 0), 1) AS overlap_pct
  FROM strided s CROSS JOIN (VALUES ('news'), ('sector'), ('corr')) y(graph) CROSS JOIN (SELECT count(*) AS n FROM universe)
  LEFT JOIN gp ON gp.graph = y.graph AND gp.snap_date = s.snap_date LEFT JOIN ov ON ov.graph = y.graph AND ov.snap_date = s.snap_date)""",
        f"""SELECT graph, {rd('avg(edges)')} AS edges, {rd('avg(2 * edges / (n * (n - 1)))')} AS density, {rd('avg(2 * edges / n)')} AS mean_degree,
  {rd('avg(isolated)')} AS isolated, {rd('avg(overlap_pct)')} AS overlap_pct FROM rows_ GROUP BY graph"""),
    "stratified_corr_gap": sql(*market(), snapshots(252), NEWS, CORR_INPUT, GAP, "SELECT snap_date, win, layer, n_linked, " + ", ".join(
        f"{rd(c)} AS {c}" for c in ("linked_corr", "unlinked_corr", "overall", "same_sector", "cross_sector")) + " FROM gap"),
    "layer_ttest": sql(*market(), snapshots(252), NEWS, CORR_INPUT, GAP, """tt AS (
  SELECT layer, count(*) AS n_snapshots, avg(n_linked) AS mean_linked_pairs, avg(linked_corr) AS corr_linked, avg(unlinked_corr) AS corr_unlinked, """
        + ", ".join(f"avg({c}) AS d_{c}, count({c}) AS n_{c}, CASE WHEN count({c}) >= 5 THEN avg({c}) / (stddev_samp({c}) / sqrt(count({c}))) END AS t_{c}"
                    for c in ("overall", "same_sector", "cross_sector")) + " FROM gap GROUP BY layer HAVING count(*) >= 5)",
        "SELECT layer, n_snapshots, " + ", ".join(f"{rd(c)} AS {c}" for c in ("mean_linked_pairs", "corr_linked", "corr_unlinked")) + ", "
        + ", ".join(f"{rd(f'd_{c}')} AS d_{c}, {rd(f't_{c}')} AS t_{c}, {rd(student_p(f't_{c}', f'(n_{c} - 1)'))} AS p_{c}"
                    for c in ("overall", "same_sector", "cross_sector")) + " FROM tt"),
    "graphvar_hard_walkforward": sql(*GRAPH_MARKET, links("hard", HARD_CASES), graph_ols("hard", "hard_links"), FORECAST + "hard"),
    "corrgraph_walkforward": sql(*GRAPH_MARKET, CORR_LINKS, graph_ols("cg", "cg_links"), FORECAST + "cg"),
    "lasso_walkforward": sql(*market(), WINDOWS, LAG_ROWS, NO_PEN, descend("cd", 3.16e-5, 1.0, EQUAL),
                             "named_model AS (SELECT 'SparseVAR-LASSO' AS model, * FROM cd)", FORECAST + "named_model"),
    "en_walkforward": sql(*market(), WINDOWS, LAG_ROWS, NO_PEN, descend("cd", 1e-4, 0.5, EQUAL),
                          "named_model AS (SELECT 'SparseVAR-EN' AS model, * FROM cd)", FORECAST + "named_model"),
    "graphvar_soft_walkforward": "\nUNION ALL ".join("SELECT * FROM (" + sql(
        *GRAPH_MARKET, LAG_ROWS, links("hard", HARD_CASES), soft_pen(case),
        descend("cd", 1e-4, 1.0, "CASE WHEN s.j IS NULL THEN 1 ELSE 0.1::DOUBLE END"),
        f"named_model AS (SELECT '{case.replace('hard', 'soft')}' AS model, * FROM cd)", FORECAST + "named_model") + ")"
        for case in HARD_CASES),
    "wide_universe_dm": sql(*market(60), WINDOWS, snapshots(252), ASOF, AR, VAR, links("hard", HARD_CASES),
                            graph_ols("hard", "hard_links"), CORR_LINKS, graph_ols("cg", "cg_links"),
                            """everything AS (SELECT * FROM ar UNION ALL SELECT * FROM var UNION ALL SELECT * FROM hard UNION ALL SELECT * FROM cg)""",
                            dm("everything", [("GraphVAR-news-hard", "AR"), ("GraphVAR-news-hard", "GraphVAR-sector-hard"),
                                              ("GraphVAR-news-hard", "CorrGraphVAR-hard"), ("VAR", "AR")]),
                            f"SELECT model_a, model_b, days, {rd('dm')} AS dm, {rd('p')} AS p_value, verdict FROM dm"),
    "wide_universe_table": sql(*market(60), WINDOWS, snapshots(252), ASOF, AR, VAR, links("hard", HARD_CASES),
                               graph_ols("hard", "hard_links"), CORR_LINKS, graph_ols("cg", "cg_links"),
                               "everything AS (SELECT * FROM ar UNION ALL SELECT * FROM var UNION ALL SELECT * FROM hard UNION ALL SELECT * FROM cg)",
                               stat_metrics("everything"), pnl("everything"), MOMENTS, ECON, METRIC_OUT.format(STAT_OUT)),
    "comparison_returns_h5": experiment(DAY_RETURNS, 5, 201, 50.4),
    "comparison_returns_h21": experiment(DAY_RETURNS, 21, 60, 12.0),
    "comparison_volume_h5": experiment(DAY_VOLUME, 5, 201, 50.4),
    "graph_vs_ar_layer": sql(
        *GRAPH_MARKET, AR, links("hard", {x: f"('{x}')" for x in LAYER_OF_CODE[:4]}), graph_ols("hard", "hard_links"), f"""live AS (SELECT DISTINCT layer, snap_date, src, dst FROM snaps_all
  WHERE layer IN {NEWS_LAYERS} AND {INSIDE} AND snap_date IN (SELECT snap_date FROM force)),
covered AS (SELECT DISTINCT layer, firm FROM (SELECT layer, src AS firm FROM live UNION ALL SELECT layer, dst FROM live)),
wide_enough AS (SELECT layer, count(*) AS n_firms FROM covered GROUP BY layer HAVING count(*) >= 3),
density AS (
  SELECT layer, count(*) / (SELECT count(*) FROM force WHERE snap_date IS NOT NULL) AS edges_per_day
  FROM live JOIN force USING (snap_date) GROUP BY layer),
sides AS (
  SELECT h.model AS layer, 'graph' AS model, t, h.firm, x, pred FROM hard h JOIN covered c ON c.layer = h.model AND c.firm = h.firm
  UNION ALL SELECT c.layer, 'AR', t, firm, x, pred FROM ar JOIN covered c USING (firm))""",
        stat_metrics("sides", "layer, model"), dm("sides", [("graph", "AR")], "layer", "graph better", "AR better"),
        f"""SELECT layer, n_firms, {rd('edges_per_day')} AS edges_per_day, {rd('g.oos_r2')} AS graph_r2, {rd('g.dir_acc')} AS graph_dir_acc,
  {rd('a.oos_r2')} AS ar_r2, {rd('a.dir_acc')} AS ar_dir_acc, {rd('dm')} AS dm, {rd('p')} AS p_value, verdict
FROM wide_enough JOIN density USING (layer) JOIN stat g USING (layer) JOIN stat a USING (layer) JOIN dm USING (layer)
WHERE g.model = 'graph' AND a.model = 'AR'"""),
    "news_filter": sql(*TEXT, NEWS_ROWS, 'SELECT * FROM kept'),
    "article_table": sql(*TEXT, NEWS_ROWS, ARTICLES, """SELECT article_id, date, title, publisher, array_to_string(tags, ',') AS tickers,
  CAST(len(tags) AS INT) AS n_tickers FROM articles"""),
    "junk_flag": f"SELECT doc_id, {junk('text')} AS junk FROM documents",
    "classify": sql(*TEXT, NEWS_ROWS, ARTICLES, f"""SELECT article_id, {junk('title')} AS junk, {relation('title')} AS relation FROM articles
UNION ALL SELECT 'doc/' || doc_id, {junk('text')}, {relation('text')} FROM documents"""),
    "name_variants": sql(NAMED, "universe AS (SELECT s_suppkey AS firm, s_suppkey AS pos FROM supplier)", DICT, """SELECT DISTINCT 'long' AS kind, name, firm FROM longs
UNION ALL SELECT 'short', form, firm FROM forms WHERE length(form) BETWEEN 2 AND 3"""),
    "mentions_pairs": sql(*UNI, PAIRS, HEAD, DICT, MENTIONS, "SELECT article_id, start, stop, firm FROM hits"),
    "edges_rules": sql(*UNI, PAIRS, HEAD, RULES, "SELECT * FROM rule_edges"),
    "relation_counts": sql(*UNI, PAIRS, HEAD, RULES, "SELECT relation, count(*) AS n FROM rule_edges GROUP BY relation"),
    "candidate_headlines": sql(*UNI, PAIRS, HEAD, NEWS_ROWS, ARTICLES, DICT, """SELECT article_id, date, title, CAST(len(tags) AS INT) AS n_tickers FROM articles
WHERE len(list_intersect(tags, (SELECT list(firm) FROM universe))) >= 2
  AND EXISTS (SELECT 1 FROM dict WHERE contains(title, dict.nm))"""),
    "resolve_names": sql(*UNI, NAMED, DICT, """written AS (
  SELECT unnest(['The ' || nm || ', Inc.', nm || ' Europe', 'New ' || nm || ' Holdings', lower(nm), nm || 'x']) AS name FROM named)""", RESOLVED,
        "SELECT name, firm FROM resolved"),
    "model_edges": sql(PAIRS, HEAD, MODEL, "SELECT * FROM model_edges"),
    "resolve_edges": sql(*UNI, PAIRS, HEAD, MODEL, """ends_ AS (
  SELECT m.article_id, m.firm_a, m.firm_b, m.relation, ua.firm AS ticker_a, ub.firm AS ticker_b FROM model_edges m
  JOIN heads h USING (article_id) LEFT JOIN universe ua ON ua.firm = h.firm_a LEFT JOIN universe ub ON ub.firm = h.firm_b)""",
        "SELECT *, CAST(ticker_a IS NOT NULL AS INT) + CAST(ticker_b IS NOT NULL AS INT) AS n_universe FROM ends_"),
    "universe_edge_counts": sql(*UNI, PAIRS, HEAD, """SELECT CAST(firm_a IN (SELECT firm FROM universe) AS INT)
  + CAST(firm_b IN (SELECT firm FROM universe) AS INT) AS n_universe, count(*) AS n FROM heads WHERE code <> 4 GROUP BY 1"""),
    "cache_key_diff": sql(PAIRS, HEAD, """SELECT DISTINCT left(sha1(title), 16) AS key, title FROM heads WHERE ts >= TIMESTAMP '1998-06-01'
  AND left(sha1(title), 16) NOT IN (SELECT left(sha1(title), 16) FROM heads WHERE ts < TIMESTAMP '1998-06-01')"""),
    "label_parse": sql(PAIRS, HEAD, "SELECT article_id, label, label <> 'none' AS has_relation, CASE WHEN label <> 'none' THEN split_part(label, ':', 1) END AS true_type FROM heads"),
    "score_extraction": sql(*UNI, PAIRS, HEAD, RULES, MODEL, PREDICTIONS, """scored AS (
  SELECT 'rules' AS extractor, panel, truth IS NOT NULL AS has, truth AS true_type, relation AS predicted FROM heads LEFT JOIN rules_pred USING (article_id)
  UNION ALL SELECT 'model', panel, truth IS NOT NULL, truth, relation FROM heads LEFT JOIN model_pred USING (article_id))""", score_select("scored")),
    "extractor_disagreement": sql(*UNI, PAIRS, HEAD, RULES, MODEL, PREDICTIONS, """SELECT coalesce(r.article_id, m.article_id) AS article_id,
  r.relation AS rules, m.relation AS model FROM rules_pred r FULL JOIN model_pred m USING (article_id) WHERE (r.relation IS NULL) <> (m.relation IS NULL)"""),
    "label_rule_scores": sql(f"""scored AS (
  SELECT 'rules' AS extractor, source AS panel, quality = 1 AS has, 'clean' AS true_type,
         CASE WHEN NOT {junk('text')} THEN 'clean' END AS predicted FROM documents JOIN labels USING (doc_id))""", score_select("scored")),
}
