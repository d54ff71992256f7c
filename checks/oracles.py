"""DuckDB SQL giving the same result as each registered query.

Built from shared CTEs; recursions are folded over lists instead of using the
closed forms of the Spark side.
"""

from __future__ import annotations

from barweave import params

AS_OF = "TIMESTAMP '2001-11-05 04:30:00'"
EVENTS_END = "TIMESTAMP '2024-01-31 00:00:00'"


def r(x: str, name: str | None = None) -> str:
    s = f"floor(({x}) * 1000000.0 + 0.5) / 1000000.0"
    return f"{s} AS {name}" if name else s


def rs(*names: str) -> str:
    return ", ".join(r(n, n) for n in names)


def ts(x: str, name: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def big(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


def div(a: str, b: str) -> str:
    """a / b with NULL for a zero or missing divisor."""
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def clamp(x: str, lo: str = "-1.0", hi: str = "1.0") -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN isfinite({x}) THEN greatest({lo}, least({hi}, {x})) ELSE 0.0 END)"


def ist(x: str) -> str:
    return f"({x} + INTERVAL 330 MINUTE)"


def joined(*parts: str, sep: str = "|") -> str:
    """Join the non-NULL texts; '' when all are NULL."""
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda v: v IS NOT NULL), '{sep}')"


def fmt(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {x})"


def high_vol(x: str) -> str:
    m = f"(hour({ist(x)}) * 60 + minute({ist(x)}))"
    return f"({m} BETWEEN 570 AND 630 OR {m} BETWEEN 870 AND 930)"


def session_factor(x: str) -> str:
    return f"1.18 * (CASE WHEN {high_vol(x)} THEN 1.2 WHEN hour({ist(x)}) BETWEEN 12 AND 13 THEN 0.8 ELSE 1.0 END)"


# --- base tables -------------------------------------------------------------------------------

TRADES = """trades AS (
  SELECT 'S' || l_suppkey AS symbol, l_shipdate AS ts,
         CAST(l_orderkey AS HUGEINT) * 10000000000000 + l_linenumber * CAST(1000000000000 AS HUGEINT) + l_partkey AS seq,
         l_extendedprice / l_quantity AS ltp, CAST(l_quantity AS BIGINT) AS ltq,
         CAST(l_linenumber AS BIGINT) * 10 AS bid_size, l_partkey % 90 + 10 AS ask_size, l_linestatus AS side
  FROM lineitem)"""

BARS = TRADES + """, bars AS (
  SELECT symbol, date_trunc('day', ts) AS ts, arg_min(ltp, seq) AS open, max(ltp) AS high, min(ltp) AS low,
         arg_max(ltp, seq) AS close, CAST(sum(ltq) AS BIGINT) AS volume
  FROM trades GROUP BY 1, 2)"""

_NUM = "CAST(substr(symbol, 2) AS BIGINT)"

CALM = BARS + """, src AS (
  SELECT symbol, ts, 1000.0 + open / 47.0 AS open, 1000.0 + high / 47.0 AS high, 1000.0 + low / 47.0 AS low,
         1000.0 + close / 47.0 AS close, volume FROM bars)"""

_DAYS = "date_diff('day', DATE '1995-01-01', CAST(ts AS DATE))"
_BASE = f"8000.0 + {_DAYS} * ((CASE WHEN {_NUM} % 2 = 0 THEN 1.0 ELSE -1.0 END) * ({_NUM} % 7 + 1) / 4.0)"
TREND = BARS + f""", src AS (
  SELECT symbol, ts, {_BASE} + open / 470.0 AS open, {_BASE} + high / 470.0 AS high, {_BASE} + low / 470.0 AS low,
         {_BASE} + close / 470.0 AS close, volume * (1 + greatest(0, {_DAYS} % 300 - 30)) AS volume FROM bars)"""

TICKS = """ticks AS (
  SELECT 'U' || user_id AS symbol, ts, event_id AS seq, value AS ltp,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS ltq, event_type
  FROM events WHERE value > 0)"""

MINUTES = TICKS + """, minutes AS (
  SELECT symbol, date_trunc('minute', ts) AS ts, arg_min(ltp, (ts, seq)) AS open, max(ltp) AS high, min(ltp) AS low,
         arg_max(ltp, (ts, seq)) AS close, CAST(sum(ltq) AS BIGINT) AS volume, count(*) AS tick_count,
         min(ticks.ts) AS first_tick_time, max(ticks.ts) AS last_tick_time
  FROM ticks GROUP BY 1, date_trunc('minute', ts))"""


def recent(base: str, n: int = 250) -> str:
    """Last n rows of ``src`` with rank, row count, index and lagged values."""
    return base + f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM src),
rec AS (
  SELECT *, n_rows - rn AS i,
    lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(volume) OVER w AS pv
  FROM (SELECT *, max(rn) OVER (PARTITION BY symbol) AS n_rows FROM ranked WHERE rn <= {n})
  WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
r0 AS (
  SELECT *, close / pc - 1 AS ret, greatest(close - pc, 0.0) AS gain0, greatest(pc - close, 0.0) AS loss0,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
  FROM rec)"""


def rows(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RUN = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def ema(x: str, n: int) -> str:
    a = 2.0 / (n + 1)
    return f"list_reduce(list({x}) OVER {RUN}, lambda acc, v: acc + {a!r} * (v - acc))"


def series(base: str, n: int = 250) -> str:
    """Indicator series of the recent rows as ``ser``."""
    d = 1 - 1 / 14
    return recent(base, n) + f""", s1 AS (
  SELECT *, coalesce(gain0, 0.0) AS gain, coalesce(loss0, 0.0) AS loss,
    avg(close) OVER {rows(5)} AS sma_5, avg(close) OVER {rows(10)} AS sma_10, avg(close) OVER {rows(20)} AS sma_20,
    avg(close) OVER {rows(50)} AS sma_50,
    {ema('close', 5)} AS ema_5, {ema('close', 10)} AS ema_10, {ema('close', 20)} AS ema_20,
    {ema('close', 12)} - {ema('close', 26)} AS macd,
    CASE WHEN i >= 19 THEN stddev_samp(close) OVER {rows(20)} END AS sd_20,
    CASE WHEN i >= 13 THEN avg(tr) OVER {rows(14)} END AS atr,
    avg(volume) OVER {rows(20)} AS volume_sma_20,
    CASE WHEN high - ph < 0 THEN 0.0 ELSE high - ph END AS up, CASE WHEN low - pl > 0 THEN 0.0 ELSE low - pl END AS down,
    {div('volume', 'pv')} * 100 - 100 AS volume_roc_raw,
    sum(CASE WHEN i = 0 THEN volume WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER {RUN} AS obv,
    sum((high + low + close) / 3 * volume) OVER {RUN} / nullif(sum(volume) OVER {RUN}, 0) AS vwap
  FROM r0),
s2 AS (
  SELECT *,
    CASE WHEN i >= 13 THEN avg(gain) OVER {rows(14)} END AS ag, CASE WHEN i >= 13 THEN avg(loss) OVER {rows(14)} END AS al,
    sum(up * pow({d!r}, -i)) OVER {RUN} / nullif(sum(CASE WHEN up IS NOT NULL THEN pow({d!r}, -i) END) OVER {RUN}, 0) AS pdm,
    sum(down * pow({d!r}, -i)) OVER {RUN} / nullif(sum(CASE WHEN down IS NOT NULL THEN pow({d!r}, -i) END) OVER {RUN}, 0) AS mdm,
    {ema('macd', 9)} AS macd_signal,
    ({div('volume', 'pv')} - 1) * 100 AS volume_roc,
    {div('volume', 'volume_sma_20')} AS volume_ratio
  FROM s1),
s3 AS (
  SELECT *, 100 * {div('ag', 'ag + al')} AS rsi, macd - macd_signal AS macd_hist,
    sma_20 + 2 * sd_20 AS bb_upper, sma_20 AS bb_middle, sma_20 - 2 * sd_20 AS bb_lower,
    {div("abs(100 * " + div('pdm', 'atr') + " - abs(100 * " + div('mdm', 'atr') + "))",
         "abs(100 * " + div('pdm', 'atr') + " + abs(100 * " + div('mdm', 'atr') + "))")} * 100 AS dx
  FROM s2),
s4 AS (SELECT *, (lag(dx) OVER (PARTITION BY symbol ORDER BY ts) * 13 + dx) / 14 AS sdx FROM s3),
ser AS (
  SELECT *, sum(sdx * pow({d!r}, -i)) OVER {RUN}
     / nullif(sum(CASE WHEN sdx IS NOT NULL THEN pow({d!r}, -i) END) OVER {RUN}, 0) AS adx
  FROM s4)"""


def series_query(*columns: str, n: int = 250) -> str:
    return f"WITH {series(CALM, n)} SELECT symbol, {ts('ts', 'ts')}, {rs(*columns)} FROM ser"


_LEVEL = """CASE WHEN max(n_rows) >= 252 AND count({x}) >= 201.6 THEN quantile_cont({x}, {p}) ELSE {f} END"""


def latest(base: str, n: int = 250) -> str:
    """One row per symbol, ``ind``: newest indicators, swing points, adaptive levels, regime."""
    newest = ["ts", "open", "high", "low", "close", "volume", "sma_5", "sma_10", "sma_20", "sma_50", "ema_5",
              "ema_10", "ema_20", "rsi", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_middle", "bb_lower",
              "atr", "adx", "volume_sma_20", "volume_roc", "obv", "vwap", "volume_ratio"]
    picks = ", ".join(f"max(CASE WHEN rn = 1 THEN {c} END) AS {c}" for c in newest)
    levels = ", ".join(
        f"{_LEVEL.format(x=x, p=p, f=f)} AS {nm}"
        for nm, x, p, f in (("rsi_oversold", "rsi", 0.1, "30.0"), ("rsi_overbought", "rsi", 0.9, "70.0"),
                            ("volume_high", "volume_ratio", 0.9, "1.5"), ("volume_low", "volume_ratio", 0.1, "0.5")))
    return series(base, n) + f""", ind0 AS (
  SELECT symbol, max(n_rows) AS n_rows, {picks}, {levels},
    CASE WHEN max(n_rows) >= 15 THEN max(CASE WHEN rn BETWEEN 6 AND 15 THEN high END) END AS swing_high,
    CASE WHEN max(n_rows) >= 15 THEN min(CASE WHEN rn BETWEEN 6 AND 15 THEN low END) END AS swing_low
  FROM ser GROUP BY symbol),
ind AS (
  SELECT *, CASE WHEN adx > 25 THEN 'TRENDING' WHEN adx < 20 THEN 'RANGING' WHEN adx IS NULL THEN 'UNKNOWN' ELSE 'WEAK' END AS market_regime
  FROM ind0)"""


LATEST_COLS = ("open", "high", "low", "close", "sma_5", "sma_10", "sma_20", "sma_50", "ema_5", "ema_10", "ema_20", "rsi",
               "macd", "macd_signal", "macd_hist", "bb_upper", "bb_middle", "bb_lower", "atr", "adx", "volume_sma_20",
               "volume_roc", "vwap", "volume_ratio", "rsi_oversold", "rsi_overbought", "volume_high", "volume_low",
               "swing_high", "swing_low")

# --- classic ("wilder") indicators: folds over lists ---------------------------------------------


def wilder_ema(x: str, n: int, start: int, seed_from: int, alpha: float) -> str:
    """Fold of rows start+1.. over the mean of rows seed_from..start."""
    lst = f"(list({x}) OVER {RUN})"
    return f"""CASE WHEN i >= {start} THEN list_reduce(
      list_concat([list_avg(list_slice({lst}, {seed_from + 1}, {start + 1}))], list_slice({lst}, {start + 2}, i + 1)),
      lambda acc, v: acc + {alpha!r} * (v - acc)) END"""


def wilder(n: int = 250) -> str:
    """Series ``wil`` of the classic definitions."""
    def wsum(x: str) -> str:
        lst = f"(list({x}) OVER {RUN})"
        return f"""CASE WHEN i >= 14 THEN list_reduce(
          list_concat([list_sum(list_slice({lst}, 2, 14))], list_slice({lst}, 15, i + 1)),
          lambda acc, v: acc - acc / 14 + v) END"""

    return recent(CALM, n) + f""", w0 AS (
  SELECT *, coalesce(gain0, 0.0) AS gain, coalesce(loss0, 0.0) AS loss,
    CASE WHEN high - ph > 0 AND high - ph > pl - low THEN high - ph ELSE 0.0 END AS up,
    CASE WHEN pl - low > 0 AND pl - low > high - ph THEN pl - low ELSE 0.0 END AS down FROM r0),
w1 AS (
  SELECT *, CASE WHEN i >= 19 THEN avg(close) OVER {rows(20)} END AS sma_20,
    CASE WHEN i >= 19 THEN stddev_pop(close) OVER {rows(20)} END AS sd,
    {wilder_ema('close', 20, 19, 0, 2 / 21)} AS ema_20,
    {wilder_ema('close', 12, 25, 14, 2 / 13)} - {wilder_ema('close', 26, 25, 0, 2 / 27)} AS macd_line,
    {wilder_ema('gain', 14, 14, 1, 1 / 14)} AS ag, {wilder_ema('loss', 14, 14, 1, 1 / 14)} AS al,
    {wilder_ema('tr', 14, 14, 1, 1 / 14)} AS atr,
    {wsum('up')} AS p, {wsum('down')} AS m
  FROM w0),
w2 AS (
  SELECT *, sma_20 + 2 * sd AS bb_upper, sma_20 - 2 * sd AS bb_lower, 100 * {div('ag', 'ag + al')} AS rsi,
    CASE WHEN i >= 14 THEN coalesce(100 * {div('abs(p - m)', 'p + m')}, 0.0) END AS dx FROM w1),
wil AS (
  SELECT symbol, ts, rn, high, close, sma_20, ema_20, bb_upper, bb_lower, rsi, atr,
    CASE WHEN i >= 33 THEN macd_line END AS macd,
    {wilder_ema('macd_line', 9, 33, 25, 0.2)} AS macd_signal,
    {wilder_ema('dx', 14, 27, 14, 1 / 14)} AS adx FROM w2)"""


def wilder_query(*columns: str, n: int = 250) -> str:
    return f"WITH {wilder(n)} SELECT symbol, {ts('ts', 'ts')}, {rs(*columns)} FROM wil"


REGIME = "CASE WHEN adx > 25 THEN 'TRENDING' WHEN adx < 20 THEN 'RANGING' WHEN adx IS NULL THEN 'UNKNOWN' ELSE 'WEAK' END AS market_regime"


def wilder_latest(*columns: str) -> str:
    return f"WITH {wilder()} SELECT symbol, {ts('ts', 'ts')}, {rs(*columns)}, {REGIME} FROM wil WHERE rn = 1"


def record_query(with_sql: str, source: str) -> str:
    fields = {"close": "current_price", "high": "high", "sma_20": "sma_20", "ema_20": "ema_20", "rsi": "rsi", "macd": "macd",
              "macd_signal": "signal", "bb_upper": "upper", "bb_lower": "lower", "atr": "atr", "adx": "adx"}
    return f"WITH {with_sql} SELECT symbol, {ts('ts', 'timestamp')}, {', '.join(r(x, name) for x, name in fields.items())}, {REGIME} FROM {source}"


# --- quant ---------------------------------------------------------------------------------------


def cdf(x: str) -> str:
    z = f"(abs({x}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {z}))"
    poly = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))))"
    e = f"(1.0 - {poly} * exp(-{z} * {z}))"
    return f"(CASE WHEN {x} >= 0 THEN 0.5 * (1.0 + {e}) ELSE 0.5 * (1.0 - {e}) END)"


def quant(base: str = CALM) -> str:
    """All quant scores, one row per symbol, as ``q``."""
    zs = ", ".join(
        f"{div(f'close - (CASE WHEN i >= {p - 1} THEN avg(close) OVER {rows(p)} END)', f'CASE WHEN i >= {p - 1} THEN stddev_samp(close) OVER {rows(p)} END')} AS z_{p}"
        for p in (5, 10, 20))
    lasts = ", ".join(f"last_value({c}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS {c}_last"
                      for c in ("z_5", "z_10", "z_20", "vol"))

    def rank(c: str) -> str:
        lo, hi = f"count(*) FILTER ({c} < {c}_last)", f"count(*) FILTER ({c} <= {c}_last)"
        return f"({lo} + {hi} + CASE WHEN {hi} > {lo} THEN 1 ELSE 0 END) / nullif(2.0 * count({c}), 0)"

    moms = ", ".join(f"max(CASE WHEN rn = {t + 1} THEN close END) AS c_{t}, stddev_samp(ret) FILTER (rn <= {t}) AS sd_{t}"
                     for t in (3, 7, 14, 21))
    vols = ", ".join(f"avg(volume) FILTER (rn <= {p}) AS vm_{p}" for p in (5, 10, 20))
    sql = recent(base) + f""", q0 AS (
  SELECT *, {zs}, CASE WHEN i >= 20 THEN stddev_samp(ret) OVER {rows(20)} END * sqrt(252.0) AS vol,
    CASE WHEN i >= 20 THEN avg(ret) OVER {rows(20)} END AS market,
    max(CASE WHEN i >= 1 THEN close END) OVER {RUN} AS peak, lag(ret) OVER w AS pret,
    CASE WHEN rn BETWEEN 3 AND 48 AND high > ph AND high > lag(high, 2) OVER w AND high > lead(high) OVER w AND high > lead(high, 2) OVER w THEN high END AS top,
    CASE WHEN rn BETWEEN 3 AND 48 AND low < pl AND low < lag(low, 2) OVER w AND low < lead(low) OVER w AND low < lead(low, 2) OVER w THEN low END AS dip
  FROM r0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
q1 AS (SELECT *, {lasts} FROM q0),
q2 AS (
  SELECT symbol, max(n_rows) AS n, max(CASE WHEN rn = 1 THEN close END) AS c, max(CASE WHEN rn = 1 THEN volume END) AS v,
    max(CASE WHEN rn = 1 THEN ret END) AS lr, {moms}, {vols},
    max(CASE WHEN rn = 1 THEN z_5 END) AS z_5, max(CASE WHEN rn = 1 THEN z_10 END) AS z_10, max(CASE WHEN rn = 1 THEN z_20 END) AS z_20,
    count(z_5) AS zn_5, count(z_10) AS zn_10, count(z_20) AS zn_20,
    {rank('z_5')} AS z_pct_5, {rank('z_10')} AS z_pct_10, {rank('z_20')} AS z_pct_20, {rank('vol')} AS vp,
    count(vol) AS vol_n, stddev_samp(ret) FILTER (rn <= 20) * sqrt(252.0) AS current_vol,
    corr(ret * ret, pret * pret) FILTER (rn <= 9) AS vol_clustering,
    list(top) FILTER (top IS NOT NULL) AS tops, list(dip) FILTER (dip IS NOT NULL) AS dips,
    max(high) FILTER (rn <= 50) AS rh, min(low) FILTER (rn <= 50) AS rl, max(high) AS ah, min(low) AS al,
    quantile_cont(ret, 0.05) FILTER (rn <= 30) AS var30, stddev_samp(ret) FILTER (rn <= 20) AS rsd20,
    avg(tr) FILTER (rn <= 14) AS atr14, quantile_cont(low, 0.2) FILTER (rn <= 20) AS lp20,
    avg(ret) AS rm, stddev_samp(ret) AS rsd, min(close / peak - 1) FILTER (i >= 1) AS mdd, quantile_cont(ret, 0.05) AS rvar,
    stddev_samp(ret) FILTER (ret < 0) AS lsd, count(*) FILTER (ret < 0) AS ln, count(market) AS mn,
    covar_samp(ret, market) AS mc, var_pop(market) AS mv, avg(market) AS mm
  FROM q1 GROUP BY symbol)"""
    for t in (3, 7, 14, 21):
        pass
    sql += ", q3 AS (SELECT *, " + ", ".join(f"c / c_{t} - 1 AS mom_ret_{t}, {div(f'c / c_{t} - 1', f'sd_{t}')} * sqrt({t}.0) AS mom_t_{t}" for t in (3, 7, 14, 21))
    sql += f""", coalesce(list_min(list_filter(tops, lambda x: x > c)), rh) AS res0,
      coalesce(list_max(list_filter(dips, lambda x: x < c)), rl) AS sup0 FROM q2)"""
    sql += ", q4 AS (SELECT *, " + ", ".join(f"2 * (1 - {cdf(f'abs(mom_t_{t})')}) AS mom_p_{t}" for t in (3, 7, 14, 21))
    sql += """, CASE WHEN n >= 50 THEN res0 ELSE ah END AS resistance, CASE WHEN n >= 50 THEN sup0 ELSE al END AS support FROM q3)"""
    used = {t: f"(n >= 26 AND sd_{t} > 0)" for t in (3, 7, 14, 21)}
    w = {t: f"(CASE WHEN {used[t]} THEN greatest(0.0, 1 - mom_p_{t}) / {t}.0 ELSE 0.0 END)" for t in used}
    num = " + ".join(f"(CASE WHEN {used[t]} THEN mom_ret_{t} * {w[t]} ELSE 0.0 END)" for t in used)
    den = " + ".join(w.values())
    nused = " + ".join(f"(CASE WHEN {used[t]} THEN 1 ELSE 0 END)" for t in used)
    psum = " + ".join(f"(CASE WHEN {used[t]} THEN mom_p_{t} ELSE 0.0 END)" for t in used)
    mu = {p: f"(n >= 40 AND n > {2 * p} AND z_{p} IS NOT NULL AND zn_{p} > 20)" for p in (5, 10, 20)}
    prob = {p: f"(CASE WHEN z_pct_{p} > 0.8 THEN (z_pct_{p} - 0.8) / 0.2 WHEN z_pct_{p} < 0.2 THEN (0.2 - z_pct_{p}) / 0.2 ELSE 0.0 END)" for p in mu}
    side = {p: f"(CASE WHEN z_pct_{p} > 0.8 THEN -1.0 WHEN z_pct_{p} < 0.2 THEN 1.0 ELSE 0.0 END)" for p in mu}
    mw = " + ".join(f"(CASE WHEN {mu[p]} THEN 1.0 / {p} ELSE 0.0 END)" for p in mu)
    mp = " + ".join(f"(CASE WHEN {mu[p]} THEN {prob[p]} / {p} ELSE 0.0 END)" for p in mu)
    md = " + ".join(f"(CASE WHEN {mu[p]} THEN {side[p]} / {p} ELSE 0.0 END)" for p in mu)
    vr = {p: f"coalesce({div('v', f'vm_{p}')}, 1.0)" for p in (5, 10, 20)}
    vs = " + ".join(f"(CASE WHEN n >= 20 AND n > {p} THEN (CASE WHEN lr > 0 THEN least(2.0, {vr[p]}) / 2.0 ELSE greatest(0.0, 2.0 - {vr[p]}) / 2.0 END) / {p} ELSE 0.0 END)" for p in vr)
    vw = " + ".join(f"(CASE WHEN n >= 20 AND n > {p} THEN 1.0 / {p} ELSE 0.0 END)" for p in vr)
    sql += f""", q5 AS (SELECT *, coalesce({div(num, den)}, 0.0) AS momentum_score, {div(psum, nused)} AS statistical_significance,
    {nused} AS n_timeframes,
    coalesce({div(mp, mw)}, 0.5) AS reversion_prob, {div(md, mw)} AS expected_direction,
    CASE WHEN n >= 60 AND vol_n >= 10 THEN vp END AS vol_percentile,
    CASE WHEN n >= 50 THEN len(list_filter(tops, lambda x: abs(x - resistance) / c < 0.02)) ELSE 0 END AS rstr,
    CASE WHEN n >= 50 THEN len(list_filter(dips, lambda x: abs(x - support) / c < 0.02)) ELSE 0 END AS sstr,
    CASE WHEN n >= 50 THEN coalesce({div('c - support', 'resistance - support')}, 0.5) END AS range_position,
    CASE WHEN n >= 50 THEN {div('resistance - support', 'c')} END AS range_width_pct,
    coalesce({div(vs, vw)}, 0.5) AS volume_score,
    CASE WHEN n > 20 THEN {div('v', 'vm_20')} ELSE 1.0 END AS current_volume_ratio FROM q4),
q6 AS (SELECT *, coalesce(rstr, 0) AS resistance_strength, coalesce(sstr, 0) AS support_strength,
    CASE WHEN abs(momentum_score) > 0.03 THEN 'STRONG' WHEN abs(momentum_score) > 0.015 THEN 'MODERATE' ELSE 'WEAK' END AS momentum_strength,
    expected_direction IS NOT NULL AND reversion_prob > 0.3 AS current_extreme,
    CASE WHEN vol_percentile > 0.8 THEN 'HIGH_VOL' WHEN vol_percentile < 0.2 THEN 'LOW_VOL' ELSE 'NORMAL' END AS vol_regime,
    CASE WHEN vol_percentile > 0.8 THEN vol_percentile WHEN vol_percentile < 0.2 THEN 1 - vol_percentile ELSE 0.5 END AS vol_score,
    CASE WHEN n >= 60 AND vol_n >= 10 THEN sqrt((0.1 * lr * lr + 0.9 * (current_vol / sqrt(252.0)) * (current_vol / sqrt(252.0))) * 252)
         WHEN n >= 60 THEN current_vol ELSE 0.02 END AS vol_forecast,
    CASE WHEN n < 20 THEN 'NEUTRAL' WHEN volume_score > 0.7 THEN 'STRONG_CONFIRMATION' WHEN volume_score > 0.5 THEN 'WEAK_CONFIRMATION' ELSE 'DIVERGENCE' END AS volume_trend
  FROM q5),
q7 AS (SELECT *, c * (1 + var30) AS stop_var, c * (1 - 2 * rsd20) AS stop_volatility,
    c - atr14 * (CASE vol_regime WHEN 'HIGH_VOL' THEN 3.0 WHEN 'LOW_VOL' THEN 1.5 ELSE 2.0 END) AS stop_atr,
    support AS stop_support, lp20 AS stop_percentile FROM q6),
q8 AS (SELECT *, {{stop}} AS stop_loss FROM q7),
q9 AS (SELECT *, CASE WHEN n >= 30 THEN (c - stop_loss) / c ELSE 0.02 END AS stop_loss_pct,
    CASE WHEN stop_loss < c THEN ((CASE WHEN resistance > c THEN resistance ELSE c * 1.05 END) - c) / (c - stop_loss) ELSE 0.0 END AS risk_reward_ratio FROM q8),
q10 AS (SELECT *, CASE WHEN n >= 50 THEN greatest(0.0, least(1.0, (momentum_score + 0.05) / 0.10)) END AS score_momentum,
    CASE WHEN n >= 50 THEN reversion_prob END AS score_mean_reversion,
    CASE WHEN n >= 50 THEN CASE vol_regime WHEN 'LOW_VOL' THEN 0.8 WHEN 'HIGH_VOL' THEN 0.4 ELSE 0.7 END END AS score_volatility,
    CASE WHEN n >= 50 THEN least(1.0, (support_strength + resistance_strength) / 10.0) * (1 - abs(range_position - 0.5)) END AS score_support_resistance,
    CASE WHEN n >= 50 THEN volume_score END AS score_volume,
    CASE WHEN n >= 50 THEN greatest(0.0, least(1.0, (risk_reward_ratio - 1) / 2)) END AS score_risk_reward FROM q9),
q11 AS (SELECT *, CASE WHEN n >= 50 THEN score_momentum * 0.25 + score_mean_reversion * 0.2 + score_volatility * 0.2
      + score_support_resistance * 0.15 + score_volume * 0.1 + score_risk_reward * 0.1 ELSE 0.4 END AS final_score FROM q10),
q AS (SELECT *, CASE WHEN n < 50 THEN 'INSUFFICIENT_DATA' WHEN final_score >= 0.75 THEN 'STRONG_BUY' WHEN final_score >= 0.6 THEN 'BUY'
      WHEN final_score >= 0.4 THEN 'HOLD' WHEN final_score >= 0.25 THEN 'SELL' ELSE 'STRONG_SELL' END AS recommendation FROM q11)"""
    return sql


def _ensemble() -> str:
    ok = {k: f"(stop_{k} BETWEEN c * 0.85 AND c * 1.02)" for k in params.STOP_WEIGHTS}
    num = " + ".join(f"(CASE WHEN {ok[k]} THEN stop_{k} * {w} ELSE 0.0 END)" for k, w in params.STOP_WEIGHTS.items())
    den = " + ".join(f"(CASE WHEN {ok[k]} THEN {w} ELSE 0.0 END)" for k, w in params.STOP_WEIGHTS.items())
    return f"CASE WHEN n >= 30 THEN least(greatest(coalesce({div(num, den)}, c * 0.95), c * 0.90), c * 0.99) ELSE c * 0.98 END"


def q(select: str, base: str = CALM, stop: str | None = None) -> str:
    return f"WITH {quant(base).replace('{stop}', stop or _ensemble())} SELECT symbol, {select} FROM q"


_SIZE = """least((CASE WHEN stop_loss_pct > 0 THEN 20000.0 / stop_loss_pct ELSE 10000.0 END)
  * (CASE vol_regime WHEN 'LOW_VOL' THEN 1.5 WHEN 'HIGH_VOL' THEN 0.7 ELSE 1.0 END)
  * (CASE momentum_strength WHEN 'STRONG' THEN 1.2 WHEN 'MODERATE' THEN 1.0 ELSE 0.8 END), 100000.0)"""
_POS = f"(CASE WHEN n >= 20 THEN {_SIZE} ELSE 10000.0 END)"
_BUYING = "recommendation IN ('BUY', 'STRONG_BUY')"
_ENTRY = f"(CASE WHEN {_BUYING} THEN CASE WHEN range_position > 0.7 THEN c * 0.99 ELSE c END END)"
_TARGET = f"(CASE WHEN {_BUYING} THEN CASE WHEN resistance > c THEN resistance * 0.98 ELSE c * 1.08 END END)"
_QTY = f"floor({_POS} / {_ENTRY})"

# --- order book ----------------------------------------------------------------------------------

QUOTES = BARS + f""", lv AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY ts DESC, seq DESC) AS lvl FROM trades),
lastbar AS (SELECT symbol, arg_max(close, ts) AS last_close, max(ts) AS ts FROM bars GROUP BY symbol),
levels AS (
  SELECT lv.symbol, side, lvl, ltq AS quantity, seq, last_close, lastbar.ts AS ts,
    last_close * (1 + (CASE WHEN side = 'F' THEN -1 ELSE 1 END) * lvl * (({_NUM.replace('symbol', 'lv.symbol')} % 70 + 1) / 20000.0)) AS price
  FROM lv JOIN lastbar ON lv.symbol = lastbar.symbol WHERE lvl <= 5),
quotes AS (
  SELECT symbol, max(ts) AS ts, max(last_close) * (1 + ({_NUM} % 5 - 2) / 10000.0) AS ltp,
    arg_max(quantity, CASE WHEN lvl = 1 THEN seq END) AS ltq,
    max(CASE WHEN side = 'F' AND lvl = 1 THEN price END) AS best_bid, max(CASE WHEN side = 'O' AND lvl = 1 THEN price END) AS best_ask,
    sum(quantity) FILTER (side = 'F') AS tb, sum(quantity) FILTER (side = 'O') AS ta,
    sum(price * quantity ORDER BY lvl) FILTER (side = 'F') AS bv, sum(price * quantity ORDER BY lvl) FILTER (side = 'O') AS av,
    max(CASE WHEN side = 'F' AND lvl = 1 THEN quantity END) AS b1, max(CASE WHEN side = 'O' AND lvl = 1 THEN quantity END) AS a1,
    count(*) FILTER (side = 'F') AS nb, count(*) FILTER (side = 'O') AS na,
    max(price) FILTER (side = 'F' AND quantity > 0) AS isup, min(price) FILTER (side = 'O' AND quantity > 0) AS ires,
    arg_max(price, (quantity, price)) FILTER (side = 'F' AND quantity > 0) AS ssup,
    arg_max(price, (quantity, -price)) FILTER (side = 'O' AND quantity > 0) AS sres
  FROM levels GROUP BY symbol),
book0 AS (
  SELECT *, best_ask - best_bid AS sp, (best_ask - best_bid) / best_bid * 100 AS spp,
    abs(ltp - best_bid) AS bd, abs(ltp - best_ask) AS ad,
    nb > 0 AND na > 0 AS deep, coalesce({div('tb', 'tb + ta')} * 100, 50.0) AS bp, coalesce({div('ta', 'tb + ta')} * 100, 50.0) AS ap
  FROM quotes),
snap AS (
  SELECT *, lag(ltp) OVER (PARTITION BY symbol ORDER BY ts, seq) AS prev FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rn FROM trades) WHERE rn <= 100),
hist AS (
  SELECT symbol, count(*) AS n, count(*) FILTER (rn <= 50) AS nt,
    count(*) FILTER (rn <= 49 AND ltp > prev) AS up, count(*) FILTER (rn <= 49 AND ltp < prev) AS dn, count(*) FILTER (rn <= 49 AND ltp = prev) AS eq,
    sum(ltp * ltq) FILTER (rn <= 49 AND prev IS NOT NULL) AS fv, sum(ltq) FILTER (rn <= 49 AND prev IS NOT NULL) AS fq,
    sum(ltq) FILTER (rn <= 10) AS rv, avg(ltq) FILTER (rn <= 50) AS avgv, max(CASE WHEN rn = 1 THEN ltp END) AS lp,
    count(*) FILTER (rn <= 9 AND prev IS NOT NULL) AS tn, count(*) FILTER (rn <= 9 AND ltp > prev) AS tu, count(*) FILTER (rn <= 9 AND ltp < prev) AS td,
    coalesce(max(CASE WHEN rn = 1 THEN {div('bid_size', 'ask_size')} END), 0.0) AS bar,
    avg(bid_size) FILTER (rn <= 3 AND bid_size <> 0) AS bn, avg(bid_size) FILTER (rn BETWEEN 4 AND 6 AND bid_size <> 0) AS bb,
    avg(ask_size) FILTER (rn <= 3 AND ask_size <> 0) AS an, avg(ask_size) FILTER (rn BETWEEN 4 AND 6 AND ask_size <> 0) AS ab
  FROM snap GROUP BY symbol),
flow AS (
  SELECT *, CASE WHEN nt >= 2 THEN CASE WHEN up > dn * 1.5 THEN 'BUYING' WHEN dn > up * 1.5 THEN 'SELLING' ELSE 'NEUTRAL' END END AS flow_direction,
    CASE WHEN nt >= 2 THEN coalesce({div('fv', 'fq')}, lp) END AS vwap,
    CASE WHEN nt >= 2 THEN CASE WHEN rv > avgv * 1.5 THEN 'HIGH' WHEN rv < avgv * 0.5 THEN 'LOW' ELSE 'NORMAL' END END AS trade_intensity,
    CASE WHEN n < 5 THEN NULL WHEN tn < 3 THEN 'INSUFFICIENT_DATA' WHEN tu > tn * 0.6 THEN 'STRONG_UP' WHEN tu > tn * 0.4 THEN 'WEAK_UP'
      WHEN td > tn * 0.6 THEN 'STRONG_DOWN' WHEN td > tn * 0.4 THEN 'WEAK_DOWN' ELSE 'SIDEWAYS' END AS micro_trend,
    CASE WHEN n < 5 THEN NULL WHEN n >= 6 AND bn > bb * 1.1 THEN 'INCREASING' WHEN n >= 6 AND bn < bb * 0.9 THEN 'DECREASING' ELSE 'STABLE' END AS bid_size_trend,
    CASE WHEN n < 5 THEN NULL WHEN n >= 6 AND an > ab * 1.1 THEN 'INCREASING' WHEN n >= 6 AND an < ab * 0.9 THEN 'DECREASING' ELSE 'STABLE' END AS ask_size_trend
  FROM hist),
book1 AS (
  SELECT book0.*, flow.* EXCLUDE (symbol, n),
    CASE WHEN spp < 0.1 THEN 'TIGHT' WHEN spp > 0.5 THEN 'WIDE' WHEN spp IS NOT NULL THEN 'NORMAL' END AS spread_class,
    CASE WHEN NOT deep THEN NULL WHEN bp > 60 THEN 'BUY_PRESSURE' WHEN ap > 60 THEN 'SELL_PRESSURE' ELSE 'BALANCED' END AS depth_pressure
  FROM book0 LEFT JOIN flow ON book0.symbol = flow.symbol),
book2 AS (
  SELECT *, CASE depth_pressure WHEN 'BUY_PRESSURE' THEN 'BULLISH' WHEN 'SELL_PRESSURE' THEN 'BEARISH' ELSE 'NEUTRAL' END AS market_sentiment,
    CASE spread_class WHEN 'TIGHT' THEN 'HIGH' WHEN 'WIDE' THEN 'LOW' ELSE 'NORMAL' END AS liquidity_quality FROM book1),
book3 AS (
  SELECT *, CASE WHEN micro_trend IN ('STRONG_UP', 'WEAK_UP') THEN 'UP' WHEN micro_trend IN ('STRONG_DOWN', 'WEAK_DOWN') THEN 'DOWN'
      WHEN flow_direction = 'BUYING' AND market_sentiment = 'BULLISH' THEN 'UP' WHEN flow_direction = 'SELLING' AND market_sentiment = 'BEARISH' THEN 'DOWN'
      ELSE 'SIDEWAYS' END AS short_term_direction FROM book2),
book4 AS (
  SELECT *, CASE WHEN market_sentiment = 'BULLISH' AND short_term_direction = 'UP' AND liquidity_quality <> 'LOW' THEN 'BUY'
      WHEN market_sentiment = 'BEARISH' AND short_term_direction = 'DOWN' AND liquidity_quality <> 'LOW' THEN 'SELL' ELSE 'WAIT' END AS entry_recommendation FROM book3),
book AS (
  SELECT *, least(1.0, 0.5 + (CASE WHEN (flow_direction = 'BUYING' AND market_sentiment = 'BULLISH') OR (flow_direction = 'SELLING' AND market_sentiment = 'BEARISH') THEN 0.2 ELSE 0.0 END)
      + (CASE spread_class WHEN 'TIGHT' THEN 0.1 WHEN 'WIDE' THEN -0.1 ELSE 0.0 END) + (CASE WHEN entry_recommendation <> 'WAIT' THEN 0.2 ELSE 0.0 END)) AS confidence,
    {joined("CASE WHEN depth_pressure = 'BUY_PRESSURE' THEN 'Strong buy depth' END", "CASE WHEN depth_pressure = 'SELL_PRESSURE' THEN 'Strong sell depth' END",
            "CASE WHEN flow_direction = 'BUYING' THEN 'Buying flow detected' END", "CASE WHEN flow_direction = 'SELLING' THEN 'Selling flow detected' END",
            "CASE WHEN spread_class = 'TIGHT' THEN 'Tight spreads' END", "CASE WHEN spread_class = 'WIDE' THEN 'Wide spreads' END",
            "CASE WHEN micro_trend LIKE '%_UP' OR micro_trend LIKE '%_DOWN' THEN 'Micro trend: ' || micro_trend END")} AS key_factors
  FROM book4)"""

# --- trajectory ----------------------------------------------------------------------------------


def fit(y: str, x: str, cond: str) -> str:
    f = f"FILTER ({cond})"
    return (f"(CASE WHEN count({y}) {f} < 2 OR coalesce(var_pop({y}) {f}, 0) = 0 THEN 0.0 ELSE "
            f"least(1.0, greatest(-1.0, pow(corr({y}, {x}) {f}, 2) * (CASE WHEN regr_slope({y}, {x}) {f} > 0 THEN 1.0 ELSE -1.0 END))) END)")


def trajectory(base: str = TREND, n: int = 100, factor: str | None = None, from_cte: str = "r0") -> str:
    """Price trajectory per symbol as ``traj``, over the rows of ``from_cte`` with rank below n."""
    factor = factor or session_factor("t0.ts")
    return f""", t0 AS (
  SELECT symbol, max(ts) AS ts, least(max(n_rows), 100) AS np,
    max(CASE WHEN rn = 1 THEN close END) AS p1, max(CASE WHEN rn = 2 THEN close END) AS p2,
    max(CASE WHEN least(n_rows, 100) - rn = 0 THEN close END) AS f1, max(CASE WHEN least(n_rows, 100) - rn = 1 THEN close END) AS f2,
    avg(abs(close - pc) / pc) FILTER (least(n_rows, 100) - rn BETWEEN 1 AND 9 AND pc > 0) AS gm,
    max(CASE WHEN rn = 5 THEN close END) AS a5, max(CASE WHEN rn = 15 THEN close END) AS a15, max(CASE WHEN rn = 30 THEN close END) AS a30,
    {fit('close', 'i', 'rn <= 5')} AS f5, {fit('close', 'i', 'rn <= 15')} AS f15, {fit('close', 'i', 'rn <= 30')} AS f30
  FROM {from_cte} GROUP BY symbol),
t1 AS (SELECT *, np >= 10 AS ok, f5 * {factor} AS st, f15 AS mt, f30 AS lt FROM t0),
t2 AS (
  SELECT *, list_filter([st, mt, lt], lambda v: v > 0) AS pos, list_filter([st, mt, lt], lambda v: v < 0) AS neg,
    len(list_filter([st, mt, lt], lambda v: v > 0.2)) AS np2, len(list_filter([st, mt, lt], lambda v: v < -0.2)) AS nn2 FROM t1),
t3 AS (SELECT *, CASE WHEN np2 >= 2 THEN list_avg(pos) WHEN nn2 >= 2 THEN abs(list_avg(neg)) ELSE 0.1 END AS cons, st * 0.5 + mt * 0.3 + lt * 0.2 AS av FROM t2),
traj AS (
  SELECT symbol, ts AS tts, np AS n_prices, CASE WHEN ok THEN 'ok' ELSE 'insufficient_data' END AS trajectory_status,
    CASE WHEN ok THEN CASE WHEN np >= 5 THEN p1 / a5 - 1 ELSE 0.0 END * 100 END AS short_change_pct,
    CASE WHEN ok THEN CASE WHEN np >= 15 THEN p1 / a15 - 1 ELSE 0.0 END * 100 END AS medium_change_pct,
    CASE WHEN ok THEN CASE WHEN np >= 30 THEN p1 / a30 - 1 ELSE 0.0 END * 100 END AS long_change_pct,
    CASE WHEN ok THEN st END AS short_trend, CASE WHEN ok THEN mt END AS medium_trend, CASE WHEN ok THEN lt END AS long_trend,
    CASE WHEN ok THEN ((p1 - p2) - (f2 - f1)) / (np - 2) END AS acceleration,
    CASE WHEN ok THEN cons END AS trend_consistency, CASE WHEN ok THEN 1.0 - least(0.3, coalesce(gm, 0.0) * 2) END AS gap_risk_factor,
    CASE WHEN NOT ok THEN NULL WHEN cons > 0.7 AND av > 0.4 THEN 'STRONG_BULLISH' WHEN cons > 0.5 AND av > 0.2 THEN 'BULLISH'
      WHEN cons > 0.7 AND av < -0.4 THEN 'STRONG_BEARISH' WHEN cons > 0.5 AND av < -0.2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS overall_trajectory
  FROM t3)"""


def traj_query(*columns: str) -> str:
    text = [c for c in columns if c in ("overall_trajectory",)]
    nums = [c for c in columns if c not in text]
    cols = ", ".join(text + [r(c, c) for c in nums])
    return f"WITH {recent(TREND, 100)}{trajectory()} SELECT symbol, {cols} FROM traj"


def momentum(from_cte: str = "ser") -> str:
    """Momentum trajectories per symbol as ``mom`` over the rows of a series CTE."""
    kinds = {"rsi": "rsi", "macd": "macd", "sma5": "sma_5", "sma20": "sma_20", "volume": "volume_ratio"}
    pos = ", ".join(f"count(CASE WHEN rn <= 30 THEN {c} END) OVER {RUN} AS x_{k}" for k, c in kinds.items())
    fits = ", ".join(f"count({c}) FILTER (rn <= 30) AS n_{k}, {fit(c, f'x_{k}', f'rn <= 30 AND {c} IS NOT NULL')} AS f_{k}" for k, c in kinds.items())
    return f""", m0 AS (SELECT *, {pos} FROM {from_cte}),
m1 AS (
  SELECT symbol, least(max(n_rows), 30) AS nm, {fits}, arg_min(rsi, rn) FILTER (rsi IS NOT NULL AND rn <= 30) AS lrsi,
    max(CASE WHEN rn = 1 THEN macd - macd_signal END) AS mg, max(CASE WHEN rn = 2 THEN macd - macd_signal END) AS mgb,
    max(CASE WHEN rn = 1 THEN sma_5 - sma_20 END) AS sg, max(CASE WHEN rn = 2 THEN sma_5 - sma_20 END) AS sgb
  FROM m0 GROUP BY symbol),
m2 AS (
  SELECT *, CASE WHEN n_rsi < 3 THEN NULL WHEN f_rsi > 0.2 THEN 'INCREASING' WHEN f_rsi < -0.2 THEN 'DECREASING' ELSE 'SIDEWAYS' END AS rsi_direction,
    CASE WHEN n_rsi >= 3 THEN abs(f_rsi) END AS rsi_strength,
    CASE WHEN n_rsi < 3 THEN NULL WHEN lrsi < 20 THEN 'OVERSOLD' WHEN lrsi > 80 THEN 'OVERBOUGHT' WHEN lrsi BETWEEN 20 AND 30 AND f_rsi > 0 THEN 'OVERSOLD_RECOVERY'
      WHEN lrsi BETWEEN 70 AND 80 AND f_rsi < 0 THEN 'OVERBOUGHT_BREAKDOWN' ELSE 'NORMAL' END AS rsi_level,
    CASE WHEN n_volume < 3 THEN NULL WHEN f_volume > 0.2 THEN 'INCREASING' WHEN f_volume < -0.2 THEN 'DECREASING' ELSE 'SIDEWAYS' END AS volume_direction,
    CASE WHEN n_volume >= 3 THEN abs(f_volume) END AS volume_strength,
    CASE WHEN n_macd < 3 THEN NULL WHEN mgb <= 0 AND mg > 0 THEN 'BULLISH_CROSSOVER_CONFIRMED' WHEN mgb >= 0 AND mg < 0 THEN 'BEARISH_CROSSOVER_CONFIRMED' ELSE 'NEUTRAL' END AS macd_cross,
    CASE WHEN n_macd >= 3 THEN f_macd END AS macd_trend, CASE WHEN n_macd >= 3 THEN mg END AS macd_divergence,
    CASE WHEN n_sma5 < 3 THEN NULL WHEN sgb <= 0 AND sg > 0 THEN 'GOLDEN_CROSS' WHEN sgb >= 0 AND sg < 0 THEN 'DEATH_CROSS' WHEN sg > 0 THEN 'BULLISH_ALIGNMENT' ELSE 'BEARISH_ALIGNMENT' END AS ma_signal,
    CASE WHEN n_sma5 < 3 THEN NULL WHEN sg > 0 THEN 'BULLISH' ELSE 'BEARISH' END AS ma_alignment,
    CASE WHEN n_sma5 >= 3 THEN f_sma5 END AS sma_5_trend, CASE WHEN n_sma5 >= 3 THEN f_sma20 END AS sma_20_trend
  FROM m1),
m3 AS (
  SELECT *, CASE WHEN nm >= 5 THEN greatest(-1.0, least(1.0,
     (CASE rsi_level WHEN 'OVERSOLD_RECOVERY' THEN 0.3 WHEN 'OVERBOUGHT_BREAKDOWN' THEN -0.3 ELSE 0.0 END)
   + (CASE rsi_direction WHEN 'INCREASING' THEN 0.1 * rsi_strength WHEN 'DECREASING' THEN -0.1 * rsi_strength ELSE 0.0 END)
   + (CASE macd_cross WHEN 'BULLISH_CROSSOVER_CONFIRMED' THEN 0.4 WHEN 'BEARISH_CROSSOVER_CONFIRMED' THEN -0.4 ELSE 0.0 END)
   + (CASE WHEN ma_signal = 'GOLDEN_CROSS' THEN 0.3 WHEN ma_signal = 'DEATH_CROSS' THEN -0.3 WHEN ma_alignment = 'BULLISH' THEN 0.1 WHEN ma_alignment = 'BEARISH' THEN -0.1 ELSE 0.0 END)
   + (CASE volume_direction WHEN 'INCREASING' THEN 0.1 * volume_strength ELSE 0.0 END))) END AS composite_momentum FROM m2),
mom AS (SELECT *, CASE WHEN nm < 5 THEN NULL WHEN composite_momentum > 0.3 THEN 'BULLISH' WHEN composite_momentum < -0.3 THEN 'BEARISH' ELSE 'NEUTRAL' END AS momentum_direction,
   abs(composite_momentum) AS momentum_abs FROM m3)"""


_TEXT = {"rsi_direction", "rsi_level", "volume_direction", "macd_cross", "ma_signal", "ma_alignment", "momentum_direction"}


def mom_query(*columns: str) -> str:
    cols = ", ".join(c if c in _TEXT else r(c, c) for c in columns)
    return f"WITH {series(TREND)}{momentum()} SELECT symbol, {cols} FROM mom"
