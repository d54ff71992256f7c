"""Oracle SQL per registered query."""

from __future__ import annotations

from barweave import params
from checks.oracles import (
    AS_OF, BARS, CALM, EVENTS_END, LATEST_COLS, MINUTES, QUOTES, TICKS, TRADES, TREND, _BUYING, _ENTRY, _POS, _QTY,
    _SIZE, _TARGET, big, clamp, div, fmt, high_vol, ist, joined, latest, mom_query, momentum, q, quant, r, recent, rs,
    record_query, series, series_query, session_factor, traj_query, trajectory, ts, wilder, wilder_latest, wilder_query,
    _ensemble, fit,
)

# --- feed ------------------------------------------------------------------------------------

FEED = f"""feed0 AS (
  SELECT event_id AS seq, 'U' || user_id AS instrument_key, event_type, epoch_us(ts) // 1000 AS ms,
    CAST(printf('%.2f', value) AS DOUBLE) AS ltp, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CAST(printf('%.2f', value + 0.5) AS DOUBLE) AS la, CAST(printf('%.2f', value * 0.913717) AS DOUBLE) AS sb, CAST(printf('%.2f', value + 1.5) AS DOUBLE) AS sa
  FROM events),
feed AS (
  SELECT *, CASE WHEN event_type = 'click' THEN make_timestamp((ms // 1000) * 1000000) ELSE make_timestamp(ms * 1000) END AS ts, k AS ltq,
    CASE WHEN event_type = 'error' THEN [{{'bp': sb, 'bq': k * 2, 'ap': sa, 'aq': k}}, {{'bp': 0.0, 'bq': 0, 'ap': 1.25, 'aq': 7}}]
      ELSE [{{'bp': ltp, 'bq': k, 'ap': la, 'aq': k + 5}}, {{'bp': sb, 'bq': k * 2, 'ap': sa, 'aq': k}}, {{'bp': 0.0, 'bq': 0, 'ap': 1.25, 'aq': 7}}] END AS lv
  FROM feed0),
fq AS (
  SELECT *, lv[1].bp AS best_bid, lv[1].ap AS best_ask, lv[1].bq AS bid_size, lv[1].aq AS ask_size,
    CASE WHEN lv[1].bp > 0 AND lv[1].ap > 0 THEN lv[1].ap - lv[1].bp ELSE 0.0 END AS spread,
    CASE WHEN lv[1].bp > 0 AND lv[1].ap > 0 THEN (lv[1].ap - lv[1].bp) / lv[1].bp * 100 ELSE 0.0 END AS spread_pct,
    array_to_string(list_transform(list_filter(lv, lambda v: v.bp <> 0)[1:5], lambda v: printf('%.4f x %d', v.bp, v.bq)), '|') AS bid_levels,
    array_to_string(list_transform(list_filter(lv, lambda v: v.ap <> 0)[1:5], lambda v: printf('%.4f x %d', v.ap, v.aq)), '|') AS ask_levels
  FROM feed),
inst AS (SELECT 'U' || c_custkey AS instrument_key, c_name AS symbol FROM customer WHERE c_mktsegment <> 'BUILDING'),
named AS (SELECT fq.*, coalesce(inst.symbol, fq.instrument_key) AS symbol FROM fq LEFT JOIN inst ON fq.instrument_key = inst.instrument_key),
lastq AS (
  SELECT symbol, instrument_key, max(ts) AS last_update, count(*) AS tick_count, arg_max(ltp, ts) AS ltp, arg_max(ltq, ts) AS ltq,
    arg_max(best_bid, ts) AS best_bid, arg_max(best_ask, ts) AS best_ask, arg_max(bid_size, ts) AS bid_size, arg_max(ask_size, ts) AS ask_size,
    arg_max(spread, ts) AS spread, arg_max(spread_pct, ts) AS spread_pct, arg_max(bid_levels, ts) AS bid_levels, arg_max(ask_levels, ts) AS ask_levels
  FROM named GROUP BY 1, 2)"""

# --- unified signals of the events ---------------------------------------------------------------

_SIDE = "CASE event_type WHEN 'click' THEN 'BUY' WHEN 'error' THEN 'SELL' ELSE 'HOLD' END"


def _comp(name: str, weight: float, present: str, score: str, conf: str, direction: str, narrative: str) -> str:
    return (f"CASE WHEN {present} THEN {{'name': '{name}', 'weight': {weight}, 'score': {score}, "
            f"'confidence': {conf}, 'direction': {direction}, 'narrative': {narrative}}} END")


def _default(name: str, d: str) -> str:
    return f"(CASE {d} WHEN 'HOLD' THEN '{name} neutral' WHEN 'BUY' THEN '{name} skewed bullish' ELSE '{name} skewed bearish' END)"


def _conf(conf: str, score: str) -> str:
    return f"(CASE WHEN {conf} > 0 THEN {conf} ELSE abs({score}) END)"


_QSC = clamp("(ltq / 49.7 - 1.0) * strength")
_QDIR = "(CASE WHEN ltq / 49.7 - 1.0 > 0 THEN 'BUY' WHEN ltq / 49.7 - 1.0 < 0 THEN 'SELL' ELSE 'HOLD' END)"
_TSC = "(CASE WHEN side = 'SELL' THEN -strength ELSE strength END)"

UNIFIED = TICKS + f""", u0 AS (
  SELECT *, {_SIDE} AS side, least(1.0, ltp / 61.7) AS strength FROM ticks),
u1 AS (
  SELECT *, sgn * strength AS psc FROM (SELECT *, CASE side WHEN 'BUY' THEN 1.0 WHEN 'SELL' THEN -1.0 ELSE 0.0 END AS sgn FROM u0)),
u2 AS (
  SELECT *, list_filter([
    {_comp('trajectory', 0.25, 'true', 'psc', _conf('strength', 'psc'), 'side', "'path'")},
    {_comp('quant', 0.2, 'ltq >= 20', _QSC, f'abs({_QSC})', _QDIR, _default('Quant', _QDIR))},
    {_comp('technical', 0.2, 'true', _TSC, 'strength', 'side', _default('Technical', 'side'))},
    {_comp('orderbook', 0.15, "event_type <> 'view'", 'ltq / 101.3', _conf('least(1.0, ltq / 80.9)', 'ltq / 101.3'), "'BUY'", "'book'")},
    {_comp('market_regime', 0.2, 'true', '0.2', '0.2', "'HOLD'", "'Market_Regime neutral'")}
  ], lambda c: c IS NOT NULL) AS components,
  CASE WHEN ltq % 2 = 0 THEN ltq / 49.7 - 1.0 END AS bias FROM u1),
u3 AS (
  SELECT *, list_sum(list_transform(components, lambda c: c.weight)) AS ws,
    list_sum(list_transform(components, lambda c: c.weight * c.score)) AS ss, list_sum(list_transform(components, lambda c: c.weight * c.confidence)) AS cs FROM u2),
u4 AS (SELECT *, greatest(-1.0, least(1.0, ss / ws)) AS score, greatest(0.0, least(1.0, cs / ws * 0.6 + abs(ss / ws) * 0.4)) AS base_confidence FROM u3),
u5 AS (
  SELECT *, greatest(0.0, least(1.0, CASE WHEN coalesce(bias, 0) <> 0 THEN base_confidence * (1 + 0.15 * bias) ELSE base_confidence END)) AS confidence,
    CASE WHEN coalesce(bias, 0) <> 0 THEN 'Daily context (1D) bias ' || printf('%+.2f', bias) || ' adjusted confidence' END AS context_note FROM u4),
u6 AS (
  SELECT *, CASE WHEN confidence < 0.2 THEN 'HOLD' WHEN score >= 0.05 THEN 'BUY' WHEN score <= -0.05 THEN 'SELL' ELSE 'HOLD' END AS raw_direction FROM u5),
u7 AS (
  SELECT *, coalesce(last_value(CASE WHEN raw_direction <> 'HOLD' AND confidence >= 0.6 THEN raw_direction END IGNORE NULLS)
    OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'HOLD') AS committed FROM u6),
u8 AS (
  SELECT *, CASE WHEN raw_direction <> committed AND confidence < 0.6 THEN 'HOLD' ELSE raw_direction END AS direction,
    CASE WHEN raw_direction = 'HOLD' AND confidence < 0.2 THEN 'Confidence dropped below actionable range'
         WHEN raw_direction <> 'HOLD' AND raw_direction <> committed AND confidence < 0.6 THEN 'Direction change gated by persistence rule (<0.60 confidence)' END AS persistence_reason,
    ltp AS entry_price, greatest((CASE WHEN ltq > 10 THEN ltp * 0.02 ELSE ltp * 0.01 END) * 1.5, ltp * 0.003) AS buf FROM u7),
u9 AS (
  SELECT *, entry_price - (CASE direction WHEN 'BUY' THEN buf WHEN 'SELL' THEN -buf ELSE 0.0 END) AS stop_loss,
    entry_price + 2 * (CASE direction WHEN 'BUY' THEN buf WHEN 'SELL' THEN -buf ELSE 0.0 END) AS target_price FROM u8),
u10 AS (SELECT *, abs(entry_price - stop_loss) AS risk_per_unit FROM u9),
sig AS (
  SELECT *, CASE WHEN risk_per_unit > 0 THEN 1000.0 ELSE 0.0 END AS position_size_value, CASE WHEN risk_per_unit > 0 THEN 1000.0 / risk_per_unit ELSE 0.0 END AS position_size_qty,
    CASE WHEN stop_loss > 0 AND target_price > 0 AND entry_price <> stop_loss THEN round((target_price - entry_price) / (entry_price - stop_loss), 2) ELSE 0.0 END AS risk_reward FROM u10)"""


def sig(select: str, tail: str = "") -> str:
    return f"WITH {UNIFIED} SELECT {select} FROM sig {tail}"


LAST_SIG = UNIFIED + """, lastsig AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rk FROM sig) WHERE rk = 1)"""

# --- rule features ---------------------------------------------------------------------------


def pick(x: str, *labels: str) -> str:
    return f"[{', '.join(repr(v) for v in labels)}][{x} % {len(labels)} + 1]"


_SECTOR = "CASE WHEN symbol LIKE 'Infosys%' THEN 'IT' WHEN symbol LIKE 'HDFC Bank%' THEN 'BANKING' WHEN symbol LIKE 'Cipla%' THEN 'PHARMA' ELSE 'OTHER' END"


def bias_of(change: str) -> str:
    h = f"hour({ist('ts')})"
    return (f"CASE sector WHEN 'OTHER' THEN 0.0 ELSE greatest(-1.0, least(1.0, (CASE sector WHEN 'IT' THEN 0.6 WHEN 'PHARMA' THEN 0.4 ELSE 0.0 END) * {change}"
            f" + (CASE WHEN sector = 'IT' AND {h} BETWEEN 20 AND 23 THEN 0.2 WHEN sector = 'BANKING' AND {h} BETWEEN 10 AND 15 THEN 0.1 ELSE 0.0 END))) END")


RULES = TICKS + f""", f0 AS (
  SELECT {pick('seq', 'HDFC Bank ', 'Infosys ', 'Cipla ', 'Fund ')} || symbol AS symbol, ts, seq, ltp + 100 AS close, CAST(ltq AS DOUBLE) AS adx, seq % 120 AS n_rows, ltq AS k,
    CASE event_type WHEN 'click' THEN 'STRONG_BULLISH' WHEN 'view' THEN 'BULLISH' WHEN 'error' THEN 'STRONG_BEARISH' ELSE 'BEARISH' END AS path,
    ltq / 100.0 + 0.2 AS cons, 1.0 - ltq / 400.0 AS gap, (ltq - 50) / 40.0 AS acceleration, CASE WHEN ltq % 3 = 0 THEN 'DOWN' ELSE 'UP' END AS sd,
    {pick('ltq', 'BULLISH', 'BEARISH', 'NEUTRAL')} AS md, (ltq % 10) / 10.0 AS ma,
    {pick('ltq', 'OVERSOLD_RECOVERY', 'OVERBOUGHT_BREAKDOWN', 'NORMAL', 'OVERSOLD')} AS rl,
    {pick('seq', 'BULLISH_CROSSOVER_CONFIRMED', 'BEARISH_CROSSOVER_CONFIRMED', 'NEUTRAL')} AS mc, {pick('seq', 'INCREASING', 'SIDEWAYS')} AS vd,
    {pick('ltq', 'DEATH_CROSS', 'BEARISH_ALIGNMENT', 'BULLISH_ALIGNMENT')} AS msig, {pick('ltq', 'BEARISH', 'BEARISH', 'BULLISH')} AS mal,
    {pick('seq', 'BUY', 'WAIT', 'SELL')} AS adv, ltq / 100.0 AS fs, 1.0 - ltq / 100.0 AS sm, CAST({pick('ltq', '0.4', '0.7', '0.8')} AS DOUBLE) AS sv, ltq / 110.0 AS sr,
    (ltp + 100) * (0.95 + ltq / 300.0) AS resistance, (ltp + 100) * 0.95 AS stop, {pick('ltq', 'STRONG_BUY', 'BUY', 'HOLD', 'SELL', 'STRONG_SELL')} AS rec
  FROM ticks),
f1 AS (SELECT *, {_SECTOR} AS sector, CASE WHEN adx > 25 THEN 'TRENDING' WHEN adx < 20 THEN 'RANGING' ELSE 'UNDEFINED' END AS reg, {high_vol('ts')} AS hv FROM f0),
f2 AS (
  SELECT *, {bias_of('0.5')} AS bias,
    CASE WHEN n_rows >= 50 THEN (CASE WHEN fs > 0.7 THEN 0.15 WHEN fs > 0.6 THEN 0.10 WHEN fs < 0.3 THEN -0.20 ELSE 0.0 END)
      + (CASE WHEN sm > 0.7 THEN 0.05 ELSE 0.0 END) + (CASE WHEN sv > 0.6 THEN 0.05 ELSE 0.0 END) ELSE 0.0 END AS boost,
    CASE WHEN n_rows >= 50 THEN list_filter([CASE WHEN fs > 0.7 THEN 'Strong quantitative score (' || {fmt('fs', 2)} || ')' WHEN fs > 0.6 THEN 'Good quantitative score (' || {fmt('fs', 2)} || ')'
      WHEN fs < 0.3 THEN 'Poor quantitative score (' || {fmt('fs', 2)} || ')' END, CASE WHEN sm > 0.7 THEN 'Strong statistical momentum' END,
      CASE WHEN sv > 0.6 THEN 'Favorable volatility regime' END, CASE WHEN sr > 0.7 THEN 'High mean reversion probability' END], lambda v: v IS NOT NULL) ELSE CAST([] AS VARCHAR[]) END AS qr,
    CASE WHEN resistance > close AND resistance < close * 1.15 THEN resistance * 0.98 ELSE close * (1 + 0.03 + ma * 0.02) END AS tgt,
    {session_factor('ts')} AS fac
  FROM f1)"""

_EV = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def side_rules(side: str) -> str:
    """Accepted rows of one side as SELECT over f2."""
    buy = side == "BUY"
    path = f"(path IN ({chr(39)+'STRONG_BULLISH'+chr(39)+', '+chr(39)+'BULLISH'+chr(39) if buy else chr(39)+'STRONG_BEARISH'+chr(39)+', '+chr(39)+'BEARISH'+chr(39)}) AND cons > 0.6)"
    lvl = "rl = 'OVERSOLD_RECOVERY'" if buy else "rl = 'OVERBOUGHT_BREAKDOWN'"
    word, Word = ("bullish", "Bullish") if buy else ("bearish", "Bearish")
    rsi_text = "RSI recovering from oversold" if buy else "RSI breaking down from overbought"
    items = [
        ("bias > 0.2" if buy else "bias < -0.2", 0.1,
         f"'{'Positive' if buy else 'Negative'} sector bias for ' || sector || ' ({'+' if buy else ''}' || {fmt('bias', 1)} || ')'"),
        (f"reg = 'TRENDING' AND {path}", 0.3, f"'Confirmed {word} trajectory (' || {fmt('cons', 2)} || ') in TRENDING market'"),
        (f"reg = 'RANGING' AND {lvl}", 0.3, f"'{rsi_text} in RANGING market'"),
        (f"reg = 'UNDEFINED' AND {path}", 0.15, f"'{Word} trajectory (' || {fmt('cons', 2)} || ') in UNDEFINED market'"),
        (f"md = '{word.upper()}' AND ma > 0.4", 0.25, f"'Strong {word} momentum (' || {fmt('ma', 2)} || ')'"),
        (lvl, 0.2, f"'{rsi_text}'"),
        (f"mc = '{word.upper()}_CROSSOVER_CONFIRMED'", 0.2, f"'MACD {word} crossover confirmed'"),
        ("vd = 'INCREASING'" if buy else "vd = 'INCREASING' AND sd = 'DOWN'", 0.15,
         "'Increasing volume support'" if buy else "'Increasing volume on decline'"),
        ("hv", 0.05, "'High volatility session timing'" if buy else "'High volatility session - increased selling pressure'"),
        (f"adv = '{side}'", 0.1, f"'Orderbook shows {'buying' if buy else 'selling'} pressure'"),
    ]
    if not buy:
        items += [("msig = 'DEATH_CROSS'", 0.15, "'Moving average death cross'"),
                  ("msig <> 'DEATH_CROSS' AND mal = 'BEARISH'", 0.1, "'Bearish moving average alignment'")]
    pts = " + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0.0 END)" for c, p, _ in items)
    texts = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, _, t in items) + "], lambda v: v IS NOT NULL)"
    if buy:
        pts, texts = f"{pts} + boost", f"list_concat({texts}, qr)"
    confirmed = " OR ".join(f"({c})" for c, _, _ in items[1:4])
    target = "tgt" if buy else "close * (1 - (0.03 + ma * 0.02 * fac))"
    stop = "stop" if buy else "close * (1 + 0.015 * fac)"
    rr = f"(({target}) - close) / (close - ({stop}))" if buy else f"(close - ({target})) / (({stop}) - close)"
    early = "acceleration > 0.5" if buy else "acceleration < -0.5"
    blocked = "bias < -0.2" if buy else "bias > 0.2"
    return f"""SELECT *, CASE WHEN confidence > 0.85 THEN 'VERY_STRONG' WHEN confidence > 0.75 THEN 'STRONG' WHEN confidence > 0.65 THEN 'MODERATE' ELSE 'WEAK' END AS strength
  FROM (SELECT symbol, seq, '{side}' AS signal_type, ts AS signal_ts, round({pts}, 9) AS confidence, close AS entry_price, {target} AS target_price, {stop} AS stop_loss,
    CASE WHEN {early} THEN 'SHORT' WHEN ma > 0.6 THEN 'MEDIUM' ELSE 'LONG' END AS time_horizon, {texts} AS reasons, {rr} AS risk_reward_ratio, reg AS market_regime,
    sector AS sector_bias, gap AS gap_risk_factor, {0.7 if buy else 0.6} AS signal_quality_score, ({confirmed}) AS confirmed, reg
    FROM f2 WHERE NOT ({blocked})) WHERE confirmed AND confidence >= (CASE WHEN reg = 'RANGING' THEN 0.60 ELSE 0.65 END) AND len(reasons) >= 3"""


def rule_query(side: str) -> str:
    return f"""WITH {RULES}, a AS ({side_rules(side)})
SELECT symbol, {ts('signal_ts', 'signal_ts')}, strength, {rs('confidence', 'entry_price', 'target_price', 'stop_loss', 'risk_reward_ratio', 'gap_risk_factor', 'signal_quality_score')},
  time_horizon, array_to_string(reasons, '|') AS reasons, market_regime, sector_bias FROM a"""


BOTH = f"{RULES}, acts AS ({side_rules('BUY')} UNION ALL {side_rules('SELL')})"
_RANK = "CASE strength WHEN 'VERY_STRONG' THEN 4 WHEN 'STRONG' THEN 3 WHEN 'MODERATE' THEN 2 ELSE 1 END"

# --- actionable signals of the trending bars -------------------------------------------------------


def flow_rules(with_book: bool) -> str:
    """The rule features of the real flow, in the columns that ``side_rules`` reads, as f2."""
    factor = session_factor(AS_OF)
    sql = quant(TREND).replace("{stop}", _ensemble())
    tail = series(TREND)[len(recent(TREND)):] + momentum() + trajectory(TREND, factor=factor)
    if with_book:
        tail += ", " + QUOTES[len(BARS) + 2:]
    advice = "book.entry_recommendation" if with_book else "CAST(NULL AS VARCHAR)"
    join = "LEFT JOIN book ON book.symbol = q.symbol" if with_book else ""
    return sql + tail + f""", adxs AS (SELECT symbol, adx FROM ser WHERE rn = 1),
f0 AS (
  SELECT q.symbol, {AS_OF} AS ts, CAST(0 AS BIGINT) AS seq, q.c AS close, adxs.adx AS adx, q.n AS n_rows, traj.overall_trajectory AS path,
    traj.trend_consistency AS cons, traj.gap_risk_factor AS gap, traj.acceleration, CASE WHEN traj.short_change_pct > 0 THEN 'UP' ELSE 'DOWN' END AS sd,
    mom.momentum_direction AS md, mom.momentum_abs AS ma, mom.rsi_level AS rl, mom.macd_cross AS mc, mom.volume_direction AS vd,
    mom.ma_signal AS msig, mom.ma_alignment AS mal, {advice} AS adv, q.final_score AS fs, q.score_momentum AS sm,
    q.score_volatility AS sv, q.score_mean_reversion AS sr, q.resistance, q.stop_loss AS stop, q.recommendation AS rec
  FROM q JOIN adxs ON adxs.symbol = q.symbol JOIN traj ON traj.symbol = q.symbol JOIN mom ON mom.symbol = q.symbol {join}),
f1 AS (SELECT *, CASE WHEN symbol LIKE '%S1%' THEN 'IT' WHEN symbol LIKE '%S2%' THEN 'BANKING' WHEN symbol LIKE '%S3%' THEN 'ENERGY' ELSE 'OTHER' END AS sector,
    CASE WHEN adx > 25 THEN 'TRENDING' WHEN adx < 20 THEN 'RANGING' ELSE 'UNDEFINED' END AS reg, {high_vol('ts')} AS hv FROM f0),
""" + RULES[RULES.index("f2 AS ("):].replace("* 0.5 +", "* 0.0 +")


FLOW_ACTS = "acts AS (" + side_rules("BUY") + " UNION ALL " + side_rules("SELL") + ")"

# --- components ------------------------------------------------------------------------------


def _c(cond: str, text: str) -> str:
    return f"CASE WHEN {cond} THEN {text} END"


_T, _R = "market_regime = 'TRENDING'", "market_regime = 'RANGING'"
_O = f"NOT ({_T} OR {_R})"
_SMA = "(coalesce(sma_5, 0) <> 0 AND coalesce(sma_20, 0) <> 0)"
_MAC = f"({_T} AND coalesce(macd, 0) <> 0 AND coalesce(macd_signal, 0) <> 0)"
_OS, _OB = "(coalesce(rsi, 0) <> 0 AND rsi < rsi_oversold)", "(coalesce(rsi, 0) <> 0 AND NOT rsi < rsi_oversold AND rsi > rsi_overbought)"
_BEL, _ABO = f"({_R} AND bb_lower <> 0 AND bb_upper <> 0 AND close < bb_lower)", f"({_R} AND bb_lower <> 0 AND bb_upper <> 0 AND NOT close < bb_lower AND close > bb_upper)"
_HV, _LV = "(coalesce(volume_ratio, 0) <> 0 AND volume_ratio > volume_high)", "(coalesce(volume_ratio, 0) <> 0 AND NOT volume_ratio > volume_high AND volume_ratio < volume_low)"


def basic(base: str, n: int) -> str:
    pts = [(f"{_T} AND {_SMA} AND sma_5 > sma_20", 1.5), (f"{_T} AND {_SMA} AND NOT sma_5 > sma_20", -1.5), (f"{_MAC} AND macd > macd_signal", 1.0),
           (f"{_MAC} AND NOT macd > macd_signal", -1.0), (f"{_T} AND adx > 25", 0.5), (f"{_R} AND {_OS}", 1.5), (f"{_R} AND {_OB}", -1.5), (_BEL, 1.0), (_ABO, -1.0),
           (f"{_O} AND {_SMA} AND sma_5 > sma_20", 0.5), (f"{_O} AND {_SMA} AND NOT sma_5 > sma_20", -0.5), (f"{_O} AND {_OS}", 0.5), (f"{_O} AND {_OB}", -0.5)]
    score = " + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0.0 END)" for c, p in pts)
    f1 = lambda x: fmt(x, 1)
    reasons = [f"CASE WHEN {_T} THEN 'Market Regime: TRENDING' WHEN {_R} THEN 'Market Regime: RANGING' ELSE 'Market Regime: WEAK/UNKNOWN' END",
               _c(f"{_T} AND {_SMA}", "CASE WHEN sma_5 > sma_20 THEN 'SMA5 > SMA20 (Trending Bullish)' ELSE 'SMA5 < SMA20 (Trending Bearish)' END"),
               _c(_MAC, "CASE WHEN macd > macd_signal THEN 'MACD bullish crossover' ELSE 'MACD bearish crossover' END"),
               _c(f"{_T} AND adx > 25", "'ADX > 25, confirms trend'"),
               _c(f"{_R} AND {_OS}", f"'RSI oversold (' || {f1('rsi')} || ' < ' || {f1('rsi_oversold')} || ')'"), _c(f"{_R} AND {_OB}", f"'RSI overbought (' || {f1('rsi')} || ' > ' || {f1('rsi_overbought')} || ')'"),
               _c(_BEL, "'Price below lower Bollinger Band'"), _c(_ABO, "'Price above upper Bollinger Band'"),
               _c(f"{_O} AND {_SMA}", "CASE WHEN sma_5 > sma_20 THEN 'SMA5 > SMA20 (Weak Bullish)' ELSE 'SMA5 < SMA20 (Weak Bearish)' END"),
               _c(f"{_O} AND {_OS}", f"'RSI oversold (' || {f1('rsi')} || ')'"), _c(f"{_O} AND {_OB}", f"'RSI overbought (' || {f1('rsi')} || ')'"),
               _c(_HV, f"'High volume activity (' || {f1('volume_ratio')} || ' > ' || {f1('volume_high')} || ')'"), _c(_LV, f"'Low volume activity (' || {f1('volume_ratio')} || ' < ' || {f1('volume_low')} || ')'")]
    return latest(base, n) + f""", b0 AS (
  SELECT *, {score} AS trend_score, list_filter([{', '.join(reasons)}], lambda v: v IS NOT NULL) AS reasons, CASE WHEN {_HV} THEN 'HIGH' WHEN {_LV} THEN 'LOW' ELSE 'NORMAL' END AS volume_label FROM ind),
basic AS (
  SELECT *, CASE WHEN trend_score >= 2 THEN 'BUY' WHEN trend_score <= -2 THEN 'SELL' ELSE 'HOLD' END AS overall_signal,
    CASE WHEN trend_score >= 2 THEN 'BULLISH' WHEN trend_score <= -2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal_trend,
    CASE WHEN abs(trend_score) >= 2 THEN least(abs(trend_score) / 4.0, 1.0) ELSE greatest(0.3, 1.0 - abs(trend_score) / 2.0) END AS signal_confidence,
    CASE WHEN trend_score >= 2 THEN round(close * 0.998, 2) WHEN trend_score <= -2 THEN round(close * 1.002, 2) END AS suggested_entry,
    CASE WHEN trend_score >= 2 THEN round(swing_low * 0.99, 2) WHEN trend_score <= -2 THEN round(swing_high * 1.01, 2) END AS basic_stop,
    CASE WHEN trend_score >= 2 THEN round(swing_high, 2) WHEN trend_score <= -2 THEN round(swing_low, 2) END AS basic_target FROM b0)"""


def components(base: str = CALM, quotes: str = QUOTES[len(BARS) + 2:]) -> str:
    """Component blocks of the calm bars as ``comp``."""
    sql = basic(base, 250) + quant(base).replace("{stop}", _ensemble())[len(recent(base)):] + trajectory(base) + ", " + quotes
    return sql + f""", comp AS (
  SELECT book.symbol, basic.ts AS ts,
    {clamp('(sma_5 - sma_20) / sma_20')} AS t_score, least(1.0, signal_confidence) AS t_conf, overall_signal AS t_dir, array_to_string(list_slice(basic.reasons, 1, 3), '; ') AS t_reason,
    {clamp('(final_score - 0.5) * 2')} AS q_score, least(1.0, abs({clamp('(final_score - 0.5) * 2')})) AS q_conf,
    CASE WHEN recommendation LIKE '%BUY%' THEN 'BUY' WHEN recommendation LIKE '%SELL%' THEN 'SELL' ELSE 'HOLD' END AS q_dir, 'Quant composite ' || {fmt('final_score', 2)} || ' (' || recommendation || ')' AS q_reason,
    book.confidence * (CASE market_sentiment WHEN 'BULLISH' THEN 1 WHEN 'BEARISH' THEN -1 ELSE 0 END) AS o_score, book.confidence AS o_conf,
    CASE market_sentiment WHEN 'BULLISH' THEN 'BUY' WHEN 'BEARISH' THEN 'SELL' ELSE 'HOLD' END AS o_dir, replace(key_factors, '|', ', ') AS o_reason,
    vol_score AS r_score, least(1.0, vol_score) AS r_conf, CASE WHEN market_regime = 'TRENDING' THEN 'BUY' ELSE 'HOLD' END AS r_dir, CAST(NULL AS VARCHAR) AS r_reason,
    CASE WHEN overall_trajectory LIKE '%BULLISH' THEN least(1.0, trend_consistency) WHEN overall_trajectory LIKE '%BEARISH' THEN -least(1.0, trend_consistency) ELSE 0.0 END AS p_score,
    CASE WHEN overall_trajectory LIKE '%BULLISH' THEN 'BUY' WHEN overall_trajectory LIKE '%BEARISH' THEN 'SELL' ELSE 'HOLD' END AS p_dir,
    overall_trajectory || ' with consistency ' || {fmt('trend_consistency', 2)} AS p_reason, acceleration,
    (sma_20 - sma_50) / sma_50 AS bias, q.n AS n_bars, trajectory_status = 'ok' AS p_ok, basic.market_regime AS regime, book.ltp, book.ltq, best_bid, best_ask, book.spp AS spread_pct, basic.atr, basic.close, basic.high, basic.low
  FROM book JOIN basic ON basic.symbol = book.symbol JOIN q ON q.symbol = book.symbol JOIN traj ON traj.symbol = book.symbol),
comp2 AS (SELECT *, least(1.0, abs(p_score) + abs(acceleration)) AS p_conf FROM comp)"""


def comp_query(prefix: str) -> str:
    return f"""WITH {components()} SELECT symbol, {r(prefix + '_score', 'score')}, {r(prefix + '_conf', 'confidence')}, {prefix}_dir AS direction, {prefix}_reason AS reason FROM comp2"""


def cycle_query() -> str:
    parts = [("p", 0.25), ("q", 0.2), ("t", 0.2), ("o", 0.15), ("r", 0.2)]

    def sc(p):
        return f"(CASE WHEN {p}_dir = 'SELL' AND {p}_score > 0 THEN -{p}_score ELSE {p}_score END)"

    ss = " + ".join(f"{w} * {sc(p)}" for p, w in parts)
    cs = " + ".join(f"{w} * (CASE WHEN {p}_conf > 0 THEN {p}_conf ELSE abs({sc(p)}) END)" for p, w in parts)
    return f"""WITH {components()}, d0 AS (SELECT *, {ss} AS score, {cs} AS cs FROM comp2),
d1 AS (SELECT *, greatest(0.0, least(1.0, (cs * 0.6 + abs(score) * 0.4) * (1 + 0.15 * coalesce(bias, 0)))) AS confidence FROM d0),
d2 AS (SELECT *, CASE WHEN confidence < 0.2 THEN 'HOLD' WHEN score >= 0.05 THEN 'BUY' WHEN score <= -0.05 THEN 'SELL' ELSE 'HOLD' END AS raw FROM d1),
d3 AS (SELECT *, CASE WHEN raw <> 'HOLD' AND confidence < 0.6 THEN 'HOLD' ELSE raw END AS direction,
  CASE WHEN raw <> 'HOLD' AND confidence < 0.6 THEN 'Direction change gated by persistence rule (<0.60 confidence)' WHEN raw = 'HOLD' AND confidence < 0.2 THEN 'Confidence dropped below actionable range' END AS persistence_reason,
  greatest(coalesce(nullif(atr, 0), ltp * 0.01) * 1.5, ltp * 0.003) AS buf FROM d2),
d4 AS (SELECT *, ltp AS entry_price, ltp - (CASE direction WHEN 'BUY' THEN buf WHEN 'SELL' THEN -buf ELSE 0.0 END) AS stop_loss,
  ltp + 2 * (CASE direction WHEN 'BUY' THEN buf WHEN 'SELL' THEN -buf ELSE 0.0 END) AS target_price FROM d3)
SELECT symbol, direction, {rs('confidence', 'score', 'entry_price', 'stop_loss', 'target_price')}, {r('abs(entry_price - stop_loss)', 'risk_per_unit')},
  {r('CASE WHEN direction = ' + chr(39) + 'HOLD' + chr(39) + ' THEN 0.0 ELSE 1000.0 / abs(entry_price - stop_loss) END', 'position_size_qty')},
  {r('CASE WHEN direction <> ' + chr(39) + 'HOLD' + chr(39) + ' AND stop_loss > 0 AND target_price > 0 THEN round((target_price - entry_price) / (entry_price - stop_loss), 2) ELSE 0.0 END', 'risk_reward')},
  persistence_reason FROM d4"""


# every closed minute bar ends a frame of its symbol's last 250 bars, quoted from its last bar
FRAMES = MINUTES + """, closed AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM minutes WHERE ts + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM ticks)),
src AS (
  SELECT e.symbol || chr(1) || epoch_us(e.ts) AS symbol, b.ts, b.open, b.high, b.low, b.close, b.volume
  FROM closed e JOIN closed b ON b.symbol = e.symbol AND b.k BETWEEN e.k - 249 AND e.k)"""
FRAME_QUOTES = """trades AS (SELECT symbol, ts, 0 AS seq, close AS ltp, volume AS ltq, 0 AS bid_size, 0 AS ask_size FROM src),
quotes AS (
  SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS ltp, arg_max(volume, ts) AS ltq, arg_max(close, ts) AS best_bid, arg_max(close, ts) AS best_ask,
    NULL::BIGINT AS tb, NULL::BIGINT AS ta, NULL::DOUBLE AS bv, NULL::DOUBLE AS av, NULL::BIGINT AS b1, NULL::BIGINT AS a1, 0 AS nb, 0 AS na,
    NULL::DOUBLE AS isup, NULL::DOUBLE AS ires, NULL::DOUBLE AS ssup, NULL::DOUBLE AS sres
  FROM src GROUP BY symbol HAVING arg_max(close, ts) > 0),
""" + QUOTES[QUOTES.index("book0 AS ("):]


def minute_cycles() -> str:
    """One signal per symbol and closed minute, gated by the symbol's commitments before it."""
    parts = [("p", 0.25), ("q", 0.2), ("t", 0.2), ("o", 0.15), ("r", 0.2)]

    def sc(p):
        return f"(CASE WHEN {p}_dir = 'SELL' AND {p}_score > 0 THEN -{p}_score ELSE {p}_score END)"

    ss = " + ".join(f"{p}_weight * coalesce({sc(p)}, 0)" for p, _ in parts)
    cs = " + ".join(f"{p}_weight * coalesce(CASE WHEN {p}_conf > 0 THEN {p}_conf ELSE abs({sc(p)}) END, 0)" for p, _ in parts)
    weights = ", ".join(f"CASE WHEN {'p_ok' if p == 'p' else 'true'} THEN {w} ELSE 0.0 END AS {p}_weight" for p, w in parts)
    return f"""WITH {components(FRAMES, FRAME_QUOTES)}, w0 AS (
  SELECT * EXCLUDE (r_score, r_conf), {weights}, CASE WHEN n_bars >= 50 THEN r_score WHEN regime = 'TRENDING' THEN 0.6 WHEN regime = 'RANGING' THEN 0.2 ELSE 0.0 END AS r_score FROM comp2),
w1 AS (SELECT *, least(1.0, r_score) AS r_conf, {" + ".join(f"{p}_weight" for p, _ in parts)} AS weight FROM w0),
d0 AS (SELECT *, ({ss}) / weight AS score, ({cs}) / weight AS cs FROM w1),
d1 AS (SELECT *, greatest(0.0, least(1.0, (cs * 0.6 + abs(score) * 0.4) * (1 + 0.15 * coalesce(bias, 0)))) AS confidence FROM d0),
d2 AS (SELECT * EXCLUDE (symbol), split_part(symbol, chr(1), 1) AS symbol, make_timestamp(split_part(symbol, chr(1), 2)::BIGINT) AS bar_ts,
  CASE WHEN confidence < 0.2 THEN 'HOLD' WHEN score >= 0.05 THEN 'BUY' WHEN score <= -0.05 THEN 'SELL' ELSE 'HOLD' END AS raw FROM d1),
d3 AS (SELECT *, coalesce(last_value(CASE WHEN raw <> 'HOLD' AND confidence >= 0.6 THEN raw END IGNORE NULLS)
  OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'HOLD') AS committed FROM d2)
SELECT symbol, {ts("bar_ts", "updated_at")}, CASE WHEN raw <> committed AND confidence < 0.6 THEN 'HOLD' ELSE raw END AS direction,
  {rs('confidence', 'score')}, {r('ltp', 'entry_price')},
  CASE WHEN raw <> 'HOLD' AND raw <> committed AND confidence < 0.6 THEN 'Direction change gated by persistence rule (<0.60 confidence)'
    WHEN raw = 'HOLD' AND confidence < 0.2 THEN 'Confidence dropped below actionable range' END AS persistence_reason FROM d3"""


_INTRA = BARS + """, intraday AS (SELECT symbol, ts, open, high, low, close + 0.01 AS close, volume FROM bars WHERE ts >= TIMESTAMP '2000-06-01')"""
_NAMES = "SELECT CASE WHEN p_size > 25 THEN p_name || ' & ' || p_type ELSE p_name END AS name, 'P' || p_partkey AS instrument_key FROM part"
_DEDUP = _INTRA + """, ded AS (
  SELECT symbol, ts, open, high, low, close, volume, 0 AS source_rank, 'intraday' AS source FROM intraday
  UNION ALL SELECT symbol, ts, open, high, low, close, volume, 1, 'historical' FROM bars WHERE (symbol, ts) NOT IN (SELECT (symbol, ts) FROM intraday))"""
_LOADED = _INTRA + """, cnt AS (SELECT symbol, count(*) AS n FROM intraday GROUP BY 1),
uni AS (SELECT symbol, ts, 'intraday' AS source FROM intraday
  UNION ALL SELECT b.symbol, b.ts, 'historical' FROM bars b LEFT JOIN cnt USING (symbol) WHERE coalesce(n, 0) < 250 AND (b.symbol, b.ts) NOT IN (SELECT (symbol, ts) FROM intraday)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM uni) WHERE rn <= 250)"""
_BAR_COLS = f"symbol, {ts('ts', 'ts')}, {rs('open', 'high', 'low', 'close')}, volume"


def resampled(width_min: int, name: str) -> str:
    off = {60: 30, 240: 150, 1440: 1110}[width_min]
    return MINUTES + f""", {name} AS (
  SELECT symbol, time_bucket(INTERVAL {width_min} MINUTE, ts, TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {off} MINUTE) AS ts0, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM minutes GROUP BY 1, 2)"""


def resample_query(width_min: int) -> str:
    return f"WITH {resampled(width_min, 'res')} SELECT symbol, {ts('ts0', 'ts')}, {rs('open', 'high', 'low', 'close')}, volume FROM res"


_MINUTE_SEL = f"""symbol, {ts('ts', 'ts')}, {rs('open', 'high', 'low', 'close')}, volume, tick_count, {ts('first_tick_time', 'first_tick_time')}, {ts('last_tick_time', 'last_tick_time')}"""
_CLOSED = f"WITH {MINUTES} SELECT {_MINUTE_SEL} FROM minutes WHERE ts + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM ticks)"
_TWICE = MINUTES.replace("ticks AS (", "once AS (", 1).replace(", minutes AS (", """, ticks AS (
  SELECT * FROM once UNION ALL SELECT symbol, ts, seq + 10000000000, ltp + 1000, ltq, event_type FROM once WHERE ts < TIMESTAMP '2024-01-10'), minutes AS (""")
_UP_NEW = BARS + """, new AS (SELECT symbol, ts, open, high, low, close + 1 AS close, volume FROM bars WHERE ts >= TIMESTAMP '2001-01-01'),
up AS (SELECT * FROM new UNION ALL SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE ts < TIMESTAMP '2001-01-01')"""


def clock(s: str) -> str:
    return f"printf('%d:%02d:%02d', {s} // 3600, ({s} % 3600) // 60, {s} % 60)"


_SEC = f"(hour({ist('ts')}) * 3600 + minute({ist('ts')}) * 60 + CAST(floor(second({ist('ts')})) AS BIGINT))"
_WD = f"(isodow({ist('ts')}) <= 5)"
_OPEN = f"({_WD} AND {_SEC} >= 33300 AND ({_SEC} < 55800 OR ({_SEC} = 55800 AND epoch_us(ts) % 1000000 = 0)))"
_STORED = BARS + ", stored AS (SELECT * FROM bars WHERE ts < TIMESTAMP '2001-06-01')"
_PRICE_SRC = f"WITH {FEED}, {LAST_SIG}"

# the events' month squeezed into one hour, and nine symbols in ten made one
ONE_HOUR = """CASE WHEN ends_with(symbol, '7') THEN symbol ELSE 'HOT' END AS symbol,
  make_timestamp(1704880800000000 + (epoch_us(ts) - 1704067200000000) // 744) AS ts"""

ORACLES = {
    "read_instruments": f"SELECT instrument_key, name AS symbol, replace(replace(name, ' ', '_'), '&', 'and') AS clean_name FROM ({_NAMES})",
    "read_bars": f"WITH {BARS} SELECT {_BAR_COLS} FROM bars WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-06-30'",
    "parse_candle_arrays": f"""WITH c AS (
  SELECT 'S' || l_suppkey AS symbol, CASE WHEN l_linestatus = 'F' THEN l_shipdate - INTERVAL 330 MINUTE ELSE l_shipdate END AS ts,
    CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice END AS p, l_extendedprice AS c, CASE WHEN l_linenumber = 1 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS volume
  FROM lineitem WHERE l_linenumber <> 7)
SELECT symbol, {ts('ts', 'ts')}, {r('p', 'open')}, {r("CAST(printf('%.2f', c + 1) AS DOUBLE)", 'high')}, {r('p', 'low')}, {r('c', 'close')}, volume FROM c WHERE p > 0""",
    "explode_feed": f"WITH {FEED} SELECT instrument_key, {ts('ts', 'ts')}, {r('ltp', 'ltp')}, ltq, CAST(len(lv) AS BIGINT) AS n_levels FROM feed",
    "upsert_bars": f"WITH {_UP_NEW} SELECT symbol, {ts('ts', 'ts')}, f AS field, {r('v', 'value')} FROM (" + " UNION ALL ".join(f"SELECT symbol, ts, '{f}' AS f, CAST({f} AS DOUBLE) AS v FROM up" for f in ("open", "high", "low", "close", "volume")) + ")",
    "store_bars": f"WITH {_UP_NEW} SELECT {_BAR_COLS} FROM up",
    "compacted_bars": f"WITH {_UP_NEW} SELECT {_BAR_COLS} FROM up WHERE ts BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2001-06-30'",
    "bar_metadata": f"WITH {_LOADED} SELECT symbol, count(*) AS candles_count, {ts('min(ts)', 'oldest_time')}, {ts('max(ts)', 'newest_time')}, "
    + joined("CASE WHEN bool_or(source = 'intraday') THEN 'intraday' END", "CASE WHEN bool_or(source = 'historical') THEN 'historical' END") + " AS strategies FROM kept GROUP BY symbol",
    "append_signal_history": f"WITH {UNIFIED} SELECT symbol, {ts('ts', 'updated_at')}, seq, direction, {r('confidence', 'confidence')}, {big('rn', 'rn')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rn FROM sig) WHERE rn <= 20",
    "signal_payload": sig(f"""symbol, direction AS p_direction, persistence_reason AS p_persistence_reason, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS p_updated_at,
  {r('round(confidence, 3)', 'p_confidence')}, {r('round(score, 3)', 'p_score')}, {r('nullif(risk_reward, 0)', 'p_risk_reward')}, {r('round(components[1].score, 3)', 'p_first_score')}, '1H' AS p_timeframe"""),
    "ingest_run_stats": f"""WITH {BARS}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1),
asked AS (SELECT 'S' || s_suppkey AS symbol FROM supplier UNION ALL SELECT 'C' || c_custkey FROM customer)
SELECT count(*) AS total_symbols, count(n) AS symbols_successful, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_candles, {r('count(n) * 100.0 / count(*)', 'success_rate')},
  {r('coalesce(sum(n), 0) / greatest(1, count(n))', 'avg_candles_per_symbol')} FROM asked LEFT JOIN n ON n.symbol = asked.symbol""",
    "latest_entry": f"WITH {BARS} SELECT symbol, {ts('max(ts)', 'last_ts')}, {r('arg_max(close, ts)', 'last_close')} FROM bars GROUP BY symbol",
    "indicator_history": f"WITH {series(CALM)} SELECT symbol, {ts('ts', 'ts')}, {rs('rsi', 'macd', 'macd_signal', 'sma_5', 'sma_20', 'volume_ratio')} FROM ser WHERE rn <= 100",
    "valid_bars": f"""SELECT 'U' || user_id AS symbol, {ts('ts', 'ts')}, {r('value', 'open')}, {r('value + 1', 'high')}, {r("value - CASE WHEN event_type = 'error' THEN 5 ELSE 0 END", 'low')}, {r('value', 'close')},
  coalesce(CASE WHEN event_type <> 'view' THEN {_EV} END, 0) AS volume FROM events WHERE value > 0 AND value - CASE WHEN event_type = 'error' THEN 5 ELSE 0 END > 0""",
    "best_quote": f"WITH {FEED} SELECT instrument_key, {ts('ts', 'ts')}, {r('ltp', 'ltp')}, ltq, {rs('best_bid', 'best_ask', 'spread', 'spread_pct')}, bid_size, ask_size FROM fq",
    "top_levels": f"WITH {FEED} SELECT instrument_key, {ts('ts', 'ts')}, {r('ltp', 'ltp')}, ltq, bid_levels, ask_levels FROM fq",
    "parse_exchange_ts": f"SELECT event_id, {ts(chr(40) + 'CASE WHEN event_type = ' + chr(39) + 'click' + chr(39) + ' THEN make_timestamp((epoch_us(ts) // 1000000) * 1000000) ELSE make_timestamp((epoch_us(ts) // 1000) * 1000) END' + chr(41), 'exchange_ts')} FROM events",
    "active_symbols": f"WITH {TICKS}, l AS (SELECT symbol, arg_max({{'p': CASE WHEN event_type <> 'error' THEN ltp END}}, ts) AS v FROM ticks GROUP BY 1) SELECT count(*) FILTER (v.p IS NOT NULL) AS active_symbols FROM l",
    "bars_in_range": f"WITH {MINUTES} SELECT symbol, {ts('ts', 'ts')}, {r('close', 'close')}, volume FROM minutes WHERE ts BETWEEN {EVENTS_END} - INTERVAL 200 HOUR AND {EVENTS_END}",
    "market_hours": f"""WITH {TICKS} SELECT seq, {ts('ts', 'ts')}, {_OPEN} AS is_open, NOT {_WD} AS is_weekend,
  CASE WHEN {_OPEN} THEN 'Market closes in ' || {clock(f'(55800 - {_SEC})')} WHEN {_WD} AND {_SEC} < 33300 THEN 'Market opens in ' || {clock(f'(33300 - {_SEC})')} ELSE 'Market closed' END AS status_message FROM ticks""",
    "high_vol_session": f"WITH {TICKS} SELECT seq, {high_vol('ts')} AS high_vol FROM ticks",
    "session_vol_factor": f"WITH {TICKS} SELECT seq, {r(session_factor('ts'), 'factor')} FROM ticks",
    "clamp": f"WITH {TICKS} SELECT seq, {r('CASE WHEN ltq <= 1 THEN 0.0 ELSE greatest(-1.0, least(1.0, (ltq - 50) / 20.0)) END', 'clamped')} FROM ticks",
    "stale_symbols": f"WITH {BARS}, l AS (SELECT symbol, max(ts) AS last_ts FROM bars GROUP BY 1) SELECT 'S' || s_suppkey AS symbol, {ts('last_ts', 'last_ts')} FROM supplier LEFT JOIN l ON l.symbol = 'S' || s_suppkey WHERE last_ts IS NULL OR TIMESTAMP '2001-10-28 00:01:00' - last_ts > INTERVAL 2 MINUTE",
    "price_tick_direction": f"WITH {TICKS}, l AS (SELECT *, lag(ltp) OVER (PARTITION BY symbol ORDER BY ts, seq) AS prev_ltp FROM ticks) SELECT symbol, seq, {rs('ltp', 'prev_ltp')}, CASE WHEN ltp > prev_ltp THEN 'up' WHEN ltp < prev_ltp THEN 'down' END AS tick_direction FROM l",
    "signal_freshness": f"WITH {TICKS}, a AS (SELECT symbol, seq, greatest(0, CAST(floor((epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(ts)) / 1000000.0) AS BIGINT)) AS age_seconds FROM ticks) SELECT *, CASE WHEN age_seconds <= 70 THEN 'fresh' ELSE 'stale' END AS freshness FROM a",
    "signal_quality": f"WITH {TICKS} SELECT seq, {r('CASE WHEN ltq <= 4 THEN 0.5 WHEN event_type = ' + chr(39) + 'click' + chr(39) + ' THEN 0.7 WHEN event_type = ' + chr(39) + 'error' + chr(39) + ' THEN 0.6 ELSE 0.5 END', 'quality')} FROM ticks",
    "signal_for": f"WITH {LAST_SIG} SELECT symbol, seq, direction, {r('confidence', 'confidence')} FROM lastsig WHERE symbol = 'U7'",
    "all_signals": f"WITH {LAST_SIG} SELECT symbol, seq, direction, {rs('confidence', 'score')} FROM lastsig",
    "live_symbols": f"WITH {FEED} SELECT symbol, replace(replace(symbol, ' ', '_'), '&', 'and') AS symbol_clean, instrument_key, {r('ltp', 'latest_price')}, tick_count AS data_points, CAST(0 AS DOUBLE) AS return_pct, {ts('last_update', 'last_update')} FROM lastq",
    "latest_quotes": f"WITH {FEED} SELECT symbol, instrument_key, {rs('ltp', 'best_bid', 'best_ask', 'spread', 'spread_pct')}, ltq, bid_size, ask_size, bid_levels, ask_levels, {ts('last_update', 'last_update')}, tick_count FROM lastq",
    "daily_trend_from_technical": f"WITH {TICKS} SELECT seq, {r('CASE WHEN event_type = ' + chr(39) + 'click' + chr(39) + ' THEN ltp WHEN event_type <> ' + chr(39) + 'view' + chr(39) + ' THEN ltp * 2 END', 'daily_trend')} FROM ticks",
    "align_series": f"WITH {BARS} SELECT symbol, {ts('ts', 'ts')}, {rs('open', 'high', 'low', 'close')}, {r('CAST(volume AS DOUBLE)', 'volume')} FROM bars",
    "label_symbols": f"WITH {FEED}, {TICKS} SELECT seq, ticks.symbol AS instrument_key, coalesce(inst.symbol, ticks.symbol) AS symbol FROM ticks LEFT JOIN inst ON inst.instrument_key = ticks.symbol",
    "subscribed_only": f"WITH {FEED}, {TICKS} SELECT seq, symbol AS instrument_key, {r('ltp', 'ltp')} FROM ticks WHERE symbol IN (SELECT instrument_key FROM inst)",
    "sector_of": f"SELECT instrument_key, CASE WHEN lower(name) LIKE '%ring%' OR lower(name) LIKE '%bolt%' OR lower(name) LIKE '%anvil%' THEN 'METALS' WHEN lower(name) LIKE '%gear%' OR lower(name) LIKE '%rod%' OR lower(name) LIKE '%plate%' THEN 'AUTO' WHEN lower(name) LIKE '%gizmo%' OR lower(name) LIKE '%hot%' THEN 'IT' ELSE 'OTHER' END AS sector FROM ({_NAMES})",
    "live_prices": f"""{_PRICE_SRC}, lq AS (SELECT instrument_key AS symbol, arg_max(ltp, ts) AS ltp, arg_max(best_bid, ts) AS best_bid, arg_max(best_ask, ts) AS best_ask, arg_max(spread_pct, ts) AS spread_pct, max(ts) AS lu FROM fq GROUP BY 1)
SELECT lq.symbol, {r('lq.ltp', 'ltp')}, {rs('best_bid', 'best_ask', 'spread_pct')}, {ts('lu', 'updated_at')}, direction, {r('confidence', 'confidence')} FROM lq LEFT JOIN lastsig ON lastsig.symbol = lq.symbol""",
    "live_prices_fallback": f"WITH {LAST_SIG} SELECT symbol, {r('ltp', 'ltp')}, {r('ltp', 'best_bid')}, {r('ltp + 0.05', 'best_ask')}, CAST(0 AS DOUBLE) AS spread_pct, {ts('ts', 'updated_at')}, direction, {r('confidence', 'confidence')} FROM lastsig",
    "assemble_snapshot": f"""WITH {TICKS}, p AS (SELECT symbol, arg_max(ltp, seq) AS ltp, arg_max(ltq, seq) FILTER (event_type = 'click') AS ltq, arg_max(ltp, seq) FILTER (event_type = 'error') AS ts2, max(CASE WHEN event_type = 'error' THEN 'error' END) AS dir FROM ticks GROUP BY 1)
SELECT symbol, {r('ltp', 'ltp')}, ltq, {r('ts2', 'technical_score')}, dir AS technical_direction FROM p""",
    "missing_bars": f"WITH {_STORED}, l AS (SELECT symbol, max(ts) AS lt FROM stored GROUP BY 1) SELECT {_BAR_COLS.replace('symbol,', 'bars.symbol,')} FROM bars JOIN l ON l.symbol = bars.symbol WHERE ts > lt AND {AS_OF} - lt > INTERVAL 2 MINUTE",
    "absent_bars": f"WITH {_STORED} SELECT {_BAR_COLS} FROM bars WHERE (symbol, ts) NOT IN (SELECT (symbol, ts) FROM stored)",
    "bars_with_context": f"""WITH {TICKS}, days AS (SELECT symbol, date_trunc('day', ts) + INTERVAL 1 DAY AS d, arg_max(ltp, (ts, seq)) AS daily_close FROM ticks GROUP BY 1, 2)
SELECT t.symbol, t.seq, {r('t.ltp', 'ltp')}, {r('days.daily_close', 'daily_close')} FROM ticks t ASOF LEFT JOIN days ON days.symbol = t.symbol AND days.d <= t.ts""",
    "bars_1m": f"WITH {MINUTES} SELECT {_MINUTE_SEL} FROM minutes",
    "bars_1d": f"WITH {BARS} SELECT {_BAR_COLS} FROM bars",
    "resample_1h": resample_query(60),
    "resample_4h": resample_query(240),
    "resample_1d": resample_query(1440),
    "bar_change_summary": f"WITH {resampled(60, 'res')} SELECT symbol, {ts('ts0', 'ts')}, {rs('open', 'close')}, {r('CASE WHEN open > 0 THEN (close - open) / open * 100 ELSE 0.0 END', 'change_pct')} FROM res",
    "chart_stats": f"""WITH {BARS}, s AS (SELECT symbol, arg_max(close, ts) AS latest_price, arg_min(close, ts) AS first_price, CAST(sum(volume) AS BIGINT) AS volume_24h, max(close) AS high_24h, min(close) AS low_24h, count(*) AS data_points, min(ts) AS a, max(ts) AS z FROM bars GROUP BY 1)
SELECT symbol, {rs('latest_price', 'first_price', 'high_24h', 'low_24h')}, volume_24h, data_points, {ts('a', 'range_start')}, {ts('z', 'range_end')}, {r('latest_price - first_price', 'price_change')}, {r('(latest_price - first_price) / first_price * 100', 'price_change_pct')} FROM s""",
    "chart_data": f"""WITH {resampled(240, 'res').replace('FROM minutes GROUP BY', f"FROM minutes WHERE symbol = 'U7' AND ts BETWEEN {EVENTS_END} - INTERVAL 400 HOUR AND {EVENTS_END} GROUP BY")}
SELECT symbol, {ts('ts0', 'ts')}, {rs('open', 'high', 'low', 'close')}, volume FROM res""",
    "depth_stats": f"""WITH {QUOTES} SELECT symbol, {r('CASE WHEN deep THEN tb END', 'total_bid_quantity')}, {r('CASE WHEN deep THEN ta END', 'total_ask_quantity')}, {r('CASE WHEN deep THEN bp END', 'bid_percentage')}, {r('CASE WHEN deep THEN ap END', 'ask_percentage')},
  {r('CASE WHEN deep THEN coalesce(' + div('bv', 'tb') + ', 0.0) END', 'bid_weighted_price')}, {r('CASE WHEN deep THEN coalesce(' + div('av', 'ta') + ', 0.0) END', 'ask_weighted_price')},
  {r('CASE WHEN deep THEN CASE WHEN nb > 1 THEN coalesce(' + div('b1', 'tb') + ' * 100, 0.0) ELSE 100.0 END END', 'bid_concentration')}, {r('CASE WHEN deep THEN CASE WHEN na > 1 THEN coalesce(' + div('a1', 'ta') + ' * 100, 0.0) ELSE 100.0 END END', 'ask_concentration')},
  nb AS n_bid_levels, na AS n_ask_levels, depth_pressure, CASE WHEN deep THEN 'ok' ELSE 'insufficient_levels' END AS depth_status FROM book1""",
    "signals_summary": f"""WITH {BOTH.replace('SELECT symbol, seq,', "SELECT symbol || '#' || seq AS symbol, seq,")} SELECT count(*) AS total_signals, count(*) FILTER (signal_type = 'BUY') AS buy_signals, count(*) FILTER (signal_type = 'SELL') AS sell_signals,
  {r('avg(confidence)', 'avg_confidence')}, {r('avg(risk_reward_ratio)', 'avg_risk_reward')}, count(*) FILTER ({_RANK} >= 3) AS strong_signals, {r('avg(gap_risk_factor)', 'avg_gap_risk')},
  arg_max(symbol, (confidence, symbol)) FILTER (signal_type = 'BUY') AS best_buy, arg_max(symbol, (confidence, symbol)) FILTER (signal_type = 'SELL') AS best_sell,
  """ + ", ".join(f"count(*) FILTER (sector_bias = '{n}') AS n_{n.lower()}" for n in ("BANKING", "IT", "PHARMA", "OTHER")) + " FROM acts",
    "pipeline_stats": f"WITH {TICKS}, t AS (SELECT symbol, count(*) AS p, count(*) FILTER (event_type <> 'error') AS s FROM ticks GROUP BY 1) SELECT CAST(sum(p) AS BIGINT) AS processed_ticks, CAST(sum(s) AS BIGINT) AS successful_ticks, count(*) FILTER (s > 0) AS active_symbols, count(*) AS symbols_with_signals, {r('sum(s) * 100.0 / sum(p)', 'success_rate')} FROM t",
    "percentile_linear": f"WITH {BARS} SELECT symbol, " + ", ".join(r(f"quantile_cont(close, {p / 100})", f"p{p}") for p in (5, 10, 20, 90)) + " FROM bars GROUP BY symbol",
    "percentile_rank_score": q(", ".join(r(f"z_pct_{p}", f"rank_{p}") for p in (5, 10, 20))),
    "trend_fit": f"WITH {recent(CALM, 100)} SELECT symbol, {r('regr_slope(close, i)', 'slope')}, {r(fit('close', 'i', 'true'), 'strength')} FROM r0 GROUP BY symbol",
    "autocorr_lag1": q(r("vol_clustering", "vol_clustering")),
    "sma": series_query("sma_5", "sma_10", "sma_20", "sma_50"),
    "ema": series_query("ema_5", "ema_10", "ema_20"),
    "rsi": series_query("rsi"),
    "macd": series_query("macd", "macd_signal", "macd_hist"),
    "bollinger": series_query("bb_upper", "bb_middle", "bb_lower"),
    "atr": series_query("tr", "atr"),
    "adx": series_query("adx"),
    "market_regime": f"WITH {latest(TREND)} SELECT symbol, {r('adx', 'adx')}, market_regime FROM ind",
    "adaptive_rsi_levels": f"WITH {latest(CALM, 252)} SELECT symbol, {rs('rsi_oversold', 'rsi_overbought')} FROM ind",
    "adaptive_volume_levels": f"WITH {latest(CALM, 252)} SELECT symbol, {rs('volume_high', 'volume_low')} FROM ind",
    "swing_points": f"WITH {latest(CALM)} SELECT symbol, {rs('swing_high', 'swing_low')} FROM ind",
    "volume_roc": series_query("volume_roc"),
    "obv": f"WITH {series(CALM)} SELECT symbol, {ts('ts', 'ts')}, CAST(obv AS BIGINT) AS obv FROM ser",
    "vwap": series_query("vwap"),
    "volume_ratio": series_query("volume_sma_20", "volume_ratio"),
    "indicators_latest": f"WITH {latest(CALM)} SELECT symbol, {big('n_rows', 'n_rows')}, {ts('ts', 'ts')}, CAST(volume AS BIGINT) AS volume, CAST(obv AS BIGINT) AS obv, {rs(*LATEST_COLS)}, market_regime FROM ind",
    "indicators_latest_wilder": wilder_latest("sma_20", "ema_20", "bb_upper", "bb_lower", "rsi", "atr", "macd", "macd_signal", "adx"),
    "indicator_record": record_query(series(CALM), "ser WHERE rn = 1"),
    "indicator_record_wilder": record_query(wilder(), "wil WHERE rn = 1"),
    "recent_bars_whole": f"WITH {BARS} SELECT {_BAR_COLS}, row_number() OVER (PARTITION BY symbol ORDER BY bars.ts DESC) AS rn FROM bars",
    "indicator_append": f"WITH {series(CALM, 1_000_000)} SELECT symbol, {ts('ts', 'ts')}, {rs('rsi', 'macd', 'macd_signal', 'sma_5', 'sma_20', 'volume_ratio')}, rn FROM ser WHERE rn <= 100",
    "whole_means": series_query("sma_20", "ema_5", "ema_20", n=1_000_000),
    "whole_macd": series_query("macd", "macd_signal", n=1_000_000),
    "whole_adx": series_query("rsi", "adx", n=1_000_000),
    "whole_wilder": wilder_query("rsi", "atr", "macd", "macd_signal", "adx", n=1_000_000),
    "wilder_means": wilder_query("sma_20", "ema_20", "bb_upper", "bb_lower"),
    "wilder_rsi_atr": wilder_query("rsi", "atr"),
    "wilder_macd": wilder_query("macd", "macd_signal"),
    "wilder_adx": wilder_query("adx"),
    "momentum_score": q(f"{rs('momentum_score', 'statistical_significance')}, momentum_strength, {big('n_timeframes', 'n_timeframes')}, " + rs(*[f"mom_{k}_{t}" for t in (3, 7, 14, 21) for k in ("ret", "t", "p")])),
    "mean_reversion": q(rs("reversion_prob", "expected_direction", *[f"{k}_{p}" for p in (5, 10, 20) for k in ("z", "z_pct")]) + ", current_extreme"),
    "volatility_regime": q("vol_regime, " + rs("current_vol", "vol_percentile", "vol_score", "vol_forecast")),
    "support_resistance": q(rs("support", "resistance", "range_position", "range_width_pct") + f", {big('support_strength', 'support_strength')}, {big('resistance_strength', 'resistance_strength')}"),
    "volume_confirmation": q("volume_trend, " + rs("volume_score", "current_volume_ratio")),
    "stop_loss": q(f"{r('c', 'close')}, CASE WHEN n >= 30 THEN 'ensemble' ELSE 'default' END AS stop_method, " + rs("stop_loss", "stop_loss_pct", *[f"stop_{k}" for k in params.STOP_WEIGHTS])),
    "stop_loss_atr": q("CASE WHEN n >= 30 THEN 'atr' ELSE 'default' END AS stop_method, " + rs("stop_loss", "stop_loss_pct"), stop="CASE WHEN n >= 30 THEN least(greatest(coalesce(stop_atr, c * 0.95), c * 0.90), c * 0.99) ELSE c * 0.98 END"),
    "position_size": q(f"""{r(_POS, 'position_size')}, {r(f'CASE WHEN n >= 20 THEN {_SIZE} / 1000000.0 END', 'position_pct')}, {r('stop_loss_pct', 'stop_loss_pct')},
  {r("CASE WHEN n >= 20 THEN CASE vol_regime WHEN 'LOW_VOL' THEN 1.5 WHEN 'HIGH_VOL' THEN 0.7 ELSE 1.0 END END", 'vol_multiplier')}, {r("CASE WHEN n >= 20 THEN CASE momentum_strength WHEN 'STRONG' THEN 1.2 WHEN 'MODERATE' THEN 1.0 ELSE 0.8 END END", 'confidence_multiplier')}, n >= 20 AS risk_adjusted"""),
    "quant_score": q("recommendation, " + rs("final_score", *[f"score_{k}" for k in params.SCORE_WEIGHTS], "risk_reward_ratio")),
    "risk_metrics": q(f"""{r('CASE WHEN n >= 30 THEN coalesce(' + div('rm - 0.07 / 252', 'rsd') + ' * sqrt(252.0), 0.0) ELSE 0.0 END', 'sharpe_ratio')}, {r('CASE WHEN n >= 30 THEN mdd ELSE 0.0 END', 'max_drawdown')}, {r('CASE WHEN n >= 30 THEN rvar ELSE 0.0 END', 'var_95')},
  {r('CASE WHEN n >= 30 THEN rsd * sqrt(252.0) ELSE 0.0 END', 'volatility')}, {r('CASE WHEN n >= 30 AND mn > 10 THEN coalesce(' + div('mc', 'mv') + ', 1.0) ELSE 1.0 END', 'beta')},
  {r('CASE WHEN n >= 30 AND mn > 10 THEN rm - coalesce(' + div('mc', 'mv') + ', 1.0) * mm ELSE 0.0 END', 'alpha')}, {r('CASE WHEN n >= 30 THEN coalesce(' + div('rm - 0.07 / 252', 'CASE WHEN ln > 0 THEN lsd ELSE rsd END') + ' * sqrt(252.0), 0.0) ELSE 0.0 END', 'sortino_ratio')}"""),
    "trading_plan": q(f"""recommendation AS action, {r('final_score', 'confidence_score')}, {r(_ENTRY, 'plan_entry')}, {big(_QTY, 'plan_quantity')}, {r(f'{_QTY} * {_ENTRY}', 'plan_position_value')}, {r(f'CASE WHEN {_BUYING} THEN stop_loss END', 'plan_stop')}, {r(_TARGET, 'plan_target')},
  {r(f'{_QTY} * ({_ENTRY} - stop_loss)', 'plan_risk_amount')}, {r(f'{_QTY} * ({_TARGET} - {_ENTRY})', 'plan_reward_amount')}, {r(f'CASE WHEN {_BUYING} THEN CASE WHEN stop_loss < {_ENTRY} THEN ({_TARGET} - {_ENTRY}) / ({_ENTRY} - stop_loss) ELSE 0.0 END END', 'plan_risk_reward')},
  {r(f'CASE WHEN {_BUYING} THEN CASE WHEN stop_loss < {_ENTRY} THEN ({_ENTRY} - stop_loss) / {_ENTRY} ELSE 0.0 END END', 'plan_max_loss_pct')}, {r(f'({_TARGET} - {_ENTRY}) / {_ENTRY}', 'plan_expected_gain_pct')},
  CASE WHEN NOT {_BUYING} THEN 'Score too low for entry' END AS plan_reason, vol_regime AS volatility_regime, momentum_strength, volume_trend"""),
    "spread_analysis": f"""WITH {QUOTES} SELECT symbol, {r('sp', 'spread_absolute')}, {r('spp', 'spread_percentage')}, spread_class, CASE WHEN spp IS NULL THEN NULL WHEN ltp <= best_bid THEN 'AT_BID' WHEN ltp >= best_ask THEN 'AT_ASK' ELSE 'BETWEEN' END AS ltp_position,
  CASE WHEN spp IS NULL THEN NULL WHEN bd < ad THEN 'BID_SIDE' ELSE 'ASK_SIDE' END AS ltp_bias, {r('CASE WHEN spp IS NOT NULL THEN bd END', 'bid_distance')}, {r('CASE WHEN spp IS NOT NULL THEN ad END', 'ask_distance')}, CASE WHEN spp IS NULL THEN 'insufficient_data' ELSE 'ok' END AS spread_status FROM book1""",
    "order_flow": f"""WITH {QUOTES} SELECT symbol, CASE WHEN nt >= 2 THEN 'ok' ELSE 'insufficient_history' END AS flow_status, flow_direction, up AS positive_moves, dn AS negative_moves, eq AS neutral_moves, {r('vwap', 'vwap')}, trade_intensity,
  {big('rv', 'recent_volume')}, {r('avgv', 'avg_volume')}, nt AS total_trades FROM flow""",
    "book_support_resistance": f"WITH {QUOTES} SELECT symbol, {r('isup', 'immediate_support')}, {r('ires', 'immediate_resistance')}, {r('ssup', 'strong_support')}, {r('sres', 'strong_resistance')}, {r('(ltp - isup) / ltp * 100', 'support_distance_pct')}, {r('(ires - ltp) / ltp * 100', 'resistance_distance_pct')} FROM (SELECT symbol, ltp, CASE WHEN deep THEN isup END AS isup, CASE WHEN deep THEN ires END AS ires, CASE WHEN deep THEN ssup END AS ssup, CASE WHEN deep THEN sres END AS sres FROM book0)",
    "tick_micro_trend": f"WITH {QUOTES} SELECT symbol, CASE WHEN n >= 5 THEN 'ok' ELSE 'building_history' END AS tick_status, micro_trend, CASE WHEN tn >= 3 THEN tu ELSE 0 END AS positive_ticks, CASE WHEN tn >= 3 THEN td ELSE 0 END AS negative_ticks, {r('bar', 'bid_ask_ratio')}, bid_size_trend, ask_size_trend, least(n, 10) AS tick_count FROM flow",
    "orderbook_signal": f"WITH {QUOTES} SELECT symbol, market_sentiment, short_term_direction, liquidity_quality, entry_recommendation, {r('confidence', 'confidence')}, key_factors FROM book",
    "orderbook_analysis": f"WITH {QUOTES} SELECT symbol, spread_class, depth_pressure, flow_direction, micro_trend, {r('CASE WHEN deep THEN ssup END', 'strong_support')}, {r('CASE WHEN deep THEN sres END', 'strong_resistance')}, entry_recommendation, {r('confidence', 'confidence')} FROM book",
    "price_trajectory": f"""WITH {recent(TREND, 100)}{trajectory()} SELECT symbol, {big('n_prices', 'n_prices')}, trajectory_status, {rs('short_change_pct', 'medium_change_pct', 'long_change_pct', 'short_trend', 'medium_trend', 'long_trend', 'acceleration', 'trend_consistency', 'gap_risk_factor')},
  """ + ", ".join(f"CASE WHEN {k}_change_pct > 0 THEN 'UP' WHEN {k}_change_pct IS NOT NULL THEN 'DOWN' END AS {k}_direction" for k in ("short", "medium", "long")) + ", overall_trajectory FROM traj",
    "trend_strength": traj_query("short_trend", "medium_trend", "long_trend"),
    "acceleration": traj_query("acceleration"),
    "trend_consistency": traj_query("trend_consistency"),
    "overall_trajectory": traj_query("overall_trajectory"),
    "gap_risk_factor": traj_query("gap_risk_factor"),
    "indicator_trajectory": mom_query("rsi_direction", "rsi_strength", "rsi_level", "volume_direction", "volume_strength"),
    "macd_cross": mom_query("macd_cross", "macd_trend", "macd_divergence"),
    "ma_cross": mom_query("ma_signal", "ma_alignment", "sma_5_trend", "sma_20_trend"),
    "momentum_composite": mom_query("composite_momentum", "momentum_direction", "momentum_abs"),
    "adx_regime": f"WITH {TICKS} SELECT seq, CASE WHEN ltq > 25 THEN 'TRENDING' WHEN ltq > 3 AND ltq < 20 THEN 'RANGING' ELSE 'UNDEFINED' END AS regime FROM ticks",
    "sector_bias": f"WITH {RULES} SELECT seq, sector, {r(bias_of('acceleration'), 'bias')} FROM f2",
    "buy_signal": rule_query("BUY"),
    "sell_signal": rule_query("SELL"),
    "quant_boost": f"WITH {RULES} SELECT seq, {r('boost', 'quant_boost')}, array_to_string(qr, '|') AS quant_reasons FROM f2",
    "statistical_target": f"WITH {RULES} SELECT seq, {r('tgt', 'target')} FROM f2",
    "combined_recommendation": f"""WITH {RULES} SELECT seq, CASE WHEN adv = 'WAIT' THEN rec WHEN adv = 'BUY' AND rec IN ('BUY', 'STRONG_BUY') THEN 'STRONG_BUY' WHEN adv = 'SELL' AND rec IN ('SELL', 'STRONG_SELL') THEN 'STRONG_SELL'
  WHEN rec = 'HOLD' THEN adv WHEN rec IN ('STRONG_BUY', 'STRONG_SELL') THEN rec ELSE 'HOLD' END AS final FROM f2""",
    "enhanced_recommendation": f"""WITH {flow_rules(False)}, {FLOW_ACTS}, fs AS (SELECT symbol, min(signal_type) AS rule_signal FROM acts GROUP BY 1)
SELECT q.symbol, rule_signal, {r('final_score', 'final_score')}, recommendation, CASE WHEN rule_signal IS NULL THEN recommendation WHEN rule_signal = 'BUY' AND recommendation IN ('BUY', 'STRONG_BUY') THEN 'STRONG_BUY'
  WHEN rule_signal = 'SELL' AND recommendation IN ('SELL', 'STRONG_SELL') THEN 'STRONG_SELL' WHEN recommendation = 'HOLD' THEN rule_signal WHEN recommendation IN ('STRONG_BUY', 'STRONG_SELL') THEN recommendation ELSE 'HOLD' END AS final_recommendation
FROM q LEFT JOIN fs ON fs.symbol = q.symbol""",
    "actionable_signals": f"WITH {flow_rules(True)}, {FLOW_ACTS} SELECT symbol, signal_type, strength, {rs('confidence', 'entry_price', 'target_price', 'stop_loss')}, time_horizon, array_to_string(reasons, '|') AS reasons FROM acts",
    "signal_analytics": f"""WITH {flow_rules(False)}, {FLOW_ACTS}, cs AS (SELECT symbol, count(*) AS n FROM acts GROUP BY 1), hs AS (SELECT symbol, count(*) AS n FROM ser WHERE rn <= 100 GROUP BY 1)
SELECT s.symbol, coalesce(cs.n, 0) AS total_signals, overall_trajectory, {rs('trend_consistency', 'composite_momentum')}, momentum_direction, coalesce(hs.n, 0) AS signal_history_length
FROM (SELECT 'S' || s_suppkey AS symbol FROM supplier) s LEFT JOIN cs ON cs.symbol = s.symbol LEFT JOIN hs ON hs.symbol = s.symbol LEFT JOIN traj ON traj.symbol = s.symbol LEFT JOIN mom ON mom.symbol = s.symbol""",
    "basic_signal": f"WITH {basic(CALM, 252)} SELECT symbol, overall_signal, signal_trend, {rs('signal_confidence', 'trend_score', 'suggested_entry', 'basic_stop', 'basic_target')}, volume_label, array_to_string(reasons, '|') AS reasons FROM basic",
    "technical_component": comp_query("t"),
    "quant_component": comp_query("q"),
    "orderbook_component": comp_query("o"),
    "regime_component": comp_query("r"),
    "trajectory_component": comp_query("p"),
    "daily_context": f"WITH {latest(CALM)} SELECT symbol, {r('(sma_20 - sma_50) / sma_50', 'bias')}, CASE WHEN sma_20 >= sma_50 THEN 'BUY' ELSE 'SELL' END AS direction, {r('least(1.0, abs((sma_20 - sma_50) / sma_50) * 2)', 'confidence')} FROM ind",
    "price_block": f"WITH {components()} SELECT symbol, {rs('ltp', 'best_bid', 'best_ask', 'spread_pct', 'atr', 'close', 'high', 'low')}, ltq FROM comp2",
    "contributions": f"WITH {UNIFIED} SELECT symbol, seq, c.name AS name, {r('c.weight', 'weight')}, {r('c.score', 'score')}, {r('c.confidence', 'confidence')}, c.direction AS direction, c.narrative AS narrative FROM (SELECT symbol, seq, unnest(components) AS c FROM sig)",
    "combine": sig(f"symbol, seq, {r('score', 'score')}"),
    "base_confidence": sig(f"symbol, seq, {r('base_confidence', 'base_confidence')}"),
    "context_adjust": sig(f"symbol, seq, {r('confidence', 'confidence')}, context_note"),
    "raw_direction": sig("symbol, seq, raw_direction"),
    "persistence": sig("symbol, seq, direction, persistence_reason"),
    "risk_levels": sig(f"symbol, seq, {rs('entry_price', 'stop_loss', 'target_price')}"),
    "unified_position_size": sig(f"symbol, seq, {rs('risk_per_unit', 'position_size_value', 'position_size_qty')}"),
    "risk_reward": sig(f"symbol, seq, {r('risk_reward', 'risk_reward')}"),
    "rationale": sig("""symbol, seq, array_to_string(list_concat(['Direction ' || direction || ' with ' || printf('%.1f', confidence * 100) || '% confidence on 1H timeframe'],
  list_transform(components, lambda c: (CASE c.name WHEN 'market_regime' THEN 'Market_Regime' ELSE upper(c.name[1]) || c.name[2:] END) || ': ' || c.narrative || ' (' || printf('%+.2f', c.score) || ')'),
  CASE WHEN context_note IS NULL THEN [] ELSE [context_note] END), '|') AS rationale"""),
    "unified_signal": sig(f"symbol, seq, direction, {rs('confidence', 'score', 'entry_price')}, persistence_reason"),
    "signal_cycle": cycle_query(),
    "bootstrap_snapshot": f"WITH {BARS}, l AS (SELECT symbol, arg_max(close, ts) AS c, arg_max(volume, ts) AS v, max(ts) AS t FROM bars GROUP BY 1) SELECT symbol, {r('c', 'ltp')}, v AS ltq, {r('c', 'best_bid')}, {r('c', 'best_ask')}, {ts('t', 'last_update')} FROM l WHERE c > 0",
    "recent_bars": f"WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) SELECT {_BAR_COLS}, rn FROM k WHERE rn <= 250",
    "signal_history": sig(f"symbol, seq, direction, {r('confidence', 'confidence')}", "WHERE symbol = 'U7' ORDER BY ts DESC, seq DESC LIMIT 30"),
    "merged_history": sig(f"symbol, seq, direction, {r('confidence', 'confidence')}", "ORDER BY ts DESC, seq DESC LIMIT 100"),
    "leaderboard": f"WITH {LAST_SIG} SELECT symbol, direction, {rs('confidence', 'entry_price')} FROM lastsig ORDER BY lastsig.confidence DESC, symbol LIMIT 8",
    "last_history_rows": f"WITH {UNIFIED}, h AS (SELECT * FROM sig WHERE symbol = 'U7' ORDER BY ts DESC, seq DESC LIMIT 20) SELECT symbol, seq, direction, {r('confidence', 'confidence')} FROM h ORDER BY ts, seq LIMIT 12",
    "union_intraday_historical": f"WITH {_INTRA}, cnt AS (SELECT symbol, count(*) AS n FROM intraday GROUP BY 1) SELECT symbol, {ts('ts', 'ts')}, {r('close', 'close')}, 'intraday' AS source FROM intraday UNION ALL SELECT b.symbol, {ts('b.ts', 'ts')}, {r('b.close', 'close')}, 'historical' FROM bars b LEFT JOIN cnt ON cnt.symbol = b.symbol WHERE coalesce(n, 0) < 120",
    "union_buy_sell": f"WITH {BOTH} SELECT symbol || '#' || seq AS symbol, signal_type, {big(_RANK, 'strength_rank')}, {r('confidence', 'confidence')} FROM acts",
    "dedup_bars": f"WITH {_DEDUP} SELECT {_BAR_COLS}, {big('source_rank', 'source_rank')}, source FROM ded",
    "stream_ohlcv_1m": _CLOSED,
    "stream_late_data": _CLOSED,
    "stream_corrected_bars": f"WITH {_TWICE} SELECT {_MINUTE_SEL} FROM minutes",
    "stream_late_ticks": f"""WITH {TICKS}, cut AS (
  SELECT *, CASE WHEN seq % 5 <> 0 THEN 0 ELSE 1 END AS batch FROM ticks UNION ALL SELECT *, 1 FROM ticks WHERE ts < TIMESTAMP '2024-01-10'),
seen AS (SELECT *, batch = 1 AND date_trunc('minute', ts) + INTERVAL 90 SECOND <= (SELECT max(ts) FROM cut WHERE batch = 0) AS late FROM cut)
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS ticks, count(*) FILTER (WHERE late) AS late_ticks,
  count(DISTINCT (symbol, date_trunc('minute', ts))) FILTER (WHERE late) AS late_bars, {ts('max(ts)', 'newest')} FROM seen GROUP BY batch""",
    "stream_latest_quotes": f"WITH {TICKS} SELECT symbol, {r('arg_max(ltp, ts)', 'ltp')}, arg_max(ltq, ts) AS ltq, {ts('max(ts)', 'last_update')}, count(*) AS tick_count FROM ticks GROUP BY symbol",
    "stream_signals": minute_cycles(),
    "stream_persistence": sig("symbol, seq, direction, persistence_reason"),
    "stream_dedup": f"WITH {TICKS} SELECT symbol, {ts('ts', 'ts')}, {r('ltp', 'ltp')}, ltq FROM ticks",
}

_FORMS = TICKS + """, f0 AS (
  SELECT *, CASE event_type WHEN 'click' THEN 'BUY' WHEN 'error' THEN 'SELL' ELSE 'HOLD' END AS side, ltq / 49.7 - 1.0 AS lean FROM ticks),
f1 AS (
  SELECT *, CASE side WHEN 'BUY' THEN 1.0 WHEN 'SELL' THEN -1.0 ELSE 0.0 END AS news, CASE WHEN lean > 0 THEN 'BUY' WHEN lean < 0 THEN 'SELL' ELSE 'HOLD' END AS way,
    greatest(-1.0, least(1.0, lean)) AS depth FROM f0),
f2 AS (
  SELECT *, CASE WHEN side = 'HOLD' THEN way ELSE side END AS depth_side, CASE WHEN ltp > 0 THEN least(1.0, ltp / 400.0) ELSE abs(news) END AS news_conf FROM f1),
forms AS (
  SELECT symbol, seq, lean, list_filter([
    {'name': 'news_flow', 'title': 'News_Flow', 'weight': 0.5::DOUBLE, 'score': news::DOUBLE, 'confidence': news_conf::DOUBLE, 'direction': side, 'narrative': 'path'},
    CASE WHEN ltq >= 20 THEN {'name': 'quant', 'title': 'Quant', 'weight': 0.25::DOUBLE, 'score': 0.5::DOUBLE, 'confidence': 0.5::DOUBLE, 'direction': way,
      'narrative': CASE way WHEN 'HOLD' THEN 'Quant neutral' WHEN 'BUY' THEN 'Quant skewed bullish' ELSE 'Quant skewed bearish' END} END,
    {'name': 'book-depth', 'title': 'Book-Depth', 'weight': 0.25::DOUBLE, 'score': depth::DOUBLE, 'confidence': abs(depth)::DOUBLE, 'direction': depth_side,
      'narrative': CASE depth_side WHEN 'HOLD' THEN 'Book-Depth neutral' WHEN 'BUY' THEN 'Book-Depth skewed bullish' ELSE 'Book-Depth skewed bearish' END}
  ], lambda c: c IS NOT NULL) AS components FROM f2),
g1 AS (
  SELECT *, list_sum(list_transform(components, lambda c: c.weight)) AS ws, list_sum(list_transform(components, lambda c: c.weight * c.score)) AS ss,
    list_sum(list_transform(components, lambda c: c.weight * c.confidence)) AS cs, greatest(-1.0, least(1.0, lean / 2)) AS bias FROM forms),
g2 AS (SELECT *, greatest(-1.0, least(1.0, ss / ws)) AS score, greatest(0.0, least(1.0, cs / ws * 0.6 + abs(ss / ws) * 0.4)) AS base FROM g1),
g3 AS (SELECT *, greatest(0.0, least(1.0, base * (1 + 0.15 * bias))) AS confidence FROM g2),
g4 AS (
  SELECT *, CASE WHEN confidence < 0.2 THEN 'HOLD' WHEN score >= 0.05 THEN 'BUY' WHEN score <= -0.05 THEN 'SELL' ELSE 'HOLD' END AS direction,
    CASE WHEN bias <> 0 THEN 'Daily context (1D) bias ' || printf('%+.2f', bias) || ' adjusted confidence' END AS context_note FROM g3)"""
_CONTEXTS = TICKS + """, c AS (
  SELECT *, ltq / 49.7 - 1.0 AS lean, CASE event_type WHEN 'click' THEN 1.0 WHEN 'error' THEN -1.0 END AS way FROM ticks),
forms AS (
  SELECT 'number' AS form, seq, greatest(-1.0, least(1.0, lean * 2)) AS bias FROM c UNION ALL
  SELECT 'score', seq, greatest(-1.0, least(1.0, lean)) FROM c UNION ALL
  SELECT 'bias', seq, greatest(-1.0, least(1.0, CASE WHEN ltq > 30 THEN lean ELSE 0.1 END)) FROM c UNION ALL
  SELECT 'side', seq, coalesce(way, 0.0) FROM c UNION ALL
  SELECT 'confidence', seq, coalesce(way * least(1.0, ltp / 90.0), 0.0) FROM c)"""

ORACLES |= {
    "carry_nulls": f"""WITH {TICKS}, t AS (SELECT CASE WHEN seq % 7 <> 0 THEN symbol END AS symbol, CASE WHEN seq % 11 <> 0 THEN ts END AS ts, seq, ltp FROM ticks),
l AS (SELECT *, CASE WHEN ts IS NOT NULL THEN lag(ltp) OVER (PARTITION BY symbol, ts IS NULL ORDER BY ts, seq) END AS prev_ltp FROM t)
SELECT symbol, seq, {rs('ltp', 'prev_ltp')}, CASE WHEN ltp > prev_ltp THEN 'up' WHEN ltp < prev_ltp THEN 'down' END AS tick_direction FROM l""",
    "latest_quotes_ties": f"""WITH {TICKS}, t AS (SELECT symbol, date_trunc('day', ts) AS ts, seq, ltp, ltq FROM ticks),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rk, count(*) OVER (PARTITION BY symbol) AS tick_count FROM t)
SELECT symbol, {r('ltp', 'ltp')}, ltq, {ts('ts', 'last_update')}, tick_count FROM k WHERE rk = 1""",
    "signal_history_long": sig(f"seq, direction, {r('confidence', 'confidence')}", "ORDER BY ts DESC, seq DESC LIMIT 1000"),
    "merged_history_long": sig(f"symbol, seq, direction, {r('confidence', 'confidence')}", "ORDER BY ts DESC, seq DESC LIMIT 1000"),
    "parse_candle_numbers": f"""SELECT 'S' || l_suppkey AS symbol, {ts('l_shipdate', 'ts')}, {", ".join(r('l_extendedprice', c) for c in ('open', 'high', 'low', 'close'))},
  CAST(l_quantity AS BIGINT) AS volume FROM lineitem WHERE l_linenumber NOT IN (4, 5)""",
    "valid_bars_nan": f"""WITH {TICKS} SELECT symbol, {ts('ts', 'ts')}, {", ".join(r('ltp', c) for c in ('open', 'high', 'low', 'close'))}, ltq AS volume FROM ticks WHERE event_type <> 'error'""",
    "contributions_aliases": f"WITH {_FORMS} SELECT symbol, seq, c.name AS name, {r('c.weight', 'weight')}, {r('c.score', 'score')}, {r('c.confidence', 'confidence')}, c.direction AS direction, c.narrative AS narrative FROM (SELECT symbol, seq, unnest(components) AS c FROM forms)",
    "context_forms": f"WITH {_CONTEXTS} SELECT form, seq, {r('bias', 'bias')} FROM forms",
    "rationale_custom": f"""WITH {_FORMS} SELECT symbol, seq, array_to_string(list_concat(['Direction ' || direction || ' with ' || printf('%.1f', confidence * 100) || '% confidence on 1H timeframe'],
  list_transform(components, lambda c: c.title || ': ' || c.narrative || ' (' || printf('%+.2f', c.score) || ')'),
  CASE WHEN context_note IS NULL THEN [] ELSE [context_note] END), '|') AS rationale FROM g4""",
    "percentile_linear_hot": f"WITH {BARS}, h AS (SELECT CASE WHEN ends_with(symbol, '7') THEN symbol ELSE 'HOT' END AS symbol, close FROM bars) SELECT symbol, "
    + ", ".join(r(f"quantile_cont(close, {p / 100})", f"p{p}") for p in (5, 50, 95)) + " FROM h GROUP BY symbol",
    "price_tick_direction_hot": f"""WITH {TICKS}, h AS (SELECT CASE WHEN ends_with(symbol, '7') THEN symbol ELSE 'HOT' END AS symbol, ts, seq, ltp FROM ticks),
l AS (SELECT *, lag(ltp) OVER (PARTITION BY symbol ORDER BY ts, seq) AS prev_ltp FROM h)
SELECT symbol, seq, {rs('ltp', 'prev_ltp')}, CASE WHEN ltp > prev_ltp THEN 'up' WHEN ltp < prev_ltp THEN 'down' END AS tick_direction FROM l""",
    "persistence_hot": f"""WITH {UNIFIED}, h AS (SELECT CASE WHEN ends_with(symbol, '7') THEN symbol ELSE 'HOT' END AS symbol, ts, seq, raw_direction, confidence FROM sig),
l AS (SELECT *, coalesce(last_value(CASE WHEN raw_direction <> 'HOLD' AND confidence >= 0.6 THEN raw_direction END IGNORE NULLS)
  OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'HOLD') AS committed FROM h)
SELECT symbol, seq, CASE WHEN raw_direction <> committed AND confidence < 0.6 THEN 'HOLD' ELSE raw_direction END AS direction,
  CASE WHEN raw_direction = 'HOLD' AND confidence < 0.2 THEN 'Confidence dropped below actionable range'
    WHEN raw_direction <> 'HOLD' AND raw_direction <> committed AND confidence < 0.6 THEN 'Direction change gated by persistence rule (<0.60 confidence)' END AS persistence_reason FROM l""",
    "price_tick_direction_hour": f"""WITH {TICKS}, h AS (SELECT {ONE_HOUR}, seq, ltp FROM ticks),
l AS (SELECT *, lag(ltp) OVER (PARTITION BY symbol ORDER BY ts, seq) AS prev_ltp FROM h)
SELECT symbol, seq, {rs('ltp', 'prev_ltp')}, CASE WHEN ltp > prev_ltp THEN 'up' WHEN ltp < prev_ltp THEN 'down' END AS tick_direction FROM l""",
    "persistence_hour": f"""WITH {UNIFIED}, h AS (SELECT {ONE_HOUR}, seq, raw_direction, confidence FROM sig),
l AS (SELECT *, coalesce(last_value(CASE WHEN raw_direction <> 'HOLD' AND confidence >= 0.6 THEN raw_direction END IGNORE NULLS)
  OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'HOLD') AS committed FROM h)
SELECT symbol, seq, CASE WHEN raw_direction <> committed AND confidence < 0.6 THEN 'HOLD' ELSE raw_direction END AS direction,
  CASE WHEN raw_direction = 'HOLD' AND confidence < 0.2 THEN 'Confidence dropped below actionable range'
    WHEN raw_direction <> 'HOLD' AND raw_direction <> committed AND confidence < 0.6 THEN 'Direction change gated by persistence rule (<0.60 confidence)' END AS persistence_reason FROM l""",
    "asof_context_hour": f"""WITH {TICKS}, h AS (SELECT {ONE_HOUR}, seq, ltp FROM ticks)
SELECT symbol, seq, {r('ltp', 'ltp')}, {r('(SELECT arg_max(e.ltp, e.ts) FROM h e WHERE e.symbol = h.symbol AND e.seq % 13 = 0 AND e.ts <= h.ts)', 'mark')} FROM h""",
    "recent_bars_hot": f"""WITH {TICKS}, h AS (SELECT CASE WHEN ends_with(symbol, '7') THEN symbol ELSE 'HOT' END AS symbol, ts, seq, ltp FROM ticks),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rn FROM h) SELECT symbol, {ts('ts', 'ts')}, seq, {r('ltp', 'ltp')}, rn FROM k WHERE rn <= 250""",
    **{
        f"stop_loss_{k}": q(f"CASE WHEN n >= 30 THEN '{k}' ELSE 'default' END AS stop_method, " + rs("stop_loss", "stop_loss_pct"),
                            stop=f"CASE WHEN n >= 30 THEN least(greatest(coalesce(stop_{k}, c * 0.95), c * 0.90), c * 0.99) ELSE c * 0.98 END")
        for k in ("var", "volatility", "support", "percentile")
    },
    "chart_minutes": f"WITH {MINUTES} SELECT symbol, {ts('ts', 'ts')}, {rs('open', 'high', 'low', 'close')}, volume FROM minutes WHERE symbol = 'U7' AND ts BETWEEN {EVENTS_END} - INTERVAL 72 HOUR AND {EVENTS_END}",
    "read_instruments_file": f"SELECT instrument_key, name AS symbol, replace(replace(name, ' ', '_'), '&', 'and') AS clean_name FROM ({_NAMES})",
}
