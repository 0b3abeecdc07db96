"""DuckDB SQL of the feature matrix and the factors, made from the same parameters as the operators."""

from __future__ import annotations

_W = "(PARTITION BY ticker ORDER BY date"


def frame(n: int) -> str:
    return f"OVER {_W} ROWS {n - 1} PRECEDING)"


def full(agg: str, x: str, n: int) -> str:
    """The aggregate of the last n rows, null until n values are there."""
    return f"CASE WHEN count({x}) {frame(n)} >= {n} THEN {agg} {frame(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {_W})"


def within(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {low}), {high}) END"


#: Smoothed columns: source, weight of the new value, values needed, rows before the first value.
_FIRST = (
    [(f"ema_{n}", "close", 2 / (n + 1), n, 0) for n in (9, 12, 13, 15, 20, 21, 26, 55)]
    + [("atr_14", "tr", 1 / 14, 14, 0)]
    + [(f"{x}_{n}", x, 1 / n, n, 1) for n in (7, 14, 28) for x in ("gain", "loss")]
    + [(f"{x}_14", x, 1 / 14, 14, 0) for x in ("plus_dm", "minus_dm")]
)
_SECOND = [("ema2_15", "v_ema_15", 2 / 16, 29), ("macd_signal_raw", "v_ema_12 - v_ema_26", 2 / 10, 34), ("adx", "100 * abs(v_plus_dm_14 / v_atr_14 - v_minus_dm_14 / v_atr_14) / nullif(v_plus_dm_14 / v_atr_14 + v_minus_dm_14 / v_atr_14, 0)", 1 / 14, 27)]
_THIRD = [("ema3_15", "v_ema2_15", 2 / 16, 43)]


def smoothed(bars: str = "bars") -> str:
    """CTEs up to ``k``: the bars with what needs the bar before and all recursive averages."""
    steps = f"""a0 AS (SELECT *, row_number() OVER {_W}) AS n, {lag("close")} AS prior, {lag("high")} AS prior_high, {lag("low")} AS prior_low FROM {bars}),
a1 AS (SELECT *, greatest(high - low, abs(high - prior), abs(low - prior)) AS tr, CASE WHEN prior IS NOT NULL THEN greatest(close - prior, 0) END AS gain, CASE WHEN prior IS NOT NULL THEN greatest(prior - close, 0) END AS loss,
  CASE WHEN high - prior_high > prior_low - low AND high > prior_high THEN high - prior_high ELSE 0.0 END AS plus_dm, CASE WHEN prior_low - low > high - prior_high AND prior_low > low THEN prior_low - low ELSE 0.0 END AS minus_dm,
  ln(close / prior) AS log_ret, (high + low + close) / 3 AS typical, close * volume AS dollar_volume, nullif(high - low, 0) AS candle FROM a0)"""

    def y(to: str, x: str, alpha: float) -> str:
        return f"coalesce({1 - alpha!r} * e.y_{to} + {alpha!r} * {x}, {x}, e.y_{to})"

    begin = ", ".join([f"CAST({x} AS DOUBLE) AS y_{to}" for to, x, *_ in _FIRST] + [f"CAST(NULL AS DOUBLE) AS y_{to}" for to, *_ in (*_SECOND, *_THIRD)])
    first = ", ".join(f"{y(to, f't.{x}', alpha)} AS y_{to}" for to, x, alpha, *_ in _FIRST)
    shown = ", ".join(f"CASE WHEN n >= {least + skip} THEN y_{to} END AS v_{to}" for to, _, _, least, skip in _FIRST)
    again = lambda steps: ", ".join(f"coalesce({1 - alpha!r} * p_{to} + {alpha!r} * ({x}), {x}, p_{to}) AS y_{to}" for to, x, alpha, _ in steps)
    old = ", ".join(f"e.y_{to} AS p_{to}" for to, *_ in (*_SECOND, *_THIRD))
    keep = ", ".join(f"y_{to}" for to, *_ in _FIRST)
    second = ", ".join(f"y_{to}" for to, *_ in _SECOND)
    recursion = f"""e AS (
  SELECT ticker, n, {begin} FROM a1 WHERE n = 1
  UNION ALL
  SELECT ticker, n, {keep}, {second}, {again(_THIRD)} FROM (SELECT *, {", ".join(f"CASE WHEN n >= {least} THEN y_{to} END AS v_{to}" for to, _, _, least in _SECOND)}
    FROM (SELECT *, {again(_SECOND)} FROM (SELECT *, {shown} FROM (SELECT t.ticker, t.n, {first}, {old} FROM e JOIN a1 t ON t.ticker = e.ticker AND t.n = e.n + 1)))))"""
    values = ", ".join([f"CASE WHEN a1.n >= {least + skip} THEN y_{to} END AS {to}" for to, _, _, least, skip in _FIRST] + [f"CASE WHEN a1.n >= {least} THEN y_{to} END AS {to}" for to, _, _, least in (*_SECOND, *_THIRD)])
    return f"{steps}, {recursion}, k AS (SELECT a1.*, {values} FROM a1 JOIN e ON e.ticker = a1.ticker AND e.n = a1.n)"


def features() -> str:
    """CTEs up to ``f``: the features of each bar, not yet lagged."""
    change = lambda now, then: f"{now} / nullif({then}, 0) - 1"
    sma = {n: full("avg(close)", "close", n) for n in (5, 10, 20, 50, 100, 200)}
    base = ", ".join([f"{x} AS sma_{n}" for n, x in sma.items()] + [
        f"100 * (close - {full('min(low)', 'low', 14)}) / nullif({full('max(high)', 'high', 14)} - {full('min(low)', 'low', 14)}, 0) AS stoch_raw",
        f"{lag('typical')} AS prior_typical", f"sum(coalesce(sign(close - prior), 0) * volume) OVER {_W} ROWS UNBOUNDED PRECEDING) AS obv", "CASE WHEN log_ret < 0 THEN log_ret ELSE 0.0 END AS downside",
        f"{full('avg(typical)', 'typical', 20)} AS tp20", f"list(typical) {frame(20)} AS tl", "((close - low) - (high - close)) / candle * volume AS mfv",
    ])
    flows = "CASE WHEN typical > prior_typical THEN typical * volume ELSE 0.0 END AS flow_up, CASE WHEN typical < prior_typical THEN typical * volume ELSE 0.0 END AS flow_down"
    z = lambda x, n: f"({x} - {full(f'avg({x})', x, n)}) / nullif({full(f'stddev_samp({x})', x, n)}, 0)"
    out: dict[str, str] = {}
    for n in (1, 2, 5, 10, 20, 60, 120, 252):
        out[f"return_{n}d"], out[f"log_return_{n}d"] = change("close", lag("close", n)), f"ln(close / {lag('close', n)})"
    out |= {"gap_return": "open / prior - 1", "candle_body_pct": "abs(close - open) / candle", "upper_shadow_pct": "(high - greatest(close, open)) / candle", "lower_shadow_pct": "(least(close, open) - low) / candle"}
    for name, periods in (("sma", (5, 10, 20, 50, 100, 200)), ("ema", (9, 21, 55))):
        for n in periods:
            out[f"{name}_ratio_{n}"], out[f"{name}_slope_{n}"] = change("close", f"{name}_{n}"), change(f"{name}_{n}", lag(f"{name}_{n}", 5))
    out |= {"macd_line": "(ema_12 - ema_26) / close", "macd_signal": "macd_signal_raw / close", "macd_hist": "(ema_12 - ema_26 - macd_signal_raw) / close", "adx_14": "adx"}
    out |= {f"rsi_{n}": within(f"100 - 100 / (1 + gain_{n} / nullif(loss_{n}, 0))", 0, 100) for n in (7, 14, 28)}
    high14, low14 = full("max(high)", "high", 14), full("min(low)", "low", 14)
    out |= {"stoch_k": within("stoch_raw", 0, 100), "stoch_d": within(full("avg(stoch_raw)", "stoch_raw", 3), 0, 100), "williams_r_14": within(f"-100 * ({high14} - close) / nullif({high14} - {low14}, 0)", -100, 0)}
    out["cci_20"] = "(typical - tp20) / nullif(0.015 * list_sum(list_transform(tl, lambda x: abs(x - tp20))) / 20, 0)"
    out |= {"roc_10": f"100 * ({change('close', lag('close', 10))})", "atr_14": "atr_14", "atr_pct_14": "atr_14 / close"}
    for n in (10, 20, 60):
        out |= {f"hist_vol_{n}": f"{full('stddev_samp(log_ret)', 'log_ret', n)} * sqrt(252)", f"downside_vol_{n}": f"{full('stddev_samp(downside)', 'downside', n)} * sqrt(252)", f"ret_z_{n}": z("log_ret", n)}
    dev = full("stddev_samp(close)", "close", 20)
    out |= {"bb_width": f"4 * {dev} / nullif(sma_20, 0)", "bb_pct": f"(close - (sma_20 - 2 * {dev})) / nullif(4 * {dev}, 0)", "obv": "obv", "obv_slope_20": change("obv", lag("obv", 20))}
    out["vwap_ratio_20"] = change("close", f"({full('sum(typical * volume)', 'typical', 20)} / nullif({full('sum(volume)', 'volume', 20)}, 0))")
    out["mfi_14"] = within(f"100 - 100 / (1 + {full('sum(flow_up)', 'flow_up', 14)} / nullif({full('sum(flow_down)', 'flow_down', 14)}, 0))", 0, 100)
    out |= {"volume_ratio_20": f"volume / nullif({full('avg(volume)', 'volume', 20)}, 0)", "dollar_volume_20": full("avg(dollar_volume)", "dollar_volume", 20), "dollar_volume_z_60": z("dollar_volume", 60)}
    out["cmf_20"] = within(f"{full('sum(mfv)', 'mfv', 20)} / nullif({full('sum(volume)', 'volume', 20)}, 0)", -1, 1)
    out |= {"kc_pct": "(close - (ema_20 - 2 * atr_14)) / nullif(4 * atr_14, 0)", "kc_width": "nullif(4 * atr_14, 0) / ema_20"}
    total = full("sum(tr)", "tr", 14)
    plus, minus = (f"{full(f'sum(abs({a}))', a, 14)} / nullif({total}, 0)" for a in ("high - prior_low", "low - prior_high"))
    out |= {"vi_plus_14": plus, "vi_minus_14": minus, "vi_diff_14": f"{plus} - {minus}", "trix_15": f"100 * ({change('ema3_15', lag('ema3_15'))})"}
    out |= {"elder_bull_13": "(high - ema_13) / close", "elder_bear_13": "(low - ema_13) / close", "dpo_20": f"(close - {lag('sma_20', 11)}) / close"}
    for n in (20, 60, 252):
        top, bottom = full("max(high)", "high", n), full("min(low)", "low", n)
        out |= {f"dist_high_{n}": f"close / {top} - 1", f"dist_low_{n}": f"close / {bottom} - 1", f"drawdown_{n}": f"close / {top} - 1"}
    out |= {"trend_regime_fast": "CASE WHEN close > sma_20 AND sma_20 > sma_50 THEN 1.0 ELSE 0.0 END", "trend_regime_slow": "CASE WHEN close > sma_50 AND sma_50 > sma_200 THEN 1.0 ELSE 0.0 END"}
    names = list(out)
    made = ", ".join(f'{x} AS "f_{k}"' for k, x in out.items())
    lagged = ", ".join(f'{lag(f"""CASE WHEN isfinite("f_{k}") THEN "f_{k}" END""")} AS "{k}"' for k in names)
    ahead = f"lead(close, 5) OVER {_W}) / close - 1"
    return (
        f"b0 AS (SELECT *, {base} FROM k), b1 AS (SELECT *, {flows} FROM b0), f AS (SELECT ticker, date, close, {made} FROM b1), "
        f"g AS (SELECT ticker, date, close, {lagged}, {ahead} AS target_return, CASE WHEN {ahead} IS NOT NULL THEN CAST({ahead} > 0 AS INTEGER) END AS target_direction FROM f)"
    ), names


#: Places by name; the rest have six. Unit prices are cents over up to 50 units: at six places some
#: are ties, which engines round by their last bit; none has more than seven places unless it has no end.
PLACES = {"close": 8, "atr_14": 4, "dollar_volume_20": 1, "obv": 2, "cci_20": 3, "roc_10": 4, "trix_15": 4, "mfi_14": 4, "adx_14": 4, "williams_r_14": 4, "stoch_k": 4, "stoch_d": 4, "rsi_7": 4, "rsi_14": 4, "rsi_28": 4, "ret_z_10": 4, "ret_z_20": 4, "ret_z_60": 4, "dollar_volume_z_60": 4, "obv_slope_20": 4}


def matrix_sql(bars: str) -> str:
    ctes, names = features()
    shown = ", ".join(f'round("{k}", {PLACES.get(k, 6)}) AS "{k}"' for k in names)
    known = " AND ".join(f'"{k}" IS NOT NULL' for k in (*names, "target_return"))
    return f"WITH RECURSIVE {bars}, {smoothed()}, {ctes} SELECT ticker, date, round(close, {PLACES["close"]}) AS close, {shown}, round(target_return, 6) AS target_return, target_direction FROM g WHERE {known}"


def _rank(x: str) -> str:
    """Share of the last 252 values that do not exceed x, ties at their mean, from ten values on."""
    values = f"list({x}) FILTER ({x} IS NOT NULL) {frame(252)}"
    return f"CASE WHEN {x} IS NOT NULL THEN list_transform([{{'v': {values}, 'x': {x}}}], lambda s: CASE WHEN len(s.v) >= 10 THEN (len(list_filter(s.v, lambda y: y < s.x)) + (len(list_filter(s.v, lambda y: y = s.x)) + 1) / 2.0) / len(s.v) END)[1] END"


def _corr(x: str, y: str, n: int) -> str:
    both = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END"
    flat = f"stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) {frame(n)} * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END) {frame(n)} > 1e-24"
    return f"CASE WHEN count({both}) {frame(n)} >= {n} AND {flat} THEN corr({x}, {y}) {frame(n)} END"


ZOO_PLACES = {"rsi_14": 4, "adx_14": 4, "macd_histogram": 4, "alpha003": 5, "alpha006": 5, "alpha012": 9, "alpha041": 3, "amihud_21": 15}


def zoo_sql(bars: str) -> str:
    dev, mid = full("stddev_samp(close)", "close", 20), full("avg(close)", "close", 20)
    total = full("sum(tr)", "tr", 14)
    plus, minus = (f"{full(f'sum(abs({a}))', a, 14)} / nullif({total}, 0)" for a in ("high - prior_low", "low - prior_high"))
    out = {
        "rsi_14": "rsi", "macd_histogram": "ema_12 - ema_26 - macd_signal_raw", "bb_pct_20": f"(close - ({mid} - 2 * {dev})) / nullif(4 * {dev}, 0)", "adx_14": "adx",
        "cmf_20": within(f"{full('sum(mfv)', 'mfv', 20)} / nullif({full('sum(volume)', 'volume', 20)}, 0)", -1, 1), "volume_ratio_20": f"volume / nullif({full('avg(volume)', 'volume', 20)}, 0)",
        "vortex_diff_14": f"{plus} - {minus}", "return_5d": f"close / nullif({lag('close', 5)}, 0) - 1", "sma_ratio_20": f"close / nullif({mid}, 0) - 1",
        "alpha003": f"-{_corr('rank_open', 'rank_volume', 10)}", "alpha006": f"-{_corr('open', 'volume', 10)}", "alpha001": f"{_rank('peak')} - 0.5", "alpha012": f"sign(volume - {lag('volume')}) * -(close - prior)",
        "alpha041": f"sqrt(high * low) - {full('sum(typical * volume)', 'typical', 5)} / nullif({full('sum(volume)', 'volume', 5)}, 0)", "alpha054": "-(low - close) * pow(open, 5) / nullif((low - high) * pow(close, 5), 0)",
        "alpha101": "(close - open) / (high - low + 0.001)", "size": "CASE WHEN market_cap > 0 THEN ln(market_cap) END", "value": "list_avg(list_filter([CASE WHEN pe > 0 THEN 1 / pe END, CASE WHEN pb > 0 THEN 1 / pb END, CASE WHEN ev_ebitda > 0 THEN 1 / ev_ebitda END], lambda x: x IS NOT NULL))",
        "quality": "0.12 - net_income / nullif(ocf, 0)", "momentum_12_1": f"{lag('close', 21)} / nullif({lag('close', 252)}, 0) - 1", "volatility_60d": full("stddev_samp(day_return)", "day_return", 60),
        "amihud_21": full("avg(illiquid)", "illiquid", 21), "trend_cross": "CASE WHEN n < 60 THEN 0.0 ELSE coalesce(CAST(ema_12 > ema_26 AND rsi < 70 AND coalesce(weekly, 1) > 0 AS DOUBLE), 0.0) END",
    }
    shown = ", ".join(f'round({x}, {ZOO_PLACES.get(k, 6)}) AS "{k}"' for k, x in out.items())
    rsi = within("100 - 100 / (1 + gain_14 / nullif(loss_14, 0))", 0, 100)
    return f"""WITH RECURSIVE {bars}, {smoothed()},
w9 AS (SELECT ticker, date_trunc('week', date)::DATE AS week, arg_max(close, date) AS c FROM bars GROUP BY ALL),
s9 AS (SELECT ticker, week, CASE WHEN count(c) OVER p >= 12 THEN CAST(avg(c) OVER f > avg(c) OVER p AS DOUBLE) END AS weekly FROM w9
  WINDOW p AS (PARTITION BY ticker ORDER BY week ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY ticker ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
f9 AS (SELECT p_brand AS ticker, sum(p_retailprice) * 1e4 AS market_cap, avg(p_size) AS pe, avg(p_size) / 10 AS pb, avg(p_retailprice) AS ev_ebitda, sum(p_size)::DOUBLE AS net_income, sum(p_retailprice) AS ocf FROM part GROUP BY p_brand),
z0 AS (SELECT k.*, close / nullif(prior, 0) - 1 AS day_return, {rsi} AS rsi, ((close - low) - (high - close)) / candle * volume AS mfv, {_rank("open")} AS rank_open, {_rank("volume")} AS rank_volume FROM k),
z1 AS (SELECT *, {full("stddev_samp(day_return)", "day_return", 20)} AS std_20, abs(day_return) / nullif(dollar_volume, 0) AS illiquid FROM z0), z2 AS (SELECT *, pow(CASE WHEN day_return < 0 THEN std_20 ELSE close END, 2) AS powered FROM z1),
z3 AS (SELECT *, list(powered) FILTER (powered IS NOT NULL) {frame(5)} AS five FROM z2), z4 AS (SELECT z3.*, CASE WHEN len(five) >= 5 THEN CAST(list_position(five, list_max(five)) - 1 AS DOUBLE) END AS peak, weekly, market_cap, pe, pb, ev_ebitda, net_income, ocf
  FROM z3 LEFT JOIN s9 ON s9.ticker = z3.ticker AND s9.week = date_trunc('week', z3.date)::DATE LEFT JOIN f9 ON f9.ticker = z3.ticker)
SELECT ticker, date, {shown} FROM z4"""
