"""Fixed values of the signal model: thresholds, weights and name lists."""

from __future__ import annotations

IST = "Asia/Kolkata"
LOOKBACK = 250
ADAPTIVE_PERIODS = 252
HOT_KEY_SPLITS = 8  # parts in which a key is ranked before its best rows meet
SEGMENT_ROWS = 4_000_000  # rows of a key that one task carries values through

# Sector name parts, matched in this order.
SECTORS = {
    "IT": ["Tata Consultancy Services", "Infosys", "HCL Technologies", "Wipro", "Tech Mahindra"],
    "BANKING": ["HDFC Bank", "ICICI Bank", "State Bank of India", "Kotak Mahindra Bank"],
    "FMCG": ["Hindustan Unilever", "ITC", "Nestle India", "Britannia"],
    "AUTO": ["Maruti Suzuki India Ltd", "Tata Motors", "Bajaj Auto", "Hero MotoCorp"],
    "METALS": ["Tata Steel", "JSW Steel", "Hindalco", "Vedanta"],
    "PHARMA": ["Sun Pharma", "Dr Reddys Labs", "Cipla", "Lupin"],
    "ENERGY": ["Reliance Industries", "ONGC", "NTPC", "Power Grid"],
    "INFRA": ["Larsen & Toubro", "UltraTech Cement", "Adani Ports"],
}
OTHER_SECTOR = "OTHER"

# Sensitivity of a sector to the currency move.
CURRENCY_IMPACT = {
    "IT": 0.6,
    "PHARMA": 0.4,
    "ENERGY": -0.3,
    "AUTO": -0.2,
    "BANKING": 0.0,
    "FMCG": -0.1,
}

# Component weights of the unified signal.
WEIGHTS = {
    "trajectory": 0.25,
    "quant": 0.20,
    "technical": 0.20,
    "orderbook": 0.15,
    "market_regime": 0.20,
}

# Thresholds and multipliers.
VOLATILITY_MULTIPLIER = 1.18
RSI_OVERBOUGHT = 80
RSI_OVERSOLD = 20
ADX_TRENDING = 25
ADX_RANGING = 20
TREND_CONSISTENCY_MIN = 0.6
RISK_FREE_RATE = 0.07
TRADING_DAYS = 252
PERSISTENCE_THRESHOLD = 0.60
HOLD_THRESHOLD = 0.20
PORTFOLIO_VALUE = 100_000.0
RISK_PCT = 0.01
PLAN_PORTFOLIO_VALUE = 1_000_000.0
PLAN_RISK_PCT = 0.02
HISTORY_LIMIT = 240
INDICATOR_HISTORY_LIMIT = 100
EXECUTION_TIMEFRAME = "1H"
CONTEXT_TIMEFRAME = "1D"

MOMENTUM_SPANS = (3, 7, 14, 21)
REVERSION_PERIODS = (5, 10, 20)
VOLUME_PERIODS = (5, 10, 20)
STOP_WEIGHTS = {"var": 0.25, "volatility": 0.20, "atr": 0.25, "support": 0.20, "percentile": 0.10}
SCORE_WEIGHTS = {
    "momentum": 0.25,
    "mean_reversion": 0.20,
    "volatility": 0.20,
    "support_resistance": 0.15,
    "volume": 0.10,
    "risk_reward": 0.10,
}
