"""Fixed values that define the results: word lists, weights, windows and thresholds. Operators take them as parameters."""

# Item scoring.
QUALITY_WEIGHTS = {"low": 5, "medium": 15, "high": 25}
HYPE_TERMS = ("moon", "vertical", "obviously", "shorts get wrecked", "insane", "everyone knows", "no spreadsheet needed")
SPECIFICITY_TERMS = (
    "revenue", "margin", "cash flow", "free cash flow", "guidance", "capex", "liquidity", "customer concentration", "dilution", "commercial",
)
RISK_TERMS = ("risk", "dilution", "execution", "liquidity", "margin", "capex", "customer concentration")
NO_EVIDENCE_TERMS = ("no spreadsheet needed", "everyone knows", "obviously")
SUMMARY_TERMS = ("margin", "revenue", "cash", "risk", "guidance")
FINANCE_TERMS = (
    "revenue", "margin", "margins", "cash flow", "free cash flow", "guidance", "earnings", "contract", "contracts", "customer", "customers",
    "valuation", "capex", "tam", "filing", "10-k", "10-q", "gross margin", "ebitda",
)
REPETITION_PHRASES = ("to the moon", "easy money", "next tesla", "guaranteed", "can't lose", "obviously")

# The deterministic classifier.
BULLISH_TERMS = ("undervalued", "growth", "winning", "margin", "cash flow", "bull", "upside", "improving")
BEARISH_TERMS = ("risk", "dilution", "overvalued", "thin", "skeptical", "bear", "execution", "concern")
FALLBACK_HYPE_TERMS = ("moon", "vertical", "obviously", "shorts", "wrecked", "insane", "easy money", "guaranteed")

# Entities.
AMBIGUOUS_SYMBOLS = ("A", "AI", "ALL", "AM", "ARE", "AT", "BE", "CAN", "FOR", "GO", "HAS", "IT", "NOW", "ON", "SO", "TO", "UP", "WE")
MEGA_CAPS = ("TSLA", "NVDA", "AAPL", "MSFT", "META", "AMZN", "GOOGL")
MARKET_SYMBOLS = {"SQ": "XYZ"}

# Horizons in price rows and in calendar days.
ROW_HORIZONS = {"1d": 1, "3d": 3, "5d": 5, "10d": 10, "20d": 20, "1m": 21}
DAY_HORIZONS = (1, 3, 7, 14, 30)
ATTENTION_WINDOWS = (7, 14, 30)

# Signal gates.
GATES = {
    "top_rank": 5, "emerging": 60.0, "acceleration": 20.0, "coverage": 0.5, "mentions": 3, "authors": 2, "threads": 2,
    "cooldown_hours": 24, "cooldown_delta": 12.0, "benchmark_sample": 12,
}

# Review presets (sentiments, then least confidence, depth and alpha, most hype, and the switches that are on).
ALL_SENTIMENTS = ("bullish", "bearish", "neutral", "irrelevant")
DECIDED = ("bullish", "bearish", "neutral")
REVIEW_PRESETS = {
    "balanced": (ALL_SENTIMENTS, 0.0, 0, 0.0, 10, ()),
    "high_signal": (DECIDED, 0.45, 4, 65.0, 7, ("hide_hype",)),
    "low_hype_leads": (DECIDED, 0.35, 0, 55.0, 4, ("hide_hype", "low_signal")),
    "new_tickers": (ALL_SENTIMENTS, 0.0, 0, 0.0, 10, ("new",)),
    "needs_verification": (DECIDED, 0.0, 0, 0.0, 10, ("deeper",)),
}
