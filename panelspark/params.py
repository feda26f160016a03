"""Fixed values and parameters.

Values in this file must equal published ones for results to be comparable.
"""

from __future__ import annotations

# --- fixed values: study layout -------------------------------------------------
HORIZONS = (1, 5, 10)
LOOKBACK = 30
CONTEXT = 500
N_WINDOWS = 30
STEP = 10
TRAIN_SHARE = 0.8
N_LAGS = 30
ROLLING = (7, 14, 30)

BASELINE_MODELS = ("arima", "lstm", "xgboost", "itransformer")
LANGUAGE_MODELS = ("llama3-8b", "qwen2.5-7b", "mistral-7b")

# config -> (news, prompt)
FACTORS = {
    "baseline_llm": (False, "zero"),
    "news_only": (True, "zero"),
    "prompt_only": (False, "few"),
    "full_model": (True, "few"),
}
CONFIGS = tuple(FACTORS)

# named subsets of the grid
ABLATIONS = {
    "news": ("baseline_llm", "news_only"),
    "prompt": ("baseline_llm", "prompt_only"),
    "interaction": CONFIGS,
}

# --- fixed values: token format ---------------------------------------------------
N_BINS = 10_000
TOKEN_PATTERN = r"###([+-]?\d+\.\d+)###"
TOKEN_FORMAT = "###%.4f###"
TOKEN_SEPARATOR = "  "

# --- fixed values: column aliases of result files ---------------------------------
ALIASES = {
    "pair": "currency",
    "fx_pair": "currency",
    "symbol": "currency",
    "h": "horizon",
    "horizon_days": "horizon",
    "directional_accuracy": "da",
    "dir_acc": "da",
    "acc": "da",
}
METRICS = ("rmse", "mae", "mape", "da")

# --- fixed values: words looked for in explanations ---------------------------------
FACTOR_TERMS = {
    "monetary_policy": (
        "interest rate", "central bank", "rate hike", "rate cut", "monetary",
        "fed", "boe", "ecb", "bank indonesia", "bi rate",
    ),
    "trade_balance": ("trade", "export", "import", "current account", "surplus", "deficit"),
    "inflation": ("inflation", "cpi", "consumer price", "ppi", "deflation"),
    "risk_sentiment": (
        "risk", "sentiment", "safe haven", "uncertainty", "confidence", "geopolit", "war", "tension",
    ),
    "economic_growth": ("gdp", "growth", "recession", "economic", "employment", "unemployment", "jobs"),
    "market_technical": (
        "trend", "momentum", "support", "resistance", "moving average", "volatility",
        "overbought", "oversold",
    ),
    "commodity": ("oil", "gold", "commodity", "crude", "energy", "metal"),
}
CONNECTORS = (
    "because", "due to", "driven by", "as a result", "following", "amid", "despite",
    "given", "reflecting", "supported by", "weighed by",
)
