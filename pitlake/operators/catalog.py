"""The features by family, with their meaning; `describe` gives them as a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: family -> feature -> meaning
FEATURES: dict[str, dict[str, str]] = {
    "momentum": {
        "mom_12_1": "return over 252 sessions up to 21 sessions ago", "mom_6_1": "return over 126 sessions up to 21 sessions ago", "mom_1m": "return over 21 sessions", "rev_1m": "the same, negated",
        "ret_3m": "return over 63 sessions", "ret_12m": "return over 252 sessions", "mom_on_12_1": "overnight part of the year's return, 21 sessions ago", "mom_id_12_1": "intraday part of it",
        "on_minus_id_252d": "log overnight less log intraday return of 252 sessions", "trend_200d": "close over its 200-session mean, less 1", "high_52w_ratio": "close over its 252-session high",
        "resid_mom_12_1": "sum of market-model residuals over their deviation", "info_discreteness": "sign of the year's return by share of falling less rising days",
    },
    "risk": {
        "vol_21d": "annual deviation of 21 returns", "vol_126d": "annual deviation of 126 returns", "vol_of_vol_252d": "deviation of vol_126d over 252 sessions", "skew_252d": "skewness of 252 returns",
        "max_ret_21d": "largest of 21 returns", "beta_252d": "beta to the equal-weight market", "corr_mkt_252d": "correlation with it", "idio_vol_252d": "annual deviation of residuals",
    },
    "liquidity": {"amihud_illiq": "log of mean absolute return by value traded", "log_dollar_volume": "log of median value traded", "half_spread_bp": "half spread in basis points", "log_market_cap": "log of market value"},
    "membership": {"months_in_index": "month ends in a row as a member", "new_member": "at most three of them", "log_tenure": "log of them"},
    "dividends": {"div_yield": "dividends of 372 days over price", "div_growth_1y": "against the 372 days before", "div_cut": "under 95 % of those", "pays_dividend": "any at all", "div_due_1m": "the next one is due"},
    "valuation": {"book_to_market": "equity by market value", "earnings_yield": "net income by market value", "cf_yield": "cash flow by market value", "buyback_yield": "repurchases by market value"},
    "quality": {
        "gross_profitability": "gross profit by assets", "roe": "net income by equity", "accruals": "net income less cash flow by assets", "capex_intensity": "investment by assets", "rnd_intensity": "research by revenue",
        "cash_ratio": "cash by assets", "current_ratio": "current assets by current liabilities", "leverage": "one less equity by assets", "debt_to_assets": "debt by assets",
    },
    "growth": {"asset_growth": "assets against a year ago", "sales_growth": "revenue against a year ago", "earnings_growth": "net income against a year ago", "eps_surprise": "quarterly change over its deviation", "eps_change_yoy": "earnings a share against a year ago"},
    "filing": {"days_since_filing": "age of the last filing", "filing_lag_days": "days from period to filing", "restatement_rate": "share of facts that were revised"},
    "macro": {f"{s}{t}": f"{s} {'change over 63 sessions' if t else 'level, known a session ago'}" for s in ("vix", "term_spread", "term_spread_3m", "ust10y", "fed_funds", "hy_spread", "ig_spread", "dollar_index", "oil") for t in ("", "_chg_63d")} | {"vix_relative": "vix over its median of 252 sessions"},
    "market": {
        "mkt_trend_200d": "market level over its 200-session mean, less 1", "mkt_drawdown": "market level below its peak", "mkt_vol_21d": "annual deviation of 21 market returns", "mkt_vol_252d": "of 252", "mkt_breadth_200d": "share of members above their 200-session mean",
        "mkt_vol_ratio": "short over long deviation",
    },
}


def names() -> list[str]:
    return [n for fam in FEATURES.values() for n in fam]


def describe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(fam, n, t) for fam, own in FEATURES.items() for n, t in own.items()], "family string, feature string, meaning string")


def undocumented(df: DataFrame, keys: tuple[str, ...] = ("date", "security_id", "session_index")) -> list[str]:
    """Columns of a feature frame that the catalogue does not know."""
    return sorted(set(df.columns) - set(names()) - set(keys))
