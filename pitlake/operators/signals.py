"""Scores from features, and strategies as score columns over the features of a date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.functions.exprs import blend, conditional, rank_pct, zscore

BY = ["date"]


def rank(c: str | Column) -> Column:
    """Percentile rank among the eligible names of a date."""
    c = F.col(c) if isinstance(c, str) else c
    return rank_pct(F.when(F.col("eligible"), c), BY)


def require(features: DataFrame, *names: str) -> DataFrame:
    """Narrow eligibility to names that have all features."""
    ok = F.col("eligible")
    for n in names:
        ok = ok & F.col(n).isNotNull()
    return features.withColumn("eligible", ok)


REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


def strategy(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a strategy: from features (date, security_id, eligible, ...) to the same rows with `score`."""
    REGISTRY[f.__name__] = f
    return f


def _scored(features: DataFrame, c: Column) -> DataFrame:
    return features.withColumn("score", c)


@strategy
def equal_weight(x):
    return _scored(x, F.when(F.col("eligible"), F.lit(1.0)))


@strategy
def momentum_12_1(x):
    return _scored(x, F.col("mom_12_1").cast("double"))


@strategy
def low_vol(x):
    return _scored(x, -F.col("vol_126d").cast("double"))


@strategy
def random_weight(x):
    """Uniform by hash of date and security: the same on every run."""
    return _scored(x, F.pmod(F.xxhash64("date", "security_id"), F.lit(1 << 30)) / (1 << 30))


@strategy
def short_reversal(x):
    return _scored(x, -F.col("mom_1m").cast("double"))


@strategy
def cash(x):
    return _scored(x, F.lit(None).cast("double"))


@strategy
def residual_momentum(x):
    return _scored(x, rank("resid_mom_12_1"))


@strategy
def frog_in_the_pan(x):
    return _scored(x, conditional(rank("mom_12_1"), rank("info_discreteness"), 0.5, high=False))


@strategy
def lottery_averse(x):
    return _scored(x, blend([(rank(-F.col("max_ret_21d")), 0.4), (rank(-F.col("skew_252d")), 0.4), (rank(-F.col("idio_vol_252d")), 0.2)], 2))


@strategy
def illiquidity_carry(x):
    return _scored(x, F.when(rank("log_dollar_volume") > 0.1, rank("amihud_illiq")))


@strategy
def overnight_momentum(x):
    return _scored(x, rank("mom_on_12_1"))


@strategy
def week52_breakout(x):
    return _scored(x, rank("high_52w_ratio"))


@strategy
def my_first_idea(x):
    return _scored(x, blend([(rank("mom_6_1"), 1.0), (rank(-F.col("vol_126d")), 1.0), (rank("trend_200d"), 1.0)], 2))


@strategy
def multi_factor(x):
    mom = blend([(rank("mom_12_1"), 1.0), (rank("resid_mom_12_1"), 1.0)])
    low = blend([(rank(-F.col("vol_126d")), 1.0), (rank(-F.col("beta_252d")), 1.0)])
    liq = blend([(rank("amihud_illiq"), 1.0)])
    lot = blend([(rank(-F.col("max_ret_21d")), 1.0), (rank(-F.col("skew_252d")), 1.0)])
    return _scored(x, blend([(mom, 1.0), (low, 1.0), (liq, 1.0), (lot, 1.0)], 3))


def value_strategies() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Strategies over fundamental features, where the features have them."""
    return {
        "pead_drift": lambda x: _scored(x, F.when(F.col("days_since_filing") <= 100, rank("eps_surprise"))),
        "accrual_quality": lambda x: _scored(x, blend([(rank(-F.col("accruals")), 0.7), (rank("cf_yield"), 0.3)])),
        "quality_value": lambda x: _scored(x, blend([(rank(c), 1.0) for c in ("book_to_market", "earnings_yield", "gross_profitability", "roe")] + [(rank(-F.col("accruals")), 1.0)], 3)),
        "restatement_averse": lambda x: _scored(x, blend([(rank(-F.col("restatement_rate")), 0.65), (rank("earnings_yield"), 0.35)])),
        "index_entry_drift": lambda x: _scored(x, F.when(F.col("months_in_index") <= 12, -F.col("months_in_index").cast("double"))),
        "dividend_grower": lambda x: _scored(x, F.when(F.coalesce(F.col("div_cut"), F.lit(0.0)) == 0, blend([(rank("div_growth_1y"), 0.5), (rank("div_yield"), 0.5)]))),
        "div_month": lambda x: _scored(x, F.when(F.col("div_due_1m") > 0, rank("div_yield"))),
    }


def defensive_regime(x: DataFrame) -> DataFrame:
    """Low volatility in stress (market below trend, or its volatility ratio over 1.5), momentum otherwise; gross halves in stress."""
    stress = (F.col("mkt_trend_200d") < 0) | (F.col("mkt_vol_ratio") > 1.5)
    return x.withColumns({"score": F.when(stress, rank(-F.col("vol_126d"))).otherwise(rank("mom_12_1")), "gross": F.when(stress, 0.5).otherwise(1.0)})


def vol_managed(x: DataFrame) -> DataFrame:
    """Momentum with gross 1 / ratio squared of market volatilities, between 0.2 and 1."""
    g = 1 / (F.col("mkt_vol_ratio") * F.col("mkt_vol_ratio"))
    return x.withColumns({"score": rank("mom_12_1"), "gross": F.coalesce(F.greatest(F.least(g, F.lit(1.0)), F.lit(0.2)), F.lit(1.0))})


def ensemble_rank(x: DataFrame, members: list[str], least: int = 3) -> DataFrame:
    """Mean of the members' re-ranked scores where at least `least` have one."""
    for m in members:
        x = REGISTRY[m](x).withColumn(f"_m_{m}", F.col("score")).drop("score")
    x = x.withColumns({f"_r_{m}": rank(f"_m_{m}") for m in members})
    return _scored(x, blend([(F.col(f"_r_{m}"), 1.0) for m in members], least)).drop(*[f"_{k}_{m}" for k in "mr" for m in members])


def weighted_rank_sum(x: DataFrame, weights: dict[str, float], dead: float = 0.05, most: int | None = None) -> DataFrame:
    """A genome as a strategy: weights within the dead zone are nothing, at most `most` of the largest count; the score is
    the missing-tolerant weighted mean of feature ranks."""
    live = {k: w for k, w in weights.items() if abs(w) >= dead}
    if most is not None:
        live = dict(sorted(live.items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:most])
    return _scored(x, blend([(rank(k), w) for k, w in live.items()]) if live else F.lit(None).cast("double"))


def evolved_blend(x: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The weighted sum of features' z-scores over the eligible names, not clipped; without one of them there is no score."""
    eligible = {c: F.when(F.col("eligible"), F.col(c).cast("double")) for c in weights}
    z = {c: zscore(e, ["date"], None) for c, e in eligible.items()}
    return _scored(x, sum((F.lit(w) * z[c] for c, w in weights.items()), F.lit(0.0)))
