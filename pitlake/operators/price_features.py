"""Price features of the panel: one pass of windows by security, sampled at rebalance dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.exprs import nullify, safe_div, trailing, trailing_agg
from pitlake.operators.panel import session_return

YEAR = 252


def market_return(panel: DataFrame, least: int = 20) -> DataFrame:
    """session_index, mkt: mean return of priced members; null with fewer than `least`."""
    inside = F.when(F.col("in_index"), F.col("ret"))
    return panel.groupBy("session_index").agg(F.when(F.count(inside) >= least, F.avg(inside)).alias("mkt"))


def with_returns(panel: DataFrame, least: int = 20) -> DataFrame:
    """panel with ret, log overnight and intraday legs, and the market's return of the session.

    The market has a row a session, so it is joined by broadcast however many securities there are.
    """
    w = Window.partitionBy("security_id").orderBy("session_index")
    adjacent = F.lag("session_index").over(w) == F.col("session_index") - 1
    rows = panel.withColumns(
        {
            "ret": session_return(),
            "leg_on": F.when(adjacent & (F.lag("close").over(w) > 0) & (F.col("open") > 0), F.ln(F.col("open") / F.lag("close").over(w))),
            "leg_id": F.when((F.col("open") > 0) & (F.col("close") > 0), F.ln(F.col("close") / F.col("open"))),
        }
    )
    return rows.join(F.broadcast(market_return(rows, least)), "session_index", "left")


def ratio_back(column: str, skip: int, lookback: int) -> Column:
    """column[t - skip] / column[t - skip - lookback] - 1, each read from exactly that session (a one-row range frame)."""

    def at(k: int) -> Column:
        return F.max(column).over(Window.partitionBy("security_id").orderBy("session_index").rangeBetween(-k, -k)) if k else F.col(column)

    old = at(skip + lookback)
    return F.when(old > 0, at(skip) / old - 1)


def beta_parts(window: int = YEAR, least: int = 63) -> tuple[Column, Column]:
    """Rolling beta and correlation with the market from population moments. The market's own moments take all
    sessions of the window, the joint ones those in which both are known; correlation is kept within +-1."""
    w = trailing("session_index", window, ["security_id"])
    both = F.when(F.col("ret").isNotNull() & F.col("mkt").isNotNull(), F.col("ret") * F.col("mkt"))
    ri = F.when(both.isNotNull(), F.col("ret"))
    mi = F.when(both.isNotNull(), F.col("mkt"))
    cov = F.avg(both).over(w) - F.avg(ri).over(w) * F.avg(mi).over(w)
    var_m = F.avg(F.col("mkt") * F.col("mkt")).over(w) - F.pow(F.avg("mkt").over(w), 2)
    var_r = F.avg(ri * ri).over(w) - F.pow(F.avg(ri).over(w), 2)
    enough = F.count(both).over(w) >= least
    corr = F.when(enough & (var_m > 0) & (var_r > 0), cov / F.sqrt(F.when(var_m * var_r > 0, var_m * var_r)))
    return F.when(enough & (var_m > 0), cov / var_m), F.when(corr.isNotNull(), F.greatest(F.least(corr, F.lit(1.0)), F.lit(-1.0)))


def price_features(panel: DataFrame, least_market: int = 20, year: int = YEAR, scale: int = 1) -> DataFrame:
    """panel (security_id, session_index, open, close, dollar_volume, half_spread, in_index) with the price features.

    `scale` divides all window lengths, for short histories. Windows go by session number, so missing bars take
    their place; minimum counts are of values. Everything is clustered by security once.
    """

    def n(x: int) -> int:
        return max(2, x // scale)

    def w(width: int, skip: int = 0):
        return trailing("session_index", n(width), ["security_id"], skip // scale)

    def agg(a: Column, c: Column | str, width: int, least: int, skip: int = 0) -> Column:
        return trailing_agg(a, F.col(c) if isinstance(c, str) else c, w(width, skip), n(least))

    rows = with_returns(panel, least_market)
    beta, corr = beta_parts(n(year), n(63))
    rows = rows.withColumns({"beta_252d": beta, "corr_mkt_252d": corr, "vol_126d": agg(F.stddev_samp("ret"), "ret", 126, 63) * F.sqrt(F.lit(float(year)))})
    rows = rows.withColumn("resid", F.col("ret") - F.col("beta_252d") * F.col("mkt"))
    up, down = F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double")), F.when(F.col("ret").isNotNull(), (F.col("ret") < 0).cast("double"))
    k = n(21)
    s_n, s_m, s_s = F.count("ret").over(w(year)), F.avg("ret").over(w(year)), F.stddev_pop("ret").over(w(year))
    third = F.avg(F.pow("ret", F.lit(3))).over(w(year)) - 3 * s_m * F.avg(F.pow("ret", F.lit(2))).over(w(year)) + 2 * F.pow(s_m, F.lit(3))
    skew = F.when((s_n >= n(126)) & (s_n > 2) & (s_s > 0), third / F.pow(s_s, F.lit(3)) * F.sqrt(s_n * (s_n - 1)) / (s_n - 2))
    mom = ratio_back("close", k, n(252))
    illiq = F.when(F.col("dollar_volume") > 0, F.abs("ret") / F.col("dollar_volume") * 1e9)
    cols = {
        "mom_12_1": mom,
        "mom_6_1": ratio_back("close", k, n(126)),
        "mom_1m": ratio_back("close", 0, k),
        "rev_1m": -ratio_back("close", 0, k),
        "ret_3m": ratio_back("close", 0, n(63)),
        "ret_12m": ratio_back("close", 0, n(252)),
        "mom_on_12_1": F.expm1(agg(F.sum("leg_on"), "leg_on", 252, 126, 21)),
        "mom_id_12_1": F.expm1(agg(F.sum("leg_id"), "leg_id", 252, 126, 21)),
        "on_minus_id_252d": agg(F.sum("leg_on"), "leg_on", 252, 126) - agg(F.sum("leg_id"), "leg_id", 252, 126),
        "trend_200d": safe_div(F.col("close"), agg(F.avg("close"), "close", 200, 100)) - 1,
        "high_52w_ratio": safe_div(F.col("close"), agg(F.max("close"), "close", 252, 126)),
        "resid_mom_12_1": safe_div(agg(F.sum("resid"), "resid", 252, 126, 21), agg(F.stddev_samp("resid"), "resid", 252, 126, 21) * F.sqrt(F.lit(float(year)))),
        "info_discreteness": F.signum(mom) * (agg(F.avg(down), "ret", 252, 126, 21) - agg(F.avg(up), "ret", 252, 126, 21)),
        "vol_21d": agg(F.stddev_samp("ret"), "ret", 21, 15) * F.sqrt(F.lit(float(year))),
        "vol_of_vol_252d": agg(F.stddev_samp("vol_126d"), "vol_126d", 252, 126),
        "skew_252d": skew,
        "max_ret_21d": agg(F.max("ret"), "ret", 21, 10),
        "idio_vol_252d": agg(F.stddev_samp("resid"), "resid", 252, 126) * F.sqrt(F.lit(float(year))),
        "amihud_illiq": F.log1p(agg(F.avg(illiq), illiq, 63, 30)),
        "log_dollar_volume": F.when(F.col("dollar_volume") > 0, F.ln("dollar_volume")),
        "half_spread_bp": F.col("half_spread") * 1e4,
    }
    names = [*cols, "beta_252d", "corr_mkt_252d", "vol_126d"]
    rows = rows.withColumns(cols)
    return rows.select("security_id", "session_index", "date", "in_index", "is_month_end", "close", "dollar_volume", *[nullify(F.col(c).cast("double")).cast("float").alias(c) for c in names])


def market_state(panel: DataFrame, least: int = 20, scale: int = 1) -> DataFrame:
    """Per session: level trend, drawdown, volatilities, their ratio and breadth of the equal-weight market."""

    def n(x: int) -> int:
        return max(2, x // scale)

    rows = panel if "ret" in panel.columns else panel.withColumn("ret", session_return())
    own = trailing("session_index", n(200), ["security_id"])
    above = F.when(F.count("close").over(own) >= n(100), (F.col("close") > F.avg("close").over(own)).cast("double"))
    rows = rows.withColumn("_above", F.when(F.col("in_index"), above))
    inside = F.when(F.col("in_index"), F.col("ret"))
    days = rows.groupBy("session_index").agg(
        F.when(F.count(inside) >= least, F.avg(inside)).alias("mkt"),
        F.when(F.count("_above") >= least, F.avg("_above")).alias("mkt_breadth_200d"),
    )
    w = Window.orderBy("session_index")
    days = days.withColumn("level", F.exp(F.sum(F.log1p(F.coalesce("mkt", F.lit(0.0)))).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    days = days.withColumn("_top", F.max("level").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def agg(a: Column, c: str, width: int, m: int) -> Column:
        return trailing_agg(a, F.col(c), trailing("session_index", n(width)), n(m))

    short, long_ = agg(F.stddev_samp("mkt"), "mkt", 21, 10), agg(F.stddev_samp("mkt"), "mkt", 252, 126)
    return days.select(
        "session_index",
        (F.col("level") / agg(F.avg("level"), "level", 200, 100) - 1).alias("mkt_trend_200d"),
        (F.col("level") / F.col("_top") - 1).alias("mkt_drawdown"),
        (short * F.sqrt(F.lit(252.0))).alias("mkt_vol_21d"),
        (long_ * F.sqrt(F.lit(252.0))).alias("mkt_vol_252d"),
        safe_div(short, long_).alias("mkt_vol_ratio"),
        "mkt_breadth_200d",
    )
