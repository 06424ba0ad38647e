"""Performance statistics of equity curves (run_id, date, nav): one window pass for returns, one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.exprs import kurtosis, norm_cdf_sql, norm_ppf_sql, safe_div, sharpe_se, skewness

RUN = "run_id"


def returns(curves: DataFrame) -> DataFrame:
    """curves with ret, the drawdown and days since the row before."""
    w = Window.partitionBy(RUN).orderBy("date")
    top = F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag("nav").over(w)
    return curves.withColumns({"ret": F.when(before > 0, F.col("nav") / before - 1), "drawdown": F.when(top > 0, F.col("nav") / top - 1), "gap": F.datediff("date", F.lag("date").over(w))})


def periods_per_year(gap: Column) -> Column:
    """252, 52, 12, 4 or 1 by the median gap in days."""
    return F.when(gap <= 4, 252).when(gap <= 10, 52).when(gap <= 45, 12).when(gap <= 120, 4).otherwise(1)


def performance(curves: DataFrame, risk_free: float = 0.0, benchmark: DataFrame | None = None) -> DataFrame:
    """A row per run: total, cagr, vol, sharpe, sortino, max_drawdown with its dates, calmar, hit, skew, kurt, best, worst,
    under_water, var5, cvar5; with a benchmark (date, bench) beta, alpha, tracking_error, information_ratio."""
    r = returns(curves)
    freq = r.groupBy(RUN).agg(F.percentile("gap", F.lit(0.5)).alias("_gap"))
    r = r.join(freq, RUN).withColumn("ppy", periods_per_year(F.col("_gap")).cast("double"))
    if benchmark is not None:
        w = Window.orderBy("date")
        b = benchmark.withColumn("bret", F.when(F.lag("bench").over(w) > 0, F.col("bench") / F.lag("bench").over(w) - 1))
        r = r.join(F.broadcast(b.select("date", "bret")), "date", "left").withColumn("ex", F.col("ret") - F.col("bret"))
    q5 = r.groupBy(RUN).agg(F.percentile("ret", F.lit(0.05)).alias("_q5"))
    r = r.join(q5, RUN)
    trough = F.struct("drawdown", "date")
    aggs = [
        F.first("ppy").alias("ppy"), F.count("ret").alias("n"), F.min_by("nav", "date").alias("first"), F.max_by("nav", "date").alias("last"), F.datediff(F.max("date"), F.min("date")).alias("days"),
        F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("down"), F.min(trough).alias("worst_dd"),
        F.avg((F.col("ret") > 0).cast("double")).alias("hit"), skewness(F.col("ret")).alias("skew"), kurtosis(F.col("ret")).alias("kurt"), F.max("ret").alias("best"), F.min("ret").alias("worst"),
        F.avg((F.col("drawdown") < 0).cast("double")).alias("under_water"), F.first("_q5").alias("var5"),
        F.when(F.count("ret") <= 20, F.min("ret")).otherwise(F.avg(F.when(F.col("ret") <= F.col("_q5"), F.col("ret")))).alias("cvar5"),
    ]
    if benchmark is not None:
        aggs += [
            safe_div(F.covar_samp("ret", "bret"), F.var_samp("bret")).alias("beta"), F.avg("bret").alias("bmean"), F.stddev_samp("ex").alias("te"), F.avg("ex").alias("exmean"),
        ]
    s = r.groupBy(RUN).agg(*aggs)
    peak = s.join(curves.select(F.col(RUN).alias("_r"), F.col("date").alias("_d"), "nav"), (F.col(RUN) == F.col("_r")) & (F.col("_d") <= F.col("worst_dd.date")))
    peak = peak.groupBy("_r").agg(F.max_by("_d", F.struct("nav", -F.unix_date("_d"))).alias("peak_date"))
    s = s.join(peak, F.col(RUN) == F.col("_r"), "left")
    root = F.sqrt("ppy")
    cagr = F.when((F.col("first") > 0) & (F.col("last") > 0) & (F.col("days") > 0), F.pow(F.col("last") / F.col("first"), 365.25 / F.col("days")) - 1)
    daily = risk_free / F.col("ppy")
    out = [
        RUN, "n", (F.col("last") / F.col("first") - 1).alias("total"), cagr.alias("cagr"), (F.col("sd") * root).alias("vol"), safe_div((F.col("mean") - daily) * root, F.col("sd")).alias("sharpe"),
        safe_div((F.col("mean") - daily) * root, F.col("down")).alias("sortino"), F.col("worst_dd.drawdown").alias("max_drawdown"), "peak_date", F.col("worst_dd.date").alias("trough_date"),
        safe_div(cagr, -F.col("worst_dd.drawdown")).alias("calmar"), "hit", "skew", "kurt", "best", "worst", "under_water", "var5", "cvar5",
    ]
    if benchmark is not None:
        out += [F.col("beta"), ((F.col("mean") - F.col("beta") * F.col("bmean")) * F.col("ppy")).alias("alpha"), (F.col("te") * root).alias("tracking_error"), safe_div(F.col("exmean") * root, F.col("te")).alias("information_ratio")]
    return s.select(*out)


def to_monthly(curves: DataFrame) -> DataFrame:
    """The last value of each calendar month, labelled by the month's last day."""
    return curves.groupBy(RUN, F.last_day("date").alias("month")).agg(F.max_by("nav", "date").alias("nav"))


def monthly_returns(curves: DataFrame) -> DataFrame:
    w = Window.partitionBy(RUN).orderBy("month")
    before = F.lag("nav").over(w)
    return to_monthly(curves).withColumn("ret", F.when(before > 0, F.col("nav") / before - 1))


def monthly_stats(curves: DataFrame, least: int = 6) -> DataFrame:
    """Monthly Sharpe ratio (not annualised), skewness and kurtosis (3 for a normal); null below `least` months."""
    m = monthly_returns(curves).groupBy(RUN).agg(F.count("ret").alias("n"), F.avg("ret").alias("a"), F.stddev_samp("ret").alias("s"), skewness(F.col("ret")).alias("skew"), kurtosis(F.col("ret")).alias("k"))
    ok = F.col("n") >= least
    return m.select(RUN, "n", F.when(ok, safe_div(F.col("a"), F.col("s"))).alias("sharpe"), F.when(ok, F.col("skew")).alias("skew"), F.when(ok, F.col("k") + 3).alias("kurt"))


def monthly_table(curves: DataFrame) -> DataFrame:
    """Years by months of returns, with the year's product."""
    m = monthly_returns(curves).where("ret IS NOT NULL").select(RUN, F.year("month").alias("year"), F.month("month").alias("m"), "ret")
    wide = m.groupBy(RUN, "year").pivot("m", list(range(1, 13))).agg(F.first("ret"))
    ytd = m.groupBy(RUN, "year").agg((F.product(1 + F.col("ret")) - 1).alias("ytd"))
    return wide.select(RUN, "year", *[F.col(str(i)).alias(f"m{i:02d}") for i in range(1, 13)]).join(ytd, [RUN, "year"])


def annual_returns(curves: DataFrame, partial_first: bool = False) -> DataFrame:
    """Year-end to year-end returns; the first year is left out, or with `partial_first` counts from the first value."""
    years = curves.groupBy(RUN, F.year("date").alias("year")).agg(F.max_by("nav", "date").alias("nav"), F.min_by("nav", "date").alias("start"))
    before = F.lag("nav").over(Window.partitionBy(RUN).orderBy("year"))
    base = F.coalesce(before, F.col("start")) if partial_first else before
    return years.select(RUN, "year", (F.col("nav") / base - 1).alias("ret")).where("ret IS NOT NULL")


def align(curves: DataFrame) -> DataFrame:
    """Dates that all runs have, each run rebased to 1 on the first."""
    n = curves.agg(F.countDistinct(RUN).alias("_n"))
    dates = curves.groupBy("date").agg(F.countDistinct(RUN).alias("_k")).crossJoin(F.broadcast(n)).where("_k = _n").select("date")
    w = Window.partitionBy(RUN).orderBy("date")
    return curves.join(dates, "date", "left_semi").withColumn("nav", F.col("nav") / F.first("nav").over(w))


def relative(curves: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each run over the benchmark (date, bench), 1 at the first common date."""
    both = curves.join(F.broadcast(benchmark), "date").withColumn("x", F.col("nav") / F.col("bench"))
    return both.select(RUN, "date", (F.col("x") / F.first("x").over(Window.partitionBy(RUN).orderBy("date"))).alias("relative"))


def rolling(curves: DataFrame, months: int, what: str) -> DataFrame:
    """Rolling Sharpe ratio or volatility, annualised, of monthly returns; null until the window is full."""
    w = Window.partitionBy(RUN).orderBy("month").rowsBetween(-(months - 1), 0)
    sd = F.stddev_samp("ret").over(w)
    value = F.when(F.count("ret").over(w) >= months, safe_div(F.avg("ret").over(w), sd) * F.sqrt(F.lit(12.0)) if what == "sharpe" else sd * F.sqrt(F.lit(12.0)))
    return monthly_returns(curves).select(RUN, "month", value.alias("value")).where("value IS NOT NULL")


def probabilistic_sharpe_sql(sharpe: str, n: str, skew: str, kurt: str, against: str = "0.0") -> str:
    """Probability that the true Sharpe ratio is above `against`."""
    se = f"sqrt(greatest(1 - {skew} * {sharpe} + ({kurt} - 1) / 4 * {sharpe} * {sharpe}, 0.0) / ({n} - 1))"
    z = f"(({sharpe} - {against}) / ({se}))"
    return f"CASE WHEN {n} > 1 AND {se} > 0 THEN {norm_cdf_sql(z)} END"


def expected_max_sharpe_sql(trials: str, sd: str) -> str:
    """Largest Sharpe ratio to expect of so many trials without skill."""
    g = 0.5772156649015329
    return f"CASE WHEN {trials} > 1 THEN {sd} * ({1 - g!r} * {norm_ppf_sql(f'(1e0 - 1e0 / {trials})')} + {g!r} * {norm_ppf_sql(f'(1e0 - 1e0 / ({trials} * 2.718281828459045e0))')}) ELSE 0.0 END"


def sharpe_inference(stats: DataFrame, confidence: float = 0.95) -> DataFrame:
    """stats (run_id, n, sharpe, skew, kurt) with se, the interval, and the probability of a positive ratio."""
    se = sharpe_se(F.col("sharpe"), F.col("n"), F.col("skew"), F.col("kurt"))
    z = F.expr(norm_ppf_sql(repr(1 - (1 - confidence) / 2)))
    return stats.withColumn("se", se).withColumns({"lo": F.col("sharpe") - z * F.col("se"), "hi": F.col("sharpe") + z * F.col("se"), "psr": F.expr(probabilistic_sharpe_sql("sharpe", "n", "skew", "kurt"))})


def deflated_sharpe(stats: DataFrame) -> DataFrame:
    """stats with trials and trial_sd: the expected maximum and the probability of being above it."""
    x = stats.withColumn("bar", F.expr(expected_max_sharpe_sql("trials", "trial_sd")))
    return x.withColumn("dsr", F.expr(probabilistic_sharpe_sql("sharpe", "n", "skew", "kurt", "bar")))
