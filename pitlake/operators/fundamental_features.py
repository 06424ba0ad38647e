"""Features from bitemporal facts, corporate events and macro series, sampled as of dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.exprs import div_positive, growth, growth_signed
from pitlake.operators import pit


def values_asof(facts: DataFrame, grid: DataFrame, tags: Sequence[str], lag: int = 0) -> DataFrame:
    """grid (security_id, date) with a column per tag: the frontier value known then, and with `lag` its value so many
    periods before, as first reported. All tags take one as-of pass, with the tag in the key, and one pivot."""
    steps = pit.with_lag(facts.where(F.col("tag").isin(list(tags))), max(1, lag))
    keys = grid.select("security_id", "date").distinct().select("*", F.explode(F.array(*[F.lit(t) for t in tags])).alias("tag"))
    seen = pit.asof_join(keys, steps, ["security_id", "tag"], "date", "filed_date", ["value", "lagged", "filed_date"], ["accession"])
    aggs = [F.max("value").alias("v")] + ([F.max("lagged").alias("lag")] if lag else [])
    wide = seen.groupBy("security_id", "date").pivot("tag", list(tags)).agg(*aggs)
    return wide


#: Guarded ratios of fundamental values: numerator and denominator by name.
RATIOS: dict[str, tuple[str, str]] = {
    "book_to_market": ("equity", "market_cap"),
    "earnings_yield": ("net_income", "market_cap"),
    "cf_yield": ("cash_flow", "market_cap"),
    "buyback_yield": ("repurchases", "market_cap"),
    "gross_profitability": ("gross_profit", "assets"),
    "roe": ("net_income", "equity"),
    "capex_intensity": ("capex", "assets"),
    "rnd_intensity": ("rnd", "revenue"),
    "cash_ratio": ("cash", "assets"),
    "current_ratio": ("current_assets", "current_liabilities"),
    "debt_to_assets": ("debt", "assets"),
}


def ratio_features(values: DataFrame) -> DataFrame:
    """values with RATIOS, accruals, leverage, log_market_cap and growth rates; a column that is absent gives null."""

    def c(name: str) -> Column:
        return F.col(name) if name in values.columns else F.lit(None).cast("double")

    cols = {k: div_positive(c(a), c(b)) for k, (a, b) in RATIOS.items()}
    cols |= {
        "accruals": div_positive(c("net_income") - c("cash_flow"), c("assets")),
        "leverage": 1 - div_positive(c("equity"), c("assets")),
        "log_market_cap": F.when(c("market_cap") > 0, F.ln(c("market_cap"))),
        "asset_growth": growth(c("assets"), c("assets_before")),
        "sales_growth": growth(c("revenue"), c("revenue_before")),
        "earnings_growth": growth_signed(c("net_income"), c("net_income_before")),
        "eps_change_yoy": growth_signed(c("eps"), c("eps_before")),
    }
    return values.withColumns({k: v.cast("float") for k, v in cols.items()})


def market_cap(shares: DataFrame, splits: DataFrame, prices: DataFrame, least: float = 5e8) -> DataFrame:
    """security_id, date, market_cap: shares last filed (the largest count of a filing date) times later splits times
    the raw close; null under `least`."""
    filed = shares.groupBy("security_id", "filed_date").agg(F.max("value").alias("shares"))
    seen = pit.asof_join(prices, filed, ["security_id"], "date", "filed_date", ["shares", "filed_date"])
    s = splits.select(F.col("security_id").alias("_s"), F.col("date").alias("_d"), F.col("value").alias("_v"))
    on = (F.col("security_id") == F.col("_s")) & (F.col("_d") > F.col("filed_date")) & (F.col("_d") <= F.col("date"))
    ratio = seen.join(s, on, "left").groupBy("security_id", "date", "close", "shares").agg(F.coalesce(F.product("_v"), F.lit(1.0)).alias("ratio"))
    cap = F.col("shares") * F.col("ratio") * F.col("close")
    return ratio.select("security_id", "date", F.when(cap >= least, cap).alias("market_cap"))


def days_since_filing(facts: DataFrame, grid: DataFrame) -> DataFrame:
    filed = facts.groupBy("security_id", "filed_date").agg(F.count(F.lit(1)).alias("n"))
    seen = pit.asof_join(grid, filed, ["security_id"], "date", "filed_date", ["filed_date"])
    return seen.select("security_id", "date", F.datediff("date", "filed_date").alias("days_since_filing"))


def tenure(panel: DataFrame) -> DataFrame:
    """Month ends of members: months_in_index (length of the run up to then), new_member (at most 3), log_tenure.

    Runs are islands: the month's number less the count of memberships so far is constant within a run.
    """
    months = panel.where("is_month_end").select("date").distinct().withColumn("_m", F.row_number().over(Window.orderBy("date")))
    rows = panel.where("is_month_end AND in_index").select("security_id", "date").join(F.broadcast(months), "date")
    own = Window.partitionBy("security_id").orderBy("_m")
    rows = rows.withColumn("_i", F.col("_m") - F.row_number().over(own))
    n = F.row_number().over(Window.partitionBy("security_id", "_i").orderBy("_m"))
    return rows.select("security_id", "date", n.alias("months_in_index"), (n <= 3).alias("new_member"), F.log1p(n).alias("log_tenure"))


def dividend_features(actions: DataFrame, grid: DataFrame, days: int = 372) -> DataFrame:
    """grid (security_id, date, close) with trailing dividends: yield, growth against the days before, cut and pays flags.

    Days and events are one ordered sequence by security, and the sums are range frames over day numbers. They are exact, in
    decimals of 18 places, and so the same in any order of rows; a fall by just 5 % is no cut. NaN counts as no dividend.
    """
    exact = F.when(~F.isnan("value"), F.col("value")).cast("decimal(38,18)")
    g = grid.select("security_id", "date", "close", F.lit(None).cast("decimal(38,18)").alias("v"), F.lit(True).alias("_g"))
    e = actions.where("action_type = 'dividend'").select("security_id", "date", F.lit(None).cast("double").alias("close"), exact.alias("v"), F.lit(False).alias("_g"))
    w = Window.partitionBy("security_id").orderBy("_t")
    both = g.unionByName(e).withColumn("_t", F.unix_date("date"))
    now = F.coalesce(F.sum("v").over(w.rangeBetween(-(days - 1), 0)).cast("double"), F.lit(0.0))
    before = F.coalesce(F.sum("v").over(w.rangeBetween(-(2 * days - 1), -days)).cast("double"), F.lit(0.0))
    out = both.withColumns({"now": now, "before": before}).where("_g")
    limit = 0.95 * F.col("before") * (1 - 1e-15)  # the product may round to just above a tie
    return out.select(
        "security_id",
        "date",
        div_positive(F.col("now"), F.col("close")).alias("div_yield"),
        growth(F.col("now"), F.col("before")).alias("div_growth_1y"),
        F.when(F.col("before") > 0, (F.col("now") < limit).cast("double")).alias("div_cut"),
        (F.col("now") > 0).cast("double").alias("pays_dividend"),
    )


def dividend_due(actions: DataFrame, grid: DataFrame, ahead: int = 31, late: int = 10) -> DataFrame:
    """1 if the next dividend is due: the median gap of the last five ex-dates (20 to 200 days) points to a day from
    `late` days ago to `ahead` days on; null with fewer than three ex-dates known."""
    w = Window.partitionBy("security_id").orderBy("date")
    ex = actions.where("action_type = 'dividend'").select("security_id", "date").distinct()
    gaps = F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.datediff(F.element_at("l", (i + 1).cast("int")), F.element_at("l", i.cast("int"))))
    ex = ex.withColumn("l", F.collect_list("date").over(w.rowsBetween(-4, 0))).where(F.size("l") >= 3)
    sorted_ = F.array_sort(gaps)
    n = F.size(sorted_)
    mid = (F.element_at(sorted_, F.floor((n + 1) / 2).cast("int")) + F.element_at(sorted_, F.floor(n / 2 + 1).cast("int"))) / 2
    ex = ex.withColumn("gap", mid).select("security_id", F.col("date").alias("ex_date"), "gap")
    seen = pit.asof_join(grid.select("security_id", "date"), ex, ["security_id"], "date", "ex_date", ["ex_date", "gap"])
    wait = F.datediff("ex_date", "date") + F.col("gap")
    due = F.col("gap").between(20, 200) & wait.between(-late, ahead)
    return seen.select("security_id", "date", F.when(F.col("ex_date").isNotNull(), due.cast("double")).alias("div_due_1m"))


def macro_features(series: DataFrame, calendar: DataFrame, change: int = 63, revised: Sequence[str] = ()) -> DataFrame:
    """series_id, session_index: level as known a session ago, and its change over `change` sessions.

    A series that is ever revised is an error, since its history was not known at the time.
    """
    if revised:
        raise ValueError(f"revised series have no point-in-time history: {', '.join(revised)}")
    names = series.select("series_id").distinct()
    grid = calendar.select("date", "session_index").join(F.broadcast(names))
    seen = pit.asof_join(grid, series.where("value IS NOT NULL"), ["series_id"], "date", "date", ["value"])
    w = Window.partitionBy("series_id").orderBy("session_index")
    level = F.lag("value", 1).over(w)
    return seen.select("series_id", "session_index", "date", level.alias("level"), (level - F.lag("value", 1 + change).over(w)).alias("change"))


def relative_level(features: DataFrame, width: int = 252, least: int = 126) -> DataFrame:
    """level over its trailing exact median."""
    w = Window.partitionBy("series_id").orderBy("session_index").rangeBetween(-(width - 1), 0)
    mid = F.when(F.count("level").over(w) >= least, F.percentile("level", F.lit(0.5)).over(w))
    return features.withColumn("relative", F.when(mid != 0, F.col("level") / mid))
