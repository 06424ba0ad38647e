"""Corporate-action adjustment of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.exprs import safe_div

AS_TRADED, SPLIT_ADJUSTED = "as_traded", "split_adjusted"


def compute_factors(bars: DataFrame, actions: DataFrame, convention: str = AS_TRADED) -> DataFrame:
    """security_id, date, adj_factor (splits and dividends) and adj_factor_price (splits): products of the events of
    strictly later sessions, so the newest factor is 1. Prices that are split-adjusted already take no split."""
    events = actions.groupBy("security_id", "date").agg(
        F.sum(F.when(F.col("action_type") == "dividend", F.col("value"))).alias("dividend"),
        F.product(F.when(F.col("action_type") == "split", F.col("value"))).alias("split"),
    )
    w = Window.partitionBy("security_id").orderBy("date")
    after = Window.partitionBy("security_id").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    rows = bars.select("security_id", "date", "close").join(events, ["security_id", "date"], "left").withColumn("before", F.lag("close").over(w))
    paid = 1 - F.coalesce("dividend", F.lit(0.0)) / F.col("before")
    split = F.lit(1.0) if convention == SPLIT_ADJUSTED else 1 / F.when(F.col("split") > 0, F.col("split"))
    rows = rows.withColumns({"by_split": F.coalesce(split, F.lit(1.0)), "by_cash": F.when((F.col("before") > 0) & (paid > 0), paid).otherwise(F.lit(1.0))})
    return rows.select(
        "security_id",
        "date",
        F.coalesce(F.product(F.col("by_split") * F.col("by_cash")).over(after), F.lit(1.0)).alias("adj_factor"),
        F.coalesce(F.product("by_split").over(after), F.lit(1.0)).alias("adj_factor_price"),
    )


def apply_factors(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """bars with factors and adjusted prices; volume goes the other way, and is null for a factor of 0."""
    joined = bars.join(factors, ["security_id", "date"], "left")
    prices = {f"adj_{c}": F.col(c) * F.col("adj_factor") for c in ("open", "high", "low", "close")}
    return joined.withColumns(prices | {"adj_volume": safe_div(F.col("volume"), F.col("adj_factor_price"))})


def agreement(adjusted: DataFrame, vendor: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Per security: bars, and median, 99th percentile and maximum of the absolute difference of daily returns."""
    w = Window.partitionBy("security_id").orderBy("date")
    own = F.col("adj_close") / F.lag("adj_close").over(w) - 1
    theirs = F.col("vendor_close") / F.lag("vendor_close").over(w) - 1
    d = adjusted.join(vendor, ["security_id", "date"]).withColumn("d", F.abs(own - theirs))
    out = d.groupBy("security_id").agg(F.count(F.lit(1)).alias("bars"), F.percentile("d", F.array(F.lit(0.5), F.lit(0.99))).alias("q"), F.max("d").alias("max_ret_diff"))
    return out.select("security_id", "bars", F.col("q")[0].alias("median_ret_diff"), F.col("q")[1].alias("p99_ret_diff"), "max_ret_diff", (F.col("q")[0] > tolerance).alias("flag"))


def cumulative_split_ratio(days: DataFrame, splits: DataFrame) -> DataFrame:
    """security_id, date, ratio: the product of splits strictly after each day; 1 without any."""
    s = splits.select(F.col("security_id").alias("_s"), F.col("date").alias("_d"), F.col("value").alias("_v"))
    joined = days.join(s, (F.col("security_id") == F.col("_s")) & (F.col("date") < F.col("_d")), "left")
    return joined.groupBy("security_id", "date").agg(F.coalesce(F.product("_v"), F.lit(1.0)).alias("ratio"))


def total_return(series: DataFrame, dividends: DataFrame) -> DataFrame:
    """A price series (date, close) back-adjusted for its dividends (date, value): date, close, tr."""
    bars = series.select(F.lit(0).alias("security_id"), "date", "close")
    acts = dividends.select(F.lit(0).alias("security_id"), "date", F.lit("dividend").alias("action_type"), "value")
    return series.join(compute_factors(bars, acts).select("date", "adj_factor"), "date").select("date", "close", (F.col("close") * F.col("adj_factor")).alias("tr"))


def cagr(series: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Annual growth between the first and last date, by days over 365.25."""
    out = series.groupBy(*(by or [])).agg(F.min_by(value, "date").alias("a"), F.max_by(value, "date").alias("b"), F.datediff(F.max("date"), F.min("date")).alias("days"))
    return out.select(*(by or []), F.when((F.col("a") > 0) & (F.col("days") > 0), F.pow(F.col("b") / F.col("a"), 365.25 / F.col("days")) - 1).alias("cagr"))
