"""Spreads and delisting returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.exprs import tick_size, trailing
from pitlake.operators.identity import classify_reason
from pitlake.operators.pit import nearest_join

#: Largest half spread.
MOST = 0.20


def corwin_schultz(bars: DataFrame) -> DataFrame:
    """bars with cs, the signed spread estimate of two adjacent sessions from their highs and lows; where the price has
    gapped overnight, the session's range is shifted to yesterday's close."""
    w = Window.partitionBy("security_id").orderBy("session_index")
    adjacent = F.lag("session_index").over(w) == F.col("session_index") - 1
    h0, l0, c0 = (F.when(adjacent, F.lag(c).over(w)) for c in ("high", "low", "close"))
    rows = bars.withColumns({"_h0": h0, "_l0": l0, "_c0": c0})
    gap = F.greatest(F.col("low") - F.col("_c0"), F.lit(0.0)) - F.greatest(F.col("_c0") - F.col("high"), F.lit(0.0))
    rows = rows.withColumns({"_h": F.col("high") - gap, "_l": F.col("low") - gap})
    ok = (F.col("_l") > 0) & (F.col("_l0") > 0)
    one, two = F.ln(F.col("_h") / F.col("_l")), F.ln(F.col("_h0") / F.col("_l0"))
    beta = one * one + two * two
    both = F.ln(F.greatest("_h", "_h0") / F.least("_l", "_l0"))
    k = 3 - 2 * 2**0.5
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(both * both / k)
    cs = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    return rows.withColumn("cs", F.when(ok, cs)).drop("_h0", "_l0", "_c0", "_h", "_l")


def abdi_ranaldo(bars: DataFrame, window: int = 21, least: int = 7) -> DataFrame:
    """bars with ar: twice the root of the mean of (close - mid)(close - next mid) over the sessions before."""
    w = Window.partitionBy("security_id").orderBy("session_index")
    mid = (F.ln("high") + F.ln("low")) / 2
    rows = bars.withColumn("_m", mid)
    after = F.when(F.lead("session_index").over(w) == F.col("session_index") + 1, F.lead("_m").over(w))
    rows = rows.withColumn("_x", (F.ln("close") - F.col("_m")) * (F.ln("close") - after))
    past = trailing("session_index", window, ["security_id"], skip=1)
    mean = F.when(F.count("_x").over(past) >= least, F.avg("_x").over(past))
    return rows.withColumn("ar", F.when(mean.isNotNull(), 2 * F.sqrt(F.greatest(mean, F.lit(0.0))))).drop("_m", "_x")


def half_spread(bars: DataFrame, window: int = 21, least: int = 7) -> DataFrame:
    """security_id, date, half_spread, half_spread_cs, half_spread_ar, tick_floor, binding: the mean of the signed
    estimates, not below the tick and not above MOST."""
    rows = abdi_ranaldo(corwin_schultz(bars), window, least)
    w = trailing("session_index", window, ["security_id"])
    smooth = F.when(F.count("cs").over(w) >= least, F.avg("cs").over(w))
    rows = rows.withColumns({"half_spread_cs": F.greatest(smooth, F.lit(0.0)) / 2, "half_spread_ar": F.col("ar") / 2, "tick_floor": tick_size(F.col("date")) / 2 / F.col("close")})
    rows = rows.withColumn("half_spread_cs", F.when(smooth.isNotNull(), F.col("half_spread_cs")))
    best = F.least(F.greatest("half_spread_cs", "tick_floor"), F.lit(MOST))
    bound = F.when(F.col("half_spread_cs") > F.col("tick_floor"), "estimator").otherwise("tick_floor")
    return rows.select("security_id", "date", best.cast("float").alias("half_spread"), "half_spread_cs", "half_spread_ar", "tick_floor", bound.alias("binding"))


def spread_eras(spreads: DataFrame) -> DataFrame:
    """Median and 90th percentile of half spreads in bp by era, and the share that the tick binds."""
    era = F.when(F.year("date") <= 1997, "to 1997").when(F.year("date") <= 2000, "1998-2000").otherwise("from 2001")
    q = F.percentile(F.col("half_spread").cast("double") * 1e4, F.array(F.lit(0.5), F.lit(0.9)))
    out = spreads.groupBy(era.alias("era")).agg(F.count(F.lit(1)).alias("rows_"), q.alias("q"), F.avg((F.col("binding") == "tick_floor").cast("double")).alias("tick_share"))
    return out.select("era", "rows_", F.col("q")[0].alias("median_bp"), F.col("q")[1].alias("p90_bp"), "tick_share")


def delisting_returns(ends: DataFrame, changes: DataFrame, assumed: dict[str, float], most: int = 365, key: str = "security_id") -> DataFrame:
    """For each ended membership (key, membership_end, last_bar_date) the change (when, reason_text) nearest to it, its
    class and the return assumed for it. Bars that go on for over 90 days mean that it was not delisted."""
    near = nearest_join(ends, changes, key, "membership_end", "when", ["reason_text"], most)
    goes_on = F.datediff("last_bar_date", "membership_end") > 90
    kind = F.when(goes_on, "index_removal").otherwise(classify_reason(F.coalesce("reason_text", F.lit(""))))
    table = F.create_map(*[x for k, v in assumed.items() for x in (F.lit(k), F.lit(float(v)))])
    return near.withColumn("reason_category", kind).withColumn("delist_return", F.coalesce(table[F.col("reason_category")], F.lit(0.0)))
