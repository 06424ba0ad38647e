"""Single-instrument timing: overnight and intraday legs, rules that hold them, and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _w() -> WindowSpec:
    return Window.orderBy("session_index")


def legs(bars: DataFrame) -> DataFrame:
    """bars (session_index, date, open, close) with r_on (close before to open), r_id (open to close), gap days to the next session."""
    before = F.lag("close").over(_w())
    return bars.withColumns({"r_on": F.when(before > 0, F.col("open") / before - 1), "r_id": F.when(F.col("open") > 0, F.col("close") / F.col("open") - 1), "next_gap": F.datediff(F.lead("date").over(_w()), "date")})


def from_return_days(hold: Column) -> dict[str, Column]:
    """Holding a session's whole return: the night before it (decided at the last close) and its day."""
    return {"hold_on": F.coalesce(F.lead(hold).over(_w()), F.lit(False)), "hold_id": hold}


def rule(name: str) -> dict[str, Column]:
    """hold_on (from this close to the next open) and hold_id (from this open to this close) of a named rule."""
    true, false = F.lit(True), F.lit(False)
    month = Window.partitionBy(F.trunc("date", "month"))
    first = F.row_number().over(month.orderBy("session_index"))
    last = F.row_number().over(month.orderBy(F.desc("session_index")))
    if name == "buy_hold":
        return {"hold_on": true, "hold_id": true}
    if name == "overnight":
        return {"hold_on": true, "hold_id": false}
    if name == "intraday":
        return {"hold_on": false, "hold_id": true}
    if name == "weekend":  # the night that ends a week: the next session's day of the week is not later
        return {"hold_on": F.coalesce(F.weekday(F.lead("date").over(_w())) <= F.weekday("date"), false), "hold_id": false}
    if name == "pre_holiday":  # a gap that is no plain weekend
        gap = F.col("next_gap")
        holiday = (gap > 1) & ~((F.weekday("date") == 4) & (gap == 3))
        return {"hold_on": F.coalesce(holiday, false), "hold_id": F.coalesce(holiday, false)}
    if name == "turn_of_month":
        return from_return_days((first <= 3) | (last == 1))
    if name == "month_end_drift":
        return from_return_days(last <= 5)
    if name == "sell_in_may":
        return from_return_days(F.month("date").isin(11, 12, 1, 2, 3, 4))
    raise ValueError(f"unknown rule {name}")


RULES = ("buy_hold", "overnight", "intraday", "weekend", "pre_holiday", "turn_of_month", "month_end_drift", "sell_in_may")


def gross_path(bars: DataFrame, name: str) -> DataFrame:
    """session_index, nav of a rule without costs: running product of the legs held."""
    x = legs(bars).withColumns(rule(name))
    on = F.when(F.coalesce(F.lag("hold_on").over(_w()), F.lit(False)), 1 + F.coalesce("r_on", F.lit(0.0))).otherwise(1.0)
    day = F.when(F.col("hold_id"), 1 + F.coalesce("r_id", F.lit(0.0))).otherwise(1.0)
    return x.select("session_index", "date", F.exp(F.sum(F.ln(on * day)).over(_w().rowsBetween(Window.unboundedPreceding, 0))).alias("nav"))


def entries(bars: DataFrame, name: str) -> DataFrame:
    """entries (rising edges of the legs in their order) and exposure (share of legs held) of a rule."""
    x = legs(bars).withColumns(rule(name))
    both = x.select(F.col("session_index").alias("t"), F.lit(0).alias("leg"), F.col("hold_id").alias("h")).union(x.select("session_index", F.lit(1), "hold_on"))
    w = Window.orderBy("t", "leg")
    edge = F.col("h") & ~F.coalesce(F.lag("h").over(w), F.lit(False))
    return both.withColumn("e", edge).agg(F.count_if("e").alias("entries"), F.avg(F.col("h").cast("double")).alias("exposure"))


def decompose(panel: DataFrame, least: int = 500) -> DataFrame:
    """Per security with enough sessions as a member at both ends: log overnight and intraday sums and the overnight share."""
    w = Window.partitionBy("security_id").orderBy("session_index")
    ok = F.col("in_index") & F.lag("in_index").over(w) & (F.lag("session_index").over(w) == F.col("session_index") - 1)
    x = panel.withColumns({"on": F.when(ok, F.ln(F.col("open") / F.lag("close").over(w))), "day": F.when(ok, F.ln(F.col("close") / F.col("open")))})
    s = x.groupBy("security_id").agg(F.count("on").alias("sessions"), F.sum("on").alias("overnight"), F.sum("day").alias("intraday")).where(F.col("sessions") >= least)
    return s.withColumn("share", F.when(F.col("overnight") + F.col("intraday") != 0, F.col("overnight") / (F.col("overnight") + F.col("intraday"))))
