"""The long panel of sessions and securities, its masks and look-back kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.exprs import safe_div, trailing


class LookaheadError(ValueError):
    """A later date was asked for than the view knows."""


def build(bars: DataFrame, intervals: DataFrame, calendar: DataFrame, liquidity: int = 20, least: int = 10) -> DataFrame:
    """Bars with session_index, in_index, dollar_volume (trailing exact median), first and last session of the security
    and month-end flags; an absent open is the close. The calendar has a row a day and is sent to every task."""
    days = F.broadcast(calendar.select("date", "session_index", "is_month_end"))
    rows = bars.join(days, "date").withColumn("open", F.coalesce("open", "close"))
    inside = (rows.security_id == intervals.security_id) & (rows.date >= intervals.start_date) & (intervals.end_is_open | (rows.date <= intervals.end_date))
    members = rows.join(intervals, inside, "left_semi").select("security_id", "date").withColumn("in_index", F.lit(True))
    rows = rows.join(members, ["security_id", "date"], "left").withColumn("in_index", F.coalesce("in_index", F.lit(False)))
    w, own = trailing("session_index", liquidity, ["security_id"]), Window.partitionBy("security_id")
    value = F.col("close") * F.col("volume")
    return rows.withColumns(
        {
            "dollar_volume": F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)).cast("float"),
            "first_session": F.min("session_index").over(own),
            "last_session": F.max("session_index").over(own),
        }
    )


def tradable(floor: float = 0.0) -> Column:
    return F.col("in_index") & F.col("close").isNotNull() & (F.coalesce(F.col("dollar_volume"), F.lit(0.0)) >= floor)


def index_size(intervals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Open intervals on each session: a running sum of starts and ends, so nothing is joined by range."""
    starts = intervals.select(F.col("start_date").alias("date"), F.lit(1).alias("d"))
    ends = intervals.where("end_date IS NOT NULL").select(F.date_add("end_date", 1).alias("date"), F.lit(-1).alias("d"))
    moves = starts.unionByName(ends).groupBy("date").agg(F.sum("d").alias("d"))
    both = moves.select("date", "d", F.lit(False).alias("session")).unionByName(calendar.select("date", F.lit(0).alias("d"), F.lit(True).alias("session")))
    total = F.sum("d").over(Window.orderBy("date", "session").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("size", total).where("session").select("date", "size")


def coverage(panel: DataFrame, size: DataFrame) -> DataFrame:
    """Per rebalance date: members priced, members in truth, and their ratio."""
    month = panel.where("is_month_end").groupBy("date").agg(F.count_if(F.col("in_index") & F.col("close").isNotNull()).alias("priced"))
    return month.join(size, "date").select("date", "priced", "size", safe_div(F.col("priced"), F.col("size")).alias("coverage"))


def session_lookup(calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """For each distinct date its session index: exact, the one before or on it, and the one on or after it.

    Distinct dates and sessions are one sequence of days, so two frames of one ordered window do what a range join would.
    """
    days = dates.select("date").distinct().join(calendar.select("date", "session_index"), "date", "full")
    asked = dates.select("date").distinct().withColumn("asked", F.lit(True))
    w = Window.orderBy("date")
    out = days.join(asked, "date", "left").withColumns(
        {
            "exact": F.col("session_index"),
            "prev": F.last("session_index", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "next": F.first("session_index", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    return out.where("asked").select("date", "exact", "prev", "next")


def never_priced(intervals: DataFrame, bars: DataFrame) -> DataFrame:
    return intervals.select("security_id").distinct().join(bars.select("security_id"), "security_id", "left_anti")


def truncate(panel: DataFrame, last: int) -> DataFrame:
    """The panel as it was at session `last`: later rows gone, and columns that tell the future overwritten."""
    cut = panel.where(F.col("session_index") <= last)
    return cut.withColumn("last_session", F.max("session_index").over(Window.partitionBy("security_id"))) if "last_session" in panel.columns else cut


class PointInTime:
    """A panel that ends at a session; asking for a later one raises."""

    def __init__(self, panel: DataFrame, last: int):
        self.panel, self.last = truncate(panel, last), last

    def at(self, session: int) -> DataFrame:
        if session > self.last:
            raise LookaheadError(f"session {session} lies after {self.last}")
        return self.panel.where(F.col("session_index") == session)


def back(column: str, sessions: int, panel: DataFrame, name: str) -> DataFrame:
    """panel with the value exactly `sessions` sessions ago (null where there was no bar): an equi-join."""
    past = panel.select("security_id", (F.col("session_index") + sessions).alias("session_index"), F.col(column).alias(name))
    return panel.join(past, ["security_id", "session_index"], "left")


def lookback_return(panel: DataFrame, lookback: int, skip: int, name: str, column: str = "close") -> DataFrame:
    """panel with column[t - skip] / column[t - skip - lookback] - 1."""
    out = back(column, skip, panel, "_a") if skip else panel.withColumn("_a", F.col(column))
    past = panel.select("security_id", (F.col("session_index") + skip + lookback).alias("session_index"), F.col(column).alias("_b"))
    return out.join(past, ["security_id", "session_index"], "left").withColumn(name, F.when(F.col("_b") > 0, F.col("_a") / F.col("_b") - 1)).drop("_a", "_b")


def session_return(column: str = "close") -> Column:
    """Return between adjacent sessions, null across a gap."""
    w = Window.partitionBy("security_id").orderBy("session_index")
    return F.when((F.lag("session_index").over(w) == F.col("session_index") - 1) & (F.lag(column).over(w) > 0), F.col(column) / F.lag(column).over(w) - 1)


