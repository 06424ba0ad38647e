"""Point-in-time joins: interval, bitemporal, as-of, nearest; and what is derived from filing order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def universe_asof(intervals: DataFrame, dates: DataFrame | str, key: str = "security_id") -> DataFrame:
    """Members on a date, or on each date of a frame (column as_of): both ends count, an open interval has none."""
    if isinstance(dates, str):
        day = F.lit(dates).cast("date")
        return intervals.where((F.col("start_date") <= day) & (F.col("end_is_open") | (F.col("end_date") >= day))).orderBy(key)
    dates = F.broadcast(dates)  # as many as there are days at most
    inside = (intervals.start_date <= dates.as_of) & (intervals.end_is_open | (intervals.end_date >= dates.as_of))
    return dates.join(intervals, inside).select("as_of", *intervals.columns)


def latest_visible(facts: DataFrame, as_of: str, keys: Sequence[str] = ("security_id", "tag", "period_end"), tags: Sequence[str] | None = None) -> DataFrame:
    """What was known on a date: per key the row filed last by then, ties by accession. Period ends never filter."""
    seen = facts.where(F.col("filed_date") <= F.lit(as_of).cast("date"))
    if tags is not None:
        seen = seen.where(F.col("tag").isin(list(tags)))
    rest = [c for c in facts.columns if c not in keys]
    order = ["filed_date", "accession", *[c for c in rest if c not in ("filed_date", "accession")]]
    return seen.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def clipped(bars: DataFrame, intervals: DataFrame, warmup: int = 400, exit_: int = 0, dedupe: bool = False, key: str = "security_id") -> DataFrame:
    """Bars within membership, from `warmup` days before its start (that day excluded) to `exit_` days after its end.

    A bar comes once for each interval that it matches, or once with `dedupe`. An equi-join on the key with a date
    condition, so it shuffles by key or not at all if one side is small.
    """
    iv = intervals.select(F.col(key).alias("_k"), F.date_sub("start_date", warmup).alias("_lo"), F.date_add("end_date", exit_).alias("_hi"), F.col("end_is_open").alias("_open"))
    on = (F.col(key) == F.col("_k")) & (F.col("date") > F.col("_lo")) & (F.col("_open") | (F.col("date") <= F.col("_hi")))
    return bars.join(iv, on, "left_semi" if dedupe else "inner").select(*bars.columns)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, payload: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """left with the payload of the latest right row at or before left_on, per `by`; several at one time: the last by `tie`.

    One shuffle and one sort of both sides together, linear however long the histories are. The payload travels
    as a struct, so that a null in the latest row counts.
    """
    cols = left.columns
    l = left.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_p"), F.struct(*cols).alias("_l"), *[F.lit(None).alias(f"_x{i}") for i, _ in enumerate(tie)])  # noqa: E741
    r = right.select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.struct(*payload).alias("_p"), F.lit(None).alias("_l"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(tie)])
    w = Window.partitionBy(*by).orderBy("_t", "_side", *[f"_x{i}" for i, _ in enumerate(tie)]).rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l).withColumn("_seen", F.last("_p", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_l.*", *[F.col(f"_seen.{c}").alias(c) for c in payload])


def nearest_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, payload: Sequence[str], most: int = 365) -> DataFrame:
    """left with the payload of the right row nearest in days, at most `most` away; ties go to the earlier date."""
    r = right.select(F.col(by).alias("_k"), F.col(right_on).alias("_d"), *payload)
    gap = F.abs(F.datediff(F.col("_d"), F.col(left_on)))
    pairs = left.join(r, (F.col(by) == F.col("_k")) & (gap <= most), "left").withColumn("_gap", gap)
    best = pairs.groupBy(*left.columns).agg(F.min(F.struct(F.coalesce("_gap", F.lit(1 << 30)), "_d", *payload)).alias("_r"), F.min("_gap").alias("gap_days"))
    return best.select(*left.columns, "gap_days", *[F.col(f"_r.{c}").alias(c) for c in payload])


def frontier(facts: DataFrame, by: Sequence[str] = ("security_id", "tag")) -> DataFrame:
    """Rows whose period is the newest known when they were filed: what "current" meant then."""
    w = Window.partitionBy(*by).orderBy("filed_date", "accession").rowsBetween(Window.unboundedPreceding, 0)
    return facts.withColumn("_top", F.max("period_end").over(w)).where("period_end = _top").drop("_top")


def with_lag(facts: DataFrame, lag: int, by: Sequence[str] = ("security_id", "tag")) -> DataFrame:
    """The frontier with the value, as first reported, `lag` periods before."""
    first = facts.groupBy(*by, "period_end").agg(F.min_by("value", F.struct("filed_date", "accession")).alias("_v"))
    before = first.withColumn("lagged", F.lag("_v", lag).over(Window.partitionBy(*by).orderBy("period_end"))).drop("_v")
    return frontier(facts, by).join(before, [*by, "period_end"], "left")


def revisions(facts: DataFrame, tolerance: float = 0.01, key: Sequence[str] = ("security_id", "tag", "period_end")) -> DataFrame:
    """Per security and filing date: facts filed, first filings among them, and revisions by more than the tolerance."""
    w = Window.partitionBy(*key).orderBy("filed_date", "accession")
    was = F.lag("value").over(w)
    moved = F.coalesce(F.abs(F.col("value") - was) > tolerance * F.abs(was), F.lit(False))
    rows = facts.select("security_id", "filed_date", moved.cast("int").alias("m"), was.isNull().cast("int").alias("f"))
    return rows.groupBy("security_id", "filed_date").agg(F.count(F.lit(1)).alias("facts"), F.sum("f").alias("first_filings"), F.sum("m").alias("revised"))


def restatement_rate(facts: DataFrame, least: int = 20) -> DataFrame:
    """Cumulative share of revised facts by filing date; null until more than `least` facts are known."""
    w = Window.partitionBy("security_id").orderBy("filed_date").rowsBetween(Window.unboundedPreceding, 0)
    known, bad = F.sum("facts").over(w), F.sum("revised").over(w)
    return revisions(facts).select("security_id", "filed_date", F.when(known > least, bad / known).alias("restatement_rate"))


def earnings_surprise(facts: DataFrame, bound: float = 10.0, by: Sequence[str] = ("security_id", "tag")) -> DataFrame:
    """Change against four periods before, over the deviation of the last eight such changes (at least four)."""
    first = facts.groupBy(*by, "period_end").agg(F.min_by("value", F.struct("filed_date", "accession")).alias("value"))
    w = Window.partitionBy(*by).orderBy("period_end")
    d = first.withColumn("d", F.col("value") - F.lag("value", 4).over(w))
    eight = w.rowsBetween(-7, 0)
    sd = F.when(F.count("d").over(eight) >= 4, F.stddev_samp("d").over(eight))
    sue = F.greatest(F.least(F.when(sd > 0, F.col("d") / sd), F.lit(bound)), F.lit(-bound))
    return d.select(*by, "period_end", F.when(sd > 0, sue).alias("sue"))


def filing_lag(facts: DataFrame) -> DataFrame:
    """Days from the newest period of a filing date to that date."""
    return facts.groupBy("security_id", "filed_date").agg(F.max("period_end").alias("pe")).select("security_id", "filed_date", F.datediff("filed_date", "pe").alias("lag_days"))


def duration_class(start: str = "period_start", end: str = "period_end"):
    """instant, annual (330 to 400 days), quarter (80 to 100) or other."""
    days = F.datediff(end, start)
    return F.when(F.col(start).isNull(), "instant").when(days.between(330, 400), "annual").when(days.between(80, 100), "quarter").otherwise("other")
