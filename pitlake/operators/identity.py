"""Calendars, membership intervals and surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def derive_calendar(sessions: DataFrame, date: str = "date") -> DataFrame:
    """A row per distinct session: date, year, month, day_of_week (Monday 0), flags of period ends, session_index from 0.

    The newest session ends every period. A calendar has a row a day, so its one ordered window is small.
    """
    days = sessions.select(F.col(date).alias("date")).where("date IS NOT NULL").distinct()
    w = Window.orderBy("date")
    after = F.lead("date").over(w)

    year, month, quarter = F.year("date"), F.month("date"), F.quarter("date")
    new_year = F.year(after) != year
    return days.select(
        "date",
        year.alias("year"),
        month.alias("month"),
        F.weekday("date").alias("day_of_week"),
        F.coalesce(new_year | (F.month(after) != month), F.lit(True)).alias("is_month_end"),
        F.coalesce(new_year | (F.quarter(after) != quarter), F.lit(True)).alias("is_quarter_end"),
        F.coalesce(new_year, F.lit(True)).alias("is_year_end"),
        (F.row_number().over(w) - 1).alias("session_index"),
    )


def build_intervals(snapshots: DataFrame, when: str, key: str) -> DataFrame:
    """Runs of consecutive snapshots that a key is in: key, start_date, end_date (null while open), end_is_open.

    Snapshots are numbered on their own (they are few); the islands are found within each key.
    """
    numbers = snapshots.select(when).distinct().withColumn("_n", F.row_number().over(Window.orderBy(when)))
    top = numbers.agg(F.max("_n").alias("_top"))
    rows = snapshots.select(when, key).distinct().join(F.broadcast(numbers), when).crossJoin(F.broadcast(top))
    island = F.col("_n") - F.row_number().over(Window.partitionBy(key).orderBy("_n"))
    return (
        rows.withColumn("_island", island)
        .groupBy(key, "_island")
        .agg(F.min(when).alias("start_date"), F.max(when).alias("_last"), (F.max("_n") == F.first("_top")).alias("end_is_open"))
        .select(key, "start_date", F.when(~F.col("end_is_open"), F.col("_last")).alias("end_date"), "end_is_open")
    )


def last_of_month(rows: DataFrame, when: str) -> DataFrame:
    """The row with the latest time of each calendar month (ties: any column order decides, so that it is one)."""
    rest = [c for c in rows.columns if c != when]
    picked = rows.groupBy(F.date_trunc("month", when).alias("_m")).agg(F.max(F.struct(when, *rest)).alias("_r"))
    return picked.select("_r.*")


def normalize_ticker(c: Column) -> Column:
    """Trimmed, upper case, without spaces; - and / become dots."""
    return F.replace(F.translate(F.upper(F.trim(c)), "-/", ".."), F.lit(" "), F.lit(""))


def assign_ids(known: DataFrame, seen: DataFrame, natural: list[str], order: str, prefix: str = "SID") -> DataFrame:
    """security_id and natural key of all keys: the known ones keep theirs, new ones follow by first `order`. They are
    numbered within each value of `order`, and those before are counted by value, so no task has all of them."""
    new = seen.groupBy(*natural).agg(F.min(order).alias("_first")).join(known, natural, "left_anti")
    top = known.agg(F.coalesce(F.max(F.regexp_extract("security_id", r"(\d+)$", 1).cast("int")), F.lit(0)).alias("_top"))
    per = new.groupBy(F.col("_first").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int").alias("_before"))
    place = F.row_number().over(Window.partitionBy("_first").orderBy(*natural))
    numbered = new.withColumn("_n", place).join(per, F.col("_first").eqNullSafe(F.col("_at"))).crossJoin(F.broadcast(top))
    made = numbered.select(F.format_string(prefix + "%06d", F.col("_n") + F.col("_before") + F.col("_top")).alias("security_id"), *natural)
    return known.select("security_id", *natural).unionByName(made)


def classify_reason(text: Column) -> Column:
    """Why a security left: bankruptcy before acquisition before removal; a spin-off is a removal."""
    t = F.lower(text)
    return (
        F.when(t.rlike("bankrupt|chapter 11|liquidat|receiver"), "bankruptcy")
        .when(t.rlike("acqui|merge|bought|takeover|private") & ~t.rlike("spin-?off|spun off"), "acquisition")
        .when(t.rlike("market cap|replac|remov|spin-?off|spun off"), "index_removal")
        .otherwise("unresolved")
    )


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a that b lacks, compared without separators and case."""
    bare = lambda c: F.upper(F.translate(c, ".-/ ", ""))
    left = a.select(F.col(key), bare(F.col(key)).alias("_k"))
    return left.join(b.select(bare(F.col(key)).alias("_k")), "_k", "left_anti").select(key).distinct()
