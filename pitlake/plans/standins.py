"""Market tables derived from the supplied star schema, as DataFrames; oracle.py has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlake.operators import identity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: the ship dates."""
    return identity.derive_calendar(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, date, open, high, low, close, volume: a supplier's unit prices of a day."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("security_id"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(F.min_by(px, key).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, key).alias("close"), F.sum("l_quantity").alias("volume"))
    )


def indexed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars with session_index; the calendar has a row a day, so it is small however many bars there are."""
    return bars(spark, sf_dir).join(F.broadcast(calendar(spark, sf_dir).select("date", "session_index")), "date")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, date, action_type, value: a day's discounts of returned lines as dividend (their exact sum), and splits of 2."""
    li = table(spark, sf_dir, "lineitem")
    key = [F.col("l_suppkey").alias("security_id"), F.col("l_shipdate").cast("date").alias("date")]
    paid = F.sum(F.col("l_discount").cast("decimal(28,18)")).cast("double")
    dividends = li.where("l_returnflag = 'R'").groupBy(*key).agg(paid.alias("value")).withColumn("action_type", F.lit("dividend"))
    splits = li.where("l_linenumber = 7 AND l_tax >= 0.07").select(*key).distinct().withColumns({"value": F.lit(2.0), "action_type": F.lit("split")})
    return dividends.unionByName(splits).select("security_id", "date", "action_type", "value")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month, security_id: the suppliers in the upper half of a month by value."""
    li = table(spark, sf_dir, "lineitem")
    value = li.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), F.col("l_suppkey").alias("security_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    w = Window.partitionBy("month")
    ranked = value.withColumns({"k": F.row_number().over(w.orderBy(F.desc("v"), "security_id")), "n": F.count(F.lit(1)).over(w)})
    return ranked.where("2 * k <= n").select("month", "security_id")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership intervals: security_id, start_date, end_date (last day of the last month; null while open), end_is_open."""
    found = identity.build_intervals(snapshots(spark, sf_dir), "month", "security_id")
    return found.withColumn("end_date", F.last_day("end_date"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal facts: security_id, tag, period_end, filed_date, accession, value."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    day = F.col("o_orderdate").cast("date")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("security_id"),
        F.col("o_orderpriority").alias("tag"),
        F.date_sub(F.trunc(day, "quarter"), 1).alias("period_end"),
        day.alias("filed_date"),
        F.col("o_orderkey").alias("accession"),
        F.col("o_totalprice").alias("value"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, date, value: daily means of events by type."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("date")).agg(F.avg("value").alias("value"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, close: price of all lines of a day."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of runs: run_id, study, fingerprint, sharpe, logged_at."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("study"), F.col("event_type").alias("fingerprint"), F.col("value").alias("sharpe"), F.col("ts").alias("logged_at"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with session_index, in_index and is_month_end."""
    b, iv = indexed_bars(spark, sf_dir), intervals(spark, sf_dir)
    days = calendar(spark, sf_dir).select("date", "is_month_end")
    member = b.join(iv, (b.security_id == iv.security_id) & (b.date >= iv.start_date) & (iv.end_is_open | (b.date <= iv.end_date)), "left_semi").select("security_id", "date").withColumn("in_index", F.lit(True))
    return b.join(member, ["security_id", "date"], "left").withColumn("in_index", F.coalesce("in_index", F.lit(False))).join(F.broadcast(days), "date")


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity curves: run_id (the part of the market by supplier modulo 5), date, nav = 100 + running mean-price moves."""
    b = bars(spark, sf_dir)
    mean = b.groupBy(F.pmod("security_id", F.lit(5)).cast("long").alias("run_id"), "date").agg(F.avg("close").alias("p"))
    w = Window.partitionBy("run_id").orderBy("date")
    return mean.select("run_id", "date", (F.avg("p").over(w.rowsBetween(-9, 0))).alias("nav"))


def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten securities with bars on nearly all sessions: bars of suppliers modulo 10, session_index, is_month_end, in_index
    (by id and month), dollar_volume (trailing median), half_spread, raw_open, and cum_split (two for one, on a day by id)."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_suppkey")
    b = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.pmod("l_suppkey", F.lit(10)).alias("security_id"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(F.min_by(px, key).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, key).alias("close"), F.sum("l_quantity").alias("volume"))
    )
    b = b.join(F.broadcast(calendar(spark, sf_dir).select("date", "session_index", "is_month_end")), "date")
    value = F.col("close") * F.col("volume")
    w = Window.partitionBy("security_id").orderBy("session_index").rangeBetween(-19, 0)
    return b.withColumns(
        {
            "in_index": (F.col("security_id") + F.month("date")) % 4 != 0,
            "dollar_volume": F.when(F.count(value).over(w) >= 10, F.percentile(value, F.lit(0.5)).over(w)),
            "half_spread": 0.0005 * (1 + F.col("security_id") % 3),
            "raw_open": F.col("open"),
            "cum_split": F.when(F.col("session_index") < 800 + 100 * F.col("security_id"), 2.0).otherwise(1.0),
        }
    )
