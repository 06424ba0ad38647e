"""Data-quality checks: each is a query that returns findings (check, severity, entity, detail, rows)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDING = T.StructType().add("check", "string").add("severity", "string").add("entity", "string").add("detail", "string").add("rows", "long")
ORDER = {"ERROR": 0, "WARN": 1, "INFO": 2}


def finding(df: DataFrame, check: str, severity: str, entity: Column | str, detail: Column | str, rows: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), lit(entity).cast("string").alias("entity"), lit(detail).alias("detail"), rows.cast("long").alias("rows"))


def counted(df: DataFrame, check: str, severity: str, rules: dict[str, Column], entity: str = "") -> DataFrame:
    """A finding for each rule that some row breaks; all rules are counted in one pass."""
    names = list(rules)
    totals = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(rules.values())])
    long = totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("d"), F.col(f"r{i}").alias("n")) for i, n in enumerate(names)])).alias("x"))
    return finding(long.where("x.n > 0"), check, severity, entity, F.col("x.d"), F.col("x.n"))


def schema_contract(df: DataFrame, required: list[str], dates: list[str] = (), numbers: list[str] = ()) -> list[str]:
    """What is wrong with the columns of a frame: missing ones and numbers of another type."""
    kinds = dict(df.dtypes)
    out = [f"missing column {c}" for c in required if c not in kinds]
    out += [f"{c} is {kinds[c]}, not a number" for c in numbers if c in kinds and not kinds[c].startswith(("double", "float", "int", "bigint", "decimal", "smallint", "tinyint"))]
    return out + [f"{c} is {kinds[c]}, not a date" for c in dates if c in kinds and kinds[c] not in ("date", "string", "timestamp")]


def bar_integrity(bars: DataFrame) -> DataFrame:
    c = {k: F.col(k) for k in ("open", "high", "low", "close", "volume")}
    rules = {
        "high below low": c["high"] < c["low"], "high below open": c["high"] < c["open"] - 1e-9, "high below close": c["high"] < c["close"] - 1e-9, "low above open": c["low"] > c["open"] + 1e-9,
        "low above close": c["low"] > c["close"] + 1e-9, "price not positive": F.least(*[c[k] for k in ("open", "high", "low", "close")]) <= 0, "negative volume": c["volume"] < 0, "no close": c["close"].isNull(),
    }
    return counted(bars, "bar_integrity", "ERROR", rules)


def primary_key(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows that share their key with another, all members counted."""
    dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.sum("n").alias("n")).where("n > 0")
    return finding(dup, "primary_key", "ERROR", name, "duplicate " + ", ".join(key), F.col("n"))


def identity_mapping(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of a with several b, and of b with several a."""
    one = df.groupBy(F.col(a).cast("string").alias("e")).agg(F.countDistinct(b).alias("n")).where("n > 1")
    two = df.groupBy(F.col(b).cast("string").alias("e")).agg(F.countDistinct(a).alias("n")).where("n > 1")
    return finding(one, "identity_mapping", "ERROR", F.col("e"), f"{a} with several {b}", F.col("n")).union(finding(two, "identity_mapping", "ERROR", F.col("e"), f"{b} with several {a}", F.col("n")))


def extreme_moves(bars: DataFrame, actions: DataFrame, most: float = 0.5) -> DataFrame:
    """Moves of more than `most` between bars on a day without an action, by security."""
    w = Window.partitionBy("security_id").orderBy("date")
    moves = bars.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).where(F.abs("ret") > most)
    bad = moves.join(actions.select("security_id", "date").distinct(), ["security_id", "date"], "left_anti").groupBy("security_id").agg(F.count(F.lit(1)).alias("n"))
    return finding(bad, "extreme_moves", "WARN", F.col("security_id"), f"moves over {most:.0%} without an action", F.col("n"))


def stale_prices(bars: DataFrame, most: int = 5) -> DataFrame:
    """Runs of more than `most` equal closes: islands in the order of a security's bars."""
    w = Window.partitionBy("security_id").orderBy("date")
    x = bars.withColumns({"_i": F.row_number().over(w), "_j": F.row_number().over(Window.partitionBy("security_id", "close").orderBy("date"))})
    runs = x.groupBy("security_id", "close", (F.col("_i") - F.col("_j")).alias("g")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return finding(runs, "stale_prices", "WARN", F.col("security_id"), "equal closes in a row", F.col("n"))


def calendar_gaps(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions between a security's first and last bar on which it has none."""
    b = bars.join(F.broadcast(calendar.select("date", "session_index")), "date").groupBy("security_id").agg(F.min("session_index").alias("a"), F.max("session_index").alias("z"), F.countDistinct("date").alias("n"))
    gaps = b.withColumn("missing", F.col("z") - F.col("a") + 1 - F.col("n")).where("missing > 0")
    return finding(gaps, "calendar_gaps", "INFO", F.col("security_id"), "sessions without a bar", F.col("missing"))


def off_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    bad = bars.join(F.broadcast(calendar.select("date")), "date", "left_anti").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return finding(bad, "off_calendar", "ERROR", "bars", "bars on days that are no sessions", F.col("n"))


def orphans(df: DataFrame, master: DataFrame, key: str, name: str) -> DataFrame:
    bad = df.select(key).distinct().join(master.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return finding(bad, "referential_integrity", "ERROR", name, f"{key} not in the master", F.col("n"))


def membership(intervals: DataFrame) -> DataFrame:
    """Inverted intervals, closed ones without an end, several open ones, and overlaps."""
    w = Window.partitionBy("security_id").orderBy("start_date", "end_date")
    x = intervals.withColumns({"_end": F.max("end_date").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_open": F.sum(F.col("end_is_open").cast("int")).over(Window.partitionBy("security_id"))})
    rules = {"ends before it starts": F.col("end_date") < F.col("start_date"), "closed without an end": ~F.col("end_is_open") & F.col("end_date").isNull(), "several open": F.col("end_is_open") & (F.col("_open") > 1), "overlaps the one before": F.col("_end") >= F.col("start_date")}
    return counted(x, "membership_intervals", "ERROR", rules)


def trading_calendar(calendar: DataFrame) -> DataFrame:
    w = Window.orderBy("date")
    x = calendar.withColumns({"_n": F.lag("session_index").over(w), "_d": F.lag("date").over(w)})
    rules = {"session on a weekend": F.weekday("date") >= 5, "index not contiguous": F.col("session_index") != F.col("_n") + 1, "duplicate date": F.col("date") == F.col("_d"), "gap over 7 days": F.datediff("date", "_d") > 7}
    return counted(x, "trading_calendar", "ERROR", rules)


def adjustment_factors(factors: DataFrame) -> DataFrame:
    """Factors that are not positive, and securities whose newest is not 1."""
    newest = factors.groupBy("security_id").agg(F.max_by("adj_factor", "date").alias("f"))
    return counted(factors, "adjustment_factors", "ERROR", {"not positive": ~(F.col("adj_factor") > 0)}).union(counted(newest, "adjustment_factors", "ERROR", {"newest is not 1": F.abs(F.col("f") - 1) > 1e-9}))


def adjusted_bars(adjusted: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    off = F.abs(F.col("adj_close") - F.col("close") * F.col("adj_factor")) > tolerance * F.abs(F.col("close"))
    return counted(adjusted, "adjusted_bars", "ERROR", {"adjusted is not raw times factor": off})


def corporate_actions(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """Values that are not positive, unknown kinds, duplicates, and dividends over half the close before."""
    prior = bars.select("security_id", "date", F.lag("close").over(Window.partitionBy("security_id").orderBy("date")).alias("_c"))
    x = actions.join(prior, ["security_id", "date"], "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("security_id", "date", "action_type")))
    rules = {"value not positive": ~(F.col("value") > 0), "unknown kind": ~F.col("action_type").isin("dividend", "split"), "duplicate": F.col("_n") > 1, "dividend over half the price": (F.col("action_type") == "dividend") & (F.col("value") > F.col("_c") / 2)}
    return counted(x, "corporate_actions", "ERROR", rules)


def fundamentals(facts: DataFrame, key: tuple[str, ...] = ("security_id", "tag", "period_end", "filed_date", "accession")) -> DataFrame:
    x = facts.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    return counted(x, "fundamentals", "ERROR", {"filed before its period ends": F.col("filed_date") < F.col("period_end"), "duplicate": F.col("_n") > 1, "huge value": F.abs("value") > 1e13, "no filing date": F.col("filed_date").isNull()})


def macro(series: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Duplicates, series without a value, and values out of a series' range."""
    x = series.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy("series_id", "date")), "_k": F.count("value").over(Window.partitionBy("series_id"))})
    out = reduce(lambda a, b: a | b, [(F.col("series_id") == k) & ~F.col("value").between(lo, hi) for k, (lo, hi) in ranges.items()], F.lit(False))
    return counted(x, "macro_integrity", "ERROR", {"duplicate": F.col("_n") > 1, "series without values": F.col("_k") == 0, "out of range": out})


def staleness(series: DataFrame, newest: Column, most: int = 14) -> DataFrame:
    last = series.where("value IS NOT NULL").groupBy("series_id").agg(F.max("date").alias("d")).withColumn("lag", F.datediff(newest, "d")).where(F.col("lag") > most)
    return finding(last, "macro_staleness", "WARN", F.col("series_id"), "days behind the newest bar", F.col("lag"))


def history_depth(series: DataFrame, years: float = 5.0) -> DataFrame:
    span = series.where("value IS NOT NULL").groupBy("series_id").agg(F.datediff(F.max("date"), F.min("date")).alias("n")).where(F.col("n") < years * 365.25)
    return finding(span, "macro_history_depth", "WARN", F.col("series_id"), "days of history", F.col("n"))


def cross_source(a: DataFrame, b: DataFrame, tolerance: float, name: str) -> DataFrame:
    """Share of common dates on which two sources (date, value) differ by more than the tolerance, and their median gap."""
    j = a.select("date", F.col("value").alias("x")).join(b.select("date", F.col("value").alias("y")), "date").withColumn("gap", F.abs(F.col("x") - F.col("y")))
    s = j.agg(F.count_if(F.col("gap") > tolerance).alias("n"), F.percentile("gap", F.lit(0.5)).alias("m")).where("n > 0")
    return finding(s, "cross_source", "WARN", name, F.concat(F.lit("median gap "), F.format_number("m", 4)), F.col("n"))


def tracks(a: DataFrame, b: DataFrame, least: float, name: str) -> DataFrame:
    """Two price series (date, value) whose returns correlate less than they should; with the slope of one on the other."""
    w = Window.orderBy("date")
    j = a.select("date", F.col("value").alias("x")).join(b.select("date", F.col("value").alias("y")), "date")
    r = j.select((F.col("x") / F.lag("x").over(w) - 1).alias("x"), (F.col("y") / F.lag("y").over(w) - 1).alias("y"))
    s = r.agg(F.corr("x", "y").alias("c"), F.regr_slope("x", "y").alias("s"), F.count("x").alias("n")).where(F.col("c") < least)
    return finding(s, "tracking", "ERROR", name, F.concat(F.lit("correlation "), F.format_number("c", 3), F.lit(", slope "), F.format_number("s", 3)), F.col("n"))


def bounds(df: DataFrame, check: str, column: str, lo: float, hi: float) -> DataFrame:
    return counted(df, check, "ERROR", {f"{column} out of bounds": ~F.col(column).between(lo, hi), f"{column} is null": F.col(column).isNull()})


def labels(df: DataFrame, check: str, column: str, allowed: list[str]) -> DataFrame:
    return counted(df, check, "ERROR", {f"unknown {column}": ~F.col(column).isin(allowed)})


def snapshot_sizes(snapshots: DataFrame, lo: int, hi: int, when: str = "month") -> DataFrame:
    bad = snapshots.groupBy(when).agg(F.count(F.lit(1)).alias("n")).where(~F.col("n").between(lo, hi))
    return finding(bad, "membership_sanity", "ERROR", F.col(when), "implausible size", F.col("n"))


def changes_per_year(changes: DataFrame, when: str, least_share: float = 0.5) -> DataFrame:
    """Years with fewer than a share of the median number of events."""
    y = changes.groupBy(F.year(when).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    m = y.agg(F.percentile("n", F.lit(0.5)).alias("m"))
    return finding(y.crossJoin(F.broadcast(m)).where(F.col("n") < least_share * F.col("m")), "changes_completeness", "INFO", F.col("y"), "fewer events than usual", F.col("n"))


def run(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """All findings, errors first; a check that cannot be planned is itself an error finding."""
    found = []
    for name, check in checks.items():
        try:
            found.append(check())
        except Exception as e:  # noqa: BLE001  the battery goes on
            found.append(spark.createDataFrame([(name, "ERROR", "battery", f"check failed: {type(e).__name__}", 0)], FINDING))
    every = reduce(DataFrame.unionByName, found)
    level = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])
    return every.orderBy(level[F.col("severity")], "check", "entity", "detail")


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"), F.sum("rows").alias("rows"))


def ticker_recycling(bars: DataFrame, intervals: DataFrame, most: int = 365) -> DataFrame:
    """Securities with bars over `most` days after their last membership ended, and members without any bar."""
    last = bars.groupBy("security_id").agg(F.max("date").alias("last_bar"))
    ended = intervals.groupBy("security_id").agg(F.max(F.when(~F.col("end_is_open"), F.col("end_date"))).alias("exit"), F.max(F.col("end_is_open").cast("int")).alias("open"))
    x = ended.join(last, "security_id", "left")
    late = x.where((F.col("open") == 0) & (F.datediff("last_bar", "exit") > most)).withColumn("n", F.datediff("last_bar", "exit"))
    none = x.where("last_bar IS NULL").withColumn("n", F.lit(0))
    return finding(late, "ticker_recycling", "WARN", F.col("security_id"), "days of bars after the exit", F.col("n")).union(finding(none, "ticker_recycling", "WARN", F.col("security_id"), "member without bars", F.col("n")))


def universe_coverage(bars: DataFrame, intervals: DataFrame, least: float = 0.8) -> DataFrame:
    """Share of all members that have a bar within membership, a finding if under `least`."""
    inside = bars.join(intervals.withColumnRenamed("security_id", "_s"), (F.col("security_id") == F.col("_s")) & (F.col("date") >= F.col("start_date")) & (F.col("end_is_open") | (F.col("date") <= F.col("end_date"))), "left_semi")
    s = intervals.agg(F.countDistinct("security_id").alias("all")).crossJoin(inside.agg(F.countDistinct("security_id").alias("n"))).where(F.col("n") < least * F.col("all"))
    return finding(s, "universe_coverage", "WARN", "members", F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("all").cast("string")), F.col("all") - F.col("n"))


def security_master(master: DataFrame) -> DataFrame:
    """Ids that are no SID and six digits, repeated ids or natural keys, empty tickers."""
    x = master.withColumns({"_a": F.count(F.lit(1)).over(Window.partitionBy("security_id")), "_b": F.count(F.lit(1)).over(Window.partitionBy("cik", "ticker"))})
    return counted(x, "security_master", "ERROR", {"malformed id": ~F.col("security_id").rlike(r"^SID\d{6}$"), "repeated id": F.col("_a") > 1, "repeated key": F.col("_b") > 1, "no ticker": F.coalesce(F.trim("ticker"), F.lit("")) == ""})


def factor_sanity(factors: DataFrame, columns: list[str], most: float = 0.25, mean: float = 0.002) -> DataFrame:
    """Daily factors out of bounds, and columns whose mean is implausible."""
    rules = {f"{c} out of bounds": F.abs(c) > most for c in columns}
    means = factors.agg(*[F.abs(F.avg(c)).alias(c) for c in columns])
    return counted(factors, "factor_sanity", "ERROR", rules).union(counted(means, "factor_sanity", "WARN", {f"mean of {c}": F.col(c) > mean for c in columns}))


def benchmarks(bars: DataFrame, calendar: DataFrame | None = None, pays: str | None = None) -> DataFrame:
    """Benchmark series: impossible prices, repeated (ticker, date), negative dividends and splits, a series that must pay dividends
    but has none, and (as INFO) rows that are on no session of the calendar."""
    c = F.col
    rules = {"impossible prices": (c("high") < c("low")) | (c("high") < c("open") - 1e-9) | (c("high") < c("close") - 1e-9) | (c("low") > c("open") + 1e-9) | (c("low") > c("close") + 1e-9) | (c("close") <= 0)}
    rules |= {f"negative {n}": c(k) < 0 for k, n in (("dividend", "dividend"), ("split_ratio", "split ratio")) if k in bars.columns}
    out = counted(bars, "benchmarks", "ERROR", rules).unionByName(primary_key(bars, ["ticker", "date"], "benchmarks"))
    if pays is not None and "dividend" in bars.columns:
        paid = bars.where(c("ticker") == pays).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(c("dividend"), F.lit(0.0))).alias("most")).where("n > 0 AND most <= 0")
        out = out.unionByName(finding(paid, "benchmarks", "ERROR", pays, f"no dividends of {pays}", F.lit(1)))
    if calendar is not None:
        off = bars.join(F.broadcast(calendar.select("date")), "date", "left_anti").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        out = out.unionByName(finding(off, "benchmarks", "INFO", "", "not a session", c("n")))
    return out
