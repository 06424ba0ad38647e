"""Queries over point-in-time tables, adjustment and the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.operators import adjust, identity, panel, pit
from pitlake.plans import standins as S
from pitlake.plans.oracle import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, *ctes: str):
    """Register a function as a query, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text, *ctes)
        return f

    return add


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def r(c, n: int = 6):
    return F.round(c, n)


@query("SELECT strftime(date, '%Y-%m-%d') AS date, year(date)::INT AS year, month(date)::INT AS month, (isodow(date) - 1)::INT AS day_of_week, is_month_end, is_quarter_end, is_year_end, session_index::INT AS session_index FROM cal", "cal")
def trading_calendar(spark: SparkSession, d: str) -> DataFrame:
    return S.calendar(spark, d).withColumn("date", day("date"))


@query("SELECT security_id, strftime(date, '%Y-%m-%d') AS date, open, high, low, close, volume FROM bars", "bars")
def daily_bars(spark, d):
    return S.bars(spark, d).select("security_id", day("date").alias("date"), "open", "high", "low", "close", "volume")


@query("SELECT security_id, strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date, end_is_open FROM intervals", "intervals")
def membership_intervals(spark, d):
    return S.intervals(spark, d).select("security_id", day("start_date").alias("start_date"), day("end_date").alias("end_date"), "end_is_open")


@query("SELECT security_id, strftime(start_date, '%Y-%m-%d') AS start_date, end_is_open FROM intervals WHERE start_date <= DATE '1998-06-15' AND (end_is_open OR end_date >= DATE '1998-06-15')", "intervals")
def universe_asof(spark, d):
    return pit.universe_asof(S.intervals(spark, d), "1998-06-15").select("security_id", day("start_date").alias("start_date"), "end_is_open")


@query("""SELECT strftime(c.date, '%Y-%m-%d') AS as_of, count(*) AS members FROM cal c JOIN intervals i ON i.start_date <= c.date AND (i.end_is_open OR i.end_date >= c.date)
          WHERE c.is_month_end GROUP BY ALL""", "cal", "intervals")
def universe_asof_dates(spark, d):
    dates = S.calendar(spark, d).where("is_month_end").select(F.col("date").alias("as_of"))
    return pit.universe_asof(S.intervals(spark, d), dates).groupBy(day("as_of").alias("as_of")).agg(F.count(F.lit(1)).alias("members"))


@query("""SELECT security_id, tag, strftime(period_end, '%Y-%m-%d') AS period_end, strftime(filed_date, '%Y-%m-%d') AS filed_date, accession, value FROM (
          SELECT *, row_number() OVER (PARTITION BY security_id, tag, period_end ORDER BY filed_date DESC, accession DESC) k FROM facts WHERE filed_date <= DATE '1998-06-15')
          WHERE k = 1""", "facts")
def fundamentals_asof(spark, d):
    return pit.latest_visible(S.facts(spark, d), "1998-06-15").withColumns({"period_end": day("period_end"), "filed_date": day("filed_date")})


@query("""SELECT i.security_id, count(*) AS rows_, count(DISTINCT b.date) AS days FROM bars b JOIN intervals i ON b.security_id = i.security_id
          AND b.date > i.start_date - 60 AND (i.end_is_open OR b.date <= i.end_date + 10) GROUP BY ALL""", "bars", "intervals")
def prices_clipped(spark, d):
    found = pit.clipped(S.bars(spark, d), S.intervals(spark, d), 60, 10)
    return found.groupBy("security_id").agg(F.count(F.lit(1)).alias("rows_"), F.countDistinct("date").alias("days"))


@query("""SELECT security_id, strftime(date, '%Y-%m-%d') AS date, close FROM bars b WHERE EXISTS (SELECT 1 FROM intervals i WHERE b.security_id = i.security_id
          AND b.date > i.start_date - 60 AND (i.end_is_open OR b.date <= i.end_date))""", "bars", "intervals")
def prices_clipped_once(spark, d):
    return pit.clipped(S.bars(spark, d), S.intervals(spark, d), 60, dedupe=True).select("security_id", day("date").alias("date"), "close")


@query("SELECT security_id, strftime(date, '%Y-%m-%d') AS date, value FROM actions WHERE action_type = 'split'", "actions")
def split_events(spark, d):
    return S.actions(spark, d).where("action_type = 'split'").select("security_id", day("date").alias("date"), "value").orderBy("security_id", "date")


FACTORS = """factors AS (
  SELECT security_id, date, coalesce(exp(sum(ln(s * m)) OVER w), 1.0) AS adj_factor, coalesce(exp(sum(ln(s)) OVER w), 1.0) AS adj_factor_price
  FROM (SELECT b.security_id, b.date, CASE WHEN a.split > 0 THEN 1 / a.split ELSE 1.0 END AS s,
               CASE WHEN 1 - coalesce(a.dividend, 0) / lag(b.close) OVER (PARTITION BY b.security_id ORDER BY b.date) > 0
                    THEN 1 - coalesce(a.dividend, 0) / lag(b.close) OVER (PARTITION BY b.security_id ORDER BY b.date) ELSE 1.0 END AS m
        FROM bars b LEFT JOIN (SELECT security_id, date, sum(value) FILTER (action_type = 'dividend') AS dividend, max(value) FILTER (action_type = 'split') AS split
                               FROM actions GROUP BY ALL) a USING (security_id, date))
  WINDOW w AS (PARTITION BY security_id ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {FACTORS} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round(ln(adj_factor), 5) AS log_factor, round(ln(adj_factor_price), 5) AS log_price_factor FROM factors", "bars", "actions")
def adjustment_factors(spark, d):
    f = adjust.compute_factors(S.bars(spark, d), S.actions(spark, d))
    return f.select("security_id", day("date").alias("date"), r(F.ln("adj_factor"), 5).alias("log_factor"), r(F.ln("adj_factor_price"), 5).alias("log_price_factor"))


@query(f"WITH {FACTORS} SELECT security_id, count(*) AS bars, round(max(adj_factor), 5) AS newest FROM factors JOIN bars USING (security_id, date) WHERE abs(close * adj_factor / close - adj_factor) < 1e-9 GROUP BY ALL", "bars", "actions")
def adjusted_bars(spark, d):
    a = adjust.apply_factors(S.bars(spark, d), adjust.compute_factors(S.bars(spark, d), S.actions(spark, d)))
    return a.where(F.abs(F.col("adj_close") / F.col("close") - F.col("adj_factor")) < 1e-9).groupBy("security_id").agg(F.count(F.lit(1)).alias("bars"), r(F.max("adj_factor"), 5).alias("newest"))


@query("""WITH v AS (SELECT security_id, date, close AS a, close * (1 + 1e-5 * (security_id % 3)) * CASE WHEN day(date) = 1 THEN 1.001 ELSE 1 END AS v FROM bars),
          d AS (SELECT security_id, abs((a / lag(a) OVER w - 1) - (v / lag(v) OVER w - 1)) AS d FROM v WINDOW w AS (PARTITION BY security_id ORDER BY date))
          SELECT security_id, count(*) AS bars, round(quantile_cont(d, 0.5), 6) AS median_ret_diff, round(quantile_cont(d, 0.99), 6) AS p99_ret_diff, round(max(d), 6) AS max_ret_diff, quantile_cont(d, 0.5) > 1e-4 AS flag
          FROM d GROUP BY ALL""", "bars")
def vendor_agreement(spark, d):
    b = S.bars(spark, d)
    vendor = b.select("security_id", "date", (F.col("close") * (1 + F.lit(1e-5) * (F.col("security_id") % 3)) * F.when(F.dayofmonth("date") == 1, 1.001).otherwise(1.0)).alias("vendor_close"))
    a = adjust.agreement(b.withColumnRenamed("close", "adj_close"), vendor)
    return a.withColumns({c: r(c) for c in ("median_ret_diff", "p99_ret_diff", "max_ret_diff")})


@query("""SELECT c.security_id, strftime(c.date, '%Y-%m-%d') AS date, coalesce(pow(2, count(s.date)), 1.0)::DOUBLE AS ratio
          FROM (SELECT DISTINCT security_id, CAST(date_trunc('month', date) AS DATE) AS date FROM bars) c
          LEFT JOIN (SELECT * FROM actions WHERE action_type = 'split') s ON s.security_id = c.security_id AND c.date < s.date GROUP BY ALL""", "bars", "actions")
def cumulative_split_ratio(spark, d):
    days = S.bars(spark, d).select("security_id", F.trunc("date", "month").alias("date")).distinct()
    return adjust.cumulative_split_ratio(days, S.actions(spark, d).where("action_type = 'split'")).withColumn("date", day("date"))


@query("SELECT strftime(date, '%Y-%m-%d') AS date, CASE WHEN date < DATE '2001-04-09' THEN 0.0625 ELSE 0.01 END::DOUBLE AS tick FROM cal", "cal")
def tick_size(spark, d):
    from pitlake.functions.exprs import tick_size as tick

    return S.calendar(spark, d).select(day("date").alias("date"), tick(F.col("date")).cast("double").alias("tick"))


@query("""WITH f AS (SELECT date, close, coalesce(exp(sum(ln(m)) OVER (ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS k FROM (
            SELECT date, close, CASE WHEN day(date) = 1 THEN coalesce(1 - 0.5 / lag(close) OVER (ORDER BY date), 1) ELSE 1.0 END AS m FROM bench))
          SELECT round(pow(arg_max(close * k, date) / arg_min(close * k, date), 365.25 / date_diff('day', min(date), max(date))) - 1, 6) AS total,
                 round(pow(arg_max(close, date) / arg_min(close, date), 365.25 / date_diff('day', min(date), max(date))) - 1, 6) AS price FROM f""", "bench")
def benchmark_growth(spark, d):
    b = S.benchmark(spark, d)
    tr = adjust.total_return(b, b.where(F.dayofmonth("date") == 1).select("date", F.lit(0.5).alias("value")))
    total = adjust.cagr(tr.select("date", "tr"), "tr").select(r("cagr").alias("total"))
    return total.crossJoin(adjust.cagr(b, "close").select(r("cagr").alias("price")))


PANEL_SQL = """pan AS (SELECT p.*, CASE WHEN count(close * volume) OVER w >= 10 THEN quantile_cont(close * volume, 0.5) OVER w END AS dv FROM panel p
  WINDOW w AS (PARTITION BY security_id ORDER BY session_index RANGE BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {PANEL_SQL} SELECT security_id, count(*) AS bars, count(*) FILTER (in_index) AS member_bars, count(dv) AS liquid, min(session_index)::INT AS first_session, max(session_index)::INT AS last_session, CAST(max(dv) AS FLOAT)::DOUBLE AS top FROM pan GROUP BY ALL", "panel")
def panel_build(spark, d):
    p = panel.build(S.bars(spark, d), S.intervals(spark, d), S.calendar(spark, d)).withColumn("top", F.col("dollar_volume"))
    return p.groupBy("security_id").agg(
        F.count(F.lit(1)).alias("bars"), F.count_if("in_index").alias("member_bars"), F.count("dollar_volume").alias("liquid"),
        F.first("first_session").alias("first_session"), F.first("last_session").alias("last_session"), F.max(F.col("top").cast("double")).alias("top"),
    )


@query("SELECT strftime(date, '%Y-%m-%d') AS date, (SELECT count(*) FROM intervals i WHERE i.start_date <= c.date AND (i.end_is_open OR i.end_date >= c.date)) AS size FROM cal c", "cal", "intervals")
def index_size(spark, d):
    return panel.index_size(S.intervals(spark, d), S.calendar(spark, d)).select(day("date").alias("date"), "size")


@query("""SELECT strftime(p.date, '%Y-%m-%d') AS date, count(*) FILTER (in_index) AS priced, s.size, round(count(*) FILTER (in_index) / s.size, 6) AS coverage
          FROM panel p JOIN (SELECT date, (SELECT count(*) FROM intervals i WHERE i.start_date <= c.date AND (i.end_is_open OR i.end_date >= c.date)) AS size FROM cal c) s USING (date)
          WHERE is_month_end GROUP BY p.date, s.size""", "panel")
def panel_coverage(spark, d):
    c = panel.coverage(S.panel(spark, d), panel.index_size(S.intervals(spark, d), S.calendar(spark, d)))
    return c.select(day("date").alias("date"), "priced", "size", r("coverage").alias("coverage"))


@query("""SELECT strftime(x.date, '%Y-%m-%d') AS date, (SELECT max(session_index) FROM cal WHERE cal.date = x.date)::INT AS exact, (SELECT max(session_index) FROM cal WHERE cal.date <= x.date)::INT AS prev,
          (SELECT min(session_index) FROM cal WHERE cal.date >= x.date)::INT AS next FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE day(o_orderdate) = 15) x""", "cal")
def session_lookup(spark, d):
    dates = S.table(spark, d, "orders").where(F.dayofmonth("o_orderdate") == 15).select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return panel.session_lookup(S.calendar(spark, d), dates).withColumn("date", day("date"))


@query("SELECT s_suppkey AS security_id FROM supplier WHERE s_suppkey NOT IN (SELECT security_id FROM bars WHERE date < DATE '1995-02-01')", "bars")
def never_priced(spark, d):
    members = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("security_id"))
    return panel.never_priced(members, S.bars(spark, d).where("date < DATE '1995-02-01'"))


@query("SELECT count(*) AS n, max(session_index)::INT AS last, round(sum(close), 3) AS total FROM ibars WHERE session_index <= 700", "ibars")
def panel_truncated(spark, d):
    p = panel.truncate(S.indexed_bars(spark, d), 700)
    return p.agg(F.count(F.lit(1)).alias("n"), F.max("session_index").alias("last"), r(F.sum("close"), 3).alias("total"))


@query("""SELECT a.security_id, a.session_index::INT AS session_index, round(b.close / c.close - 1, 6) AS ret FROM ibars a LEFT JOIN ibars b ON b.security_id = a.security_id AND b.session_index = a.session_index - 5
          LEFT JOIN ibars c ON c.security_id = a.security_id AND c.session_index = a.session_index - 25""", "ibars")
def lookback_return(spark, d):
    return panel.lookback_return(S.indexed_bars(spark, d), 20, 5, "ret").select("security_id", "session_index", r("ret").alias("ret"))


@query("""SELECT security_id, session_index::INT AS session_index, round(CASE WHEN lag(session_index) OVER w = session_index - 1 THEN close / lag(close) OVER w - 1 END, 6) AS ret FROM ibars
          WINDOW w AS (PARTITION BY security_id ORDER BY session_index)""", "ibars")
def session_returns(spark, d):
    return S.indexed_bars(spark, d).select("security_id", "session_index", r(panel.session_return()).alias("ret"))


@query("""SELECT l.security_id, strftime(l.date, '%Y-%m-%d') AS date, r.accession, r.value FROM (SELECT DISTINCT security_id, CAST(date_trunc('month', filed_date) AS DATE) AS date FROM facts) l
          ASOF LEFT JOIN (SELECT security_id, filed_date, arg_max(accession, accession) AS accession, arg_max(value, accession) AS value FROM facts GROUP BY ALL) r
          ON l.security_id = r.security_id AND l.date >= r.filed_date""", "facts")
def asof_join(spark, d):
    f = S.facts(spark, d)
    grid = f.select("security_id", F.trunc("filed_date", "month").alias("date")).distinct()
    return pit.asof_join(grid, f, ["security_id"], "date", "filed_date", ["accession", "value"], ["accession"]).withColumn("date", day("date"))


@query("""WITH l AS (SELECT security_id, start_date FROM intervals), x AS (SELECT l.security_id, l.start_date, a.date, a.value, abs(a.date - l.start_date) AS gap FROM l LEFT JOIN (SELECT * FROM actions WHERE action_type = 'split') a
          ON a.security_id = l.security_id AND abs(a.date - l.start_date) <= 365)
          SELECT security_id, strftime(start_date, '%Y-%m-%d') AS start_date, gap::INT AS gap_days, strftime(date, '%Y-%m-%d') AS date FROM (SELECT *, row_number() OVER (PARTITION BY security_id, start_date ORDER BY gap, date) k FROM x) WHERE k = 1""", "intervals", "actions")
def nearest_join(spark, d):
    left = S.intervals(spark, d).select("security_id", "start_date")
    right = S.actions(spark, d).where("action_type = 'split'").withColumn("when", F.col("date"))
    n = pit.nearest_join(left, right, "security_id", "start_date", "date", ["when"])
    return n.select("security_id", day("start_date").alias("start_date"), "gap_days", day("when").alias("date"))


@query("""SELECT security_id, tag, strftime(period_end, '%Y-%m-%d') AS period_end, strftime(filed_date, '%Y-%m-%d') AS filed_date, accession, value FROM (
          SELECT *, max(period_end) OVER (PARTITION BY security_id, tag ORDER BY filed_date, accession ROWS UNBOUNDED PRECEDING) AS top FROM facts) WHERE period_end = top""", "facts")
def restatement_frontier(spark, d):
    return pit.frontier(S.facts(spark, d)).withColumns({"period_end": day("period_end"), "filed_date": day("filed_date")})


@query("""WITH first AS (SELECT security_id, tag, period_end, lag(v, 4) OVER (PARTITION BY security_id, tag ORDER BY period_end) AS lagged FROM (
            SELECT security_id, tag, period_end, arg_min(value, accession) AS v FROM (SELECT *, rank() OVER (PARTITION BY security_id, tag, period_end ORDER BY filed_date) k FROM facts) WHERE k = 1 GROUP BY ALL)),
          fr AS (SELECT * FROM (SELECT *, max(period_end) OVER (PARTITION BY security_id, tag ORDER BY filed_date, accession ROWS UNBOUNDED PRECEDING) AS top FROM facts) WHERE period_end = top)
          SELECT fr.accession, fr.value, lagged FROM fr LEFT JOIN first USING (security_id, tag, period_end)""", "facts")
def frontier_with_lag(spark, d):
    return pit.with_lag(S.facts(spark, d), 4).select("accession", "value", "lagged")


REV = """rev AS (SELECT security_id, filed_date, count(*) AS facts, count(*) FILTER (was IS NULL) AS first_filings, count(*) FILTER (abs(value - was) > 0.01 * abs(was)) AS revised FROM (
  SELECT *, lag(value) OVER (PARTITION BY security_id, tag, period_end ORDER BY filed_date, accession) AS was FROM facts) GROUP BY security_id, filed_date)"""


@query(f"WITH {REV} SELECT security_id, strftime(filed_date, '%Y-%m-%d') AS filed_date, facts, first_filings::BIGINT AS first_filings, revised::BIGINT AS revised FROM rev", "facts")
def revision_counts(spark, d):
    return pit.revisions(S.facts(spark, d)).withColumn("filed_date", day("filed_date"))


@query(f"WITH {REV} SELECT security_id, strftime(filed_date, '%Y-%m-%d') AS filed_date, round(CASE WHEN sum(facts) OVER w > 20 THEN sum(revised) OVER w / sum(facts) OVER w END, 6) AS restatement_rate FROM rev WINDOW w AS (PARTITION BY security_id ORDER BY filed_date)", "facts")
def restatement_rate(spark, d):
    return pit.restatement_rate(S.facts(spark, d)).select("security_id", day("filed_date").alias("filed_date"), r("restatement_rate").alias("restatement_rate"))


@query("""WITH f AS (SELECT security_id, tag, period_end, arg_min(value, accession) AS value FROM (SELECT *, rank() OVER (PARTITION BY security_id, tag, period_end ORDER BY filed_date) k FROM facts) WHERE k = 1 GROUP BY ALL),
          d AS (SELECT *, value - lag(value, 4) OVER (PARTITION BY security_id, tag ORDER BY period_end) AS d FROM f),
          s AS (SELECT *, CASE WHEN count(d) OVER w >= 4 THEN stddev_samp(d) OVER w END AS sd FROM d WINDOW w AS (PARTITION BY security_id, tag ORDER BY period_end ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
          SELECT security_id, tag, strftime(period_end, '%Y-%m-%d') AS period_end, round(CASE WHEN sd > 0 THEN greatest(least(d / sd, 10), -10) END, 5) AS sue FROM s""", "facts")
def earnings_surprise(spark, d):
    return pit.earnings_surprise(S.facts(spark, d)).select("security_id", "tag", day("period_end").alias("period_end"), r("sue", 5).alias("sue"))


@query("SELECT security_id, strftime(filed_date, '%Y-%m-%d') AS filed_date, (filed_date - max(period_end))::INT AS lag_days FROM facts GROUP BY security_id, filed_date", "facts")
def filing_lag(spark, d):
    return pit.filing_lag(S.facts(spark, d)).withColumn("filed_date", day("filed_date"))


@query("""SELECT strftime(arg_max(date, date), '%Y-%m-%d') AS date, arg_max(close, date) AS close FROM (SELECT date, round(close, 6) AS close FROM bench) GROUP BY date_trunc('month', date)""", "bench")
def last_per_month(spark, d):
    return identity.last_of_month(S.benchmark(spark, d).withColumn("close", r("close")), "date").select(day("date").alias("date"), "close")


@query("SELECT DISTINCT upper(replace(replace(replace(trim(p_brand), '-', '.'), '/', '.'), ' ', '')) AS ticker FROM part")
def normalize_ticker(spark, d):
    return S.table(spark, d, "part").select(identity.normalize_ticker(F.col("p_brand")).alias("ticker")).distinct()


@query("""WITH known AS (SELECT 'SID' || lpad(CAST(row_number() OVER (ORDER BY c_custkey) AS VARCHAR), 6, '0') AS security_id, c_custkey AS cik FROM customer WHERE c_custkey % 3 = 0),
          new AS (SELECT o_custkey AS cik, min(o_orderkey) AS f FROM orders WHERE o_custkey NOT IN (SELECT cik FROM known) GROUP BY 1)
          SELECT security_id, cik FROM known UNION ALL
          SELECT 'SID' || lpad(CAST(row_number() OVER (ORDER BY f, cik) + (SELECT count(*) FROM known) AS VARCHAR), 6, '0'), cik FROM new""")
def assign_ids(spark, d):
    from pyspark.sql import Window

    c = S.table(spark, d, "customer").where("c_custkey % 3 = 0")
    known = c.select(F.format_string("SID%06d", F.row_number().over(Window.orderBy("c_custkey"))).alias("security_id"), F.col("c_custkey").alias("cik"))
    seen = S.table(spark, d, "orders").select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("first_seen"))
    return identity.assign_ids(known, seen, ["cik"], "first_seen")


@query("SELECT DISTINCT p_brand FROM part WHERE p_size > 25 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size <= 2)")
def coverage_vs_missing(spark, d):
    p = S.table(spark, d, "part")
    return identity.set_difference(p.where("p_size > 25"), p.where("p_size <= 2"), "p_brand")
