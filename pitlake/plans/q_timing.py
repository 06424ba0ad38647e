"""Queries over timing rules and the quality battery."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import adjust, quality, timing
from pitlake.plans import standins as S
from pitlake.plans.oracle import sql
from pitlake.plans.q_lake import FACTORS, day, r

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(text: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *ctes)
        return f

    return add


def _one(spark, d):
    """One instrument: security 3 of the dense panel."""
    return S.dense_panel(spark, d).where("security_id = 3").select("session_index", "date", "open", "close")


_LEGS = """one AS (SELECT session_index, date, open, close FROM dense WHERE security_id = 3),
  lg AS (SELECT *, open / lag(close) OVER w - 1 AS r_on, close / open - 1 AS r_id, (lead(date) OVER w - date) AS next_gap, lead(date) OVER w AS next_date,
         row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY session_index) AS f, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY session_index DESC) AS l FROM one WINDOW w AS (ORDER BY session_index))"""
_HOLD = {
    "buy_hold": ("true", "true"),
    "overnight": ("true", "false"),
    "intraday": ("false", "true"),
    "weekend": ("coalesce(isodow(next_date) <= isodow(date), false)", "false"),
    "pre_holiday": ("coalesce(next_gap > 1 AND NOT (isodow(date) = 5 AND next_gap = 3), false)", "coalesce(next_gap > 1 AND NOT (isodow(date) = 5 AND next_gap = 3), false)"),
    "turn_of_month": ("coalesce(lead(f <= 3 OR l = 1) OVER (ORDER BY session_index), false)", "f <= 3 OR l = 1"),
    "month_end_drift": ("coalesce(lead(l <= 5) OVER (ORDER BY session_index), false)", "l <= 5"),
    "sell_in_may": ("coalesce(lead(month(date) IN (11, 12, 1, 2, 3, 4)) OVER (ORDER BY session_index), false)", "month(date) IN (11, 12, 1, 2, 3, 4)"),
}


def _timing(name: str):
    def run(spark, d):
        return timing.gross_path(_one(spark, d), name).select("session_index", r(F.ln("nav"), 5).alias("log_nav"))

    run.__name__ = f"timing_{name}"
    return run


def _entries(name: str):
    def run(spark, d):
        return timing.entries(_one(spark, d), name).select("entries", r("exposure").alias("exposure"))

    run.__name__ = f"schedule_{name}"
    return run


for _n, (_on, _id) in _HOLD.items():
    _h = f"{_LEGS}, h AS (SELECT *, {_on} AS hold_on, {_id} AS hold_id FROM lg)"
    QUERIES[f"timing_{_n}"] = _timing(_n)
    SQL[f"timing_{_n}"] = sql(
        f"WITH {_h}, z AS (SELECT session_index, CASE WHEN coalesce(lag(hold_on) OVER w, false) THEN ln(1 + coalesce(r_on, 0)) ELSE 0 END + CASE WHEN hold_id THEN ln(1 + r_id) ELSE 0 END AS g FROM h WINDOW w AS (ORDER BY session_index)) SELECT session_index::INT AS session_index, round(sum(g) OVER (ORDER BY session_index), 5) AS log_nav FROM z",
        "dense",
    )
    QUERIES[f"schedule_{_n}"] = _entries(_n)
    SQL[f"schedule_{_n}"] = sql(
        f"WITH {_h}, u AS (SELECT session_index AS t, 0 AS leg, hold_id AS x FROM h UNION ALL SELECT session_index, 1, hold_on FROM h), e AS (SELECT x, x AND NOT coalesce(lag(x) OVER (ORDER BY t, leg), false) AS e FROM u) SELECT count(*) FILTER (e) AS entries, round(avg(CASE WHEN x THEN 1.0 ELSE 0 END), 6) AS exposure FROM e",
        "dense",
    )


@_add(f"WITH {_LEGS}, g AS (SELECT session_index, ln(1 + coalesce(CASE WHEN session_index > (SELECT min(session_index) FROM lg) THEN r_on END, 0)) AS o, ln(1 + r_id) AS i FROM lg) SELECT true AS ok, round(sum(o), 5) AS overnight, round(sum(i), 5) AS intraday, round(sum(o + i), 5) AS buy_hold FROM g", "dense")
def timing_identity(spark, d):
    """Overnight times intraday is buy and hold, to 1e-9; and what each comes to."""
    b = _one(spark, d)
    p = {n: timing.gross_path(b, n).select("session_index", F.ln("nav").alias(n)) for n in ("buy_hold", "overnight", "intraday")}
    j = p["buy_hold"].join(p["overnight"], "session_index").join(p["intraday"], "session_index")
    last = {n: r(F.max_by(n, "session_index"), 5).alias(n) for n in p}
    return j.agg((F.max(F.abs(F.col("buy_hold") - F.col("overnight") - F.col("intraday"))) < 1e-9).alias("ok"), *last.values())


@_add("""WITH x AS (SELECT security_id, CASE WHEN in_index AND lag(in_index) OVER w AND lag(session_index) OVER w = session_index - 1 THEN ln(open / lag(close) OVER w) END AS a, CASE WHEN in_index AND lag(in_index) OVER w AND lag(session_index) OVER w = session_index - 1 THEN ln(close / open) END AS b
  FROM dense WINDOW w AS (PARTITION BY security_id ORDER BY session_index)) SELECT security_id, count(a) AS sessions, round(sum(a), 5) AS overnight, round(sum(b), 5) AS intraday FROM x GROUP BY security_id HAVING count(a) >= 500""", "dense")
def overnight_decomposition(spark, d):
    return timing.decompose(S.dense_panel(spark, d)).select("security_id", "sessions", r("overnight", 5).alias("overnight"), r("intraday", 5).alias("intraday"))


# -- quality: clean tables give none, and defects that are put in give theirs ------------------------------------------

_SEL = 'SELECT \'{c}\' AS "check", \'{s}\' AS severity, {e} AS entity, {d} AS detail, {n} AS rows'


def _f(check: str, severity: str, entity: str, detail: str, n: str, rest: str) -> str:
    return _SEL.format(c=check, s=severity, e=entity, d=detail, n=n) + " " + rest


_BAD_BARS = "bad AS (SELECT security_id, date, open, CASE WHEN security_id = 7 THEN low / 2 ELSE high END AS high, low, close, CASE WHEN security_id = 3 AND day(date) = 5 THEN -1 ELSE volume END AS volume FROM bars)"


def _bad(spark, d):
    return S.bars(spark, d).withColumns({"high": F.when(F.col("security_id") == 7, F.col("low") / 2).otherwise(F.col("high")), "volume": F.when((F.col("security_id") == 3) & (F.dayofmonth("date") == 5), -1).otherwise(F.col("volume"))})


_RULES = {"high below low": "high < low", "high below open": "high < open - 1e-9", "high below close": "high < close - 1e-9", "low above open": "low > open + 1e-9", "low above close": "low > close + 1e-9", "price not positive": "least(open, high, low, close) <= 0", "negative volume": "volume < 0", "no close": "close IS NULL"}


@_add(f"WITH {_BAD_BARS} SELECT * FROM (" + " UNION ALL ".join(_f("bar_integrity", "ERROR", "''", f"'{k}'", "count(*)", f"FROM bad WHERE {v}") for k, v in _RULES.items()) + ") WHERE rows > 0", "bars")
def check_bar_integrity(spark, d):
    return quality.bar_integrity(_bad(spark, d))


@_add("SELECT * FROM (" + _f("primary_key", "ERROR", "'lineitem'", "'duplicate l_orderkey, l_linenumber'", "sum(n)::BIGINT", "FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)") + ") WHERE rows > 0")
def check_primary_key(spark, d):
    return quality.primary_key(S.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem")


@_add(_f("identity_mapping", "ERROR", "p_brand", "'p_brand with several p_size'", "count(DISTINCT p_size)", "FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) > 1") + " UNION ALL " + _f("identity_mapping", "ERROR", "CAST(p_size AS VARCHAR)", "'p_size with several p_brand'", "count(DISTINCT p_brand)", "FROM part GROUP BY p_size HAVING count(DISTINCT p_brand) > 1"))
def check_identity_mapping(spark, d):
    return quality.identity_mapping(S.table(spark, d, "part"), "p_brand", "p_size")


@_add(_f("extreme_moves", "WARN", "CAST(security_id AS VARCHAR)", "'moves over 50% without an action'", "count(*)", "FROM (SELECT *, close / lag(close) OVER (PARTITION BY security_id ORDER BY date) - 1 AS ret FROM bars) b WHERE abs(ret) > 0.5 AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.security_id = b.security_id AND a.date = b.date) GROUP BY security_id"), "bars", "actions")
def check_extreme_moves(spark, d):
    return quality.extreme_moves(S.bars(spark, d), S.actions(spark, d))


@_add("WITH x AS (SELECT security_id, date, round(ln(close)) AS close FROM bars), y AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date) - row_number() OVER (PARTITION BY security_id, close ORDER BY date) AS g FROM x) " + _f("stale_prices", "WARN", "CAST(security_id AS VARCHAR)", "'equal closes in a row'", "count(*)", "FROM y GROUP BY security_id, close, g HAVING count(*) > 5"), "bars")
def check_stale_prices(spark, d):
    return quality.stale_prices(S.bars(spark, d).withColumn("close", F.round(F.ln("close"))))


@_add("SELECT * FROM (" + _f("calendar_gaps", "INFO", "CAST(security_id AS VARCHAR)", "'sessions without a bar'", "(max(session_index) - min(session_index) + 1 - count(*))", "FROM ibars GROUP BY security_id") + ") WHERE rows > 0", "ibars")
def check_calendar_gaps(spark, d):
    return quality.calendar_gaps(S.bars(spark, d), S.calendar(spark, d))


@_add("SELECT * FROM (" + _f("off_calendar", "ERROR", "'bars'", "'bars on days that are no sessions'", "count(*)", "FROM bars WHERE date NOT IN (SELECT date FROM cal WHERE session_index % 50 <> 7)") + ") WHERE rows > 0", "bars", "cal")
def check_off_calendar(spark, d):
    return quality.off_calendar(S.bars(spark, d), S.calendar(spark, d).where("session_index % 50 <> 7"))


@_add("SELECT * FROM (" + _f("referential_integrity", "ERROR", "'bars'", "'security_id not in the master'", "count(DISTINCT security_id)", "FROM bars WHERE security_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 <> 4)") + ") WHERE rows > 0", "bars")
def check_orphans(spark, d):
    return quality.orphans(S.bars(spark, d), S.table(spark, d, "supplier").where("s_suppkey % 9 <> 4").select(F.col("s_suppkey").alias("security_id")), "security_id", "bars")


_BADIV = "iv AS (SELECT security_id, start_date, CASE WHEN security_id % 5 = 1 THEN end_date + 40 ELSE end_date END AS end_date, end_is_open OR (security_id % 11 = 2 AND end_date IS NULL) AS end_is_open FROM intervals), z AS (SELECT *, max(end_date) OVER (PARTITION BY security_id ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, sum(CASE WHEN end_is_open THEN 1 ELSE 0 END) OVER (PARTITION BY security_id) AS n FROM iv)"


@_add(f"WITH {_BADIV} SELECT * FROM (" + " UNION ALL ".join(_f("membership_intervals", "ERROR", "''", f"'{k}'", "count(*)", f"FROM z WHERE {v}") for k, v in {"ends before it starts": "end_date < start_date", "closed without an end": "NOT end_is_open AND end_date IS NULL", "several open": "end_is_open AND n > 1", "overlaps the one before": "prev >= start_date"}.items()) + ") WHERE rows > 0", "intervals")
def check_membership_intervals(spark, d):
    iv = S.intervals(spark, d).withColumn("end_date", F.when(F.col("security_id") % 5 == 1, F.date_add("end_date", 40)).otherwise(F.col("end_date")))
    return quality.membership(iv)


@_add("WITH z AS (SELECT *, lag(session_index) OVER (ORDER BY date) AS n, lag(date) OVER (ORDER BY date) AS p FROM cal WHERE session_index % 100 <> 9) SELECT * FROM (" + " UNION ALL ".join(_f("trading_calendar", "ERROR", "''", f"'{k}'", "count(*)", f"FROM z WHERE {v}") for k, v in {"session on a weekend": "isodow(date) >= 6", "index not contiguous": "session_index <> n + 1", "duplicate date": "date = p", "gap over 7 days": "date - p > 7"}.items()) + ") WHERE rows > 0", "cal")
def check_trading_calendar(spark, d):
    return quality.trading_calendar(S.calendar(spark, d).where("session_index % 100 <> 9"))


@_add(f"WITH {FACTORS}, b AS (SELECT security_id, date, CASE WHEN security_id = 8 THEN adj_factor * -1 WHEN security_id = 9 THEN adj_factor * 2 ELSE adj_factor END AS f FROM factors) SELECT * FROM (" + _f("adjustment_factors", "ERROR", "''", "'not positive'", "count(*)", "FROM b WHERE NOT f > 0") + " UNION ALL " + _f("adjustment_factors", "ERROR", "''", "'newest is not 1'", "count(*)", "FROM (SELECT arg_max(f, date) AS f FROM b GROUP BY security_id) WHERE abs(f - 1) > 1e-9") + ") WHERE rows > 0", "bars", "actions")
def check_adjustment_factors(spark, d):
    f = adjust.compute_factors(S.bars(spark, d), S.actions(spark, d))
    return quality.adjustment_factors(f.withColumn("adj_factor", F.when(F.col("security_id") == 8, -F.col("adj_factor")).when(F.col("security_id") == 9, F.col("adj_factor") * 2).otherwise(F.col("adj_factor"))))


@_add("SELECT 'none' AS \"check\", 'INFO' AS severity, '' AS entity, '' AS detail, 0::BIGINT AS rows WHERE 1 = 0")
def check_adjusted_bars(spark, d):
    b = S.bars(spark, d)
    return quality.adjusted_bars(adjust.apply_factors(b, adjust.compute_factors(b, S.actions(spark, d))))


@_add("WITH p AS (SELECT security_id, date, lag(close) OVER (PARTITION BY security_id ORDER BY date) AS c FROM bars), z AS (SELECT a.*, CASE WHEN action_type = 'dividend' AND security_id = 5 THEN value * 1e4 ELSE value END AS v, p.c FROM actions a LEFT JOIN p USING (security_id, date)) SELECT * FROM (" + " UNION ALL ".join(_f("corporate_actions", "ERROR", "''", f"'{k}'", "count(*)", f"FROM z WHERE {v}") for k, v in {"value not positive": "NOT v > 0", "dividend over half the price": "action_type = 'dividend' AND v > c / 2"}.items()) + ") WHERE rows > 0", "actions", "bars")
def check_corporate_actions(spark, d):
    a = S.actions(spark, d).withColumn("value", F.when((F.col("action_type") == "dividend") & (F.col("security_id") == 5), F.col("value") * 1e4).otherwise(F.col("value")))
    return quality.corporate_actions(a, S.bars(spark, d))


@_add("SELECT * FROM (" + _f("fundamentals", "ERROR", "''", "'filed before its period ends'", "count(*)", "FROM facts WHERE filed_date < period_end + CASE WHEN accession % 97 = 0 THEN 200 ELSE 0 END") + ") WHERE rows > 0", "facts")
def check_fundamentals(spark, d):
    f = S.facts(spark, d).withColumn("period_end", F.when(F.col("accession") % 97 == 0, F.date_add("period_end", 200)).otherwise(F.col("period_end")))
    return quality.fundamentals(f)


@_add("SELECT * FROM (" + _f("macro_integrity", "ERROR", "''", "'out of range'", "count(*)", "FROM macro WHERE series_id = 'click' AND NOT value BETWEEN 0 AND 10") + ") WHERE rows > 0", "macro")
def check_macro(spark, d):
    return quality.macro(S.macro(spark, d), {"click": (0.0, 10.0)})


@_add(_f("macro_staleness", "WARN", "series_id", "'days behind the newest bar'", "(DATE '2024-02-10' - max(date))", "FROM macro GROUP BY series_id HAVING DATE '2024-02-10' - max(date) > 5") + " UNION ALL " + _f("macro_history_depth", "WARN", "series_id", "'days of history'", "(max(date) - min(date))", "FROM macro GROUP BY series_id HAVING max(date) - min(date) < 0.5 * 365.25"), "macro")
def check_macro_age(spark, d):
    m = S.macro(spark, d)
    return quality.staleness(m, F.lit("2024-02-10").cast("date"), 5).unionByName(quality.history_depth(m, 0.5))


@_add("WITH a AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS x FROM bench), b AS (SELECT date, avg(close) AS c FROM bars GROUP BY date), r AS (SELECT bench.close / lag(bench.close) OVER (ORDER BY date) - 1 AS x, b.c / lag(b.c) OVER (ORDER BY date) - 1 AS y FROM bench JOIN b USING (date)) SELECT count(x) AS n, round(corr(x, y), 5) AS c, round(regr_slope(x, y), 5) AS s FROM r", "bench", "bars")
def check_tracking(spark, d):
    a = S.benchmark(spark, d).select("date", F.col("close").alias("value"))
    b = S.bars(spark, d).groupBy("date").agg(F.avg("close").alias("value"))
    f = quality.tracks(a, b, 2.0, "index")
    w = F.regexp_extract("detail", r"correlation (\S+),", 1)
    from pyspark.sql import Window

    wd = Window.orderBy("date")
    j = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), "date")
    x = j.select((F.col("x") / F.lag("x").over(wd) - 1).alias("x"), (F.col("y") / F.lag("y").over(wd) - 1).alias("y")).agg(r(F.corr("x", "y"), 5).alias("c"), r(F.regr_slope("x", "y"), 5).alias("s"))
    return f.where(w.isNotNull()).select(F.col("rows").alias("n")).crossJoin(x)


@_add("SELECT severity, count(*) AS findings, sum(rows)::BIGINT AS rows FROM (SELECT 'ERROR' AS severity, count(*) AS rows FROM bars WHERE security_id = 7 HAVING count(*) > 0 UNION ALL SELECT 'INFO', max(session_index) - min(session_index) + 1 - count(*) FROM ibars GROUP BY security_id HAVING max(session_index) - min(session_index) + 1 - count(*) > 0) GROUP BY severity", "ibars")
def quality_battery(spark, d):
    b = S.bars(spark, d)
    found = quality.run(
        spark,
        {
            "keys": lambda: quality.primary_key(b, ["security_id", "date"], "bars"),
            "gaps": lambda: quality.calendar_gaps(b, S.calendar(spark, d)),
            "bad": lambda: quality.counted(b, "planted", "ERROR", {"security 7": F.col("security_id") == 7}),
        },
    )
    return quality.summary(found)
