"""Queries over fundamental, event and macro features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import fundamental_features as ff
from pitlake.operators import pit
from pitlake.plans import standins as S
from pitlake.plans.oracle import sql
from pitlake.plans.q_lake import day, r

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(text: str | None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *ctes)
        return f

    return add


#: What the priorities of orders stand for.
TAGS = {"1-URGENT": "net_income", "2-HIGH": "cash_flow", "3-MEDIUM": "equity", "4-NOT SPECIFIED": "revenue", "5-LOW": "assets"}
_NAMES = "CASE tag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items()) + " END"


def _facts(spark, d):
    table = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    return S.facts(spark, d).withColumn("tag", table[F.col("tag")]).where("tag IS NOT NULL")


def _grid(spark, d):
    return _facts(spark, d).select("security_id", F.last_day("filed_date").alias("date")).distinct()


_ASOF = f"""f AS (SELECT * REPLACE ({_NAMES} AS tag) FROM facts WHERE {_NAMES} IS NOT NULL),
  g AS (SELECT DISTINCT security_id, last_day(filed_date) AS date FROM f),
  lagged AS (SELECT security_id, tag, period_end, lag(v, 4) OVER (PARTITION BY security_id, tag ORDER BY period_end) AS lagged FROM (
      SELECT security_id, tag, period_end, arg_min(value, accession) AS v FROM (SELECT *, rank() OVER (PARTITION BY security_id, tag, period_end ORDER BY filed_date) k FROM f) WHERE k = 1 GROUP BY ALL)),
  fr AS (SELECT security_id, tag, filed_date, arg_max(value, accession) AS value, arg_max(lagged, accession) FILTER (lagged IS NOT NULL) AS lagged0, arg_max(period_end, accession) AS period_end FROM (
      SELECT x.*, l.lagged FROM (SELECT *, max(period_end) OVER (PARTITION BY security_id, tag ORDER BY filed_date, accession ROWS UNBOUNDED PRECEDING) AS top FROM f) x
      LEFT JOIN lagged l USING (security_id, tag, period_end) WHERE period_end = top) GROUP BY ALL),
  fr2 AS (SELECT fr.*, l.lagged FROM fr LEFT JOIN lagged l USING (security_id, tag, period_end)),
  w AS (SELECT g.security_id, g.date, t.tag, fr2.value, fr2.lagged FROM (g CROSS JOIN (SELECT DISTINCT tag FROM f) t) ASOF LEFT JOIN fr2 ON g.security_id = fr2.security_id AND t.tag = fr2.tag AND g.date >= fr2.filed_date),
  v AS (SELECT security_id, date, {', '.join(f"max(value) FILTER (tag = '{t}') AS {t}, max(lagged) FILTER (tag = '{t}') AS {t}_before" for t in TAGS.values())} FROM w GROUP BY ALL)"""


def _values(spark, d):
    wide = ff.values_asof(_facts(spark, d), _grid(spark, d), list(TAGS.values()), 4)
    return wide.select("security_id", "date", *[F.col(f"{t}_v").alias(t) for t in TAGS.values()], *[F.col(f"{t}_lag").alias(f"{t}_before") for t in TAGS.values()])


@_add(f"WITH {_ASOF} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, {', '.join(TAGS.values())}, assets_before FROM v", "facts")
def values_asof(spark, d):
    return _values(spark, d).select("security_id", day("date").alias("date"), *TAGS.values(), "assets_before")


FUNDAMENTAL = {
    "accruals": "CASE WHEN assets > 0 THEN (net_income - cash_flow) / assets END",
    "roe": "CASE WHEN equity > 0 THEN net_income / equity END",
    "leverage": "1 - CASE WHEN assets > 0 THEN equity / assets END",
    "book_to_market": "CASE WHEN market_cap > 0 THEN equity / market_cap END",
    "earnings_yield": "CASE WHEN market_cap > 0 THEN net_income / market_cap END",
    "cf_yield": "CASE WHEN market_cap > 0 THEN cash_flow / market_cap END",
    "buyback_yield": "CASE WHEN market_cap > 0 THEN repurchases / market_cap END",
    "gross_profitability": "CASE WHEN assets > 0 THEN gross_profit / assets END",
    "capex_intensity": "CASE WHEN assets > 0 THEN capex / assets END",
    "rnd_intensity": "CASE WHEN revenue > 0 THEN rnd / revenue END",
    "cash_ratio": "CASE WHEN assets > 0 THEN cash / assets END",
    "current_ratio": "CASE WHEN current_liabilities > 0 THEN current_assets / current_liabilities END",
    "debt_to_assets": "CASE WHEN assets > 0 THEN debt / assets END",
    "log_market_cap": "CASE WHEN market_cap > 0 THEN ln(market_cap) END",
    "asset_growth": "CASE WHEN assets_before > 0 THEN assets / assets_before - 1 END",
    "sales_growth": "CASE WHEN revenue_before > 0 THEN revenue / revenue_before - 1 END",
    "earnings_growth": "greatest(least(CASE WHEN net_income_before <> 0 THEN (net_income - net_income_before) / abs(net_income_before) END, CASE WHEN net_income_before <> 0 THEN 10 END), CASE WHEN net_income_before <> 0 THEN -10 END)",
    "eps_change_yoy": "greatest(least(CASE WHEN eps_before <> 0 THEN (eps - eps_before) / abs(eps_before) END, CASE WHEN eps_before <> 0 THEN 10 END), CASE WHEN eps_before <> 0 THEN -10 END)",
}
_MORE = {
    "market_cap": "revenue * 40", "repurchases": "cash_flow * 0.1", "gross_profit": "revenue * 0.4", "capex": "cash_flow * 0.2", "rnd": "revenue * 0.05", "cash": "assets * 0.1",
    "current_assets": "assets * 0.3", "current_liabilities": "assets - 0.8 * equity", "debt": "assets - equity", "eps": "net_income / 1000", "eps_before": "net_income_before / 1000",
}


def _fundamental(name: str):
    def run(spark, d):
        values = _values(spark, d).withColumns({k: F.expr(v) for k, v in _MORE.items()})
        return ff.ratio_features(values).select("security_id", day("date").alias("date"), r(F.col(name).cast("double"), 3).alias("value"))

    run.__name__ = f"feature_{name}"
    return run


for _name, _expr in FUNDAMENTAL.items():
    QUERIES[f"feature_{_name}"] = _fundamental(_name)
    SQL[f"feature_{_name}"] = sql(
        f"WITH {_ASOF} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round(CAST(CAST({_expr} AS FLOAT) AS DOUBLE), 3) AS value FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _MORE.items())} FROM v)",
        "facts",
    )


@_add("""WITH sh AS (SELECT security_id, filed_date, max(value) AS shares FROM facts GROUP BY ALL),
  p AS (SELECT security_id, date, close FROM bars WHERE security_id < 25 AND day(date) <= 7), s AS (SELECT p.*, sh.shares, sh.filed_date FROM p ASOF LEFT JOIN sh ON p.security_id = sh.security_id AND p.date >= sh.filed_date),
  k AS (SELECT s.security_id, s.date, s.close, s.shares, count(a.date) AS n FROM s LEFT JOIN (SELECT * FROM actions WHERE action_type = 'split') a ON a.security_id = s.security_id AND a.date > s.filed_date AND a.date <= s.date GROUP BY ALL)
  SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN shares * pow(2, n) * close >= 1e8 THEN shares * pow(2, n) * close END, 1) AS market_cap FROM k""", "facts", "bars", "actions")
def market_cap(spark, d):
    prices = S.bars(spark, d).where("security_id < 25 AND day(date) <= 7").select("security_id", "date", "close")
    splits = S.actions(spark, d).where("action_type = 'split'")
    return ff.market_cap(S.facts(spark, d), splits, prices, 1e8).select("security_id", day("date").alias("date"), r("market_cap", 1).alias("market_cap"))


@_add(None)
def market_cap_whole(spark, d):
    """Of every bar; market_cap and its SQL hold the first week of the months of 25 securities."""
    splits = S.actions(spark, d).where("action_type = 'split'")
    caps = ff.market_cap(S.facts(spark, d), splits, S.bars(spark, d).select("security_id", "date", "close"), 1e8)
    return caps.select("security_id", day("date").alias("date"), r("market_cap", 1).alias("market_cap"))


@_add("""SELECT g.security_id, strftime(g.date, '%Y-%m-%d') AS date, (g.date - f.filed_date)::INT AS days_since_filing FROM (SELECT DISTINCT security_id, last_day(filed_date) AS date FROM facts) g
         ASOF LEFT JOIN (SELECT DISTINCT security_id, filed_date FROM facts) f ON g.security_id = f.security_id AND g.date >= f.filed_date""", "facts")
def feature_days_since_filing(spark, d):
    f = S.facts(spark, d)
    grid = f.select("security_id", F.last_day("filed_date").alias("date")).distinct()
    return ff.days_since_filing(f, grid).withColumn("date", day("date"))


_TENURE = """m AS (SELECT date, row_number() OVER (ORDER BY date) AS m FROM cal WHERE is_month_end),
  t AS (SELECT security_id, date, row_number() OVER (PARTITION BY security_id, i ORDER BY m) AS n FROM (SELECT p.security_id, p.date, m.m, m.m - row_number() OVER (PARTITION BY p.security_id ORDER BY m.m) AS i
        FROM panel p JOIN m USING (date) WHERE p.in_index))"""


@_add(f"WITH {_TENURE} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, n::INT AS months_in_index, n <= 3 AS new_member, round(ln(1 + n), 6) AS log_tenure FROM t", "panel", "cal")
def feature_tenure(spark, d):
    return ff.tenure(S.panel(spark, d)).select("security_id", day("date").alias("date"), "months_in_index", "new_member", r("log_tenure").alias("log_tenure"))


_DIV = """g AS (SELECT security_id, date, close FROM panel WHERE is_month_end),
  x AS (SELECT g.*, coalesce((SELECT sum(value) FROM actions a WHERE a.action_type = 'dividend' AND a.security_id = g.security_id AND a.date > g.date - 372 AND a.date <= g.date), 0) AS now,
               coalesce((SELECT sum(value) FROM actions a WHERE a.action_type = 'dividend' AND a.security_id = g.security_id AND a.date > g.date - 744 AND a.date <= g.date - 372), 0) AS before FROM g)"""


@_add(f"""WITH {_DIV} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round(now / close, 6) AS div_yield, round(CASE WHEN before > 0 THEN now / before - 1 END, 7) AS div_growth_1y,
          CASE WHEN before > 0 THEN CASE WHEN now < 0.95 * before THEN 1.0 ELSE 0.0 END END::DOUBLE AS div_cut, CASE WHEN now > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS pays_dividend FROM x""", "panel", "actions")
def feature_dividends(spark, d):
    grid = S.panel(spark, d).where("is_month_end").select("security_id", "date", "close")
    f = ff.dividend_features(S.actions(spark, d), grid)
    return f.select("security_id", day("date").alias("date"), r("div_yield").alias("div_yield"), r("div_growth_1y", 7).alias("div_growth_1y"), "div_cut", "pays_dividend")


@_add("""WITH ex AS (SELECT DISTINCT security_id, date FROM actions WHERE action_type = 'dividend' AND security_id % 7 = 0 AND day(date) % 9 = 0),
  k AS (SELECT security_id, date AS ex_date, list_sort(list_transform(range(1, len(l)), lambda i: l[i + 1] - l[i])) AS gaps FROM (SELECT security_id, date, list(date) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM ex) WHERE len(l) >= 3),
  q AS (SELECT security_id, ex_date, (gaps[(len(gaps) + 1) // 2] + gaps[len(gaps) // 2 + 1]) / 2 AS gap FROM k),
  s AS (SELECT g.security_id, g.date, q.ex_date, q.gap FROM (SELECT security_id, date FROM panel WHERE is_month_end AND security_id % 7 = 0) g ASOF LEFT JOIN q ON g.security_id = q.security_id AND g.date >= q.ex_date)
  SELECT security_id, strftime(date, '%Y-%m-%d') AS date, CASE WHEN ex_date IS NOT NULL THEN CASE WHEN gap BETWEEN 20 AND 200 AND (ex_date - date) + gap BETWEEN -10 AND 31 THEN 1.0 ELSE 0.0 END END::DOUBLE AS div_due_1m FROM s""", "panel", "actions")
def feature_div_due_1m(spark, d):
    a = S.actions(spark, d).where("security_id % 7 = 0 AND day(date) % 9 = 0")
    grid = S.panel(spark, d).where("is_month_end AND security_id % 7 = 0")
    return ff.dividend_due(a, grid).withColumn("date", day("date"))


@_add(None)
def feature_div_due_1m_whole(spark, d):
    """Of every security and all dividends; feature_div_due_1m and its SQL hold one security of seven and days 9, 18 and 27."""
    return ff.dividend_due(S.actions(spark, d), S.panel(spark, d).where("is_month_end")).withColumn("date", day("date"))


_DAYS = "mcal AS (SELECT CAST(d AS DATE) AS date, row_number() OVER (ORDER BY d) - 1 AS session_index FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events))"


def _macro(spark, d):
    from pitlake.operators.identity import derive_calendar

    cal = derive_calendar(S.table(spark, d, "events").select(F.col("ts").cast("date").alias("date")))
    return ff.macro_features(S.macro(spark, d), cal, 5)


@_add(f"""WITH {_DAYS}, s AS (SELECT g.series_id, g.date, g.session_index, m.value FROM (SELECT * FROM mcal CROSS JOIN (SELECT DISTINCT series_id FROM macro)) g ASOF LEFT JOIN macro m ON g.series_id = m.series_id AND g.date >= m.date)
  SELECT series_id, session_index::INT AS session_index, round(lag(value, 1) OVER w, 6) AS level, round(lag(value, 1) OVER w - lag(value, 6) OVER w, 6) AS change FROM s WINDOW w AS (PARTITION BY series_id ORDER BY session_index)""", "macro")
def feature_macro(spark, d):
    return _macro(spark, d).select("series_id", "session_index", r("level").alias("level"), r("change").alias("change"))


@_add(f"""WITH {_DAYS}, s AS (SELECT g.series_id, g.session_index, m.value FROM (SELECT * FROM mcal CROSS JOIN (SELECT DISTINCT series_id FROM macro)) g ASOF LEFT JOIN macro m ON g.series_id = m.series_id AND g.date >= m.date),
  l AS (SELECT series_id, session_index, lag(value, 1) OVER (PARTITION BY series_id ORDER BY session_index) AS level FROM s)
  SELECT series_id, session_index::INT AS session_index, round(CASE WHEN count(level) OVER w >= 5 THEN level / quantile_cont(level, 0.5) OVER w END, 6) AS relative FROM l WINDOW w AS (PARTITION BY series_id ORDER BY session_index RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)""", "macro")
def feature_vix_relative(spark, d):
    return ff.relative_level(_macro(spark, d), 10, 5).select("series_id", "session_index", r("relative").alias("relative"))


@_add("""SELECT CASE WHEN period_start IS NULL THEN 'instant' WHEN n BETWEEN 330 AND 400 THEN 'annual' WHEN n BETWEEN 80 AND 100 THEN 'quarter' ELSE 'other' END AS kind, count(*) AS n FROM (
  SELECT CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 420 AS INT) END AS period_start, o_orderkey % 420 AS n FROM orders) GROUP BY 1""")
def duration_class(spark, d):
    o = S.table(spark, d, "orders")
    start = F.when(F.col("o_orderkey") % 3 > 0, F.date_sub(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 420).cast("int")))
    return o.select(start.alias("period_start"), F.col("o_orderdate").cast("date").alias("period_end")).groupBy(pit.duration_class().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# -- one query for each remaining feature ---------------------------------------------------------------------------------


def _tenure_column(name: str, expr: str):
    def run(spark, d):
        t = ff.tenure(S.panel(spark, d))
        c = F.col(name) if name == "months_in_index" else F.col(name).cast("double")
        return t.select("security_id", day("date").alias("date"), r(c.cast("double")).alias("value"))

    run.__name__ = f"feature_{name}"
    QUERIES[run.__name__] = run
    SQL[run.__name__] = sql(f"WITH {_TENURE} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round({expr}, 6)::DOUBLE AS value FROM t", "panel", "cal")


def _dividend_column(name: str, expr: str):
    def run(spark, d):
        grid = S.panel(spark, d).where("is_month_end").select("security_id", "date", "close")
        return ff.dividend_features(S.actions(spark, d), grid).select("security_id", day("date").alias("date"), r(name, 7).alias("value"))

    run.__name__ = f"feature_{name}"
    QUERIES[run.__name__] = run
    SQL[run.__name__] = sql(f"WITH {_DIV} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round({expr}, 7)::DOUBLE AS value FROM x", "panel", "actions")


def _macro_column(name: str, series: str, change: bool):
    def run(spark, d):
        m = _macro(spark, d).where(F.col("series_id") == series)
        return m.select("session_index", r("change" if change else "level").alias("value"))

    run.__name__ = f"feature_{name}" + ("_chg_63d" if change else "")
    QUERIES[run.__name__] = run
    value = "lag(value, 1) OVER w - lag(value, 6) OVER w" if change else "lag(value, 1) OVER w"
    SQL[run.__name__] = sql(
        f"WITH {_DAYS}, s AS (SELECT g.session_index, m.value FROM (SELECT *, 0 AS k FROM mcal) g ASOF LEFT JOIN (SELECT *, 0 AS k FROM macro WHERE series_id = '{series}') m ON g.k = m.k AND g.date >= m.date) SELECT session_index::INT AS session_index, round({value}, 6) AS value FROM s WINDOW w AS (ORDER BY session_index)",
        "macro",
    )


for _name, _expr in {"months_in_index": "n", "new_member": "CASE WHEN n <= 3 THEN 1 ELSE 0 END", "log_tenure": "ln(1 + n)"}.items():
    _tenure_column(_name, _expr)
for _name, _expr in {
    "div_yield": "now / close",
    "div_growth_1y": "CASE WHEN before > 0 THEN now / before - 1 END",
    "div_cut": "CASE WHEN before > 0 THEN CASE WHEN now < 0.95 * before THEN 1 ELSE 0 END END",
    "pays_dividend": "CASE WHEN now > 0 THEN 1 ELSE 0 END",
}.items():
    _dividend_column(_name, _expr)
for _i, _name in enumerate(("vix", "term_spread", "term_spread_3m", "ust10y", "fed_funds", "hy_spread", "ig_spread", "dollar_index", "oil")):
    for _change in (False, True):
        _macro_column(_name, ("click", "view", "purchase", "signup", "error")[_i % 5], _change)


@_add("""WITH g AS (SELECT DISTINCT security_id, last_day(filed_date) AS date FROM facts), f AS (SELECT security_id, filed_date, filed_date - max(period_end) AS v FROM facts GROUP BY security_id, filed_date)
  SELECT g.security_id, strftime(g.date, '%Y-%m-%d') AS date, v::INT AS value FROM g ASOF LEFT JOIN f ON g.security_id = f.security_id AND g.date >= f.filed_date""", "facts")
def feature_filing_lag_days(spark, d):
    f = S.facts(spark, d)
    grid = f.select("security_id", F.last_day("filed_date").alias("date")).distinct()
    return pit.asof_join(grid, pit.filing_lag(f), ["security_id"], "date", "filed_date", ["lag_days"]).select("security_id", day("date").alias("date"), F.col("lag_days").alias("value"))


@_add("""WITH rev AS (SELECT security_id, filed_date, count(*) AS facts, count(*) FILTER (abs(value - was) > 0.01 * abs(was)) AS revised FROM (
    SELECT *, lag(value) OVER (PARTITION BY security_id, tag, period_end ORDER BY filed_date, accession) AS was FROM facts) GROUP BY security_id, filed_date),
  rr AS (SELECT security_id, filed_date, CASE WHEN sum(facts) OVER w > 20 THEN sum(revised) OVER w / sum(facts) OVER w END AS v FROM rev WINDOW w AS (PARTITION BY security_id ORDER BY filed_date)),
  g AS (SELECT DISTINCT security_id, last_day(filed_date) AS date FROM facts)
  SELECT g.security_id, strftime(g.date, '%Y-%m-%d') AS date, round(v, 6) AS value FROM g ASOF LEFT JOIN rr ON g.security_id = rr.security_id AND g.date >= rr.filed_date""", "facts")
def feature_restatement_rate(spark, d):
    f = S.facts(spark, d)
    grid = f.select("security_id", F.last_day("filed_date").alias("date")).distinct()
    return pit.asof_join(grid, pit.restatement_rate(f), ["security_id"], "date", "filed_date", ["restatement_rate"]).select("security_id", day("date").alias("date"), r("restatement_rate").alias("value"))


@_add("""WITH f AS (SELECT security_id, tag, period_end, min(filed_date) AS filed_date, arg_min(value, accession) AS value FROM (SELECT *, rank() OVER (PARTITION BY security_id, tag, period_end ORDER BY filed_date) k FROM facts) WHERE k = 1 GROUP BY ALL),
  d AS (SELECT *, value - lag(value, 4) OVER (PARTITION BY security_id, tag ORDER BY period_end) AS d FROM f),
  s AS (SELECT *, CASE WHEN count(d) OVER w >= 4 THEN stddev_samp(d) OVER w END AS sd FROM d WINDOW w AS (PARTITION BY security_id, tag ORDER BY period_end ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
  u AS (SELECT security_id, filed_date, period_end, CASE WHEN sd > 0 THEN greatest(least(d / sd, 10), -10) END AS sue FROM s WHERE tag = '1-URGENT'),
  v AS (SELECT security_id, filed_date, arg_max(sue, period_end) FILTER (true) AS sue, max(period_end) AS p FROM u GROUP BY ALL), w AS (SELECT v.security_id, v.filed_date, u.sue FROM v JOIN u ON u.security_id = v.security_id AND u.filed_date = v.filed_date AND u.period_end = v.p),
  g AS (SELECT DISTINCT security_id, last_day(filed_date) AS date FROM facts)
  SELECT g.security_id, strftime(g.date, '%Y-%m-%d') AS date, round(sue, 5) AS value FROM g ASOF LEFT JOIN w ON g.security_id = w.security_id AND g.date >= w.filed_date""", "facts")
def feature_eps_surprise(spark, d):
    f = S.facts(spark, d).where("tag = '1-URGENT'")
    first = f.groupBy("security_id", "tag", "period_end").agg(F.min("filed_date").alias("filed_date"))
    sue = pit.earnings_surprise(f).join(first, ["security_id", "tag", "period_end"])
    grid = S.facts(spark, d).select("security_id", F.last_day("filed_date").alias("date")).distinct()
    return pit.asof_join(grid, sue, ["security_id"], "date", "filed_date", ["sue"], ["period_end"]).select("security_id", day("date").alias("date"), r("sue", 5).alias("value"))
