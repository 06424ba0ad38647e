"""Queries over scores, portfolios, backtests, statistics and the registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitlake.functions import exprs
from pitlake.operators import backtest, costs, experiments, metrics, portfolio, price_features, signals
from pitlake.plans import standins as S
from pitlake.plans.oracle import sql
from pitlake.plans.q_lake import day, r
from pitlake.plans.q_price import _WINDOWS, PRICE

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(text: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *ctes)
        return f

    return add


# -- scores ---------------------------------------------------------------------------------------------------------

_BASE = """x AS (SELECT security_id, date, session_index, in_index AND close IS NOT NULL AS eligible, round(close, 0) AS a, volume AS b, dollar_volume, close, half_spread FROM dense WHERE is_month_end)"""


def _x(spark, d):
    p = S.dense_panel(spark, d).where("is_month_end")
    return p.select("security_id", "date", "session_index", (F.col("in_index") & F.col("close").isNotNull()).alias("eligible"), F.round("close", 0).alias("a"), F.col("volume").alias("b"), "dollar_volume", "close", "half_spread")


_RANK = "CASE WHEN eligible AND {c} IS NOT NULL AND count(CASE WHEN eligible THEN {c} END) OVER (PARTITION BY date) >= 3 THEN (rank() OVER (PARTITION BY date, eligible ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY date, eligible, {c}) - 1) / 2) / (count(CASE WHEN eligible THEN {c} END) OVER (PARTITION BY date) - 1) END"
_RK_SHORT = _RANK
_NRANK = "CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY date) >= 3 THEN (rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) - 1 + (count({c}) OVER (PARTITION BY date, {c}) - 1) / 2) / (count({c}) OVER (PARTITION BY date) - 1) END"
_RANKS = f"{_BASE}, rk AS (SELECT *, {_RANK.format(c='a')} AS ra, {_RANK.format(c='b')} AS rb FROM x)"


@_add(f"WITH {_RANKS} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round(ra, 6) AS ra, round(rb, 6) AS rb FROM rk", "dense")
def rank_pct(spark, d):
    return _x(spark, d).select("security_id", day("date").alias("date"), r(signals.rank("a")).alias("ra"), r(signals.rank("b")).alias("rb"))


@_add(f"WITH {_BASE} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN stddev_samp(b) OVER w > 0 THEN greatest(least((b - avg(b) OVER w) / stddev_samp(b) OVER w, 4), -4) END, 5) AS z, round(coalesce(CASE WHEN stddev_samp(b) OVER w > 0 THEN greatest(least((b - avg(b) OVER w) / stddev_samp(b) OVER w, 3), -3) END, 0), 5) AS z0 FROM x WINDOW w AS (PARTITION BY date)", "dense")
def zscore(spark, d):
    return _x(spark, d).select("security_id", day("date").alias("date"), r(exprs.zscore(F.col("b"), ["date"]), 5).alias("z"), r(exprs.zscore(F.col("b"), ["date"], 3.0, 0.0), 5).alias("z0"))


@_add(f"WITH {_BASE} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN count(close) OVER w >= 5 THEN greatest(least(close, quantile_cont(close, 0.9) OVER w), quantile_cont(close, 0.1) OVER w) ELSE close END, 7) AS v FROM x WINDOW w AS (PARTITION BY date)", "dense")
def winsorise(spark, d):
    return _x(spark, d).select("security_id", day("date").alias("date"), r(exprs.winsorise(F.col("close"), ["date"], 0.1, 0.9, 5), 7).alias("v"))


@_add(f"""WITH {_RANKS} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN CASE WHEN ra IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN rb > 0.2 THEN 1 ELSE 0 END >= 1
          THEN (coalesce(ra * 0.7, 0) + coalesce(CASE WHEN rb > 0.2 THEN rb * -0.3 END, 0)) / (CASE WHEN ra IS NOT NULL THEN 0.7 ELSE 0 END + CASE WHEN rb > 0.2 THEN 0.3 ELSE 0 END) END, 6) AS score FROM rk""", "dense")
def blend(spark, d):
    x = _x(spark, d).withColumns({"ra": signals.rank("a"), "rb": signals.rank("b")})
    return x.select("security_id", day("date").alias("date"), r(exprs.blend([(F.col("ra"), 0.7), (F.when(F.col("rb") > 0.2, F.col("rb")), -0.3)])).alias("score"))


@_add(f"WITH {_RANKS} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN rb >= 0.5 THEN ra END, 6) AS hi, round(CASE WHEN rb <= 0.33 THEN ra END, 6) AS lo FROM rk", "dense")
def conditional_sort(spark, d):
    x = _x(spark, d).withColumns({"ra": signals.rank("a"), "rb": signals.rank("b")})
    return x.select("security_id", day("date").alias("date"), r(exprs.conditional(F.col("ra"), F.col("rb"), 0.5)).alias("hi"), r(exprs.conditional(F.col("ra"), F.col("rb"), 0.33, False)).alias("lo"))


@_add(f"WITH {_BASE} SELECT strftime(date, '%Y-%m-%d') AS date, count(*) FILTER (eligible AND dollar_volume IS NOT NULL) AS n FROM x GROUP BY date", "dense")
def require_features(spark, d):
    return signals.require(_x(spark, d), "dollar_volume").groupBy(day("date").alias("date")).agg(F.count_if("eligible").alias("n"))


# -- portfolios -----------------------------------------------------------------------------------------------------

_TOP = f"""{_BASE}, s AS (SELECT *, a AS score FROM x WHERE eligible AND a IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, md5(CAST(security_id AS VARCHAR))) AS place FROM s), k AS (SELECT * FROM t WHERE place <= 4)"""


def _scores(spark, d):
    return _x(spark, d).withColumns({"score": F.col("a"), "vol": F.when(F.col("b") > 40, F.col("b"))})


@_add(f"WITH {_TOP} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, place::INT AS place FROM k", "dense")
def top_k(spark, d):
    return portfolio.top_k(_scores(spark, d).where("eligible"), 4).select("security_id", day("date").alias("date"), "place")


_SCHEMES = {
    "equal": "1.0",
    "score": "score - min(score) OVER w + 1e-12",
    "score_rank": "count(*) OVER w - place + 1.0",
    "inverse_vol": "1 / coalesce(CASE WHEN b > 40 THEN b END, quantile_cont(CASE WHEN b > 40 THEN b END, 0.5) OVER w, 1.0)",
}


def _weights(scheme: str):
    def run(spark, d):
        w = portfolio.build_weights(_scores(spark, d), portfolio.Construction(top=4, scheme=scheme, gross=0.9, min_names=5))
        return w.select("security_id", day("date").alias("date"), r("weight").alias("weight"))

    run.__name__ = f"weights_{scheme}"
    return run


for _s, _e in _SCHEMES.items():
    QUERIES[f"weights_{_s}"] = _weights(_s)
    SQL[f"weights_{_s}"] = sql(
        f"WITH {_TOP}, n AS (SELECT date FROM s GROUP BY date HAVING count(*) >= 5), raw AS (SELECT k.*, {_e} AS raw FROM k JOIN n USING (date) WINDOW w AS (PARTITION BY date)) SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round(0.9 * raw / sum(raw) OVER (PARTITION BY date), 6) AS weight FROM raw",
        "dense",
    )


@_add(f"""WITH RECURSIVE {_TOP.replace('place <= 4', 'place <= 8')}, raw AS (SELECT date, security_id, score / sum(score) OVER (PARTITION BY date) AS w, count(*) OVER (PARTITION BY date) AS n FROM k),
  it AS (SELECT 0 AS i, date, security_id, w, n FROM raw UNION ALL
         SELECT i + 1, date, security_id, CASE WHEN w >= 0.15 THEN 0.15 ELSE w + coalesce(w * (sum(greatest(w - 0.15, 0)) OVER (PARTITION BY date)) / nullif(sum(CASE WHEN w < 0.15 THEN w END) OVER (PARTITION BY date), 0), 0) END, n FROM it WHERE i < 60)
  SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN n * 0.15 <= 1 THEN 1.0 / n ELSE w END, 5) AS weight FROM it WHERE i = 60""", "dense")
def weights_capped(spark, d):
    k = portfolio.top_k(_scores(spark, d).where("eligible"), 8)
    raw = k.withColumn("weight", F.col("score") / F.sum("score").over(Window.partitionBy("date")))
    return portfolio.cap_weights(raw, 0.15).select("security_id", day("date").alias("date"), r("weight", 5).alias("weight"))


def _w(spark, d):
    return portfolio.build_weights(_scores(spark, d), portfolio.Construction(top=4, scheme="score_rank"))


_W = f"{_TOP}, wt AS (SELECT date, security_id, (count(*) OVER w - place + 1.0) / sum(0.0 + place) OVER w AS weight FROM k WINDOW w AS (PARTITION BY date))"


@_add(f"""WITH {_W}, ds AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM wt)),
  pairs AS (SELECT coalesce(a.date, b.date) AS date, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS d FROM wt a FULL JOIN (SELECT ds.date, wt.security_id, wt.weight FROM ds JOIN wt ON wt.date = ds.prev) b ON a.date = b.date AND a.security_id = b.security_id)
  SELECT strftime(date, '%Y-%m-%d') AS date, round(sum(abs(d)) / 2, 6) AS turnover FROM pairs GROUP BY date""", "dense")
def turnover(spark, d):
    return portfolio.turnover(_w(spark, d)).select(day("date").alias("date"), r("turnover").alias("turnover"))


_ORDERS = "o AS (SELECT l_suppkey % 10 AS grp, l_extendedprice * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS notional, l_extendedprice / l_quantity / 20 AS price, CASE WHEN l_linenumber < 6 THEN l_discount / 100 END AS half_spread FROM lineitem)"


def _orders(spark, d):
    return S.table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("grp"),
        (F.col("l_extendedprice") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("notional"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 20).alias("price"),
        F.when(F.col("l_linenumber") < 6, F.col("l_discount") / 100).alias("half_spread"),
    )


@_add(f"""WITH {_ORDERS}, c AS (SELECT *, least(greatest(0.005 * abs(notional) / price, 1.0), 0.01 * abs(notional)) AS commission, abs(notional) * coalesce(half_spread, 0.0005) * 2 AS spread_cost FROM o)
  SELECT grp, round(sum(commission), 2) AS commission, round(sum(spread_cost), 2) AS spread, count(*) FILTER (0.005 * (abs(notional) / price) < 1 AND 1 <= 0.01 * abs(notional)) AS at_minimum, count(*) FILTER (half_spread IS NULL) AS unknown_spread FROM c GROUP BY grp""")
def trading_costs(spark, d):
    c = costs.charge_total(_orders(spark, d), ["grp"], costs.SETTINGS["pessimistic"])
    return c.select("grp", r("commission", 2).alias("commission"), r("spread", 2).alias("spread"), "at_minimum", "unknown_spread")


# -- backtests ------------------------------------------------------------------------------------------------------


def _run_weights(spark, d):
    return _w(spark, d).select(F.lit("top4").alias("run"), "date", "security_id", "weight")


def _schedule(spark, d):
    return backtest.rebalance_schedule(S.calendar(spark, d), "1996-01-01")


_SCHED = """sch AS (SELECT row_number() OVER (ORDER BY session_index) - 1 AS period, date, session_index, session_index + 1 AS exec, coalesce(lead(session_index) OVER (ORDER BY session_index) + 1, (SELECT max(session_index) + 1 FROM cal)) AS until
  FROM cal WHERE is_month_end AND date >= DATE '1996-01-01' AND session_index < (SELECT max(session_index) FROM cal))"""


@_add(f"WITH {_SCHED} SELECT period::INT AS period, strftime(date, '%Y-%m-%d') AS date, exec::INT AS exec, until::INT AS until FROM sch", "cal")
def rebalance_schedule(spark, d):
    return _schedule(spark, d).select("period", day("date").alias("date"), "exec", "until")


#: Prices of each name and period; a series that breaks off or pauses before the next fill ends at its last close.
_PERIODS = f"""{_SCHED}, nx AS (SELECT *, lead(session_index) OVER (PARTITION BY security_id ORDER BY session_index) AS nxt, (SELECT max(until) - 1 FROM sch) AS fin FROM dense),
  pp AS (SELECT q.security_id, sch.period, max(CASE WHEN session_index = exec THEN open END) AS fill, max(CASE WHEN session_index = exec THEN raw_open * cum_split END) AS traded, arg_max(close, session_index) AS last_close,
           min(CASE WHEN session_index < least(until, fin) AND coalesce(nxt, -1) <> session_index + 1 THEN session_index END) AS brk
         FROM (SELECT security_id, session_index, open, close, raw_open, cum_split, nxt, fin FROM nx) q JOIN (SELECT period, exec, until FROM sch) sch ON session_index >= exec AND session_index < until GROUP BY ALL),
  pr AS (SELECT pp.*, CASE WHEN lead(pp.period) OVER w = pp.period + 1 THEN lead(fill) OVER w END AS next_fill, b.close AS break_close, b.raw_open * b.cum_split AS break_traded, b.nxt IS NOT NULL AS resumes
         FROM pp LEFT JOIN nx b ON b.security_id = pp.security_id AND b.session_index = brk WINDOW w AS (PARTITION BY pp.security_id ORDER BY pp.period)),
  wp AS (SELECT wt.security_id, wt.weight, sch.period, sch.exec FROM wt JOIN sch USING (date) WHERE wt.weight <> 0),
  gr AS (SELECT wp.period, 1 + sum(CASE WHEN fill IS NOT NULL THEN weight * (CASE WHEN brk IS NOT NULL THEN break_close ELSE coalesce(next_fill, last_close) END / fill - 1) ELSE 0 END) AS growth
         FROM wp LEFT JOIN pr USING (security_id, period) GROUP BY wp.period)"""


@_add(f"WITH {_W}, {_PERIODS} SELECT period::INT AS period, round(growth, 6) AS growth FROM gr", "dense", "cal")
def backtest_free_growth(spark, d):
    return backtest.free_growth(_run_weights(spark, d), S.dense_panel(spark, d), _schedule(spark, d)).select("period", r("growth").alias("growth"))


def _events(spark, d, setting="realistic"):
    return backtest.run_backtest(_run_weights(spark, d), S.dense_panel(spark, d), _schedule(spark, d), costs.SETTINGS[setting])


@_add()
def backtest_run(spark, d):
    """Positions of a run under realistic costs; tests hold it against a plain loop over sessions."""
    h = backtest.positions(_events(spark, d)).join(backtest.rebalances(_events(spark, d)).select("run", "period", "nav", "cash"), ["run", "period"])
    return h.select("run", "period", "security_id", r("shares", 4).alias("shares"), "until", r("nav", 2).alias("nav"), r("cash", 2).alias("cash"))


_ORDERS_FREE = f"""WITH {_W}, {_PERIODS}, nv AS (SELECT period, 100000 * coalesce(exp(sum(ln(growth)) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS nav FROM gr),
  hv AS (SELECT wp.security_id, wp.period, weight, nav, fill, traded, brk, break_close, break_traded, resumes, next_fill, CASE WHEN fill IS NOT NULL THEN weight * nav ELSE 0 END AS after FROM wp JOIN nv USING (period) LEFT JOIN pr USING (security_id, period)),
  bf AS (SELECT security_id, period + 1 AS period, after / fill * next_fill AS before FROM hv WHERE fill IS NOT NULL AND brk IS NULL AND period + 1 IN (SELECT period FROM nv)),
  od AS (SELECT security_id, period, coalesce(after, 0) - coalesce(before, 0) AS delta, p.traded FROM hv FULL JOIN bf USING (security_id, period) LEFT JOIN (SELECT security_id, period, traded FROM pr) p USING (security_id, period)),
  al AS (SELECT period, security_id, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, 'filled' AS status, 'rebalance' AS reason, abs(delta) / traded AS shares, abs(delta) AS notional, -delta AS cash_flow FROM od WHERE abs(delta) > 1e-6
         UNION ALL SELECT period, security_id, 'buy', 'unfilled', 'no_opening_bar', NULL, weight * nav, 0 FROM hv WHERE fill IS NULL
         UNION ALL SELECT period, security_id, 'sell', 'filled', CASE WHEN resumes THEN 'exit:price_gap' ELSE 'exit:unresolved' END, after / fill * break_close / break_traded, after / fill * break_close, after / fill * break_close FROM hv WHERE fill IS NOT NULL AND brk IS NOT NULL)"""


@_add(_ORDERS_FREE + """
  SELECT period::INT AS period, security_id, side, status, reason, round(shares, 2) AS shares, round(notional, 2) AS notional, round(cash_flow, 2) AS cash_flow FROM al""", "dense", "cal")
def backtest_orders(spark, d):
    """The whole ledger of a run without costs: orders, unfilled ones and forced exits, shares in the money of the day."""
    orders = backtest.ledger(_events(spark, d, "free")).where("notional > 1e-6")
    return orders.select("period", "security_id", "side", "status", "reason", r("shares", 2).alias("shares"), r("notional", 2).alias("notional"), r("cash_flow", 2).alias("cash_flow"))


@_add(_ORDERS_FREE + " SELECT 'top4' AS run, true AS ok, round(sum(notional), 0) AS traded, round(sum(cash_flow), 0) AS flow FROM al WHERE status = 'filled'", "dense", "cal")
def backtest_reconcile(spark, d):
    """Whether orders, charges and the cash account replayed from them agree in every period of the run, with what was traded
    and what flowed in all."""
    e = _events(spark, d, "free")
    n = backtest.ledger(e).where("status = 'filled'").groupBy("run").agg(r(F.sum("notional"), 0).alias("traded"), r(F.sum("cash_flow"), 0).alias("flow"))
    return backtest.reconcile(e).join(n, "run").select("run", "ok", "traded", "flow")


@_add()
def backtest_ledger(spark, d):
    sched = _schedule(spark, d)
    dated = backtest.ledger(_events(spark, d)).join(F.broadcast(sched.select("period", F.year("date").alias("y"))), "period")
    return backtest.ledger_summary(dated, F.col("y")).withColumns({c: r(c, 2) for c in ("notional", "cost", "cost_bp")})


@_add()
def backtest_daily_value(spark, d):
    return backtest.daily_value(_events(spark, d, "optimistic"), S.dense_panel(spark, d)).select("run", "session_index", r("nav", 2).alias("nav"))


@_add(f"""WITH {_SCHED} SELECT period::INT AS period, round(avg(n.open / f.open), 6) AS growth, count(*) AS names FROM dense s JOIN sch USING (session_index) JOIN dense f ON f.security_id = s.security_id AND f.session_index = sch.exec
  JOIN dense n ON n.security_id = s.security_id AND n.session_index = sch.until WHERE s.in_index AND s.is_month_end GROUP BY period""", "dense", "cal")
def equal_weight_reference(spark, d):
    return backtest.equal_weight_reference(S.dense_panel(spark, d), _schedule(spark, d)).select("period", r("growth").alias("growth"), "names")


# -- statistics -----------------------------------------------------------------------------------------------------

_RET = """r AS (SELECT *, nav / lag(nav) OVER w - 1 AS ret, nav / max(nav) OVER (PARTITION BY run_id ORDER BY date) - 1 AS dd, date - lag(date) OVER w AS gap FROM curves WINDOW w AS (PARTITION BY run_id ORDER BY date))"""
_PPY = "CASE WHEN g <= 4 THEN 252 WHEN g <= 10 THEN 52 WHEN g <= 45 THEN 12 WHEN g <= 120 THEN 4 ELSE 1 END"


@_add(f"""WITH {_RET}, q AS (SELECT run_id, quantile_cont(ret, 0.05) AS q5, quantile_cont(gap, 0.5) AS g FROM r GROUP BY run_id),
  s AS (SELECT run_id, any_value(q5) AS var5, {_PPY.replace('g <=', 'any_value(g) <=')} AS ppy, count(ret) AS n, arg_max(nav, date) / arg_min(nav, date) AS gr, max(date) - min(date) AS days, avg(ret) AS m, stddev_samp(ret) AS sd,
          stddev_samp(CASE WHEN ret < 0 THEN ret END) AS dn, min(dd) AS mdd, arg_min(date, dd) AS trough, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0 END) AS hit, skewness(ret) AS skew, kurtosis(ret) AS kurt, max(ret) AS best, min(ret) AS worst,
          avg(CASE WHEN dd < 0 THEN 1.0 ELSE 0 END) AS uw, avg(CASE WHEN ret <= q5 THEN ret END) AS cvar5 FROM r JOIN q USING (run_id) GROUP BY run_id)
  SELECT run_id, n, round(gr - 1, 5) AS total, round(pow(gr, 365.25 / days) - 1, 5) AS cagr, round(sd * sqrt(ppy), 5) AS vol, round(m / sd * sqrt(ppy), 5) AS sharpe, round(m / dn * sqrt(ppy), 5) AS sortino, round(mdd, 5) AS max_drawdown,
         strftime(trough, '%Y-%m-%d') AS trough_date, round(hit, 5) AS hit, round(skew, 4) AS skew, round(kurt, 3) AS kurt, round(best, 5) AS best, round(worst, 5) AS worst, round(uw, 5) AS under_water, round(var5, 5) AS var5, round(cvar5, 5) AS cvar5 FROM s""", "curves")
def performance(spark, d):
    p = metrics.performance(S.curves(spark, d))
    five = ("total", "cagr", "vol", "sharpe", "sortino", "max_drawdown", "hit", "best", "worst", "under_water", "var5", "cvar5")
    return p.select("run_id", "n", *[r(c, 5).alias(c) for c in five], day("trough_date").alias("trough_date"), r("skew", 4).alias("skew"), r("kurt", 3).alias("kurt"))


@_add(f"""WITH {_RET}, b AS (SELECT date, close AS bench, close / lag(close) OVER (ORDER BY date) - 1 AS bret FROM bench), j AS (SELECT r.*, b.bret FROM r LEFT JOIN b USING (date)), q AS (SELECT run_id, quantile_cont(gap, 0.5) AS g FROM r GROUP BY run_id)
  SELECT run_id, round(covar_samp(ret, bret) / var_samp(bret), 5) AS beta, round(stddev_samp(ret - bret) * sqrt({_PPY.replace('g <=', 'any_value(g) <=')}), 4) AS tracking_error, round(avg(ret - bret) * sqrt({_PPY.replace('g <=', 'any_value(g) <=')}) / stddev_samp(ret - bret), 4) AS information_ratio FROM j JOIN q USING (run_id) GROUP BY run_id""", "curves", "bench")
def performance_benchmark(spark, d):
    p = metrics.performance(S.curves(spark, d), benchmark=S.benchmark(spark, d).withColumnRenamed("close", "bench"))
    return p.select("run_id", r("beta", 5).alias("beta"), r("tracking_error", 4).alias("tracking_error"), r("information_ratio", 4).alias("information_ratio"))


@_add(f"WITH {_RET} SELECT run_id, strftime(date, '%Y-%m-%d') AS date, round(dd, 6) AS drawdown FROM r", "curves")
def drawdown_series(spark, d):
    return metrics.returns(S.curves(spark, d)).select("run_id", day("date").alias("date"), r("drawdown").alias("drawdown"))


_MON = "mo AS (SELECT run_id, last_day(date) AS month, arg_max(nav, date) AS nav FROM curves GROUP BY ALL), mr AS (SELECT *, nav / lag(nav) OVER (PARTITION BY run_id ORDER BY month) - 1 AS ret FROM mo)"


@_add(f"WITH {_MON} SELECT run_id, strftime(month, '%Y-%m-%d') AS month, round(nav, 6) AS nav FROM mo", "curves")
def to_monthly(spark, d):
    return metrics.to_monthly(S.curves(spark, d)).select("run_id", day("month").alias("month"), r("nav").alias("nav"))


_MS = f"{_MON}, ms AS (SELECT run_id, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sharpe, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurt FROM mr GROUP BY run_id)"


@_add(f"WITH {_MS} SELECT run_id, n, round(sharpe, 6) AS sharpe, round(skew, 5) AS skew, round(kurt, 5) AS kurt FROM ms", "curves")
def monthly_stats(spark, d):
    return metrics.monthly_stats(S.curves(spark, d)).select("run_id", "n", r("sharpe").alias("sharpe"), r("skew", 5).alias("skew"), r("kurt", 5).alias("kurt"))


@_add(f"""WITH {_MON} SELECT run_id, year(month)::INT AS year, {', '.join(f"round(max(ret) FILTER (month(month) = {i}), 6) AS m{i:02d}" for i in range(1, 13))}, round(product(1 + ret) - 1, 6) AS ytd FROM mr WHERE ret IS NOT NULL GROUP BY ALL""", "curves")
def monthly_table(spark, d):
    t = metrics.monthly_table(S.curves(spark, d))
    return t.select("run_id", "year", *[r(c).alias(c) for c in t.columns[2:]])


@_add("""WITH y AS (SELECT run_id, year(date) AS year, arg_max(nav, date) AS nav, arg_min(nav, date) AS start FROM curves GROUP BY ALL)
  SELECT run_id, year::INT AS year, round(nav / lag(nav) OVER w - 1, 6) AS ret, round(nav / coalesce(lag(nav) OVER w, start) - 1, 6) AS ret_partial FROM y WINDOW w AS (PARTITION BY run_id ORDER BY year)""", "curves")
def annual_returns(spark, d):
    c = S.curves(spark, d)
    a, b = metrics.annual_returns(c), metrics.annual_returns(c, True)
    return b.select("run_id", "year", r("ret").alias("ret_partial")).join(a.select("run_id", "year", r("ret").alias("ret")), ["run_id", "year"], "left")


@_add("""WITH k AS (SELECT date FROM curves WHERE NOT (run_id = 2 AND day(date) = 3) GROUP BY date HAVING count(*) = (SELECT count(DISTINCT run_id) FROM curves)), c AS (SELECT * FROM curves WHERE date IN (SELECT date FROM k))
  SELECT run_id, strftime(date, '%Y-%m-%d') AS date, round(nav / first_value(nav) OVER (PARTITION BY run_id ORDER BY date), 6) AS nav FROM c""", "curves")
def align_curves(spark, d):
    c = S.curves(spark, d).where("NOT (run_id = 2 AND day(date) = 3)")
    return metrics.align(c).select("run_id", day("date").alias("date"), r("nav").alias("nav"))


@_add("SELECT run_id, strftime(date, '%Y-%m-%d') AS date, round((nav / close) / first_value(nav / close) OVER (PARTITION BY run_id ORDER BY date), 6) AS relative FROM curves JOIN bench USING (date)", "curves", "bench")
def relative_strength(spark, d):
    return metrics.relative(S.curves(spark, d), S.benchmark(spark, d).withColumnRenamed("close", "bench")).select("run_id", day("date").alias("date"), r("relative").alias("relative"))


@_add(f"""WITH {_MON}, z AS (SELECT run_id, month, avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(12) AS v, count(ret) OVER w AS n FROM mr WINDOW w AS (PARTITION BY run_id ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW))
  SELECT run_id, strftime(month, '%Y-%m-%d') AS month, round(v, 5) AS value FROM z WHERE n >= 36""", "curves")
def rolling_sharpe(spark, d):
    return metrics.rolling(S.curves(spark, d), 36, "sharpe").select("run_id", day("month").alias("month"), r("value", 5).alias("value"))


@_add(f"""WITH {_MON}, z AS (SELECT run_id, month, stddev_samp(ret) OVER w * sqrt(12) AS v, count(ret) OVER w AS n FROM mr WINDOW w AS (PARTITION BY run_id ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
  SELECT run_id, strftime(month, '%Y-%m-%d') AS month, round(v, 6) AS value FROM z WHERE n >= 12""", "curves")
def rolling_volatility(spark, d):
    return metrics.rolling(S.curves(spark, d), 12, "vol").select("run_id", day("month").alias("month"), r("value").alias("value"))


_SE = "sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 0) / (n - 1))"


@_add(f"WITH {_MS} SELECT run_id, round({_SE}, 6) AS se, round(sharpe - 1.959963984540054 * {_SE}, 6) AS lo, round(sharpe + 1.959963984540054 * {_SE}, 6) AS hi, round({metrics.probabilistic_sharpe_sql('sharpe', 'n', 'skew', 'kurt')}, 6) AS psr FROM ms", "curves")
def sharpe_inference(spark, d):
    s = metrics.sharpe_inference(metrics.monthly_stats(S.curves(spark, d)))
    return s.select("run_id", *[r(c).alias(c) for c in ("se", "lo", "hi", "psr")])


@_add(f"""WITH {_MS}, t AS (SELECT *, 40 AS trials, (SELECT stddev_samp(sharpe) FROM ms) AS trial_sd FROM ms), b AS (SELECT *, {metrics.expected_max_sharpe_sql('trials', 'trial_sd')} AS bar FROM t)
  SELECT run_id, round(bar, 6) AS bar, round({metrics.probabilistic_sharpe_sql('sharpe', 'n', 'skew', 'kurt', 'bar')}, 6) AS dsr FROM b""", "curves")
def deflated_sharpe(spark, d):
    s = metrics.monthly_stats(S.curves(spark, d))
    s = s.crossJoin(F.broadcast(s.agg(F.stddev_samp("sharpe").alias("trial_sd")))).withColumn("trials", F.lit(40))
    return metrics.deflated_sharpe(s).select("run_id", r("bar").alias("bar"), r("dsr").alias("dsr"))


# -- registry -------------------------------------------------------------------------------------------------------


@_add("""SELECT study, count(*) AS runs, count(DISTINCT fingerprint) AS trials, arg_max(run_id, (sharpe, -run_id)) AS best_run, max(sharpe) AS best_sharpe, strftime(min(logged_at), '%Y-%m-%d %H:%M:%S') AS first_at FROM runs GROUP BY study""", "runs")
def studies(spark, d):
    return experiments.studies(S.runs(spark, d)).select("study", "runs", "trials", "best_run", "best_sharpe", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"))


@_add("SELECT study, run_id, sharpe FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY sharpe DESC NULLS LAST, run_id) k FROM runs) WHERE k = 1", "runs")
def best_run(spark, d):
    return experiments.best(S.runs(spark, d)).select("study", "run_id", "sharpe")


@_add("SELECT study, count(*) AS trials, round(stddev_samp(sharpe), 6) AS trial_sd FROM (SELECT *, row_number() OVER (PARTITION BY study, fingerprint ORDER BY logged_at, run_id) k FROM runs) WHERE k = 1 GROUP BY study", "runs")
def trial_deviation(spark, d):
    return experiments.trial_sd(S.runs(spark, d)).select("study", "trials", r("trial_sd").alias("trial_sd"))


@_add("SELECT study, fingerprint, run_id FROM (SELECT *, row_number() OVER (PARTITION BY study, fingerprint ORDER BY logged_at DESC, run_id DESC) k FROM runs) WHERE k = 1", "runs")
def latest_records(spark, d):
    return experiments.latest_lines(S.runs(spark, d), ["study", "fingerprint"], ["logged_at", "run_id"]).select("study", "fingerprint", "run_id")


@_add("SELECT study, fingerprint, run_id FROM (SELECT *, row_number() OVER (PARTITION BY study, fingerprint ORDER BY logged_at, run_id) k FROM runs) WHERE k = 1", "runs")
def earliest_seals(spark, d):
    return experiments.earliest_lines(S.runs(spark, d), ["study", "fingerprint"], ["logged_at", "run_id"]).select("study", "fingerprint", "run_id")


@_add("SELECT run_id, row_number() OVER (PARTITION BY study, fingerprint ORDER BY logged_at, run_id)::INT AS look FROM runs", "runs")
def look_numbers(spark, d):
    return experiments.look_number(S.runs(spark, d), ["study", "fingerprint"], ["logged_at", "run_id"]).select("run_id", "look")


@_add("""WITH w AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 AS INT) AS "end" FROM orders)
  SELECT k, strftime(start, '%Y-%m-%d') AS start, strftime(least("end", DATE '1998-12-31'), '%Y-%m-%d') AS "end", greatest((year(least("end", DATE '1998-12-31')) - year(start)) * 12 + month(least("end", DATE '1998-12-31')) - month(start)
         + CASE WHEN least("end", DATE '1998-12-31') = last_day(least("end", DATE '1998-12-31')) THEN 1 ELSE 0 END, 0)::INT AS months FROM w""")
def holdout_windows(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("start"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 300).cast("int")).alias("end"))
    w = experiments.apply_holdout(o, "exclude", "1999-01-01").withColumn("months", experiments.month_ends_between(F.col("start"), F.col("end")))
    return w.select("k", day("start").alias("start"), day("end").alias("end"), "months")


@_add(f"""WITH {_MS}, p AS (SELECT a.run_id, a.sharpe AS sharpe_r, {_SE.replace('skew', 'a.skew').replace('sharpe', 'a.sharpe').replace('kurt', 'a.kurt').replace('(n ', '(a.n ')} AS se_r, b.sharpe AS sharpe_f, {_SE.replace('skew', 'b.skew').replace('sharpe', 'b.sharpe').replace('kurt', 'b.kurt').replace('(n ', '(b.n ')} AS se_f, b.n AS n_f
  FROM ms a JOIN ms b ON b.run_id = (a.run_id + 1) % 5), z AS (SELECT *, (sharpe_f - sharpe_r) / sqrt(se_r * se_r + se_f * se_f) AS z FROM p), q AS (SELECT *, {exprs.norm_cdf_sql('z')} AS p FROM z)
  SELECT run_id, round(z, 5) AS z, round(p, 5) AS p, CASE WHEN n_f < 12 THEN 'inconclusive' WHEN sharpe_f <= 0 THEN 'failed' WHEN p < 0.05 THEN 'decayed' ELSE 'held' END AS verdict FROM q""", "curves")
def forward_comparison(spark, d):
    s = metrics.sharpe_inference(metrics.monthly_stats(S.curves(spark, d)))
    a = s.select("run_id", F.col("sharpe").alias("sharpe_r"), F.col("se").alias("se_r"))
    b = s.select(F.pmod(F.col("run_id") + 4, F.lit(5)).alias("run_id"), F.col("sharpe").alias("sharpe_f"), F.col("se").alias("se_f"), F.col("n").alias("n_f"))
    return experiments.compare(a.join(b, "run_id")).select("run_id", r("z", 5).alias("z"), r("p", 5).alias("p"), "verdict")


@_add("""WITH s AS (SELECT study AS run_id, avg(sharpe) AS a, count(*) AS b FROM runs GROUP BY study), k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb,
  row_number() OVER (ORDER BY a DESC, run_id) AS ta, row_number() OVER (ORDER BY b DESC, run_id) AS tb FROM s) SELECT round(corr(ra, rb), 6) AS spearman, count(*) FILTER (ta <= 5 AND tb <= 5) AS overlap FROM k""", "runs")
def rank_agreement(spark, d):
    s = S.runs(spark, d).groupBy(F.col("study").alias("run_id")).agg(F.avg("sharpe").alias("a"), F.count(F.lit(1)).alias("b"))
    return experiments.rank_agreement(s, "a", "b").select(r("spearman").alias("spearman"), "overlap")


@_add("SELECT study, fingerprint, substring(sha256('{\"fingerprint\":\"' || fingerprint || '\",\"study\":' || study || '}'), 1, 16) AS id, count(*) AS n FROM runs GROUP BY ALL", "runs")
def config_fingerprint(spark, d):
    return S.runs(spark, d).groupBy("study", "fingerprint", experiments.fingerprint("study", "fingerprint").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@_add("SELECT (g - 1)::INT AS gene, count(*) AS n, round(avg(e), 5) AS mean_weight FROM (SELECT unnest(embedding) AS e, generate_subscripts(embedding, 1) AS g FROM embeddings) WHERE abs(e) >= CAST(0.05 AS DOUBLE) GROUP BY g")
def gene_usage(spark, d):
    g = S.table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("genes"))
    return experiments.usage(g).select("gene", "n", r("mean_weight", 5).alias("mean_weight"))


@_add("SELECT round(max(abs(p - CASE WHEN z > 0 THEN 1 ELSE 0 END)), 3) <= 0.5 AS ok, count(*) AS n FROM (SELECT c_acctbal / 2000 AS z, " + exprs.norm_cdf_sql("c_acctbal / 2000") + " AS p FROM customer)")
def normal_distribution(spark, d):
    c = S.table(spark, d, "customer").select((F.col("c_acctbal") / 2000).alias("z")).withColumn("p", exprs.norm_cdf("z"))
    return c.agg((F.round(F.max(F.abs(F.col("p") - F.when(F.col("z") > 0, 1).otherwise(0))), 3) <= 0.5).alias("ok"), F.count(F.lit(1)).alias("n"))


# -- strategies -----------------------------------------------------------------------------------------------------


def _features(spark, d):
    f = price_features.price_features(S.dense_panel(spark, d), 3).where("is_month_end")
    state = price_features.market_state(S.dense_panel(spark, d), 3)
    return f.withColumn("eligible", F.col("in_index")).join(F.broadcast(state), "session_index", "left")


def _strategy(name: str):
    def run(spark, d):
        x = _features(spark, d)
        own = {"defensive_regime": signals.defensive_regime, "vol_managed": signals.vol_managed, "ensemble_rank": lambda z: signals.ensemble_rank(z, ["momentum_12_1", "low_vol", "week52_breakout", "lottery_averse"])}
        s = (own | signals.REGISTRY)[name](x)
        w = portfolio.build_weights(s, portfolio.Construction(top=4, cap=0.4))
        return w.select(day("date").alias("date"), "security_id", r("weight", 5).alias("weight"))

    run.__name__ = f"strategy_{name}"
    return run


for _n in (*signals.REGISTRY, "defensive_regime", "vol_managed", "ensemble_rank"):
    QUERIES[f"strategy_{_n}"] = _strategy(_n)

_MOMENTUM = """f AS (SELECT security_id, date, is_month_end, in_index, CAST({e} AS FLOAT) AS v FROM resids WINDOW s272 AS (PARTITION BY security_id ORDER BY session_index RANGE BETWEEN 272 PRECEDING AND 21 PRECEDING)),
  g AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY CAST(v AS DOUBLE) * {sign} DESC, md5(CAST(security_id AS VARCHAR))) AS k FROM f WHERE is_month_end AND in_index AND v IS NOT NULL), h AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM g WHERE k <= 4)
  SELECT strftime(date, '%Y-%m-%d') AS date, security_id, round(1.0 / n, 5) AS weight FROM h"""
_BACK = "(max(close) OVER (PARTITION BY security_id ORDER BY session_index RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING))"
SQL["strategy_momentum_12_1"] = sql("WITH " + _MOMENTUM.format(e=f"{_BACK.format(k=21)} / {_BACK.format(k=273)} - 1", sign=1), "resids")
SQL["strategy_short_reversal"] = sql("WITH " + _MOMENTUM.format(e=f"close / {_BACK.format(k=21)} - 1", sign=-1), "resids")
SQL["strategy_low_vol"] = sql("WITH " + _MOMENTUM.format(e="vol_126d", sign=-1), "resids")
SQL["strategy_equal_weight"] = sql("WITH " + _MOMENTUM.format(e="1.0", sign=1), "resids")
SQL["strategy_cash"] = sql("SELECT strftime(date, '%Y-%m-%d') AS date, security_id, 0.1::DOUBLE AS weight FROM dense WHERE 1 = 0", "dense")

#: Strategies whose score is one rank, as SQL: the feature, and a condition on the rank of another one.
_ONE_RANK = {
    "residual_momentum": ("resid_mom_12_1", None, ""),
    "overnight_momentum": ("mom_on_12_1", None, ""),
    "week52_breakout": ("high_52w_ratio", None, ""),
    "frog_in_the_pan": ("mom_12_1", "info_discreteness", "rb <= 0.5"),
    "illiquidity_carry": ("amihud_illiq", "log_dollar_volume", "rb > 0.1"),
}
for _n, (_a, _b, _c) in _ONE_RANK.items():
    _second = PRICE[_b] if _b else "1.0"
    SQL[f"strategy_{_n}"] = sql(
        f"""WITH f AS (SELECT security_id, date, is_month_end, in_index AS eligible, CAST({PRICE[_a]} AS FLOAT) AS a, CAST({_second} AS FLOAT) AS b FROM resids WINDOW {_WINDOWS}),
        e AS (SELECT * FROM f WHERE is_month_end AND eligible), k AS (SELECT *, {_NRANK.format(c='a')} AS ra, {_NRANK.format(c='b')} AS rb FROM e), s AS (SELECT * FROM k WHERE ra IS NOT NULL {'AND ' + _c if _c else ''}),
        t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ra DESC, md5(CAST(security_id AS VARCHAR))) AS p FROM s), u AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM t WHERE p <= 4)
        SELECT strftime(date, '%Y-%m-%d') AS date, security_id, round(1.0 / n, 5) AS weight FROM u""",
        "resids",
    )
