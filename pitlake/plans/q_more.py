"""Further queries: portfolio diagnostics, scoreboards, forward records, value strategies and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitlake.functions import exprs
from pitlake.operators import adjust, backtest, costs, experiments, fundamental_features, identity, metrics, pit, portfolio, price_features, quality, signals
from pitlake.operators import panel as panel_ops
from pitlake.plans import standins as S
from pitlake.plans.oracle import sql
from pitlake.plans.q_fundamental import _MORE, _values
from pitlake.plans.q_lake import day, r
from pitlake.plans.q_price import _CLASS, _REASONS, _reasons
from pitlake.plans.q_research import _MON, _MS, _RK_SHORT, _events, _run_weights, _schedule
from pitlake.plans.q_timing import _f

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(text: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *ctes)
        return f

    return add


@_add("SELECT DISTINCT event_type AS ticker FROM events")
def available_series(spark, d):
    return S.table(spark, d, "events").select(F.col("event_type").alias("ticker")).distinct()


@_add("SELECT security_id, count(*) AS n, round(avg(close), 4) AS mean_close FROM ibars WHERE session_index BETWEEN 991 AND 1010 GROUP BY security_id", "ibars")
def trailing_window(spark, d):
    p = panel_ops.PointInTime(S.indexed_bars(spark, d), 1010).panel.where("session_index > 1010 - 20")
    return p.groupBy("security_id").agg(F.count(F.lit(1)).alias("n"), r(F.avg("close"), 4).alias("mean_close"))


@_add("SELECT security_id, close FROM ibars WHERE session_index = 700", "ibars")
def price_on(spark, d):
    return panel_ops.PointInTime(S.indexed_bars(spark, d), 1010).at(700).select("security_id", "close")


@_add(f"""WITH {_REASONS}, k AS (SELECT CASE WHEN year("when") <= 1997 THEN 'early' ELSE 'late' END AS era, {_CLASS.format(t='reason_text')} AS c FROM reasons)
  SELECT era, count(*) FILTER (c = 'acquisition') AS acquisition, count(*) FILTER (c = 'bankruptcy') AS bankruptcy, count(*) FILTER (c = 'index_removal') AS index_removal, count(*) FILTER (c = 'unresolved') AS unresolved FROM k GROUP BY era""")
def delisting_crosstab(spark, d):
    x = _reasons(spark, d).select(F.when(F.year("when") <= 1997, "early").otherwise("late").alias("era"), identity.classify_reason(F.col("reason_text")).alias("c"))
    kinds = ["acquisition", "bankruptcy", "index_removal", "unresolved"]
    return x.groupBy("era").pivot("c", kinds).count().na.fill(0, kinds)


@_add("SELECT strftime(date, '%Y-%m-%d') AS date, round(quantile_cont(close, 0.05), 7) AS p5, round(quantile_cont(close, 0.5), 7) AS p50, round(quantile_cont(close, 0.95), 7) AS p95 FROM dense WHERE is_month_end GROUP BY date", "dense")
def feature_percentiles(spark, d):
    q = F.percentile("close", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    x = S.dense_panel(spark, d).where("is_month_end").groupBy("date").agg(q.alias("q"))
    return x.select(day("date").alias("date"), *[r(F.col("q")[i], 7).alias(n) for i, n in enumerate(("p5", "p50", "p95"))])


@_add(f"WITH x AS (SELECT security_id, date, in_index AS eligible, volume AS b, close AS c FROM dense WHERE is_month_end) SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round({_RK_SHORT.format(c='b')}, 6) AS volume__rank, round({_RK_SHORT.format(c='c')}, 6) AS close__rank, c AS close FROM x", "dense")
def rank_panel(spark, d):
    x = S.dense_panel(spark, d).where("is_month_end").withColumn("eligible", F.col("in_index"))
    ranks = {f"{c}__rank": r(signals.rank(c)) for c in ("volume", "close")}
    return x.withColumns(ranks).select("security_id", day("date").alias("date"), *ranks, "close")


@_add("SELECT strftime(date, '%Y-%m-%d') AS date, round(avg(half_spread), 8) AS spread FROM dense WHERE is_month_end AND security_id = 0 GROUP BY date", "dense")
def first_known(spark, d):
    x = S.dense_panel(spark, d).where("is_month_end AND security_id = 0")
    return x.groupBy(day("date").alias("date")).agg(F.round(F.first("half_spread", ignorenulls=True), 8).alias("spread"))


@_add("SELECT security_id, session_index::INT AS session_index, round(CASE WHEN count(ret) OVER w >= 30 THEN stddev_pop(ret) OVER w * sqrt(252) END, 5) AS vol FROM rets WINDOW w AS (PARTITION BY security_id ORDER BY session_index RANGE BETWEEN 62 PRECEDING AND CURRENT ROW)", "rets")
def vol_for_weighting(spark, d):
    x = S.dense_panel(spark, d).withColumn("ret", panel_ops.session_return())
    w = exprs.trailing("session_index", 63, ["security_id"])
    return x.select("security_id", "session_index", r(exprs.trailing_agg(F.stddev_pop("ret"), F.col("ret"), w, 30) * F.sqrt(F.lit(252.0)), 5).alias("vol"))


@_add("""WITH c AS (SELECT p.date, count(*) FILTER (in_index) / any_value(s.size) AS coverage FROM panel p JOIN (SELECT date, (SELECT count(*) FROM intervals i WHERE i.start_date <= c.date AND (i.end_is_open OR i.end_date >= c.date)) AS size FROM cal c) s USING (date) WHERE is_month_end GROUP BY p.date)
  SELECT round(min(coverage), 6) AS least, round(quantile_cont(coverage, 0.5), 6) AS median, round(max(coverage), 6) AS most, strftime(arg_min(date, (coverage, date)), '%Y-%m-%d') AS worst FROM c""", "panel")
def coverage_gate(spark, d):
    c = panel_ops.coverage(S.panel(spark, d), panel_ops.index_size(S.intervals(spark, d), S.calendar(spark, d)))
    return c.agg(r(F.min("coverage")).alias("least"), r(F.percentile("coverage", F.lit(0.5))).alias("median"), r(F.max("coverage")).alias("most"), day(F.min_by("date", F.struct("coverage", "date"))).alias("worst"))


@_add("""WITH g AS (SELECT DISTINCT date FROM curves WHERE run_id = 1), b AS (SELECT g.date, x.close FROM g ASOF JOIN (SELECT * FROM bench WHERE day(date) % 3 <> 0) x ON g.date >= x.date)
  SELECT strftime(date, '%Y-%m-%d') AS date, round(close / first_value(close) OVER (ORDER BY date), 6) AS bench FROM b""", "curves", "bench")
def benchmark_rebased(spark, d):
    """The benchmark on a run's own dates, the last known value where it has none, 1 at the first."""
    dates = S.curves(spark, d).where("run_id = 1").select("date", F.lit(0).alias("k"))
    b = S.benchmark(spark, d).where("day(date) % 3 <> 0").select("date", "close", F.lit(0).alias("k"))
    x = pit.asof_join(dates, b, ["k"], "date", "date", ["close"]).where("close IS NOT NULL")
    return x.select(day("date").alias("date"), r(F.col("close") / F.first("close").over(Window.orderBy("date"))).alias("bench"))


@_add()
def cost_settings(spark, d):
    """One strategy under all cost settings: last value before a trade and all costs of each run."""
    e = backtest.run_settings(_run_weights(spark, d), S.dense_panel(spark, d), _schedule(spark, d), costs.SETTINGS)
    out = backtest.rebalances(e).groupBy("run").agg(F.max_by("nav", "period").alias("nav"), F.sum("cost").alias("cost"))
    return out.select(F.element_at(F.split("run", r"\|"), 2).alias("setting"), r("nav", 2).alias("nav"), r("cost", 2).alias("cost"))


@_add()
def most_traded(spark, d):
    m = backtest.most_traded(backtest.ledger(_events(spark, d)), 5)
    return m.withColumns({"notional": r("notional", 2), "cost": r("cost", 2)})


@_add()
def exit_diagnostics(spark, d):
    return backtest.exits(_events(spark, d, "free")).withColumn("proceeds", r("proceeds", 2))


@_add(f"WITH {_MS} SELECT run_id, round(sharpe * sqrt(12), 5) AS sharpe, row_number() OVER (ORDER BY sharpe DESC, run_id)::INT AS place FROM ms", "curves")
def scoreboard(spark, d):
    m = metrics.monthly_stats(S.curves(spark, d))
    return m.select("run_id", r(F.col("sharpe") * F.sqrt(F.lit(12.0)), 5).alias("sharpe"), F.row_number().over(Window.orderBy(F.desc("sharpe"), "run_id")).alias("place"))


@_add("""WITH y AS (SELECT run_id, year(date) AS year, arg_max(nav, date) AS nav FROM curves GROUP BY ALL), a AS (SELECT run_id, year, nav / lag(nav) OVER (PARTITION BY run_id ORDER BY year) - 1 AS ret FROM y),
  z AS (SELECT year(date) AS year, arg_max(close, date) AS c FROM bench GROUP BY ALL), b AS (SELECT year, c / lag(c) OVER (ORDER BY year) - 1 AS bret FROM z)
  SELECT run_id, year::INT AS year, round(ret, 6) AS ret, round(bret, 6) AS bret, round(ret - bret, 6) AS excess FROM a JOIN b USING (year) WHERE ret IS NOT NULL""", "curves", "bench")
def annual_table(spark, d):
    a = metrics.annual_returns(S.curves(spark, d))
    b = metrics.annual_returns(S.benchmark(spark, d).select(F.lit(0).alias("run_id"), "date", F.col("close").alias("nav"))).select("year", F.col("ret").alias("bret"))
    return a.join(b, "year").select("run_id", "year", r("ret").alias("ret"), r("bret").alias("bret"), r(F.col("ret") - F.col("bret")).alias("excess"))


@_add(f"WITH {_MON}, g AS (SELECT run_id, pow(arg_max(nav, date) / arg_min(nav, date), 365.25 / date_diff('day', min(date), max(date))) - 1 AS cagr FROM curves GROUP BY run_id) SELECT g.run_id, round(any_value(cagr), 5) AS cagr, round(stddev_samp(ret) * sqrt(12), 5) AS vol FROM g JOIN mr USING (run_id) GROUP BY g.run_id", "curves")
def risk_return(spark, d):
    c = S.curves(spark, d)
    v = metrics.monthly_returns(c).groupBy("run_id").agg((F.stddev_samp("ret") * F.sqrt(F.lit(12.0))).alias("vol"))
    return adjust.cagr(c, "nav", ["run_id"]).join(v, "run_id").select("run_id", r("cagr", 5).alias("cagr"), r("vol", 5).alias("vol"))


@_add("SELECT run_id, strftime(month, '%Y-%m-%d') AS date, round(nav, 6) AS nav FROM (SELECT run_id, last_day(date) AS month, arg_max(nav, date) AS nav FROM curves GROUP BY ALL)", "curves")
def load_curves(spark, d):
    """Month-end curves as logged lines of parallel arrays, and unpacked again; a later line supersedes."""
    m = metrics.to_monthly(S.curves(spark, d))
    lines = m.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "nav"))), lambda x: x["month"]).alias("dates"), F.transform(F.array_sort(F.collect_list(F.struct("month", "nav"))), lambda x: x["nav"]).alias("navs"))
    logged = lines.withColumn("line", F.lit(2)).unionByName(lines.withColumns({"line": F.lit(1), "navs": F.transform("navs", lambda v: v * 0)}))
    return experiments.unpack_curves(logged).select("run_id", day("date").alias("date"), r("nav").alias("nav"))


@_add("""WITH w AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 AS INT) AS "end" FROM orders)
  SELECT k, strftime(CASE WHEN greatest(start, DATE '1998-07-01') <= "end" THEN greatest(start, DATE '1998-07-01') END, '%Y-%m-%d') AS fresh_start FROM w""")
def fresh_windows(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("start"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 300).cast("int")).alias("end"))
    return experiments.freshness(o, "1998-06-30").select("k", day("fresh_start").alias("fresh_start"))


@_add(f"WITH {_MS}, x AS (SELECT *, sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 0) / (n - 1)) AS se FROM ms) SELECT run_id, round((sharpe - 1.959963984540054 * se) * sqrt(12), 5) AS lo, round((sharpe + 1.959963984540054 * se) * sqrt(12), 5) AS hi, round(1.959963984540054 * sqrt(2) * sqrt((1 + sharpe * sharpe / 2) / (n - 1)) * sqrt(12), 5) AS gap FROM x", "curves")
def sharpe_band(spark, d):
    m = metrics.monthly_stats(S.curves(spark, d)).withColumn("a", F.col("sharpe") * F.sqrt(F.lit(12.0)))
    lo, hi = experiments.sharpe_band(F.col("a"), F.col("n"), F.col("skew"), F.col("kurt"))
    return m.select("run_id", r(lo, 5).alias("lo"), r(hi, 5).alias("hi"), r(experiments.detectable_gap(F.col("n"), F.col("a")), 5).alias("gap"))


@_add("""WITH c AS (SELECT * FROM curves WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'), r AS (SELECT run_id, nav / lag(nav) OVER (PARTITION BY run_id ORDER BY date) - 1 AS ret FROM c)
  SELECT run_id, count(ret) AS n, round(avg(ret) / stddev_samp(ret) * sqrt(252), 5) AS sharpe FROM r GROUP BY run_id""", "curves")
def leg_from_slice(spark, d):
    c = S.curves(spark, d).where("date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
    return metrics.performance(c).select("run_id", "n", r("sharpe", 5).alias("sharpe"))


@_add(f"""WITH {_MS}, s AS (SELECT *, sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 0) / (n - 1)) AS se FROM ms), p AS (SELECT a.run_id, a.sharpe AS sr, a.se AS er, b.sharpe AS sf, b.se AS ef, b.n FROM s a JOIN s b ON b.run_id = (a.run_id + 1) % 5)
  SELECT run_id, n >= 12 AS enough_months, sf > 0 AS positive, abs(sf - sr) <= 1.959963984540054 * sqrt(ef * ef + er * er) AS within_band, CASE WHEN sr > 0 THEN sf >= sr / 2 END AS kept_half FROM p""", "curves")
def forward_checks(spark, d):
    s = metrics.sharpe_inference(metrics.monthly_stats(S.curves(spark, d)))
    a = s.select("run_id", F.col("sharpe").alias("sharpe_r"), F.col("se").alias("se_r"))
    b = s.select(F.pmod(F.col("run_id") + 4, F.lit(5)).alias("run_id"), F.col("sharpe").alias("sharpe_f"), F.col("se").alias("se_f"), F.col("n").alias("n_f"))
    return experiments.checks(a.join(b, "run_id")).select("run_id", "enough_months", "positive", "within_band", "kept_half")


@_add("SELECT run_id, strftime(max(ts_end) OVER (PARTITION BY study, fingerprint ORDER BY logged_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '%Y-%m-%d') AS prev_end FROM (SELECT *, CAST(logged_at AS DATE) - CAST(run_id % 9 AS INT) AS ts_end FROM runs)", "runs")
def previous_data_end(spark, d):
    x = S.runs(spark, d).withColumn("data_end", F.date_sub(F.col("logged_at").cast("date"), (F.col("run_id") % 9).cast("int")))
    return experiments.previous_end(x, ["study", "fingerprint"]).select("run_id", day("prev_end").alias("prev_end"))


@_add("""SELECT study AS forward_id, strftime(date, '%Y-%m-%d') AS date, run_id FROM (SELECT study, CAST(logged_at AS DATE) AS date, run_id, row_number() OVER (PARTITION BY study, CAST(logged_at AS DATE) ORDER BY run_id) k FROM runs) WHERE k = 1""", "runs")
def stitched_curve(spark, d):
    x = S.runs(spark, d).select(F.col("study").alias("forward_id"), F.col("logged_at").cast("date").alias("date"), F.col("run_id").alias("window"), "run_id")
    return experiments.stitched(x).select("forward_id", day("date").alias("date"), "run_id")


@_add(f"WITH s AS (SELECT count(DISTINCT fingerprint || study) AS trials, stddev_samp(sharpe) AS sd FROM runs) SELECT trials, round(sd, 6) AS trial_sd, round({metrics.expected_max_sharpe_sql('trials', 'sd')}, 5) AS bar FROM s", "runs")
def selection_bar(spark, d):
    x = S.runs(spark, d).withColumn("seal_id", F.concat("fingerprint", F.col("study").cast("string")))
    return experiments.selection_bar(x, F.expr(metrics.expected_max_sharpe_sql("trials", "trial_sd"))).select("trials", r("trial_sd").alias("trial_sd"), r("bar", 5).alias("bar"))


@_add("SELECT fingerprint, study AS origin FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY logged_at, run_id) k FROM runs WHERE study NOT IN (1, 2)) WHERE k = 1", "runs")
def origin_study(spark, d):
    return experiments.origin_study(S.runs(spark, d), ["1", "2"])


@_add("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY study % 20, fingerprint ORDER BY logged_at DESC, run_id DESC) k FROM runs), b AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY logged_at DESC, run_id DESC) j FROM a WHERE k = 1) SELECT fingerprint AS strategy, run_id FROM b WHERE j = 1""", "runs")
def primary_rows(spark, d):
    x = S.runs(spark, d).withColumns({"seal_id": F.concat("fingerprint", (F.col("study") % 20).cast("string")), "strategy": F.col("fingerprint")})
    return experiments.primary_rows(x).select("strategy", "run_id")


@_add("WITH s AS (SELECT fingerprint AS name, avg(sharpe) AS a, min(sharpe) AS b FROM runs GROUP BY 1) SELECT name, a = max(a) OVER () AS best_a, b = min(b) OVER () AS best_b FROM s", "runs")
def best_in_column(spark, d):
    x = S.runs(spark, d).groupBy(F.col("fingerprint").alias("name")).agg(F.avg("sharpe").alias("a"), F.min("sharpe").alias("b"))
    return experiments.highlight_best(x, ["a"], ["b"]).select("name", "best_a", "best_b")


@_add("SELECT fingerprint AS family, arg_max(run_id, (sharpe, -run_id)) AS run_id FROM runs GROUP BY 1", "runs")
def best_per_family(spark, d):
    return S.runs(spark, d).groupBy(F.col("fingerprint").alias("family")).agg(F.max_by("run_id", F.struct("sharpe", F.negative("run_id"))).alias("run_id"))


@_add("""WITH one AS (SELECT session_index, volume FROM dense WHERE security_id = 3), x AS (SELECT session_index, lag(volume) OVER (ORDER BY session_index) AS v FROM one), y AS (SELECT *, CASE WHEN count(v) OVER w >= 20 THEN quantile_cont(v, 0.5) OVER w END AS m FROM x WINDOW w AS (ORDER BY session_index RANGE BETWEEN 62 PRECEDING AND CURRENT ROW))
  SELECT session_index::INT AS session_index, coalesce(v > m, false) AS hold_on FROM y""", "dense")
def timing_vix_overnight(spark, d):
    """Overnight where yesterday's gauge is above its trailing median."""
    w = Window.orderBy("session_index")
    x = S.dense_panel(spark, d).where("security_id = 3").select("session_index", F.lag("volume").over(w).alias("v"))
    t = w.rangeBetween(-62, 0)
    return x.select("session_index", F.coalesce(F.col("v") > F.when(F.count("v").over(t) >= 20, F.percentile("v", F.lit(0.5)).over(t)), F.lit(False)).alias("hold_on"))


@_add("SELECT security_id, session_index::INT AS session_index, round(close / avg(close) OVER (PARTITION BY security_id ORDER BY session_index RANGE BETWEEN 99 PRECEDING AND CURRENT ROW) - 1, 6) AS trend FROM dense", "dense")
def price_trend(spark, d):
    w = exprs.trailing("session_index", 100, ["security_id"])
    return S.dense_panel(spark, d).select("security_id", "session_index", r(F.col("close") / F.avg("close").over(w) - 1).alias("trend"))


@_add("SELECT label, avg(CASE WHEN embedding[1] + embedding[2] > 0 THEN 1.0 ELSE 0 END) >= 0.5 AS gate FROM embeddings GROUP BY label")
def ensemble_vote(spark, d):
    """The majority of a group's members decides."""
    return S.table(spark, d, "embeddings").groupBy("label").agg((F.avg((F.col("embedding")[0] + F.col("embedding")[1] > 0).cast("double")) >= 0.5).alias("gate"))


# -- value strategies ---------------------------------------------------------------------------------------------------


def _value(name: str):
    def run(spark, d):
        values = _values(spark, d).withColumns({k: F.expr(v) for k, v in _MORE.items()})
        f = fundamental_features.ratio_features(values).join(fundamental_features.days_since_filing(S.facts(spark, d), values.select("security_id", "date")), ["security_id", "date"])
        x = f.withColumns(
            {
                "eligible": F.lit(True), "eps_surprise": F.col("eps_change_yoy"), "restatement_rate": F.col("accruals"), "months_in_index": F.month("date"), "div_cut": (F.col("accruals") > 0).cast("double"),
                "div_growth_1y": F.col("asset_growth"), "div_yield": F.col("cf_yield"), "div_due_1m": (F.month("date") % 3 == 0).cast("double"),
            }
        )
        w = portfolio.build_weights(signals.value_strategies()[name](x), portfolio.Construction(top=5, cap=0.5))
        return w.select(day("date").alias("date"), "security_id", r("weight", 5).alias("weight"))

    run.__name__ = f"strategy_{name}"
    return run


for _n in ("pead_drift", "accrual_quality", "quality_value", "restatement_averse", "index_entry_drift", "dividend_grower", "div_month"):
    QUERIES[f"strategy_{_n}"] = _value(_n)

# -- further checks -------------------------------------------------------------------------------------------------------


@_add("WITH l AS (SELECT security_id, max(date) AS lb FROM bars WHERE security_id % 10 <> 4 GROUP BY 1), e AS (SELECT security_id, max(end_date) FILTER (NOT end_is_open) AS ex, bool_or(end_is_open) AS op FROM intervals GROUP BY 1), x AS (SELECT e.*, l.lb FROM e LEFT JOIN l USING (security_id)) " + _f("ticker_recycling", "WARN", "CAST(security_id AS VARCHAR)", "'days of bars after the exit'", "(lb - ex)", "FROM x WHERE NOT op AND lb - ex > 30") + " UNION ALL " + _f("ticker_recycling", "WARN", "CAST(security_id AS VARCHAR)", "'member without bars'", "0", "FROM x WHERE lb IS NULL"), "bars", "intervals")
def check_ticker_recycling(spark, d):
    return quality.ticker_recycling(S.bars(spark, d).where("security_id % 10 <> 4"), S.intervals(spark, d), 30)


@_add("WITH n AS (SELECT count(DISTINCT security_id) AS a FROM intervals), m AS (SELECT count(DISTINCT b.security_id) AS b FROM bars b JOIN intervals i ON i.security_id = b.security_id AND b.date >= i.start_date AND (i.end_is_open OR b.date <= i.end_date) WHERE b.security_id % 2 = 0) " + _f("universe_coverage", "WARN", "'members'", "CAST(b AS VARCHAR) || ' of ' || CAST(a AS VARCHAR)", "(a - b)", "FROM n, m WHERE b < 0.8 * a"), "bars", "intervals")
def check_universe_coverage(spark, d):
    return quality.universe_coverage(S.bars(spark, d).where("security_id % 2 = 0"), S.intervals(spark, d))


_MASTER = "m AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN 'X' || c_custkey ELSE 'SID' || lpad(CAST(c_custkey % 1400 AS VARCHAR), 6, '0') END AS security_id, c_nationkey AS cik, CASE WHEN c_custkey % 77 = 0 THEN '' ELSE c_name END AS ticker FROM customer), z AS (SELECT *, count(*) OVER (PARTITION BY security_id) AS a, count(*) OVER (PARTITION BY cik, ticker) AS b FROM m)"


@_add(f"WITH {_MASTER} SELECT * FROM (" + " UNION ALL ".join(_f("security_master", "ERROR", "''", f"'{k}'", "count(*)", f"FROM z WHERE {v}") for k, v in {"malformed id": "NOT regexp_matches(security_id, '^SID[0-9]{6}$')", "repeated id": "a > 1", "repeated key": "b > 1", "no ticker": "ticker = ''"}.items()) + ") WHERE rows > 0")
def check_security_master(spark, d):
    k = F.col("c_custkey")
    m = S.table(spark, d, "customer").select(F.when(k % 50 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.format_string("SID%06d", k % 1400)).alias("security_id"), F.col("c_nationkey").alias("cik"), F.when(k % 77 == 0, "").otherwise(F.col("c_name")).alias("ticker"))
    return quality.security_master(m)


@_add("WITH x AS (SELECT l_discount - 0.05 AS smb, l_tax - 0.04 AS hml FROM lineitem) SELECT * FROM (" + _f("factor_sanity", "ERROR", "''", "'smb out of bounds'", "count(*)", "FROM x WHERE abs(smb) > 0.045") + " UNION ALL " + _f("factor_sanity", "ERROR", "''", "'hml out of bounds'", "count(*)", "FROM x WHERE abs(hml) > 0.045") + ") WHERE rows > 0")
def check_factor_sanity(spark, d):
    x = S.table(spark, d, "lineitem").select((F.col("l_discount") - 0.05).alias("smb"), (F.col("l_tax") - 0.04).alias("hml"))
    return quality.factor_sanity(x, ["smb", "hml"], 0.045, 1.0)


@_add("SELECT * FROM (" + _f("half_spread", "ERROR", "''", "'half_spread out of bounds'", "count(*)", "FROM dense WHERE NOT half_spread BETWEEN 0.0006 AND 0.2") + ") WHERE rows > 0", "dense")
def check_half_spread(spark, d):
    return quality.bounds(S.dense_panel(spark, d), "half_spread", "half_spread", 0.0006, 0.2)


@_add("SELECT * FROM (" + _f("labels", "ERROR", "''", "'unknown action_type'", "count(*)", "FROM actions WHERE action_type NOT IN ('dividend')") + ") WHERE rows > 0", "actions")
def check_labels(spark, d):
    return quality.labels(S.actions(spark, d), "labels", "action_type", ["dividend"])


@_add(_f("membership_sanity", "ERROR", "strftime(month, '%Y-%m-%d')", "'implausible size'", "count(*)", "FROM snapshots GROUP BY month HAVING NOT count(*) BETWEEN 45 AND 50"), "snapshots")
def check_snapshot_sizes(spark, d):
    return quality.snapshot_sizes(S.snapshots(spark, d), 45, 50)


@_add("WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) " + _f("changes_completeness", "INFO", "CAST(y AS VARCHAR)", "'fewer events than usual'", "n", "FROM y WHERE n < 0.9 * (SELECT quantile_cont(n, 0.5) FROM y)"))
def check_changes_completeness(spark, d):
    return quality.changes_per_year(S.table(spark, d, "orders"), "o_orderdate", 0.9)


@_add("WITH a AS (SELECT date, close AS x FROM bench), b AS (SELECT date, avg(close) AS y FROM bars GROUP BY date), g AS (SELECT abs(x - y) AS gap FROM a JOIN b USING (date)) SELECT 'cross_source' AS \"check\", 'WARN' AS severity, 'price' AS entity, count(*) AS rows FROM g WHERE gap > 300", "bench", "bars")
def check_cross_source(spark, d):
    a = S.benchmark(spark, d).select("date", F.col("close").alias("value"))
    b = S.bars(spark, d).groupBy("date").agg(F.avg("close").alias("value"))
    return quality.cross_source(a, b, 300.0, "price").drop("detail")


@_add("SELECT security_id, count(*) AS rows_, round(max(half_spread), 6) AS most FROM dense GROUP BY security_id", "dense")
def spread_join(spark, d):
    """Spreads joined to the panel; what has none stays null."""
    p = S.dense_panel(spark, d)
    spreads = p.select("security_id", "date", F.col("half_spread").alias("hs"))
    return p.drop("half_spread").join(spreads, ["security_id", "date"], "left").groupBy("security_id").agg(F.count(F.lit(1)).alias("rows_"), r(F.max("hs")).alias("most"))



@_add()
def backtest_roster(spark, d):
    """Several strategies under all cost settings at once: one plan for the weights and prices of all, one fold a run."""
    p, sched = S.dense_panel(spark, d), _schedule(spark, d)
    x = price_features.price_features(p, 3).where("is_month_end").withColumn("eligible", F.col("in_index"))
    names = ("equal_weight", "momentum_12_1", "low_vol", "short_reversal", "week52_breakout", "overnight_momentum")
    for name in names:
        x = signals.REGISTRY[name](x).withColumnRenamed("score", f"s_{name}")
    long = x.select("date", "security_id", "eligible", F.explode(F.array(*[F.struct(F.lit(n).alias("run"), F.col(f"s_{n}").cast("double").alias("score")) for n in names])).alias("v"))
    weights = portfolio.build_weights(long.select("date", "security_id", "eligible", "v.run", "v.score"), portfolio.Construction(top=4), ("run", "date"))
    h = backtest.rebalances(backtest.run_settings(weights, p, sched, costs.SETTINGS))
    return h.groupBy("run").agg(F.count_if(F.col("traded") > 0).alias("trades"), F.max("period").alias("last_period"))
