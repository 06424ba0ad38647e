"""Forward tests, search spaces, acceptance and further sources as queries; most with an SQL twin."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from pitlake.functions.exprs import norm_cdf_sql
from pitlake.operators import acceptance, backtest, costs, forward, genomes, panel, price_features, quality, signals
from pitlake.operators import portfolio as portfolio_ops
from pitlake.plans import standins as S
from pitlake.plans.oracle import sql
from pitlake.plans.q_lake import day, r
from pitlake.plans.q_price import _WINDOWS, PRICE
from pitlake.plans.q_research import _NRANK, _ORDERS_FREE, _W, SQL as _RESEARCH, _events, _run_weights, _schedule, _w
from pitlake.sources import ingest, registry

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(text: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *ctes)
        return f

    return add


# -- forward tests ----------------------------------------------------------------------------------------------------

#: Pairs of legs made of orders: whatever values they have, with nulls.
_LEG = {
    "k": "o_orderkey", "sharpe_r": "(o_custkey % 17) / 6.0e0 - 0.5e0", "sharpe_f": "CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE (o_orderkey % 19) / 6.0e0 - 1.0e0 END", "se_r": "0.2137e0 + (o_custkey % 5) / 20.0e0", "se_f": "0.1071e0 + (o_orderkey % 7) / 10.0e0",
    "n_f": "20 + o_orderkey % 30", "ruined_f": "o_orderkey % 101 = 0", "cagr_f": "(o_custkey % 11) / 40.0e0 - 0.05e0", "bench_sharpe_r": "0.6e0", "bench_sharpe_f": "(o_orderkey % 5) / 8.0e0", "bench_cagr_f": "0.06e0",
    "max_drawdown_f": "-((o_orderkey % 23) / 30.0e0)", "max_drawdown_r": "-0.4e0", "turnover_f": "(o_orderkey % 9) / 4.0e0", "turnover_r": "CASE WHEN o_custkey % 29 = 0 THEN 0.0e0 ELSE 1.0e0 END",
}


def _pairs(spark, d):
    return S.table(spark, d, "orders").selectExpr(*[f"CAST({e} AS {'bigint' if k in ('k', 'n_f') else 'boolean' if k == 'ruined_f' else 'double'}) AS {k}" for k, e in _LEG.items()])


_PAIRS = "p AS (SELECT " + ", ".join(f"CAST({e} AS {'BIGINT' if k in ('k', 'n_f') else 'BOOLEAN' if k == 'ruined_f' else 'DOUBLE'}) AS {k}" for k, e in _LEG.items()) + " FROM orders)"
_COMPARED = f"""{_PAIRS}, c AS (SELECT *, sharpe_f - sharpe_r AS decay, (sharpe_f - sharpe_r) / sqrt(se_r * se_r + se_f * se_f) AS decay_z, sharpe_r - bench_sharpe_r AS dr, sharpe_f - bench_sharpe_f AS df, CASE WHEN turnover_r <> 0 THEN turnover_f / turnover_r END AS tr FROM p),
  q AS (SELECT *, n_f >= 24 AS enough_data, NOT ruined_f AS no_ruin, cagr_f > 0 AS made_money, df > 0 AS beat_benchmark, cagr_f - bench_cagr_f > 0 AS positive_excess, CASE WHEN dr > 0 THEN df > 0 END AS kept_its_edge,
               decay_z >= -1 AS decay_within_noise, max_drawdown_f >= max_drawdown_r AS drawdown_held, 1.5 >= tr AS turnover_held FROM c)"""


@_add(f"WITH {_COMPARED} SELECT k, enough_data, no_ruin, made_money, beat_benchmark, positive_excess, kept_its_edge, decay_within_noise, drawdown_held, turnover_held FROM q")
def forward_nine_checks(spark, d):
    return forward.checks(forward.comparison(_pairs(spark, d))).select("k", *forward.CHECKS)


@_add(f"""WITH {_COMPARED} SELECT k, round(decay, 6) AS decay, round(decay_z, 5) AS decay_z, round({norm_cdf_sql('decay_z')}, 5) AS decay_p, CASE WHEN NOT enough_data THEN 'inconclusive' WHEN NOT no_ruin OR NOT made_money OR decay_z <= -1.96 THEN 'failed' WHEN NOT kept_its_edge OR NOT decay_within_noise THEN 'decayed' ELSE 'held' END AS verdict,
  CASE WHEN NOT enough_data THEN 'enough_data' WHEN NOT no_ruin THEN 'no_ruin' WHEN NOT made_money THEN 'made_money' WHEN decay_z <= -1.96 THEN 'decay' WHEN NOT kept_its_edge THEN 'kept_its_edge' WHEN NOT decay_within_noise THEN 'decay_within_noise' ELSE '' END AS because FROM q""")
def forward_verdicts(spark, d):
    v = forward.verdict(forward.checks(forward.comparison(_pairs(spark, d))))
    return v.select("k", r("decay").alias("decay"), r("decay_z", 5).alias("decay_z"), r("decay_p", 5).alias("decay_p"), "verdict", "because")


@_add("""SELECT 'seal-' || substr(sha256('{"fingerprint":"' || fingerprint || '","study":' || study || '}'), 1, 12) AS seal_id, count(*) AS runs, min(run_id) AS first_run FROM runs GROUP BY 1""", "runs")
def seal_ids(spark, d):
    return S.runs(spark, d).groupBy(forward.seal_id("study", "fingerprint").alias("seal_id")).agg(F.count(F.lit(1)).alias("runs"), F.min("run_id").alias("first_run"))


@_add("""SELECT 'seal-' || substr(sha256('{"fingerprint":"' || fingerprint || '","study":' || study || '}'), 1, 12) AS seal_id, run_id FROM runs WHERE run_id % 3 = 0 AND (study, fingerprint) NOT IN (SELECT (study, fingerprint) FROM runs WHERE run_id % 2 = 1)""", "runs")
def seals_not_yet_written(spark, d):
    """Seals of some runs, without those that others have bound before."""
    fields, x = ["study", "fingerprint"], S.runs(spark, d).withColumn("touches", F.lit(False))
    log = forward.seal(x.where("run_id % 2 = 1"), fields, "before", "2024-01-01")
    return forward.new_seals(forward.seal(x.where("run_id % 3 = 0"), fields, "a reason", "2024-01-02"), log).select("seal_id", "run_id")


@_add("SELECT o_orderkey AS k, '1996-01-01' AS start, strftime(least(DATE '1997-06-30', CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS \"end\" FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def forward_windows(spark, d):
    ends = S.table(spark, d, "orders").where("o_orderdate >= '1996-01-01'").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("data_end"))
    w = forward.forward_window(ends, "1995-01-01", "1997-06-30", "1996-01-01")
    return w.select("k", day("start").alias("start"), day("end").alias("end"))


@_add("SELECT run_id, round(CASE WHEN run_id % 7 <> 0 THEN sharpe - sharpe * (run_id % 5) / 4.0 END, 6) AS drift FROM runs", "runs")
def seal_drift(spark, d):
    x = S.runs(spark, d).withColumns({"sealed": F.col("sharpe") * (F.col("run_id") % 5) / 4.0, "now": F.when(F.col("run_id") % 7 != 0, F.col("sharpe"))})
    return x.select("run_id", r(forward.drift("now", "sealed")).alias("drift"))


@_add(_ORDERS_FREE + " SELECT strftime(sch.date, '%Y-%m-%d') AS signal_date, count(*) AS orders, round(sum(notional), 0) AS notional FROM al JOIN sch USING (period) WHERE sch.date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY sch.date", "dense", "cal")
def orders_by_signal(spark, d):
    """Orders of a window by the date of their signal, not of their fill."""
    x = backtest.ledger_between(backtest.ledger(_events(spark, d, "free")).where("notional > 1e-6"), _schedule(spark, d), "1997-01-01", "1998-12-31")
    return x.groupBy(day("signal_date").alias("signal_date")).agg(F.count(F.lit(1)).alias("orders"), r(F.sum("notional"), 0).alias("notional"))


@_add(_ORDERS_FREE + " SELECT reason, count(*) AS n, round(sum(cash_flow), 0) AS proceeds FROM al WHERE reason LIKE 'exit:%' GROUP BY reason", "dense", "cal")
def forced_exits(spark, d):
    return backtest.exits(_events(spark, d, "free")).select("reason", "n", r("proceeds", 0).alias("proceeds"))


@_add("SELECT study, CASE WHEN max(sharpe) FILTER (fingerprint = 'click') IS NOT NULL THEN 'ensemble' ELSE 'champion' END AS kind, coalesce(max(run_id) FILTER (fingerprint = 'click'), max(run_id) FILTER (fingerprint <> 'click')) AS genome FROM runs GROUP BY study", "runs")
def search_deliverables(spark, d):
    x = S.runs(spark, d)
    own = x.where("fingerprint = 'click'").groupBy("study").agg(F.max("run_id").alias("genome"))
    best = x.where("fingerprint <> 'click'").groupBy("study").agg(F.max("run_id").alias("genome"))
    return forward.deliverables(x.select("study").distinct(), own, best)


@_add("SELECT n_name AS name, n_nationkey AS place FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000)")
def recorded_roster(spark, d):
    n = S.table(spark, d, "nation")
    rec = S.table(spark, d, "customer").where("c_acctbal > 5000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("strategy"))
    return forward.roster(n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("place")), rec)


# -- search spaces ----------------------------------------------------------------------------------------------------


@_add("SELECT preset, n + 6 AS genes, round(s + 11.22, 2) AS low FROM (VALUES ('price', 13, -13.0), ('full', 23, -23.0), ('night', 17, -17.0), ('families', 9, 0.0), ('families-price', 5, 0.0)) v(preset, n, s)")
def search_spaces(spark, d):
    return genomes.presets_frame(spark).groupBy("preset").agg(F.count(F.lit(1)).cast("int").alias("genes"), F.round(F.sum("low"), 2).alias("low"))


def _family_sql(name: str) -> str:
    members = genomes.FAMILIES[name].items()
    n = " + ".join(f"({f} IS NOT NULL)::INT" for f, _ in members)
    total = " + ".join(f"coalesce({f if s > 0 else f'1 - {f}'}, 0)" for f, s in members)
    return f"CASE WHEN {n} > 0 THEN ({total}) / ({n}) END"


_FAMILY_RANKS = {"mom_12_1": "p_size / 50.371e0", "resid_mom_12_1": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE (p_partkey % 100) / 100.913e0 END", "high_52w_ratio": "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice / 3001.7e0 END",
                 "info_discreteness": "CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_partkey % 7) / 7.131e0 END", "asset_growth": "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE (p_partkey % 11) / 11.173e0 END"}


@_add(f"""WITH x AS (SELECT p_partkey AS k, {', '.join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _FAMILY_RANKS.items())} FROM part), c AS (SELECT k, {_family_sql('momentum')} AS m, {_family_sql('investment')} AS i FROM x)
  SELECT k, round((coalesce(0.7 * m, 0) + coalesce(0.4 * i, 0)) / (CASE WHEN m IS NOT NULL THEN 0.7 ELSE 0 END + CASE WHEN i IS NOT NULL THEN 0.4 ELSE 0 END), 6) AS score FROM c""")
def family_composite(spark, d):
    """Two families' composites, weighted: members turned by their sign, missing ones left out."""
    x = S.table(spark, d, "part").selectExpr("p_partkey AS k", *[f"CAST({e} AS double) AS {n}" for n, e in _FAMILY_RANKS.items()])
    return x.select("k", r(genomes.family_score([("momentum", 0.7), ("investment", 0.4)])).alias("score"))


# -- strategies with several ranks ------------------------------------------------------------------------------------

_BLENDS: dict[str, tuple[list[tuple[str, float]], int]] = {
    "lottery_averse": ([("-max_ret_21d", 0.4), ("-skew_252d", 0.4), ("-idio_vol_252d", 0.2)], 2),
    "my_first_idea": ([("mom_6_1", 1.0), ("-vol_126d", 1.0), ("trend_200d", 1.0)], 2),
}


def _blend_sql(name: str) -> str:
    parts, least = _BLENDS[name]
    own = [(f"r{i}", f.lstrip("-"), -1 if f[0] == "-" else 1, w) for i, (f, w) in enumerate(parts)]
    features = ", ".join(f"{'-' if s < 0 else ''}CAST({PRICE[f]} AS FLOAT) AS x{i}" for i, (_, f, s, _) in enumerate(own))
    ranks = ", ".join(f"{_NRANK.format(c=f'x{i}')} AS {n}" for i, (n, *_) in enumerate(own))
    have = " + ".join(f"({n} IS NOT NULL)::INT" for n, *_ in own)
    top = " + ".join(["0.0::DOUBLE", *(f"coalesce({n} * {w}::DOUBLE, 0.0)" for n, _, _, w in own)])
    mass = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {n} IS NOT NULL THEN {w}::DOUBLE ELSE 0.0 END" for n, _, _, w in own)])
    return f"""WITH f AS (SELECT security_id, date, is_month_end, in_index AS eligible, {features} FROM resids WINDOW {_WINDOWS}), e AS (SELECT * FROM f WHERE is_month_end AND eligible), k AS (SELECT *, {ranks} FROM e),
      s AS (SELECT *, CASE WHEN {have} >= {least} THEN ({top}) / ({mass}) END AS score FROM k), t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, md5(CAST(security_id AS VARCHAR))) AS p FROM s WHERE score IS NOT NULL),
      u AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM t WHERE p <= 4) SELECT strftime(date, '%Y-%m-%d') AS date, security_id, round(1.0 / n, 5) AS weight FROM u"""


for _n in _BLENDS:
    _RESEARCH[f"strategy_{_n}"] = sql(_blend_sql(_n), "resids")

_Z = "({x} - avg({x}) OVER (PARTITION BY date)) / nullif(stddev_samp({x}) OVER (PARTITION BY date), 0)"


@_add(f"""WITH f AS (SELECT security_id, date, is_month_end, in_index AS eligible, CAST({PRICE['mom_12_1']} AS FLOAT)::DOUBLE AS a, CAST({PRICE['mom_1m']} AS FLOAT)::DOUBLE AS b, CAST({PRICE['vol_126d']} AS FLOAT)::DOUBLE AS c, CAST({PRICE['trend_200d']} AS FLOAT)::DOUBLE AS t FROM resids WINDOW {_WINDOWS}),
  e AS (SELECT * FROM f WHERE is_month_end AND eligible) SELECT strftime(date, '%Y-%m-%d') AS date, security_id, round(0.4 * {_Z.format(x='a')} + 0.1 * -({_Z.format(x='b')}) + 0.3 * -({_Z.format(x='c')}) + 0.2 * {_Z.format(x='t')}, 4) AS score FROM e""", "resids")
def evolved_blend(spark, d):
    """Four z-scores, weighted; a name that lacks one has no score."""
    x = price_features.price_features(S.dense_panel(spark, d), 3).where("is_month_end AND in_index").withColumn("eligible", F.col("in_index"))
    return signals.evolved_blend(x, {"mom_12_1": 0.4, "mom_1m": -0.1, "vol_126d": -0.3, "trend_200d": 0.2}).select(day("date").alias("date"), "security_id", r("score", 4).alias("score"))


# -- acceptance -------------------------------------------------------------------------------------------------------


@_add(_RESEARCH["strategy_momentum_12_1"].replace("WHERE is_month_end AND in_index AND v IS NOT NULL", "WHERE is_month_end AND in_index AND v IS NOT NULL AND date IN (SELECT date FROM cal WHERE session_index <= 1200)"))
def no_lookahead(spark, d):
    """Weights from a panel that ends with a session are those that the whole panel gives up to it."""
    f = price_features.price_features(panel.truncate(S.dense_panel(spark, d), 1200), 3).where("is_month_end").withColumn("eligible", F.col("in_index"))
    w = portfolio_ops.build_weights(signals.REGISTRY["momentum_12_1"](f), portfolio_ops.Construction(top=4))
    return w.select(day("date").alias("date"), "security_id", r("weight", 5).alias("weight"))


_LEAK = ("trend_200d", "vol_21d", "mom_12_1", "beta_252d")


@_add(f"""WITH f AS (SELECT security_id, session_index, {', '.join(f'CAST({PRICE[n]} AS FLOAT) AS {n}' for n in _LEAK)} FROM resids WINDOW {_WINDOWS}) SELECT security_id, session_index::INT AS session_index, {', '.join(f'round({n}::DOUBLE, 3) AS {n}' for n in _LEAK)} FROM f WHERE session_index BETWEEN 1000 AND 1200""", "resids")
def leakage_check(spark, d):
    """Features from a panel that ends with a session are those that the whole panel gives up to it."""
    cut = price_features.price_features(panel.truncate(S.dense_panel(spark, d), 1200), 3).where("session_index >= 1000")
    return cut.select("security_id", "session_index", *[r(F.col(n).cast("double"), 3).alias(n) for n in _LEAK])


@_add(f"""WITH {_W}, bw AS (SELECT date, security_id, weight * CASE WHEN month(date) = 5 THEN 1.3 WHEN month(date) = 6 AND security_id = 2 THEN -1 ELSE 1 END AS weight FROM wt), xw AS (SELECT date, count(*) FILTER (weight < -1e-9) AS bad, sum(weight) AS total FROM bw GROUP BY date),
  ow AS (SELECT b.date, count(*) AS untradable FROM (SELECT date, (security_id + 1) % 10 AS security_id, weight FROM bw) b LEFT JOIN dense d ON d.date = b.date AND d.security_id = b.security_id AND d.in_index AND d.close IS NOT NULL WHERE b.weight > 0 AND d.date IS NULL GROUP BY b.date)
  SELECT strftime(coalesce(x.date, ow.date), '%Y-%m-%d') AS date, bad, round(total, 6) AS total, coalesce(untradable, 0) AS untradable FROM (SELECT * FROM xw WHERE bad > 0 OR total > 1 + 1e-9) x FULL JOIN ow ON x.date = ow.date""", "dense")
def weight_checks(spark, d):
    """Planted faults: weights over the whole in May, a negative one in June, and names moved to others that can't be traded."""
    w = _w(spark, d).withColumn("weight", F.col("weight") * F.when(F.month("date") == 5, 1.3).when((F.month("date") == 6) & (F.col("security_id") == 2), -1).otherwise(1))
    alien = portfolio_ops.untradable(w.withColumn("security_id", (F.col("security_id") + 1) % 10), S.dense_panel(spark, d)).groupBy("date").agg(F.count(F.lit(1)).alias("untradable"))
    bad = portfolio_ops.violations(w)
    return bad.join(alien, "date", "full").select(day("date").alias("date"), "bad", r("total").alias("total"), F.coalesce("untradable", F.lit(0)).alias("untradable"))


@_add()
def acceptance_contract(spark, d):
    """The contract of a strategy that keeps it, and of two that do not."""
    good = _run_weights(spark, d)
    over = good.withColumns({"run": F.lit("over"), "weight": F.col("weight") * 1.5})
    alien = good.withColumns({"run": F.lit("alien"), "security_id": (F.col("security_id") + 1) % 10})
    return acceptance.contract(good.unionByName(over).unionByName(alien), S.dense_panel(spark, d), _schedule(spark, d), costs.SETTINGS["realistic"], costs.SETTINGS["free"])


@_add("""WITH a AS (SELECT date, avg(close) AS x FROM dense WHERE security_id = 1 GROUP BY date), b AS (SELECT date, avg(close) AS y FROM dense WHERE security_id = 2 GROUP BY date), j AS (SELECT * FROM a JOIN b USING (date)),
  g AS (SELECT pow(arg_max(x, date) / arg_min(x, date), 365.25 / (max(date) - min(date))) - 1 AS first, pow(arg_max(y, date) / arg_min(y, date), 365.25 / (max(date) - min(date))) - 1 AS second FROM j)
  SELECT round(first, 6) AS first, round(second, 6) AS second, round((first - second) * 1e4, 2) AS gap_bp, abs((first - second) * 1e4) <= 25 AS ok FROM g""", "dense")
def calibration(spark, d):
    p = S.dense_panel(spark, d)
    a, b = (p.where(f"security_id = {k}").groupBy("date").agg(F.avg("close").alias("nav")) for k in (1, 2))
    return acceptance.calibrated(a, b).select(r("first").alias("first"), r("second").alias("second"), r("gap_bp", 2).alias("gap_bp"), "ok")


@_add()
def cheats(spark, d):
    """Three ways to look ahead, which must all be blocked."""
    return spark.createDataFrame(list(acceptance.cheats_blocked(S.dense_panel(spark, d), 100).items()), "cheat string, blocked boolean")


# -- sources ----------------------------------------------------------------------------------------------------------


@_add("SELECT min(c_custkey) AS security_id, c_nationkey::BIGINT * 10 AS cik, min(c_name) AS ticker FROM customer WHERE c_nationkey > 0 AND c_acctbal > 0 GROUP BY c_nationkey")
def universe_ciks(spark, d):
    c = S.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("security_id"), F.col("c_name").alias("ticker"))
    master = S.table(spark, d, "customer").select(F.col("c_custkey").alias("security_id"), (F.col("c_nationkey").cast("long") * 10).alias("cik"))
    return ingest.ciks(c, master)


@_add("SELECT min(o_custkey) AS security_id, o_orderpriority || o_orderstatus AS ticker FROM orders GROUP BY 2")
def universe_ever(spark, d):
    x = S.table(spark, d, "orders").select(F.col("o_custkey").alias("security_id"), F.concat("o_orderpriority", "o_orderstatus").alias("ticker"))
    return ingest.resolve_universe(x, x.limit(0))


@_add("SELECT s_name AS code, s_acctbal AS size, false AS is_delisted FROM supplier UNION ALL SELECT c_name, NULL, true FROM customer")
def symbol_lists(spark, d):
    a = S.table(spark, d, "supplier").select(F.col("s_name").alias("code"), F.col("s_acctbal").alias("size"))
    return ingest.flagged_union(a, S.table(spark, d, "customer").select(F.col("c_name").alias("code")))


@_add("SELECT DISTINCT p_brand AS ticker FROM part WHERE p_brand IS NOT NULL")
def distinct_tickers(spark, d):
    return ingest.tickers(S.table(spark, d, "part"), "p_brand").select(F.col("p_brand").alias("ticker"))


@_add("SELECT 'in the archive' AS name, '2024-01-02,1.5' AS line UNION ALL SELECT 'broken', NULL")
def zipped_source(spark, d):
    """The member of an archive, and an archive that can't be read."""
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("DATA.CSV", "date,value\n2024-01-02,1.5\n")
    files = spark.createDataFrame([("in the archive", whole.getvalue()), ("broken", b"PK?")], "path string, content binary")
    return ingest.zip_members(files).select(F.col("path").alias("name"), F.element_at(F.split("text", "\n"), 2).alias("line"))


@_add("SELECT * FROM (VALUES ('AAA', 'One & Co', 'x', '2001-02-03'), ('BBB', 'Two', 'x', NULL)) t(\"Symbol\", \"Security\", \"Added_Ticker\", \"Added_Date\")")
def page_table(spark, d):
    """The table of a page that has a column, its header in two rows and a cell over two rows."""
    page = """<table><tr><th>Other</th></tr><tr><td>1</td></tr></table><table><tr><th rowspan=2>Symbol</th><th rowspan=2>Security</th><th colspan=2>Added</th></tr><tr><th>Ticker</th><th>Date</th></tr>
      <tr><td>AAA</td><td>One &amp; Co</td><td rowspan="2">x</td><td>2001-<b>02</b>-03</td></tr><tr><td>BBB</td><td>Two</td></tr></table>"""
    return ingest.table_frame(spark, page, "symbol", 1)


@_add("SELECT b.l_suppkey AS k, CASE WHEN count(px) = 0 THEN 'no data' ELSE 'x' END AS v FROM (SELECT l_suppkey, l_extendedprice / l_quantity AS px FROM lineitem) b WHERE l_suppkey = 3 GROUP BY 1")
def convention_probe(spark, d):
    """What prices before a known split are: here there is no bar of the days before it, or there is."""
    b = S.bars(spark, d).where("security_id = 3")
    at = ingest.split_convention(b, "1900-01-05", 100.0, 10.0)
    return spark.createDataFrame([(3, "x" if at == "inconclusive" else at)], "k long, v string")


@_add("""WITH b AS (SELECT l_linenumber::VARCHAR AS ticker, CAST(l_shipdate AS DATE) AS date, min(l_extendedprice) AS low, max(l_extendedprice) AS high, CASE WHEN day(CAST(l_shipdate AS DATE)) = 13 THEN max(l_extendedprice) + 1 ELSE avg(l_extendedprice) END AS close, avg(l_extendedprice) AS open,
         CASE WHEN l_linenumber = 1 THEN 0.0 ELSE sum(l_discount) - CASE WHEN day(CAST(l_shipdate AS DATE)) = 2 THEN 1000 ELSE 0 END END AS dividend FROM lineitem GROUP BY l_linenumber, CAST(l_shipdate AS DATE))
  SELECT 'no dividends of ' || ticker AS detail, 1::BIGINT AS n FROM b WHERE ticker = '1' GROUP BY ticker HAVING max(dividend) <= 0 UNION ALL SELECT 'impossible prices', count(*) FROM b WHERE high < close - 1e-9 UNION ALL SELECT 'negative dividend', count(*) FROM b WHERE dividend < 0
  UNION ALL SELECT 'not a session', count(*) FROM b WHERE day(date) = 28""")
def check_benchmarks(spark, d):
    """Planted faults: closes above the high, no dividends of the one that must have them, negative ones, days off the calendar."""
    li = S.table(spark, d, "lineitem").withColumn("date", F.col("l_shipdate").cast("date"))
    p = F.col("l_extendedprice")
    b = li.groupBy(F.col("l_linenumber").cast("string").alias("ticker"), "date").agg(
        F.min(p).alias("low"), F.max(p).alias("high"), F.when(F.dayofmonth(F.first("date")) == 13, F.max(p) + 1).otherwise(F.avg(p)).alias("close"), F.avg(p).alias("open"),
        F.when(F.first("l_linenumber") == 1, 0.0).otherwise(F.sum("l_discount") - F.when(F.dayofmonth(F.first("date")) == 2, 1000).otherwise(0)).alias("dividend"),
    )
    return quality.benchmarks(b, S.calendar(spark, d).where("day(date) <> 28"), "1").select("detail", F.col("rows").alias("n"))


@_add()
def data_version(spark, d):
    """The version of a table, the same however its rows lie."""
    b = S.bars(spark, d)
    return registry.data_version(b, ["security_id", "date"]).unionByName(registry.data_version(b.repartition(7, "date"), ["security_id", "date"])).distinct()
