"""A query for each price feature, market-state feature and liquidity estimate."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import liquidity, price_features
from pitlake.plans import standins as S
from pitlake.plans.oracle import sql
from pitlake.plans.q_lake import day, r

QUERIES: dict = {}
SQL: dict[str, str] = {}

_LONG = "PARTITION BY security_id ORDER BY session_index RANGE BETWEEN"
_WINDOWS = ", ".join(
    f"{name} AS ({_LONG} {a} PRECEDING AND {b})"
    for name, a, b in (("w20", 20, "CURRENT ROW"), ("w62", 62, "CURRENT ROW"), ("w199", 199, "CURRENT ROW"), ("w251", 251, "CURRENT ROW"), ("s272", 272, "21 PRECEDING"))
)


def _at(k: int) -> str:
    return f"(max(close) OVER ({_LONG} {k} PRECEDING AND {k} PRECEDING))" if k else "close"


def _ratio(skip: int, lookback: int) -> str:
    return f"{_at(skip)} / {_at(skip + lookback)} - 1"


def _agg(f: str, c: str, w: str, least: int) -> str:
    return f"CASE WHEN count({c}) OVER {w} >= {least} THEN {f} OVER {w} END"


#: Each feature as an expression over the rows of `resids`.
PRICE = {
    "mom_12_1": _ratio(21, 252),
    "mom_6_1": _ratio(21, 126),
    "mom_1m": _ratio(0, 21),
    "rev_1m": f"-({_ratio(0, 21)})",
    "ret_3m": _ratio(0, 63),
    "ret_12m": _ratio(0, 252),
    "mom_on_12_1": f"exp({_agg('sum(leg_on)', 'leg_on', 's272', 126)}) - 1",
    "mom_id_12_1": f"exp({_agg('sum(leg_id)', 'leg_id', 's272', 126)}) - 1",
    "on_minus_id_252d": f"{_agg('sum(leg_on)', 'leg_on', 'w251', 126)} - {_agg('sum(leg_id)', 'leg_id', 'w251', 126)}",
    "trend_200d": f"close / {_agg('avg(close)', 'close', 'w199', 100)} - 1",
    "high_52w_ratio": f"close / {_agg('max(close)', 'close', 'w251', 126)}",
    "resid_mom_12_1": f"{_agg('sum(resid)', 'resid', 's272', 126)} / ({_agg('stddev_samp(resid)', 'resid', 's272', 126)} * sqrt(252))",
    "info_discreteness": f"sign({_ratio(21, 252)}) * {_agg('avg(CASE WHEN ret < 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END)', 'ret', 's272', 126)} - sign({_ratio(21, 252)}) * {_agg('avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END)', 'ret', 's272', 126)}",
    "vol_21d": f"{_agg('stddev_samp(ret)', 'ret', 'w20', 15)} * sqrt(252)",
    "vol_126d": "vol_126d",
    "vol_of_vol_252d": _agg("stddev_samp(vol_126d)", "vol_126d", "w251", 126),
    "skew_252d": _agg("skewness(ret)", "ret", "w251", 126),
    "max_ret_21d": _agg("max(ret)", "ret", "w20", 10),
    "beta_252d": "beta",
    "corr_mkt_252d": "corr",
    "idio_vol_252d": f"{_agg('stddev_samp(resid)', 'resid', 'w251', 126)} * sqrt(252)",
    "amihud_illiq": f"ln(1 + {_agg('avg(abs(ret) / dollar_volume * 1e9)', 'abs(ret) / dollar_volume', 'w62', 30)})",
    "log_dollar_volume": "ln(dollar_volume)",
    "half_spread_bp": "half_spread * 1e4",
}


def _price(name: str):
    def run(spark, d):
        f = price_features.price_features(S.dense_panel(spark, d), least_market=3)
        return f.where("is_month_end").select("security_id", day("date").alias("date"), r(F.col(name).cast("double"), 3).alias("value"))

    run.__name__ = f"feature_{name}"
    return run


for _name, _expr in PRICE.items():
    QUERIES[f"feature_{_name}"] = _price(_name)
    SQL[f"feature_{_name}"] = sql(
        f"SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) AS value FROM (SELECT security_id, date, is_month_end, {_expr} AS value FROM resids WINDOW {_WINDOWS}) WHERE is_month_end",
        "resids",
    )

_MKT = """mk AS (SELECT c.session_index, c.date, c.is_month_end, m.mkt, b.breadth, exp(sum(ln(1 + coalesce(m.mkt, 0))) OVER (ORDER BY c.session_index)) AS level
  FROM cal c LEFT JOIN (SELECT DISTINCT session_index, mkt FROM rets) m USING (session_index)
  LEFT JOIN (SELECT session_index, CASE WHEN count(a) >= 3 THEN avg(a) END AS breadth FROM (
     SELECT session_index, CASE WHEN in_index AND count(close) OVER w >= 100 THEN CASE WHEN close > avg(close) OVER w THEN 1.0 ELSE 0.0 END END AS a FROM rets
     WINDOW w AS (PARTITION BY security_id ORDER BY session_index RANGE BETWEEN 199 PRECEDING AND CURRENT ROW)) GROUP BY session_index) b USING (session_index))"""

MARKET = {
    "mkt_trend_200d": "level / CASE WHEN count(level) OVER w199 >= 100 THEN avg(level) OVER w199 END - 1",
    "mkt_drawdown": "level / max(level) OVER (ORDER BY session_index) - 1",
    "mkt_vol_21d": "CASE WHEN count(mkt) OVER w20 >= 10 THEN stddev_samp(mkt) OVER w20 END * sqrt(252)",
    "mkt_vol_252d": "CASE WHEN count(mkt) OVER w251 >= 126 THEN stddev_samp(mkt) OVER w251 END * sqrt(252)",
    "mkt_vol_ratio": "CASE WHEN count(mkt) OVER w20 >= 10 THEN stddev_samp(mkt) OVER w20 END / CASE WHEN count(mkt) OVER w251 >= 126 THEN stddev_samp(mkt) OVER w251 END",
    "mkt_breadth_200d": "breadth",
}


def _market(name: str):
    def run(spark, d):
        days = S.calendar(spark, d).where("is_month_end").select("session_index", "date")
        state = price_features.market_state(S.dense_panel(spark, d), 3)
        return days.join(state, "session_index").select(day("date").alias("date"), r(name, 4).alias("value"))

    run.__name__ = f"feature_{name}"
    return run


for _name, _expr in MARKET.items():
    QUERIES[f"feature_{_name}"] = _market(_name)
    SQL[f"feature_{_name}"] = sql(
        f"WITH {_MKT} SELECT strftime(date, '%Y-%m-%d') AS date, round(value, 4) AS value FROM (SELECT date, is_month_end, {_expr} AS value FROM mk WINDOW "
        + ", ".join(f"w{k} AS (ORDER BY session_index RANGE BETWEEN {k} PRECEDING AND CURRENT ROW)" for k in (20, 199, 251))
        + ") WHERE is_month_end",
        "rets",
    )


def _add(text: str | None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text, *ctes)
        return f

    return add


@_add("SELECT session_index::INT AS session_index, count(ret) AS n, round(any_value(mkt), 6) AS mkt FROM rets GROUP BY session_index", "rets")
def market_return(spark, d):
    rows = price_features.with_returns(S.dense_panel(spark, d), 3)
    return rows.groupBy("session_index").agg(F.count("ret").alias("n"), r(F.first("mkt")).alias("mkt"))


@_add("SELECT security_id, session_index::INT AS session_index, round(leg_on, 6) AS leg_on, round(leg_id, 6) AS leg_id FROM rets", "rets")
def overnight_intraday_legs(spark, d):
    return price_features.with_returns(S.dense_panel(spark, d), 3).select("security_id", "session_index", r("leg_on").alias("leg_on"), r("leg_id").alias("leg_id"))


_CS = """x AS (SELECT *, CASE WHEN lag(session_index) OVER w = session_index - 1 THEN lag(high) OVER w END AS h0, CASE WHEN lag(session_index) OVER w = session_index - 1 THEN lag(low) OVER w END AS l0,
    CASE WHEN lag(session_index) OVER w = session_index - 1 THEN lag(close) OVER w END AS c0 FROM dense WINDOW w AS (PARTITION BY security_id ORDER BY session_index)),
  y AS (SELECT *, high - g AS h, low - g AS l FROM (SELECT *, CASE WHEN c0 IS NULL THEN NULL WHEN low > c0 THEN low - c0 WHEN high < c0 THEN high - c0 ELSE 0 END AS g FROM x)),
  z AS (SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) AS alpha FROM (
    SELECT *, pow(ln(h / l), 2) + pow(ln(h0 / l0), 2) AS beta, pow(ln(greatest(h, h0) / least(l, l0)), 2) AS gamma FROM y WHERE l > 0 AND l0 > 0)),
  cs AS (SELECT d.*, 2 * (exp(alpha) - 1) / (1 + exp(alpha)) AS cs FROM dense d LEFT JOIN (SELECT security_id, session_index, alpha FROM z) USING (security_id, session_index))"""
_AR = """m AS (SELECT *, (ln(high) + ln(low)) / 2 AS mid FROM dense),
  p AS (SELECT *, (ln(close) - mid) * (ln(close) - CASE WHEN lead(session_index) OVER w = session_index + 1 THEN lead(mid) OVER w END) AS prod FROM m WINDOW w AS (PARTITION BY security_id ORDER BY session_index)),
  ar AS (SELECT security_id, session_index, CASE WHEN count(prod) OVER w >= 7 THEN 2 * sqrt(greatest(avg(prod) OVER w, 0)) END AS ar FROM p
         WINDOW w AS (PARTITION BY security_id ORDER BY session_index RANGE BETWEEN 21 PRECEDING AND 1 PRECEDING))"""


@_add(f"WITH {_CS} SELECT security_id, session_index::INT AS session_index, round(cs, 5) AS cs FROM cs", "dense")
def corwin_schultz(spark, d):
    return liquidity.corwin_schultz(S.dense_panel(spark, d)).select("security_id", "session_index", r("cs", 5).alias("cs"))


@_add(f"WITH {_AR} SELECT security_id, session_index::INT AS session_index, round(ar, 5) AS ar FROM ar", "dense")
def abdi_ranaldo(spark, d):
    return liquidity.abdi_ranaldo(S.dense_panel(spark, d)).select("security_id", "session_index", r("ar", 5).alias("ar"))


_HS = f"""{_CS}, hs AS (SELECT *, greatest(CASE WHEN count(cs) OVER w >= 7 THEN greatest(avg(cs) OVER w, 0) / 2 END) AS half, CASE WHEN date < DATE '2001-04-09' THEN 0.0625 ELSE 0.01 END / 2 / close AS floor_
    FROM cs WINDOW w AS (PARTITION BY security_id ORDER BY session_index RANGE BETWEEN 20 PRECEDING AND CURRENT ROW)),
  fin AS (SELECT security_id, date, least(greatest(half, floor_), 0.2) AS half_spread, CASE WHEN half > floor_ THEN 'estimator' ELSE 'tick_floor' END AS binding FROM hs)"""


@_add(f"WITH {_HS} SELECT security_id, strftime(date, '%Y-%m-%d') AS date, round(CAST(CAST(half_spread AS FLOAT) AS DOUBLE), 5) AS half_spread, binding FROM fin", "dense")
def half_spread(spark, d):
    h = liquidity.half_spread(S.dense_panel(spark, d))
    return h.select("security_id", day("date").alias("date"), r(F.col("half_spread").cast("double"), 5).alias("half_spread"), "binding")


@_add(f"""WITH {_HS} SELECT CASE WHEN year(date) <= 1997 THEN 'to 1997' WHEN year(date) <= 2000 THEN '1998-2000' ELSE 'from 2001' END AS era, count(*) AS rows_,
          round(quantile_cont(CAST(CAST(half_spread AS FLOAT) AS DOUBLE) * 1e4, 0.5), 2) AS median_bp, round(quantile_cont(CAST(CAST(half_spread AS FLOAT) AS DOUBLE) * 1e4, 0.9), 2) AS p90_bp,
          round(avg(CASE WHEN binding = 'tick_floor' THEN 1.0 ELSE 0.0 END), 6) AS tick_share FROM fin GROUP BY 1""", "dense")
def spread_eras(spark, d):
    e = liquidity.spread_eras(liquidity.half_spread(S.dense_panel(spark, d)))
    return e.select("era", "rows_", r("median_bp", 2).alias("median_bp"), r("p90_bp", 2).alias("p90_bp"), r("tick_share").alias("tick_share"))


_REASONS = """reasons AS (SELECT p_partkey % 100 AS security_id, CAST(DATE '1995-01-01' + CAST(p_partkey * 37 % 2400 AS INT) AS DATE) AS "when",
  CASE p_size % 5 WHEN 0 THEN 'Filed for Chapter 11' WHEN 1 THEN 'Acquired by ' || p_brand WHEN 2 THEN 'Market cap changes' WHEN 3 THEN 'Spun off and merged' ELSE p_name END AS reason_text FROM part)"""
_CLASS = """CASE WHEN regexp_matches(lower({t}), 'bankrupt|chapter 11|liquidat|receiver') THEN 'bankruptcy'
  WHEN regexp_matches(lower({t}), 'acqui|merge|bought|takeover|private') AND NOT regexp_matches(lower({t}), 'spin-?off|spun off') THEN 'acquisition'
  WHEN regexp_matches(lower({t}), 'market cap|replac|remov|spin-?off|spun off') THEN 'index_removal' ELSE 'unresolved' END"""


def _reasons(spark, d):
    p = S.table(spark, d, "part")
    text = F.when(F.col("p_size") % 5 == 0, "Filed for Chapter 11").when(F.col("p_size") % 5 == 1, F.concat(F.lit("Acquired by "), "p_brand")).when(F.col("p_size") % 5 == 2, "Market cap changes").when(F.col("p_size") % 5 == 3, "Spun off and merged").otherwise(F.col("p_name"))
    return p.select((F.col("p_partkey") % 100).alias("security_id"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") * 37 % 2400).cast("int")).alias("when"), text.alias("reason_text"))


@_add(f"WITH {_REASONS} SELECT {_CLASS.format(t='reason_text')} AS category, count(*) AS n FROM reasons GROUP BY 1")
def classify_reason(spark, d):
    from pitlake.operators.identity import classify_reason as classify

    return _reasons(spark, d).groupBy(classify(F.col("reason_text")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@_add(f"""WITH {_REASONS}, ends AS (SELECT i.security_id, i.end_date AS membership_end, (SELECT max(date) FROM bars b WHERE b.security_id = i.security_id AND b.date <= i.end_date + 120) AS last_bar_date FROM intervals i WHERE end_date IS NOT NULL),
  j AS (SELECT e.*, r."when", r.reason_text, abs(r."when" - e.membership_end) AS gap FROM ends e LEFT JOIN reasons r ON r.security_id = e.security_id AND abs(r."when" - e.membership_end) <= 365),
  k AS (SELECT *, row_number() OVER (PARTITION BY security_id, membership_end ORDER BY gap, "when", reason_text) AS n FROM j)
  SELECT security_id, strftime(membership_end, '%Y-%m-%d') AS membership_end, CASE WHEN last_bar_date - membership_end > 90 THEN 'index_removal' ELSE {_CLASS.format(t="coalesce(reason_text, '')")} END AS reason_category,
         CASE CASE WHEN last_bar_date - membership_end > 90 THEN 'index_removal' ELSE {_CLASS.format(t="coalesce(reason_text, '')")} END WHEN 'bankruptcy' THEN -1.0 WHEN 'index_removal' THEN -0.02 ELSE 0.0 END::DOUBLE AS delist_return FROM k WHERE n = 1""", "bars", "intervals")
def delisting_returns(spark, d):
    iv, b = S.intervals(spark, d).where("end_date IS NOT NULL"), S.bars(spark, d).select(F.col("security_id").alias("s"), "date")
    ends = iv.join(b, (iv.security_id == b.s) & (b.date <= F.date_add("end_date", 120)), "left").groupBy("security_id", F.col("end_date").alias("membership_end")).agg(F.max("date").alias("last_bar_date"))
    out = liquidity.delisting_returns(ends, _reasons(spark, d), {"bankruptcy": -1.0, "index_removal": -0.02})
    return out.select("security_id", day("membership_end").alias("membership_end"), "reason_category", "delist_return")


@_add("""SELECT f, round(min(share), 6) AS worst, round(avg(share), 6) AS mean FROM (
  SELECT date, 'close' AS f, count(close) / count(*) AS share FROM dense GROUP BY date UNION ALL SELECT date, 'dollar_volume', count(dollar_volume) / count(*) FROM dense GROUP BY date) GROUP BY f""", "dense")
def fill_rates(spark, d):
    p = S.dense_panel(spark, d)
    per = p.groupBy("date").agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in ("close", "dollar_volume")])
    long = per.unpivot(["date"], ["close", "dollar_volume"], "f", "share")
    return long.groupBy("f").agg(r(F.min("share")).alias("worst"), r(F.avg("share")).alias("mean"))
