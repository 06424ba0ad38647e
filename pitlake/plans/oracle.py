"""The market tables of standins.py as SQL for a reference engine: common table expressions by name."""

from __future__ import annotations

CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "cal": ((), """
        SELECT d AS date, row_number() OVER (ORDER BY d) - 1 AS session_index,
               coalesce(month(lead(d) OVER (ORDER BY d)) <> month(d) OR year(lead(d) OVER (ORDER BY d)) <> year(d), true) AS is_month_end,
               coalesce(quarter(lead(d) OVER (ORDER BY d)) <> quarter(d) OR year(lead(d) OVER (ORDER BY d)) <> year(d), true) AS is_quarter_end,
               coalesce(year(lead(d) OVER (ORDER BY d)) <> year(d), true) AS is_year_end
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) d FROM lineitem)"""),
    "bars": ((), """
        SELECT l_suppkey AS security_id, d AS date, max(CASE WHEN a = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
               max(CASE WHEN z = 1 THEN px END) AS close, sum(q) AS volume
        FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, d ORDER BY o, n, p, e, q) a,
                        row_number() OVER (PARTITION BY l_suppkey, d ORDER BY o DESC, n DESC, p DESC, e DESC, q DESC) z
              FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) d, l_extendedprice / l_quantity px, l_quantity q, l_orderkey o,
                           l_linenumber n, l_partkey p, l_extendedprice e FROM lineitem))
        GROUP BY l_suppkey, d"""),
    "ibars": (("bars", "cal"), "SELECT bars.*, session_index FROM bars JOIN cal USING (date)"),
    "actions": ((), """
        SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS date, 'dividend' AS action_type, sum(l_discount) AS value
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL
        UNION ALL SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE), 'split', 2.0 FROM lineitem WHERE l_linenumber = 7 AND l_tax >= 0.07"""),
    "snapshots": ((), """
        SELECT month, security_id FROM (
          SELECT *, row_number() OVER (PARTITION BY month ORDER BY v DESC, security_id) k, count(*) OVER (PARTITION BY month) n
          FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_suppkey AS security_id, round(sum(l_extendedprice), 2) v
                FROM lineitem GROUP BY ALL))
        WHERE 2 * k <= n"""),
    "intervals": (("snapshots",), """
        SELECT security_id, min(month) AS start_date, CASE WHEN max(m) = any_value(top) THEN NULL ELSE last_day(max(month)) END AS end_date,
               max(m) = any_value(top) AS end_is_open
        FROM (SELECT *, m - row_number() OVER (PARTITION BY security_id ORDER BY m) AS island
              FROM (SELECT *, max(m) OVER () AS top FROM (SELECT *, dense_rank() OVER (ORDER BY month) AS m FROM snapshots)))
        GROUP BY security_id, island"""),
    "facts": ((), """
        SELECT c_nationkey AS security_id, o_orderpriority AS tag, CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1 AS period_end,
               CAST(o_orderdate AS DATE) AS filed_date, o_orderkey AS accession, o_totalprice AS value
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "macro": ((), "SELECT event_type AS series_id, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY ALL"),
    "bench": ((), "SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY ALL"),
    "runs": ((), "SELECT event_id AS run_id, user_id AS study, event_type AS fingerprint, value AS sharpe, ts AS logged_at FROM events"),
    "panel": (("ibars", "intervals", "cal"), """
        SELECT b.*, EXISTS (SELECT 1 FROM intervals i WHERE i.security_id = b.security_id AND b.date >= i.start_date
                            AND (i.end_is_open OR b.date <= i.end_date)) AS in_index, cal.is_month_end
        FROM ibars b JOIN cal USING (date)"""),
    "dense": (("cal",), """
        SELECT b.*, c.session_index, c.is_month_end, (security_id + month(b.date)) % 4 <> 0 AS in_index, CAST(0.0005 * (1 + security_id % 3) AS DOUBLE) AS half_spread,
               open AS raw_open, CASE WHEN c.session_index < 800 + 100 * security_id THEN 2.0::DOUBLE ELSE 1.0 END AS cum_split,
               CASE WHEN count(close * volume) OVER w >= 10 THEN quantile_cont(close * volume, 0.5) OVER w END AS dollar_volume
        FROM (SELECT s AS security_id, d AS date, max(CASE WHEN a = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
                     max(CASE WHEN z = 1 THEN px END) AS close, sum(q) AS volume
              FROM (SELECT *, row_number() OVER (PARTITION BY s, d ORDER BY o, n, p, e, q, u) a,
                              row_number() OVER (PARTITION BY s, d ORDER BY o DESC, n DESC, p DESC, e DESC, q DESC, u DESC) z
                    FROM (SELECT l_suppkey % 10 s, l_suppkey u, CAST(l_shipdate AS DATE) d, l_extendedprice / l_quantity px, l_quantity q,
                                 l_orderkey o, l_linenumber n, l_partkey p, l_extendedprice e FROM lineitem))
              GROUP BY s, d) b JOIN cal c USING (date)
        WINDOW w AS (PARTITION BY security_id ORDER BY c.session_index RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)"""),
    "rets": (("dense",), """
        SELECT d.*, m.mkt FROM (SELECT *, CASE WHEN lag(session_index) OVER w = session_index - 1 THEN close / lag(close) OVER w - 1 END AS ret,
                   CASE WHEN lag(session_index) OVER w = session_index - 1 THEN ln(open / lag(close) OVER w) END AS leg_on, ln(close / open) AS leg_id
              FROM dense WINDOW w AS (PARTITION BY security_id ORDER BY session_index)) d
        LEFT JOIN (SELECT session_index, CASE WHEN count(ret) >= 3 THEN avg(ret) END AS mkt
                   FROM (SELECT *, CASE WHEN lag(session_index) OVER w = session_index - 1 THEN close / lag(close) OVER w - 1 END AS ret
                         FROM dense WINDOW w AS (PARTITION BY security_id ORDER BY session_index)) WHERE in_index GROUP BY session_index) m USING (session_index)"""),
    "resids": (("rets",), """
        SELECT *, ret - beta * mkt AS resid FROM (
          SELECT *, CASE WHEN n >= 63 AND vm > 0 THEN (xy - x * y) / vm END AS beta,
                 CASE WHEN n >= 63 AND vm > 0 AND vr > 0 THEN greatest(least((xy - x * y) / sqrt(vm * vr), 1), -1) END AS corr,
                 CASE WHEN nr >= 63 THEN sd * sqrt(252) END AS vol_126d
          FROM (SELECT *, count(ret * mkt) OVER w AS n, avg(ret * mkt) OVER w AS xy, avg(CASE WHEN mkt IS NOT NULL THEN ret END) OVER w AS x,
                       avg(CASE WHEN ret IS NOT NULL THEN mkt END) OVER w AS y, avg(mkt * mkt) OVER w - pow(avg(mkt) OVER w, 2) AS vm,
                       avg(CASE WHEN mkt IS NOT NULL THEN ret * ret END) OVER w - pow(avg(CASE WHEN mkt IS NOT NULL THEN ret END) OVER w, 2) AS vr,
                       count(ret) OVER v AS nr, stddev_samp(ret) OVER v AS sd
                FROM rets WINDOW w AS (PARTITION BY security_id ORDER BY session_index RANGE BETWEEN 251 PRECEDING AND CURRENT ROW),
                                 v AS (PARTITION BY security_id ORDER BY session_index RANGE BETWEEN 125 PRECEDING AND CURRENT ROW)))"""),
    "curves": (("bars",), """
        SELECT run_id, date, avg(p) OVER (PARTITION BY run_id ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS nav
        FROM (SELECT security_id % 5 AS run_id, date, avg(close) AS p FROM bars GROUP BY ALL)"""),
}


def sql(query: str, *names: str) -> str:
    """query after the expressions that it names and those that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in CTE[name][0]:
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    head = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order)
    body = query.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
