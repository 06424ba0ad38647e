"""Monthly backtests: signals at a close, fills at the next open, costs, forced exits and the daily value.

Holdings after a trade depend on prices and targets, so all per-name work is done set-wise for all runs at once; only
the value of a run, whose costs are not linear in it, is a fold, one group per run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators.costs import CostModel


def rebalance_schedule(calendar: DataFrame, start: str, end: str | None = None, warmup: int = 0) -> DataFrame:
    """period, date, session_index, exec (the next session), until (the next period's exec, or the last session + 1)."""
    w = Window.orderBy("session_index")
    last = calendar.agg(F.max("session_index").alias("_last"))
    days = calendar.where("is_month_end").crossJoin(F.broadcast(last)).where((F.col("session_index") < F.col("_last")) & (F.col("session_index") >= warmup) & (F.col("date") >= F.lit(start).cast("date")))
    if end is not None:
        days = days.where(F.col("date") <= F.lit(end).cast("date"))
    days = days.withColumns({"period": F.row_number().over(w) - 1, "exec": F.col("session_index") + 1})
    return days.select("period", "date", "session_index", "exec", F.coalesce(F.lead("exec").over(w), F.col("_last") + 1).alias("until"))


def period_prices(panel: DataFrame, schedule: DataFrame, delistings: DataFrame | None = None) -> DataFrame:
    """A row per security and period: the open at the fill (`fill`; null: no bar), the price then in the money of the day
    (`traded`: raw_open * cum_split where panel has them), half spread, the open at the next fill, the last close, and
    where the series breaks before that: the last session with a bar, its close and traded price, what a holder gets
    (`factor`) and why (`reason`: price_gap if bars resume, else that of delistings or unresolved).

    The panel is read once, by security; the schedule and its sessions are as long as the calendar.
    """
    last = schedule.agg((F.max("until") - 1).alias("_last"))
    days = schedule.crossJoin(F.broadcast(last)).select("period", "exec", "until", "_last", F.explode(F.sequence("exec", F.col("until") - 1)).alias("session_index"))
    whole = {"raw_open", "cum_split"} <= set(panel.columns)
    bars = panel.select(
        "security_id", "session_index", "open", "close", "half_spread", (F.col("raw_open") * F.col("cum_split") if whole else F.col("open")).alias("traded"),
        F.lead("session_index").over(Window.partitionBy("security_id").orderBy("session_index")).alias("_next"),
    )
    at_fill = F.col("session_index") == F.col("exec")
    broken = (F.col("session_index") < F.least("until", "_last")) & (F.coalesce("_next", F.lit(-1)) != F.col("session_index") + 1)
    found = (
        bars.join(F.broadcast(days), "session_index")
        .groupBy("security_id", "period")
        .agg(
            F.max(F.when(at_fill, F.col("open"))).alias("fill"),
            F.max(F.when(at_fill, F.col("traded"))).alias("traded"),
            F.max(F.when(at_fill, F.col("half_spread"))).alias("hs"),
            F.max_by("close", "session_index").alias("last_close"),
            F.min(F.when(broken, F.struct("session_index", "close", "traded", F.col("_next").isNotNull().alias("resumes")))).alias("b"),
        )
    )
    w = Window.partitionBy("security_id").orderBy("period")
    next_ = F.lead(F.struct("period", "fill")).over(w)
    found = found.withColumn("_n", next_).withColumn("next_fill", F.when(F.col("_n.period") == F.col("period") + 1, F.col("_n.fill"))).drop("_n")
    ends = panel.sparkSession.createDataFrame([], "security_id long, delist_return double, reason string") if delistings is None else delistings.select("security_id", "delist_return", "reason")
    gap = F.col("b.resumes")
    return found.join(ends, "security_id", "left").select(
        "security_id", "period", "fill", "traded", "hs", "next_fill", "last_close",
        F.col("b.session_index").alias("break_at"), F.col("b.close").alias("break_close"), F.col("b.traded").alias("break_traded"),
        F.when(gap, 1.0).otherwise(1 + F.coalesce("delist_return", F.lit(0.0))).alias("factor"),
        F.when(F.col("b").isNull(), None).when(gap, "price_gap").otherwise(F.coalesce("reason", F.lit("unresolved"))).alias("reason"),
    )


def dated_weights(weights: DataFrame, panel: DataFrame, schedule: DataFrame, delistings: DataFrame | None = None) -> DataFrame:
    """Weights with a closing row for each name that was held before, and the prices of their periods."""
    dated = with_closing_rows(weights, schedule).join(F.broadcast(schedule.select("date", "period", "exec", "until")), "date").drop("date")
    return dated.join(period_prices(panel, schedule, delistings), ["security_id", "period"], "left")


EVENTS = (
    "run string, period int, block int, kind string, session int, security_id long, side string, status string, reason string, shares double, price double, notional double, commission double, "
    "spread double, fixed double, cash_flow double, adj_shares double, adj_price double, weight_before double, weight_after double, nav double, cash double, until int"
)
_NAMES = [f.split()[0] for f in EVENTS.split(", ")]


def _charges(m: CostModel, notional: np.ndarray, price: np.ndarray, hs: np.ndarray) -> np.ndarray:
    """Commission, spread and fixed cost of orders, a row each."""
    shares = np.divide(notional, price, out=np.zeros_like(notional), where=price > 0)
    commission = np.where(notional > 0, np.minimum(np.maximum(m.rate * shares, m.minimum), m.most * notional), 0.0)
    return np.stack([commission, notional * np.where(np.isnan(hs), m.unknown, hs) * m.spread, notional * m.bps / 1e4])


def _fold(capital: float, models: dict[str, CostModel]):
    def trade(m: CostModel, now: pd.DataFrame, held: dict[int, float], cash: float) -> tuple:
        """What the orders of one fill are, and what they cost: costs come out of what is invested, so they are found twice."""
        fill, hs, traded, weight = (now[c].to_numpy(float) for c in ("fill", "hs", "traded", "weight"))
        open_ = np.isfinite(fill) & (fill > 0)
        before = np.array([held.get(i, 0.0) for i in now["security_id"]]) * np.where(open_, fill, 0.0)
        nav = cash + before.sum()
        aim = np.where(open_, weight, 0.0)
        after = aim * nav
        for _ in range(2):
            cost = _charges(m, np.abs(after - before), traded, hs)
            after = aim * (nav - cost.sum())
        return fill, traded, weight, open_, before, nav, after, cost

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["run"].iloc[0]
        m = models.get(name.rpartition("|")[2]) or models[""]
        cash, held, block, out = capital, {}, 0, []
        rows = rows.sort_values(["period", "security_id"])
        for period, now in rows.groupby("period", sort=True):
            at, until = int(now["exec"].iloc[0]), int(now["until"].iloc[0])
            fill, traded, weight, open_, before, nav, after, cost = trade(m, now, held, cash)

            def event(kind: str, k: int | None, period: int = int(period), now: pd.DataFrame = now, **values: object) -> None:
                ids = {"security_id": None if k is None else int(now["security_id"].iat[k])}
                out.append({"run": name, "period": period, "block": block, "kind": kind} | ids | values)

            block += 1
            if nav <= 0:
                event("period", None, session=at, until=until, nav=0.0, cash=0.0, reason="ruin")
                break
            delta, each = after - before, cost.sum(axis=0)
            for k in np.flatnonzero((delta != 0) | (each > 0)).tolist():
                event(
                    "order", k, session=at, side="buy" if delta[k] > 0 else "sell", status="filled", reason="rebalance", shares=abs(delta[k]) / traded[k], price=traded[k], notional=abs(delta[k]),
                    commission=cost[0, k], spread=cost[1, k], fixed=cost[2, k], cash_flow=-delta[k] - each[k], adj_shares=delta[k] / fill[k], adj_price=fill[k],
                    weight_before=before[k] / nav, weight_after=after[k] / nav, nav=nav,
                )
            for k in np.flatnonzero(~open_ & (weight != 0)).tolist():
                event("unfilled", k, session=at, side="buy", status="unfilled", reason="no_opening_bar", notional=abs(weight[k] * nav), cash_flow=0.0, weight_before=0.0, weight_after=0.0, nav=nav)
            cash = nav - after.sum() - each.sum()
            event("period", None, session=at, until=until, nav=nav, cash=cash, notional=float(np.abs(delta).sum()), commission=cost[0].sum(), spread=cost[1].sum(), fixed=cost[2].sum(), shares=float((after != 0).sum()))
            held, broken = {}, []
            end, close, factor, money = (now[c].to_numpy(float) for c in ("break_at", "break_close", "factor", "break_traded"))
            for k in np.flatnonzero(after != 0).tolist():
                own = after[k] / fill[k]
                stays = not np.isfinite(end[k])
                event("position", k, session=at, until=until - 1 if stays else int(end[k]), adj_shares=own, adj_price=fill[k], weight_after=after[k] / nav)
                if stays:
                    held[int(now["security_id"].iat[k])] = own
                else:
                    broken.append((int(end[k]), k, own))
            for session, k, own in sorted(broken):
                block += 1
                value = own * close[k]
                shares = abs(value) / money[k] if money[k] > 0 else None
                event("exit", k, session=session, side="sell", status="filled", reason="exit:" + now["reason"].iat[k], shares=shares, price=money[k], notional=abs(value), commission=0.0, spread=0.0, fixed=0.0, cash_flow=value * factor[k], adj_shares=-own, adj_price=close[k], weight_after=0.0)
                cash += value * factor[k]
        return pd.DataFrame(out, columns=_NAMES)

    return run


def run_backtest(weights: DataFrame, panel: DataFrame, schedule: DataFrame, m: CostModel, capital: float = 100_000.0, delistings: DataFrame | None = None) -> DataFrame:
    """Everything that happens in each run, as EVENTS: orders, unfilled orders, forced exits, positions after each fill, and a
    row per period with its value before the trade and its cash and costs after it.

    weights has run, date, security_id, weight; panel has open, close and half_spread by session, and raw_open and
    cum_split if prices are adjusted for splits. Fills are at the open after a signal. A name without a bar then is not bought, and
    what is meant for it stays cash. A name whose bars break off, or pause, before the next fill is sold at its last close,
    times 1 + its delist_return if they do not resume. Shares and per-share commissions are in the money of the day.
    """
    rows = dated_weights(weights, panel, schedule, delistings)
    return rows.groupBy("run").applyInPandas(_fold(capital, {"": m}), EVENTS)


def run_settings(weights: DataFrame, panel: DataFrame, schedule: DataFrame, models: dict[str, CostModel], capital: float = 100_000.0, delistings: DataFrame | None = None) -> DataFrame:
    """The events of each run under each cost model, as run "name|model": prices are joined once for all, and each run is
    a fold of its own, so runs are as parallel as there are of them. With the model "free" among them it is the
    gross mirror of the others."""
    rows = dated_weights(weights, panel, schedule, delistings).withColumn("_m", F.explode(F.array(*[F.lit(k) for k in models])))
    rows = rows.withColumn("run", F.concat("run", F.lit("|"), "_m")).drop("_m")
    return rows.groupBy("run").applyInPandas(_fold(capital, models), EVENTS)


def with_closing_rows(weights: DataFrame, schedule: DataFrame) -> DataFrame:
    """weights with a zero row at the next rebalance for each name that has no weight then."""
    next_ = schedule.select("date", F.lead("date").over(Window.orderBy("date")).alias("next"))
    zeros = weights.where("weight > 0").join(F.broadcast(next_), "date").where("next IS NOT NULL").select("run", F.col("next").alias("date"), "security_id", F.lit(0.0).alias("weight"))
    return weights.unionByName(zeros).groupBy("run", "date", "security_id").agg(F.sum("weight").alias("weight"))


def free_growth(weights: DataFrame, panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """run, period, growth of a run without costs: no fold, since growth does not depend on value."""
    rows = dated_weights(weights, panel, schedule).where("weight <> 0")
    end = F.when(F.col("break_at").isNotNull(), F.col("break_close") * F.col("factor")).otherwise(F.coalesce("next_fill", "last_close"))
    own = F.when(F.col("fill").isNotNull(), F.col("weight") * (end / F.col("fill") - 1)).otherwise(0.0)
    return rows.groupBy("run", "period").agg((1 + F.sum(own)).alias("growth"))


def positions(events: DataFrame) -> DataFrame:
    """What is held after each fill: run, period, security_id, session, until (last session held), shares, price (adjusted), weight."""
    return events.where("kind = 'position'").select("run", "period", "security_id", "session", "until", F.col("adj_shares").alias("shares"), F.col("adj_price").alias("price"), F.col("weight_after").alias("weight"))


def rebalances(events: DataFrame) -> DataFrame:
    """run, period, session, until, nav before the trade, cash and cost after it, positions."""
    cost = F.col("commission") + F.col("spread") + F.col("fixed")
    return events.where("kind = 'period'").select("run", "period", "session", "until", "nav", "cash", F.col("notional").alias("traded"), cost.alias("cost"), F.col("shares").cast("int").alias("positions"))


def daily_value(events: DataFrame, panel: DataFrame) -> DataFrame:
    """run, session_index, nav at each close: positions at their closes, cash, and from the session after an exit what it
    brought. A position is priced on every session that it is held."""
    held = positions(events).select("run", "period", "security_id", "shares", F.explode(F.sequence("session", "until")).alias("session_index"))
    priced = held.join(panel.select("security_id", "session_index", "close"), ["security_id", "session_index"])
    stocks = priced.select("run", "session_index", (F.col("shares") * F.col("close")).alias("v"))
    cash = rebalances(events).select("run", F.explode(F.sequence("session", F.col("until") - 1)).alias("session_index"), F.col("cash").alias("v"))
    out = events.where("kind = 'exit'").join(rebalances(events).select("run", "period", F.col("until").alias("end")), ["run", "period"])
    out = out.where("session < end - 1").select("run", F.explode(F.sequence(F.col("session") + 1, F.col("end") - 1)).alias("session_index"), F.col("cash_flow").alias("v"))
    return stocks.unionByName(cash).unionByName(out).groupBy("run", "session_index").agg(F.sum("v").alias("nav"))


def ledger(events: DataFrame) -> DataFrame:
    """Orders, unfilled ones and exits, in the order of trading: run, block, period, session, security_id, side, status, reason,
    shares and price in the money of the day, notional, commission, spread, cost, cash_flow, adjusted shares and price,
    weights before and after, nav."""
    cost = F.coalesce(F.col("commission") + F.col("spread") + F.col("fixed"), F.lit(0.0))
    return events.where("kind IN ('order', 'unfilled', 'exit')").select(
        "run", "block", "period", "session", "security_id", "side", "status", "reason", "shares", "price", "notional", "commission", "spread", cost.alias("cost"), "cash_flow",
        "adj_shares", "adj_price", "weight_before", "weight_after", "nav",
    )


def in_order(orders: DataFrame) -> DataFrame:
    """The ledger sorted as it is kept: by run, session, block, side and name."""
    return orders.orderBy("run", "session", "block", "side", "security_id")


def ledger_between(orders: DataFrame, schedule: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Orders whose signal was given from start to end; a fill just after the end belongs to it."""
    kept = orders.join(F.broadcast(schedule.select("period", F.col("date").alias("signal_date"))), "period")
    for bound, ok in ((start, lambda b: F.col("signal_date") >= b), (end, lambda b: F.col("signal_date") <= b)):
        if bound is not None:
            kept = kept.where(ok(F.lit(bound).cast("date")))
    return kept


def last_orders(orders: DataFrame, k: int = 40) -> DataFrame:
    """The latest orders of each run."""
    w = Window.partitionBy("run").orderBy(F.desc("session"), F.desc("block"), "side", "security_id")
    return orders.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def ledger_summary(orders: DataFrame, year) -> DataFrame:
    """Per run and year: orders, buys, sells, names, notional, cost and cost in bp of it."""
    return orders.groupBy("run", year.alias("year")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"),
        F.countDistinct("security_id").alias("names"), F.sum("notional").alias("notional"), F.sum("cost").alias("cost"), (F.sum("cost") / F.sum("notional") * 1e4).alias("cost_bp"),
    )


def most_traded(orders: DataFrame, k: int = 20) -> DataFrame:
    """The names with the most money traded, with orders and cost."""
    return orders.groupBy("security_id").agg(F.sum("notional").alias("notional"), F.count(F.lit(1)).alias("orders"), F.sum("cost").alias("cost")).orderBy(F.desc("notional"), "security_id").limit(k)


def reconcile(events: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """The audit of each run: what orders cost against what was charged, orders that were priced but are not filled rows, and the
    largest gap between the cash account replayed from the orders' and exits' flows and the cash that the run says it has.

    A period is replayed from the cash of the one before. A gap may have a cent, or what sums of doubles lose: 1e-12 of
    the money that moved (`worst_part` is the largest gap as a part of it), which is more than a cent from 1e10 on.
    """
    is_order, is_exit = F.col("kind") == "order", F.col("kind") == "exit"
    flow = events.where("kind IN ('order', 'exit')").groupBy("run", "period").agg(
        F.sum(F.when(is_order, F.col("cash_flow"))).alias("orders_flow"),
        F.sum(F.when(is_exit, F.col("cash_flow"))).alias("exits_flow"),
        F.sum(F.when(is_order, F.abs("cash_flow"))).alias("orders_moved"),
        F.sum(F.when(is_exit, F.abs("cash_flow"))).alias("exits_moved"),
        F.sum(F.col("commission") + F.col("spread") + F.col("fixed")).alias("paid"),
        F.count_if(is_order).alias("orders"),
        F.count_if(is_order & F.col("shares").isNull()).alias("without_shares"),
    )
    own = rebalances(events).join(flow, ["run", "period"], "left").fillna(0.0)
    w = Window.partitionBy("run").orderBy("period")
    before = F.lag("cash", 1, capital).over(w)
    replayed = before + F.lag("exits_flow", 1, 0.0).over(w) + F.col("orders_flow")
    moved = F.abs(before) + F.lag("exits_moved", 1, 0.0).over(w) + F.col("orders_moved") + F.abs("cash")
    gaps = own.withColumns({"gap": F.abs(replayed - F.col("cash")), "moved": moved})
    out = gaps.groupBy("run").agg(
        F.sum("orders").alias("orders"), F.sum("paid").alias("paid"), F.sum("cost").alias("charged"), F.max("gap").alias("worst_gap"),
        F.max(F.when(F.col("moved") > 0, F.col("gap") / F.col("moved")).otherwise(0.0)).alias("worst_part"), F.sum("without_shares").alias("without_shares"),
        F.bool_and(F.col("gap") < F.greatest(F.lit(0.01), 1e-12 * F.col("moved"))).alias("cash_ok"),
    )
    paid_ok = F.abs(F.col("paid") - F.col("charged")) <= F.greatest(F.lit(1e-6), 1e-9 * F.col("charged"))
    return out.withColumn("ok", paid_ok & F.col("cash_ok") & (F.col("without_shares") == 0)).drop("cash_ok")


def exits(events: DataFrame) -> DataFrame:
    """Forced exits by reason: how many, and what they brought."""
    return events.where("kind = 'exit'").groupBy("run", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("cash_flow").alias("proceeds"))


def equal_weight_reference(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Growth of an equal-weight index of the tradable names by period: the mean ratio of fills, nothing shared with the fold."""
    names = panel.where("in_index AND is_month_end").join(F.broadcast(schedule.select("session_index", "period", "exec", "until")), "session_index")
    fill = panel.select("security_id", F.col("session_index").alias("exec"), F.col("open").alias("a"))
    out = panel.select("security_id", F.col("session_index").alias("until"), F.col("open").alias("b"))
    both = names.select("security_id", "period", "exec", "until").join(fill, ["security_id", "exec"]).join(out, ["security_id", "until"])
    return both.groupBy("period").agg(F.avg(F.col("b") / F.col("a")).alias("growth"), F.count(F.lit(1)).alias("names"))
