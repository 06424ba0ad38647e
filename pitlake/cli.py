"""Command line over a lake folder: python -m pitlake.cli ROOT COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from pitlake.operators import adjust, backtest, catalog, costs, identity, liquidity, panel, pit, portfolio, price_features, quality, signals
from pitlake.sources.lake import Lake


def session() -> SparkSession:
    """A session with UTC time and adaptive plans; what the submitter sets stays."""
    b = SparkSession.builder.appName("pitlake").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return b.getOrCreate()


def adjusted(lake: Lake) -> DataFrame:
    """The adjusted bars: from the lake if they were written, else derived."""
    if lake.exists("silver", "daily_bars_adjusted"):
        return lake.read("silver", "daily_bars_adjusted")
    bars = lake.read("silver", "daily_bars")
    return adjust.apply_factors(bars, adjust.compute_factors(bars, lake.read("silver", "corporate_actions")))


def build_panel(lake: Lake) -> DataFrame:
    bars = adjusted(lake)
    cal = lake.read("silver", "trading_calendar") if lake.exists("silver", "trading_calendar") else identity.derive_calendar(bars.select("date"))
    p = panel.build(bars, lake.read("silver", "membership_intervals"), cal)
    spread = liquidity.half_spread(p).select("security_id", "date", "half_spread")
    return p.join(spread, ["security_id", "date"], "left")


def features(lake: Lake) -> DataFrame:
    return price_features.price_features(build_panel(lake))


def run_strategy(lake: Lake, name: str, setting: str, start: str, top: int) -> DataFrame:
    """Value after each rebalance of a strategy."""
    p = build_panel(lake)
    x = price_features.price_features(p).where("is_month_end")
    x = x.withColumn("eligible", x["in_index"])
    w = portfolio.build_weights(signals.REGISTRY[name](x), portfolio.Construction(top=top))
    sched = backtest.rebalance_schedule(identity.derive_calendar(p.select("date")), start)
    w = w.selectExpr(f"'{name}' AS run", "date", "security_id", "weight")
    return backtest.rebalances(backtest.run_backtest(w, p, sched, costs.SETTINGS[setting])).select("run", "period", "nav").orderBy("period")


def battery(spark: SparkSession, lake: Lake) -> DataFrame:
    bars, cal, iv, acts = (lambda n=n: lake.read("silver", n) for n in ("daily_bars", "trading_calendar", "membership_intervals", "corporate_actions"))
    return quality.run(
        spark,
        {
            "bar_integrity": lambda: quality.bar_integrity(bars()),
            "primary_key": lambda: quality.primary_key(bars(), ["security_id", "date"], "daily_bars"),
            "stale_prices": lambda: quality.stale_prices(bars()),
            "extreme_moves": lambda: quality.extreme_moves(bars(), acts()),
            "calendar_gaps": lambda: quality.calendar_gaps(bars(), cal()),
            "off_calendar": lambda: quality.off_calendar(bars(), cal()),
            "trading_calendar": lambda: quality.trading_calendar(cal()),
            "membership_intervals": lambda: quality.membership(iv()),
            "corporate_actions": lambda: quality.corporate_actions(acts(), bars()),
        },
    )


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="pitlake")
    p.add_argument("root", help="lake folder")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("status", help="views and their rows")
    sub.add_parser("verify", help="artifacts against their checksums")
    sub.add_parser("quality", help="all checks")
    sub.add_parser("normalize", help="write adjusted bars")
    sub.add_parser("features", help="write month-end price features")
    sub.add_parser("catalog", help="features and their meaning")
    q = sub.add_parser("query", help="SQL over the views")
    q.add_argument("sql")
    q.add_argument("--limit", type=int, default=50)
    u = sub.add_parser("universe", help="members on a date")
    u.add_argument("date")
    f = sub.add_parser("fundamentals", help="facts as known on a date")
    f.add_argument("date")
    b = sub.add_parser("backtest", help="run a strategy")
    b.add_argument("strategy", choices=sorted(signals.REGISTRY))
    b.add_argument("--costs", default="realistic", choices=sorted(costs.SETTINGS))
    b.add_argument("--start", default="2000-01-01")
    b.add_argument("--top", type=int, default=50)
    a = p.parse_args(args)
    spark = session()
    lake = Lake(spark, a.root)
    if a.command == "normalize":
        print(lake.write(adjusted(lake), "silver", "daily_bars_adjusted"))
        return
    if a.command == "features":
        print(lake.write(features(lake).where("is_month_end"), "gold", "features"))
        return
    out = {
        "status": lambda: lake.catalog(),
        "verify": lambda: lake.verify(),
        "quality": lambda: battery(spark, lake),
        "catalog": lambda: catalog.describe(spark),
        "query": lambda: lake.query(a.sql, a.limit),
        "universe": lambda: pit.universe_asof(lake.read("silver", "membership_intervals"), a.date),
        "fundamentals": lambda: pit.latest_visible(lake.read("silver", "xbrl_facts"), a.date),
        "backtest": lambda: run_strategy(lake, a.strategy, a.costs, a.start, a.top),
    }[a.command]()
    out.show(getattr(a, "limit", 100), truncate=False)


if __name__ == "__main__":
    main()
