"""Trading costs: commission by shares with a minimum and a cap, half spreads and a fixed rate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostModel:
    """rate a share, at least `minimum` an order and at most `most` of its value; half spread times `spread`; `bps` on top.
    An unknown half spread is `unknown`."""

    name: str
    rate: float = 0.005
    minimum: float = 1.0
    most: float = 0.01
    spread: float = 1.0
    bps: float = 0.0
    unknown: float = 0.0005


#: Named settings.
SETTINGS = {
    "free": CostModel("free", 0.0, 0.0, 0.0, 0.0),
    "optimistic": CostModel("optimistic", spread=0.0),
    "realistic": CostModel("realistic"),
    "pessimistic": CostModel("pessimistic", spread=2.0),
}


def charge(notional: Column, price: Column, half_spread: Column, m: CostModel) -> dict[str, Column]:
    """Columns commission, spread_cost, fixed, bound (which term of the commission counted) of an order."""
    value = F.abs(notional)
    shares = F.when(price > 0, value / price)
    by_share, cap = m.rate * F.coalesce(shares, F.lit(0.0)), m.most * value
    commission = F.when(value > 0, F.least(F.greatest(by_share, F.lit(m.minimum)), cap)).otherwise(0.0)
    bound = F.when(value <= 0, "none").when(F.greatest(by_share, F.lit(m.minimum)) > cap, "cap").when(by_share < m.minimum, "minimum").otherwise("rate")
    return {"commission": commission, "spread_cost": value * F.coalesce(half_spread, F.lit(m.unknown)) * m.spread, "fixed": value * m.bps / 1e4, "bound": bound}


def charge_detail(orders: DataFrame, m: CostModel) -> DataFrame:
    """orders (notional, price, half_spread) with the columns of `charge`."""
    return orders.withColumns(charge(F.col("notional"), F.col("price"), F.col("half_spread"), m))


def charge_total(orders: DataFrame, by: list[str], m: CostModel) -> DataFrame:
    """Sums of the terms, orders, and how often each bound, by group."""
    d = charge_detail(orders, m)
    return d.groupBy(*by).agg(
        F.sum("commission").alias("commission"),
        F.sum("spread_cost").alias("spread"),
        F.sum("fixed").alias("fixed"),
        F.count_if(F.col("notional") != 0).alias("orders"),
        F.count_if(F.col("bound") == "minimum").alias("at_minimum"),
        F.count_if(F.col("bound") == "cap").alias("at_cap"),
        F.count_if(F.col("half_spread").isNull() & (F.col("notional") != 0)).alias("unknown_spread"),
    )
