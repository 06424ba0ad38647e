"""Acceptance of the engine and of strategies: what must hold whatever the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators import backtest, portfolio
from pitlake.operators.costs import CostModel

# Tolerated differences a year, and what total return is above price return.
TOTAL_RETURN_BP, INDEX_BP = 25.0, 10.0
DIVIDENDS = (0.01, 0.03)


class LookaheadError(ValueError):
    """Data from after the signal date were asked for."""


class AsOf:
    """A panel as it was known on a session: asking for a later one raises, and the rest is out of reach."""

    __slots__ = ("session", "_rows")

    def __init__(self, panel: DataFrame, session: int):
        object.__setattr__(self, "session", session)
        object.__setattr__(self, "_rows", panel.where(F.col("session_index") <= session))

    def rows(self, upto: int | None = None) -> DataFrame:
        if upto is not None and upto > self.session:
            raise LookaheadError(f"session {upto} lies after {self.session}")
        return self._rows if upto is None else self._rows.where(F.col("session_index") <= upto)

    def at(self, back: int) -> DataFrame:
        """The rows of so many sessions ago; what is not in the past is no place in it."""
        if back < 0:
            raise IndexError(f"{-back} sessions ahead")
        return self._rows.where(F.col("session_index") == self.session - back)

    def __getattr__(self, name: str):
        raise AttributeError(f"{name} is not part of what is known")


def cheats_blocked(panel: DataFrame, session: int) -> dict[str, bool]:
    """Three ways to look ahead, and whether each raises what it should."""

    def raises(error: type[Exception], cheat: Callable[[AsOf], object]) -> bool:
        try:
            cheat(AsOf(panel, session))
        except error:
            return True
        return False

    return {
        "later session": raises(LookaheadError, lambda v: v.rows(session + 1)),
        "place ahead": raises(IndexError, lambda v: v.at(-1)),
        "whole panel": raises(AttributeError, lambda v: v.panel),
    }


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two results has, with `side`: none if a computation is deterministic."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def growth_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the yearly growth of two curves (date, nav) over the dates that both have, and the gap in basis points."""
    both = a.select("date", F.col("nav").alias("x")).join(b.select("date", F.col("nav").alias("y")), "date")
    years = F.datediff(F.max("date"), F.min("date")) / 365.25

    def cagr(c: str):
        return F.pow(F.max_by(c, "date") / F.min_by(c, "date"), 1 / years) - 1

    return both.agg(cagr("x").alias("first"), cagr("y").alias("second")).withColumn("gap_bp", (F.col("first") - F.col("second")) * 1e4)


def calibrated(own: DataFrame, known: DataFrame, bp: float = TOTAL_RETURN_BP) -> DataFrame:
    """Whether a total-return curve is within so many basis points a year of a known one."""
    return growth_gap(own, known).withColumn("ok", F.abs("gap_bp") <= bp)


def dividends_in_band(total: DataFrame, price: DataFrame, lo: float = DIVIDENDS[0], hi: float = DIVIDENDS[1]) -> DataFrame:
    """Whether total return is above price return by what dividends can be."""
    return growth_gap(total, price).withColumn("ok", F.col("gap_bp").between(lo * 1e4, hi * 1e4))


def index_reproduced(growth: DataFrame, reference: DataFrame, years: float, bp: float = INDEX_BP) -> DataFrame:
    """Growth by period of the engine against that of an index computed apart: the gap a year, and whether it is small."""
    both = growth.select("period", F.col("growth").alias("x")).join(reference.select("period", F.col("growth").alias("y")), "period")
    out = both.agg(F.exp(F.sum(F.log("x"))).alias("x"), F.exp(F.sum(F.log("y"))).alias("y"), F.count(F.lit(1)).alias("periods"))
    gap = (F.pow("x", F.lit(1 / years)) - F.pow("y", F.lit(1 / years))) * 1e4
    return out.select("periods", gap.alias("gap_bp"), (F.abs(gap) <= bp).alias("ok"))


def contract(weights: DataFrame, panel: DataFrame, schedule: DataFrame, model: CostModel, free: CostModel, capital: float = 100_000.0) -> DataFrame:
    """A row per run, with what a portfolio must be: weights that are finite, not negative and no more than the whole, tradable
    names only, values above 0, costs that take and never give, turnover from 0 to 1, and books that balance; and `ok`."""
    events = backtest.run_settings(weights, panel, schedule, {"net": model, "gross": free}, capital)
    done = backtest.rebalances(events).withColumns({"name": F.substring_index("run", "|", 1), "side": F.substring_index("run", "|", -1)})
    value = done.groupBy("name").agg(
        F.min("nav").alias("low"),
        F.max_by(F.when(F.col("side") == "net", F.col("nav")), F.when(F.col("side") == "net", F.col("period"))).alias("net"),
        F.max_by(F.when(F.col("side") == "gross", F.col("nav")), F.when(F.col("side") == "gross", F.col("period"))).alias("gross"),
        F.max(F.col("traded") / 2 / F.col("nav")).alias("most_turnover"),
    )
    books = backtest.reconcile(events, capital).groupBy(F.substring_index("run", "|", 1).alias("name")).agg(F.min("ok").alias("books"))
    sums = weights.groupBy("run", "date").agg(F.sum("weight").alias("s"), F.min("weight").alias("m"), F.max(F.isnan("weight") | F.col("weight").isNull()).alias("odd"))
    shape = sums.groupBy(F.col("run").alias("name")).agg(F.max("s").alias("most"), F.min("m").alias("least"), F.max("odd").alias("odd"))
    alien = portfolio.untradable(weights, panel).groupBy(F.col("run").alias("name")).agg(F.count(F.lit(1)).alias("untradable"))
    x = shape.join(value, "name", "left").join(books, "name", "left").join(alien, "name", "left").fillna(0, ["untradable"])
    rules = {
        "finite": ~F.col("odd"), "not_negative": F.col("least") >= -1e-12, "no_leverage": F.col("most") <= 1 + 1e-9, "tradable": F.col("untradable") == 0, "solvent": F.col("low") > 0,
        "costs_take": F.col("net") <= F.col("gross") * (1 + 1e-9), "turnover_in_range": F.col("most_turnover").between(0, 1 + 1e-9), "balanced": F.col("books"),
    }
    out = x.select(F.col("name").alias("run"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()])
    ok = F.lit(True)
    for n in rules:
        ok = ok & F.col(n)
    return out.withColumn("ok", ok)


def stages(steps: dict[str, Callable[[], DataFrame]], order: list[str] | None = None) -> list[tuple[str, str, int]]:
    """A health check in stages: (name, verdict, findings). A stage passes without a finding of severity ERROR; one that
    raises has failed; after a failure the later ones are skipped."""
    out, broken = [], False
    for name in order or list(steps):
        if broken:
            out.append((name, "skipped", 0))
            continue
        try:
            found = steps[name]()
            n = found.where("severity = 'ERROR'").count()
        except Exception as e:  # noqa: BLE001 - whatever a stage raises
            out.append((name, f"failed: {type(e).__name__}", 0))
            broken = True
            continue
        out.append((name, "ok" if not n else "failed", n))
        broken = n > 0
    return out
