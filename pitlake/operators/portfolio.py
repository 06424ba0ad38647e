"""Weights from scores: eligibility, top k, scheme, cap and gross; turnover and checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.exprs import stable_key


@dataclass(frozen=True)
class Construction:
    """How scores become weights."""

    top: int | None = 50
    scheme: str = "equal"
    cap: float | None = None
    gross: float = 1.0
    min_names: int = 1

    def __post_init__(self) -> None:
        if self.scheme not in ("equal", "score", "score_rank", "inverse_vol"):
            raise ValueError(f"unknown scheme {self.scheme}")
        if self.cap is not None and not 0 < self.cap <= 1:
            raise ValueError("cap must lie in (0, 1]")
        if not 0 < self.gross <= 1:
            raise ValueError("gross must lie in (0, 1]")


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """The k best scores of each date; ties by a hash that has nothing to do with ids."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), stable_key(F.col("security_id")))
    return scores.where("score IS NOT NULL").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def raw_weights(picked: DataFrame, scheme: str, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Weights before the cap, summing to 1 per date."""
    w = Window.partitionBy(*by)
    if scheme == "equal":
        raw = F.lit(1.0)
    elif scheme == "score":
        raw = F.col("score") - F.min("score").over(w) + 1e-12
    elif scheme == "score_rank":
        raw = (F.count(F.lit(1)).over(w) - F.col("place") + 1).cast("double")
    else:
        vol = F.when(F.col("vol") > 0, F.col("vol"))
        raw = 1 / F.coalesce(vol, F.percentile(vol, F.lit(0.5)).over(w), F.lit(1.0))
    return picked.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / F.sum("_raw").over(w)).drop("_raw")


def cap_weights(weights: DataFrame, cap: float, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Weights with none above `cap`, the excess shared in proportion: the limit of repeated redistribution in closed form.

    By falling weight, the first m get the cap and the rest are scaled to what is left, for the least m for which the
    next one then stays under it. Where all at the cap do not make 1, weights are equal.
    """
    w = Window.partitionBy(*by)
    order = w.orderBy(F.desc("weight"), "security_id")
    n = F.count(F.lit(1)).over(w)
    rows = weights.withColumns({"_i": F.row_number().over(order), "_n": n, "_rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    fits = (1 - (F.col("_i") - 1) * cap) * F.col("weight") <= cap * F.col("_rest") * (1 + 1e-12)
    rows = rows.withColumn("_m", F.min(F.when(fits, F.col("_i") - 1)).over(w))
    rows = rows.withColumn("_tail", F.max(F.when(F.col("_i") == F.col("_m") + 1, F.col("_rest"))).over(w))
    capped = F.when(F.col("_n") * cap <= 1, 1.0 / F.col("_n")).when(F.col("_i") <= F.col("_m"), F.lit(cap)).otherwise(F.col("weight") * (1 - F.col("_m") * cap) / F.col("_tail"))
    return rows.withColumn("weight", capped).drop("_i", "_n", "_rest", "_m", "_tail")


def build_weights(scores: DataFrame, how: Construction, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """date, security_id, weight from (date, security_id, eligible, score[, vol][, gross]); no rows where a date has fewer
    than min_names to choose from. With by=("run", "date") the scores of many runs are done in one plan."""
    rows = scores.where("eligible AND score IS NOT NULL")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") >= how.min_names).drop("_n")
    picked = top_k(rows, how.top if how.top is not None else 1 << 30, by)
    out = raw_weights(picked, how.scheme, by)
    if how.cap is not None:
        out = cap_weights(out, how.cap, by)
    gross: Column = F.lit(how.gross) * (F.col("gross") if "gross" in scores.columns else F.lit(1.0))
    return out.select(*by, "security_id", (F.col("weight") * gross).alias("weight"))


def violations(weights: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Dates whose weights are not finite, negative, or sum to more than 1."""
    bad = F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < -tolerance)
    return weights.groupBy("date").agg(F.count_if(bad).alias("bad"), F.sum("weight").alias("total")).where((F.col("bad") > 0) | (F.col("total") > 1 + tolerance))


def untradable(weights: DataFrame, panel: DataFrame) -> DataFrame:
    """Weights on names that cannot be traded on their date: any row is a leak."""
    ok = panel.where(F.col("in_index") & F.col("close").isNotNull()).select("date", "security_id")
    return weights.where("weight > 0").join(ok, ["date", "security_id"], "left_anti")


def turnover(weights: DataFrame) -> DataFrame:
    """One-way turnover of each date against the date before, in targets; the first date trades its gross.

    Each weight counts on its own date with + and on the next with -, so no outer join is needed.
    """
    dates = weights.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))
    w = weights.join(F.broadcast(dates), "date")
    both = w.select("date", "security_id", "weight").unionByName(w.where("next IS NOT NULL").select(F.col("next").alias("date"), "security_id", (-F.col("weight")).alias("weight")))
    moved = both.groupBy("date", "security_id").agg(F.abs(F.sum("weight")).alias("d"))
    return moved.groupBy("date").agg((F.sum("d") / 2).alias("turnover"))
