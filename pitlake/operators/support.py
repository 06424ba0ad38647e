"""Smaller operators over panels, curves, records and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_frame(features: DataFrame, name: str, securities: list[int]) -> DataFrame:
    """One feature as dates by securities."""
    wide = features.groupBy("date").pivot("security_id", securities).agg(F.first(name))
    return wide.select("date", *[F.col(str(s)).alias(f"s{s}") for s in securities])


def worst_year(fill: DataFrame) -> DataFrame:
    """fill (date, share): the year with the least mean, and that mean; ties to the earlier year."""
    y = fill.groupBy(F.year("date").alias("year")).agg(F.avg("share").alias("share"))
    return y.agg(F.min_by("year", F.struct("share", "year")).alias("year"), F.min("share").alias("share"))


def last_known(panel: DataFrame, column: str, name: str) -> DataFrame:
    """panel with the last value of a column at or before each session."""
    w = Window.partitionBy("security_id").orderBy("session_index").rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn(name, F.last(column, ignorenulls=True).over(w))


def trimmed(series: DataFrame, value: str) -> DataFrame:
    """Rows from the first to the last that has a value."""
    w = Window.partitionBy("run_id")
    known = F.when(F.col(value).isNotNull(), F.col("date"))
    x = series.withColumns({"_a": F.min(known).over(w), "_z": F.max(known).over(w)})
    return x.where("date >= _a AND date <= _z").drop("_a", "_z")


def slice_curve(curve: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows within dates, both included; an open bound is none."""
    out = curve if start is None else curve.where(F.col("date") >= F.lit(start).cast("date"))
    return out if end is None else out.where(F.col("date") <= F.lit(end).cast("date"))


def curve_block(curve: DataFrame) -> DataFrame:
    """run_id, date, value: month ends after an anchor at the first date, 1 there, to six places."""
    first = curve.groupBy("run_id").agg(F.min_by(F.struct("date", "nav"), "date").alias("f")).select("run_id", F.col("f.date").alias("date"), F.col("f.nav").alias("nav"))
    months = curve.groupBy("run_id", F.last_day("date").alias("m")).agg(F.max_by(F.struct("date", "nav"), "date").alias("l")).select("run_id", F.col("l.date").alias("date"), F.col("l.nav").alias("nav"))
    both = first.unionByName(months).distinct()
    return both.select("run_id", "date", F.round(F.col("nav") / F.first("nav").over(Window.partitionBy("run_id").orderBy("date")), 6).alias("value"))


def month_positions() -> dict[str, Column]:
    """Place of a session in its month, from the beginning and from the end, both from 1."""
    month = Window.partitionBy(F.trunc("date", "month"))
    return {"from_start": F.row_number().over(month.orderBy("date")), "from_end": F.row_number().over(month.orderBy(F.desc("date")))}


def generation_stats(individuals: DataFrame) -> DataFrame:
    """Per generation: size, best, mean and median fitness, and the mean deviation of genes."""
    base = individuals.groupBy("generation").agg(F.count(F.lit(1)).alias("size"), F.max("fitness").alias("best"), F.avg("fitness").alias("mean"), F.percentile("fitness", F.lit(0.5)).alias("median"))
    genes = individuals.select("generation", F.posexplode("genes").alias("g", "x")).groupBy("generation", "g").agg(F.stddev_pop("x").alias("s")).groupBy("generation").agg((F.avg("s") / 2).alias("diversity"))
    return base.join(genes, "generation")


def last_generation(individuals: DataFrame) -> DataFrame:
    """The individuals of each study's last generation."""
    top = individuals.groupBy("study").agg(F.max("generation").alias("generation"))
    return individuals.join(top, ["study", "generation"], "left_semi")


def fold_metric(curves: DataFrame, folds: DataFrame, least: int = 40) -> DataFrame:
    """run_id, fold, sharpe (daily) of the slices of curves by folds (fold, s, e) that have enough rows; folds are few."""
    x = curves.join(F.broadcast(folds), (F.col("date") >= F.col("s")) & (F.col("date") <= F.col("e")))
    w = Window.partitionBy("run_id", "fold").orderBy("date")
    r = x.withColumn("ret", F.col("nav") / F.lag("nav").over(w) - 1)
    out = r.groupBy("run_id", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("a"), F.stddev_samp("ret").alias("s_")).where(F.col("n") >= least)
    return out.select("run_id", "fold", "n", F.when(F.col("s_") > 0, F.col("a") / F.col("s_")).alias("sharpe"))


def fitness(sharpe: Column, turnover: Column, periods: Column, penalty: float, least: int = 24) -> Column:
    """Sharpe ratio less a penalty on turnover; minus infinity with too few periods."""
    return F.when((periods < least) | sharpe.isNull(), F.lit(float("-inf"))).otherwise(sharpe - penalty * F.coalesce(turnover, F.lit(0.0)))


def effective_genes(genes: Column, dead: float, most: int) -> Column:
    """Genes in the dead zone and those beyond the `most` largest are 0 (ties to the earlier gene)."""
    live = F.transform(genes, lambda g: F.when(F.abs(g) >= dead, g).otherwise(0.0))
    keyed = F.transform(live, lambda g, i: F.struct((-F.abs(g)).alias("k"), i.alias("i")))
    keep = F.transform(F.slice(F.array_sort(keyed), 1, most), lambda s: s["i"])
    return F.transform(live, lambda g, i: F.when(F.array_contains(keep, i), g).otherwise(0.0))


def clean_cell(c: Column) -> Column:
    """A table cell without footnote marks; dashes and such are null."""
    t = F.trim(F.regexp_replace(c, r"\[\w+\]", ""))
    return F.when(~F.lower(t).isin("", "-", "–", "—", "n/a", "none"), t)


def merge_factors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two factor tables by date, all dates of either."""
    return a.join(b, "date", "full_outer")


def holdings_snapshot(weights: DataFrame, limit: int = 25) -> DataFrame:
    """The largest weights of the latest date."""
    top = weights.agg(F.max("date").alias("_d"))
    return weights.crossJoin(F.broadcast(top)).where("date = _d AND weight > 0").drop("_d").orderBy(F.desc("weight"), "security_id").limit(limit)


def flatten_legs(records: DataFrame, leg: str) -> DataFrame:
    """Records with the fields of a nested leg as columns named leg_field."""
    fields = records.schema[leg].dataType.names
    return records.select(*[c for c in records.columns if c != leg], *[F.col(f"{leg}.{f}").alias(f"{leg}_{f}") for f in fields])
