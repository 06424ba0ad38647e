"""The registry of runs, forward tests and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.exprs import norm_cdf_sql


def fingerprint(*fields: str) -> Column:
    """A short hash of a configuration: fields in the order of their names, as JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)])), 256), 1, 16)


def studies(runs: DataFrame) -> DataFrame:
    """Per study: runs, distinct trials, best run and Sharpe ratio, first and last time."""
    top = F.struct("sharpe", F.negative("run_id").alias("k"))
    out = runs.groupBy("study").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("fingerprint").alias("trials"), F.max(top).alias("_b"), F.min("logged_at").alias("first_at"), F.max("logged_at").alias("last_at"))
    return out.select("study", "runs", "trials", (-F.col("_b.k")).alias("best_run"), F.col("_b.sharpe").alias("best_sharpe"), "first_at", "last_at")


def best(runs: DataFrame, by: str = "sharpe") -> DataFrame:
    """The best run of each study; ties to the smallest run_id."""
    w = Window.partitionBy("study").orderBy(F.desc_nulls_last(by), "run_id")
    return runs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_trials(runs: DataFrame) -> DataFrame:
    """The first run of each fingerprint in a study: repeats are no trials."""
    w = Window.partitionBy("study", "fingerprint").orderBy("logged_at", "run_id")
    return runs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def trial_sd(runs: DataFrame) -> DataFrame:
    """study, trials, trial_sd: deviation of the Sharpe ratios of distinct trials."""
    return first_trials(runs).groupBy("study").agg(F.count(F.lit(1)).alias("trials"), F.stddev_samp("sharpe").alias("trial_sd"))


def latest_lines(lines: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of lines with one key the last: later records supersede."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return lines.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def earliest_lines(lines: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of lines with one key the first: a seal binds from the beginning."""
    w = Window.partitionBy(*key).orderBy(*order)
    return lines.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def look_number(records: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """records with look: how often the key has been looked at up to then."""
    return records.withColumn("look", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def apply_holdout(windows: DataFrame, mode: str, boundary: str = "2022-01-01") -> DataFrame:
    """windows (start, end) kept out of the holdout (exclude), within it (only), or as they are (include), with touches."""
    b = F.lit(boundary).cast("date")
    if mode == "exclude":
        return windows.withColumns({"end": F.least("end", F.date_sub(b, 1)), "touches": F.lit(False)})
    if mode == "only":
        return windows.withColumns({"start": F.greatest("start", b), "touches": F.lit(True)})
    if mode != "include":
        raise ValueError(f"unknown mode {mode}")
    return windows.withColumn("touches", F.col("end") >= b)


def month_ends_between(start: Column, end: Column) -> Column:
    """Calendar month ends from start to end, both included."""
    first = F.last_day(start)
    n = (F.year(end) - F.year(first)) * 12 + F.month(end) - F.month(first) + F.when(end == F.last_day(end), 1).otherwise(0)
    return F.greatest(n, F.lit(0)).cast("int")


def compare(pairs: DataFrame) -> DataFrame:
    """Research against forward (columns sharpe, se with _r and _f, n_f): decay, z of the difference, p, and a verdict."""
    z = (F.col("sharpe_f") - F.col("sharpe_r")) / F.sqrt(F.col("se_r") * F.col("se_r") + F.col("se_f") * F.col("se_f"))
    x = pairs.withColumns({"decay": F.when(F.col("sharpe_r") != 0, 1 - F.col("sharpe_f") / F.col("sharpe_r")), "z": z})
    x = x.withColumn("p", F.expr(norm_cdf_sql("z")))
    verdict = F.when(F.col("n_f") < 12, "inconclusive").when(F.col("sharpe_f") <= 0, "failed").when(F.col("p") < 0.05, "decayed").otherwise("held")
    return x.withColumn("verdict", verdict)


def stitched(curves: DataFrame, key: str = "forward_id") -> DataFrame:
    """Curves of successive windows as one: of dates in two windows the earlier window's value stays."""
    return earliest_lines(curves, [key, "date"], ["window"])


def rank_agreement(rows: DataFrame, a: str, b: str, top: int = 5) -> DataFrame:
    """Spearman correlation (ties averaged) and how many of the top names agree."""
    n = F.count(F.lit(1)).over(Window.partitionBy())

    def ranked(c: str) -> Column:
        return F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2

    x = rows.withColumns({"_ra": ranked(a), "_rb": ranked(b), "_n": n, "_ta": F.row_number().over(Window.orderBy(F.desc(a), "run_id")), "_tb": F.row_number().over(Window.orderBy(F.desc(b), "run_id"))})
    return x.agg(F.corr("_ra", "_rb").alias("spearman"), F.count_if((F.col("_ta") <= top) & (F.col("_tb") <= top)).alias("overlap"))


def unpack_curves(lines: DataFrame) -> DataFrame:
    """Lines with parallel arrays dates and navs as rows; a later line of a run supersedes."""
    last = latest_lines(lines, ["run_id"], ["line"])
    return last.select("run_id", F.explode(F.arrays_zip("dates", "navs")).alias("x")).select("run_id", F.col("x.dates").alias("date"), F.col("x.navs").alias("nav"))


def usage(genomes: DataFrame, dead: float = 0.05) -> DataFrame:
    """How many genomes of a population use each gene (beyond the dead zone)."""
    return genomes.select(F.posexplode("genes").alias("gene", "w")).where(F.abs("w") >= dead).groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_weight"))


def sharpe_band(sharpe: Column, months: Column, skew: Column, kurt: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Interval of an annualised Sharpe ratio known from so many months."""
    m = sharpe / F.sqrt(F.lit(12.0))
    se = F.sqrt(F.greatest(1 - skew * m + (kurt - 1) / 4 * m * m, F.lit(0.0)) / (months - 1))
    return (m - z * se) * F.sqrt(F.lit(12.0)), (m + z * se) * F.sqrt(F.lit(12.0))


def detectable_gap(months: Column, sharpe: Column, z: float = 1.959963984540054) -> Column:
    """The least difference of annualised Sharpe ratios that so many months can tell."""
    m = sharpe / F.sqrt(F.lit(12.0))
    return z * F.sqrt(F.lit(2.0)) * F.sqrt((1 + m * m / 2) / (months - 1)) * F.sqrt(F.lit(12.0))


def freshness(windows: DataFrame, seen: str) -> DataFrame:
    """windows (start, end) with fresh_start: the first day after what was seen before, null if nothing is fresh."""
    after = F.greatest(F.col("start"), F.date_add(F.lit(seen).cast("date"), 1))
    return windows.withColumn("fresh_start", F.when(after <= F.col("end"), after))


def previous_end(records: DataFrame, key: list[str]) -> DataFrame:
    """records with prev_end: the latest data_end of the key's earlier records."""
    w = Window.partitionBy(*key).orderBy("logged_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("prev_end", F.max("data_end").over(w))


def selection_bar(records: DataFrame, expected: Column) -> DataFrame:
    """trials (distinct seals), their deviation, and the Sharpe ratio that the best of them would reach without skill."""
    return records.agg(F.countDistinct("seal_id").alias("trials"), F.stddev_samp("sharpe").alias("trial_sd")).withColumn("bar", expected)


def origin_study(runs: DataFrame, exclude: list[str]) -> DataFrame:
    """The study in which each fingerprint was first run, but for excluded ones."""
    return runs.where(~F.col("study").cast("string").isin(exclude)).groupBy("fingerprint").agg(F.min_by("study", F.struct("logged_at", "run_id")).alias("origin"))


def primary_rows(records: DataFrame) -> DataFrame:
    """Of records the last per seal, and of those the last per strategy."""
    return latest_lines(latest_lines(records, ["seal_id"], ["logged_at", "run_id"]), ["strategy"], ["logged_at", "run_id"])


def highlight_best(rows: DataFrame, up: list[str], down: list[str]) -> DataFrame:
    """rows with best_<column>: whether a value is the best of its column, by the direction that is good."""
    w = Window.partitionBy()
    return rows.withColumns({f"best_{c}": F.col(c) == F.max(c).over(w) for c in up} | {f"best_{c}": F.col(c) == F.min(c).over(w) for c in down})


def checks(pairs: DataFrame) -> DataFrame:
    """Tri-state checks of a forward leg: true, false, or null where it cannot be told."""
    return pairs.withColumns(
        {
            "enough_months": F.col("n_f") >= 12,
            "positive": F.col("sharpe_f") > 0,
            "within_band": F.when(F.col("se_f").isNotNull(), F.abs(F.col("sharpe_f") - F.col("sharpe_r")) <= 1.959963984540054 * F.sqrt(F.col("se_f") * F.col("se_f") + F.col("se_r") * F.col("se_r"))),
            "kept_half": F.when(F.col("sharpe_r") > 0, F.col("sharpe_f") >= F.col("sharpe_r") / 2),
        }
    )
