"""Forward tests: candidates sealed on the research window, run on what came after, and judged.

Legs are rows, so all candidates, cost settings and windows are compared in one plan; the log is a folder of JSON lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.functions.exprs import norm_cdf_sql
from pitlake.operators import backtest, metrics
from pitlake.operators.costs import SETTINGS, CostModel
from pitlake.operators.experiments import apply_holdout, look_number

# The day from which data are held out, months of forward data below which nothing is said, standard errors
# that are noise and that are a refutation, and how much more may be traded than before.
HOLDOUT = "2022-01-01"
LEAST_MONTHS = 24
NOISE, FATAL = 1.0, 1.96
MORE_TURNOVER = 1.5
COST_SETTINGS = ("realistic", "optimistic", "pessimistic")


class ForwardError(ValueError):
    """There is nothing to test."""


def seal_id(*fields: str) -> Column:
    """A short hash of what a candidate does: its fields by name, as JSON, without any date."""
    return F.concat(F.lit("seal-"), F.substring(F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)])), 256), 1, 12))


def seal(runs: DataFrame, fields: list[str], rationale: str, now: str) -> DataFrame:
    """Seals of runs, a row each: seal_id of `fields`, when and why, and all that the runs say of the research window.
    A run that has touched the holdout (column touches) can't be sealed: what it predicts is what it was measured on."""
    if runs.where("touches").limit(1).count():
        raise ValueError("a run that has seen the holdout can't be sealed")
    if not rationale.strip():
        raise ValueError("a seal needs a reason")
    return runs.select(seal_id(*fields).alias("seal_id"), F.lit(now).alias("sealed_at"), F.lit(rationale.strip()).alias("rationale"), *[c for c in runs.columns if c != "touches"])


def new_seals(seals: DataFrame, log: DataFrame) -> DataFrame:
    """Those of the seals that the log has not: the earliest line binds, later ones are not written."""
    return seals.join(log.select("seal_id").distinct(), "seal_id", "left_anti")


def forward_window(ends: DataFrame, start: str = HOLDOUT, end: str | None = None, boundary: str = HOLDOUT) -> DataFrame:
    """ends (data_end) with start, end and months of the window that can be tested: not before the holdout, not after the
    data. Raises if there is none."""
    lo = F.greatest(F.lit(start).cast("date"), F.lit(boundary).cast("date"))
    hi = F.least(F.lit(end).cast("date"), F.col("data_end")) if end else F.col("data_end")
    out = ends.withColumns({"start": lo, "end": hi}).withColumn("months", F.floor(F.months_between(F.date_add("end", 1), "start")).cast("int"))
    if out.where("end < start").limit(1).count():
        raise ForwardError("the data end before the holdout begins")
    return out


def drift(now: str, sealed: str) -> Column:
    """How much a recomputed figure differs from the sealed one; null if either is no number."""
    ok = F.col(now).isNotNull() & F.col(sealed).isNotNull() & ~F.isnan(now) & ~F.isnan(sealed)
    return F.when(ok, F.col(now) - F.col(sealed))


def _over(a: Column, b: Column, or_equal: bool = False) -> Column:
    """a > b; null if either is no number."""
    ok = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    return F.when(ok, a >= b if or_equal else a > b)


def comparison(pairs: DataFrame) -> DataFrame:
    """Pairs of legs, with columns of the research leg in _r and of the forward leg in _f (sharpe, se, n, cagr, max_drawdown,
    turnover, bench_sharpe, bench_cagr, ruined), with the differences: decay, its standard error, z and p, the
    Sharpe ratios and growth over the benchmark's, and how much more is traded."""
    se = F.sqrt(F.col("se_r") * F.col("se_r") + F.col("se_f") * F.col("se_f"))
    x = pairs.withColumns(
        {
            "decay": F.col("sharpe_f") - F.col("sharpe_r"),
            "decay_se": se,
            "d_sharpe_r": F.col("sharpe_r") - F.col("bench_sharpe_r"),
            "d_sharpe_f": F.col("sharpe_f") - F.col("bench_sharpe_f"),
            "excess_f": F.col("cagr_f") - F.col("bench_cagr_f"),
            "turnover_ratio": F.when(F.col("turnover_r") != 0, F.col("turnover_f") / F.col("turnover_r")),
        }
    ).withColumn("decay_z", F.when(F.col("decay_se") > 0, F.col("decay") / F.col("decay_se")))
    return x.withColumn("decay_p", F.expr(norm_cdf_sql("decay_z")))


CHECKS = ("enough_data", "no_ruin", "made_money", "beat_benchmark", "positive_excess", "kept_its_edge", "decay_within_noise", "drawdown_held", "turnover_held")


def checks(compared: DataFrame, least_months: int = LEAST_MONTHS) -> DataFrame:
    """Nine checks of each comparison: true, false, or null where it can't be told. An edge over the benchmark can only be
    kept if there was one."""
    c, zero = F.col, F.lit(0.0)
    return compared.withColumns(
        {
            "enough_data": c("n_f") >= least_months,
            "no_ruin": ~c("ruined_f"),
            "made_money": _over(c("cagr_f"), zero),
            "beat_benchmark": _over(c("d_sharpe_f"), zero),
            "positive_excess": _over(c("excess_f"), zero),
            "kept_its_edge": F.when(c("d_sharpe_r") > 0, _over(c("d_sharpe_f"), zero)),
            "decay_within_noise": _over(c("decay_z"), F.lit(-NOISE), True),
            "drawdown_held": _over(c("max_drawdown_f"), c("max_drawdown_r"), True),
            "turnover_held": _over(F.lit(MORE_TURNOVER), c("turnover_ratio"), True),
        }
    )


def verdict(checked: DataFrame) -> DataFrame:
    """The checks in order of weight as one word: inconclusive (too little data), failed (ruin, a loss, or a decay that is no
    noise), decayed (the edge is gone, or less than it was by more than noise), else held, which is not yet confirmed.
    `because` names what decided."""
    rules = [
        (~F.col("enough_data"), "inconclusive", "enough_data"),
        (~F.col("no_ruin"), "failed", "no_ruin"),
        (~F.col("made_money"), "failed", "made_money"),
        (F.col("decay_z") <= -FATAL, "failed", "decay"),
        (~F.col("kept_its_edge"), "decayed", "kept_its_edge"),
        (~F.col("decay_within_noise"), "decayed", "decay_within_noise"),
    ]
    word, why = F.lit("held"), F.lit("")
    for rule, name, because in reversed(rules):
        word, why = F.when(rule, name).otherwise(word), F.when(rule, because).otherwise(why)
    return checked.withColumns({"verdict": word, "because": why})


def legs(values: DataFrame, rebalances: DataFrame, windows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Statistics of runs (values: run, date, nav) over windows (leg, start, end): run, leg, n months, Sharpe ratio and its
    standard error by month, growth and drawdown, turnover a year, the benchmark's on the same dates, and ruin."""
    cut = values.join(F.broadcast(windows), (F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end")))
    cut = cut.withColumn("run_id", F.concat_ws("#", "run", "leg"))
    bench = cut.join(F.broadcast(benchmark.select("date", F.col("close").alias("bench"))), "date")
    # a run and the benchmark on its dates are two curves of one frame
    curves = cut.select(F.concat(F.lit("r"), "run_id").alias("run_id"), "date", "nav").unionByName(bench.select(F.concat(F.lit("b"), "run_id").alias("run_id"), "date", F.col("bench").alias("nav")))
    month = metrics.sharpe_inference(metrics.monthly_stats(curves)).select("run_id", "n", "sharpe", "se")
    both = metrics.performance(curves).select("run_id", "cagr", "max_drawdown").join(month, "run_id", "left")
    key = F.expr("substr(run_id, 2)").alias("run_id")
    stats = both.where("run_id LIKE 'r%'").select(key, "n", "sharpe", "se", "cagr", "max_drawdown")
    known = both.where("run_id LIKE 'b%'").select(key, F.col("sharpe").alias("bench_sharpe"), F.col("cagr").alias("bench_cagr"))
    span = cut.groupBy("run_id", "run", "leg").agg(F.min("nav").alias("_low"), (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("_years"))
    traded = rebalances.join(F.broadcast(windows), (F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end"))).groupBy("run", "leg").agg(F.sum(F.col("traded") / 2 / F.col("nav")).alias("_t"))
    out = span.join(traded, ["run", "leg"], "left").join(stats, "run_id", "left").join(known, "run_id", "left")
    return out.select("run", "leg", "n", "sharpe", "se", "cagr", "max_drawdown", (F.coalesce("_t", F.lit(0.0)) / F.col("_years")).alias("turnover"), "bench_sharpe", "bench_cagr", (F.col("_low") <= 0).alias("ruined"))


def paired(found: DataFrame) -> DataFrame:
    """Legs "research" and "forward" of each run side by side."""
    own = [c for c in found.columns if c not in ("run", "leg")]
    r = found.where("leg = 'research'").select("run", *[F.col(c).alias(f"{c}_r") for c in own])
    f = found.where("leg = 'forward'").select("run", *[F.col(c).alias(f"{c}_f") for c in own])
    return f.join(r, "run", "left")


def forward_test(
    weights: DataFrame, panel: DataFrame, calendar: DataFrame, benchmark: DataFrame, research_start: str, boundary: str = HOLDOUT, mode: str = "paired",
    settings: dict[str, CostModel] | None = None, least_months: int = LEAST_MONTHS, capital: float = 100_000.0,
) -> DataFrame:
    """Every run of weights (run, date, security_id, weight) under every cost setting: its comparison, checks and verdict.

    mode "paired": the research and the forward window are backtests of their own, each from `capital`; "continuous": one
    backtest goes through both and is cut at the boundary, so what is held then is carried over. What the runs did and their
    daily values, which the statistics read several times, are persisted.
    """
    if mode not in ("paired", "continuous"):
        raise ValueError(f"unknown mode {mode}")
    models = settings or {k: SETTINGS[k] for k in COST_SETTINGS}
    spark = weights.sparkSession
    last = calendar.agg(F.max("date").alias("data_end"))
    end = forward_window(last, boundary, None, boundary).first()
    before = apply_holdout(spark.createDataFrame([(research_start, str(end["end"]))], "start string, end string").select(F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end")), "exclude", boundary).first()
    windows = spark.createDataFrame([("research", before["start"], before["end"]), ("forward", end["start"], end["end"])], "leg string, start date, end date")
    parts = [("", before["start"], end["end"])] if mode == "continuous" else [("#research", before["start"], before["end"]), ("#forward", end["start"], end["end"])]
    curves, trades = [], []
    for _, start, stop in parts:
        days = calendar.where(F.col("date") <= F.lit(stop))
        schedule = backtest.rebalance_schedule(days, str(start))
        events = backtest.run_settings(weights, panel.where(F.col("date") <= F.lit(stop)), schedule, models, capital).persist()
        dates = F.broadcast(calendar.select("session_index", "date"))
        curves.append(backtest.daily_value(events, panel).join(dates, "session_index").where((F.col("date") >= F.lit(start)) & (F.col("date") <= F.lit(stop))))
        trades.append(backtest.rebalances(events).join(F.broadcast(schedule.select("period", "date")), "period"))
    values, done = curves[0], trades[0]
    for c, t in zip(curves[1:], trades[1:], strict=True):
        values, done = values.unionByName(c), done.unionByName(t)
    found = legs(values.persist(), done.persist(), windows, benchmark)
    return verdict(checks(comparison(paired(found)), least_months))


def suite(candidates: dict[str, Callable[[], DataFrame]], test: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """The forward tests of candidates (name: a function that gives weights), and the reasons of those that failed; one
    failure leaves the others alone."""
    out, failed = None, {}
    for name, weights in candidates.items():
        try:
            found = test(weights()).withColumn("candidate", F.lit(name))
            found.schema  # noqa: B018 - analysed here, so that what is wrong is known to be this candidate's
            out = found if out is None else out.unionByName(found)
        except Exception as e:  # noqa: BLE001 - whatever a candidate raises
            failed[name] = f"{type(e).__name__}: {e}".splitlines()[0]
    return out, failed


def records(tested: DataFrame, log: DataFrame, now: str, mode: str) -> DataFrame:
    """What a forward test adds to the log (seal_id, setting, mode, logged_at, look): how often each seal has been looked at
    under a setting and mode, this time included."""
    before = log.groupBy("seal_id", "setting", "mode").agg(F.count(F.lit(1)).alias("_n"))
    own = tested.withColumns({"mode": F.lit(mode), "logged_at": F.lit(now)}).join(before, ["seal_id", "setting", "mode"], "left")
    looked = look_number(own, ["seal_id", "setting", "mode"], ["logged_at"])
    return looked.withColumn("look", F.col("look") + F.coalesce("_n", F.lit(0))).drop("_n")


def roster(order: DataFrame, recorded: DataFrame) -> DataFrame:
    """The strategies of an ordered list (name, place) that have a record."""
    return order.join(recorded.select(F.col("strategy").alias("name")).distinct(), "name", "left_semi").orderBy("place")


def deliverables(searches: DataFrame, ensembles: DataFrame, champions: DataFrame) -> DataFrame:
    """What each search (study) gives: its ensemble, else its champion, else nothing."""
    e, c = ensembles.select("study", F.col("genome").alias("_e")), champions.select("study", F.col("genome").alias("_c"))
    kind = F.when(F.col("_e").isNotNull(), "ensemble").when(F.col("_c").isNotNull(), "champion")
    return searches.join(e, "study", "left").join(c, "study", "left").select("study", kind.alias("kind"), F.coalesce("_e", "_c").alias("genome")).where("kind IS NOT NULL")
