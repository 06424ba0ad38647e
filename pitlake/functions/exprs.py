"""Column expressions that the operators share. NULL is "no opinion"; NaN and infinities become NULL at every boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def nullify(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.when(b != 0, a / b)


def div_positive(a: Column, b: Column) -> Column:
    """a / b, NULL unless b is positive."""
    return F.when(b > 0, a / b)


def clip(c: Column, lo: float, hi: float) -> Column:
    """c within bounds; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def growth(now: Column, before: Column) -> Column:
    """now / before - 1 for a positive base."""
    return F.when(before > 0, now / before - 1)


def growth_signed(now: Column, before: Column, bound: float = 10.0) -> Column:
    """(now - before) / |before|, within bounds."""
    return clip(F.when(before != 0, (now - before) / F.abs(before)), -bound, bound)


def tick_size(date: Column) -> Column:
    """The price step of a session: a sixteenth before decimal prices, a cent since."""
    return F.when(date < F.lit("2001-04-09").cast("date"), F.lit(1 / 16)).otherwise(F.lit(0.01))


def rank_pct(c: Column, by: Sequence[str], least: int = 3) -> Column:
    """Percentile rank in [0, 1] of non-null values in each group, ties averaged; NULL in groups of fewer than `least`."""
    group = Window.partitionBy(*by)
    n = F.count(c).over(group)
    place = F.rank().over(group.orderBy(c.asc_nulls_last()))
    same = F.count(c).over(Window.partitionBy(*by, c))
    return F.when(c.isNotNull() & (n >= least), (place - 1 + (same - 1) / 2) / (n - 1))


def zscore(c: Column, by: Sequence[str], bound: float | None = 4.0, fill: float | None = None) -> Column:
    """Cross-sectional z-score (sample deviation), clipped to +-bound if given; NULL without spread. `fill` replaces NULL."""
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(c).over(w)
    z = F.when(sd > 0, (c - F.avg(c).over(w)) / sd)
    z = clip(z, -bound, bound) if bound is not None else z
    return F.coalesce(z, F.lit(fill)) if fill is not None else z


def winsorise(c: Column, by: Sequence[str], lo: float = 0.01, hi: float = 0.99, least: int = 10) -> Column:
    """c clipped to the group's exact percentiles; as it is in groups of fewer than `least`."""
    w = Window.partitionBy(*by)
    bounds = F.percentile(c, F.array(F.lit(lo), F.lit(hi))).over(w)
    return F.when(F.count(c).over(w) >= least, F.when(c.isNotNull(), F.greatest(F.least(c, bounds[1]), bounds[0]))).otherwise(c)


def blend(parts: Sequence[tuple[Column, float]], least: int = 1) -> Column:
    """Weighted mean of the parts that are not null (divided by their absolute weights); NULL with fewer than `least`."""
    have = sum((F.when(c.isNotNull(), 1).otherwise(0) for c, _ in parts), F.lit(0))
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    mass = sum((F.when(c.isNotNull(), abs(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when((have >= least) & (mass > 0), top / mass)


def conditional(primary: Column, condition_rank: Column, keep: float = 0.33, high: bool = True) -> Column:
    """primary where the rank of the condition lies in its top (or bottom) share."""
    return F.when(condition_rank >= 1 - keep if high else condition_rank <= keep, primary)


def trailing(order: str, width: int, by: Sequence[str] = (), skip: int = 0) -> WindowSpec:
    """The `width` sessions that end `skip` sessions ago: by session number, so that a missing bar takes a place."""
    return Window.partitionBy(*by).orderBy(order).rangeBetween(-(width - 1 + skip), -skip)


def trailing_agg(agg: Column, counted: Column, window: WindowSpec, least: int) -> Column:
    """agg over the window where it has `least` values of `counted`."""
    return F.when(F.count(counted).over(window) >= least, agg.over(window))


def skewness(c: Column) -> Column:
    """Bias-corrected skewness as an aggregate; NULL below three values or without spread."""
    n = F.count(c)
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis as an aggregate; NULL below four values or without spread."""
    n = F.count(c)
    return F.when((n > 3) & (F.stddev_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def norm_cdf_sql(x: str) -> str:
    """Standard normal distribution function as SQL text, to about 1e-15 (Hart's rational form)."""
    # fixed values: Hart's coefficients
    a = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    b = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
    z = f"abs({x})"

    def horner(c: tuple[float, ...]) -> str:
        out = repr(c[0])
        for v in c[1:]:
            out = f"({out} * {z} + {v!r})"
        return out

    low = f"exp(-{z} * {z} / 2) * {horner(a)} / {horner(b)}"
    far = f"exp(-{z} * {z} / 2) / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) / 2.506628274631"
    tail = f"CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < 7.07106781186547 THEN {low} ELSE {far} END"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END)"


def norm_ppf_sql(p: str) -> str:
    """Inverse of the standard normal distribution function as SQL text (Acklam); NULL outside (0, 1)."""
    # fixed values: Acklam's coefficients
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def horner(k: tuple[float, ...], v: str) -> str:
        out = repr(k[0])
        for x in k[1:]:
            out = f"({out} * {v} + {x!r})"
        return out

    r, low, high = f"(({p} - 0.5) * ({p} - 0.5))", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (
        f"(CASE WHEN {p} IS NULL OR {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < 0.02425 THEN {horner(c, low)} / {horner(d, low)} "
        f"WHEN {p} > 1 - 0.02425 THEN -{horner(c, high)} / {horner(d, high)} ELSE {horner(a, r)} * ({p} - 0.5) / {horner(b, r)} END)"
    )


def norm_cdf(c: str) -> Column:
    return F.expr(norm_cdf_sql(c))


def norm_ppf(c: str) -> Column:
    return F.expr(norm_ppf_sql(c))


def sharpe_se(sharpe: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Standard error of a Sharpe ratio (not annualised) for given skewness and kurtosis; NULL below two periods."""
    return F.when(n > 1, F.sqrt(F.greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, F.lit(0.0)) / (n - 1)))


def stable_key(c: Column) -> Column:
    """A key that has nothing to do with the order of ids, for ties."""
    return F.md5(c.cast("string"))
