"""Search spaces: genes, presets of features or of families of features, and what a vector means."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The features of the presets, the signs of the families' members and the bounds of the other genes.
PRICE = (
    "mom_12_1", "resid_mom_12_1", "rev_1m", "info_discreteness", "high_52w_ratio", "trend_200d", "vol_126d", "idio_vol_252d", "beta_252d", "max_ret_21d", "amihud_illiq",
    "log_dollar_volume", "div_yield",
)
FUNDAMENTAL = ("book_to_market", "earnings_yield", "gross_profitability", "roe", "accruals", "log_market_cap", "asset_growth", "eps_surprise", "restatement_rate", "leverage")
NIGHT = ("mom_on_12_1", "mom_id_12_1", "on_minus_id_252d", "div_due_1m")
FAMILIES: dict[str, dict[str, int]] = {
    "momentum": {"mom_12_1": 1, "resid_mom_12_1": 1, "high_52w_ratio": 1, "info_discreteness": -1},
    "reversal": {"rev_1m": 1},
    "low_risk": {"vol_126d": -1, "idio_vol_252d": -1, "beta_252d": -1, "max_ret_21d": -1},
    "liquidity": {"amihud_illiq": 1},
    "payout": {"div_yield": 1, "div_growth_1y": 1, "div_due_1m": 1},
    "value": {"book_to_market": 1, "earnings_yield": 1, "cf_yield": 1},
    "quality": {"gross_profitability": 1, "roe": 1, "accruals": -1, "leverage": -1},
    "investment": {"asset_growth": -1},
    "earnings": {"eps_surprise": 1},
}
PRESETS: dict[str, tuple[str, ...]] = {"price": PRICE, "full": PRICE + FUNDAMENTAL, "night": PRICE + NIGHT}
FAMILY_PRESETS: dict[str, tuple[str, ...]] = {"families": tuple(FAMILIES), "families-price": ("momentum", "reversal", "low_risk", "liquidity", "payout")}
FAMILIES_AT_ONCE = 3
EARLIEST = {"full": "2010-07-01", "families": "2010-07-01"}
SCHEMES = ("equal", "score_rank", "inverse_vol")
DEAD = 0.10
SHAPE = (("top_k", 10, 100, True, ()), ("max_weight", 0.02, 0.20, False, ()), ("weighting", 0, 2, False, SCHEMES), ("use_regime", 0, 1, False, ("off", "on")), ("defensive_gross", 0.2, 1.0, False, ()), ("vol_trigger", 1.0, 3.0, False, ()))
PLAIN_SHAPE = {"top_k": 50, "max_weight": 0.05, "weighting": "equal", "use_regime": "off", "defensive_gross": 0.6, "vol_trigger": 1.5}
RECIPES: dict[str, dict[str, float]] = {
    "momentum": {"mom_12_1": 1.0}, "residual_momentum": {"resid_mom_12_1": 1.0}, "low_vol": {"vol_126d": -1.0}, "lottery_averse": {"max_ret_21d": -1.0, "idio_vol_252d": -1.0}, "reversal": {"rev_1m": 1.0},
    "trend": {"trend_200d": 1.0, "high_52w_ratio": 1.0}, "value": {"book_to_market": 1.0, "earnings_yield": 1.0}, "quality": {"gross_profitability": 1.0, "roe": 1.0, "accruals": -1.0},
}


@dataclass(frozen=True)
class Space:
    """A box of genes as parallel arrays: `signals` of them weigh features or families, the rest shape the portfolio."""

    names: tuple[str, ...]
    low: np.ndarray
    high: np.ndarray
    whole: np.ndarray
    choices: tuple[tuple[str, ...], ...]
    signals: int
    families: bool = False
    most: int | None = None

    def inside(self, x: np.ndarray) -> np.ndarray:
        """A population (a row a vector) within the bounds; whole numbers and choices are rounded."""
        x = np.asarray(x, dtype=np.float64)
        if x.shape[-1] != len(self.names):
            raise ValueError(f"{x.shape[-1]} genes where {len(self.names)} are due")
        x = np.clip(x, self.low, self.high)
        return np.where(self.whole, np.rint(x), x)

    def behaving(self, x: np.ndarray) -> np.ndarray:
        """A population as it behaves: weights in the dead zone are 0, and so are all but the `most` largest, of equal ones
        the first."""
        x = self.inside(np.atleast_2d(x)).copy()
        own = x[:, : self.signals]
        own[np.abs(own) < DEAD] = 0.0
        if self.most is not None and self.signals > self.most:
            late = np.argsort(-np.abs(own), axis=1, kind="stable")[:, self.most :]
            np.put_along_axis(own, late, 0.0, axis=1)
        return x

    def marks(self, x: np.ndarray, decimals: int = 3) -> list[str]:
        """A text for each vector, equal for those that behave alike."""
        return [",".join(f"{v:.{decimals}f}" for v in row) for row in self.behaving(x) + 0.0]

    def params(self, x: np.ndarray) -> dict:
        """What one vector says, by name. Where only so many weights may be live, the others are 0."""
        row = (self.behaving(x)[0] if self.most is not None else self.inside(np.atleast_2d(x))[0]).tolist()
        return {n: c[int(v)] if c else int(v) if w else v for n, v, w, c in zip(self.names, row, self.whole.tolist(), self.choices, strict=True)}

    def vector(self, params: dict) -> np.ndarray:
        """The vector of parameters by name, within the bounds."""
        return self.inside(np.array([float(c.index(params[n])) if c and isinstance(params[n], str) else float(params[n]) for n, c in zip(self.names, self.choices, strict=True)]))

    def draw(self, n: int, rng: np.random.Generator) -> np.ndarray:
        return self.inside(rng.uniform(self.low, self.high, (n, len(self.names))))


def space(preset: str = "price") -> Space:
    """The search space of a preset: a weight from -1 to 1 for each feature, or from 0 to 1 for each family, whose members'
    signs are given and of which FAMILIES_AT_ONCE may be live; and six genes for the portfolio."""
    if preset not in PRESETS and preset not in FAMILY_PRESETS:
        raise KeyError(f"unknown preset {preset}; there are {', '.join([*PRESETS, *FAMILY_PRESETS])}")
    families = preset in FAMILY_PRESETS
    own = FAMILY_PRESETS[preset] if families else PRESETS[preset]
    n = len(own)
    return Space(
        names=(*(("f_" if families else "w_") + x for x in own), *(s[0] for s in SHAPE)),
        low=np.array([0.0 if families else -1.0] * n + [float(s[1]) for s in SHAPE]),
        high=np.array([1.0] * n + [float(s[2]) for s in SHAPE]),
        whole=np.array([False] * n + [s[3] or bool(s[4]) for s in SHAPE]),
        choices=(*((),) * n, *(s[4] for s in SHAPE)),
        signals=n,
        families=families,
        most=FAMILIES_AT_ONCE if families else None,
    )


def features_of(preset: str) -> list[str]:
    """The features that a preset reads, each once."""
    if preset in PRESETS:
        return list(PRESETS[preset])
    return list(dict.fromkeys(f for name in FAMILY_PRESETS[preset] for f in FAMILIES[name]))


def recipes(preset: str) -> dict[str, np.ndarray]:
    """Known strategies as vectors: each family alone, or those recipes whose features the preset has."""
    box = space(preset)
    zero = dict.fromkeys(box.names[: box.signals], 0.0) | PLAIN_SHAPE
    if box.families:
        return {name: box.vector(zero | {f"f_{name}": 1.0}) for name in FAMILY_PRESETS[preset]}
    return {name: box.vector(zero | {f"w_{f}": w for f, w in own.items()}) for name, own in RECIPES.items() if set(own) <= set(PRESETS[preset])}


def presets_frame(spark: SparkSession) -> DataFrame:
    """preset, gene, place, low, high of all presets."""
    boxes = {p: space(p) for p in (*PRESETS, *FAMILY_PRESETS)}
    rows = [(p, n, i, float(lo), float(hi)) for p, s in boxes.items() for i, (n, lo, hi) in enumerate(zip(s.names, s.low, s.high, strict=True))]
    return spark.createDataFrame(rows, "preset string, gene string, place int, low double, high double")


def family_weights(box: Space, x: np.ndarray) -> list[tuple[str, float]]:
    """Live families of a vector, the heaviest first; none for a space of features."""
    row = box.behaving(x)[0][: box.signals]
    return sorted(((n[2:], float(w)) for n, w in zip(box.names, row, strict=False) if box.families and w > 0), key=lambda p: -p[1])


def live_features(box: Space, x: np.ndarray) -> list[str]:
    """The features that a vector reads: all members of its live families, or those with a weight."""
    if box.families:
        return list(dict.fromkeys(f for name, _ in family_weights(box, x) for f in FAMILIES[name]))
    return [n[2:] for n, w in zip(box.names, box.behaving(x)[0][: box.signals], strict=False) if w]


def family_score(weights: Sequence[tuple[str, float]], rank: dict[str, Column] | None = None) -> Column:
    """The weighted mean of live families' composites. A composite is the mean of its members' ranks, turned where the low
    end is the good one, over the members that a name has; a family of which it has none does not count."""
    at = rank or {}
    top, mass = F.lit(0.0), F.lit(0.0)
    for name, w in weights:
        parts = [(at.get(f, F.col(f)), sign) for f, sign in FAMILIES[name].items()]
        n = sum((c.isNotNull().cast("int") for c, _ in parts), F.lit(0))
        total = sum((F.coalesce(c if sign > 0 else 1 - c, F.lit(0.0)) for c, sign in parts), F.lit(0.0))
        top = top + F.when(n > 0, w * total / n).otherwise(0.0)
        mass = mass + F.when(n > 0, w).otherwise(0.0)
    return F.when(mass > 0, top / mass)


def ensemble(member_scores: list[str], rank: Column | None = None, least: int = 3) -> Column:
    """The mean of members' ranks, for names that `least` of them know."""
    known = sum((F.col(c).isNotNull().cast("int") for c in member_scores), F.lit(0))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in member_scores), F.lit(0.0))
    return F.when(known >= least, total / known)
