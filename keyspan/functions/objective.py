"""Losses, penalties, learning rates and update rules, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Logit:
    """log(1 + exp(-y m)) for label y and margin m."""

    def value(self, y: Column, m: Column) -> Column:
        z = -y * m  # split by sign, so that exp cannot overflow
        return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))

    def slope(self, y: Column, m: Column) -> Column:
        """By the margin; a feature's gradient is the sum of slope * value."""
        return -y * self.tau(y, m)

    def curvature(self, y: Column, m: Column) -> Column:
        """A feature's diagonal second derivative is the sum of curvature * value ** 2."""
        t = self.tau(y, m)
        return t * (1 - t)

    @staticmethod
    def tau(y: Column, m: Column) -> Column:
        return 1 / (1 + F.exp(y * m))


@dataclass(frozen=True)
class SquaredHinge:
    """max(1 - y m, 0) ** 2. literal: the slope with a step in place of the distance, taken where y m > 1."""

    literal: bool = False

    def value(self, y: Column, m: Column) -> Column:
        short = F.greatest(1 - y * m, F.lit(0.0))
        return short * short

    def slope(self, y: Column, m: Column) -> Column:
        if self.literal:
            return -2 * y * F.when(y * m > 1, F.lit(1.0)).otherwise(F.lit(0.0))
        return -2 * y * F.greatest(1 - y * m, F.lit(0.0))


@dataclass(frozen=True)
class Square:
    def value(self, y: Column, m: Column) -> Column:
        return (y - m) * (y - m) / 2

    def slope(self, y: Column, m: Column) -> Column:
        return m - y

    def curvature(self, y: Column, m: Column) -> Column:
        return F.lit(1.0)


@dataclass(frozen=True)
class Hinge:
    def value(self, y: Column, m: Column) -> Column:
        return F.greatest(1 - y * m, F.lit(0.0))

    def slope(self, y: Column, m: Column) -> Column:
        return F.when(y * m < 1, -y).otherwise(F.lit(0.0))


LOSSES = {"LOGIT": Logit(), "SQUARE_HINGE": SquaredHinge(), "SQUARE": Square(), "HINGE": Hinge()}


@dataclass(frozen=True)
class ElasticNet:
    """l1 |w| + l2 w ** 2 (the quadratic part enters the proximal step as a shrinkage by 1 + l2 eta)."""

    l1: float = 0.0
    l2: float = 0.0

    def value(self, w: Column) -> Column:
        return self.l1 * F.abs(w) + self.l2 * w * w

    def prox(self, z: Column, eta: Column | float) -> Column:
        eta = _c(eta)
        shift = self.l1 * eta
        soft = F.when(z > shift, z - shift).when(z < -shift, z + shift).otherwise(F.lit(0.0))
        return soft / (1 + self.l2 * eta)


def penalty(kind: str, *weights: float) -> ElasticNet:
    """L1 with one or two weights (absolute, quadratic), or L2 with one."""
    if kind == "L1":
        return ElasticNet(*weights)
    if kind == "L2":
        return ElasticNet(0.0, weights[0])
    raise ValueError(f"no penalty {kind}")


@dataclass(frozen=True)
class LearningRate:
    """alpha, or alpha / (x + beta) if it decays."""

    alpha: float = 1.0
    beta: float = 1.0
    decay: bool = True

    def __call__(self, x: Column) -> Column:
        return self.alpha / (x + self.beta) if self.decay else F.lit(float(self.alpha))


FTRL_STATE = "struct<w: double, z: double, n: double>"
ADAGRAD_STATE = "struct<w: double, s: double>"


@dataclass(frozen=True)
class Ftrl:
    """State (w, z, n), n being the root of the summed squares of gradients."""

    rate: LearningRate
    penalty: ElasticNet

    def start(self) -> Column:
        return F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("z"), F.lit(0.0).alias("n"))

    def step(self, s: Column, g: Column) -> Column:
        n = F.sqrt(s["n"] * s["n"] + g * g)
        # One field after another, each computed once and handed on.
        moved = lambda n: F.struct(n.alias("n"), (s["z"] + g - (n - s["n"]) / self.rate.alpha * s["w"]).alias("z"), self.rate(n).alias("eta"))
        out = lambda t: F.struct(self.penalty.prox(-t["z"] * t["eta"], t["eta"]).alias("w"), t["z"].alias("z"), t["n"].alias("n"))
        return F.element_at(F.transform(F.transform(F.array(n), moved), out), 1)


@dataclass(frozen=True)
class AdaGrad:
    """State (w, s), s being the sum of squares of gradients."""

    rate: LearningRate
    penalty: ElasticNet

    def start(self) -> Column:
        return F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s"))

    def step(self, s: Column, g: Column) -> Column:
        moved = lambda q: F.struct(q.alias("s"), self.rate(F.sqrt(q)).alias("eta"))
        out = lambda t: F.struct(self.penalty.prox(s["w"] - t["eta"] * g, t["eta"]).alias("w"), t["s"].alias("s"))
        return F.element_at(F.transform(F.transform(F.array(s["s"] + g * g), moved), out), 1)
