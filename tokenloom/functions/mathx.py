"""Scalar math columns (A7, T2, W5 guards, V1)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PERPLEXITY_CAP = 100.0


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def perplexity_col(loss: Column | str) -> Column:
    """exp(loss) if loss < 100 else +inf (NaN < 100 is false -> +inf)."""
    c = _c(loss)
    return F.when(c < F.lit(PERPLEXITY_CAP), F.exp(c)).otherwise(F.lit(float("inf")))


def nll_col(p: Column | str) -> Column:
    """-ln p, with p = 0 -> +inf (Spark's ln(0) is NULL)."""
    c = _c(p)
    return F.when(c > 0, -F.log(c)).otherwise(F.lit(float("inf")))


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, ``default`` when den <= 0 or NULL (ANSI-safe)."""
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def schedule_factor_col(step: Column | str, warmup: Column | int, total: Column | int,
                        kind: str = "cosine") -> Column:
    """Multiplier lambda(step) of the rate schedule.

    Linear warm-up to ``warmup``, then cosine / linear decay over
    ``total`` steps; any other ``kind`` is constant.  The cosine branch
    follows the formula literally, so it rises again past ``total``.
    """
    s = _c(step).cast("double")
    w = F.lit(warmup) if isinstance(warmup, int) else warmup
    t = F.lit(total) if isinstance(total, int) else total
    w_d, t_d = w.cast("double"), t.cast("double")
    warm = s / F.greatest(F.lit(1.0), w_d)
    span = F.greatest(F.lit(1.0), t_d - w_d)
    if kind == "cosine":
        progress = (s - w_d) / span
        after = F.greatest(F.lit(0.0), 0.5 * (1.0 + F.cos(F.lit(math.pi) * progress)))
    elif kind == "linear":
        after = F.greatest(F.lit(0.0), (t_d - s) / span)
    else:
        after = F.lit(1.0)
    return F.when(s < w_d, warm).otherwise(after)


def rms_normalize_col(vec: Column | str, eps: float = 1e-6, weight: list[float] | None = None) -> Column:
    """V1: w * x / sqrt(mean(x^2) + eps), computed in double."""
    x = _c(vec).cast("array<double>")
    ms = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v) / F.size(x)
    inv = F.lit(1.0) / F.sqrt(ms + F.lit(float(eps)))
    if weight is None:
        return F.transform(x, lambda v: v * inv)
    w = F.array(*[F.lit(float(v)) for v in weight])
    return F.zip_with(x, w, lambda v, g: g * v * inv)
