"""Tail probabilities of the t and normal distributions.

Spark has neither function. They run on coefficient tables only, a few rows per
model, vectorised over Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Steps of the recurrence that carries the gamma ratio to where its series holds in double precision.
_SHIFT = 16
# Nodes and weights of a double-exponential rule on (0, ∞) for integrands that decay exponentially.
_S = np.arange(-4.5, 5.0, 1.0 / 32.0)
_NODES = np.exp(_S - np.exp(-_S))
_WEIGHTS = _NODES * (1.0 + np.exp(-_S)) / 32.0


def _log_gamma_ratio(a: np.ndarray) -> np.ndarray:
    """ln Γ(a + ½) − ln Γ(a), without the cancellation of two large logarithms."""
    steps = np.arange(_SHIFT)
    below = np.log1p(-0.5 / (a[..., None] + steps + 0.5)).sum(axis=-1)
    z = a + _SHIFT
    series = -1 / (8 * z) + 1 / (192 * z**3) - 1 / (640 * z**5) + 17 / (14336 * z**7) - 31 / (18432 * z**9)
    return 0.5 * np.log(z) + series + below


def t_two_sided(t: np.ndarray | float, dof: np.ndarray | float) -> np.ndarray:
    """Two-sided p-values of Student's t; NaN where t is NaN or there are no degrees of freedom.

    With u = √dof · sinh(y) the tail is a multiple of ∫ cosh(y)^-dof dy from asinh(|t|/√dof). The integrand is smooth and is
    taken relative to its first value, so one fixed rule serves every t and every number of degrees of freedom.
    """
    t, dof = np.broadcast_arrays(np.abs(np.asarray(t, float)), np.asarray(dof, float))
    known = (dof > 0) & ~np.isnan(t)
    x, n = np.where(known & np.isfinite(t), t, 0.0), np.where(known, dof, 1.0)
    first = 0.5 * np.log1p(x * x / n)
    slope = x / np.sqrt(n + x * x)
    scale = 1.0 / (np.sqrt(n) + n * slope)
    with np.errstate(over="ignore"):
        d = scale[..., None] * _NODES
        rise = np.log1p(2 * np.sinh(d / 2) ** 2 + slope[..., None] * np.sinh(d))
        area = scale * (np.exp(-n[..., None] * rise) * _WEIGHTS).sum(axis=-1)
    p = 2 / math.sqrt(math.pi) * np.exp(_log_gamma_ratio(n / 2) - n * first) * area
    return np.where(known, np.where(np.isinf(t), 0.0, np.minimum(p, 1.0)), np.nan)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float, na_value=np.nan), dof.to_numpy(float, na_value=np.nan))).astype("Float64")
