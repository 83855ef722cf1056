"""Contrast columns for categorical regressors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIXES = {1: ".L", 2: ".Q", 3: ".C"}


def polynomial_matrix(levels: int) -> np.ndarray:
    """Orthonormal polynomial contrasts of equally spaced levels (levels x degree)."""
    centred = np.arange(levels) - (levels - 1) / 2
    powers = np.vander(centred, levels, increasing=True)
    q, r = np.linalg.qr(powers)
    return (q * np.sign(np.diag(r)))[:, 1:]


def polynomial(ordinal: str, levels: int, name: str | None = None) -> dict[str, Column]:
    """Columns ``.L, .Q, .C, ^4 …`` of an ordered factor from its ordinal 1..levels; NULL stays NULL."""
    matrix = polynomial_matrix(levels)
    columns = {}
    for degree in range(1, levels):
        values = F.array(*[F.lit(float(v)) for v in matrix[:, degree - 1]])
        columns[f"{name or ordinal}{SUFFIXES.get(degree, f'^{degree}')}"] = F.get(values, F.col(ordinal) - 1)
    return columns


def treatment(factor: str, levels: list, name: str | None = None) -> dict[str, Column]:
    """0/1 columns of an unordered factor, the first level being the baseline; NULL stays NULL."""
    return {f"{name or factor}{level}": (F.col(factor) == F.lit(level)).cast("double") for level in levels[1:]}


def interactions(first: list[str], second: list[str]) -> dict[str, Column]:
    """Products of two sets of columns."""
    return {f"{a}:{b}": F.col(f"`{a}`") * F.col(f"`{b}`") for a in first for b in second}
