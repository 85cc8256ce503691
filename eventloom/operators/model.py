"""Hidden Markov models with normal emissions: validation, re-parameterised transitions, long tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Self transitions above this share (as a 32-bit float) make runs of a state collapse.
COLLAPSE_FROM = 0.001


@dataclass(frozen=True)
class Model:
    """means and variances of n states, and the n x n transition table as it is read."""

    means: tuple[float, ...]
    variances: tuple[float, ...]
    transitions: tuple[tuple[float, ...], ...]

    def __post_init__(self):
        n = len(self.means)
        if not n or len(self.variances) != n or len(self.transitions) != n or any(len(row) != n for row in self.transitions):
            raise ValueError("a model needs n means, n variances and n rows of n transitions")
        if min(self.variances) <= 0:
            raise ValueError("variances must be positive")

    def reparameterised(self, p_stay: float, p_skip: float, strict: bool = False) -> np.ndarray:
        """Transition probabilities with a common self share and skip share.

        The table's diagonal is replaced by p_stay. In each row the other zero entries
        share p_skip evenly, and the positive ones share what is left by their size. Rows
        without zeros, or without positive entries, then sum to less than 1. strict
        refuses shares that are negative or over 1 together.
        """
        if strict and (min(p_stay, p_skip) < 0 or p_stay + p_skip > 1):
            raise ValueError("p_stay and p_skip must be shares of 1")
        t = np.array(self.transitions, float)
        off = ~np.eye(len(t), dtype=bool)
        zero, positive = off & (t == 0), off & (t > 0)
        n_zero, total = zero.sum(axis=1, keepdims=True), np.where(positive, t, 0).sum(axis=1, keepdims=True)
        out = np.where(zero, p_skip / np.maximum(n_zero, 1), 0.0)
        out = np.where(positive, (1 - p_stay - p_skip) * t / np.where(total > 0, total, 1), out)
        np.fill_diagonal(out, p_stay)
        return out

    def adjacent(self) -> np.ndarray:
        """Which transitions the table has, the diagonal apart."""
        t = np.array(self.transitions, float)
        return (t > 0) & ~np.eye(len(t), dtype=bool)

    def collapses(self, p_stay: float) -> bool:
        return float(np.float32(p_stay)) > COLLAPSE_FROM

    def states(self, spark: SparkSession) -> DataFrame:
        """One row per state: s, mean, var."""
        return spark.createDataFrame([(i, float(m), float(v)) for i, (m, v) in enumerate(zip(self.means, self.variances))], "s int, mean double, var double")

    def edges(self, spark: SparkSession) -> DataFrame:
        """One row per entry of the table: p, s, prob."""
        return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(self.transitions) for j, x in enumerate(row)], "p int, s int, prob double")


def reparameterised(edges: DataFrame, p_stay: float, p_skip: float) -> DataFrame:
    """The same for a long table (p, s, prob): p, s, prob, is_adjacent; one window per row of the table."""
    row = Window.partitionBy("p")
    off = F.col("p") != F.col("s")
    zeros = F.count_if(off & (F.col("prob") == 0)).over(row)
    total = F.sum(F.when(off & (F.col("prob") > 0), F.col("prob"))).over(row)
    prob = F.when(~off, F.lit(p_stay)).when(F.col("prob") == 0, F.try_divide(F.lit(p_skip), zeros)).otherwise((1 - p_stay - p_skip) * F.col("prob") / total)
    return edges.select("p", "s", prob.alias("prob"), (off & (F.col("prob") > 0)).alias("is_adjacent"))
