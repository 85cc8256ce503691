"""Search for the decoding parameters: a grid in one job, then hill climbing with shrinking steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import alignment
from eventloom.operators.decode import correct_grid
from eventloom.operators.model import Model

#: Parameters of the search.
GRID = (0.0, 0.025, 0.05, 0.1, 0.2, 0.3)
STEPS = (0.02, 0.01, 0.005)

Objective = Callable[[float, float], float]
Pair = tuple[float, float]


def grid_scores(reads: DataFrame, model: Model, score, grid: tuple[float, ...] = GRID, **options) -> DataFrame:
    """Scores for each pair of grid values: p_stay, p_skip and the columns that score gives.

    All pairs are decoded in one pass over the reads (read_id, events). score takes the
    corrected reads (p_stay, p_skip, read_id, events, states) and returns a row a pair.
    """
    return score(correct_grid(reads, model, [(x, y) for x in grid for y in grid], **options))


def f1_scores(mapped: DataFrame, truth: DataFrame, factor: float = 1.5, na_is_fp: bool = False, by: tuple[str, ...] = ("p_stay", "p_skip")) -> DataFrame:
    """Precision, recall and F1 of alignments against a truth, one row for each value of `by`.

    mapped holds the alignments (as in alignment.labelled(), row_id rising within a pair) that
    a mapper makes of the corrected reads of each pair; the mapper is the caller's.
    """
    rows = mapped.withColumn("_row", F.col("row_id")).withColumn("row_id", F.struct(*by, "_row"))
    return alignment.rates(alignment.confusion(alignment.labelled(rows, truth, factor), list(by)), na_is_fp).select(*by, "n", "precision", "recall", "f1")


def best(scores: DataFrame, by: str) -> DataFrame:
    """The row with the highest score, the lowest parameters first among equals."""
    return scores.orderBy(F.col(by).desc_nulls_last(), "p_stay", "p_skip").limit(1)


def scores_of(scores: DataFrame, by: str, pairs: list[Pair]) -> dict[Pair, float]:
    """The score of each pair of a few from a table with p_stay, p_skip; minus infinity for one that has none."""
    found = {(r["p_stay"], r["p_skip"]): r[by] for r in scores.select("p_stay", "p_skip", by).collect()}
    return {p: float("-inf") if found.get(p) is None else found[p] for p in pairs}


def climbed(objective: Objective, start: Pair, steps: tuple[float, ...] = STEPS, ahead: Callable[[list[Pair]], dict[Pair, float]] | None = None) -> tuple[Pair, float, int]:
    """Hill climbing from start: the best pair, its score, and how many pairs were asked for.

    Each round tries a step up and down in either parameter and takes the best strictly
    better pair; it never goes straight back, a parameter that gets better upwards isn't
    tried downwards, and negative values are left out. When no step helps, the next
    smaller one is tried. Pairs are scored once. ahead scores several pairs in one job (as
    correct_grid() does): then a round's neighbours, four at most, are scored together.
    """
    known: dict[Pair, float] = {}
    asked: set[Pair] = set()

    def value(pair: Pair) -> float:
        asked.add(pair)
        if pair not in known:
            known[pair] = objective(*pair)
        return known[pair]

    here = tuple(round(x, 6) for x in start)
    top = value(here)
    for step in steps:
        came = None  # (parameter, direction) of the last move
        while True:
            found = None
            moved = {(axis, sign): tuple(round(x + sign * step * (k == axis), 6) for k, x in enumerate(here)) for axis in (0, 1) for sign in (1, -1)}
            new = [p for (axis, _), p in moved.items() if p not in known and p[axis] >= 0]
            if ahead and new:
                known.update(ahead(new))
            for axis in (0, 1):
                for sign in (1, -1):
                    pair = moved[axis, sign]
                    if came == (axis, -sign) or pair[axis] < 0:
                        continue
                    score = value(pair)
                    if score > (found[0] if found else top):
                        found = score, pair, (axis, sign)
                    if sign == 1 and score > top:
                        break
            if not found:
                break
            top, here, came = found
    return here, top, len(asked)
