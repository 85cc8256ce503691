"""Training: normal mixtures for the start, then expectation-maximisation over chunks on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.arrays import alike, arrays, known, lists
from eventloom.operators.model import Model
from eventloom.sources.shared import unused_path

LEAST_VARIANCE = 1e-6
#: Fixed value: the step of the seeding draws.
GOLDEN = 0.6180339887498949
#: Values (places x chunks x states) that forward-backward holds at once.
CELLS = 2_000_000
#: Where at most one in so many transitions is left, a step goes through those alone.
SPARSE = 16
#: Numbers of all tasks together that the driver adds up itself.
GATHERED = 1_000_000


def mixture(values: DataFrame, column: str, n: int, seed: int = 0, rounds: int = 500, tol: float = 1e-6, seeding: str = "drawn") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A mixture of n normals by EM: means, variances and weights, in ascending order of means.

    The first means are drawn one by one, far values likelier: a value x has the draw
    u = frac(|x| * GOLDEN * (seed + k)) of the k-th mean, and the one with the largest
    ln(u) / distance ** 2 is taken. The draws and each round are aggregates over the
    values, of which the driver sees n sums; these sums don't depend on the order of
    values but for rounding. With many components seeding="oversampled" saves a job for each
    (see spread_means()). Stops when the log likelihood grows by less than tol
    relatively. Nulls are left out; equal values may be repeated.
    """
    x = F.col(column).cast("double")
    rows = values.filter(x.isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("m")).persist()  # equal values weigh together
    try:
        total, centre, spread = rows.agg(F.sum("m"), F.sum(F.col("x") * F.col("m")) / F.sum("m"), F.sum(F.col("x") * F.col("x") * F.col("m")) / F.sum("m")).first()
        if not total:
            raise ValueError("there are no values to fit")
        spread = rows.agg(F.sum(F.pow(F.col("x") - centre, 2) * F.col("m"))).first()[0] / total
        if seeding == "oversampled":
            means = spread_means(rows, n, seed)
            means += [centre + k * 1e-3 for k in range(len(means), n)]
        else:
            means = [rows.orderBy(_draw(seed, 1).desc(), "x").first()["x"]]
            for k in range(1, n):
                near = F.least(*[F.pow(F.col("x") - m, 2) for m in means]) if len(means) > 1 else F.pow(F.col("x") - means[0], 2)
                drawn = rows.filter(near > 0).orderBy((F.ln(_draw(seed, k + 1)) / near).desc(), "x").first()
                means.append(drawn["x"] if drawn else centre + k * 1e-3)
        means = np.array(sorted(means))
        variances, weights = np.full(n, max(spread / n, 1e-4)), np.full(n, 1 / n)
        before = None
        for _ in range(rounds):
            got = _mixture_sums(rows, means, variances, weights)
            mass, first, second = (np.array(got[1 + k * n : 1 + (k + 1) * n]) for k in range(3))
            mass = np.maximum(mass, 1e-12)
            moved = first / mass
            variances = np.maximum(second / mass - (moved - means) ** 2, LEAST_VARIANCE)
            means, weights = moved, mass / total
            if before is not None and abs(got[0] - before) <= tol * abs(before):
                break
            before = got[0]
    finally:
        rows.unpersist()
    order = np.argsort(means, kind="stable")
    return means[order], variances[order], weights[order]


def _draw(seed: int, k: int):
    """A value's draw of turn k, above 0 and up to 1."""
    return F.pmod(F.abs("x") * F.lit(GOLDEN * (seed + k)), F.lit(1.0)) + F.lit(1e-9)


def nearest(rows: DataFrame, means: list[float]) -> DataFrame:
    """rows (x, m) with the place of the nearest of ascending means (the lower one of two as near) and its squared distance: x, m, place, near."""
    edges = (np.array(means[1:]) + np.array(means[:-1])) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").to_numpy()
            place = np.searchsorted(edges, x, side="left")
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("m"), pa.array(place.astype(np.int32)), pa.array((x - np.array(means)[place]) ** 2)], names=["x", "m", "place", "near"])

    return rows.select("x", "m").mapInArrow(run, "x double, m long, place int, near double")


def oversampled(rows: DataFrame, means: list[float], size: int, seed: int, turn: int) -> list[float]:
    """A round of seeding: up to `size` further values, far and frequent ones likelier, as one top-k job over rows (x, m)."""
    far = nearest(rows, sorted(means)).filter("near > 0")
    key = F.ln(_draw(seed, turn)) / (F.col("near") * F.col("m"))
    return [r["x"] for r in far.orderBy(key.desc(), "x").select("x").limit(size).collect()]


def spread_means(rows: DataFrame, n: int, seed: int = 0, rounds: int = 4, factor: int = 2) -> list[float]:
    """Up to n starting means among values (x, m times each), in rounds + 2 jobs however large n is.

    One value is drawn; each round draws factor * n more at once by their distance from
    those before. The candidates, at most 1 + rounds * factor * n, weigh as much as the
    values nearest to them, and n of these are drawn one by one in the same way on the driver.
    """
    found = [rows.orderBy(_draw(seed, 1).desc(), "x").first()["x"]]
    for k in range(rounds):
        more = oversampled(rows, found, factor * n, seed, k + 2)
        if not more:
            break
        found += more
    x = np.array(sorted(found))
    weight = np.zeros(len(x))
    for r in nearest(rows, x.tolist()).groupBy("place").agg(F.sum("m").alias("m")).collect():
        weight[r["place"]] = r["m"]
    means = [float(x[np.argmax(weight)])]
    near = (x - means[0]) ** 2
    for k in range(1, n):
        if not (near > 0).any():
            break
        u = np.mod(np.abs(x) * GOLDEN * (seed + k + 1), 1.0) + 1e-9
        with np.errstate(divide="ignore"):
            key = np.where((near > 0) & (weight > 0), np.log(u) / (near * weight), -np.inf)
        means.append(float(x[np.argmax(key)]))
        near = np.minimum(near, (x - means[-1]) ** 2)
    return means


def _mixture_sums(rows: DataFrame, means: np.ndarray, variances: np.ndarray, weights: np.ndarray):
    """The log likelihood and each component's mass, sum of x and sum of squared distances from its mean, as one aggregate.

    The parameters go in as one array, so that the code doesn't depend on them.
    """
    n = len(means)
    flat = F.lit([*map(float, np.log(weights) - 0.5 * np.log(2 * np.pi * variances)), *map(float, means), *map(float, 2 * variances)])
    at = lambda k: F.get(flat, F.lit(k))
    terms = [at(k) - F.pow(F.col("x") - at(n + k), 2) / at(2 * n + k) for k in range(n)]
    scored = rows.select("x", "m", *[t.alias(f"l{k}") for k, t in enumerate(terms)])
    top = F.greatest(*[F.col(f"l{k}") for k in range(n)]) if n > 1 else F.col("l0")
    scored = scored.withColumn("top", top).select("x", "m", "top", *[F.exp(F.col(f"l{k}") - F.col("top")).alias(f"e{k}") for k in range(n)])
    s = F.col("e0")
    for k in range(1, n):
        s = s + F.col(f"e{k}")
    scored = scored.withColumn("s", s)
    share = lambda k: F.col("m") * F.col(f"e{k}") / F.col("s")
    sums = [F.sum(share(k)) for k in range(n)] + [F.sum(share(k) * F.col("x")) for k in range(n)] + [F.sum(share(k) * F.pow(F.col("x") - at(n + k), 2)) for k in range(n)]
    return scored.agg(F.sum(F.col("m") * (F.col("top") + F.ln("s"))), *sums).first()


Statistics = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]


class Moves:
    """Sums over transitions. Where few are left, only those are gone through; else the whole matrix is."""

    def __init__(self, trans: np.ndarray):
        self.trans, n = trans, len(trans)
        self.p, self.s = np.nonzero(trans)
        self.sparse = SPARSE * len(self.p) <= n * n
        if self.sparse:
            self.v = trans[self.p, self.s]
            self.into = np.argsort(self.s, kind="stable")  # edges by target; they come by source
            self.sources, self.source_at = np.unique(self.p, return_index=True)
            self.targets, self.target_at = np.unique(self.s[self.into], return_index=True)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """x @ trans."""
        if not self.sparse:
            return x @ self.trans
        out = np.zeros_like(x)
        if len(self.p):
            out[:, self.targets] = np.add.reduceat(x[:, self.p[self.into]] * self.v[self.into], self.target_at, axis=1)
        return out

    def backward(self, x: np.ndarray) -> np.ndarray:
        """x @ trans.T."""
        if not self.sparse:
            return x @ self.trans.T
        out = np.zeros_like(x)
        if len(self.p):
            out[:, self.sources] = np.add.reduceat(x[:, self.s] * self.v, self.source_at, axis=1)
        return out

    def met(self, f: np.ndarray, a: np.ndarray) -> np.ndarray:
        """How much of f goes to a by each transition that there is."""
        return np.einsum("ke,ke->e", f[:, self.p], a[:, self.s]) if self.sparse else f.T @ a

    def counts(self, total: np.ndarray | float) -> np.ndarray:
        """Sums of met() as a matrix of expected transitions."""
        if not self.sparse:
            return total * self.trans
        out = np.zeros_like(self.trans)
        out[self.p, self.s] = total * self.v
        return out


def expected(xs: list[np.ndarray], means: np.ndarray, variances: np.ndarray, trans: np.ndarray, cells: int | None = None) -> Statistics:
    """Scaled forward-backward over chunks, each with a uniform start; chunks of like length go step by step together.

    Returns the sums over chunks of expected transition counts, state masses, state sums of
    x, state sums of squared distances from the means, and the log likelihood.

    Of a group with more than `cells` values (places x chunks x states), only the forward
    values in front of each stretch of places are kept, a square root of them; going back,
    each stretch is made anew. So a chunk of any length takes its own size and two
    stretches. Steps cost what transitions there are (see Moves).
    """
    n, moves, cells = len(means), Moves(trans), cells or CELLS
    pairs, mass, first, second, log = 0.0, np.zeros(n), np.zeros(n), np.zeros(n), 0.0
    for group in alike([len(x) for x in xs], max(cells // n, 1)):
        lengths = np.array([len(xs[k]) for k in group])
        most, rows = int(lengths.max(initial=0)), len(group)
        if not most:
            continue
        x = np.zeros((most, rows))
        for k, g in enumerate(group):
            x[: lengths[k], k] = xs[g]
        live = np.searchsorted(-lengths, -np.arange(most), side="left")  # chunks that have a place t: the longest come first
        stretch = most if most * rows * n <= cells else int(np.ceil(np.sqrt(most)))

        def emitted(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            """Emissions of a stretch over the largest of each place, and that one's logarithm: values far from all means don't vanish."""
            emit = -0.5 * ((x[a:b, :, None] - means) ** 2 / variances + np.log(2 * np.pi * variances))  # noqa: B023
            top = emit.max(axis=2)
            return np.exp(emit - top[:, :, None]), top

        def walked(a: int, b: int, now: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Forward values of a stretch, from those of the place before it, and their scales."""
            out, scale = np.zeros((b - a, rows, n)), np.ones((b - a, rows))  # noqa: B023
            for t in range(a, b):
                m = live[t]  # noqa: B023
                now = (now[:m] if t == 0 else moves.forward(now[:m])) * emit[t - a, :m]
                scale[t - a, :m] = np.maximum(now.sum(axis=1), 1e-300)
                now = now / scale[t - a, :m, None]
                out[t - a, :m] = now
            return out, scale

        starts = range(0, most, stretch)
        before = {0: np.full((rows, n), 1 / n)}  # the values in front of each stretch
        for a in starts:
            b = min(a + stretch, most)
            emit, top = emitted(a, b)
            forward, scale = walked(a, b, before[a], emit)
            log += float(np.log(scale).sum() + sum(top[t - a, : live[t]].sum() for t in range(a, b)))
            before[b] = forward[-1].copy()
        behind, ahead_emit, ahead_scale = np.ones((rows, n)), None, None
        for a in reversed(starts):
            b = min(a + stretch, most)
            if len(starts) > 1:  # with one stretch its values are still there
                emit, _ = emitted(a, b)
                forward, scale = walked(a, b, before[a], emit)
            gamma = forward.copy()  # right for each chunk's last place
            for t in range(min(b, most - 1) - 1, a - 1, -1):
                m = live[t + 1]
                e, c = (emit[t + 1 - a, :m], scale[t + 1 - a, :m]) if t + 1 < b else (ahead_emit[:m], ahead_scale[:m])
                ahead = e * behind[:m] / c[:, None]
                pairs = pairs + moves.met(forward[t - a, :m], ahead)
                behind[:m] = moves.backward(ahead)
                gamma[t - a, :m] = forward[t - a, :m] * behind[:m]
            mass += gamma.sum(axis=(0, 1))
            first += np.einsum("tks,tk->s", gamma, x[a:b])
            second += (gamma * (x[a:b, :, None] - means) ** 2).sum(axis=(0, 1))
            ahead_emit, ahead_scale = emit[0].copy(), scale[0].copy()
    return moves.counts(pairs), mass, first, second, log


def _statistics(chunks: DataFrame, n_tasks: int, means: np.ndarray, variances: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The sum of all chunks' statistics. Each task adds up its own chunks; where their rows are few numbers together the driver adds them, else Spark does, element by element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            parts = expected([known(x) for x in arrays(batch.column("xs"))], means, variances, trans)
            flat = np.concatenate([np.ravel(p) for p in parts])
            total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([lists([total], pa.float64())], names=["values"])

    out = np.zeros(len(means) ** 2 + 3 * len(means) + 1)
    rows = chunks.select("xs").mapInArrow(run, "values array<double>")
    if n_tasks * len(out) <= GATHERED:
        for r in rows.collect():
            out += np.array(r["values"])
        return out
    for r in rows.select(F.posexplode("values").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def renewed(pairs: np.ndarray, before: np.ndarray, below: float = 0.0) -> np.ndarray:
    """Transition counts as probabilities by row, those under `below` cut and the rest raised to 1 again; rows without counts stay as before."""
    rows = pairs.sum(axis=1, keepdims=True)
    p = pairs / np.where(rows > 0, rows, 1)
    p = np.where(p < below, 0, p)
    left = p.sum(axis=1, keepdims=True)
    return np.where(rows > 0, p / np.where(left > 0, left, 1), before)


def trained(chunks: DataFrame, means: np.ndarray, variances: np.ndarray, trans: np.ndarray | None = None, least: int = 1001, most: int = 10_000, tol: float = 1e-4, prune_after: int = 100, prune_below: float = 0.001) -> tuple[Model, list[float]]:
    """Baum-Welch over chunks of observations (xs, an array a row): the model and the log likelihood of each round.

    A round is two jobs: one for transitions and means; one, with the new means but the old
    variances and transitions, for the squared distances that the variances are made of,
    over the masses of the first. Transitions start uniform without self transitions, which
    therefore stay 0; from round prune_after on (counted from 0) small ones are cut. Rounds
    stop when the log likelihood moves by less than tol, after more than `least` of them.
    States without mass, or without a way out, stay as they are.
    """
    n = len(means)
    if trans is None:
        if n < 2:
            raise ValueError("two states are needed where none may follow itself")
        trans = (1 - np.eye(n)) / (n - 1)
    path = unused_path(chunks.sparkSession, "chunks")
    chunks.select("xs").write.parquet(path)  # a lost executor's chunks are read again, not made again
    chunks = chunks.sparkSession.read.schema("xs array<double>").parquet(path).persist()
    log, k = [], n * n
    try:
        n_tasks = chunks.rdd.getNumPartitions()
        for turn in range(most):
            s = _statistics(chunks, n_tasks, means, variances, trans)
            mass, some = s[k : k + n], s[k : k + n] > 0
            means = np.where(some, s[k + n : k + 2 * n] / np.where(some, mass, 1), means)
            second = _statistics(chunks, n_tasks, means, variances, trans)[k + 2 * n : k + 3 * n]
            variances = np.where(some, np.maximum(second / np.where(some, mass, 1), LEAST_VARIANCE), variances)
            trans = renewed(s[:k].reshape(n, n), trans, prune_below if turn >= prune_after else 0.0)
            log.append(float(s[-1]))
            if turn >= least and abs(log[-1] - log[-2]) < tol:
                break
    finally:
        chunks.unpersist()
    return Model(tuple(means), tuple(variances), tuple(map(tuple, trans))), log
