"""Decoding of event sequences, many reads at once, and the correction that follows it."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.arrays import alike, arrays, lists
from eventloom.operators.model import Model

#: Scores (reads x events x states) that are held at once.
CELLS = 4_000_000
#: Where no state has links from more than one in so many states, a step goes through the links alone.
DENSE = 2


def best_paths(model: Model, p_stay: float, p_skip: float, reads: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """The best state path of each read, and which of its states were reached by a skip.

    A state's predecessor is, in this order and only if strictly better: one that the
    table links to it (lowest first), the state itself, the best state of the event
    before. Other skips are not tried, so a step costs what links there are. There is no initial distribution. A read with a
    value that is not a number, or with no possible path, gives None; an empty one an
    empty path.
    """
    means, variances = np.array(model.means), np.array(model.variances)
    norm, inv = -0.5 * (np.log(2 * np.pi) + np.log(variances)), 1 / (2 * variances)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = model.reparameterised(p_stay, p_skip)
        log_t = np.where(t > 0, np.log(np.where(t > 0, t, 1)), -np.inf)
    adjacent = model.adjacent()
    linked = np.where(adjacent, log_t, -np.inf)
    most_in = max(int(adjacent.sum(axis=0).max(initial=0)), 1)
    if few := DENSE * most_in <= len(means):  # each state's links in order, filled up with ones that can't be
        into = np.zeros((len(means), most_in), int)
        way = np.full(into.shape, -np.inf)
        for s in range(len(means)):
            p = np.flatnonzero(adjacent[:, s])
            into[s, : len(p)], way[s, : len(p)] = p, log_t[p, s]
    stay, own = np.diag(log_t), np.arange(len(means))
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(reads)
    for group in alike([len(r) for r in reads], CELLS // len(means)):
        lengths = np.array([len(reads[g]) for g in group])
        most, rows = int(lengths.max()), np.arange(len(group))
        if most == 0:
            for g in group:
                out[g] = np.zeros(0, np.int32), np.zeros(0, bool)
            continue
        x = np.zeros((len(group), most))
        for row, g in zip(x, group):
            row[: len(reads[g])] = reads[g]
        sound = np.isfinite(x).all(axis=1)
        x[~sound] = 0
        back = np.full((most, len(group), len(means)), -1, np.int16)
        skip = np.zeros((most, len(group), len(means)), bool)
        best = np.zeros((most, len(group)), np.int16)
        alive = np.zeros((most, len(group)), bool)
        score = norm - (x[:, :1] - means) ** 2 * inv
        best[0], alive[0] = score.argmax(axis=1), True
        for i in range(1, most):
            n = int(np.searchsorted(-lengths, -i, side="left"))  # reads that go on: they are sorted by length
            now, at = score[:n], rows[:n]
            if few:
                ways = now[:, into] + way
                where = ways.argmax(axis=2)
                value = np.take_along_axis(ways, where[:, :, None], axis=2)[:, :, 0]
                where = into[own, where]
            else:
                ways = now[:, :, None] + linked
                where = ways.argmax(axis=1)
                value = np.take_along_axis(ways, where[:, None, :], axis=1)[:, 0]
            self_ = now + stay
            where, value = np.where(self_ > value, own, where), np.maximum(self_, value)
            top = best[i - 1, :n].astype(int)
            jump = now[at, top][:, None] + log_t[top]
            skipped = jump > value
            where, value = np.where(skipped, top[:, None], where), np.where(skipped, jump, value)
            back[i, :n] = np.where(np.isfinite(value), where, -1)
            skip[i, :n] = skipped
            score = value + norm - (x[:n, i : i + 1] - means) ** 2 * inv
            best[i, :n], alive[i, :n] = score.argmax(axis=1), np.isfinite(score).any(axis=1)
        path, jumped = np.zeros((len(group), most), np.int32), np.zeros((len(group), most), bool)
        state = np.zeros(len(group), int)
        ok = sound.copy()
        for i in range(most - 1, -1, -1):
            state = np.where(lengths - 1 == i, best[i], state)
            on = lengths > i
            path[:, i] = state
            jumped[:, i] = skip[i, rows, state]
            if i:
                before = back[i, rows, state]
                ok &= ~on | ((before >= 0) & alive[i])
                state = np.where(on & (before >= 0), before, state)
        for k, g in enumerate(group):
            out[g] = (path[k, : lengths[k]], jumped[k, : lengths[k]]) if ok[k] else None
    return out


def collapsed(x: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and states of the runs of a path, and the run of each event."""
    starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]]) if len(path) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(path)))
    return (np.add.reduceat(x, starts) / sizes if len(x) else x), path[starts], np.repeat(np.arange(len(starts)), sizes)


def _frame_means(e: np.ndarray, w: int) -> np.ndarray:
    """The mean of each full frame of w values, by its first place."""
    return np.lib.stride_tricks.sliding_window_view(e, w).mean(axis=1)


def denoised(x: np.ndarray, path: np.ndarray, means: np.ndarray, width: int, edge: str = "compat") -> np.ndarray:
    """See frames.without_noise(), for one read."""
    w = width + 1 - width % 2
    if not width or len(x) < w:
        return x
    h, n, out = (w - 1) // 2, len(x), x.copy()
    noise = _frame_means(x - means[path], w)  # frame k has the centre k + h
    if edge == "exact":
        out[h : n - h] -= noise
        return out
    out[h : n - w - 1 + h] -= noise[: max(n - w - 1, 0)]
    out[n - w + h] -= noise[max(n - w - 1, 0)]
    return out


def run_denoised(x: np.ndarray, path: np.ndarray, means: np.ndarray, width: int, collapse: bool) -> np.ndarray:
    """See frames.without_run_noise(), for one read."""
    run_x, run_state, run = collapsed(x, path) if collapse else (x, path, np.arange(len(x)))
    w = width + 1 - width % 2
    h, n = (w - 1) // 2, len(run_x)
    if not width or n <= w:
        return x
    noise = np.zeros(n)
    noise[h : n - w + h] = _frame_means(run_x - means[run_state], w)[: n - w]
    return x - noise[run]


def decode_reads(reads: DataFrame, model: Model, p_stay: float, p_skip: float) -> DataFrame:
    """The state paths of reads (read_id, events): read_id, events, states, skips; null states and skips where there is no path.

    Arrow hands over many reads at once; those of like length are decoded together. No
    shuffle: the model travels with the function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = arrays(batch.column("events"))
            paths = best_paths(model, p_stay, p_skip, [np.zeros(0) if r is None else r for r in rows])
            found = [None if r is None else p for r, p in zip(rows, paths)]
            states = lists([None if p is None else p[0] for p in found], pa.int32())
            skips = lists([None if p is None else p[1] for p in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("read_id"), batch.column("events"), states, skips], names=["read_id", "events", "states", "skips"])

    rows = reads.select("read_id", F.col("events").cast("array<double>").alias("events"))
    return rows.mapInArrow(run, f"read_id {rows.dtypes[0][1]}, events array<double>, states array<int>, skips array<boolean>")


def corrector(model: Model, p_stay: float, width: int = 20, remove_stays: bool = True, remove_noise: bool = True):
    """The correction of one read by its path: (events, path) to (events, path)."""
    means, collapse = np.array(model.means), model.collapses(p_stay)

    def one(x: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if remove_stays and collapse:
            x, path, _ = collapsed(x, path)
        if remove_noise:
            x = denoised(x, path, means, width) if remove_stays else run_denoised(x, path, means, width, collapse)
        return x, path

    return one


def correct_grid(reads: DataFrame, model: Model, pairs: list[tuple[float, float]], width: int = 20, remove_stays: bool = True, remove_noise: bool = True) -> DataFrame:
    """correct_reads() for each pair of (p_stay, p_skip), in one pass over the reads: p_stay, p_skip, read_id, events, states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = arrays(batch.column("events"))
            plain = [np.zeros(0) if r is None else r for r in rows]
            for p_stay, p_skip in pairs:
                one = corrector(model, p_stay, width, remove_stays, remove_noise)
                paths = best_paths(model, p_stay, p_skip, plain)
                done = [None if r is None or p is None else one(r, p[0]) for r, p in zip(rows, paths)]
                events, states = (lists([None if d is None else d[k] for d in done], kind) for k, kind in ((0, pa.float64()), (1, pa.int32())))
                shares = [pa.array(np.full(len(rows), p)) for p in (p_stay, p_skip)]
                yield pa.RecordBatch.from_arrays([*shares, batch.column("read_id"), events, states], names=["p_stay", "p_skip", "read_id", "events", "states"])

    rows = reads.select("read_id", F.col("events").cast("array<double>").alias("events"))
    return rows.mapInArrow(run, f"p_stay double, p_skip double, read_id {rows.dtypes[0][1]}, events array<double>, states array<int>")


def correct_reads(reads: DataFrame, model: Model, p_stay: float, p_skip: float, width: int = 20, remove_stays: bool = True, remove_noise: bool = True, timed: bool = False) -> DataFrame:
    """Decode and correct reads (read_id, events) in one function: read_id, events, states; null where a read can't be decoded. timed adds ms, a read's share of the time that its batch took."""
    one = corrector(model, p_stay, width, remove_stays, remove_noise)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = time.perf_counter()
            rows = arrays(batch.column("events"))
            paths = best_paths(model, p_stay, p_skip, [np.zeros(0) if r is None else r for r in rows])
            done = [None if r is None or p is None else one(r, p[0]) for r, p in zip(rows, paths)]
            events = lists([None if d is None else d[0] for d in done], pa.float64())
            states = lists([None if d is None else d[1] for d in done], pa.int32())
            columns, names = [batch.column("read_id"), events, states], ["read_id", "events", "states"]
            if timed:
                sizes = np.array([0 if r is None else len(r) for r in rows], float)
                columns, names = [*columns, pa.array((time.perf_counter() - start) * 1000 * sizes / max(sizes.sum(), 1))], [*names, "ms"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = reads.select("read_id", F.col("events").cast("array<double>").alias("events"))
    return rows.mapInArrow(run, f"read_id {rows.dtypes[0][1]}, events array<double>, states array<int>" + (", ms double" if timed else ""))
