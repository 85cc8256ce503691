"""Segmentation of signals into events by two sliding t-statistics, many reads at once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.functions.arrays import alike, arrays, known, lists
from eventloom.operators.frames import LEAST_VARIANCE

#: Samples of padded reads that are searched for peaks at once.
CELLS = 3_000_000


@dataclass(frozen=True)
class Segmenter:
    """How to segment. variant 1 normalises the events, variant 2 the signal; least and most bound variant 2's segments."""

    variant: int = 1
    short: int = 3
    long: int = 6
    short_threshold: float = 4.30265
    long_threshold: float = 2.57058
    height: float = 1.0
    least: int = 0
    most: int = 500
    precision: str = "float64"

    def but(self, **changes) -> Segmenter:
        """The same with some settings changed."""
        return replace(self, **changes)


#: Presets by name.
PRESETS = {
    "v1": Segmenter(),
    "v2": Segmenter(2, 3, 9, 4.0, 3.5, 0.4),
    "v2-r10": Segmenter(2, 3, 6, 6.5, 4.0, 0.2),
}


def window_sums(x: np.ndarray, width: int) -> np.ndarray:
    """The sum of every `width` samples in a row, each added up by itself and in order."""
    out = x[: len(x) - width + 1].copy()
    for k in range(1, width):
        out += x[k : k + len(out)]
    return out


def t_statistic(x: np.ndarray, width: int, precision: str = "float64") -> np.ndarray:
    """frames.t_statistic() for one read, to the last digit.

    Each window is added up by itself: differences of running sums are not quite 0 where
    samples repeat, and a variance of nothing makes peaks of that. With another precision
    running sums are kept in it, as some segmenters do.
    """
    n, out = len(x), np.zeros(len(x))
    if n < 2 * width or width < 2:
        return out
    kind = np.dtype(precision).type
    x = x.astype(kind)
    at = slice(width, n - width + 1)
    if kind is np.float64:
        means, squares = window_sums(x, width) / width, window_sums(x * x, width) / width
        m1, m2 = means[:-width], means[width:]
        q = squares[:-width] - m1 * m1 + squares[width:] - m2 * m2
    else:
        s, ss = (np.concatenate([np.zeros(1, kind), np.cumsum(v, dtype=kind)]) for v in (x, x * x))
        means = (s[width:] - s[:-width]) / width
        m1, m2 = means[:-width], means[width:]
        q = (ss[2 * width :] - ss[: -2 * width]) / width - m1 * m1 - m2 * m2
    out[at] = np.abs(m2 - m1) / np.sqrt(np.maximum(q, kind(LEAST_VARIANCE)) / width)
    return out


def peaks(shorts: list[np.ndarray], longs: list[np.ndarray], how: Segmenter) -> list[np.ndarray]:
    """The places where either statistic peaks, for many reads in step.

    Each detector first follows its statistic down, starts a peak where it has risen by
    `height`, follows it up, and reports the top once it has fallen by `height` from over
    the threshold and half a window has gone by. A short peak over its threshold silences
    the long detector for a window. Reads of like length go through their samples
    together: a step is a few array operations over all of them that still have samples.
    """
    out: list[np.ndarray] = [np.zeros(0, int)] * len(shorts)
    for group in alike([len(s) for s in shorts], CELLS):
        for k, found in zip(group, _peaks([shorts[k] for k in group], [longs[k] for k in group], how)):
            out[k] = found
    return out


def _peaks(shorts: list[np.ndarray], longs: list[np.ndarray], how: Segmenter) -> list[np.ndarray]:
    """peaks() for reads that come by length, the longest first."""
    lengths = np.array([len(s) for s in shorts])
    n, most = len(shorts), int(lengths.max(initial=0))
    curves = np.zeros((2, n, most))
    for k, many in enumerate((shorts, longs)):
        for row, s in zip(curves[k], many):
            row[: len(s)] = s
    widths, limits = (how.short, how.long), (how.short_threshold, how.long_threshold)
    top, at = np.full((2, n), np.inf), np.full((2, n), -1)
    sure, quiet = np.zeros((2, n), bool), np.zeros((2, n), int)
    found_read, found_at = [], []
    all_top, all_at, all_sure, all_quiet = top, at, sure, quiet
    for i in range(most):
        m = int(np.searchsorted(-lengths, -i, side="left"))  # reads that go on
        top, at, sure, quiet = all_top[:, :m], all_at[:, :m], all_sure[:, :m], all_quiet[:, :m]
        for k in (0, 1):
            v = curves[k, :m, i]
            on = quiet[k] < i
            searching, climbing = on & (at[k] < 0), on & (at[k] >= 0)
            falls = searching & (v < top[k])
            begins = searching & ~falls & (v - top[k] > how.height)
            higher = climbing & (v > top[k])
            top[k] = np.where(falls | begins | higher, v, top[k])
            at[k] = np.where(begins | higher, i, at[k])
            high = climbing & (top[k] > limits[k])
            if k == 0:
                quiet[1] = np.where(high, at[0] + how.short, quiet[1])
                top[1], at[1], sure[1] = np.where(high, np.inf, top[1]), np.where(high, -1, at[1]), sure[1] & ~high
            sure[k] |= high & (top[k] - v > how.height)
            done = climbing & sure[k] & (i - at[k] > widths[k] // 2)
            if done.any():
                found_read.append(np.flatnonzero(done))
                found_at.append(at[k][done])
                top[k], at[k], sure[k] = np.where(done, v, top[k]), np.where(done, -1, at[k]), sure[k] & ~done
    if not found_read:
        return [np.zeros(0, int)] * n
    reads, places = np.concatenate(found_read), np.concatenate(found_at)
    order = np.argsort(reads, kind="stable")
    return np.split(places[order], np.cumsum(np.bincount(reads, minlength=n))[:-1])


def middle_mean(segment: np.ndarray) -> float:
    """signal.middle_mean() for one segment."""
    if not len(segment):
        return 0.0
    s = np.sort(segment)
    q1, q3 = s[len(s) // 4], s[3 * len(s) // 4]
    kept = s[(s >= 2 * q1 - q3) & (s <= 2 * q3 - q1)]
    return float(kept.mean()) if len(kept) else 0.0


def spreads(reads: list[np.ndarray]) -> list[tuple[float, float]]:
    """Each read's mean and population standard deviation, many reads in step.

    They come sample by sample, the mean from a running sum and the deviation by Welford's
    update, as avg and stddev_pop come over a table in order. Sums in another order differ
    in the last digits, and with them the side that a sample on a limit falls to.
    """
    out = [(0.0, 0.0)] * len(reads)
    for group in alike([len(x) for x in reads], CELLS):
        lengths = np.array([len(reads[k]) for k in group])
        samples = np.zeros((int(lengths[0]), len(group)))
        for column, k in zip(samples.T, group):
            column[: len(reads[k])] = reads[k]
        total, mean, squares = np.zeros((3, len(group)))
        with np.errstate(invalid="ignore"):
            for i, v in enumerate(samples):
                m = int(np.searchsorted(-lengths, -i, side="left"))  # reads that go on
                v, off = v[:m], v[:m] - mean[:m]
                total[:m] += v
                mean[:m] += off / (i + 1)
                squares[:m] += (v - mean[:m]) * off
        for k, n, a, b in zip(group, lengths.tolist(), total.tolist(), squares.tolist()):
            out[k] = (a / n, math.sqrt(b / n)) if n else (0.0, 0.0)
    return out


def normalised(reads: list[np.ndarray], sigmas: float = 3.0) -> list[np.ndarray]:
    """Each read's population z-scores strictly inside +-sigmas; none without spread."""
    out = []
    for x, (mean, spread) in zip(reads, spreads(reads)):
        z = (x - mean) / spread if spread > 0 else x[:0]
        out.append(z[np.abs(z) < sigmas])
    return out


def segmented(signals: list[np.ndarray], how: Segmenter) -> list[np.ndarray | None]:
    """The events of each signal, or None where it has none.

    Variant 1: means between peaks; the last peak opens no segment of its own, the last
    segment runs to the end, and the events are z-scored (a lone event has no spread:
    None). Variant 2: trimmed means of the z-scored signal up to each peak; what follows
    the last peak, and segments that are too short or long, are dropped.
    """
    xs = [np.asarray(x, float) for x in signals]
    if how.variant != 1:
        xs = normalised(xs)
    found = peaks([t_statistic(x, how.short, how.precision) for x in xs], [t_statistic(x, how.long, how.precision) for x in xs], how)
    out: list[np.ndarray | None] = []
    for x, p in zip(xs, found):
        if not len(p):
            out.append(None)
        elif how.variant == 1:
            inside = 1 + int(((p[1:] > 0) & (p[1:] < len(x))).sum())
            edges = np.concatenate([[0], p[: inside - 1], [len(x)]])
            sums = np.concatenate([[0], np.cumsum(x)])
            with np.errstate(divide="ignore", invalid="ignore"):
                events = np.diff(sums[edges]) / np.diff(edges)
            spread = events.std()
            out.append((events - events.mean()) / spread if spread > 0 and np.isfinite(events).all() else None)
        else:
            p = p[(p > 0) & (p < len(x))]
            edges = np.concatenate([[0], p])
            own = [middle_mean(x[a:b]) for a, b in zip(edges[:-1], edges[1:]) if how.least <= b - a < how.most]
            out.append(np.array(own) if own else None)
    return out


def segment_reads(reads: DataFrame, how: Segmenter | str = "v1") -> DataFrame:
    """The events of reads (read_id, signal): read_id, events; null where there are none. Samples that are null or not a number are left out. No shuffle."""
    how = PRESETS[how] if isinstance(how, str) else how

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events = lists(segmented([known(v) for v in arrays(batch.column("signal"))], how), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("read_id"), events], names=["read_id", "events"])

    rows = reads.select("read_id", "signal")
    return rows.mapInArrow(run, f"read_id {rows.dtypes[0][1]}, events array<double>")


def carried_z_scores(x: np.ndarray, before: tuple[float, float, int]) -> tuple[np.ndarray, tuple[float, float, int]]:
    """z-scores of a signal by the mean and spread of all samples so far, and the sums to go on with (sum, sum of squares, count)."""
    total, squares, n = before[0] + float(x.sum()), before[1] + float((x * x).sum()), before[2] + len(x)
    mean = total / n if n else 0.0
    spread = np.sqrt(max(squares / n - mean * mean, 0.0)) if n else 0.0
    z = (x - mean) / spread if spread > 0 else x[:0]
    return z[np.abs(z) < 3.0], (total, squares, n)
