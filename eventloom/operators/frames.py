"""Signals and event sequences with one sample a row (read_id, idx, x): windows over reads.

All frames of a read share one partitioning and one sort, so a chain of these operators
costs one shuffle on read_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def read() -> WindowSpec:
    return Window.partitionBy("read_id")


def ordered() -> WindowSpec:
    return read().orderBy("idx")


def frame(low: int, high: int) -> WindowSpec:
    return ordered().rowsBetween(low, high)


def indexed(df: DataFrame, read: str, order: list[str], value: str) -> DataFrame:
    """Rows of a table as a signal: each row's place in its read, from 0, by the given order."""
    place = F.row_number().over(Window.partitionBy(read).orderBy(*order)) - 1
    return df.select(F.col(read).alias("read_id"), place.alias("idx"), F.col(value).cast("double").alias("x"))


def exploded(df: DataFrame, read: str, values: str) -> DataFrame:
    """Arrays of samples as one sample a row."""
    return df.select(F.col(read).alias("read_id"), F.posexplode(values).alias("idx", "x"))


def z_scores(signal: DataFrame) -> DataFrame:
    """x less its read's mean over its population standard deviation; null where that is 0."""
    return signal.withColumn("x", F.try_divide(F.col("x") - F.avg("x").over(read()), F.stddev_pop("x").over(read())))


def within_sigmas(signal: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """z-scored samples strictly inside +-sigmas, with indices closed up."""
    kept = signal.filter((F.col("x") > -sigmas) & (F.col("x") < sigmas))
    return kept.withColumn("idx", F.row_number().over(ordered()) - 1)


def prefix_sums(signal: DataFrame) -> DataFrame:
    """Running sums of x and of its square, the row's own included."""
    upto = frame(Window.unboundedPreceding, 0)
    return signal.withColumns({"sum_x": F.sum("x").over(upto), "sum_xx": F.sum(F.col("x") * F.col("x")).over(upto)})


#: Fixed value: the least variance of a t-statistic, the smallest normal 32-bit float.
LEAST_VARIANCE = 1.17549435e-38


def t_statistic(signal: DataFrame, width: int, name: str = "t") -> DataFrame:
    """Compare the means of the `width` samples before a place and of those from it on.

    0 where either window would leave the read, and for reads under two windows.
    """
    before, after = frame(-width, -1), frame(0, width - 1)
    m1, m2 = F.avg("x").over(before), F.avg("x").over(after)
    v = F.avg(F.col("x") * F.col("x")).over(before) - m1 * m1 + F.avg(F.col("x") * F.col("x")).over(after) - m2 * m2
    n = F.count("*").over(read())
    fits = (n >= 2 * width) & (F.col("idx") >= width) & (F.col("idx") <= n - width)
    t = F.abs(m2 - m1) / F.sqrt(F.greatest(v, F.lit(LEAST_VARIANCE)) / width)
    return signal.withColumn(name, F.when(fits, t).otherwise(0.0) if width >= 2 else F.lit(0.0))


def runs(path: DataFrame, collapse: bool = True) -> DataFrame:
    """Number the maximal runs of equal states of each read, from 0; without collapse each row is a run."""
    if not collapse:
        return path.withColumn("run", F.row_number().over(ordered()) - 1)
    new = F.coalesce((F.col("state") != F.lag("state").over(ordered())).cast("int"), F.lit(0))
    return path.withColumn("new", new).withColumn("run", F.sum("new").over(frame(Window.unboundedPreceding, 0))).drop("new")


def without_stays(path: DataFrame, collapse: bool = True) -> DataFrame:
    """One row per run of a state: its place, the mean of its samples, the state."""
    if not collapse:
        return path.select("read_id", "idx", "x", "state")
    of_run = runs(path).groupBy("read_id", "run").agg(F.avg("x").alias("x"), F.min_by("state", "idx").alias("state"))
    return of_run.select("read_id", F.col("run").cast("int").alias("idx"), "x", "state")


def _odd(width: int) -> tuple[int, int]:
    width += 1 - width % 2
    return width, (width - 1) // 2


def _means(means: list[float]) -> Column:
    return F.get(F.lit([float(m) for m in means]), F.col("state"))


def without_noise(path: DataFrame, means: list[float], width: int = 20, edge: str = "compat") -> DataFrame:
    """Subtract the mean residual (sample less its state's mean) of a sliding frame from its centre.

    An even width becomes the next odd one; reads shorter than the frame stay as they are.
    edge="compat": of the last two full frames, the first leaves its centre alone and the
    last takes the residuals of the frame one place earlier. edge="exact": every sample
    with a full frame gets that frame's mean.
    """
    if width == 0:
        return path
    w, h = _odd(width)
    e = F.col("x") - _means(means)
    own, earlier = F.avg(e).over(frame(-h, h)), F.avg(e).over(frame(-h - 1, h - 1))
    n, i = F.count("*").over(read()), F.col("idx")
    if edge == "exact":
        return path.withColumn("x", F.when((n >= w) & (i >= h) & (i <= n - 1 - h), F.col("x") - own).otherwise(F.col("x")))
    inner = (n >= w) & (i >= h) & (i <= n - w - 2 + h)
    last = (n >= w) & (i == n - w + h)
    return path.withColumn("x", F.when(inner, F.col("x") - own).when(last, F.col("x") - F.when(n == w, own).otherwise(earlier)).otherwise(F.col("x")))


def without_run_noise(path: DataFrame, means: list[float], width: int = 20, collapse: bool = True) -> DataFrame:
    """The same with runs for samples: a frame holds runs, and its mean residual comes off every sample of the centre run.

    The last full frame is not applied.
    """
    if width == 0:
        return path
    w, h = _odd(width)
    numbered = runs(path, collapse)
    of_run = numbered.groupBy("read_id", "run").agg(F.avg("x").alias("x"), F.min_by("state", "idx").alias("state"))
    by_run = read().orderBy("run")
    n, i = F.count("*").over(read()), F.col("run")
    noise = F.avg(F.col("x") - _means(means)).over(by_run.rowsBetween(-h, h))
    fits = (n >= width) & (i >= h) & (i <= n - w - 1 + h)
    noise = of_run.select("read_id", "run", F.when(fits, noise).otherwise(0.0).alias("noise"))
    return numbered.join(noise, ["read_id", "run"]).withColumn("x", F.col("x") - F.col("noise")).drop("run", "noise")


def border_segments(signal: DataFrame, borders: DataFrame) -> DataFrame:
    """Mean of the samples from each border (read_id, event_start) up to the next, z-scored over the read.

    Samples before the first border are left out, the last segment runs to the end, and
    borders at or behind the end are dropped. Borders count in ascending order; equal
    ones count once. A read without borders, or without spread, gives nothing.
    """
    sizes = signal.groupBy("read_id").agg(F.count("*").alias("n"))
    inside = borders.dropna().distinct().join(sizes, "read_id").filter("event_start >= 0 and event_start < n").select("read_id", F.col("event_start").alias("idx"), F.lit(True).alias("starts"))
    marked = signal.join(inside, ["read_id", "idx"], "left")
    segment = F.sum(F.col("starts").cast("int")).over(frame(Window.unboundedPreceding, 0))
    means = marked.withColumn("segment", segment).filter("segment is not null").groupBy("read_id", "segment").agg(F.avg("x").alias("x"))
    out = z_scores(means.select("read_id", (F.col("segment") - 1).cast("int").alias("idx"), "x"))
    return out.filter("x is not null")
