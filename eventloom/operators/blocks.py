"""Windows over reads of any length: the operators of frames.py, with a read dealt out in blocks.

A block is a range of `size` places of a read. What a block needs from the others comes
in two ways: sums of whole blocks are carried forward, and samples near an edge are
copied to the neighbour as a halo. So a read is as many groups as it has blocks; only
its blocks' sums, one row each, meet in a window of the read.

Signals are (read_id, idx, x) with idx from 0 without gaps, as indexed() makes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eventloom.operators.frames import LEAST_VARIANCE
from eventloom.sources.shared import unused_path

#: Samples of a block.
SIZE = 1 << 16


def _in_block() -> WindowSpec:
    return Window.partitionBy("read_id", "_block").orderBy("idx")


def _with_blocks(signal: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """Each sample in its block, and in those blocks to which it lies within `halo` places; _own tells the copies."""
    block = F.floor(F.col("idx") / size)
    if not halo:
        return signal.withColumns({"_block": block, "_own": F.lit(True)})
    near = F.sequence(F.floor((F.col("idx") - halo) / size), F.floor((F.col("idx") + halo) / size))
    return signal.withColumn("_block", F.explode(near)).withColumn("_own", F.col("_block") == block)


def _carried(blocks: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """A row for each block: sums over the blocks before it (before_*) and over the whole read (all_*)."""
    totals = blocks.filter("_own").groupBy("read_id", "_block").agg(*[c.alias(name) for name, c in sums.items()])
    read = Window.partitionBy("read_id")
    upto = read.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(name).over(upto), F.lit(0)).alias(f"before_{name}") for name in sums]
    return totals.select("read_id", "_block", *before, *[F.sum(name).over(read).alias(f"all_{name}") for name in sums])


def _joined(blocks: DataFrame, carried: DataFrame) -> DataFrame:
    """Samples with what is carried to their block; the join has the grouping of the blocks' windows."""
    same = (F.col("c.read_id").eqNullSafe(F.col("s.read_id"))) & (F.col("c._block") == F.col("s._block"))
    rest = [F.col(f"c.{c}") for c in carried.columns if c not in ("read_id", "_block")]
    return blocks.alias("s").join(carried.alias("c"), same).select("s.*", *rest)


def indexed(df: DataFrame, read: str, order: list[str], value: str) -> DataFrame:
    """frames.indexed() for reads of any length: ranges of (read, order) are sorted apart and numbered behind each other.

    The number of a row in its range is part of its id there (the upper bits are the
    range's); the rows of a read in the ranges before are counted by range. The ranges
    come from a sample that differs from one evaluation to the next, so the dealt rows are
    written with their ids once, and whatever reads the result gets the same ones.
    """
    columns = {f"_o{k}": F.col(c) for k, c in enumerate(order)}
    rows = df.select(F.col(read).alias("read_id"), F.col(value).cast("double").alias("x"), *[c.alias(name) for name, c in columns.items()])
    dealt = rows.repartitionByRange("read_id", *columns).sortWithinPartitions("read_id", *columns)
    dealt = dealt.select("read_id", "x", F.monotonically_increasing_id().alias("_at"))
    path = unused_path(df.sparkSession, "placed")
    dealt.write.parquet(path)
    placed = df.sparkSession.read.schema(dealt.schema).parquet(path).withColumn("_block", F.shiftright("_at", 33))
    firsts = placed.groupBy("read_id", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("read_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = _joined(placed, firsts.select("read_id", "_block", (before - F.col("first")).alias("shift")))
    return out.select("read_id", (F.col("_at") + F.col("shift")).alias("idx"), "x")


def prefix_sums(signal: DataFrame, size: int = SIZE) -> DataFrame:
    """Running sums of x and of its square, the row's own included: those of the blocks before, and those inside the block."""
    blocks = _with_blocks(signal, size)
    xx = F.col("x") * F.col("x")
    out = _joined(blocks, _carried(blocks, {"x": F.sum("x"), "xx": F.sum(xx)}))
    upto = _in_block().rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"sum_x": F.col("before_x") + F.sum("x").over(upto), "sum_xx": F.col("before_xx") + F.sum(xx).over(upto)})
    return out.select(*signal.columns, "sum_x", "sum_xx")


def z_scores(signal: DataFrame, size: int = SIZE) -> DataFrame:
    """x less its read's mean over its population standard deviation; null where that is 0.

    Blocks give their number, mean and squared deviation; a read's follow from those, so
    nothing large is subtracted from something as large.
    """
    blocks = _with_blocks(signal, size)
    read = Window.partitionBy("read_id")
    of_block = blocks.groupBy("read_id", "_block").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("d"))
    of_read = of_block.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(read) / F.sum("n").over(read))
    spread = F.sqrt(F.sum(F.col("d") + F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).over(read) / F.sum("n").over(read))
    out = _joined(blocks, of_read.withColumn("spread", spread).select("read_id", "_block", "mean", "spread"))
    return out.withColumn("x", F.try_divide(F.col("x") - F.col("mean"), F.col("spread"))).select(*signal.columns)


def within_sigmas(signal: DataFrame, sigmas: float = 3.0, size: int = SIZE) -> DataFrame:
    """z-scored samples strictly inside +-sigmas, with indices closed up: the samples kept in the blocks before, and those before it in the block."""
    blocks = _with_blocks(signal.filter((F.col("x") > -sigmas) & (F.col("x") < sigmas)), size)
    out = _joined(blocks, _carried(blocks, {"n": F.count("*")}))
    return out.withColumn("idx", F.col("before_n") + F.row_number().over(_in_block()) - 1).select(*signal.columns)


def t_statistics(signal: DataFrame, widths: dict[str, int], size: int = SIZE) -> DataFrame:
    """frames.t_statistic() for several widths at once, by name. Frames lie in a block and its halo, as wide as the widest frame."""
    halo = max(widths.values())
    if halo > size:
        raise ValueError("a block must be as long as a frame at least")
    blocks = _with_blocks(signal, size, halo)
    out = _joined(blocks, _carried(blocks, {"n": F.count("*")}))
    xx = F.col("x") * F.col("x")
    for name, width in widths.items():
        before, after = _in_block().rowsBetween(-width, -1), _in_block().rowsBetween(0, width - 1)
        m1, m2 = F.avg("x").over(before), F.avg("x").over(after)
        v = F.avg(xx).over(before) - m1 * m1 + F.avg(xx).over(after) - m2 * m2
        fits = (F.col("all_n") >= 2 * width) & (F.col("idx") >= width) & (F.col("idx") <= F.col("all_n") - width)
        t = F.abs(m2 - m1) / F.sqrt(F.greatest(v, F.lit(LEAST_VARIANCE)) / width)
        out = out.withColumn(name, F.when(fits, t).otherwise(0.0) if width >= 2 else F.lit(0.0))
    return out.filter("_own").select(*signal.columns, *widths)
