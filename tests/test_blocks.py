"""Reads dealt out in blocks give what windows over whole reads give."""

import pytest
from pyspark.sql import functions as F

from eventloom.operators import blocks, frames


@pytest.fixture(scope="module")
def signal(spark):
    """A long read, shorter ones, one of a sample, one without a name; some samples are null."""
    n = F.when(F.col("id") < 3000, "long").when(F.col("id") < 3200, "b").when(F.col("id") < 3201, "one").when(F.col("id") < 3264, "c")
    rows = spark.range(3300).select(n.alias("read_id"), F.col("id").alias("t"), F.when(F.col("id") % 97 != 5, F.sin(F.col("id") * 1.7) * 40 + F.pmod(F.xxhash64("id"), F.lit(23))).alias("v"))
    return rows.repartition(7).cache()


def listed(df, digits=8):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_places(signal):
    assert listed(blocks.indexed(signal, "read_id", ["t"], "v")) == listed(frames.indexed(signal, "read_id", ["t"], "v"))


def test_places_hold_where_they_are_read_twice(spark):
    """So many rows that ranges come from a sample, which is another one each time; small ranges are not put together."""
    rows = spark.range(40_000).select((F.col("id") % 7).alias("r"), F.xxhash64("id").alias("t"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).alias("v")).coalesce(1)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")
    try:
        s, want = blocks.indexed(rows, "r", ["t"], "v"), frames.indexed(rows, "r", ["t"], "v")
        assert listed(s) == listed(want)
        assert listed(blocks.t_statistics(s, {"t": 3}, 256)) == listed(frames.t_statistic(want, 3))
    finally:
        spark.conf.unset(merged)


@pytest.mark.parametrize("size", [9, 64, 1 << 16])
def test_equal_to_windows_over_reads(signal, size):
    s = frames.indexed(signal, "read_id", ["t"], "v")
    known = s.fillna(1.0, ["x"])
    assert listed(blocks.prefix_sums(known, size), 4) == listed(frames.prefix_sums(known), 4)
    want = frames.t_statistic(frames.t_statistic(s, 3, "a"), 9, "b")
    assert listed(blocks.t_statistics(s, {"a": 3, "b": 9}, size)) == listed(want)
    assert listed(blocks.z_scores(known, size), 6) == listed(frames.z_scores(known), 6)
    z = frames.z_scores(known)
    assert listed(blocks.within_sigmas(z, 1.2, size)) == listed(frames.within_sigmas(z, 1.2))


def test_samples_of_a_read_meet_in_blocks_only(spark, signal):
    s = spark.range(10).select(F.lit("r").alias("read_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("x"))
    plan = blocks.t_statistics(s, {"a": 3}, 64)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("_block" in line.split("windowspecdefinition(")[1].split("ASC")[0] for line in windows) >= 1
    with pytest.raises(ValueError):
        blocks.t_statistics(s, {"a": 70}, 64)
    for made in (blocks.t_statistics(s.limit(0), {"a": 3}), blocks.prefix_sums(s.limit(0)), blocks.z_scores(s.limit(0)), blocks.within_sigmas(s.limit(0))):
        assert made.isEmpty()
