"""From samples to corrected events, in one stage after one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.signal import z_scored
from eventloom.operators import frames
from eventloom.operators.decode import correct_reads, decode_reads
from eventloom.operators.model import Model
from eventloom.operators.segment import Segmenter, segment_reads


def gathered(rows: DataFrame, read: str, order: list[str], value: str) -> DataFrame:
    """One row per read with its samples in order: read_id, signal."""
    at = F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_x"))))
    return rows.groupBy(F.col(read).alias("read_id")).agg(F.transform(at, lambda s: s["_x"]).alias("signal"))


def correct_events(reads: DataFrame, model: Model, p_stay: float, p_skip: float, width: int = 20, remove_stays: bool = True, remove_noise: bool = True, engine: str = "arrow", timed: bool = False) -> DataFrame:
    """Decode reads (read_id, events) and correct them: read_id, events, states; timed adds ms a read (with Arrow only).

    engine="arrow" decodes and corrects in one function without a shuffle. engine="sql"
    decodes alike and corrects with windows, one sample a row. Reads that can't be decoded
    have null events.
    """
    if engine == "arrow":
        return correct_reads(reads, model, p_stay, p_skip, width, remove_stays, remove_noise, timed)
    path = decode_reads(reads, model, p_stay, p_skip).filter("states is not null")
    path = path.select("read_id", F.posexplode(F.arrays_zip("events", "states")).alias("idx", "z")).select("read_id", "idx", F.col("z.events").alias("x"), F.col("z.states").alias("state"))
    collapse = model.collapses(p_stay)
    if remove_stays:
        path = frames.without_stays(path, collapse)
    if remove_noise:
        path = frames.without_noise(path, list(model.means), width) if remove_stays else frames.without_run_noise(path, list(model.means), width, collapse)
    at = F.sort_array(F.collect_list(F.struct("idx", "x", "state")))
    return path.groupBy("read_id").agg(at.alias("a")).select("read_id", F.transform("a", lambda s: s["x"]).alias("events"), F.transform("a", lambda s: s["state"]).alias("states"))


def segment_events(reads: DataFrame, how: Segmenter | str = "v1") -> DataFrame:
    """Segment reads (read_id, signal): read_id, events; reads without events are left out."""
    return segment_reads(reads, how).filter("events is not null")


def signal_to_corrected(reads: DataFrame, model: Model, p_stay: float, p_skip: float, how: Segmenter | str = "v1", **options) -> DataFrame:
    """Segment and correct reads (read_id, signal) in one stage."""
    return correct_events(segment_events(reads, how), model, p_stay, p_skip, **options)


def normalised(reads: DataFrame) -> DataFrame:
    """Reads (read_id, signal) with z-scored samples as events; reads without spread are left out."""
    return reads.select("read_id", z_scored(F.col("signal")).alias("events")).filter("events is not null")


def register(spark, model: Model, p_stay: float, p_skip: float) -> None:
    """SQL names for the array functions: segment_v1, segment_v2, viterbi_path."""
    import numpy as np
    import pyarrow as pa

    from eventloom.functions.arrays import arrays, known, lists
    from eventloom.operators.decode import best_paths
    from eventloom.operators.segment import PRESETS, segmented

    def segmenter(how):
        def run(column: pa.Array) -> pa.Array:
            return lists(segmented([known(v) for v in arrays(column)], how), pa.float64())

        run.__annotations__ = {"column": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "array<double>")

    def path(column: pa.Array) -> pa.Array:
        found = best_paths(model, p_stay, p_skip, [np.zeros(0) if v is None else v for v in arrays(column)])
        return lists([None if p is None else p[0] for p in found], pa.int32())

    path.__annotations__ = {"column": pa.Array, "return": pa.Array}
    spark.udf.register("segment_v1", segmenter(PRESETS["v1"]))
    spark.udf.register("segment_v2", segmenter(PRESETS["v2"]))
    spark.udf.register("viterbi_path", F.arrow_udf(path, "array<int>"))
