"""Writers of the text formats, and the lines that they write."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.arrays import arrays
from eventloom.operators.model import Model


def event_lines(reads: DataFrame, digits: int = 6) -> DataFrame:
    """read_id, events as lines (value) with fixed decimals; reads without events are left out."""
    some = reads.filter(F.size("events") > 0)
    numbers = F.array_join(F.transform("events", lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), "\t")
    return some.select(F.concat_ws("\t", "read_id", numbers).alias("value"))


def short_number(column: Column) -> Column:
    """Arrays of numbers with six significant digits, tab-joined."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array(["\t".join(["%.6g"] * len(v)) % tuple(v) if v is not None else "" for v in arrays(values)], pa.string())

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(column)


def corrected_lines(reads: DataFrame) -> DataFrame:
    """read_id, events as lines (value) with six significant digits."""
    some = reads.filter("events is not null")
    return some.select(F.concat_ws("\t", "read_id", short_number(F.col("events"))).alias("value"))


def annotated_lines(labelled: DataFrame) -> DataFrame:
    """Alignment lines (raw_line) with their label as a last tag."""
    return labelled.select(F.concat("raw_line", F.lit("\trf:Z:"), "label").alias("value"))


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    lines.write.option("compression", compression).text(path)


def model_lines(means: list[float], variances: list[float], transitions: list[list[float]]) -> str:
    """The three lines of a model file, six decimals each."""
    flat = [x for row in transitions for x in row]
    return "\n".join("\t".join(f"{x:.6f}" for x in values) for values in (means, variances, flat))


def write_model(spark: SparkSession, model: Model, path: str) -> None:
    """A model file, as one part."""
    spark.createDataFrame([(model_lines(model.means, model.variances, model.transitions),)], "value string").coalesce(1).write.text(path)


def counted(reads: DataFrame, name: str = "reads") -> tuple[DataFrame, object]:
    """reads, and an Observation that has n_reads, n_written and n_skipped once they have been written, and ms (the tasks' time together) where reads have it.

    Tasks count what they hand on, so the writing job is the only one. Counts of a task
    that runs again because its output got lost may be in the sums twice.
    """
    from pyspark.sql import Observation

    seen = Observation(name)
    some = F.size("events") > 0
    counts = [F.count("*").alias("n_reads"), F.count_if(some).alias("n_written"), F.count_if(~F.coalesce(some, F.lit(False))).alias("n_skipped")]
    return reads.observe(seen, *counts, *([F.coalesce(F.sum("ms"), F.lit(0.0)).alias("ms")] if "ms" in reads.columns else [])), seen


def report(rates: DataFrame) -> Iterator[str]:
    """Printed lines of a rates table: one row per run, so few."""
    for row in rates.toLocalIterator():
        for name, value in row.asDict().items():
            yield f"{name}: {value:.2f}" if isinstance(value, float) else f"{name}: {value}"


def report_lines(rates: DataFrame, key: str) -> DataFrame:
    """The printed report of each row of rates (see alignment.rates() and throughput()): key, line_no, value.

    A summary, the matrix of positives and negatives with their percentages, the mappings
    that the truth doesn't know, and speed where rates has it.
    """
    share = lambda x: F.format_string("%.2f", F.col(f"pct_{x}").cast("double"))
    mapped = F.col("n_tp") + F.col("n_fp") + F.col("n_na")
    lines = [
        F.concat(F.lit("Summary: "), F.col("n").cast("string"), F.lit(" reads, "), mapped.cast("string"), F.lit(" mapped")),
        F.lit("\tP\tN"),
        F.concat_ws("\t", F.lit("T"), share("tp"), share("tn")),
        F.concat_ws("\t", F.lit("F"), share("fp"), share("fn")),
        F.concat(F.lit("NA: "), share("na")),
    ]
    lines += [F.concat(F.lit(f"{c}: "), F.format_string("%.6f", F.col(c).cast("double"))) for c in ("precision", "recall", "f1")]
    for c, name in (("bp_per_s", "BP per sec"), ("bp", "BP mapped"), ("ms", "MS to map")):
        if f"mean_{c}" in rates.columns:
            lines.append(F.concat(F.lit(f"{name}: "), F.format_string("%.2f", F.col(f"mean_{c}").cast("double")), F.lit(" "), F.format_string("%.2f", F.col(f"median_{c}").cast("double"))))
    return rates.select(F.col(key).alias("key"), F.posexplode(F.array(*lines)).alias("line_no", "value"))
