"""Text formats as typed DataFrames: event tables, models, k-mer tables, alignments, SLOW5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.signal import calibrated_by_range, in_band
from eventloom.operators.alignment import field
from eventloom.operators.model import Model


def _numbers(tokens: Column) -> Column:
    """The leading tokens that are finite numbers, as doubles."""
    values = F.transform(tokens, lambda t: F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")))
    first_bad = F.array_position(F.transform(values, lambda v: v.isNull()), True)
    return F.when(first_bad == 0, values).otherwise(F.slice(values, 1, F.greatest(first_bad - 1, F.lit(0)).cast("int")))


def parsed_events(lines: DataFrame) -> DataFrame:
    """Lines (value) of an event table as read_id, events: an id, then numbers up to the first other token. Empty lines are skipped."""
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.filter(F.length("value") > 0).withColumn("tokens", tokens)
    return rows.select(F.col("tokens")[0].alias("read_id"), _numbers(F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0)))).alias("events"))


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parsed_events(spark.read.text(path))


def parsed_model(value: str) -> Model:
    """The text of a model file: lines of means, variances, and transitions row by row."""
    lines = [[float(x) for x in line.split()] for line in value.splitlines() if line.strip()]
    if len(lines) < 3:
        raise ValueError("a model file has three lines")
    means, variances, flat = lines[:3]
    n = len(means)
    if len(flat) != n * n:
        raise ValueError(f"{n} states need {n * n} transitions")
    return Model(tuple(means), tuple(variances), tuple(tuple(flat[i * n : (i + 1) * n]) for i in range(n)))


def read_model(spark: SparkSession, path: str) -> Model:
    """A model file (see parsed_model()). One small row reaches the driver."""
    row = spark.read.text(path, wholetext=True).first()
    return parsed_model(row["value"] if row else "")


def kmer_rows(lines: DataFrame) -> DataFrame:
    """Lines (value) of a k-mer table as line_no, kmer, level, error: bad lines have an error and no k-mer. Comments and blank lines are left out.

    line_no rises in the order of a file's lines.
    """
    m = lambda k: F.regexp_extract("value", r"^\s*(\S{1,63})\s+([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", k)
    rows = lines.withColumn("line_no", F.monotonically_increasing_id()).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    rows = rows.select("line_no", m(1).alias("kmer"), m(2).try_cast("double").alias("level"))
    bad = F.col("level").isNull()
    return rows.select("line_no", F.when(~bad, F.col("kmer")).alias("kmer"), "level", F.when(bad, "bad line").alias("error"))


def parsed_kmers(lines: DataFrame) -> DataFrame:
    """The k-mers of a table's lines (see kmer_rows()) as line_no, kmer, level; bad lines are left out."""
    return kmer_rows(lines).filter("error is null").drop("error")


def first_k(parsed: DataFrame) -> int | None:
    """The length of a k-mer table's first k-mer, which is the table's k; none without k-mers."""
    row = parsed.agg(F.min_by(F.length("kmer"), "line_no").alias("k")).first()
    return row["k"]


def read_kmers(spark: SparkSession, path: str) -> DataFrame:
    return parsed_kmers(spark.read.text(path))


def parsed_alignments(lines: DataFrame) -> DataFrame:
    """Lines (value) of a PAF file as typed columns; comment and log lines and lines under 12 fields are left out.

    An unmapped row spans its whole query and has no reference. row_id rises in the order
    of a file's lines.
    """
    c = F.split(F.rtrim("value"), "\t")
    rows = lines.withColumn("row_id", F.monotonically_increasing_id()).filter(~F.col("value").rlike(r"^[#\[]")).withColumn("c", c).filter(F.size("c") >= 12)
    mapped = F.col("c")[4] != "*"
    number = lambda k: F.col("c")[k].try_cast("int")
    if_mapped = lambda x: F.when(mapped, x)
    return rows.select(
        "row_id",
        F.col("c")[0].alias("qr_name"),
        number(1).alias("qr_len"),
        mapped.alias("is_mapped"),
        F.when(mapped, number(2)).otherwise(1).alias("qr_st"),
        F.when(mapped, number(3)).otherwise(number(1)).alias("qr_en"),
        if_mapped(F.col("c")[4] == "+").alias("is_fwd"),
        if_mapped(F.col("c")[5]).alias("rf_name"),
        if_mapped(number(6)).alias("rf_len"),
        if_mapped(number(7)).alias("rf_st"),
        if_mapped(number(8)).alias("rf_en"),
        F.slice("c", 13, F.greatest(F.size("c") - 12, F.lit(0))).alias("tags"),
        F.col("value").alias("raw_line"),
    )


def read_alignments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parsed_alignments(spark.read.text(path))


def parsed_annotated(lines: DataFrame) -> DataFrame:
    """Lines (value) of an annotated PAF file: 20 fields are a mapped read, 15 an unmapped one, others are left out.

    Columns: is_mapped, label, ms, chunks, bases, from the tags in their places (mapped:
    mt, ci, sl at 13, 14, 15; unmapped: mt, ci, sl at 12, 13, then the label last).
    """
    rows = lines.withColumn("c", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).filter(F.size("c").isin(20, 15))
    named = lambda name: field(F.get(F.filter("c", lambda t: t.startswith(name)), F.lit(0)))
    return rows.select(
        (F.size("c") == 20).alias("is_mapped"),
        field(F.element_at("c", -1)).alias("label"),
        named("mt:f:").try_cast("double").alias("ms"),
        named("ci:i:").try_cast("double").alias("chunks"),
        named("sl:i:").try_cast("double").alias("bases"),
    )


def parsed_summary(lines: DataFrame) -> DataFrame:
    """Lines (value) of a printed report as name, number: the text before the first colon, the first number behind it."""
    m = lambda k: F.regexp_extract("value", r"^\s*([^:]+?)\s*:\s*[^0-9+-]*([+-]?[0-9]+(?:\.[0-9]+)?)", k)
    return lines.select(m(1).alias("name"), m(2).try_cast("double").alias("number")).filter("number is not null")


def slow5_rows(lines: DataFrame) -> DataFrame:
    """Lines (value, and what goes with them) of SLOW5 text: read_id, signal_pA, error, and the other columns.

    The columns are read_id, read_group, digitisation, offset, range, sampling_rate,
    len_raw_signal, raw_signal; lines that start with # or @ are headers. A line with
    fewer columns, or where one of the numbers is none, has an error instead of a read.
    """
    c = F.split("value", "\t")
    rest = [x for x in lines.columns if x != "value"]
    rows = lines.filter(~F.col("value").rlike("^[#@]") & (F.length("value") > 0)).select(*rest, c.alias("_c"))
    raw = F.transform(F.split(F.get("_c", F.lit(7)), ","), lambda x: x.try_cast("int"))
    number = lambda k: F.get("_c", F.lit(k)).try_cast("double")
    error = F.when(F.size("_c") < 8, "too few columns").when(number(2).isNull() | number(3).isNull() | number(4).isNull(), "calibration is no number")
    rows = rows.withColumns({"error": error, "signal_pA": in_band(calibrated_by_range(raw, number(2), number(3), number(4)))})
    whole = lambda x: F.when(F.col("error").isNull(), x)
    return rows.select(whole(F.get("_c", F.lit(0))).alias("read_id"), whole(F.col("signal_pA")).alias("signal_pA"), *rest, "error")


def parsed_slow5(lines: DataFrame) -> DataFrame:
    """The reads of SLOW5 lines (see slow5_rows()) as read_id, signal_pA: calibrated samples inside the band. Bad lines are left out."""
    return slow5_rows(lines.select("value")).filter("error is null").select("read_id", "signal_pA")


def read_borders(spark: SparkSession, path: str) -> DataFrame:
    """Predicted borders: read_id, event_start."""
    return spark.read.parquet(path).select("read_id", F.col("event_start").cast("int").alias("event_start"))
