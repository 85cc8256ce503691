"""What the corpus operators share: word and character expressions, written tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space between words, as characters and as a pattern.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \t-\r]+"

#: Bounds on what may be sent to every executor: rows, and bytes of their values.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64_000_000


def whole_text(text: str = "text") -> Column:
    """The text of a row; a null text counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text: maximal runs without white space, in order."""
    return F.array_remove(F.split(text, SPACE_RUN, -1), "")


def without_spaces(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and all tasks
    run in this process, as in tests on one machine, a folder of our own is made and set
    for the session; on a cluster such a folder would be another one on each machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("eventloom.shared.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("eventloom.shared.dir", named)
    return named.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/eventloom/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_shared(spark: SparkSession) -> None:
    """Delete all tables that this application has written in between; call it when results have been saved."""
    _delete(spark, _own_folder(spark))


def unused_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder for a new table."""
    return f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write a DataFrame as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without redoing the
    work before, and plans with the table's real size.
    """
    spark = df.sparkSession
    path = unused_path(spark, tag)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path  # for dropped()
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made and nothing reads any more."""
    for table in tables:
        path = getattr(table, "_written_at", None)
        if path:
            _delete(table.sparkSession, path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand tasks' Python code batches of at most so many rows: whole texts can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def value_bytes(df: DataFrame) -> Column:
    """About how many bytes a row's values take: texts, binaries and arrays by their length, other values 8."""
    sizes = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)) + 8)
        elif kind == "array<string>":
            sizes.append(F.coalesce(F.octet_length(F.array_join(c, "")), F.lit(0)) + 8 * F.greatest(F.size(c), F.lit(1)))
        elif kind.startswith("array"):
            sizes.append(8 + 8 * F.greatest(F.size(c), F.lit(0)))
        else:
            sizes.append(F.lit(8))
    total = sizes[0]
    for size in sizes[1:]:
        total = total + size
    return total.cast("long")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a side of a join for broadcast if it has at most so many rows and bytes of values.

    Both are measured first, as one partial aggregate over the narrow side; a larger one
    stays as it is and the join shuffles, where adaptive execution splits the skewed
    partitions.
    """
    n, taken = df.agg(F.count("*"), F.coalesce(F.sum(value_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and taken <= size else df


def input_bytes(df: DataFrame) -> int:
    """The size of what a DataFrame reads, as the optimizer estimates it from the files; 0 if it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that hands freed memory back to the system after each batch: its process lives on and runs other tasks."""

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            give_back()
        give_back()

    return batches_of


def numbered(df: DataFrame, order: list[Column], name: str, tag: str) -> DataFrame:
    """Number all rows from 0 in the given order: ranges are numbered apart and start behind the ones before.

    The window over the ranges' sizes sees one row per range.
    """
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), tag)
    sizes = parts.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_place", place).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_start", "_place")


def placed(df: DataFrame, group: str, order: list[Column], tag: str) -> DataFrame:
    """Number the rows of each group from 0 in the given order (place); group_rows is the group's number of rows.

    Ranges of (group, order) are sorted apart, so no group has to fit in a task. A row's
    number in its range is part of its id there, whose upper bits are the range's; a window
    over the ranges' sizes puts each range behind the ones before.
    """
    dealt = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    ranges = written(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33).cast("int")), tag)
    sizes = ranges.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(sizes.select(group, "_part", "_first", before.alias("_before"), F.sum("_n").over(own).alias("group_rows")), f"{tag}-starts")
    return ranges.join(small_side(starts), [group, "_part"]).withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")
