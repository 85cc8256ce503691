"""Signal files by extension: SLOW5 text through Spark, BLOW5 and POD5 as data sources, other formats through their libraries."""

from __future__ import annotations

import importlib
import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.signal import BAND
from eventloom.sources import binary
from eventloom.sources.text import slow5_rows

SCHEMA = "read_id string, signal_pA array<double>"
Reads = Iterator[tuple[str, np.ndarray]]


def _kept(raw: np.ndarray, offset: float, scale: float) -> np.ndarray:
    x = (raw.astype(float) + offset) * scale
    return x[(x > BAND[0]) & (x < BAND[1])]


def _need(name: str, what: str):
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise ImportError(f"reading {what} files needs the {name} library") from e


def fast5_reads(data: bytes) -> Reads:
    """Single-read files keep the signal under Raw/Reads, others one group read_* per read; groups that can't be read are skipped."""
    h5py = _need("h5py", "FAST5")
    text = lambda v: v.decode() if isinstance(v, bytes) else str(v)
    with h5py.File(io.BytesIO(data), "r") as f:
        single = "Raw" in f
        groups = [("Raw/Reads/" + name, f["Raw/Reads"][name], f["UniqueGlobalKey/channel_id"]) for name in f["Raw/Reads"]] if single else [(name, f[name]["Raw"], f[name]["channel_id"]) for name in f if name.startswith("read_") and "Raw" in f[name] and "channel_id" in f[name]]
        for name, group, channel in groups:
            try:
                at = channel.attrs
                yield text(group.attrs.get("read_id", name)), _kept(group["Signal"][:], float(at["offset"]), float(at["range"]) / float(at["digitisation"]))
            except KeyError:
                continue


#: Formats that a library reads, by extension: what makes reads of a file's bytes. Others may be added.
BINARY: dict[str, Callable[[bytes], Reads]] = {"fast5": fast5_reads}
#: Formats that are data sources of this library.
SOURCES = ("blow5", "pod5")


def _parts(reads: Reads, rows: int = 1000, samples: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Reads as tables of bounded size."""
    held, size = [], 0
    for read in reads:
        held.append(read)
        size += len(read[1])
        if len(held) >= rows or size >= samples:
            yield pd.DataFrame(held, columns=["read_id", "signal_pA"])
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=["read_id", "signal_pA"])


def _by_library(spark: SparkSession, path: str, kind: str, strict: bool) -> DataFrame:
    """The reads of files of a kind in BINARY: columns as in binary.SCHEMA but for file_no; whole tables of reads before the first bad one of a file, which has a row with an error."""
    reads = BINARY[kind]
    files = spark.read.format("binaryFile").load(path)
    files = files.filter(F.lower("path").endswith(f".{kind}")).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                place = 0
                try:
                    for part in _parts(reads(bytes(data))):
                        yield part.assign(file=name, place=range(place, place + len(part)), error=None)
                        place += len(part)
                except Exception as e:
                    if strict:
                        raise
                    yield pd.DataFrame({"read_id": [None], "signal_pA": [None], "file": [name], "place": [place], "error": [f"{type(e).__name__}: {e}"]})

    return files.mapInPandas(run, f"{SCHEMA}, file string, place long, error string")


def _rows(spark: SparkSession, path: str, kind: str, strict: bool = False) -> DataFrame:
    """What files of a kind hold: read_id, signal_pA, file, place, error. strict: an error stops the job, but for SLOW5 lines."""
    if kind == "slow5":
        lines = spark.read.text(path) if path.lower().endswith(".slow5") else spark.read.option("pathGlobFilter", "*.[sS][lL][oO][wW]5").text(path)
        return slow5_rows(lines.select("value", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"), F.monotonically_increasing_id().alias("place")))
    if kind in SOURCES:
        binary.register(spark)
        return spark.read.format(kind).option("mode", "failfast" if strict else "permissive").load(path).drop("file_no")
    if kind in BINARY:
        return _by_library(spark, path, kind, strict)
    raise ValueError(f"unknown signal format: {kind}")


def read_signals(spark: SparkSession, path: str, kind: str, strict: bool = True, required: bool = False) -> DataFrame:
    """The reads of a file, or of all files of a kind in a folder (not in folders below): read_id, signal_pA.

    strict=False leaves out what can't be read (scan() tells what that was); else it is an
    error, but for lines of SLOW5 text with too few columns. required raises an error if
    there is no file of the kind.
    """
    kind = kind.lower().lstrip(".")
    rows = _rows(spark, path, kind, strict)
    if required and not binary.listed(path, f".{kind}"):
        raise FileNotFoundError(f"no {kind} file in {path}")
    return rows.filter("error is null").select("read_id", "signal_pA")


def scan(spark: SparkSession, path: str, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """All signal files of a folder, or one file, whatever their formats: reads (file_no, place, read_id, signal_pA) and rejects (file_no, file, reason, n).

    file_no counts the files by path from 0 and place rises in each, so that the two order
    the reads as the files do. rejects counts by reason what could not be read: a whole
    file, a record, a line. whole_files leaves out all reads of a file of which a part
    could not be read, but for SLOW5 and BLOW5 files. A folder without signal files gives
    empty tables; a missing one is an error.
    """
    kinds = ("slow5", *SOURCES, *BINARY)
    files = binary.listed(path, *(f".{k}" for k in kinds))
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")  # noqa: E731  # readers differ in how they write local paths
    numbers = spark.createDataFrame([(k, re.sub("^[a-z0-9]+:/+", "/", name)) for k, (name, _) in enumerate(files)], "file_no int, _name string")
    out = spark.createDataFrame([], f"{SCHEMA}, file string, place long, error string")
    for kind in kinds:
        if any(name.lower().endswith(f".{kind}") for name, _ in files):
            out = out.unionByName(_rows(spark, path, kind))
    rows = out.withColumn("_name", bare("file")).join(numbers, "_name", "left").drop("_name")
    bad = rows.filter("error is not null")
    good = rows.filter("error is null")
    if whole_files:
        broken = bad.filter(~F.lower("file").rlike("\\.(slow5|blow5)$")).select("file_no").distinct()
        good = good.join(broken, "file_no", "left_anti")
    return good.select("file_no", "place", "read_id", "signal_pA"), bad.groupBy("file_no", "file", F.col("error").alias("reason")).agg(F.count("*").alias("n"))
