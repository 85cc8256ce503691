"""K-mers: de Bruijn texts, sliding windows, level lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASES = "ACGT"
#: Letters whose windows are counted at once.
LETTERS = 4_000_000


def de_bruijn(k: int) -> str:
    """A shortest text that has every k-mer once, the least one in the order of BASES.

    Going around, it is made of the Lyndon words whose length divides k, in order: of each
    k-mer that is the least of its rotations, the letters up to where it repeats.
    """
    code = np.arange(4**k)
    least, period = np.ones(len(code), bool), np.full(len(code), k)
    for j in range(k - 1, 0, -1):
        turned = (code << 2 * j | code >> 2 * (k - j)) & (4**k - 1)
        least &= code <= turned
        period[turned == code] = j
    letters = code[least, None] >> 2 * np.arange(k - 1, -1, -1) & 3
    around = np.array(list(BASES))[letters[np.arange(k) < period[least, None]]]
    return "".join([*around, *around[: k - 1]])


def sliding(texts: DataFrame, text: str, k: int) -> DataFrame:
    """Each k-mer of each text with its place: the columns of texts, t, kmer.

    A text is cut into letters once, and windows are slices of that array: places in a
    long string would be counted from its start each time.
    """

    def windows(letters: Column) -> Column:
        n = F.size(letters)
        of = F.transform(F.sequence(F.lit(0), n - k), lambda t: F.array_join(F.slice(letters, t + 1, k), ""))
        return F.when(n >= k, of).otherwise(F.array().cast("array<string>"))

    letters = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), ""), "")
    return texts.select("*", F.posexplode(F.transform(F.array(letters), windows)[0]).alias("t", "kmer"))


def coded(kmer: Column, k: int) -> Column:
    """A k-mer as a number, two bits a base; null for other texts."""
    return F.when(kmer.rlike(f"^[{BASES}]{{{k}}}$"), F.conv(F.translate(kmer, BASES, "0123"), 4, 10).cast("long"))


def counted(texts: DataFrame, text: str, k: int) -> DataFrame:
    """How often each k-mer occurs in each text of the letters A, C, G, T: the other columns of texts, code (see coded()), n.

    Windows with other letters are left out, null texts have none; k is 31 at most. A task
    turns letters into numbers and counts them, so k-mers leave it as one row each.
    """
    if not 0 < k < 32:
        raise ValueError("k must be from 1 to 31")
    codes = np.full(256, 4, np.int64)
    codes[np.frombuffer(BASES.encode(), np.uint8)] = np.arange(4)

    def counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of texts, their k-mers and the numbers of these."""
        sizes = pc.binary_length(column).to_numpy()
        ends = np.cumsum(sizes)
        letters = codes[np.frombuffer(b"".join(column.to_pylist()), np.uint8)]
        m = len(letters) - k + 1
        if m < 1:
            return (np.zeros(0, np.int64),) * 3
        windows, bad = np.zeros(m, np.int64), np.zeros(m, bool)
        for i in range(k):
            windows = windows << 2 | letters[i : i + m] & 3
            bad |= letters[i : i + m] > 3
        of = np.repeat(np.arange(len(sizes)), sizes)[:m]
        whole = ~bad & (np.arange(m) + k <= ends[of])
        of, windows = of[whole], windows[whole]
        order = np.lexsort((windows, of))
        of, windows = of[order], windows[order]
        starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (windows[1:] != windows[:-1])]) if len(of) else np.zeros(0, np.int64)
        return of[starts], windows[starts], np.diff(np.r_[starts, len(of)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = pc.binary_length(column).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // LETTERS)) + 1  # a longer text is one part
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                of, windows, n = counts(column.slice(a, b - a))
                own = batch.slice(a, b - a).take(pa.array(of)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*own, pa.array(windows, pa.int64()), pa.array(n, pa.int64())], names=[*names, "code", "n"])

    names = [c for c in texts.columns if c != text]
    rows = texts.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_letters"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in texts.dtypes if c != text), "code long", "n long"])
    return rows.mapInArrow(run, schema)


def levels(kmers: DataFrame, table: DataFrame, missing: float = 0.0) -> DataFrame:
    """k-mers with their level; those that the table (kmer, level) lacks get `missing`. The join strategy is left to the size of the table."""
    return kmers.join(table, "kmer", "left").withColumn("level", F.coalesce("level", F.lit(missing)))


def last_wins(table: DataFrame) -> DataFrame:
    """A k-mer table (line_no, kmer, level) with the last line of each k-mer."""
    return table.groupBy("kmer").agg(F.max_by("level", "line_no").alias("level"))


def observations(spark: SparkSession, table: DataFrame, k: int, chunks: int = 1) -> DataFrame:
    """The levels along the de Bruijn text of k: t, kmer, level, chunk.

    Places are dealt over tasks and cut from the text, which each task has; there are 4 ** k
    of them, so their chunk (see chunked()) follows from the place alone.
    """
    shared = spark.sparkContext.broadcast(de_bruijn(k))
    n = 4**k
    base, extra = divmod(n, chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([shared.value[t : t + k] for t in places])], names=["t", "kmer"])

    t = F.col("t")
    long_rows = extra * (base + 1)
    chunk = F.when(t < long_rows, F.floor(t / (base + 1))).otherwise(extra + F.floor((t - long_rows) / max(base, 1))).cast("int")
    return levels(spark.range(n).mapInArrow(run, "t int, kmer string"), table).withColumn("chunk", chunk)


def chunked(signal: DataFrame, chunks: int) -> DataFrame:
    """Contiguous chunks of each read, the first ones longer by one if the rows don't divide evenly: adds chunk."""
    n = F.count("*").over(Window.partitionBy("read_id"))
    base, extra = F.floor(n / chunks), F.pmod(n, F.lit(chunks))
    long_rows = extra * (base + 1)
    i = F.col("idx")
    chunk = F.when(i < long_rows, F.floor(i / (base + 1))).otherwise(extra + F.floor(F.try_divide(i - long_rows, base)))
    return signal.withColumn("chunk", chunk.cast("int"))
