"""Alignments scored against a ground truth: labels, rates, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.signal import extended, tag

LABELS = ("tp", "fp", "fn", "tn", "na")


def _intervals(df: DataFrame, factor: float) -> DataFrame:
    low, high = extended(F.col("rf_st"), F.col("rf_en"), F.col("qr_st"), F.col("qr_en"), F.col("qr_len"), F.col("rf_len"), F.col("is_fwd"), factor)
    return df.withColumns({"low": low, "high": high})


def united(intervals: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """Closed intervals of each group joined where they meet: by, low, high, apart from each other and ascending.

    A sweep: in the order of low, an interval begins a new one where all before it end
    below it; what it begins takes the largest end of those that follow.
    """
    group = Window.partitionBy(*by).orderBy(low, high)
    ends = F.max(high).over(group.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(ends.isNull() | (ends < F.col(low)), 1).otherwise(0)
    numbered = intervals.filter(F.col(low) <= F.col(high)).withColumn("_new", begins).withColumn("_no", F.sum("_new").over(group.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_no").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_no")


def overlapping(query: DataFrame, truth: DataFrame, by: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """The query rows whose closed interval meets one of the truth's with the same key, each once; rows with a null key or an empty interval meet none.

    Truth intervals are united first, so that of those which begin before a query interval
    ends only the last can meet it. Both sides lie in one sequence by place (a truth's
    low, a query's high; truth first where equal), and a running maximum carries the last
    truth's end: one sort of both sides, however many rows a key has.
    """
    for c in by:
        query, truth = query.filter(F.col(c).isNotNull()), truth.filter(F.col(c).isNotNull())
    t = united(truth.select(*by, low, high), by, low, high)
    row = F.struct(*query.columns)
    both = query.filter(F.col(low) <= F.col(high)).select(*by, F.col(high).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(dict(t.dtypes)[high]).alias("_end"), row.alias("_row"))
    both = both.unionByName(t.select(*by, F.col(low).alias("_at"), F.lit(0).alias("_side"), F.col(high).alias("_end")), allowMissingColumns=True)
    last = F.max("_end").over(Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_end", last).filter((F.col("_side") == 1) & (F.col("_end") >= F.col(f"_row.{low}"))).select("_row.*")


def labelled(query: DataFrame, truth: DataFrame, factor: float = 1.5) -> DataFrame:
    """query rows with a label: how a mapping compares with the truth rows of the same read.

    Mapped: na if the read has no truth row or its first one is unmapped, tp if any truth
    row on the same reference overlaps (closed intervals, both stretched by factor), else
    fp. Unmapped: fn if the first truth row is mapped, else tn. Both sides have row_id,
    which orders truth rows and tells query rows of one name apart.

    The truth's first rows are one partial aggregate; whether any overlaps is found by a
    sweep over both sides (see overlapping()), not by pairs.
    """
    first = truth.groupBy("qr_name").agg(F.min_by("is_mapped", "row_id").alias("truth_mapped"))
    t = _intervals(truth.filter("is_mapped"), factor).select("qr_name", "rf_name", "low", "high")
    q = _intervals(query.filter("is_mapped"), factor).select("row_id", "qr_name", "rf_name", "low", "high")
    hits = overlapping(q, t, ["qr_name", "rf_name"]).select("row_id").distinct().withColumn("hit", F.lit(True))
    known, hit = F.coalesce("truth_mapped", F.lit(False)), F.coalesce("hit", F.lit(False))
    label = F.when(~F.col("is_mapped"), F.when(known, "fn").otherwise("tn")).when(~known, "na").when(hit, "tp").otherwise("fp")
    return query.join(first, "qr_name", "left").join(hits, "row_id", "left").withColumn("label", label).drop("truth_mapped", "hit").select(*query.columns, "label")


def confusion(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of each label and of all rows, by the given columns."""
    counts = [F.count_if(F.col("label") == x).alias(f"n_{x}") for x in LABELS]
    return labels.groupBy(*(by or [])).agg(F.count("*").alias("n"), *counts)


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rates(counts: DataFrame, na_is_fp: bool = False, rounded: bool = False) -> DataFrame:
    """Percentages of each label, and precision, recall and F1, 0 where undefined.

    na_is_fp counts mappings without a truth as false positives. rounded derives the
    scores from percentages with two decimals, as a printed report would.
    """
    out = counts.withColumns({f"pct_{x}": F.round(_share(100.0 * F.col(f"n_{x}"), F.col("n")), 2) for x in LABELS})
    value = lambda x: F.col(f"pct_{x}" if rounded else f"n_{x}").cast("double")
    fp = value("fp") + value("na") if na_is_fp else value("fp")
    out = out.withColumns({"precision": _share(value("tp"), value("tp") + fp), "recall": _share(value("tp"), value("tp") + value("fn"))})
    return out.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


#: What throughput() averages: bases per second, bases, milliseconds.
TIMED = ("bp_per_s", "bp", "ms")


def throughput(query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and exact median of bases per second, bases, and milliseconds of mapped rows that have a mt:f: tag."""
    ms = F.try_divide(F.col("mt"), F.lit(1.0))
    rows = query.filter("is_mapped").withColumn("mt", tag(F.col("tags"), "mt:f:").cast("double")).filter("mt is not null")
    rows = rows.select(*(by or []), F.col("qr_en").cast("double").alias("bp"), ms.alias("ms"), F.try_divide(1000.0 * F.col("qr_en"), F.col("mt")).alias("bp_per_s"))
    means = [F.avg(c).alias(f"mean_{c}") for c in TIMED]
    return with_medians(rows, rows.groupBy(*(by or [])).agg(F.count("*").alias("n_timed"), *means), list(TIMED), by)


#: Accuracy of the sketches that bracket a value, and most distinct values that one task puts in order.
ACCURACY, SORTED = 10_000, 200_000


def selected(rows: DataFrame, columns: list[str], accuracy: int = ACCURACY, most: int = SORTED) -> DataFrame:
    """Exact medians of columns of doubles over all rows, by narrowing: one row with median_<column>, null if there are no values.

    A round sketches quantiles of the values that may still be a median, which gives two
    values with the median between them, since a sketch's error in rank is bounded; then
    it counts what lies below and inside. Rounds end when few distinct values are left or
    none are dropped any more. Each round is two partial aggregates and cuts the values by
    about accuracy / 6; one row a round reaches the driver.
    """
    found = {}
    for c in columns:
        v = F.col(c).cast("double").alias("v")
        counts = rows.select(v).filter("v is not null")
        lo = hi = None
        below, n = 0, None
        while True:
            inside = counts if lo is None else counts.filter((F.col("v") >= lo) & (F.col("v") <= hi))
            if n is None:
                n = inside.count()
                if not n:
                    found[c] = None
                    break
            low, high = (n + 1) // 2, n // 2 + 1  # places of the two middle values, from 1
            size, distinct = inside.agg(F.count("*"), F.approx_count_distinct("v")).first()
            if distinct <= most:
                ordered = inside.groupBy("v").count().withColumn("upto", below + F.sum("count").over(Window.orderBy("v")))  # at most about `most` rows
                holds = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("count") < k)  # noqa: B023, E731
                a, b = ordered.filter(holds(low) | holds(high)).agg(F.min("v"), F.max("v")).first()
                found[c] = (a + b) / 2
                break
            around = [max(0.0, (low - below) / size - 2 / accuracy), min(1.0, (high - below) / size + 2 / accuracy)]
            lo, hi = inside.agg(F.percentile_approx("v", around, accuracy)).first()[0]
            below += inside.filter(F.col("v") < lo).count()
    return rows.sparkSession.createDataFrame([tuple(found[c] for c in columns)], ", ".join(f"`median_{c}` double" for c in columns))


def medians(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Exact medians of columns of doubles, null if there are no values: by, median_<column>.

    Of groups, values are counted first, in parallel, so that only distinct ones are put in
    order, by a sort that can spill; no buffer holds a group. All rows together: see selected().
    """
    if not by:
        return selected(rows, columns)
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")
    counts = rows.select(*by, named).filter("s.v is not null").groupBy(*by, F.col("s.name").alias("name"), F.col("s.v").alias("v")).count()
    group = Window.partitionBy(*by, "name")
    placed = counts.withColumns({"upto": F.sum("count").over(group.orderBy("v")), "n": F.sum("count").over(group)})
    # the places of the two middle values, from 1; they are one if the count is odd
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("count") < k)
    middle = placed.filter(holds(low) | holds(high))
    value = lambda c: ((F.min(F.when(F.col("name") == c, F.col("v"))) + F.max(F.when(F.col("name") == c, F.col("v")))) / 2).alias(f"median_{c}")
    return middle.groupBy(*by).agg(*[value(c) for c in columns])


def with_medians(rows: DataFrame, stats: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """stats (a row for each value of by) with the medians of columns of rows."""
    own = medians(rows, columns, by)
    if not by:  # a row each
        return stats.withColumn("_one", F.lit(1)).join(own.withColumn("_one", F.lit(1)), "_one").drop("_one")
    for c in by:
        own = own.withColumnRenamed(c, f"_{c}")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return stats.join(own, same, "left").drop(*[f"_{c}" for c in by])


def field(column: Column) -> Column:
    """The value of a tag such as mt:f:12.5."""
    return F.split_part(column, F.lit(":"), F.lit(3))


def read_costs(annotated: DataFrame) -> DataFrame:
    """Means over annotated rows (is_mapped, bases, chunks, ms), mapped and unmapped together; null if there are none."""
    return with_medians(annotated, annotated.agg(*[F.avg(c).alias(f"mean_{c}") for c in ("ms", "bases", "chunks")]), ["ms"])
