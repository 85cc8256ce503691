import statistics

import pytest
from pyspark.sql import functions as F

from eventloom.functions.signal import extended
from eventloom.operators import alignment
from eventloom.sources import sinks, text

COLS = "row_id long, qr_name string, qr_len int, is_mapped boolean, qr_st int, qr_en int, is_fwd boolean, rf_name string, rf_len int, rf_st int, rf_en int"


def row(i, name, mapped=True, ref="c1", st=100, en=200):
    return (i, name, 1000, mapped, 0, 1000, True, ref if mapped else None, 5000, st if mapped else None, en if mapped else None)


@pytest.mark.parametrize("fwd, st, en, expected", [(True, 1100, 1900, (950, 2200)), (False, 1100, 1900, (800, 2050)), (True, 100, 4900, (1, 5000))])
def test_extended(spark, fwd, st, en, expected):
    low, high = extended(*map(F.lit, (st, en, 100, 800, 1000, 5000, fwd)), 1.5)
    assert tuple(spark.range(1).select(low, high).first()) == expected


def test_labels(spark):
    query = spark.createDataFrame([row(1, "none"), row(2, "first_unmapped"), row(3, "hit"), row(4, "other_ref"), row(5, "touch", en=300), row(6, "none", False), row(7, "hit", False), row(8, "hit")], COLS)
    truth = spark.createDataFrame([row(1, "first_unmapped", False), row(2, "first_unmapped"), row(3, "hit", st=2000, en=2100), row(4, "hit", st=150, en=160), row(5, "other_ref", ref="c2"), row(6, "touch", st=300, en=400)], COLS)
    got = {r["row_id"]: r["label"] for r in alignment.labelled(query, truth).collect()}
    assert got == {1: "na", 2: "na", 3: "tp", 4: "fp", 5: "tp", 6: "tn", 7: "fn", 8: "tp"}


def test_rates(spark):
    labels = spark.createDataFrame([(x,) for x in ["tp"] * 8 + ["fp", "na", "fn", "fn"]], "label string")
    counts = alignment.confusion(labels)
    assert alignment.rates(counts).first()["precision"] == pytest.approx(8 / 9)
    assert alignment.rates(counts, na_is_fp=True).first()["precision"] == pytest.approx(0.8)
    assert alignment.rates(counts).first()["recall"] == pytest.approx(0.8)
    assert alignment.rates(counts, rounded=True).first()["precision"] == pytest.approx(66.67 / (66.67 + 8.33))
    assert alignment.rates(alignment.confusion(labels.limit(0))).first()["f1"] == 0


def test_throughput(spark):
    rows = spark.createDataFrame([(True, 100, ["mt:f:2.0"]), (True, 300, ["xx", "mt:f:4.0"]), (False, 9, ["mt:f:1"]), (True, 9, [])], "is_mapped boolean, qr_en int, tags array<string>")
    got = alignment.throughput(rows).first()
    assert (got["n_timed"], got["mean_bp_per_s"], got["median_bp_per_s"]) == (2, 62500.0, 62500.0)


def test_alignment_lines(spark):
    lines = ["#x", "[log] y", "too\tshort", "r1\t1000\t10\t900\t-\tc1\t5000\t100\t200\t5\t6\t60\tmt:f:1.5", "r2\t700\t*\t*\t*\t*\t*\t*\t*\t0\t0\t0"]
    rows = text.parsed_alignments(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("row_id").collect()
    assert [(r["qr_name"], r["is_mapped"], r["qr_st"], r["qr_en"], r["is_fwd"], r["rf_name"], r["tags"]) for r in rows] == [("r1", True, 10, 900, False, "c1", ["mt:f:1.5"]), ("r2", False, 1, 700, None, None, [])]
    out = sinks.annotated_lines(spark.createDataFrame([("a\tb", "tp")], "raw_line string, label string")).first()["value"]
    assert out == "a\tb\trf:Z:tp"


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [2.0, 2.0, 2.0, 9.0], [5.0, 1.0, 4.0, 4.0, -2.0], []])
def test_medians(spark, values):
    import statistics

    rows = spark.createDataFrame([(g, v, 1.0) for g in ("a", None) for v in [*values, None]], "g string, x double, y double")
    got = {r["g"]: (r["median_x"], r["median_y"]) for r in alignment.medians(rows, ["x", "y"], ["g"]).collect()}
    assert got == {g: (statistics.median(values) if values else None, 1.0) for g in ("a", None)}
    alone = alignment.with_medians(rows, rows.agg(F.count("*").alias("n")), ["x"]).first()
    assert alone["median_x"] == (statistics.median(values) if values else None) and alone["n"] == rows.count()


def test_f1_of_pairs(spark):
    from eventloom.plans import tuning

    truth = spark.createDataFrame([row(1, "a"), row(2, "b"), row(3, "c")], COLS)
    mapped = spark.createDataFrame([(0.1, 0.0, *row(1, "a")), (0.1, 0.0, *row(2, "b", st=4000, en=4100)), (0.1, 0.0, *row(3, "c", False)), (0.2, 0.0, *row(1, "a")), (0.2, 0.0, *row(2, "b"))], f"p_stay double, p_skip double, {COLS}")
    got = {r["p_stay"]: (r["n"], r["precision"], r["recall"], r["f1"]) for r in tuning.f1_scores(mapped, truth).collect()}
    assert got == {0.1: (3, 0.5, 0.5, 0.5), 0.2: (2, 1.0, 1.0, 1.0)}


@pytest.mark.parametrize("n", [1, 2, 999, 1000])
def test_medians_of_all_rows_by_narrowing(spark, n):
    """Few values may be sorted and the sketch is coarse, so several rounds are needed; ties, infinities and nulls are among the values."""
    x = F.when(F.col("id") % 50 == 7, None).when(F.col("id") % 101 == 3, float("inf")).when(F.col("id") % 5 == 0, 12.5).otherwise(F.pow(F.pmod(F.xxhash64("id"), F.lit(997)), F.lit(3.0)) - 4e8)
    rows = spark.range(1, n + 1).select(x.alias("x"), F.lit(None).cast("double").alias("y"), F.col("id").alias("z")).repartition(3)
    got = alignment.selected(rows, ["x", "y", "z"], accuracy=50, most=8).first()
    values = [r["x"] for r in rows.collect() if r["x"] is not None]
    assert got["median_x"] == statistics.median(values) and got["median_y"] is None and got["median_z"] == (n + 1) / 2


def test_overlaps_by_sweep(spark):
    """Against pairs: many intervals of one key, ends that touch, empty ones, null keys and repeated rows."""
    import random

    rng = random.Random(4)
    some = lambda n, step: [(k, rng.choice(["a", "a", "a", "b", None]), lo := rng.randrange(0, 4000), lo + rng.randrange(-3, step)) for k in range(n)]
    q, t = some(300, 9), some(200, 25)
    q += q[:5]
    columns = "row_id long, k string, low long, high long"
    got = alignment.overlapping(spark.createDataFrame(q, columns), spark.createDataFrame(t, columns), ["k"])
    want = [a for a in q if any(a[1] is not None and a[1] == b[1] and max(a[2], b[2]) <= min(a[3], b[3]) and a[2] <= a[3] and b[2] <= b[3] for b in t)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and 0 < len(want) < 300
    apart = [tuple(r) for r in alignment.united(spark.createDataFrame(t, columns).filter("k = 'a'"), ["k"], "low", "high").orderBy("low").collect()]
    assert all(a[2] < b[1] for a, b in zip(apart, apart[1:]))
    assert alignment.overlapping(spark.createDataFrame([], columns), spark.createDataFrame(t, columns), ["k"]).isEmpty()


def test_a_read_with_very_many_rows(spark):
    """A hundred thousand rows on both sides of one read and reference: no pairs are made."""
    at = spark.range(100_000).select(F.col("id").alias("row_id"), F.lit("r").alias("k"), (F.col("id") * 10).alias("low"), (F.col("id") * 10 + 9_000).alias("high"))
    far = at.select("row_id", "k", (F.col("low") + 900_000).alias("low"), (F.col("low") + 900_001).alias("high"))
    assert alignment.overlapping(far, at, ["k"]).count() == sum(k * 10 + 900_000 <= 99_999 * 10 + 9_000 for k in range(100_000))
