"""Samples on a limit, and repeated ones, fall to the side they fall to in SQL."""

import math
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from eventloom import catalog
from eventloom.operators import frames, segment

from conftest import same_rows


def lineitem(folder, reads):
    """Reads as a lineitem table: its folder, and a database that knows it."""
    rows = [(read, place, float(x)) for read, samples in enumerate(reads) for place, x in enumerate(samples)]
    read, place, price = zip(*rows)
    places = pa.array(place, pa.int64())
    names = ["l_suppkey", "l_orderkey", "l_partkey", "l_shipdate", "l_linenumber", "l_extendedprice"]
    table = pa.table([pa.array(read, pa.int64()), places, places, places, pa.array([1] * len(rows), pa.int32()), pa.array(price)], names)
    pq.write_table(table, folder / "lineitem.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return str(folder), db


def whole_numbers(seed, reads=12, size=150):
    """Levels with small steps around them, all whole numbers, so that samples lie on the limits of their segment's middle."""
    rng = np.random.default_rng(seed)
    levels = [np.repeat(rng.integers(2, 15, size // 15 + 1) * 10, rng.integers(8, 26, size // 15 + 1))[:size] for _ in range(reads)]
    return [level + rng.integers(-4, 5, len(level)) for level in levels]


@pytest.mark.parametrize("seed", [0, 4])
def test_segment_v2_with_samples_on_limits(spark, tmp_path, seed):
    sf, db = lineitem(tmp_path, whole_numbers(seed))
    same_rows(catalog.QUERIES["segment_v2"](spark, sf).toPandas(), db.sql(catalog.ORACLES["segment_v2"]).df())


def test_spreads():
    reads = [np.random.default_rng(n).normal(80, 5, n) for n in (1, 400, 0, 70, 3)] + [np.full(50, 0.1)]
    for x, (mean, spread) in zip(reads, segment.spreads(reads)):
        total, center, squares = 0.0, 0.0, 0.0
        for n, v in enumerate(x.tolist(), 1):
            off = v - center
            total, center = total + v, center + off / n
            squares += (v - center) * off
        assert (mean, spread) == ((total / len(x), math.sqrt(squares / len(x))) if len(x) else (0.0, 0.0))


def repeats(seed, reads=12, size=150):
    """Samples that come four to eight times in a row, so that windows hold one value only."""
    rng = np.random.default_rng(seed)
    return [np.repeat(rng.integers(3000, 20000, size // 6) / 100, rng.integers(4, 9, size // 6))[:size] for _ in range(reads)]


@pytest.mark.parametrize("made", [whole_numbers, repeats])
def test_segment_v2_r10_with_repeated_samples(spark, tmp_path, made):
    sf, db = lineitem(tmp_path, made(1))
    same_rows(catalog.QUERIES["segment_v2_r10"](spark, sf).toPandas(), db.sql(catalog.ORACLES["segment_v2_r10"]).df())


@pytest.mark.parametrize("width", [3, 6, 9])
def test_t_statistic_equals_frames(spark, width):
    reads = [*repeats(2, 3), *whole_numbers(2, 3)]
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in enumerate(reads) for i, v in enumerate(x)], "read_id long, idx int, x double")
    want = [r["t"] for r in frames.t_statistic(rows, width).orderBy("read_id", "idx").collect()]
    assert np.concatenate([segment.t_statistic(np.asarray(x, float), width) for x in reads]).tolist() == want


@pytest.mark.parametrize("made, seed", [(whole_numbers, 1), (whole_numbers, 4), (repeats, 0)])
def test_sql_functions_add_rounded_events(spark, tmp_path, made, seed):
    sf, db = lineitem(tmp_path, made(seed))
    same_rows(catalog.QUERIES["sql_functions"](spark, sf).toPandas(), db.sql(catalog.ORACLES["sql_functions"]).df())


def test_sql_functions_round_the_exact_total(spark, tmp_path):
    """One of these totals ends in half a digit, where a sum of doubles is rounded by its order; half goes away from 0."""
    sf, db = lineitem(tmp_path, repeats(11))
    sums = {}
    for read, _, event in db.sql(catalog.ORACLES["segment_v2"]).fetchall():
        sums[read] = sums.get(read, 0) + Decimal(repr(event))
    assert sum(abs(s) * 10**6 % 100 == 50 for s in sums.values()) == 1
    got = {r["read_id"]: r["total"] for r in catalog.QUERIES["sql_functions"](spark, sf).collect()}
    assert got == {read: float(s.quantize(Decimal("0.0001"), ROUND_HALF_UP)) for read, s in sums.items()}
