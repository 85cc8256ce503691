"""Forward-backward in bounded memory and over few transitions."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import training


def graph(n):
    """A chain of states with four successors each, as k-mers have."""
    trans = np.zeros((n, n))
    for p in range(n):
        trans[p, (4 * p + np.arange(4)) % n] = np.array([0.1, 0.2, 0.3, 0.4])
    return np.linspace(-2, 2, n), np.full(n, 0.1), trans


@pytest.mark.parametrize("n", [2, 16, 128])
def test_stretches_and_few_transitions_change_no_sum(monkeypatch, n):
    rng = np.random.default_rng(n)
    args = graph(n) if n > 2 else (np.array([-1.0, 1.0]), np.array([0.5, 0.5]), np.array([[0, 1.0], [1.0, 0]]))
    xs = [rng.normal(size=k) for k in (0, 1, 300, 37, 200, 36, 1, 64)]
    whole = training.expected(xs, *args)
    assert training.Moves(args[2]).sparse == (n == 128)
    for cells in (1, 50 * n, 1000 * n):
        assert all(np.allclose(a, b) for a, b in zip(whole, training.expected(xs, *args, cells=cells)))
    monkeypatch.setattr(training, "SPARSE", 0 if n < 128 else 10**9)
    assert all(np.allclose(a, b) for a, b in zip(whole, training.expected(xs, *args)))


def test_states_without_ways(monkeypatch):
    trans = np.array([[0, 1.0, 0], [0, 0, 0], [1.0, 0, 0]])
    x = [np.array([0.0, 1.0]), np.array([2.0])]
    args = np.array([0.0, 1.0, 2.0]), np.full(3, 0.1), trans
    dense = training.expected(x, *args)
    monkeypatch.setattr(training, "SPARSE", 0)
    assert all(np.allclose(a, b) for a, b in zip(dense, training.expected(x, *args)))
    none = training.expected(x[1:], *args[:2], np.zeros((3, 3)))
    assert not none[0].any() and np.isclose(none[1].sum(), 1)


def test_a_long_chunk_takes_two_stretches():
    means, variances, trans = graph(64)
    x = np.random.default_rng(1).normal(size=40_000)
    tracemalloc.start()
    training.expected([x], means, variances, trans)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # three arrays of places x states would be 61 MB


def test_many_means_in_few_jobs(spark):
    """128 groups of values, each with a mean of its own, and jobs that don't grow with their number."""
    rows = spark.range(128 * 40).select((F.pmod("id", F.lit(128)) * 100.0 + F.pmod(F.floor(F.col("id") / 128), F.lit(7)) * 0.1).alias("x"), F.lit(1).cast("long").alias("m")).groupBy("x").agg(F.sum("m").alias("m"))
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    means = training.spread_means(rows, 128, seed=1)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    jobs, before = (int(str(x)) for x in (jobs, before))
    assert len(means) == len(set(means)) == 128 and {r["x"] for r in rows.collect()} >= set(means)
    assert len({round(m / 100) for m in means}) > 110
    assert jobs - before <= 20  # adaptive execution makes a job of each stage
    assert training.spread_means(rows, 128, seed=1) == means


def test_few_values_and_their_nearest(spark):
    rows = spark.createDataFrame([(1.0, 3), (5.0, 1), (9.0, 2)], "x double, m long")
    assert sorted(training.spread_means(rows, 5)) == [1.0, 5.0, 9.0]
    got = {r["x"]: (r["place"], r["near"]) for r in training.nearest(rows, [1.0, 9.0]).collect()}
    assert got == {1.0: (0, 0.0), 5.0: (0, 16.0), 9.0: (1, 0.0)}
    means, _, _ = training.mixture(rows, "x", 2, rounds=3, seeding="oversampled")
    assert len(means) == 2
