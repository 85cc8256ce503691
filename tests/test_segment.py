import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.functions import signal as sig
from eventloom.operators import frames, segment

from pyspark.sql import functions as F


def brute_t(x, w):
    n, out = len(x), np.zeros(len(x))
    for i in range(n):
        if n >= 2 * w and w <= i <= n - w:
            a, b = x[i - w : i], x[i : i + w]
            out[i] = abs(b.mean() - a.mean()) / np.sqrt(max(a.var() + b.var(), frames.LEAST_VARIANCE) / w)
    return out


@pytest.mark.parametrize("n", [0, 4, 6, 7, 40])
@pytest.mark.parametrize("w", [3, 6])
def test_t_statistic(spark, n, w):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(segment.t_statistic(x, w), brute_t(x, w), rtol=1e-6)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "read_id long, idx int, x double")
    assert np.allclose([r["t"] for r in frames.t_statistic(rows, w).orderBy("idx").collect()], brute_t(x, w), rtol=1e-6)


def brute_peaks(short, long, how):
    """The detectors' rule for one read, sample by sample."""
    found = []
    ds = [dict(c=short, w=how.short, limit=how.short_threshold, at=None, top=np.inf, sure=False, quiet=0), dict(c=long, w=how.long, limit=how.long_threshold, at=None, top=np.inf, sure=False, quiet=0)]
    for i in range(len(short)):
        for d in ds:
            if d["quiet"] >= i:
                continue
            v = d["c"][i]
            if d["at"] is None:
                if v < d["top"]:
                    d["top"] = v
                elif v - d["top"] > how.height:
                    d["top"], d["at"] = v, i
                continue
            if v > d["top"]:
                d["top"], d["at"] = v, i
            if d is ds[0] and d["top"] > d["limit"]:
                ds[1].update(quiet=d["at"] + how.short, at=None, top=np.inf, sure=False)
            if d["top"] - v > how.height and d["top"] > d["limit"]:
                d["sure"] = True
            if d["sure"] and i - d["at"] > d["w"] // 2:
                found.append(d["at"])
                d.update(at=None, top=v, sure=False)
    return found


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.floats(0, 12), st.floats(0, 12)), max_size=60), min_size=1, max_size=4), st.sampled_from(sorted(segment.PRESETS)))
def test_peaks(reads, preset):
    how = segment.PRESETS[preset]
    shorts, longs = ([np.array([p[k] for p in r]) for r in reads] for k in (0, 1))
    got = segment.peaks(shorts, longs, how)
    assert [g.tolist() for g in got] == [brute_peaks(s, long_, how) for s, long_ in zip(shorts, longs)]


@pytest.mark.parametrize("values, expected", [([1] * 7 + [100], 1.0), ([1, 2, 3, 4], 2.5), ([], 0.0), ([5], 5.0)])
def test_middle_mean(spark, values, expected):
    assert segment.middle_mean(np.array(values, float)) == expected
    row = spark.createDataFrame([(1, [float(v) for v in values])], "id int, s array<double>").select(sig.middle_mean(F.col("s")).alias("m")).first()
    assert row["m"] == expected


def test_steps_become_events():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 1, 40) for m in (60, 90, 70, 120)])
    how = segment.PRESETS["v1"]
    places = brute_peaks(brute_t(x, 3), brute_t(x, 6), how)
    edges = [0, *places[:-1], len(x)]  # the last peak opens no segment
    means = np.array([x[a:b].mean() for a, b in zip(edges[:-1], edges[1:])])
    assert np.allclose(segment.segmented([x], how)[0], (means - means.mean()) / means.std())
    how = segment.PRESETS["v2"]
    z = (x - x.mean()) / x.std()
    places = [0, *brute_peaks(brute_t(z, 3), brute_t(z, 9), how)]
    assert np.allclose(segment.segmented([x], how)[0], [segment.middle_mean(z[a:b]) for a, b in zip(places[:-1], places[1:])])
    assert segment.segmented([np.zeros(0), np.ones(50)], segment.PRESETS["v2"]) == [None, None]
    assert segment.segmented([x], segment.PRESETS["v2"].but(most=10))[0] is None


def test_signal_expressions(spark):
    row = spark.createDataFrame([([0, 10, 30, 100, 200],)], "raw array<int>").select(
        sig.in_band(sig.calibrated(F.col("raw"), F.lit(0.0), F.lit(1.0))).alias("band"),
        sig.z_scored(F.col("raw").cast("array<double>")).alias("z"),
        sig.decoded_kmer(F.lit(27), 4).alias("kmer"),
    ).first()
    x = np.array([0, 10, 30, 100, 200], float)
    assert row["band"] == [100.0] and np.allclose(row["z"], (x - x.mean()) / x.std()) and row["kmer"] == "ACGT"
    none = spark.createDataFrame([([1.0, 1.0],), ([],), (None,)], "x array<double>").select(sig.z_scored(F.col("x")).alias("z")).collect()
    assert [r["z"] for r in none] == [None, None, None]


def test_border_segments(spark):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 1, 5, 5, 9, 9])], "read_id string, idx int, x double")
    cut = lambda starts: [round(r["x"], 6) for r in frames.border_segments(rows, spark.createDataFrame([("a", s) for s in starts], "read_id string, event_start int")).orderBy("idx").collect()]
    assert cut([0, 2, 4, 6]) == [-1.224745, 0.0, 1.224745]
    assert cut([2, 4]) == [-1.0, 1.0]
    assert cut([2, 2, 4]) == [-1.0, 1.0] and cut([7]) == []


def test_carried_state():
    x = np.array([1.0, 2, 3, 4])
    z, sums = segment.carried_z_scores(x, (0.0, 0.0, 0))
    assert np.allclose(z, (x - 2.5) / x.std()) and sums == (10.0, 30.0, 4)
    z, _ = segment.carried_z_scores(np.array([5.0]), sums)
    both = np.append(x, 5.0)
    assert np.allclose(z, (5 - both.mean()) / both.std())


def test_t_statistic_in_single_precision():
    """Running sums in 32 bits, as some segmenters keep them: each sum is rounded, so results are near the exact ones only."""
    x = np.random.default_rng(4).normal(80, 5, 300)
    got = segment.t_statistic(x, 4, "float32")
    s, ss = np.zeros(301, np.float32), np.zeros(301, np.float32)
    for i, v in enumerate(x.astype(np.float32)):
        s[i + 1], ss[i + 1] = s[i] + v, ss[i] + v * v
    for i in range(4, 297):
        m1, m2 = (s[i] - s[i - 4]) / np.float32(4), (s[i + 4] - s[i]) / np.float32(4)
        q = (ss[i + 4] - ss[i - 4]) / np.float32(4) - m1 * m1 - m2 * m2
        assert np.isclose(got[i], abs(m2 - m1) / np.sqrt(max(q, np.finfo(np.float32).tiny) / np.float32(4)), rtol=1e-5)
    exact = segment.t_statistic(x, 4)
    assert not np.array_equal(got, exact) and np.corrcoef(got, exact)[0, 1] > 0.9


def test_mixed_lengths_stay_small():
    """A long read among many short ones isn't the measure of all: memory follows the samples there are."""
    import tracemalloc

    rng = np.random.default_rng(2)
    reads = [rng.normal(size=100) for _ in range(200)] + [rng.normal(size=20_000)]
    tracemalloc.start()
    found = segment.segmented(reads, segment.PRESETS["v1"])
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
    assert len(found) == 201 and found[-1] is not None
    few = segment.segmented([reads[0], reads[-1][:1000], reads[1]], segment.PRESETS["v1"])
    assert np.allclose(few[0], found[0]) if found[0] is not None else few[0] is None


def test_lists(spark):
    import pyarrow as pa

    from eventloom.functions.arrays import alike, arrays, known, lists

    column = pa.array([[1, 2], None, [], [None, 3]], pa.list_(pa.int32()))
    for part in (column, column.slice(1)):
        got = arrays(part)
        assert [None if g is None else np.nan_to_num(g, nan=-1).tolist() for g in got] == [None if v is None else [-1 if x is None else x for x in v] for v in part.to_pylist()]
    assert known(arrays(column)[3]).tolist() == [3.0] and known(None).tolist() == []
    back = lists([None if g is None else known(g) for g in arrays(column)], pa.float64())
    assert back.to_pylist() == [[1.0, 2.0], None, [], [3.0]] and lists([], pa.int32()).to_pylist() == [] and lists([None], pa.int32()).to_pylist() == [None]
    assert [g.tolist() for g in alike([1, 9, 3, 0], 6)] == [[1], [2, 0], [3]]
    assert [g.tolist() for g in alike([100, 300, 150, 149, 70, 10], 10**6)] == [[1, 2], [3, 0], [4], [5]] and alike([], 5) == []
