import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.operators import decode, frames
from eventloom.operators.model import Model, reparameterised
from eventloom.plans import correction

MODEL = Model((-1.0, 0.0, 1.0), (0.3, 0.2, 0.3), ((0, 0.8, 0), (0.5, 0, 0.5), (0, 1.0, 0)))


def brute_path(model, p_stay, p_skip, x):
    """The decoding rule, one candidate at a time."""
    t, adjacent, n = model.reparameterised(p_stay, p_skip), model.adjacent(), len(model.means)
    log_t = lambda p, s: np.log(t[p, s]) if t[p, s] > 0 else -np.inf
    emit = lambda v, s: -0.5 * (np.log(2 * np.pi) + np.log(model.variances[s])) - (v - model.means[s]) ** 2 / (2 * model.variances[s])
    score, back = [emit(x[0], s) for s in range(n)], []
    for v in x[1:]:
        best = max(range(n), key=lambda s: (score[s], -s))
        new, came = [], []
        for s in range(n):
            top, who = -np.inf, -1
            for p in [*[p for p in range(n) if adjacent[p, s]], s, best]:
                if score[p] + log_t(p, s) > top:
                    top, who = score[p] + log_t(p, s), p
            new.append(top + emit(v, s))
            came.append(who)
        score = new
        back.append(came)
    path = [max(range(n), key=lambda s: (score[s], -s))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.floats(-3, 3), min_size=1, max_size=30), min_size=1, max_size=5))
def test_paths_follow_the_rule(reads):
    got = decode.best_paths(MODEL, 0.1, 0.06, [np.array(r) for r in reads])
    for r, g in zip(reads, got):
        assert g[0].tolist() == brute_path(MODEL, 0.1, 0.06, r)


def test_reads_without_a_path():
    got = decode.best_paths(MODEL, 0.1, 0.06, [np.array([0.0, np.nan, 1.0]), np.zeros(0), np.array([0.1])])
    assert got[0] is None and len(got[1][0]) == 0 and got[2][0].tolist() == [1]


@pytest.mark.parametrize("row, expected", [((0, 0.8, 0), (0.1, 0.84, 0.06)), ((0, 0.5, 0.5), (0.1, 0.42, 0.42)), ((0.7, 0.8, 0), (0.1, 0.84, 0.06)), ((1, 0, 0), (0.1, 0.03, 0.03))])
def test_reparameterised_rows(spark, row, expected):
    model = Model((0, 1, 2), (1, 1, 1), (row, (1, 0, 1), (1, 1, 0)))
    assert np.allclose(model.reparameterised(0.1, 0.06)[0], expected)
    rows = reparameterised(model.edges(spark), 0.1, 0.06).filter("p = 0").orderBy("s").collect()
    assert np.allclose([r["prob"] for r in rows], expected)


def test_models_are_checked():
    with pytest.raises(ValueError):
        Model((0, 1), (1, 0), ((0, 1), (1, 0)))
    with pytest.raises(ValueError):
        Model((0, 1), (1, 1), ((0, 1),))
    with pytest.raises(ValueError):
        MODEL.reparameterised(0.9, 0.2, strict=True)


def test_runs_collapse():
    x, states, run = decode.collapsed(np.array([1.0, 3, 4, 5, 6, 7]), np.array([2, 2, 1, 1, 1, 2]))
    assert x.tolist() == [2, 5, 7] and states.tolist() == [2, 1, 2] and run.tolist() == [0, 0, 1, 1, 1, 2]
    assert MODEL.collapses(0.001) and not MODEL.collapses(0.0005)


@pytest.mark.parametrize("n, changed", [(19, []), (20, []), (21, [10]), (22, [11]), (23, [10, 12]), (30, [*range(10, 18), 19])])
def test_noise_frames(spark, n, changed):
    x = np.random.default_rng(n).normal(size=n)
    path = np.arange(n) % 3
    means = np.array(MODEL.means)
    got = decode.denoised(x, path, means, 20)
    assert np.flatnonzero(got != x).tolist() == changed
    if n == 22:
        assert np.isclose(x[11] - got[11], (x - means[path])[:21].mean())
    rows = spark.createDataFrame([(1, i, float(v), int(s)) for i, (v, s) in enumerate(zip(x, path))], "read_id long, idx int, x double, state int")
    windows = frames.without_noise(rows, list(MODEL.means), 20).orderBy("idx").collect()
    assert np.allclose([r["x"] for r in windows], got)
    exact = decode.denoised(x, path, means, 20, "exact")
    windows = frames.without_noise(rows, list(MODEL.means), 20, "exact").orderBy("idx").collect()
    assert np.allclose([r["x"] for r in windows], exact)


def test_both_engines_agree(spark, sf):
    from eventloom import catalog

    reads = catalog.user_reads(spark, sf)
    for stays in (True, False):
        for noise in (True, False):
            out = [{r["read_id"]: (np.round(r["events"], 6).tolist(), r["states"]) for r in correction.correct_events(reads, catalog.MODEL, 0.1, 0.06, 5, stays, noise, engine).collect()} for engine in ("arrow", "sql")]
            assert out[0] == out[1]


def test_empty_and_null_reads(spark):
    reads = spark.createDataFrame([(1, []), (2, None), (3, [0.1, None])], "read_id long, events array<double>")
    rows = {r["read_id"]: r["events"] for r in correction.correct_events(reads, MODEL, 0.1, 0.06).collect()}
    assert rows == {1: [], 2: None, 3: None}


def test_sql_names(spark):
    correction.register(spark, MODEL, 0.1, 0.06)
    assert spark.sql("SELECT viterbi_path(array(0.0D, 1.0D)) AS p").first()["p"] == brute_path(MODEL, 0.1, 0.06, [0.0, 1.0])


@pytest.mark.parametrize("n", [6, 64])
def test_links_alone_give_the_same_paths(monkeypatch, n):
    """Models with few links a state: gone through by link, as a whole matrix, and by the rule."""
    rng = np.random.default_rng(n)
    trans = np.zeros((n, n))
    for p in range(n):
        to = {(2 * p) % n, (2 * p + 1) % n} - {p}
        for s in to:
            trans[p, s] = 1 / len(to)
    model = Model(tuple(np.linspace(-2, 2, n)), tuple([0.2] * n), tuple(map(tuple, trans)))
    reads = [rng.normal(size=k) for k in (0, 1, 30, 7, 31)] + [np.array([0.5] * 9)]
    for pair in ((0.1, 0.06), (0.0, 0.0), (0.3, 0.0)):
        got = decode.best_paths(model, *pair, reads)
        monkeypatch.setattr(decode, "DENSE", 10**9)
        want = decode.best_paths(model, *pair, reads)
        monkeypatch.undo()
        for a, b, x in zip(got, want, reads):
            assert (a is None) == (b is None)
            if a is not None:
                assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
