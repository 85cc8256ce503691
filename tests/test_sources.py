import numpy as np
import pytest

from eventloom.operators import kmers, training
from eventloom.operators.model import Model
from eventloom.plans import tuning
from eventloom.sources import signals, sinks, text


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_event_lines(spark):
    rows = text.parsed_events(lines(spark, "r1\t0.5\t-1.25", "r1b 0.5 -1.25", "", "r2\t1.0\tnan\t2.0", "r3", "r4\tinf", "r5\t1e3\t.5")).collect()
    assert {r["read_id"]: r["events"] for r in rows} == {"r1": [0.5, -1.25], "r1b": [0.5, -1.25], "r2": [1.0], "r3": [], "r4": [], "r5": [1000.0, 0.5]}
    reads = spark.createDataFrame([("a", [1.0, 2.5]), ("b", [])], "read_id string, events array<double>")
    assert [r["value"] for r in sinks.event_lines(reads, 2).collect()] == ["a\t1.00\t2.50"]
    assert [r["value"] for r in sinks.corrected_lines(spark.createDataFrame([("a", [1 / 3, 1e-7])], "read_id string, events array<double>")).collect()] == ["a\t0.333333\t1e-07"]


def test_counted(spark, tmp_path):
    reads, seen = sinks.counted(spark.createDataFrame([("a", [1.0]), ("b", [])], "read_id string, events array<double>"))
    sinks.write_lines(sinks.event_lines(reads), str(tmp_path / "out"))
    assert text.read_events(spark, str(tmp_path / "out")).count() == 1
    assert seen.get["n_reads"] == 2


def test_model_files(spark, tmp_path):
    model = Model((0.0, 1.0), (0.5, 0.25), ((0.0, 1.0), (1.0, 0.0)))
    sinks.write_model(spark, model, str(tmp_path / "m"))
    assert text.read_model(spark, str(tmp_path / "m")) == model
    (tmp_path / "bad").write_text("0 1\n1 1\n0 1 1\n")
    with pytest.raises(ValueError):
        text.read_model(spark, str(tmp_path / "bad"))


def test_kmer_tables(spark, tmp_path):
    (tmp_path / "k").write_text("# levels\nAC 1.5\n\nAG\nCA x\nAC 2.5\nGT\t-1e1\n")
    table = text.read_kmers(spark, str(tmp_path / "k"))
    assert {r["kmer"]: r["level"] for r in kmers.last_wins(table).collect()} == {"AC": 2.5, "GT": -10.0}


def test_slow5(spark):
    row = text.parsed_slow5(lines(spark, "#slow5_version\t0.2.0", "@x", "r1\t0\t8192\t10\t16384\t4000\t4\t5,10,40,200")).first()
    assert row["read_id"] == "r1" and row["signal_pA"] == [40.0, 100.0]


def test_signal_dispatch(spark, tmp_path):
    with pytest.raises(ValueError):
        signals.read_signals(spark, str(tmp_path), "abc")
    signals.BINARY["toy"] = lambda data: iter([("x", np.frombuffer(data, "u1").astype(float))])
    (tmp_path / "a.toy").write_bytes(bytes([50, 60]))
    (tmp_path / "b.txt").write_bytes(b"no")
    assert [tuple(r) for r in signals.read_signals(spark, str(tmp_path), ".TOY").collect()] == [("x", [50.0, 60.0])]


def test_missing_files(spark, tmp_path):
    signals.BINARY["toy"] = lambda data: iter([("x", np.frombuffer(data, "u1").astype(float))])
    (tmp_path / "b.txt").write_bytes(b"no")
    for kind in ("toy", "slow5"):
        with pytest.raises(FileNotFoundError):
            signals.read_signals(spark, str(tmp_path), kind, required=True)
    assert signals.read_signals(spark, str(tmp_path), "toy").isEmpty()


def test_bad_files(spark, tmp_path):
    def reads(data):
        for k in range(2500):
            if data == b"x" and k == 1200:
                raise OSError("cut off")
            yield f"r{k}", np.full(3, 50.0)

    signals.BINARY["odd"] = reads
    (tmp_path / "a.odd").write_bytes(b"a")
    (tmp_path / "b.odd").write_bytes(b"x")
    got = signals.read_signals(spark, str(tmp_path), "odd", strict=False)
    assert got.count() == 2500 + 1000  # whole tables of reads before the bad one
    with pytest.raises(Exception, match="cut off"):
        signals.read_signals(spark, str(tmp_path), "odd").count()


def test_borders(spark, tmp_path):
    spark.createDataFrame([("a", 3, 0.5), ("a", 7, 0.9)], "read_id string, event_start long, score double").write.parquet(str(tmp_path / "p"))
    got = text.read_borders(spark, str(tmp_path / "p"))
    assert got.dtypes == [("read_id", "string"), ("event_start", "int")] and sorted(map(tuple, got.collect())) == [("a", 3), ("a", 7)]


def test_summaries(spark):
    rows = text.parsed_summary(lines(spark, "Summary: 12 reads, 3 mapped", "\tP\tN", "f1: 0.25", "BP per sec: -1.5 2", "no number: here", "")).collect()
    assert [tuple(r) for r in rows] == [("Summary", 12.0), ("f1", 0.25), ("BP per sec", -1.5)]


def test_reports(spark):
    from eventloom.operators import alignment

    labels = spark.createDataFrame([("k", x) for x in ["tp"] * 2 + ["fp", "fn"]], "run string, label string")
    got = sinks.report_lines(alignment.rates(alignment.confusion(labels, ["run"])), "run").orderBy("line_no").collect()
    assert [r["value"] for r in got] == ["Summary: 4 reads, 3 mapped", "\tP\tN", "T\t50.00\t0.00", "F\t25.00\t25.00", "NA: 0.00", "precision: 0.666667", "recall: 0.666667", "f1: 0.666667"]


@pytest.mark.parametrize("k", [1, 3, 31])
def test_counted_kmers(spark, k):
    import collections

    rng = np.random.default_rng(k)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (0, 2, 40, 200)] + [None, "ACGNACGTTTé" * 5, "acgt", "A" * 100]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, dna string, n2 string").repartition(2)
    got = {(r["id"], r["code"]): r["n"] for r in kmers.counted(rows, "dna", k).collect()}
    expected = collections.Counter()
    for i, t in enumerate(texts):
        for a in range(len(t or "") - k + 1):
            own = t[a : a + k]
            if set(own) <= set("ACGT"):
                expected[i, sum("ACGT".index(c) << 2 * (k - 1 - j) for j, c in enumerate(own))] += 1
    assert got == dict(expected)
    codes = spark.createDataFrame([("ACG",), ("acg",), ("AC",), (None,)], "kmer string").select(kmers.coded(text.F.col("kmer"), 3)).collect()
    assert [r[0] for r in codes] == [6, None, None, None]


def test_observation_chunks(spark):
    table = spark.createDataFrame([("ACG", 2.0)], "kmer string, level double")
    rows = kmers.observations(spark, table, 3, 5).orderBy("t").collect()
    signal = spark.createDataFrame([(1, r["t"], r["level"]) for r in rows], "read_id int, idx int, x double")
    assert [r["chunk"] for r in rows] == [r["chunk"] for r in kmers.chunked(signal, 5).orderBy("idx").collect()]
    assert "".join(r["kmer"][0] for r in rows) == kmers.de_bruijn(3)[:64] and sum(r["level"] for r in rows) == 2.0


@pytest.mark.parametrize("k, expected", [(1, "ACGT"), (2, "AACAGATCCGCTGGTTA"), (3, "AAACAAGAATACCACGACTAGCAGGAGTATCATG"), (4, "AAAACAAAGAAATAACCAACGAACTAAGCAAGGA")])
def test_de_bruijn(k, expected):
    got = kmers.de_bruijn(k)
    assert got.startswith(expected) and len(got) == 4**k + k - 1
    assert len({got[i : i + k] for i in range(4**k)}) == 4**k


def test_chunks(spark):
    rows = spark.createDataFrame([(1, i, 0.0) for i in range(7)] + [(2, 0, 0.0)], "read_id int, idx int, x double")
    got = kmers.chunked(rows, 3).orderBy("read_id", "idx").collect()
    assert [r["chunk"] for r in got] == [0, 0, 0, 1, 1, 2, 2, 0]


def brute_statistics(x, means, variances, trans):
    """Posterior sums over all state paths."""
    import itertools

    n, total = len(means), 0.0
    pairs, mass = np.zeros((n, n)), np.zeros(n)
    for path in itertools.product(range(n), repeat=len(x)):
        p = 1 / n
        for t, s in enumerate(path):
            p *= np.exp(-0.5 * (x[t] - means[s]) ** 2 / variances[s]) / np.sqrt(2 * np.pi * variances[s])
            p *= trans[path[t - 1], s] if t else 1
        total += p
        for t, s in enumerate(path):
            mass[s] += p
            if t:
                pairs[path[t - 1], s] += p
    return pairs / total, mass / total, np.log(total)


def test_forward_backward():
    """Chunks of other lengths together, an empty one among them, against all state paths of each."""
    means, variances = np.array([-0.5, 0.2, 1.0]), np.array([0.4, 0.3, 0.5])
    trans = np.array([[0, 0.7, 0.3], [0.5, 0, 0.5], [0.2, 0.8, 0]])
    xs = [np.array(x) for x in ([0.1, 1.2, -0.4, 0.8], [0.3], [1.0, -1.0], [], [0.0, 0.5, 0.9, -0.2, 0.4], [0.2, 0.2])]
    found = [brute_statistics(x, means, variances, trans) for x in xs if len(x)]
    for cells in (training.CELLS, 9):
        pairs, mass, sums, squares, log = training.expected(xs, means, variances, trans) if cells == training.CELLS else _with_cells(cells, xs, means, variances, trans)
        assert np.allclose(pairs, sum(f[0] for f in found)) and np.allclose(mass, sum(f[1] for f in found)) and np.isclose(log, sum(f[2] for f in found))
        assert np.isclose(mass.sum(), sum(map(len, xs))) and np.isclose(sums.sum(), sum(x.sum() for x in xs))


def _with_cells(cells, *args):
    before, training.CELLS = training.CELLS, cells
    try:
        return training.expected(*args)
    finally:
        training.CELLS = before


def brute_round(xs, means, variances, trans, below):
    """One round by all state paths: means first, then variances with the new means and the old rest."""
    found = [brute_sums(x, means, variances, trans) for x in xs]
    mass, first, pairs = (sum(f[k] for f in found) for k in (0, 1, 3))
    moved = first / mass
    squares = sum(brute_sums(x, moved, variances, trans)[2] for x in xs)
    p = pairs / pairs.sum(axis=1, keepdims=True)
    p[p < below] = 0
    return moved, np.maximum(squares / mass, 1e-6), p / p.sum(axis=1, keepdims=True)


def brute_sums(x, means, variances, trans):
    import itertools

    n, total = len(means), 0.0
    mass, first, squares, pairs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, n))
    for path in itertools.product(range(n), repeat=len(x)):
        p = 1 / n
        for t, s in enumerate(path):
            p *= np.exp(-0.5 * (x[t] - means[s]) ** 2 / variances[s]) / np.sqrt(2 * np.pi * variances[s]) * (trans[path[t - 1], s] if t else 1)
        total += p
        for t, s in enumerate(path):
            mass[s] += p
            first[s] += p * x[t]
            squares[s] += p * (x[t] - means[s]) ** 2
            if t:
                pairs[path[t - 1], s] += p
    return mass / total, first / total, squares / total, pairs / total


def test_training_rounds(spark):
    """Rounds against brute force, with transitions cut from the third on."""
    rng = np.random.default_rng(1)
    xs = [rng.normal(size=n) for n in (5, 6, 4)]
    means, variances, trans = np.array([-1.0, 0.1, 0.9]), np.array([0.5, 0.4, 0.6]), (1 - np.eye(3)) / 2
    chunks = spark.createDataFrame([(list(map(float, x)),) for x in xs], "xs array<double>")
    model, log = training.trained(chunks, means, variances, most=4, prune_after=2, prune_below=0.45)
    for turn in range(4):
        means, variances, trans = brute_round(xs, means, variances, trans, 0.45 if turn >= 2 else 0)
    assert np.allclose(model.means, means) and np.allclose(model.variances, variances) and np.allclose(model.transitions, trans)
    assert len(log) == 4 and (np.array(model.transitions) == 0).sum() > 3


def test_far_values(spark):
    """Values far from all means, and tasks whose sums Spark adds up."""
    pairs, mass, _, _, log = training.expected([np.array([1e4, -1e4, 0.0])], np.array([-1.0, 1.0]), np.array([0.1, 0.1]), np.array([[0, 1.0], [1.0, 0]]))
    assert np.isfinite(log) and np.isclose(mass.sum(), 3) and np.isclose(pairs.sum(), 2)
    chunks = spark.createDataFrame([([float(k % 3), 1.0, -1.0],) for k in range(9)], "xs array<double>").repartition(3)
    args = np.array([-1.0, 1.0]), np.array([0.5, 0.5]), np.array([[0, 1.0], [1.0, 0]])
    before, training.GATHERED = training.GATHERED, 0
    spread = training._statistics(chunks, 3, *args)
    training.GATHERED = before
    assert np.allclose(spread, training._statistics(chunks, 3, *args))


def test_training_stops_late(spark):
    """Rounds go on for more than `least` of them, and then until they change little."""
    chunks = spark.createDataFrame([([-1.0, 1.0, -0.9, 1.1, -1.1],)], "xs array<double>")
    _, log = training.trained(chunks, np.array([-0.5, 0.5]), np.array([1.0, 1.0]), least=12, most=100, tol=1e9)
    assert len(log) == 13


def test_training_improves(spark):
    rng = np.random.default_rng(3)
    xs = [[float(v) for v in np.tile([-1.0, 1.0], 30) + rng.normal(0, 0.2, 60)] for _ in range(3)]
    chunks = spark.createDataFrame([(x,) for x in xs], "xs array<double>")
    model, log = training.trained(chunks, np.array([-0.5, 0.5]), np.array([1.0, 1.0]), most=6)
    assert all(b >= a - 1e-6 for a, b in zip(log, log[1:]))
    assert np.allclose(model.means, (-1, 1), atol=0.1)


def test_mixture(spark):
    rng = np.random.default_rng(5)
    values = [(float(v),) for v in np.concatenate([rng.normal(0, 1, 200), rng.normal(10, 1, 100)])]
    means, variances, weights = training.mixture(spark.createDataFrame(values, "x double"), "x", 2, rounds=15)
    assert np.allclose(means, (0, 10), atol=0.5) and np.allclose(weights, (2 / 3, 1 / 3), atol=0.05)


def test_climbing():
    best, score, tried = tuning.climbed(lambda a, b: -((a - 0.1) ** 2) - (b - 0.05) ** 2, (0.0, 0.0))
    assert best == pytest.approx((0.1, 0.05)) and tried < 60
    assert tuning.climbed(lambda a, b: -a - b, (0.0, 0.0))[0] == (0.0, 0.0)


def test_neighbours_are_scored_together():
    f = lambda a, b: -((a - 0.1) ** 2) - (b - 0.05) ** 2
    jobs = []

    def ahead(pairs):
        jobs.append(pairs)
        return {p: f(*p) for p in pairs}

    alone = []
    best = tuning.climbed(f, (0.0, 0.0), ahead=ahead)
    assert best == tuning.climbed(lambda a, b: alone.append(1) or f(a, b), (0.0, 0.0))
    assert len(jobs) < len(alone) and all(1 <= len(p) <= 4 and min(map(min, p)) >= 0 for p in jobs)


def plain_climb(f, start, steps):
    """The rule move by move, without a memory of scores."""
    here, top = start, f(*start)
    for step in steps:
        back = None
        while True:
            moves = []
            for axis in (0, 1):
                to = lambda d: tuple(round(v + (d * step if k == axis else 0), 6) for k, v in enumerate(here))
                up, down = to(1), to(-1)
                up_helps = back != (axis, 1) and f(*up) > top
                if up_helps:
                    moves.append((f(*up), up, (axis, -1)))
                elif back != (axis, -1) and down[axis] >= 0 and f(*down) > top:
                    moves.append((f(*down), down, (axis, 1)))
            if not moves:
                break
            top, here, back = max(moves, key=lambda m: m[0])
    return here, top


@pytest.mark.parametrize("seed", range(12))
def test_climbing_follows_the_rule(seed):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=6)
    f = lambda a, b: float(w[0] * np.sin(40 * a + w[1]) + w[2] * np.cos(30 * b + w[3]) + w[4] * np.sin(25 * (a + b)) - 10 * abs(w[5]) * (a * a + b * b))
    start = (round(float(rng.choice(tuning.GRID)), 6), round(float(rng.choice(tuning.GRID)), 6))
    best, score, tried = tuning.climbed(f, start)
    assert (best, score) == plain_climb(f, start, tuning.STEPS) and tried > 0


def test_streams(spark, tmp_path):
    from eventloom.streaming import reads as streams

    model = Model((-1.0, 1.0), (0.5, 0.5), ((0, 1), (1, 0)))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("r1\t-1.0\t1.0\nr2\t0.9\n")
    out = streams.correct_stream(spark, str(tmp_path / "in"), model, 0.1, 0.0)
    q = out.writeStream.format("memory").queryName("corrected").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["read_id"]: r["states"] for r in spark.table("corrected").collect()} == {"r1": [0, 1], "r2": [1]}


def test_carried_normalisation(spark, tmp_path):
    from eventloom.operators.segment import carried_z_scores
    from eventloom.streaming import reads as streams

    rng = np.random.default_rng(2)
    rows = [(c, i, f"r{c}{i}", [float(v) for v in rng.normal(c, 1 + i, 20)]) for c in (1, 2) for i in range(3)]
    schema = "channel long, seq long, read_id string, signal array<double>"
    for i in range(3):  # a file, and so a batch, for each place in the channels
        spark.createDataFrame([r for r in rows if r[1] == i], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.normalise_stream(stream).writeStream.format("memory").queryName("normalised").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["channel"], r["seq"]): r["signal"] for r in spark.table("normalised").collect()}
    for c in (1, 2):
        sums = (0.0, 0.0, 0)
        for i in range(3):
            z, sums = carried_z_scores(np.array(rows[3 * (c - 1) + i][3]), sums)
            assert np.allclose(got[c, i], z)
