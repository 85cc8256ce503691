"""The registered queries of the signal operators, bound to the given tables, and the SQL that checks them.

Samples come from events (a read per user) and lineitem (a longer read per supplier),
arrays from embeddings, alignments from lineitem and orders, k-mers from documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import signal as sig
from eventloom.operators import alignment, blocks, decode, frames, kmers, segment, training
from eventloom.operators.model import Model, reparameterised
from eventloom.plans import correction, evaluation, tuning
from eventloom.sources import binary, shared, sinks, text

#: Our own small model: five states, no self transitions, rows with different numbers of zeros.
MODEL = Model(
    (-1.2, -0.5, 0.1, 0.7, 1.5),
    (0.2, 0.15, 0.1, 0.15, 0.3),
    ((0.0, 0.7, 0.3, 0.0, 0.0), (0.2, 0.0, 0.5, 0.3, 0.0), (0.0, 0.4, 0.0, 0.6, 0.0), (0.0, 0.0, 0.5, 0.0, 0.5), (0.1, 0.0, 0.3, 0.6, 0.0)),
)
P_STAY, P_SKIP, WIDTH = 0.1, 0.06, 20
K = 4

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def band_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter((F.col("value") > 30) & (F.col("value") < 200))


def user_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' values inside the pA band, one sample a row."""
    return frames.indexed(band_rows(spark, sf_dir), "user_id", ["ts", "event_id"], "value")


def supplier_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").withColumn("pa", F.pmod(F.col("l_extendedprice"), F.lit(170.0)) + 30.0)
    return frames.indexed(rows, "l_suppkey", order, "pa")


def user_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' z-scored values as arrays: read_id, events."""
    return correction.normalised(correction.gathered(band_rows(spark, sf_dir), "user_id", ["ts", "event_id"], "value"))


def supplier_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").withColumn("pa", F.pmod(F.col("l_extendedprice"), F.lit(170.0)) + 30.0)
    return correction.gathered(rows, "l_suppkey", order, "pa")


def long_path(reads: DataFrame) -> DataFrame:
    """Decoded reads, one event a row: read_id, idx, x, state."""
    path = decode.decode_reads(reads, MODEL, P_STAY, P_SKIP).filter("states is not null")
    path = path.select("read_id", F.posexplode(F.arrays_zip("events", "states", "skips")).alias("idx", "z"))
    return path.select("read_id", "idx", F.col("z.events").alias("x"), F.col("z.states").alias("state"), F.col("z.skips").alias("is_skip"))


# The SQL of what several queries share.
USER_SIGNAL = "sig AS (SELECT user_id AS read_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS idx, value AS x FROM events WHERE value > 30 AND value < 200)"
SUPPLIER_SIGNAL = (
    "sig AS (SELECT l_suppkey AS read_id, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1)::INT AS idx, "
    "l_extendedprice % 170.0::DOUBLE + 30.0::DOUBLE AS x FROM lineitem)"
)
Z = "z AS (SELECT read_id, idx, (x - avg(x) OVER r) / nullif(stddev_pop(x) OVER r, 0) AS x FROM sig WINDOW r AS (PARTITION BY read_id))"
STATES = "states(s, mean, var) AS (VALUES " + ", ".join(f"({i}, {m}::DOUBLE, {v}::DOUBLE)" for i, (m, v) in enumerate(zip(MODEL.means, MODEL.variances))) + ")"
RAW_EDGES = "raw_edges(p, s, prob) AS (VALUES " + ", ".join(f"({i}, {j}, {x}::DOUBLE)" for i, row in enumerate(MODEL.transitions) for j, x in enumerate(row)) + ")"


def edges_sql(p_stay: float, p_skip: float) -> str:
    return f"""edges AS (
    SELECT p, s, CASE WHEN p = s THEN {p_stay} WHEN prob = 0 THEN {p_skip}::DOUBLE / count(*) FILTER (p <> s AND prob = 0) OVER r
                      ELSE (1 - {p_stay}::DOUBLE - {p_skip}::DOUBLE) * prob / sum(prob) FILTER (p <> s AND prob > 0) OVER r END::DOUBLE AS prob,
           p <> s AND prob > 0 AS is_adjacent
    FROM raw_edges WINDOW r AS (PARTITION BY p))"""


EDGES = edges_sql(P_STAY, P_SKIP)
LOG_EDGES = "log_edges AS (SELECT *, CASE WHEN prob > 0 THEN ln(prob) ELSE '-inf'::DOUBLE END AS lp FROM edges)"
EMIT = "emit AS (SELECT read_id, idx, x, s, -0.5 * (ln(2 * pi()) + ln(var)) - pow(x - mean, 2) / (2 * var) AS le FROM z, states WHERE x IS NOT NULL)"
# A round keeps, for each read and state, the best way there: linked predecessors, then the state itself, then the last event's best state.
DECODE = """dp AS (
    SELECT read_id, idx, s, le AS score, [s] AS path, [false] AS skips FROM emit WHERE idx = 0
    UNION ALL
    SELECT read_id, idx, s, score, path, skips FROM (
        SELECT e.read_id, e.idx, e.s, d.score + t.lp + e.le AS score, list_append(d.path, e.s) AS path,
               list_append(d.skips, NOT t.is_adjacent AND t.p <> t.s) AS skips,
               row_number() OVER (PARTITION BY e.read_id, e.s ORDER BY d.score + t.lp DESC, CASE WHEN t.is_adjacent THEN 0 WHEN t.p = t.s THEN 1 ELSE 2 END, t.p) AS k
        FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, s) AS place FROM dp) d
        JOIN log_edges t ON t.p = d.s AND (t.is_adjacent OR t.p = t.s OR d.place = 1)
        JOIN emit e ON e.read_id = d.read_id AND e.idx = d.idx + 1 AND e.s = t.s)
    WHERE k = 1),
ends AS (
    SELECT read_id, path, skips FROM (
        SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY idx DESC, score DESC, s) AS k FROM dp) WHERE k = 1),
path AS (
    SELECT z.read_id, z.idx, z.x, ends.path[z.idx + 1]::INT AS state, ends.skips[z.idx + 1] AS is_skip
    FROM z JOIN ends ON z.read_id = ends.read_id WHERE z.x IS NOT NULL)"""


def decoded_sql(signal: str, p_stay: float, p_skip: float) -> str:
    return f"WITH RECURSIVE {signal}, {STATES}, {RAW_EDGES}, {edges_sql(p_stay, p_skip)}, {LOG_EDGES}, {EMIT}, {DECODE}"


DECODED = decoded_sql(f"{USER_SIGNAL}, {Z}", P_STAY, P_SKIP)
RUNS = """numbered AS (
    SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY idx)::INT AS run
    FROM (SELECT *, coalesce((state <> lag(state) OVER (PARTITION BY read_id ORDER BY idx))::INT, 0) AS new FROM path)),
collapsed AS (SELECT read_id, run AS idx, avg(x) AS x, arg_min(state, idx) AS state FROM numbered GROUP BY read_id, run)"""
W = WIDTH + 1 - WIDTH % 2
H = (W - 1) // 2
DENOISED = f"""residual AS (
    SELECT c.read_id, c.idx, c.x, c.state, c.x - mean AS e, count(*) OVER (PARTITION BY c.read_id) AS n FROM collapsed c JOIN states ON s = state),
framed AS (
    SELECT *, avg(e) OVER (PARTITION BY read_id ORDER BY idx ROWS BETWEEN {H} PRECEDING AND {H} FOLLOWING) AS own,
           avg(e) OVER (PARTITION BY read_id ORDER BY idx ROWS BETWEEN {H + 1} PRECEDING AND {H - 1} FOLLOWING) AS earlier FROM residual),
denoised AS (
    SELECT read_id, idx, state, CASE WHEN n >= {W} AND idx BETWEEN {H} AND n - {W} - 2 + {H} THEN x - own
                                     WHEN n >= {W} AND idx = n - {W} + {H} THEN x - CASE WHEN n = {W} THEN own ELSE earlier END ELSE x END AS x
    FROM framed)"""


RUN_NOISE = f"""run_residual AS (SELECT c.read_id, c.idx AS run, c.x - mean AS e, count(*) OVER (PARTITION BY c.read_id) AS n FROM collapsed c JOIN states ON s = state),
run_noise AS (
    SELECT read_id, run, CASE WHEN n >= {WIDTH} AND run BETWEEN {H} AND n - {W} - 1 + {H}
                              THEN avg(e) OVER (PARTITION BY read_id ORDER BY run ROWS BETWEEN {H} PRECEDING AND {H} FOLLOWING) ELSE 0 END AS noise
    FROM run_residual)"""


def long_corrected(out: DataFrame) -> DataFrame:
    z = F.arrays_zip("events", "states")
    return out.filter("events is not null").select("read_id", F.posexplode(z).alias("idx", "z")).select("read_id", "idx", rounded(F.col("z.events")).alias("event"), F.col("z.states").alias("state"))


@query(f"{DECODED}, {RUNS}, {DENOISED} SELECT read_id, idx, round(x, 6) + 0.0 AS event, state FROM denoised")
def correct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: band filter, z-score, decoding, stay removal, noise removal, on arrays."""
    return long_corrected(correction.correct_events(user_reads(spark, sf_dir), MODEL, P_STAY, P_SKIP, WIDTH))


@query(f"{DECODED}, {RUNS}, {DENOISED} SELECT read_id, idx, round(x, 6) + 0.0 AS event, state FROM denoised")
def correct_events_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with windows over one event a row."""
    return long_corrected(correction.correct_events(user_reads(spark, sf_dir), MODEL, P_STAY, P_SKIP, WIDTH, engine="sql"))


@query(f"{DECODED}, {RUNS} SELECT read_id, idx, round(x, 6) + 0.0 AS event, state FROM collapsed")
def correct_stays_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrector without noise removal."""
    return long_corrected(correction.correct_events(user_reads(spark, sf_dir), MODEL, P_STAY, P_SKIP, WIDTH, remove_noise=False))


@query(f"{DECODED}, {RUNS}, {RUN_NOISE} SELECT p.read_id, p.idx, round(p.x - noise, 6) + 0.0 AS event, p.state FROM numbered p JOIN run_noise n ON p.read_id = n.read_id AND p.run = n.run")
def correct_noise_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrector without stay removal: noise comes off run by run."""
    return long_corrected(correction.correct_events(user_reads(spark, sf_dir), MODEL, P_STAY, P_SKIP, WIDTH, remove_stays=False))


@query(f"{DECODED} SELECT read_id, idx, round(x, 6) + 0.0 AS event, state FROM path")
def correct_neither(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrector with both removals off: events with their states."""
    return long_corrected(correction.correct_events(user_reads(spark, sf_dir), MODEL, P_STAY, P_SKIP, WIDTH, remove_stays=False, remove_noise=False))


@query(f"{DECODED} SELECT read_id, idx, state, is_skip FROM path")
def viterbi_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_path(user_reads(spark, sf_dir)).select("read_id", "idx", "state", "is_skip")


@query(f"{DECODED}, {RUNS} SELECT read_id, idx, round(x, 6) + 0.0 AS event, state FROM collapsed")
def remove_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.without_stays(long_path(user_reads(spark, sf_dir)), MODEL.collapses(P_STAY))
    return out.select("read_id", "idx", rounded(F.col("x")).alias("event"), "state")


@query(f"""{DECODED}, collapsed AS (SELECT * FROM path), {DENOISED} SELECT read_id, idx, round(x, 6) + 0.0 AS event FROM denoised""")
def remove_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.without_noise(long_path(user_reads(spark, sf_dir)), list(MODEL.means), WIDTH)
    return out.select("read_id", "idx", rounded(F.col("x")).alias("event"))


@query(f"{DECODED}, {RUNS}, {RUN_NOISE} SELECT p.read_id, p.idx, round(p.x - noise, 6) + 0.0 AS event FROM numbered p JOIN run_noise n ON p.read_id = n.read_id AND p.run = n.run")
def remove_run_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.without_run_noise(long_path(user_reads(spark, sf_dir)), list(MODEL.means), WIDTH)
    return out.select("read_id", "idx", rounded(F.col("x")).alias("event"))


@query(f"WITH {USER_SIGNAL} SELECT read_id, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS spread FROM sig GROUP BY read_id")
def band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration (offset 0, scale 1) and the band filter on arrays, then statistics per read."""
    raw = correction.gathered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    kept = raw.select("read_id", F.explode(sig.in_band(sig.calibrated(F.col("signal"), F.lit(0.0), F.lit(1.0)))).alias("x"))
    return kept.groupBy("read_id").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("spread"))


@query("SELECT event_id, round((value + 12.5) * (1.5::DOUBLE / 0.75::DOUBLE), 6) AS pa FROM events")
def calibrate_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    pa = sig.calibrated_by_range(F.array("value"), F.lit(0.75), F.lit(12.5), F.lit(1.5))[0]
    return table(spark, sf_dir, "events").select("event_id", F.round(pa, 6).alias("pa"))


@query(
    f"""WITH {SUPPLIER_SIGNAL}, {Z}, kept AS (SELECT read_id, idx, x FROM z WHERE abs(x) < 1.5)
    SELECT read_id, (row_number() OVER (PARTITION BY read_id ORDER BY idx) - 1)::INT AS idx, round(x, 6) + 0.0 AS z FROM kept"""
)
def sigma_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-scores by read, the far ones dropped (here from 1.5 deviations on, so that some are) and indices closed up."""
    return frames.within_sigmas(frames.z_scores(supplier_signal(spark, sf_dir)), 1.5).select("read_id", "idx", rounded(F.col("x")).alias("z"))


@query(
    f"""WITH {USER_SIGNAL} SELECT read_id, idx, round(sum(x) OVER r, 4) AS sum_x, round(sum(x * x) OVER r, 4) AS sum_xx FROM sig
    WINDOW r AS (PARTITION BY read_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.prefix_sums(user_signal(spark, sf_dir)).select("read_id", "idx", F.round("sum_x", 4).alias("sum_x"), F.round("sum_xx", 4).alias("sum_xx"))


def _t_sql(w: int) -> str:
    return f"""CASE WHEN n >= {2 * w} AND idx BETWEEN {w} AND n - {w} THEN abs(m2_{w} - m1_{w}) / sqrt(greatest(q1_{w} - m1_{w} * m1_{w} + q2_{w} - m2_{w} * m2_{w}, 1.17549435e-38::DOUBLE) / {w}) ELSE 0 END"""


def _t_frames(w: int) -> str:
    sides = (("1", f"{w} PRECEDING AND 1 PRECEDING"), ("2", f"CURRENT ROW AND {w - 1} FOLLOWING"))
    return ", ".join(f"avg({x}) OVER (PARTITION BY read_id ORDER BY idx ROWS BETWEEN {f}) AS {name}{k}_{w}" for k, f in sides for name, x in (("m", "x"), ("q", "x * x")))


@query(
    f"""WITH {SUPPLIER_SIGNAL}, f AS (SELECT read_id, idx, count(*) OVER (PARTITION BY read_id) AS n, {_t_frames(3)}, {_t_frames(6)} FROM sig)
    SELECT read_id, idx, round({_t_sql(3)}, 4) AS t_short, round({_t_sql(6)}, 4) AS t_long FROM f"""
)
def t_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.t_statistic(frames.t_statistic(supplier_signal(spark, sf_dir), 3, "t_short"), 6, "t_long")
    return out.select("read_id", "idx", F.round("t_short", 4).alias("t_short"), F.round("t_long", 4).alias("t_long"))


@query(ORACLES["t_statistics"])
def blocked_t_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each read dealt out in blocks of 256 samples."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").withColumn("pa", F.pmod(F.col("l_extendedprice"), F.lit(170.0)) + 30.0)
    out = blocks.t_statistics(blocks.indexed(rows, "l_suppkey", order, "pa"), {"t_short": 3, "t_long": 6}, 256)
    return out.select("read_id", "idx", F.round("t_short", 4).alias("t_short"), F.round("t_long", 4).alias("t_long"))


@query(ORACLES["prefix_sums"])
def blocked_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocks.prefix_sums(blocks.indexed(band_rows(spark, sf_dir), "user_id", ["ts", "event_id"], "value"), 16)
    return out.select("read_id", "idx", F.round("sum_x", 4).alias("sum_x"), F.round("sum_xx", 4).alias("sum_xx"))


def _segmented(spark: SparkSession, sf_dir: str, preset: str) -> DataFrame:
    out = correction.segment_events(supplier_reads(spark, sf_dir), preset)
    return out.select("read_id", F.posexplode("events").alias("idx", "event")).withColumn("event", rounded(F.col("event")))


def _peaks_sql(short: int, long: int, limits: tuple[float, float], height: float) -> str:
    """Peak places: a recursion over samples that carries both detectors (top, place, sure) and until when the long one is silent."""
    inf = "'inf'::DOUBLE"

    def step(k: str, on: str, high: str = "false") -> str:
        """A detector's next state: what it was, what the sample makes of it, whether its peak is done."""
        w, limit = (short, limits[0]) if k == "a" else (long, limits[1])
        return f"""SELECT *, {k}_at2 >= 0 AND {k}_at1 >= 0 AND {k}_sure2 AND {on} AND idx - {k}_at2 > {w // 2} AS {k}_done FROM (
            SELECT *, {k}_sure1 OR ({on} AND {k}_at1 >= 0 AND {k}_top2 > {limit} AND {k}_top2 - {k}_v > {height}) AS {k}_sure2 FROM (
            SELECT *, CASE WHEN {on} AND ((({k}_at1 < 0) AND ({k}_v < {k}_top1 OR {k}_v - {k}_top1 > {height})) OR ({k}_at1 >= 0 AND {k}_v > {k}_top1)) THEN {k}_v ELSE {k}_top1 END AS {k}_top2,
                   CASE WHEN {on} AND (({k}_at1 < 0 AND {k}_v >= {k}_top1 AND {k}_v - {k}_top1 > {height}) OR ({k}_at1 >= 0 AND {k}_v > {k}_top1)) THEN idx ELSE {k}_at1 END AS {k}_at2 FROM {{}}))"""

    begin = f"SELECT t.read_id, t.idx, t.a_v, t.b_v, p.a_top AS a_top1, p.a_at AS a_at1, p.a_sure AS a_sure1, p.b_top AS b_top0, p.b_at AS b_at0, p.b_sure AS b_sure0, p.quiet AS quiet0, p.found FROM peaks p JOIN tstat t ON t.read_id = p.read_id AND t.idx = p.idx + 1"
    first = step("a", "true").format(f"({begin})")
    loud = f"a_at1 >= 0 AND a_top2 > {limits[0]}"
    silenced = f"""SELECT *, CASE WHEN {loud} THEN a_at2 + {short} ELSE quiet0 END AS quiet1, CASE WHEN {loud} THEN {inf} ELSE b_top0 END AS b_top1,
        CASE WHEN {loud} THEN -1 ELSE b_at0 END AS b_at1, CASE WHEN {loud} THEN false ELSE b_sure0 END AS b_sure1 FROM ({first})"""
    second = step("b", "quiet1 < idx").format(f"({silenced})")
    out = lambda k: f"CASE WHEN {k}_done THEN {k}_v ELSE {k}_top2 END AS {k}_top, CASE WHEN {k}_done THEN -1 ELSE {k}_at2 END AS {k}_at, {k}_sure2 AND NOT {k}_done AS {k}_sure"
    return f"""peaks AS (
    SELECT read_id, idx, {inf} AS a_top, -1 AS a_at, false AS a_sure, {inf} AS b_top, -1 AS b_at, false AS b_sure, 0 AS quiet, []::INT[] AS found FROM tstat WHERE idx = 0
    UNION ALL
    SELECT read_id, idx, {out("a")}, {out("b")}, quiet1 AS quiet, found || CASE WHEN a_done THEN [a_at2] ELSE [] END || CASE WHEN b_done THEN [b_at2] ELSE [] END AS found FROM ({second})),
places AS (SELECT read_id, arg_max(found, idx) AS found FROM peaks GROUP BY read_id)"""


def _segments_sql(variant: int, short: int, long: int, limits: tuple[float, float], height: float, most: int = 500, digits: int = 6) -> str:
    signal = "kept AS (SELECT read_id, idx, x FROM sig)" if variant == 1 else f"{Z}, kept AS (SELECT read_id, (row_number() OVER (PARTITION BY read_id ORDER BY idx) - 1)::INT AS idx, x FROM z WHERE abs(x) < 3)"
    tstat = f"framed AS (SELECT read_id, idx, count(*) OVER (PARTITION BY read_id) AS n, {_t_frames(short)}, {_t_frames(long)} FROM kept), tstat AS (SELECT read_id, idx, {_t_sql(short)} AS a_v, {_t_sql(long)} AS b_v FROM framed)"
    sizes = "sizes AS (SELECT read_id, count(*)::INT AS n FROM kept GROUP BY read_id)"
    head = f"WITH RECURSIVE {SUPPLIER_SIGNAL}, {signal}, {tstat}, {_peaks_sql(short, long, limits, height)}, {sizes}"
    if variant == 1:
        edges = "edges AS (SELECT p.read_id, [0] || found[:len(list_filter(found[2:], lambda x: x > 0 AND x < n))] || [n] AS e FROM places p JOIN sizes USING (read_id) WHERE len(found) > 0)"
        mean = "avg(x)"
    else:
        edges = "edges AS (SELECT p.read_id, [0] || list_filter(found, lambda x: x > 0 AND x < n) AS e FROM places p JOIN sizes USING (read_id))"
        mean = "coalesce(list_avg(list_filter(s, lambda v: v >= 2 * q1 - q3 AND v <= 2 * q3 - q1)), 0)"
    cut = "cut AS (SELECT read_id, unnest(range(1, len(e)))::INT AS k, e FROM edges), bounds AS (SELECT read_id, k - 1 AS idx, e[k] AS low, e[k + 1] AS high FROM cut)"
    joined = "FROM bounds b JOIN kept v ON v.read_id = b.read_id AND v.idx >= low AND v.idx < high GROUP BY b.read_id, b.idx, low, high"
    if variant == 1:
        return f"{head}, {edges}, {cut}, means AS (SELECT b.read_id, b.idx, avg(x) AS x {joined}) SELECT read_id, idx::INT AS idx, round((x - avg(x) OVER r) / nullif(stddev_pop(x) OVER r, 0), {digits}) + 0.0 AS event FROM means WINDOW r AS (PARTITION BY read_id) QUALIFY event IS NOT NULL"
    parts = f"parts AS (SELECT b.read_id, b.idx, list_sort(list(x)) AS s, count(*) AS n {joined}), q AS (SELECT *, s[n // 4 + 1] AS q1, s[3 * n // 4 + 1] AS q3 FROM parts WHERE n < {most})"
    return f"{head}, {edges}, {cut}, {parts} SELECT read_id, (row_number() OVER (PARTITION BY read_id ORDER BY idx) - 1)::INT AS idx, round({mean}, 6) + 0.0 AS event FROM q"


@query(_segments_sql(1, 3, 6, (4.30265, 2.57058), 1.0))
def segment_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, "v1")


@query(_segments_sql(2, 3, 9, (4.0, 3.5), 0.4))
def segment_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, "v2")


@query(_segments_sql(2, 3, 6, (6.5, 4.0), 0.2))
def segment_v2_r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir, "v2-r10")


@query(f"{decoded_sql(f'z AS (SELECT read_id, idx, event AS x FROM ({_segments_sql(1, 3, 6, (4.30265, 2.57058), 1.0, digits=15)}))', 0.3, 0.02)}, {RUNS}, {DENOISED} SELECT read_id, idx, round(x, 6) + 0.0 AS event, state FROM denoised")
def signal_to_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation, decoding and correction in one stage."""
    return long_corrected(correction.signal_to_corrected(supplier_reads(spark, sf_dir), MODEL, 0.3, 0.02))


@query(
    """WITH parts AS (SELECT l_orderkey, list_sort(list(l_extendedprice)) AS s, count(*) AS n FROM lineitem GROUP BY l_orderkey),
    q AS (SELECT *, s[(n // 4) + 1] AS q1, s[(3 * n // 4) + 1] AS q3 FROM parts)
    SELECT l_orderkey, n, round(coalesce(list_avg(list_filter(s, lambda x: x >= q1 - (q3 - q1) AND x <= q3 + (q3 - q1))), 0), 6) AS middle_mean FROM q"""
)
def middle_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the middle of each order's prices."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.collect_list("l_extendedprice").alias("s"))
    return parts.select("l_orderkey", "n", F.round(sig.middle_mean(F.col("s")), 6).alias("middle_mean"))


@query(
    f"""WITH {SUPPLIER_SIGNAL}, borders AS (SELECT DISTINCT read_id, idx FROM sig WHERE idx % 7 = 3),
    marked AS (SELECT s.*, sum((b.idx IS NOT NULL)::INT) OVER (PARTITION BY s.read_id ORDER BY s.idx) AS segment FROM sig s LEFT JOIN borders b ON s.read_id = b.read_id AND s.idx = b.idx),
    means AS (SELECT read_id, (segment - 1)::INT AS idx, avg(x) AS x FROM marked WHERE segment > 0 GROUP BY read_id, segment)
    SELECT read_id, idx, round((x - avg(x) OVER r) / nullif(stddev_pop(x) OVER r, 0), 6) + 0.0 AS event FROM means WINDOW r AS (PARTITION BY read_id) QUALIFY event IS NOT NULL"""
)
def border_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between given borders (here every seventh sample), z-scored means."""
    rows = supplier_signal(spark, sf_dir)
    borders = rows.filter("idx % 7 = 3").select("read_id", F.col("idx").alias("event_start"))
    return frames.border_segments(rows, borders).select("read_id", "idx", rounded(F.col("x")).alias("event"))


@query(f"WITH {USER_SIGNAL}, {Z}, {STATES}, {EMIT} SELECT read_id, idx, s, round(le, 6) + 0.0 AS le FROM emit")
def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with every state: the model's few rows are joined to all."""
    z = frames.z_scores(user_signal(spark, sf_dir)).filter("x is not null")
    both = z.crossJoin(F.broadcast(MODEL.states(spark)))
    return both.select("read_id", "idx", "s", rounded(sig.log_emission(F.col("x"), F.col("mean"), F.col("var"))).alias("le"))


@query(
    f"""WITH pairs AS (SELECT n_regionkey AS p, c_nationkey % 5 AS s, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    raw_edges AS (SELECT a.p, b.s, coalesce(n, 0)::DOUBLE AS prob FROM (SELECT DISTINCT p FROM pairs) a CROSS JOIN (SELECT DISTINCT s FROM pairs) b LEFT JOIN pairs USING (p, s)), {EDGES}, {LOG_EDGES}
    SELECT p::BIGINT AS p, s::BIGINT AS s, is_adjacent, round(prob, 9) AS prob, round(greatest(lp, -1e9), 6) + 0.0 AS lp FROM log_edges"""
)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of pairs as a transition table, re-parameterised, with logarithms."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pairs = joined.groupBy(F.col("n_regionkey").cast("long").alias("p"), (F.col("c_nationkey") % 5).cast("long").alias("s")).agg(F.count("*").alias("n"))
    square = pairs.select("p").distinct().crossJoin(pairs.select("s").distinct()).join(pairs, ["p", "s"], "left")
    edges = reparameterised(square.select("p", "s", F.coalesce("n", F.lit(0)).cast("double").alias("prob")), P_STAY, P_SKIP)
    lp = F.greatest(sig.log_or_none(F.col("prob")), F.lit(-1e9))
    return edges.select("p", "s", "is_adjacent", F.round("prob", 9).alias("prob"), rounded(lp).alias("lp"))


KMER_TABLE = f"levels AS (SELECT kmer, arg_max(level, line_no) AS level FROM (SELECT p_partkey AS line_no, p_retailprice AS level, list_aggregate(list_transform(range({K} - 1, -1, -1), lambda i: substr('ACGT', ((p_partkey % 300) // (4 ** i)::BIGINT) % 4 + 1, 1)), 'string_agg', '') AS kmer FROM part) GROUP BY kmer)"


def kmer_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a k-mer table: a part's key gives the k-mer, its price the level; the last part of a k-mer wins."""
    code = F.pmod(F.pmod("p_partkey", F.lit(300)), F.lit(4**K))
    return kmers.last_wins(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), sig.decoded_kmer(code, K).alias("kmer"), F.col("p_retailprice").alias("level")))


@query(
    f"""WITH {KMER_TABLE}, texts AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS dna FROM documents),
    slid AS (SELECT doc_id, unnest(range(0, length(dna) - {K} + 1))::INT AS t, dna FROM texts WHERE length(dna) >= {K})
    SELECT doc_id, count(*) AS n, count(level) AS n_known, round(sum(coalesce(level, 0.0)), 2) AS total FROM slid LEFT JOIN levels ON kmer = substr(dna, t + 1, {K}) GROUP BY doc_id"""
)
def kmer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers of the documents' letters A, C, G, T, counted by document and joined with their levels, 0 for those without."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("dna"))
    known = kmer_levels(spark, sf_dir).select(kmers.coded(F.col("kmer"), K).alias("code"), "level")
    out = kmers.counted(texts, "dna", K).join(known, "code", "left")
    total = F.sum(F.col("n") * F.coalesce("level", F.lit(0.0)))
    return out.groupBy("doc_id").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("level").isNotNull(), F.col("n"))), F.lit(0)).alias("n_known"), F.round(total, 2).alias("total"))


@query(
    f"""WITH {KMER_TABLE}, slid AS (SELECT unnest(range(0, {4**K}))::INT AS t)
    SELECT t, substr('{kmers.de_bruijn(K)}', t + 1, {K}) AS kmer, coalesce(level, 0.0) AS level FROM slid LEFT JOIN levels ON kmer = substr('{kmers.de_bruijn(K)}', t + 1, {K})"""
)
def debruijn_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of the k-mer table along the de Bruijn text."""
    return kmers.observations(spark, kmer_levels(spark, sf_dir), K).drop("chunk")



PAF = """rows AS (
    SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS row_id, l_orderkey AS qr_name, 1000 AS qr_len,
           l_returnflag <> 'R' AS is_mapped, (l_partkey % 90)::INT AS qr_st, (900 + l_suppkey % 100)::INT AS qr_en, l_linestatus = 'O' AS is_fwd,
           'chr' || l_suppkey % 3 AS rf_name, 10000 AS rf_len, (1 + l_partkey * 37 % 9000)::INT AS rf_st, (1 + l_partkey * 37 % 9000 + 900)::INT AS rf_en FROM lineitem),
q AS (SELECT row_id, qr_name, qr_len, is_mapped, CASE WHEN is_mapped THEN qr_st ELSE 1 END AS qr_st, CASE WHEN is_mapped THEN qr_en ELSE qr_len END AS qr_en, is_fwd, rf_name, rf_len, rf_st, rf_en FROM rows),
t AS (
    SELECT o_orderkey AS row_id, o_orderkey AS qr_name, 1000 AS qr_len, o_orderstatus <> 'P' AS is_mapped, 10 AS qr_st, 990 AS qr_en, o_custkey % 2 = 0 AS is_fwd,
           'chr' || o_custkey % 3 AS rf_name, 10000 AS rf_len, (1 + o_custkey * 61 % 9000)::INT AS rf_st, (1 + o_custkey * 61 % 9000 + 2000)::INT AS rf_en FROM orders)"""
STRETCHED = """SELECT *, greatest(1, rf_st - CASE WHEN is_fwd THEN head ELSE tail END) AS low, least(rf_len, rf_en + CASE WHEN is_fwd THEN tail ELSE head END) AS high
    FROM (SELECT *, trunc(qr_st * 1.5)::INT AS head, trunc((qr_len - qr_en) * 1.5)::INT AS tail FROM {})"""
LABELLED = f"""{PAF},
qx AS ({STRETCHED.format("q")}), tx AS ({STRETCHED.format("t")}),
first AS (SELECT qr_name, arg_min(is_mapped, row_id) AS truth_mapped FROM t GROUP BY qr_name),
hits AS (SELECT DISTINCT qx.row_id FROM qx JOIN tx ON qx.qr_name = tx.qr_name AND qx.rf_name = tx.rf_name WHERE qx.is_mapped AND tx.is_mapped AND greatest(qx.low, tx.low) <= least(qx.high, tx.high)),
labels AS (
    SELECT q.*, CASE WHEN NOT is_mapped THEN CASE WHEN coalesce(truth_mapped, false) THEN 'fn' ELSE 'tn' END
                     WHEN NOT coalesce(truth_mapped, false) THEN 'na' WHEN h.row_id IS NOT NULL THEN 'tp' ELSE 'fp' END AS label
    FROM q LEFT JOIN first USING (qr_name) LEFT JOIN hits h ON q.row_id = h.row_id)"""


def alignments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as alignments and orders as their truth: reads are orders, coordinates come from keys."""
    c = F.col
    item = table(spark, sf_dir, "lineitem").withColumn("key", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    mapped = c("l_returnflag") != "R"
    start = (1 + c("l_partkey") * 37 % 9000).cast("int")
    query_ = item.select(
        c("key").alias("row_id"), c("l_orderkey").alias("qr_name"), F.lit(1000).alias("qr_len"), mapped.alias("is_mapped"),
        F.when(mapped, (c("l_partkey") % 90).cast("int")).otherwise(1).alias("qr_st"), F.when(mapped, (900 + c("l_suppkey") % 100).cast("int")).otherwise(1000).alias("qr_en"),
        (c("l_linestatus") == "O").alias("is_fwd"), F.concat(F.lit("chr"), c("l_suppkey") % 3).alias("rf_name"), F.lit(10000).alias("rf_len"),
        start.alias("rf_st"), (start + 900).alias("rf_en"), F.array(F.concat(F.lit("mt:f:"), F.round(1 + c("l_quantity") / 10, 1))).alias("tags"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus",
    )
    start = (1 + c("o_custkey") * 61 % 9000).cast("int")
    truth = table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("row_id"), c("o_orderkey").alias("qr_name"), F.lit(1000).alias("qr_len"), (c("o_orderstatus") != "P").alias("is_mapped"), F.lit(10).alias("qr_st"), F.lit(990).alias("qr_en"),
        (c("o_custkey") % 2 == 0).alias("is_fwd"), F.concat(F.lit("chr"), c("o_custkey") % 3).alias("rf_name"), F.lit(10000).alias("rf_len"), start.alias("rf_st"), (start + 2000).alias("rf_en"),
    )
    return query_, truth


@query(f"WITH {LABELLED} SELECT qr_name, rf_name, rf_st, rf_en, label, count(*) AS n FROM labels GROUP BY ALL")
def alignment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.labelled(*alignments(spark, sf_dir))
    return out.groupBy("qr_name", "rf_name", "rf_st", "rf_en", "label").agg(F.count("*").alias("n"))


RATES = """SELECT *, coalesce(p + r, 0) AS s, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM (
    SELECT *, CASE WHEN n_tp + n_fp + {na} > 0 THEN n_tp::DOUBLE / (n_tp + n_fp + {na}) ELSE 0 END AS p, CASE WHEN n_tp + n_fn > 0 THEN n_tp::DOUBLE / (n_tp + n_fn) ELSE 0 END AS r
    FROM (SELECT rf_name, count(*) AS n, {counts} FROM labels GROUP BY rf_name))"""
_COUNTS = ", ".join(f"count(*) FILTER (label = '{x}') AS n_{x}" for x in alignment.LABELS)
_PCTS = ", ".join(f"round(100.0 * n_{x} / n, 2)::DOUBLE AS pct_{x}" for x in alignment.LABELS)


@query(f"WITH {LABELLED}, rates AS ({RATES.format(na=0, counts=_COUNTS)}) SELECT rf_name, n, n_tp, n_fp, n_fn, n_tn, n_na, {_PCTS}, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM rates")
def confusion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.rates(alignment.confusion(alignment.labelled(*alignments(spark, sf_dir)), ["rf_name"]))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {LABELLED}, rates AS ({RATES.format(na='n_na', counts=_COUNTS)}) SELECT rf_name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM rates")
def rates_with_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.rates(alignment.confusion(alignment.labelled(*alignments(spark, sf_dir)), ["rf_name"]), na_is_fp=True)
    return out.select("rf_name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    """WITH m AS (
        SELECT 'chr' || l_suppkey % 3 AS rf_name, (900 + l_suppkey % 100)::DOUBLE AS bp, round(1 + l_quantity / 10, 1) AS ms FROM lineitem WHERE l_returnflag <> 'R')
    SELECT rf_name, count(*) AS n_timed, round(avg(1000 * bp / ms), 4) AS mean_bp_per_s, round(median(1000 * bp / ms), 4) AS median_bp_per_s, round(avg(bp), 4) AS mean_bp, median(bp) AS median_bp, round(avg(ms), 4) AS mean_ms, median(ms) AS median_ms
    FROM m GROUP BY rf_name"""
)
def mapping_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.throughput(alignments(spark, sf_dir)[0], ["rf_name"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean_bp_per_s", "median_bp_per_s", "mean_bp", "mean_ms")})


@query(
    """SELECT round(avg(ms), 6) AS mean_ms, round(avg(bases), 6) AS mean_bases, round(avg(chunks), 6) AS mean_chunks, median(ms) AS median_ms
    FROM (SELECT round(1 + l_quantity / 10, 1) AS ms, 900 + l_suppkey % 100 AS bases, l_linenumber AS chunks FROM lineitem)"""
)
def annotated_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as annotated alignment lines, parsed again and averaged."""
    c = F.col
    tail = F.concat(F.lit("mt:f:"), F.round(1 + c("l_quantity") / 10, 1), F.lit(" ci:i:"), c("l_linenumber"), F.lit(" sl:i:"), 900 + c("l_suppkey") % 100)
    filler = lambda n: F.lit(" ".join(["x"] * n) + " ")
    line = F.when(c("l_returnflag") != "R", F.concat(filler(16), tail, F.lit(" rf:Z:tp"))).otherwise(F.concat(filler(11), tail, F.lit(" rf:Z:fn")))
    out = alignment.read_costs(text.parsed_annotated(table(spark, sf_dir, "lineitem").select(line.alias("value"))))
    return out.select(*[F.round(f"mean_{x}", 6).alias(f"mean_{x}") for x in ("ms", "bases", "chunks")], "median_ms")


@query("SELECT vec_id::VARCHAR AS read_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 6))), 4) + 0.0 AS total FROM embeddings")
def event_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays written as lines of an event table and parsed again."""
    lines = sinks.event_lines(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("read_id"), F.col("embedding").alias("events")))
    back = text.parsed_events(lines)
    return back.select("read_id", F.size("events").alias("n"), rounded(F.aggregate("events", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"WITH {LABELLED} SELECT qr_name::VARCHAR AS qr_name, is_mapped, qr_st, qr_en, CASE WHEN is_mapped THEN rf_name END AS rf_name, label, count(*) AS n FROM labels GROUP BY ALL")
def alignment_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled alignments written as lines, parsed again, with their label as a tag."""
    rows = alignment.labelled(*alignments(spark, sf_dir))
    strand = F.when(~F.col("is_mapped"), "*").when(F.col("is_fwd"), "+").otherwise("-")
    raw = F.concat_ws("\t", "qr_name", "qr_len", "qr_st", "qr_en", strand, "rf_name", "rf_len", "rf_st", "rf_en", F.lit("0"), F.lit("0"), F.lit("60"), F.col("tags")[0])
    back = text.parsed_alignments(sinks.annotated_lines(rows.withColumn("raw_line", raw)))
    return back.select("qr_name", "is_mapped", "qr_st", "qr_en", "rf_name", sig.tag(F.col("tags"), "rf:Z:").alias("label")).groupBy("qr_name", "is_mapped", "qr_st", "qr_en", "rf_name", "label").agg(F.count("*").alias("n"))


def _agreement(out: DataFrame) -> DataFrame:
    """A score for corrected reads, by pair of parameters: the share of events within one deviation of their state's mean."""
    z = out.select("p_stay", "p_skip", F.explode(F.arrays_zip("events", "states")).alias("z"))
    near = F.pow(F.col("z.events") - F.get(F.lit(list(MODEL.means)), F.col("z.states")), 2) <= F.get(F.lit(list(MODEL.variances)), F.col("z.states"))
    return z.groupBy("p_stay", "p_skip").agg(F.count("*").alias("n_events"), F.round(F.avg(near.cast("double")), 6).alias("score"))


def _each_pair_sql(select: str, grid: tuple[float, ...] = tuning.GRID) -> str:
    """A query over denoised events (read_id, idx, x, state) for each pair of the grid, each decoded by its own recursion."""
    parts = []
    for p_stay in grid:
        for p_skip in grid:
            runs = RUNS if MODEL.collapses(p_stay) else "collapsed AS (SELECT * FROM path)"
            parts.append(f"SELECT {p_stay}::DOUBLE AS p_stay, {p_skip}::DOUBLE AS p_skip, * FROM ({decoded_sql(f'{USER_SIGNAL}, {Z}', p_stay, p_skip)}, {runs}, {DENOISED} {select})")
    return " UNION ALL ".join(parts)


_GRID = _each_pair_sql("SELECT count(*) AS n_events, round(avg((pow(d.x - mean, 2) <= var)::INT), 6) AS score FROM denoised d JOIN states ON s = state")


@query(_GRID)
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over the whole grid of decoding parameters, in one pass over the reads."""
    return tuning.grid_scores(user_reads(spark, sf_dir), MODEL, _agreement)


@query(f"SELECT * FROM ({_GRID}) ORDER BY score DESC, p_stay, p_skip LIMIT 1")
def best_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.best(parameter_grid(spark, sf_dir), "score")


@query()
def climbed_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hill climbing from the grid's best pair; a round's neighbours are decoded together in one job over all reads."""
    reads = user_reads(spark, sf_dir).persist()

    def scores(pairs: list[tuple[float, float]]) -> dict[tuple[float, float], float]:
        return tuning.scores_of(_agreement(decode.correct_grid(reads, MODEL, pairs)), "score", pairs)

    start = tuning.best(tuning.grid_scores(reads, MODEL, _agreement), "score").first()
    (p_stay, p_skip), top, tried = tuning.climbed(lambda *pair: scores([pair])[pair], (start["p_stay"], start["p_skip"]) if start else (0.0, 0.0), ahead=scores)
    reads.unpersist()
    return spark.createDataFrame([(p_stay, p_skip, top, tried)], "p_stay double, p_skip double, score double, n_tried int")


def mapped_reads(out: DataFrame) -> DataFrame:
    """A toy mapper in a mapper's place: a corrected read lies on the reference of its most frequent state, where its length says; short ones stay unmapped."""
    key = ["p_stay", "p_skip", "read_id"]
    counts = out.select(*key, F.explode("states").alias("s")).groupBy(*key, "s").count()
    reads = counts.groupBy(*key).agg(F.sum("count").cast("int").alias("n"), F.max_by("s", F.struct("count", -F.col("s"))).alias("s"))
    start = (1 + 20 * F.col("n")).cast("int")
    return reads.select(
        "p_stay", "p_skip", F.col("read_id").alias("row_id"), F.col("read_id").alias("qr_name"), F.lit(1000).alias("qr_len"), (F.col("n") >= 25).alias("is_mapped"), F.lit(0).alias("qr_st"), F.lit(1000).alias("qr_en"),
        F.lit(True).alias("is_fwd"), F.concat(F.lit("chr"), F.col("s") % 3).alias("rf_name"), F.lit(100_000).alias("rf_len"), start.alias("rf_st"), (start + 200).alias("rf_en"),
    )


@query(
    f"""WITH each AS ({_each_pair_sql("SELECT read_id, state, count(*) AS k FROM denoised GROUP BY read_id, state")}),
    mapped AS (SELECT p_stay, p_skip, read_id, sum(k)::INT AS n, first(state ORDER BY k DESC, state) AS s FROM each GROUP BY p_stay, p_skip, read_id),
    truth AS (
        SELECT user_id AS read_id, user_id % 7 <> 0 AS known, 'chr' || user_id % 3 AS rf_name, 1 + 15 * count(*) AS low, 1 + 15 * count(*) + 200 AS high
        FROM events WHERE value > 30 AND value < 200 GROUP BY user_id),
    labels AS (
        SELECT p_stay, p_skip, CASE WHEN n < 25 THEN CASE WHEN known THEN 'fn' ELSE 'tn' END WHEN NOT known THEN 'na'
                                    WHEN 'chr' || s % 3 = rf_name AND greatest(low, 1 + 20 * n) <= least(high, 20 * n + 201) THEN 'tp' ELSE 'fp' END AS label
        FROM mapped JOIN truth USING (read_id)),
    counts AS (SELECT p_stay, p_skip, count(*) AS n, {", ".join(f"count(*) FILTER (label = '{x}') AS n_{x}" for x in alignment.LABELS)} FROM labels GROUP BY p_stay, p_skip),
    rates AS (SELECT *, CASE WHEN n_tp + n_fp > 0 THEN n_tp::DOUBLE / (n_tp + n_fp) ELSE 0 END AS p, CASE WHEN n_tp + n_fn > 0 THEN n_tp::DOUBLE / (n_tp + n_fn) ELSE 0 END AS r FROM counts)
    SELECT p_stay, p_skip, n, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM rates"""
)
def grid_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search's objective: F1 of the mappings of the corrected reads against a truth, for each pair of the grid."""
    size = F.count("*").cast("int")
    truth = band_rows(spark, sf_dir).groupBy("user_id").agg((1 + 15 * size).cast("int").alias("rf_st"))
    truth = truth.select(
        F.col("user_id").alias("row_id"), F.col("user_id").alias("qr_name"), F.lit(1000).alias("qr_len"), (F.col("user_id") % 7 != 0).alias("is_mapped"), F.lit(0).alias("qr_st"), F.lit(1000).alias("qr_en"),
        F.lit(True).alias("is_fwd"), F.concat(F.lit("chr"), F.col("user_id") % 3).alias("rf_name"), F.lit(100_000).alias("rf_len"), "rf_st", (F.col("rf_st") + 200).alias("rf_en"),
    )
    out = tuning.grid_scores(user_reads(spark, sf_dir), MODEL, lambda corrected: tuning.f1_scores(mapped_reads(corrected), truth))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


WAYS = {"v1": (1, 3, 6, (4.30265, 2.57058), 1.0), "v2": (2, 3, 9, (4.0, 3.5), 0.4), "v2-r10": (2, 3, 6, (6.5, 4.0), 0.2)}


def _way_sql(name: str) -> str:
    """Events a read by one segmenter, raw and corrected."""
    events = _segments_sql(*WAYS[name], digits=15)
    corrected = f"{decoded_sql(f'z AS (SELECT read_id, idx, event AS x FROM ({events}))', 0.3, 0.02)}, {RUNS} SELECT read_id, count(*) AS n FROM collapsed GROUP BY read_id"
    return f"SELECT '{name}' AS segmenter, false AS corrected, read_id, count(*) AS n FROM ({events}) GROUP BY read_id UNION ALL SELECT '{name}', true, read_id, n FROM ({corrected})"


@query(
    f"""WITH mapped AS ({" UNION ALL ".join(_way_sql(name) for name in WAYS)}),
    truth AS (SELECT l_suppkey AS read_id, l_suppkey % 5 <> 0 AS known, 'chr' || l_suppkey % 2 AS rf_name, 1 + 10 * (count(*) // 20) AS low FROM lineitem GROUP BY l_suppkey),
    labels AS (
        SELECT segmenter, corrected, CASE WHEN n < 20 THEN CASE WHEN known THEN 'fn' ELSE 'tn' END WHEN NOT known THEN 'na'
                                          WHEN 'chr' || n % 2 = rf_name AND greatest(low, 1 + 10 * n) <= least(low + 400, 101 + 10 * n) THEN 'tp' ELSE 'fp' END AS label
        FROM mapped JOIN truth USING (read_id)),
    counts AS (SELECT segmenter, corrected, count(*) AS n, {", ".join(f"count(*) FILTER (label = '{x}') AS n_{x}" for x in alignment.LABELS)} FROM labels GROUP BY segmenter, corrected),
    rates AS (SELECT *, CASE WHEN n_tp + n_fp > 0 THEN n_tp::DOUBLE / (n_tp + n_fp) ELSE 0 END AS p, CASE WHEN n_tp + n_fn > 0 THEN n_tp::DOUBLE / (n_tp + n_fn) ELSE 0 END AS r FROM counts)
    SELECT segmenter, corrected, n, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM rates"""
)
def evaluation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 after each way to segment the suppliers' signals, raw and corrected; a toy mapper places reads by their number of events."""
    n, start = F.size("events"), (1 + 10 * F.size("events")).cast("int")
    place = [F.lit(1000).alias("qr_len"), F.lit(0).alias("qr_st"), F.lit(1000).alias("qr_en"), F.lit(True).alias("is_fwd"), F.lit(100_000).alias("rf_len")]

    def mapper(events: DataFrame) -> DataFrame:
        name = F.concat(F.lit("chr"), n % 2)
        return events.select("segmenter", "corrected", F.col("read_id").alias("row_id"), F.col("read_id").alias("qr_name"), (n >= 20).alias("is_mapped"), name.alias("rf_name"), start.alias("rf_st"), (start + 100).alias("rf_en"), *place)

    low = (1 + 10 * F.floor(F.count("*") / 20)).cast("int")
    truth = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("qr_name")).agg(low.alias("rf_st"))
    truth = truth.select(F.col("qr_name").alias("row_id"), "qr_name", (F.col("qr_name") % 5 != 0).alias("is_mapped"), F.concat(F.lit("chr"), F.col("qr_name") % 2).alias("rf_name"), "rf_st", (F.col("rf_st") + 400).alias("rf_en"), *place)
    ways = evaluation.segmented_ways(supplier_reads(spark, sf_dir), {name: name for name in WAYS}, MODEL, 0.3, 0.02)
    return evaluation.evaluated(ways, mapper, truth).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def _mixture_sql(table_: str, column: str, n: int, seed: int, rounds: int = 500, tol: float = 1e-6) -> str:
    """training.mixture() as a recursion over rounds: the first means one by one, then arrays of parameters."""
    seeds, known = [], []
    for k in range(n):
        u = f"((abs(x) * {training.GOLDEN * (seed + k + 1)!r}::DOUBLE) % 1.0::DOUBLE + 1e-9::DOUBLE)"
        near = f"least({', '.join(f'pow(x - m{j}, 2)' for j in known)})" if known else ""
        order = f"ln({u}) / {near} DESC" if known else f"{u} DESC"
        seeds.append(f"seed{k} AS MATERIALIZED (SELECT x AS m{k} FROM vals{''.join(f', seed{j}' for j in known)} {f'WHERE {near} > 0' if known else ''} ORDER BY {order}, x LIMIT 1)")
        known.append(k)
    logs = [f"ln(w[{k + 1}]) - 0.5 * ln(2 * pi() * v[{k + 1}]) - pow(x - m[{k + 1}], 2) / (2 * v[{k + 1}])" for k in range(n)]
    terms = ", ".join(f"l{k} - top AS d{k}" for k in range(n))
    both = " + ".join(f"exp(d{k})" for k in range(n))
    mass = ", ".join(f"greatest(sum(c * exp(d{k}) / s), 1e-12) AS mass{k}, sum(c * exp(d{k}) / s * x) AS first{k}, sum(c * exp(d{k}) / s * pow(x - m[{k + 1}], 2)) AS second{k}" for k in range(n))
    means = ", ".join(f"first{k} / mass{k}" for k in range(n))
    variances = ", ".join(f"greatest(second{k} / mass{k} - pow(first{k} / mass{k} - m[{k + 1}], 2), {training.LEAST_VARIANCE})" for k in range(n))
    return f"""WITH RECURSIVE vals AS MATERIALIZED (SELECT {column}::DOUBLE AS x, count(*) AS c FROM {table_} WHERE {column} IS NOT NULL GROUP BY 1),
    {", ".join(seeds)},
    em AS (
        SELECT 0 AS k, list_sort([{", ".join(f"m{k}" for k in range(n))}]) AS m, [greatest(var_pop / {n}, 1e-4) FOR i IN range({n})] AS v, [1.0::DOUBLE / {n} FOR i IN range({n})] AS w, NULL::DOUBLE AS ll, false AS done
        FROM {", ".join(f"seed{k}" for k in range(n))}, (SELECT var_pop({column}::DOUBLE) AS var_pop FROM {table_})
        UNION ALL
        SELECT k + 1, [{means}], [{variances}], [{", ".join(f"mass{k} / total" for k in range(n))}], new, coalesce(abs(new - ll) <= {tol} * abs(ll), false)
        FROM (SELECT k, m, ll, sum(c) AS total, sum(c * (top + ln(s))) AS new, {mass}
              FROM (SELECT *, {both} AS s FROM (SELECT k, m, ll, x, c, top, {terms}
                    FROM (SELECT *, greatest({", ".join(f"l{k}" for k in range(n))}) AS top FROM (SELECT k, m, ll, x, c, {", ".join(f"{x} AS l{k}" for k, x in enumerate(logs))} FROM em, vals WHERE NOT done AND k < {rounds}))))
              GROUP BY k, m, ll)),
    last AS (SELECT * FROM em ORDER BY k DESC LIMIT 1), states AS (SELECT unnest(m) AS mean, unnest(v) AS var, unnest(w) AS weight FROM last)"""


@query(f"{_mixture_sql('part', 'p_retailprice', 4, 1)} SELECT (row_number() OVER (ORDER BY mean) - 1)::INT AS s, round(mean, 3) AS mean, round(var, 2) AS var, round(weight, 5) AS weight FROM states")
def mixture_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of normals fitted to the parts' prices until it converges."""
    means, variances, weights = training.mixture(table(spark, sf_dir, "part"), "p_retailprice", 4, seed=1)
    return spark.createDataFrame([(i, round(float(m), 3), round(float(v), 2), round(float(w), 5)) for i, (m, v, w) in enumerate(zip(means, variances, weights))], "s int, mean double, var double, weight double")


@query(
    f"""WITH vals AS (SELECT o_totalprice AS x, count(*) AS m FROM orders GROUP BY 1),
    first AS (SELECT x AS x0 FROM vals ORDER BY (abs(x) * {training.GOLDEN * 2!r}::DOUBLE) % 1.0::DOUBLE + 1e-9::DOUBLE DESC, x LIMIT 1)
    SELECT x FROM vals, first WHERE x <> x0 ORDER BY ln((abs(x) * {training.GOLDEN * 3!r}::DOUBLE) % 1.0::DOUBLE + 1e-9::DOUBLE) / (pow(x - x0, 2) * m) DESC, x LIMIT 256"""
)
def seeding_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round of seeding 128 states with the orders' prices: 256 candidates in one job."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_totalprice").cast("double").alias("x")).agg(F.count("*").alias("m"))
    first = training.spread_means(rows, 1, seed=1, rounds=0)
    return spark.createDataFrame([(x,) for x in training.oversampled(rows, first, 256, 1, 2)], "x double")


def _expected_sql(tag: str, means: str) -> str:
    """Forward-backward over chunks (obs: c, t, x, n) with the means of a one-row table: gam<tag> has c, t, x, g (state probabilities), f, ahead, scale."""
    n = len(MODEL.means)
    var = "[" + ", ".join(f"{v}::DOUBLE" for v in MODEL.variances) + "]"
    to = lambda a, s: f"(list_sum({a}) - {a}[{s}]) / {n - 1}"  # noqa: E731  the start's transitions are even but for the diagonal
    emit = f"[exp(-0.5 * pow(x - m[s], 2) / ({var})[s]) / sqrt(2 * pi() * ({var})[s]) FOR s IN range(1, {n + 1})]"
    normed = "SELECT c, t, [z / sc FOR z IN a] AS f, sc AS scale FROM (SELECT *, greatest(list_sum(a), 1e-300) AS sc FROM ({}))"
    return f"""em{tag} AS MATERIALIZED (SELECT c, t, x, n, {emit} AS e FROM obs, {means}),
    fw{tag} AS (
        {normed.format(f"SELECT c, t, [z / {n} FOR z IN e] AS a FROM em{tag} WHERE t = 0")}
        UNION ALL
        {normed.format(f"SELECT o.c, o.t, [({to('w.f', 's')}) * o.e[s] FOR s IN range(1, {n + 1})] AS a FROM fw{tag} w JOIN em{tag} o ON o.c = w.c AND o.t = w.t + 1")}),
    fs{tag} AS MATERIALIZED (SELECT w.c, w.t, o.x, o.n, o.e, w.f, w.scale FROM fw{tag} w JOIN em{tag} o ON o.c = w.c AND o.t = w.t),
    bw{tag} AS (
        SELECT c, t, [1.0::DOUBLE FOR s IN range({n})] AS b, NULL::DOUBLE[] AS ahead FROM fs{tag} WHERE t = n - 1
        UNION ALL
        SELECT c, t, [{to("ahead", "s")} FOR s IN range(1, {n + 1})] AS b, ahead
        FROM (SELECT o.c, o.t - 1 AS t, [o.e[s] * w.b[s] / o.scale FOR s IN range(1, {n + 1})] AS ahead FROM bw{tag} w JOIN fs{tag} o ON o.c = w.c AND o.t = w.t WHERE o.t > 0)),
    gam{tag} AS MATERIALIZED (SELECT s.c, s.t, s.x, s.f, s.scale, w.ahead, [s.f[i] * w.b[i] FOR i IN range(1, {n + 1})] AS g FROM fs{tag} s JOIN bw{tag} w ON s.c = w.c AND s.t = w.t)"""


_N = len(MODEL.means)
_PASSES = f"""WITH RECURSIVE {SUPPLIER_SIGNAL}, {Z}, kept AS (SELECT read_id, idx, x, count(*) OVER (PARTITION BY read_id) AS n FROM z WHERE x IS NOT NULL),
    parts AS (SELECT read_id, idx, x, CASE WHEN idx < n % 4 * (n // 4 + 1) THEN idx // (n // 4 + 1) ELSE n % 4 + (idx - n % 4 * (n // 4 + 1)) // (n // 4) END AS part FROM kept),
    obs AS MATERIALIZED (SELECT read_id * 4 + part AS c, row_number() OVER (PARTITION BY read_id, part ORDER BY idx) - 1 AS t, x, count(*) OVER (PARTITION BY read_id, part) AS n FROM parts),
    given AS (SELECT [{", ".join(f"{m}::DOUBLE" for m in MODEL.means)}] AS m), {_expected_sql("1", "given")},
    sums AS MATERIALIZED (SELECT s, sum(g[s]) AS mass, sum(g[s] * x) AS first FROM gam1, range(1, {_N + 1}) a(s) GROUP BY s),
    moved AS MATERIALIZED (SELECT list(first / mass ORDER BY s) AS m FROM sums), {_expected_sql("2", "moved")},
    var AS (SELECT s, greatest(sum(g[s] * pow(x - m[s], 2)) / any_value(mass), {training.LEAST_VARIANCE}) AS var FROM gam2, moved, sums GROUP BY s),
    pairs AS (SELECT p, q, sum(f[p] * ahead[q]) / {_N - 1} AS k FROM gam1, range(1, {_N + 1}) a(p), range(1, {_N + 1}) b(q) WHERE ahead IS NOT NULL AND p <> q GROUP BY p, q)"""


def _round_sql(below: float) -> str:
    """A round's model; transitions under `below` are cut and the rest raised to 1."""
    return f"""{_PASSES},
    shares AS (SELECT p, q, k / sum(k) OVER (PARTITION BY p) AS share FROM pairs), cut AS (SELECT p, q, CASE WHEN share < {below} THEN 0 ELSE share END AS share FROM shares),
    probs AS (SELECT p, q, share / sum(share) OVER (PARTITION BY p) AS prob FROM cut UNION ALL SELECT s, s, 0 FROM sums)
    SELECT (p - 1)::INT AS p, (q - 1)::INT AS s, round(first / mass, 6) AS mean, round(var, 6) AS var, round(prob, 6) AS prob, round((SELECT sum(ln(scale)) FROM gam1), 2) AS log_likelihood
    FROM probs JOIN sums ON sums.s = p JOIN var ON var.s = p"""


def _model_rows(spark: SparkSession, model: Model, log: list[float]) -> DataFrame:
    rows = [(i, j, round(float(model.means[i]), 6), round(float(model.variances[i]), 6), round(float(p), 6), round(log[-1], 2)) for i, row in enumerate(model.transitions) for j, p in enumerate(row)]
    return spark.createDataFrame(rows, "p int, s int, mean double, var double, prob double, log_likelihood double")


def supplier_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' z-scored signals in four chunks each: xs."""
    signal = kmers.chunked(frames.z_scores(supplier_signal(spark, sf_dir)).filter("x is not null"), 4)
    at = F.sort_array(F.collect_list(F.struct("idx", "x")))
    return signal.groupBy("read_id", "chunk").agg(F.transform(at, lambda s: s["x"]).alias("xs"))


@query(_round_sql(0))
def training_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of training on chunks of the suppliers' signals."""
    return _model_rows(spark, *training.trained(supplier_chunks(spark, sf_dir), *map(training.np.array, (MODEL.means, MODEL.variances)), most=1))


@query(_round_sql(0.22))
def pruning_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a round in which small transitions are cut, here those under 0.22."""
    return _model_rows(spark, *training.trained(supplier_chunks(spark, sf_dir), *map(training.np.array, (MODEL.means, MODEL.variances)), most=1, prune_after=0, prune_below=0.22))


@query()
def trained_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model trained on the users' z-scored signals until it changes little, after more than 150 rounds (1,001 unless told otherwise), with small transitions cut from the hundredth on."""
    chunks = user_reads(spark, sf_dir).select(F.col("events").alias("xs"))
    return _model_rows(spark, *training.trained(chunks, *map(training.np.array, (MODEL.means, MODEL.variances)), least=150))


@query(
    """WITH stats AS (SELECT c_nationkey % 5 AS s, round(avg(c_acctbal), 6) AS mean, round(var_pop(c_acctbal), 6) AS var FROM customer GROUP BY ALL),
    pairs AS (SELECT n_regionkey AS p, c_nationkey % 5 AS s, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    square AS (SELECT a.s AS p, b.s AS s, coalesce(n, 0) AS n FROM stats a CROSS JOIN stats b LEFT JOIN pairs ON pairs.p = a.s AND pairs.s = b.s)
    SELECT p::INT AS p, s::INT AS s, mean, var, round(n::DOUBLE / sum(n) OVER (PARTITION BY p), 6) AS prob FROM square JOIN (SELECT s AS p, mean, var FROM stats) USING (p)"""
)
def model_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances and regions as a model, written as a model file's lines and parsed again."""
    customers = table(spark, sf_dir, "customer").withColumn("s", (F.col("c_nationkey") % 5).cast("int"))
    stats = customers.groupBy("s").agg(F.avg("c_acctbal").alias("mean"), F.var_pop("c_acctbal").alias("var"))
    joined = customers.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pairs = joined.groupBy(F.col("n_regionkey").cast("int").alias("p"), "s").agg(F.count("*").alias("n"))
    states = {r["s"]: r for r in stats.collect()}
    counts = {(r["p"], r["s"]): r["n"] for r in pairs.collect()}  # at most 5 x 5
    total = {p: sum(counts.get((p, s), 0) for s in states) or 1 for p in states}
    order = sorted(states)
    lines = sinks.model_lines([states[s]["mean"] for s in order], [states[s]["var"] for s in order], [[counts.get((p, s), 0) / total[p] for s in order] for p in order])
    model = text.parsed_model(lines)
    return spark.createDataFrame([(p, s, model.means[p], model.variances[p], model.transitions[p][s]) for p in order for s in order], "p int, s int, mean double, var double, prob double")


@query(f"WITH {KMER_TABLE} SELECT kmer, level FROM levels")
def kmer_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a k-mer table, among comments and odd lines, parsed again; the last line of a k-mer wins."""
    parts = table(spark, sf_dir, "part")
    code = F.pmod(F.pmod("p_partkey", F.lit(300)), F.lit(4**K))
    line = F.concat_ws("\t", sig.decoded_kmer(code, K), F.col("p_retailprice").cast("string"))
    lines = parts.select("p_partkey", F.explode(F.array(F.concat(F.lit("# "), line), line, F.lit(""), F.lit("NNNN x"))).alias("value"))
    parsed = text.parsed_kmers(lines.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").select("value"))
    return kmers.last_wins(parsed)


RAW_SQL = """WITH raw AS (SELECT user_id, event_id, floor(value)::INT AS v FROM events), pa AS (SELECT user_id, (v + 10.0::DOUBLE) * (2.0::DOUBLE / 4.0::DOUBLE) AS x FROM raw)
    SELECT user_id::VARCHAR AS read_id, count(*) FILTER (x > 30 AND x < 200) AS n, round(coalesce(sum(x) FILTER (x > 30 AND x < 200), 0), 4) AS total FROM pa GROUP BY user_id"""


@query(RAW_SQL)
def slow5_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' values as SLOW5 lines, read again: calibrated by range and inside the band."""
    reads = correction.gathered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    raw = F.array_join(F.transform("signal", lambda x: F.floor(x).cast("int").cast("string")), ",")
    lines = reads.select(F.concat_ws("\t", F.col("read_id").cast("string"), F.lit("0"), F.lit("4"), F.lit("10"), F.lit("2"), F.lit("4000"), F.size("signal").cast("string"), raw).alias("value"))
    back = text.parsed_slow5(lines.select(F.explode(F.array(F.lit("#slow5_version\t0.2.0"), F.lit("@x\ty"), "value")).alias("value")))
    total = F.aggregate("signal_pA", F.lit(0.0), lambda a, x: a + x)
    return back.select("read_id", F.size("signal_pA").cast("long").alias("n"), F.round(total, 4).alias("total"))


def _binary_round_trip(spark: SparkSession, sf_dir: str, kind: str, compression: str) -> DataFrame:
    """Users' values as raw samples in files of a kind, read again in small partitions."""
    reads = correction.gathered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    raw = F.transform("signal", lambda x: F.floor(x).cast("short"))
    name = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("read_id").cast("string"), 12, "0"))
    path = shared.unused_path(spark, kind)
    binary.register(spark)
    rows = reads.select(name.alias("read_id"), raw.alias("raw"), F.lit(4.0).alias("digitisation"), F.lit(10.0).alias("offset"), F.lit(2.0).alias("range"))
    rows.write.format(kind).mode("append").option("compression", compression).save(path)
    back = spark.read.format(kind).option("partitionBytes", 100_000).load(path)
    total = F.aggregate("signal_pA", F.lit(0.0), lambda a, x: a + x)
    return back.select(F.substring("read_id", -12, 12).cast("long").cast("string").alias("read_id"), F.size("signal_pA").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query(RAW_SQL)
def blow5_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary_round_trip(spark, sf_dir, "blow5", "zlib")


@query(RAW_SQL)
def pod5_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary_round_trip(spark, sf_dir, "pod5", "zstd")


@query("SELECT 'bad line' AS reason, 2 * count(*) AS n FROM part")
def kmer_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the bad lines among parts as lines of a k-mer table, and how many there are."""
    line = F.concat_ws("\t", sig.decoded_kmer(F.pmod("p_partkey", F.lit(4**K)), K), F.col("p_retailprice").cast("string"))
    lines = table(spark, sf_dir, "part").select(F.explode(F.array(line, F.lit("# x"), F.lit("ACGT"), F.lit(""), F.lit("ACGT x"))).alias("value"))
    return text.kmer_rows(lines).filter("error is not null").groupBy(F.col("error").alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {LABELLED}, rates AS ({RATES.format(na=0, counts=_COUNTS)}),
    m AS (SELECT 'chr' || l_suppkey % 3 AS rf_name, (900 + l_suppkey % 100)::DOUBLE AS bp, round(1 + l_quantity / 10, 1) AS ms FROM lineitem WHERE l_returnflag <> 'R'),
    speed AS (SELECT rf_name, avg(1000 * bp / ms) AS a1, median(1000 * bp / ms) AS b1, avg(bp) AS a2, median(bp) AS b2, avg(ms) AS a3, median(ms) AS b3 FROM m GROUP BY rf_name),
    lines AS (SELECT rf_name AS key, [
        'Summary: ' || n || ' reads, ' || n_tp + n_fp + n_na || ' mapped', chr(9) || 'P' || chr(9) || 'N',
        'T' || chr(9) || printf('%.2f', round(100.0 * n_tp / n, 2)) || chr(9) || printf('%.2f', round(100.0 * n_tn / n, 2)), 'F' || chr(9) || printf('%.2f', round(100.0 * n_fp / n, 2)) || chr(9) || printf('%.2f', round(100.0 * n_fn / n, 2)),
        'NA: ' || printf('%.2f', round(100.0 * n_na / n, 2)), 'precision: ' || printf('%.6f', p), 'recall: ' || printf('%.6f', r), 'f1: ' || printf('%.6f', f),
        'BP per sec: ' || printf('%.2f', a1) || ' ' || printf('%.2f', b1), 'BP mapped: ' || printf('%.2f', a2) || ' ' || printf('%.2f', b2), 'MS to map: ' || printf('%.2f', a3) || ' ' || printf('%.2f', b3)] AS v FROM rates JOIN speed USING (rf_name))
    SELECT key, unnest(range(0, 11))::INT AS line_no, unnest(v) AS value FROM lines"""
)
def annotation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed report of each reference's mappings: summary, matrix of positives and negatives, unknown ones, speed."""
    mapped, truth = alignments(spark, sf_dir)
    scores = alignment.rates(alignment.confusion(alignment.labelled(mapped, truth), ["rf_name"]))
    return sinks.report_lines(scores.join(alignment.throughput(mapped, ["rf_name"]), "rf_name"), "rf_name")


@query(
    f"""WITH {LABELLED}, rates AS ({RATES.format(na=0, counts=_COUNTS)})
    SELECT name, round(sum(number), 4) AS number FROM (
        SELECT unnest(['Summary', 'NA', 'precision', 'recall', 'f1']) AS name, unnest([n::DOUBLE, round(100.0 * n_na / n, 2)::DOUBLE, round(p, 6), round(r, 6), round(f, 6)]) AS number FROM rates) GROUP BY name"""
)
def summary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's lines parsed again, and their numbers added up over the references."""
    lines = sinks.report_lines(alignment.rates(alignment.confusion(alignment.labelled(*alignments(spark, sf_dir)), ["rf_name"])), "rf_name")
    return text.parsed_summary(lines.select("value")).groupBy("name").agg(F.round(F.sum("number"), 4).alias("number"))


@query(f"{DECODED}, {RUNS}, {DENOISED} SELECT read_id::VARCHAR AS read_id, idx, printf('%.6g', x)::DOUBLE AS event FROM denoised")
def corrected_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected reads as lines with six significant digits, parsed again."""
    out = correction.correct_events(user_reads(spark, sf_dir), MODEL, P_STAY, P_SKIP, WIDTH).filter("events is not null")
    return text.parsed_events(sinks.corrected_lines(out)).select("read_id", F.posexplode("events").alias("idx", "event"))


@query(
    f"""WITH {SUPPLIER_SIGNAL}, marked AS (SELECT *, sum((idx % 7 = 3)::INT) OVER (PARTITION BY read_id ORDER BY idx) AS segment FROM sig),
    means AS (SELECT read_id, (segment - 1)::INT AS idx, avg(x) AS x FROM marked WHERE segment > 0 GROUP BY read_id, segment)
    SELECT read_id::VARCHAR AS read_id, idx, printf('%.4f', (x - avg(x) OVER r) / nullif(stddev_pop(x) OVER r, 0))::DOUBLE + 0.0 AS event FROM means WINDOW r AS (PARTITION BY read_id) QUALIFY event IS NOT NULL"""
)
def border_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events between borders as lines with four decimals, parsed again."""
    rows = supplier_signal(spark, sf_dir)
    out = frames.border_segments(rows, rows.filter("idx % 7 = 3").select("read_id", F.col("idx").alias("event_start")))
    reads = out.groupBy("read_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"]).alias("events"))
    return text.parsed_events(sinks.event_lines(reads, 4)).select("read_id", F.posexplode("events").alias("idx", "event")).withColumn("event", F.col("event") + F.lit(0.0))


@query(f"WITH events_ AS ({_segments_sql(*WAYS['v2-r10'])}), all_reads AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem), segmented AS (SELECT count(DISTINCT read_id) AS k FROM events_) SELECT n AS n_reads, k AS n_written, n - k AS n_skipped FROM all_reads, segmented")
def segmentation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a segmentation run counts as it writes: reads, those with events, those without."""
    out, seen = sinks.counted(segment.segment_reads(supplier_reads(spark, sf_dir), "v2-r10"))
    out.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[c] for c in ("n_reads", "n_written", "n_skipped"))], "n_reads long, n_written long, n_skipped long")


@query(f"{DECODED} SELECT count(DISTINCT z.read_id) AS n_reads, count(DISTINCT path.read_id) AS n_written, count(DISTINCT z.read_id) - count(DISTINCT path.read_id) AS n_skipped, true AS is_timed FROM z LEFT JOIN path USING (read_id) WHERE z.x IS NOT NULL")
def correction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a correction run counts as it writes: reads, those that could be decoded, those that couldn't, and whether the tasks' time is known."""
    out, seen = sinks.counted(correction.correct_events(user_reads(spark, sf_dir), MODEL, P_STAY, P_SKIP, WIDTH, timed=True), "correction")
    out.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(*(got[c] for c in ("n_reads", "n_written", "n_skipped")), got["ms"] > 0)], "n_reads long, n_written long, n_skipped long, is_timed boolean")


@query(f"SELECT read_id, count(*) AS n_events, round(sum(event), 4) + 0.0 AS total FROM ({_segments_sql(*WAYS['v2'], digits=15)}) GROUP BY read_id")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The array functions by their SQL names."""
    correction.register(spark, MODEL, P_STAY, P_SKIP)
    reads = spark.sql("SELECT read_id, segment_v2(signal) AS events FROM {reads}", reads=supplier_reads(spark, sf_dir)).filter("events is not null")
    paths = spark.sql("SELECT read_id, events, viterbi_path(events) AS states FROM {reads}", reads=reads).filter("size(states) = size(events)")
    exact = "decimal(38, 6)"  # events have six digits here; their sum in doubles would depend on their order where it is rounded
    total = F.aggregate("events", F.lit(0).cast(exact), lambda a, x: (a + rounded(x).cast(exact)).cast(exact))
    return paths.select("read_id", F.size("events").cast("long").alias("n_events"), F.round(total, 4).cast("double").alias("total"))
