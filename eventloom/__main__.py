"""Command line: python -m eventloom correct|segment|train|label|tune ... ; run with --help for the options."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import alignment, kmers, training
from eventloom.operators.decode import correct_grid
from eventloom.operators.segment import PRESETS
from eventloom.plans import correction, tuning
from eventloom.sources import signals, sinks, text


def correct(spark: SparkSession, a: argparse.Namespace) -> None:
    model = text.read_model(spark, a.model)
    out = correction.correct_events(text.read_events(spark, a.events), model, a.p_stay, a.p_skip, a.window_size, not a.no_stay_removal, not a.no_noise_removal, timed=True)
    out, seen = sinks.counted(out)
    start = time.time()
    sinks.write_lines(sinks.corrected_lines(out), a.output)
    got = seen.get
    print(f"reads {got['n_reads']}, written {got['n_written']}, not decoded {got['n_skipped']}")
    print(f"wall time {time.time() - start:.3f} s, {got['ms'] / max(got['n_reads'], 1):.3f} ms a read")


def segment(spark: SparkSession, a: argparse.Namespace) -> None:
    names = ("short", "long", "short_threshold", "long_threshold", "height", "least", "most", "precision")
    how = PRESETS[a.preset].but(**{k: getattr(a, k) for k in names if getattr(a, k) is not None})
    reads = signals.read_signals(spark, a.input, a.format, strict=not a.skip_bad_files, required=True)
    out, seen = sinks.counted(correction.segment_reads(reads.withColumnRenamed("signal_pA", "signal"), how))
    sinks.write_lines(sinks.event_lines(out), a.output)
    print("reads {n_reads}, written {n_written}, skipped {n_skipped}".format(**seen.get))


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    table = kmers.last_wins(text.read_kmers(spark, a.kmers))
    means, variances, _ = training.mixture(table, "level", a.states, seed=a.seed, seeding="oversampled")
    at = F.sort_array(F.collect_list(F.struct("t", "level")))
    chunks = kmers.observations(spark, table, a.k, a.chunks).groupBy("chunk").agg(F.transform(at, lambda s: s["level"]).alias("xs"))
    model, log = training.trained(chunks, means, variances, least=a.least, most=a.most, tol=1e-4 * 4 ** max(a.k - 9, 0))
    sinks.write_model(spark, model, a.output)
    print(f"{len(log)} rounds, log likelihood {log[-1]:.4f}")


def label(spark: SparkSession, a: argparse.Namespace) -> None:
    query = text.read_alignments(spark, a.query)
    out = alignment.labelled(query, text.read_alignments(spark, a.truth), a.extension).persist()
    if a.output:
        sinks.write_lines(sinks.annotated_lines(out), a.output)
    for table in (alignment.rates(alignment.confusion(out), a.na_is_fp, a.rounded), alignment.throughput(out)):
        print(*sinks.report(table), sep="\n")


def tune(spark: SparkSession, a: argparse.Namespace) -> None:
    """Search for the parameters under which events lie nearest their states' means; a mapper's F1 needs its own objective."""
    model, reads = text.read_model(spark, a.model), text.read_events(spark, a.events).persist()

    def nearness(out: DataFrame) -> DataFrame:
        z = out.select("p_stay", "p_skip", F.explode(F.arrays_zip("events", "states")).alias("z"))
        near = -F.pow(F.col("z.events") - F.get(F.lit(list(map(float, model.means))), F.col("z.states")), 2)
        return z.groupBy("p_stay", "p_skip").agg(F.avg(near).alias("score"))

    found = tuning.best(tuning.grid_scores(reads, model, nearness), "score").first()
    scores = lambda pairs: tuning.scores_of(nearness(correct_grid(reads, model, pairs)), "score", pairs)
    best, top, tried = tuning.climbed(lambda *pair: scores([pair])[pair], (found["p_stay"], found["p_skip"]) if found else (0.0, 0.0), ahead=scores)
    print(f"p_stay {best[0]} p_skip {best[1]} score {top:.6f} after {tried} pairs")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="eventloom", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    p = jobs.add_parser("correct", help="decode and correct an event table")
    p.add_argument("model")
    p.add_argument("events")
    p.add_argument("p_stay", type=float)
    p.add_argument("p_skip", type=float)
    p.add_argument("output")
    p.add_argument("--window-size", type=int, default=20)
    p.add_argument("--no-noise-removal", action="store_true")
    p.add_argument("--no-stay-removal", action="store_true")
    p = jobs.add_parser("segment", help="segment signal files into events")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--format", default="slow5")
    p.add_argument("--preset", choices=sorted(PRESETS), default="v1")
    p.add_argument("--skip-bad-files", action="store_true")
    for name, kind in (("short", int), ("long", int), ("short-threshold", float), ("long-threshold", float), ("height", float), ("least", int), ("most", int), ("precision", str)):
        p.add_argument(f"--{name}", type=kind)
    p = jobs.add_parser("train", help="train a model on a k-mer table")
    p.add_argument("states", type=int)
    p.add_argument("kmers")
    p.add_argument("k", type=int)
    p.add_argument("output")
    p.add_argument("--chunks", type=int, default=8)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--least", type=int, default=1001)
    p.add_argument("--most", type=int, default=10_000)
    p = jobs.add_parser("label", help="label alignments by a ground truth and print the rates")
    p.add_argument("query")
    p.add_argument("truth")
    p.add_argument("--output")
    p.add_argument("--extension", type=float, default=1.5)
    p.add_argument("--na-is-fp", action="store_true")
    p.add_argument("--rounded", action="store_true")
    p = jobs.add_parser("tune", help="search for decoding parameters")
    p.add_argument("model")
    p.add_argument("events")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"eventloom {a.job}").getOrCreate()
    globals()[a.job](spark, a)


if __name__ == "__main__":
    main()
