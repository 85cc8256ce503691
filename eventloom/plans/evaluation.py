"""How well reads map after each way to segment them, raw and corrected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.model import Model
from eventloom.operators.segment import Segmenter
from eventloom.plans.correction import correct_events, segment_events
from eventloom.plans.tuning import f1_scores


def segmented_ways(reads: DataFrame, segmenters: dict[str, Segmenter | str], model: Model, p_stay: float, p_skip: float, **options) -> DataFrame:
    """The events of reads (read_id, signal) by each segmenter, raw and corrected: segmenter, corrected, read_id, events."""
    out = None
    for name, how in segmenters.items():
        raw = segment_events(reads, how)
        for corrected, events in ((False, raw), (True, correct_events(raw, model, p_stay, p_skip, **options).filter("events is not null"))):
            part = events.select(F.lit(name).alias("segmenter"), F.lit(corrected).alias("corrected"), "read_id", "events")
            out = part if out is None else out.unionByName(part)
    return out


def evaluated(events: DataFrame, mapper: Callable[[DataFrame], DataFrame], truth: DataFrame, factor: float = 1.5, na_is_fp: bool = False) -> DataFrame:
    """Precision, recall and F1 for each way: segmenter, corrected, n, precision, recall, f1.

    mapper makes alignments of events (see tuning.f1_scores()), with segmenter and corrected
    carried along; truth are the alignments of the reads themselves.
    """
    return f1_scores(mapper(events), truth, factor, na_is_fp, ("segmenter", "corrected"))
