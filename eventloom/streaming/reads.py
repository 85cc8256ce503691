"""Event tables as streams: stateless correction, and normalisation with state carried between a channel's reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventloom.operators.model import Model
from eventloom.operators.segment import carried_z_scores
from eventloom.plans.correction import correct_events
from eventloom.sources.text import parsed_events


def correct_stream(spark: SparkSession, path: str, model: Model, p_stay: float, p_skip: float, files_per_batch: int = 100, **options) -> DataFrame:
    """Corrected reads of the event files that arrive in a folder. Each read stands alone, so no state is kept."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return correct_events(parsed_events(lines), model, p_stay, p_skip, **options)


def normalise_stream(reads: DataFrame) -> DataFrame:
    """z-scores of a stream of reads (channel, seq, read_id, signal) by all samples of the channel so far, its own included.

    The state of a channel is three numbers. Within a micro-batch a channel's reads count
    in the order of seq.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums = state.get if state.exists else (0.0, 0.0, 0)
        own = pd.concat(list(batches)).sort_values("seq")
        rows = []
        for seq, read, x in zip(own["seq"], own["read_id"], own["signal"]):
            z, sums = carried_z_scores(np.asarray(x, float), tuple(sums))
            rows.append((key[0], seq, read, z))
        state.update((float(sums[0]), float(sums[1]), int(sums[2])))
        yield pd.DataFrame(rows, columns=["channel", "seq", "read_id", "signal"])

    return reads.groupBy("channel").applyInPandasWithState(run, "channel long, seq long, read_id string, signal array<double>", "total double, squares double, n long", "append", GroupStateTimeout.NoTimeout)
