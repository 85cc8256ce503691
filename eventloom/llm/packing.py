"""Documents packed into full sequences whose tokens keep to target shares of their sources.

Deficit round-robin: each source is a queue of packets (parts of documents). A round
gives every queue a quantum, its share of a window; a queue sends the packets that its
credit covers and carries the rest, its deficit, into the next round. Rounds follow each
other in one stream, which is cut into windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import dropped, lean, small_side, whole_text, written
from eventloom.llm.vocab import ByteEncoder, text_parts

#: Tokens of a sequence, most tokens of a packet.
WINDOW = 2048
PACKET = 512
#: Rows that are handed over together.
TOGETHER = 2000


def _queues(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Each document's ids in its queue: part, queue (the source, or none), start in the part's queue, n, ids. A queue keeps the table's order."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        encoder = spark.sparkContext.broadcast({"text": f.read()})
    wide = max(ByteEncoder(encoder.value).vocab_size(), end_id + 1) > 1 << 16
    queue = F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), queue.alias("queue"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, model, kind, upto = TaskContext.get().partitionId(), ByteEncoder(encoder.value), "<u4" if wide else "<u2", {}
        for texts in text_parts(batches):
            ids, counts = model.encode(texts.column("text"))
            values = [np.append(x, end_id).astype(kind).tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]
            starts = []
            for queue, n in zip(texts.column("queue").to_pylist(), counts.tolist()):
                starts.append(upto.get(queue, 0))
                upto[queue] = starts[-1] + n + 1
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(starts), pa.int32()), texts.column("queue"), pa.array(starts, pa.int64()), texts.column("doc_id"), pa.array(counts + 1, pa.int64()), pa.array(values, pa.binary())], names=["part", "queue", "start", "doc_id", "n", "ids"])

    return written(rows.mapInArrow(lean(run), "part int, queue string, start long, doc_id long, n long, ids binary"), "pack-queues", compression="zstd")


def sent(end: int, weight: int, of: int, window: int) -> tuple[int, float]:
    """The round that sends a packet which ends at a place of its queue, and the queue's deficit after it.

    By the end of round r a queue was given (r + 1) * window * weight / of, and has sent
    all packets that end by then; so a packet's round follows from its end alone.
    """
    r = (end * of - 1) // (window * weight)
    return r, ((r + 1) * window * weight - end * of) / of


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _dealt(queues: DataFrame, weights: dict[str | None, int] | None, window: int, packet: int) -> DataFrame:
    """The packets with their rounds; packets of one document that follow each other in a round are one row."""
    own = Window.partitionBy("queue")
    sizes = queues.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(sizes.select("queue", "part", before.alias("before"), F.sum("n").over(own).alias("total")), "pack-starts")
    if weights is None:
        weight: Column = F.col("total")
    else:
        weight = F.lit(1)
        for source, w in weights.items():
            weight = F.when(F.col("queue") == ("" if source is None else f"={source}"), F.lit(int(w))).otherwise(weight)
    starts = starts.withColumn("weight", weight.cast("long"))
    of = int(starts.select("queue", "weight").distinct().agg(F.coalesce(F.sum("weight"), F.lit(1))).first()[0])
    rows = queues.join(small_side(starts.select("queue", "part", "before", "weight")), ["queue", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                out: list[tuple] = []
                columns = [batch.column(c).slice(k, TOGETHER).to_pylist() for c in ("queue", "before", "start", "weight", "doc_id", "n", "ids")]
                for queue, before, start, weight, doc_id, n, ids in zip(*columns):
                    first, width, a = before + start, len(ids) // n, 0
                    last = None
                    for b in [*range(packet, n, packet), n]:
                        r, deficit = sent(first + b, weight, of, window)
                        if last is not None and last[0] != r:
                            out.append((last[0], queue, first + a, doc_id, a, last[2] - a, n, last[1], ids[a * width : last[2] * width]))
                            a = last[2]
                        last = r, deficit, b
                    out.append((last[0], queue, first + a, doc_id, a, n - a, n, last[1], ids[a * width :]))
                yield _batch(out, schema)

    names = ["round", "queue", "place", "doc_id", "start", "length", "doc_tokens", "deficit", "ids"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))
    return rows.mapInArrow(lean(run), "round long, queue string, place long, doc_id long, start long, length long, doc_tokens long, deficit double, ids binary")


def _stream(packets: DataFrame) -> DataFrame:
    """All packets in the order of rounds, queues and places, with base, the tokens before each one's range, and at, those before it there."""
    order = ["round", "queue", "place"]
    dealt = packets.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column("length").to_numpy()
            at = upto + np.cumsum(size) - size
            upto += int(size.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(at, pa.int64())], names=[*batch.schema.names, "part", "at"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packets.schema.fields)
    ranges = written(dealt.mapInArrow(lean(run), f"{fields}, part int, at long"), "pack-stream", compression="zstd")
    sizes = ranges.groupBy("part").agg(F.sum("length").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    return ranges.join(small_side(written(sizes.select("part", base.alias("base")), "pack-bases")), "part")


def sequence_ends(total: int, window: int) -> list[int]:
    """Where the sequences behind the last full window end: what is left is cut into falling powers of two, which need no padding."""
    ends, at = [], total - total % window
    for k in range(window.bit_length() - 1, -1, -1):
        if (total - at) >> k & 1:
            at += 1 << k
            ends.append(at)
    return ends


def packed(docs: DataFrame, tokenizer_path: str, end_id: int, weights: dict[str | None, int] | None = None, window: int = WINDOW, packet: int = PACKET, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pack all documents: a row for each piece with doc_id, source, start, length, doc_tokens, sequence_id, offset, round, deficit, ids.

    A document is its text's ids and end_id; a null text counts as empty (end_id alone), a
    null source is a queue of its own, rows with equal or null doc_ids are documents each,
    an empty table gives no rows, and other columns are ignored. weights: the target of
    each source (positive integers; 1 for those not named), by default its share of all
    tokens. Once a queue is empty, the others share the windows by their weights.

    A packet is up to `packet` tokens of a document, so that in any run of rounds a source
    is at most one packet behind its target. deficit is what its queue carries on after a
    piece's packet. All sequences have `window` tokens but for the last ones, which have
    falling powers of two; none has padding. ids holds the piece's ids as 32-bit
    little-endian integers.

    Where a packet goes follows from the tokens before it in its queue, which are summed
    up by task; so queues of any size are dealt out over all tasks, and credit is carried
    across them. Ids are shuffled once, by ranges of (round, queue, place).
    """
    if weights and min(weights.values()) < 1:
        raise ValueError("weights are positive integers")
    queues = _queues(docs, tokenizer_path, end_id, id_col, text_col, source_col)
    stream = _stream(_dealt(queues, weights, window, packet))
    dropped(queues)
    total = int(stream.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])
    whole, ends = total // window, sequence_ends(total, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                out = []
                columns = [batch.column(c).slice(k, TOGETHER).to_pylist() for c in ("base", "at", "doc_id", "queue", "start", "length", "doc_tokens", "round", "deficit", "ids")]
                for base, at, doc_id, queue, start, length, n, r, deficit, ids in zip(*columns):
                    width, place, done = len(ids) // length, base + at, 0
                    while done < length:
                        here = place + done
                        if here < whole * window:
                            seq, first = here // window, here - here % window
                            end = first + window
                        else:
                            i = next(i for i, e in enumerate(ends) if here < e)
                            seq, end = whole + i, ends[i]
                            first = ends[i - 1] if i else whole * window
                        size = min(length - done, end - here)
                        own = np.frombuffer(ids, f"<u{width}", size, done * width).astype("<u4").tobytes()
                        out.append((doc_id, queue[1:] if queue else None, start + done, size, n, seq, here - first, r, deficit, own))
                        done += size
                yield _batch(out, schema)

    names = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "round", "deficit", "ids"]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.float64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))
    return stream.mapInArrow(lean(run), "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, round long, deficit double, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids (all pieces' ids in order, as 32-bit little-endian integers), doc_ids and lengths of the pieces."""
    piece = F.struct("offset", "length", "doc_id", "ids")
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate(F.col("p"), F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", "n_tokens", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
