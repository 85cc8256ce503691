"""Token ids in binary blocks, compressed by a static range asymmetric numeral system."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import lean, small_side, unused_path, whole_text, written
from eventloom.llm.vocab import WordEncoder, text_parts

#: Fixed values of the format: mark, version, lanes of a block, steps between checkpoints, least state, bits of a word.
MARK, VERSION, LANES, STEPS, LOW, WORD = b"ETOK", 2, 128, 128, 1 << 31, 32
HEAD = "<4sHHIIII"  # mark, version, scale bits, lanes, ids, checkpoints, checksum of the frequency table
#: Parameters: ids of a block (a longer document makes a longer block), blocks that are coded together, bits of the scale.
BLOCK_IDS = 1 << 16
TOGETHER = 16
SCALE_BITS = 20


class Table:
    """The shared frequency table: how often each id is taken to occur, out of 2 ** bits; crc tells tables apart."""

    def __init__(self, counts: np.ndarray, bits: int = SCALE_BITS):
        total, scale = max(int(counts.sum()), 1), 1 << bits
        freq = np.where(counts > 0, np.maximum(1, counts * scale // total), 0).astype(np.int64)
        if not counts.any():
            freq[0] = scale
        order = np.argsort(-freq)
        spare = scale - int(freq.sum())
        for i in order if spare < 0 else order[:1]:  # rounding: the most frequent give or take
            step = max(spare, 1 - int(freq[i]))
            freq[i] += step
            spare -= step
            if not spare:
                break
        self.bits, self.freq, self.crc = bits, freq.astype(np.uint64), zlib.crc32(freq.astype("<i8").tobytes())
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)  # the id of each place of the scale


def encode_blocks(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """Each block of ids as bytes of its own.

    Id i of a block belongs to lane i % LANES; lanes have a state each and share one
    stream of 32-bit words. Every STEPS steps a checkpoint holds all states and the
    place in the stream, so a reader can start there. A CRC-32 ends the block.
    """
    n = np.array([len(b) for b in blocks])
    steps = -(-n // LANES)
    most = int(steps.max(initial=0))
    ids = np.zeros((len(blocks), most * LANES), np.int64)
    for row, b in zip(ids, blocks):
        row[: len(b)] = b
    ids = ids.reshape(len(blocks), most, LANES)
    live = np.arange(most * LANES).reshape(1, most, LANES) < n[:, None, None]
    x = np.full((len(blocks), LANES), LOW, np.uint64)
    words = np.zeros((most, len(blocks), LANES), np.uint32)
    out = np.zeros((most, len(blocks), LANES), bool)
    points = {}
    word, bits = np.uint64(WORD), np.uint64(table.bits)
    limit = np.uint64(63 - table.bits)
    for t in range(most - 1, -1, -1):
        f, c, on = table.freq[ids[:, t]], table.start[ids[:, t]], live[:, t]
        f = np.maximum(f, np.uint64(1))
        over = on & (x >= (f << limit))
        words[t], out[t] = x.astype(np.uint32), over
        x = np.where(over, x >> word, x)
        q = x // f
        x = np.where(on, (q << bits) + (x - q * f) + c, x)
        if t % STEPS == 0:
            points[t // STEPS] = x
    before = np.concatenate([np.zeros((1, len(blocks)), np.int64), np.cumsum(out.sum(axis=2), axis=0)])
    made = []
    for b in range(len(blocks)):
        marks = range(-(-int(steps[b]) // STEPS))
        body = struct.pack(HEAD, MARK, VERSION, table.bits, LANES, int(n[b]), len(marks), table.crc)
        body += b"".join(points[k][b].astype("<u8").tobytes() for k in marks)
        body += before[[k * STEPS for k in marks], b].astype("<u4").tobytes() if marks else b""
        body += words[:, b][out[:, b]].astype("<u4").tobytes()
        made.append(body + struct.pack("<I", zlib.crc32(body)))
    return made


def decode_blocks(payloads: list[bytes], table: Table) -> list[np.ndarray]:
    """The ids of each block; all stretches between checkpoints are decoded at once."""
    states, base, first, sizes, streams, n_words = [], [], [], [], [], 0
    for p in payloads:
        body = p[:-4]
        if struct.unpack("<I", p[-4:])[0] != zlib.crc32(body):
            raise ValueError("a block's checksum doesn't fit its bytes")
        mark, version, bits, lanes, n, marks, crc = struct.unpack_from(HEAD, body)
        if (mark, version, bits, lanes, crc) != (MARK, VERSION, table.bits, LANES, table.crc):
            raise ValueError("not a block of this format and table")
        at = struct.calcsize(HEAD)
        states.append(np.frombuffer(body, "<u8", marks * LANES, at).reshape(marks, LANES))
        at += marks * LANES * 8
        base.append(np.frombuffer(body, "<u4", marks, at).astype(np.int64) + n_words)
        at += marks * 4
        streams.append(np.frombuffer(body, "<u4", -1, at) if at < len(body) else np.zeros(0, "<u4"))
        n_words += len(streams[-1])
        first.append(n - np.arange(marks) * STEPS * LANES)  # ids from each checkpoint on
        sizes.append((n, marks))
    x = np.concatenate([np.zeros((0, LANES), np.uint64), *states]).astype(np.uint64)
    at, left = np.concatenate([np.zeros(0, np.int64), *base]), np.concatenate([np.zeros(0, np.int64), *first])
    stream = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
    got = np.zeros((len(x), STEPS, LANES), np.uint32)
    bits, word = np.uint64(table.bits), np.uint64(WORD)
    mask, low = np.uint64((1 << table.bits) - 1), np.uint64(LOW)
    lane = np.arange(LANES)
    for t in range(STEPS if len(x) else 0):
        on = (t * LANES + lane)[None, :] < left[:, None]
        if not on.any():
            break
        slot = x & mask
        s = table.slots[slot.astype(np.int64)]
        got[:, t] = s
        x = np.where(on, table.freq[s] * (x >> bits) + slot - table.start[s], x)
        want = on & (x < low)
        place = at[:, None] + np.cumsum(want, axis=1) - 1
        x = np.where(want, (x << word) | stream[np.where(want, place, len(stream) - 1)], x)
        at = at + want.sum(axis=1)
    out, k = [], 0
    for n, marks in sizes:
        out.append(got[k : k + marks].reshape(-1)[:n])
        k += marks
    return out


def _ids(value: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(value, "<u4" if wide else "<u2").astype(np.int64)


def _encoded(docs: DataFrame, encoder, end_id: int, wide: bool, id_col: str, text_col: str) -> DataFrame:
    """The ids of each document with its shard (its range of document ids) and its start there, in ascending order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, start, model = TaskContext.get().partitionId(), 0, WordEncoder(encoder.value)
        kind = "<u4" if wide else "<u2"
        for part in text_parts(batches):
            ids, counts = model.encode(part.column("text"))
            sizes = counts + 1
            values = [np.append(x, end_id).astype(kind).tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(sizes), pa.int32()), pa.array(starts), part.column("doc_id"), pa.array(sizes), pa.array(values, pa.binary())], names=["shard", "start", "doc_id", "n", "ids"])

    return rows.mapInArrow(lean(run), "shard int, start long, doc_id long, n long, ids binary")


def counted_ids(rows: DataFrame, size: int, wide: bool) -> np.ndarray:
    """How often each id occurs in all documents: one row per id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                counts += np.bincount(_ids(b"".join(batch.column("ids").slice(k, 1000).to_pylist()), wide), minlength=size)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in rows.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


BLOCKS = "shard int, start long, doc_ids array<long>, doc_tokens array<long>, payload binary"
HEADER = "version int, tokenizer string, tokenizer_sha256 string, end_id int, n_docs long, n_tokens long, counts array<long>"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text, append end_id, and write the ids in ascending order of document ids, to path (a new folder).

    Documents are dealt by ranges of ids (rows with equal ids by their text's hash),
    sorted and encoded, and their ids kept in the shared folder. Counts over all of them
    make the frequency table. Then each run of rows becomes blocks of whole documents,
    without another shuffle; shard and start (in the shard) give a block's place in the
    order, and each file holds its blocks in that order. Null texts count as empty (the
    end id alone), null ids come first, an empty table gives no blocks.

    path gets two folders of Parquet files: blocks, and header with one row: the format's
    version, the tokenizer file's name and SHA-256, the end id, the numbers of documents and
    ids, and how often each id occurs, from which the frequency table follows. Every block
    names the table's checksum. So the folder is all that a reader needs. Without a path
    it lies in the shared folder. Returns the path.
    """
    spark = docs.sparkSession
    path = path or unused_path(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    encoder = spark.sparkContext.broadcast({"text": vocabulary})
    size = max(WordEncoder(encoder.value).vocab_size(), end_id + 1)
    wide = size > 1 << 16
    rows = written(_encoded(docs, encoder, end_id, wide, id_col, text_col), "token-ids", compression="zstd")
    counts = spark.sparkContext.broadcast(counted_ids(rows, size, wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Table(counts.value)
        full: list[tuple[int, int, list, list, np.ndarray]] = []
        own: list[tuple] = []  # rows of the block that is being filled
        held = 0

        def close() -> None:
            nonlocal own, held
            full.append((own[0][0], own[0][1], [r[2] for r in own], [r[3] for r in own], np.concatenate([_ids(r[4], wide) for r in own])))
            own, held = [], 0

        def flush() -> pa.RecordBatch:
            payloads = encode_blocks([x[4] for x in full], codes)
            of = lambda k, type_: pa.array([x[k] for x in full], type_)
            out = pa.RecordBatch.from_arrays([of(0, pa.int32()), of(1, pa.int64()), of(2, pa.list_(pa.int64())), of(3, pa.list_(pa.int64())), pa.array(payloads, pa.binary())], names=["shard", "start", "doc_ids", "doc_tokens", "payload"])
            full.clear()
            return out

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "doc_id", "n", "ids"))):
                if own and (row[0] != own[-1][0] or row[1] != own[-1][1] + own[-1][3]):
                    close()
                own.append(row)
                held += row[3]
                if held >= BLOCK_IDS:
                    close()
                if len(full) >= TOGETHER:
                    yield flush()
        if own:
            close()
        if full:
            yield flush()

    rows.mapInArrow(lean(run), BLOCKS).sortWithinPartitions("shard", "start").write.parquet(f"{path}/blocks")
    n_docs = rows.count()
    head = (VERSION, os.path.basename(tokenizer_path), hashlib.sha256(vocabulary.encode()).hexdigest(), end_id, n_docs, int(counts.value.sum()), counts.value.tolist())
    spark.createDataFrame([head], HEADER).coalesce(1).write.parquet(f"{path}/header")
    return path


class TokenFiles:
    """Token files at a path, in whatever session: header is the row that describes them, blocks the table of their blocks."""

    def __init__(self, spark: SparkSession, path: str):
        self.header = spark.read.schema(HEADER).parquet(f"{path}/header").first()
        if self.header is None or self.header["version"] != VERSION:
            raise ValueError(f"no token files of version {VERSION} at {path}")
        self.blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
        self.counts = spark.sparkContext.broadcast(np.array(self.header["counts"], np.int64))

    def ids(self) -> DataFrame:
        """Decode the blocks: one row per document with doc_id, start, n_tokens, ids (array of long)."""
        return _decoded(self.blocks, self.counts, "ids array<long>", lambda ids, ends: pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int64))))

    def checksums(self) -> DataFrame:
        """Decode the blocks: one row per document with doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit little-endian integers)."""

        def crc(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
            raw = memoryview(ids.astype("<u4").tobytes())
            return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(np.r_[0, ends[:-1]], ends)], pa.int64())

        return _decoded(self.blocks, self.counts, "ids_crc32 long", crc)


def _decoded(blocks: DataFrame, counts, column: str, of_ids) -> DataFrame:
    """Shards' totals give each shard's first place; a window over them sees one row per shard file."""
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = written(totals.select("shard", before.alias("base")), "token-shards")
    rows = blocks.join(small_side(bases), "shard").select((F.col("base") + F.col("start")).alias("start"), "doc_ids", "doc_tokens", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Table(counts.value)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                all_ids = decode_blocks(part.column("payload").to_pylist(), codes)
                for start, names, sizes, ids in zip(part.column("start").to_pylist(), part.column("doc_ids").to_pylist(), part.column("doc_tokens").to_pylist(), all_ids):
                    ends = np.cumsum(sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), of_ids(ids, ends)], names=["doc_id", "start", "n_tokens", column.split()[0]])

    return rows.mapInArrow(lean(run), f"doc_id long, start long, n_tokens long, {column}")
