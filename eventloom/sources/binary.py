"""Binary read files as Spark data sources: `blow5` and `pod5`, read in partitions and written by tasks.

    spark.dataSource.register(Blow5)
    spark.read.format("blow5").load("s3://bucket/run")

A path is a file or a folder, local or any that Arrow's file systems know (file, hdfs, s3, gs).
Options: partitionBytes, about how much of the files a partition reads; mode, `failfast`
(an error stops the job) or `permissive` (what can't be read is a row with an error).
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from eventloom.functions import vbytes
from eventloom.functions.signal import BAND

#: A read, or (permissive) something that could not be read, and why. file_no counts the files by path; place rises within a file.
SCHEMA = "read_id string, signal_pA array<double>, file string, file_no int, place long, error string"
ARROW = pa.schema([("read_id", pa.string()), ("signal_pA", pa.list_(pa.float64())), ("file", pa.string()), ("file_no", pa.int32()), ("place", pa.int64()), ("error", pa.string())])
PARTITION_BYTES = 128 << 20
#: Samples that are handed over together.
TOGETHER = 2_000_000


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def listed(path: str, *suffixes: str) -> list[tuple[str, int]]:
    """The files of some kinds and their sizes, by path: the file itself, or those in the folder (not in folders below)."""
    files, root = _opened(path)
    info = files.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in files.get_file_info(pafs.FileSelector(root)) if f.is_file and f.path.lower().endswith(suffixes)]
    prefix = path[: len(path) - len(root)] if path.endswith(root) else path.split("://")[0] + "://" if "://" in path else ""
    return sorted((prefix + f.path, f.size) for f in found)


@dataclass
class Pieces(InputPartition):
    """Parts of files: number, path, first, last (in the format's own counting; none: the whole file)."""

    parts: list[tuple[int, str, int | None, int | None]]


def in_band(raw: np.ndarray, offset: float, scale: float) -> np.ndarray:
    x = (raw.astype(float) + offset) * scale
    return x[(x > BAND[0]) & (x < BAND[1])]


class FileReader(DataSourceReader):
    """Plans and reads files of a kind. A kind says where a large file may be cut, and makes rows of a part."""

    suffix = ""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"

    def cuts(self, path: str, size: int) -> list[tuple[int | None, int | None]]:
        """The parts of a large file."""
        raise NotImplementedError

    def rows(self, path: str, first: int | None, last: int | None) -> Iterator[tuple[str | None, np.ndarray | None, int | None, str | None]]:
        """The reads of a part: id, signal, place, error."""
        raise NotImplementedError

    def partitions(self) -> list[Pieces]:
        """Small files share partitions; only files over the size of one are looked into for places to cut."""
        out, held, room = [], [], self.size
        for no, (path, size) in enumerate(listed(self.path, self.suffix)):
            if size > self.size:
                try:
                    out += [Pieces([(no, path, a, b)]) for a, b in self.cuts(path, size)]
                    continue
                except Exception:  # the task that reads it reports what is wrong
                    pass
            if held and size > room:
                out.append(Pieces(held))
                held, room = [], self.size
            held.append((no, path, None, None))
            room -= size
        return [*out, Pieces(held)] if held else out or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for no, path, first, last in partition.parts:
            try:
                for read_id, signal, place, error in self.rows(path, first, last):
                    if error and not self.permissive:
                        raise ValueError(f"{path} at {place}: {error}")
                    held.append((read_id, signal, path, no, place, error))
                    size += 0 if signal is None else len(signal)
                    if size >= TOGETHER:
                        yield self._batch(held)
                        held, size = [], 0
            except Exception as e:
                if not self.permissive:
                    raise
                held.append((None, None, path, no, None, f"{type(e).__name__}: {e}"))
        yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)


# BLOW5. Marks, the header's size, codes of compression.
MARK, END_MARK, HEAD = b"BLOW5\x01", b"5WOLB", 64
NONE, ZLIB, ZSTD, SVB_ZD = 0, 1, 2, 1
RECORD = "<I4dQ"  # group, digitisation, offset, range, rate, size of the signal


def _inflated(data: bytes, method: int) -> bytes:
    if method == ZLIB:
        return zlib.decompressobj(zlib.MAX_WBITS | 32).decompress(data)
    if method == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


class Blow5Reader(FileReader):
    suffix = ".blow5"

    @staticmethod
    def head(f) -> tuple[int, int, int]:
        """A file's compression of records and of signals, and where its records begin."""
        head = f.read(HEAD + 4)
        if len(head) < HEAD + 4 or head[:6] != MARK:
            raise ValueError("not a BLOW5 file")
        # versions before 0.2 have no byte for the signal's compression
        return head[9], head[14] if head[6:8] >= b"\x00\x02" else NONE, HEAD + 4 + struct.unpack_from("<I", head, HEAD)[0]

    def cuts(self, path: str, size: int) -> list[tuple[int, int]]:
        files, name = _opened(path)
        with files.open_input_file(name) as f:
            at = first = self.head(f)[2]
            out, end = [], size - len(END_MARK)
            while at < end:  # eight bytes a record are read
                f.seek(at)
                at += 8 + struct.unpack("<Q", f.read(8))[0]
                if at - first >= self.size:
                    out.append((first, min(at, size)))
                    first = at
        return [*out, (first, size)] if first < end or not out else out

    def rows(self, path, first, last):
        files, name = _opened(path)
        with files.open_input_file(name) as f:
            size = f.size()
            packed, signals, start = self.head(f)
            if packed not in (NONE, ZLIB, ZSTD) or signals not in (NONE, SVB_ZD):
                raise ValueError(f"compression {packed}, {signals} isn't known")
            at, end = first or start, last or size
            f.seek(at)
            while at < end:
                head = f.read(8)
                if head[: len(END_MARK)] == END_MARK and at + len(head) >= size:
                    return
                n = struct.unpack("<Q", head)[0] if len(head) == 8 else -1
                if n < 0 or at + 8 + n > size:
                    yield None, None, at, "the file ends inside a record"
                    return
                try:
                    yield *self.record(_inflated(f.read(n), packed), signals), at, None
                except Exception as e:
                    yield None, None, at, f"{type(e).__name__}: {e}"
                    f.seek(at + 8 + n)
                at += 8 + n

    @staticmethod
    def record(data: bytes, signals: int) -> tuple[str, np.ndarray]:
        n = struct.unpack_from("<H", data)[0]
        read_id = data[2 : 2 + n].decode()
        _, digitisation, offset, range_, _, size = struct.unpack_from(RECORD, data, 2 + n)
        at = 2 + n + struct.calcsize(RECORD)
        if signals == NONE:
            raw = np.frombuffer(data, "<i2", size, at)
        else:  # size counts bytes; they begin with the number of samples
            body = data[at : at + size]
            raw = vbytes.summed(vbytes.unzigzag(vbytes.decode32(body[4:], struct.unpack_from("<I", body)[0])))
        return read_id, in_band(raw, offset, range_ / digitisation)


#: What the writers take; raw samples are calibrated as (raw + offset) * range / digitisation.
RAW = "read_id string, raw array<short>, digitisation double, offset double, range double"


class FileWriter(DataSourceWriter):
    """Each task writes its reads as files of a folder, under names of their own, a bounded number of samples each; if the job fails they are removed."""

    suffix, samples = "", 50_000_000

    def __init__(self, options: dict):
        self.path, self.packed = options["path"], options.get("compression", "zstd").lower()

    def content(self, reads: list[tuple]) -> bytes:
        raise NotImplementedError

    def write(self, iterator) -> WriterCommitMessage:
        files, root = _opened(self.path)
        held, size, made = [], 0, Written([])

        def flush() -> None:
            files.create_dir(root)
            made.names.append(f"{root}/part-{uuid.uuid4().hex}{self.suffix}")
            with files.open_output_stream(made.names[-1]) as f:
                f.write(self.content(held))

        for r in iterator:
            held.append((r["read_id"], np.array(r["raw"], np.int16), r["digitisation"], r["offset"], r["range"]))
            size += len(held[-1][1])
            if size >= self.samples:
                flush()
                held, size = [], 0
        if held:
            flush()
        return made

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        files, _ = _opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            if files.get_file_info(name).is_file:
                files.delete_file(name)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Blow5Writer(FileWriter):
    suffix = ".blow5"

    def content(self, reads: list[tuple]) -> bytes:
        import zstandard

        method = {"none": NONE, "zlib": ZLIB, "zstd": ZSTD}[self.packed]
        pack = {NONE: lambda b: b, ZLIB: zlib.compress, ZSTD: zstandard.ZstdCompressor().compress}[method]
        text = b"#slow5_version\t1.0.0\n#num_read_groups\t1\n#char*\tuint32_t\tdouble\tdouble\tdouble\tdouble\tuint64_t\tint16_t*\n#read_id\tread_group\tdigitisation\toffset\trange\tsampling_rate\tlen_raw_signal\traw_signal\n"
        head = (MARK + bytes([1, 0, 0, method]) + struct.pack("<I", 1) + bytes([NONE if method == NONE else SVB_ZD])).ljust(HEAD, b"\x00") + struct.pack("<I", len(text)) + text
        out = io.BytesIO()
        out.write(head)
        for read_id, raw, digitisation, offset, range_ in reads:
            name = read_id.encode()
            if method == NONE:
                size, body = len(raw), raw.astype("<i2").tobytes()
            else:
                body = struct.pack("<I", len(raw)) + vbytes.encode32(vbytes.zigzag(vbytes.deltas(raw.astype(np.int32))))
                size = len(body)
            record = pack(struct.pack("<H", len(name)) + name + struct.pack(RECORD, 0, digitisation, offset, range_, 4000.0, size) + body)
            out.write(struct.pack("<Q", len(record)) + record)
        return out.getvalue() + END_MARK


class Blow5(DataSource):
    """BLOW5 files. Records may be packed with zlib or zstd, signals as variable-byte deltas."""

    @classmethod
    def name(cls) -> str:
        return "blow5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Blow5Reader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return Blow5Writer(self.options)


# POD5. The file's signature, the mark of its footer, codes of its tables.
SIGNATURE, FOOTER = b"\x8bPOD\r\n\x1a\n", b"FOOTER\x00\x00"
READS, SIGNAL = 0, 1


def footer_tables(footer: bytes) -> dict[int, tuple[int, int]]:
    """The footer's embedded files by what they hold: where each begins and its size. The footer is a FlatBuffer."""

    def number(kind: str, at: int) -> int:
        return struct.unpack_from(kind, footer, at)[0]

    def slot(table: int, k: int) -> int | None:
        """Where a table's k-th value is."""
        names = table - number("<i", table)
        at = number("<H", names + 4 + 2 * k) if 4 + 2 * k < number("<H", names) else 0
        return table + at if at else None

    root = number("<I", 0)
    listed_at = slot(root, 3)
    out = {}
    if listed_at is not None:
        files = listed_at + number("<I", listed_at)
        for k in range(number("<I", files)):
            at = files + 4 + 4 * k
            table = at + number("<I", at)
            offset, length, _, content = (number(kind, p) if (p := slot(table, i)) is not None else 0 for i, kind in enumerate(("<q", "<q", "<h", "<h")))
            out[content] = offset, length
    return out


class Part(io.RawIOBase):
    """A part of an open file as a file."""

    def __init__(self, f, first: int, size: int):
        self.f, self.first, self.size, self.at = f, first, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = min(n if n is not None and n >= 0 else self.size, max(self.size - self.at, 0))
        self.f.seek(self.first + self.at)
        out = self.f.read(n)
        self.at += len(out)
        return out


def pod5_tables(f) -> tuple[ipc.RecordBatchFileReader, ipc.RecordBatchFileReader]:
    """The tables of reads and of signals; their batches are read when they are asked for."""
    size = f.size()
    if size < 64 or f.read(8) != SIGNATURE:
        raise ValueError("not a POD5 file")
    f.seek(size - 32)  # size of the footer, section mark, signature
    length = struct.unpack("<q", f.read(8))[0]
    for n in (length, -(-length // 8) * 8):  # with or without padding
        at = size - 32 - n
        if 0 < n < size and at >= 8:
            f.seek(at - 8)
            if f.read(8) == FOOTER:
                tables = footer_tables(f.read(n))
                return tuple(ipc.open_file(pa.PythonFile(Part(f, *tables[kind]), "r")) for kind in (READS, SIGNAL))
    raise ValueError("the file has no footer")


class Pod5Reader(FileReader):
    """Parts are runs of batches of the table of reads."""

    suffix = ".pod5"

    def cuts(self, path: str, size: int) -> list[tuple[int, int]]:
        files, name = _opened(path)
        with files.open_input_file(name) as f:
            n = pod5_tables(f)[0].num_record_batches
        parts = max(1, min(n, -(-size // self.size)))
        edges = [n * k // parts for k in range(parts + 1)]
        return list(zip(edges[:-1], edges[1:]))

    def rows(self, path, first, last):
        files, name = _opened(path)
        with files.open_input_file(name) as f:
            reads, signals = pod5_tables(f)
            each = signals.get_batch(0).num_rows if signals.num_record_batches else 1  # all batches but the last are of one size
            place, held = (first or 0) * (reads.get_batch(0).num_rows if reads.num_record_batches else 0), (-1, None)
            for k in range(first or 0, reads.num_record_batches if last is None else last):
                batch = reads.get_batch(k)
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("read_id", "signal", "calibration_offset", "calibration_scale")]
                for read_id, rows, offset, scale in zip(*columns):
                    try:
                        parts = []
                        for row in rows:
                            if held[0] != row // each:
                                held = row // each, signals.get_batch(row // each)
                            parts.append(self.samples(held[1], row % each))
                        raw = np.concatenate([np.zeros(0, np.int16), *parts])
                        yield str(read_id if isinstance(read_id, uuid.UUID) else uuid.UUID(bytes=read_id)), in_band(raw, offset, scale), place, None
                    except Exception as e:
                        yield None, None, place, f"{type(e).__name__}: {e}"
                    place += 1

    @staticmethod
    def samples(batch: pa.RecordBatch, row: int) -> np.ndarray:
        """A row of the table of signals: integers, or packed as variable-byte deltas and then with zstd."""
        column = batch.column(batch.schema.get_field_index("signal"))
        storage = column.storage if isinstance(column, pa.ExtensionArray) else column
        if not pa.types.is_large_binary(storage.type) and not pa.types.is_binary(storage.type):
            return storage[row].values.to_numpy()
        import zstandard

        n = batch.column(batch.schema.get_field_index("samples"))[row].as_py()
        data = zstandard.ZstdDecompressor().decompressobj().decompress(storage[row].as_py())
        return vbytes.summed(vbytes.unzigzag(vbytes.decode16(data, n)))


def footer_bytes(tables: dict[int, tuple[int, int]]) -> bytes:
    """A footer that names embedded files: the inverse of footer_tables()."""
    # one layout for all tables of files: offset, size, what they hold
    names = struct.pack("<6H", 12, 24, 8, 16, 0, 4)
    entries = list(tables.items())
    root = 4 + 12  # behind the place of the root and its list of slots
    vector = root + 8
    first = -(-(vector + 4 + 4 * len(entries) + len(names)) // 8) * 8
    out = bytearray(first + 24 * len(entries))
    struct.pack_into("<I6H", out, 0, root, 12, 8, 0, 0, 0, 4)
    struct.pack_into("<iI", out, root, 12, vector - root - 4)
    struct.pack_into("<I", out, vector, len(entries))
    layout = vector + 4 + 4 * len(entries)
    out[layout : layout + len(names)] = names
    for k, (content, (offset, length)) in enumerate(entries):
        at = first + 24 * k
        struct.pack_into("<I", out, vector + 4 + 4 * k, at - (vector + 4 + 4 * k))
        struct.pack_into("<ihhqq", out, at, at - layout, content, 0, offset, length)
    return bytes(out)


class Pod5Writer(FileWriter):
    """The tables of reads and signals, without the run's description. Read ids must be UUIDs; others become ones made of their text."""

    suffix = ".pod5"
    #: Rows of a batch of the signal table, samples of a row.
    BATCH, SAMPLES = 100, 102_400

    def content(self, reads: list[tuple]) -> bytes:
        import zstandard

        pack, rows, of_reads = zstandard.ZstdCompressor(), [], []
        for read_id, raw, digitisation, offset, range_ in reads:
            try:
                key = uuid.UUID(read_id).bytes
            except ValueError:
                key = uuid.uuid5(uuid.NAMESPACE_OID, read_id).bytes
            first = len(rows)
            for a in range(0, len(raw), self.SAMPLES):
                part = raw[a : a + self.SAMPLES]
                data = part if self.packed == "none" else pack.compress(vbytes.encode16(vbytes.zigzag(vbytes.deltas(part))))
                rows.append((key, data, len(part)))
            of_reads.append((key, list(range(first, len(rows))), offset, range_ / digitisation))
        kind = pa.large_list(pa.int16()) if self.packed == "none" else pa.large_binary()
        signal = pa.schema([("read_id", pa.binary(16)), ("signal", kind), ("samples", pa.uint32())])
        read = pa.schema([("read_id", pa.binary(16)), ("signal", pa.list_(pa.uint64())), ("calibration_offset", pa.float32()), ("calibration_scale", pa.float32())])
        out, tables, mark = io.BytesIO(), {}, uuid.uuid4().bytes
        out.write(SIGNATURE + mark)
        for content, schema, some in ((SIGNAL, signal, rows), (READS, read, of_reads)):
            body = io.BytesIO()
            with ipc.new_file(body, schema) as w:
                for a in range(0, len(some), self.BATCH):
                    w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some[a : a + self.BATCH]), schema)], schema=schema))
            tables[content] = out.tell(), len(body.getvalue())
            out.write(body.getvalue())
            out.write(b"\x00" * (-out.tell() % 8) + mark)
        footer = footer_bytes(tables)
        return out.getvalue() + FOOTER + footer + struct.pack("<q", len(footer)) + mark + SIGNATURE


class Pod5(DataSource):
    """POD5 files: Arrow tables of reads and of signal rows in one container."""

    @classmethod
    def name(cls) -> str:
        return "pod5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Pod5Reader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return Pod5Writer(self.options)


def register(spark) -> None:
    """Make the formats known to a session."""
    for kind in (Blow5, Pod5):
        spark.dataSource.register(kind)
