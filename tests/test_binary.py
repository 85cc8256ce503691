"""Binary read files: variable-byte streams, containers, partitions, broken files."""

import struct
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.functions import vbytes
from eventloom.sources import binary, signals, text

RAW = {f"r{k}": np.array([(i * 7919 + k * 31) % 60000 - 30000 if k % 2 else i % 300 for i in range(k * 40)], np.int16) for k in range(40)}
SCALE, OFFSET = 0.5, 10.0


def expected(raw):
    x = (raw.astype(float) + OFFSET) * SCALE
    return x[(x > 30) & (x < 200)].tolist()


def name(read_id, kind):
    return read_id if kind == "blow5" else str(uuid.uuid5(uuid.NAMESPACE_OID, read_id))


@given(st.lists(st.integers(-(1 << 15), (1 << 15) - 1), max_size=70))
@settings(max_examples=60, deadline=None)
def test_streams_come_back(values):
    for kind, encode, decode in ((np.int16, vbytes.encode16, vbytes.decode16), (np.int32, vbytes.encode32, vbytes.decode32)):
        x = np.array(values, kind)
        data = encode(vbytes.zigzag(vbytes.deltas(x)))
        assert vbytes.summed(vbytes.unzigzag(decode(data, len(x)))).tolist() == values


def test_streams_by_hand():
    assert vbytes.encode32(np.array([1, 0x1FF, 0x10000, 0x1000000, 7], np.uint32)) == bytes([0b11100100, 0]) + b"\x01\xff\x01\x00\x00\x01\x00\x00\x00\x01\x07"
    assert vbytes.encode16(np.array([1, 0x1FF], np.uint16)) == bytes([0b10]) + b"\x01\xff\x01"
    assert vbytes.zigzag(np.array([0, -1, 1, -2], np.int16)).tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        vbytes.decode32(b"\xff\x00", 4)


@pytest.fixture(scope="module")
def raw_reads(spark):
    binary.register(spark)
    rows = [(k, v.tolist(), 4.0, OFFSET, 2.0) for k, v in RAW.items()]
    return spark.createDataFrame(rows, binary.RAW).repartition(2)


@pytest.mark.parametrize("kind, compression", [("blow5", "none"), ("blow5", "zlib"), ("blow5", "zstd"), ("pod5", "none"), ("pod5", "zstd")])
def test_files_come_back(spark, raw_reads, tmp_path, kind, compression):
    raw_reads.write.format(kind).mode("append").option("compression", compression).save(str(tmp_path / "x"))
    want = {name(k, kind): expected(v) for k, v in RAW.items()}
    read = lambda path, **options: spark.read.format(kind).options(**options).load(str(path))
    assert {r["read_id"]: r["signal_pA"] for r in read(tmp_path / "x").collect()} == want
    small = read(tmp_path / "x", partitionBytes=700)
    assert {r["read_id"]: r["signal_pA"] for r in small.collect()} == want and small.count() == len(RAW)
    if kind == "blow5":  # records are dealt over several partitions of a file
        assert small.rdd.getNumPartitions() > 2
        order = [(r["file_no"], r["place"]) for r in small.collect()]
        assert sorted(order) == order and len(set(order)) == len(order)
    one = sorted((tmp_path / "x").iterdir())[0]
    assert 0 < read(one).count() < len(RAW)
    got = signals.read_signals(spark, str(tmp_path / "x"), kind)
    assert got.columns == ["read_id", "signal_pA"] and got.count() == len(RAW)


def test_batches_of_a_large_container_are_dealt_out(spark, tmp_path):
    reads = [(str(uuid.UUID(int=k)), np.arange(50 + k, 150 + k, dtype=np.int16), 4.0, 10.0, 2.0) for k in range(450)]
    (tmp_path / "a.pod5").write_bytes(binary.Pod5Writer({"path": "", "compression": "zstd"}).content(reads))
    binary.register(spark)
    rows = spark.read.format("pod5").option("partitionBytes", 5_000).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 5
    assert [r["read_id"] for r in rows.orderBy("file_no", "place").collect()] == [r[0] for r in reads]


@pytest.mark.parametrize("tables", [{}, {0: (24, 100)}, {1: (1 << 40, 5), 0: (7, 9), 4: (3, 2)}])
def test_footers(tables):
    assert binary.footer_tables(binary.footer_bytes(tables)) == tables


def test_old_headers_and_signals_in_rows(spark, tmp_path):
    """Version 0.1 has no compressed signals; a read's signal may lie in several rows of its table."""
    data = bytearray(binary.Blow5Writer({"path": "", "compression": "none"}).content([("a", np.array([100, 900], np.int16), 4.0, 10.0, 2.0)]))
    data[6:9], data[14] = bytes([0, 1, 0]), 77
    (tmp_path / "a.blow5").write_bytes(data)
    writer = binary.Pod5Writer({"path": "", "compression": "zstd"})
    writer.SAMPLES = 7
    (tmp_path / "b.pod5").write_bytes(writer.content([(str(uuid.UUID(int=3)), np.arange(100, 130, dtype=np.int16), 4.0, 10.0, 2.0)]))
    reads, rejects = signals.scan(spark, str(tmp_path))
    assert {r["read_id"]: r["signal_pA"] for r in reads.collect()} == {"a": [55.0], str(uuid.UUID(int=3)): [(x + 10) / 2 for x in range(100, 130)]}
    assert rejects.isEmpty()


@pytest.fixture
def broken(tmp_path):
    """A folder of good files, broken ones, and others."""
    some = [(f"r{k}", np.full(50, 100, np.int16), 4.0, 10.0, 2.0) for k in range(3)]
    good = binary.Blow5Writer({"path": "", "compression": "none"}).content(some)
    first = 68 + struct.unpack_from("<I", good, 64)[0]
    size = struct.unpack_from("<Q", good, first)[0] + 8
    bad = bytearray(good)
    bad[first + size + 8 : first + size + 10] = b"\xff\xff"  # the second read's name
    pod = binary.Pod5Writer({"path": "", "compression": "zstd"}).content([(str(uuid.UUID(int=k)), *x[1:]) for k, x in enumerate(some)])
    files = {"a.blow5": good, "b.blow5": bad, "c.BLOW5": good[: first + size + 20], "d.pod5": pod, "e.pod5": b"no", "f.pod5": pod[:-40], "g.slow5": b"#x\nr1\t0\t4\t10\t2\t4000\t2\t100,900\nr2\t0\nr3\t0\tx\t10\t2\t4000\t1\t5\n", "h.txt": b"no", "i %+.fast5": b"no"}
    for path, data in files.items():
        (tmp_path / path).write_bytes(data)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "z.blow5").write_bytes(b"no")
    return tmp_path


def test_rejects_of_a_folder(spark, broken):
    reads, rejects = signals.scan(spark, str(broken))
    assert sorted((r["file_no"], r["read_id"]) for r in reads.collect()) == [(0, "r0"), (0, "r1"), (0, "r2"), (1, "r0"), (1, "r2"), (2, "r0"), *[(3, str(uuid.UUID(int=k))) for k in range(3)], (6, "r1")]
    found = {(r["file_no"], r["reason"].split(":")[0]): r["n"] for r in rejects.collect()}
    assert set(no for no, _ in found) == {1, 2, 4, 5, 6, 7} and found[2, "the file ends inside a record"] == 1
    assert found[6, "too few columns"] == 1 and found[6, "calibration is no number"] == 1
    with pytest.raises(Exception, match="b.blow5 at"):
        signals.read_signals(spark, str(broken), "blow5").count()
    assert signals.read_signals(spark, str(broken), "blow5", strict=False).count() == 6
    with pytest.raises(FileNotFoundError):
        signals.scan(spark, str(broken / "none"))


def test_broken_containers_can_be_left_out_whole(spark, tmp_path):
    writer = binary.Pod5Writer({"path": "", "compression": "zstd"})
    reads = [(str(uuid.UUID(int=k)), np.full(50, 100, np.int16), 4.0, 10.0, 2.0) for k in range(3)]
    data = writer.content(reads)
    packed = data.index(b"\x28\xb5\x2f\xfd")  # the first signal
    (tmp_path / "a.pod5").write_bytes(data[:packed] + b"\x00" * 4 + data[packed + 4 :])
    assert signals.scan(spark, str(tmp_path))[0].count() == 2
    reads_, rejects = signals.scan(spark, str(tmp_path), whole_files=True)
    assert reads_.isEmpty() and rejects.count() == 1


def test_kmer_lines_that_are_bad(spark):
    rows = text.kmer_rows(spark.createDataFrame([("# c",), ("ACG 1",), ("",), ("AC",), ("AC x",), ("AC 2",)], "value string").coalesce(1))
    assert rows.filter(F.col("error").isNotNull()).count() == 2 and text.first_k(rows.filter("error is null")) == 3
    assert text.first_k(rows.limit(0)) is None
