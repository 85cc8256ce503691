"""Piece encoding and token files: parity with the libraries, round trips, odd texts."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from eventloom.llm import pieces, queries, token_files
from eventloom.llm.vocab import WordEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "   ", "a  b\n\tc", "  x ", "日本 é́", "ﬁ Ⅷ", "hello▁world", "a\x00b  c", "\n", "\n\n a", "é É!", "İx", "<s> </s> <0x0A>", "<|endoftext|> <|ENDOFTEXT|>", "don't DON'T it's'", "word### a.b.c 12,5!", "x" * 5000, "ab cd ef", "\U0001f600 ok"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    return [r["text"] or "" for r in rows] + ODD


def test_pieces_equal_the_reference_library(texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coder = pieces.PieceCoder({"model": open(MODEL, "rb").read()})
    ids, counts = coder.encode(pa.array(texts))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == own.encode(texts)
    assert coder.each(ODD) == own.encode(ODD)
    back = coder.decode(ids, counts)
    assert back == own.decode([p.tolist() for p in parts])
    assert back == [t.replace("▁", " ") for t in texts]
    sliced = pa.array(["x", *ODD]).slice(1)
    assert coder.encode(sliced)[1].tolist() == coder.encode(pa.array(ODD))[1].tolist()


def message(*parts):
    """A protobuf message of (number, value) fields; values are integers, bytes or floats."""
    import struct

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_models():
    sentencepiece = pytest.importorskip("sentencepiece")
    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁ab", -4.0, 1), ("▁a", -3.5, 1), ("ba", -4.5, 1)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in vocab)
    data += message((2, message((3, 1), (35, 1), (40, 0))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    coder = pieces.PieceCoder({"model": data})
    some = ["ab ab a", "abba", "a  b", "aé b", "", "ba ab"]
    ids, counts = coder.encode(pa.array(some))
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == own.encode(some)
    with pytest.raises(ValueError):
        pieces.parse(message((2, message((3, 4)))))


def test_piece_spaces(spark):
    """White space at the ends: a unigram model that squeezes runs drops spaces only, and long texts keep their whole length."""
    sentencepiece = pytest.importorskip("sentencepiece")
    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("▁ab", -4.0, 1), ("▁a", -3.5, 1)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in vocab)
    data += message((2, message((3, 1), (35, 1), (40, 0))), (3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    coder = pieces.PieceCoder({"model": data})
    some = ["  ab   a  ", "\tab\n", " \n a \t ", "\n", "   ", "ab\t\tb", "a " * 50_000]
    ids, counts = coder.encode(pa.array(some))
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == own.encode(some)


def test_piece_long_texts(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["word " * 200_000, "x" * 5_000, "\t".join(["tabbed"] * 10_000)]
    rows = pieces.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL).collect()
    assert all(r["round_trip"] and r["ids"] == own.encode(texts[r["doc_id"]]) for r in rows) and len(rows) == 3


def test_piece_query(spark, sf):
    out = queries.op7_piece_encoding(spark, sf)
    assert out.filter("not round_trip or size(ids) <> n_ids").isEmpty()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    back = pieces.decoded(out, MODEL).join(docs.select("doc_id", docs["text"].alias("own")), "doc_id")
    assert back.filter("text <> own").isEmpty() and back.count() == docs.count()


def test_piece_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "a", 0), (2, "b", 0), (2, "b", 0)], "doc_id long, text string, ids int")
    rows = pieces.encoded(docs, MODEL).collect()
    assert sorted(r["n_ids"] for r in rows) == [0, 1, 1, 1]
    assert pieces.encoded(docs.limit(0), MODEL).isEmpty()


def test_words_equal_the_library(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS)
    ids, counts = WordEncoder({"text": open(WORDS, encoding="utf-8").read()}).encode(pa.array(texts))
    expected = [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == expected


@pytest.mark.parametrize("sizes", [[], [1], [127, 128, 129], [20_000, 3], [70_000]])
def test_blocks_round_trip(sizes):
    rng = np.random.default_rng(len(sizes))
    blocks = [np.minimum(rng.zipf(1.3, n), 5000) for n in sizes]
    counts = np.bincount(np.concatenate([[1], *blocks]).astype(int), minlength=5001)
    table = token_files.Table(counts)
    made = token_files.encode_blocks(blocks, table)
    assert all((a == b).all() for a, b in zip(token_files.decode_blocks(made, table), blocks))
    if sizes:
        broken = bytearray(made[0])
        broken[len(broken) // 2] ^= 1
        with pytest.raises(ValueError):
            token_files.decode_blocks([bytes(broken)], table)


def test_blocks_of_one_id():
    table = token_files.Table(np.array([0, 0, 9]))
    block = np.full(1000, 2)
    assert (token_files.decode_blocks(token_files.encode_blocks([block], table), table)[0] == block).all()


def test_token_files(spark, sf):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS)
    got = sorted(tuple(r) for r in queries.op9_token_files(spark, sf).collect())
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    expected, start = [], 0
    for i, t in docs:
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected


def test_token_files_of_odd_rows(spark):
    docs = spark.createDataFrame([(5, None, 0), (None, "a b", 0), (2, "", 0), (2, "", 0), (-1, "long " * 90_000, 0)], "doc_id long, text string, start int")
    rows = sorted(token_files.TokenFiles(spark, token_files.write_token_files(docs, WORDS, 2)).ids().collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, -1, 2, 2, 5] and all(r["ids"][-1] == 2 for r in rows)
    assert [r["n_tokens"] for r in rows] == [3, 90_001, 1, 1, 1]
    empty = token_files.TokenFiles(spark, token_files.write_token_files(docs.limit(0), WORDS, 2))
    assert empty.checksums().isEmpty() and empty.header["n_docs"] == empty.header["n_tokens"] == 0


def test_token_files_in_another_session(spark, sf, tmp_path):
    """A process that knows the path only reads the ids back."""
    import hashlib
    import os
    import subprocess
    import sys

    path = f"{tmp_path}/tokens"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert token_files.write_token_files(docs, WORDS, 2, path) == path
    head = token_files.TokenFiles(spark, path).header
    with open(WORDS, "rb") as f:
        assert head["tokenizer_sha256"] == hashlib.sha256(f.read()).hexdigest() and head["end_id"] == 2
    code = f"""
from pyspark.sql import SparkSession
from eventloom.llm.token_files import TokenFiles
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
TokenFiles(spark, {path!r}).checksums().toPandas().to_csv({f"{tmp_path}/out.csv"!r}, index=False)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=300)
    with open(f"{tmp_path}/out.csv") as f:
        rows = sorted(tuple(map(int, line.split(","))) for line in f.read().splitlines()[1:])
    assert rows == sorted(tuple(r) for r in queries.op9_token_files(spark, sf).collect())
    assert len(rows) == head["n_docs"] and sum(r[2] for r in rows) == head["n_tokens"]


def test_blocks_of_another_table():
    one, other = token_files.Table(np.array([1, 2, 9])), token_files.Table(np.array([1, 3, 9]))
    made = token_files.encode_blocks([np.array([0, 1, 2])], one)
    with pytest.raises(ValueError):
        token_files.decode_blocks(made, other)
