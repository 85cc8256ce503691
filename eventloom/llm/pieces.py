"""Subword pieces from a model file, encoded and decoded with the tokenizers library.

The model file is a protobuf message; it is read here field by field, and its normaliser,
white space marker, scores and byte fallback are rebuilt as a tokenizers model.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import lean, small_batches, whole_text
from eventloom.llm.vocab import few_threads, id_lists, joined_runs, looked_up, runs, text_parts, whole_array

#: The marker that stands for a space; the message's kinds of pieces and models.
MARKER = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number, and the value as an integer or as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
            continue
        if wire not in (1, 2, 5):
            raise ValueError(f"field {number} has the unknown wire type {wire}")
        size = varint() if wire == 2 else 8 if wire == 1 else 4
        yield number, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What a model file says."""

    pieces: list[tuple[str, float, int]]  # piece, score, kind
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_prefix: bool = True
    squeeze: bool = True  # drop spaces at the ends and runs of them
    escape: bool = True


def parse(data: bytes) -> PieceModel:
    model = PieceModel([])
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
            model.unk_id = trainer.get(40, 0)
        elif number == 3:
            rules = dict(fields(value))
            model.charsmap = rules.get(2, b"")
            model.add_prefix, model.squeeze, model.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are known")
    return model


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """The merges of a BPE model: every way to cut a piece in two others, the best-scored piece first."""
    rank = {p: (-score, i) for i, (p, score, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, place in rank.items():
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            if a in rank and b in rank:
                found.append((place, rank[a][1], rank[b][1], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: PieceModel, prefix: bool | None = None):
    """The tokenizers model that gives the same ids. prefix: whether a text gets the marker in front (default: as the file says)."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.kind == BPE:
        own = models.BPE(vocab, merges(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        own = models.Unigram([(p, score) for p, score, _ in model.pieces], model.unk_id, model.byte_fallback)
    out = Tokenizer(own)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_prefix if prefix is None else prefix:
        steps.append(normalizers.Prepend(MARKER if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARKER))
    out.normalizer = normalizers.Sequence(steps)
    strip = [decoders.Strip(" ", 1, 0)] if model.add_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    out.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER])
    return out


def piece_bytes(model: PieceModel) -> list[bytes]:
    """What each id adds to a decoded text; control pieces add nothing."""
    as_bytes = lambda p, kind: bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARKER, " ").encode()
    return [as_bytes(p, kind) for p, _, kind in model.pieces]


class PieceCoder:
    """Encodes and decodes batches of texts.

    No piece of the model joins a letter with a marker behind it (else texts are encoded
    one by one), so a text may be cut before its runs of spaces, and each distinct part
    of a batch is encoded once. shared holds the model file's bytes and what is built
    from them, so tasks of one worker build it once.
    """

    def __init__(self, shared: dict):
        if "built" not in shared:
            few_threads()
            model = parse(shared["model"])
            cuttable = model.escape and not model.charsmap and not model.squeeze and model.add_prefix and not any(MARKER in p.lstrip(MARKER) or kind == USER for p, _, kind in model.pieces)
            opens = np.array([p.startswith(MARKER) for p, _, _ in model.pieces])
            shared["built"] = model, build(model), build(model, prefix=False), cuttable, opens, pa.array(piece_bytes(model), pa.binary())
        self.model, self.whole, self.inner, self.cuttable, self.opens, self.bytes = shared["built"]

    def each(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, by the library alone."""
        return [x.ids for x in self.whole.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one after the other, and how many each text has. Equal to each()."""
        texts = whole_array(texts)
        odd = pc.or_(pc.match_substring(texts, "\x00"), pc.match_substring(texts, MARKER)).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy() == 0)
        if not self.cuttable:
            odd[:] = True
        plain = pc.binary_join_element_wise(" ", pc.if_else(pa.array(odd), "", texts), "")
        parts = pc.split_pattern(pc.replace_substring_regex(plain, r"( *[^ ]+)", "\\1\x00"), "\x00")
        of = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy())
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary
        single = pc.match_substring_regex(words, "^ [^ ]+$").to_numpy(zero_copy_only=False)
        names = words.filter(pa.array(single)).to_pylist(), words.filter(pa.array(~single)).to_pylist()
        inner = lambda many: [x.ids for x in self.inner.encode_batch(many, add_special_tokens=False)]
        found = joined_runs(names[0], "", inner, lambda ids: np.flatnonzero(self.opens[ids]), inner) + runs(inner(names[1]))
        place = np.empty(len(single), np.int64)  # each word begins where a piece has the marker in front
        place[single], place[~single] = np.arange(len(names[0])), len(names[0]) + np.arange(len(names[1]))
        ids, sizes = looked_up(id_lists(found), place[coded.indices.to_numpy()])
        counts = np.bincount(of, weights=sizes, minlength=len(texts)).astype(np.int64)
        if not odd.any():
            return ids, counts
        split = np.split(ids, np.cumsum(counts)[:-1])
        for k, x in zip(np.flatnonzero(odd), self.each([texts[k].as_py() for k in np.flatnonzero(odd)])):
            split[k] = np.asarray(x, np.uint32)
        return np.concatenate(split), np.array([len(x) for x in split], np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids: the pieces' bytes joined, without the space in front."""
        taken = self.bytes.take(pa.array(ids.astype(np.int64)))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy())]).astype(np.int64)
        raw = b"".join(taken.to_pylist()) if taken.offset or taken.buffers()[2] is None else taken.buffers()[2].to_pybytes()
        cuts = ends[np.concatenate([[0], np.cumsum(counts)])]
        skip = 1 if self.model.add_prefix else 0
        return [raw[a + (skip if raw[a : a + 1] == b" " else 0) : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(cuts[:-1], cuts[1:])]


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int), n_ids (long), round_trip (boolean).

    Every whole text is encoded and decoded again; round_trip says whether the decoded
    text is the text (a text that holds the marker itself comes back with a space in its
    place). Null and empty texts have no ids, repeated rows have equal results, an
    empty table gives an empty result, and other columns are not read. No shuffle: each
    batch is encoded where it is read, by the library's threads.
    """
    spark = docs.sparkSession
    small_batches(spark, 2000)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast({"model": f.read()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(shared.value)
        for part in text_parts(batches):
            texts = part.column("text")
            ids, counts = coder.encode(texts)
            same = [a == b for a, b in zip(coder.decode(ids, counts), texts.to_pylist())]
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(counts), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """The texts of rows with doc_id and ids: columns doc_id, text; null ids count as none."""
    spark = rows.sparkSession
    small_batches(spark, 2000)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast({"model": f.read()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(shared.value)
        for batch in batches:
            lists = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            texts = coder.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")
