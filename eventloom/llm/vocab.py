"""Batch encoding by distinct words: each distinct word of a batch is encoded once, then looked up."""

from __future__ import annotations

import os
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text that are encoded together.
BATCH_ROWS = 8000
BATCH_BYTES = 16_000_000
#: Words that are joined into one text for the tokenizer, words that are looked up at once.
JOINED = 200
LOOKED_UP = 300_000

#: ASCII punctuation; a run of it at the end of a word is always cut off behind a letter or digit.
TAIL_MARKS = string.punctuation


def few_threads(n: int = 2) -> None:
    """So many threads for the library in each task's process, unless the environment says otherwise: tasks share the machine's cores."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(n))


def text_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size; a longer text has one of its own."""
    for batch in batches:
        rows = max(1, min(BATCH_ROWS, int(BATCH_ROWS * BATCH_BYTES / max(batch.nbytes, 1))) if batch.nbytes > BATCH_BYTES else BATCH_ROWS)
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def whole_array(texts: pa.Array) -> pa.Array:
    """The texts as an array of their own: some kernels forget the offset of a slice."""
    return pa.array(texts.to_numpy(zero_copy_only=False), pa.string()) if texts.offset else texts


Runs = list[tuple[np.ndarray, np.ndarray]]  # ids one after the other, and how many each word has


def runs(lists: list) -> Runs:
    """Lists of token ids as one run."""
    return [(np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists)))]


def id_lists(found: Runs, order: np.ndarray | None = None) -> pa.ListArray:
    """Runs of token ids as one array of lists; order: for each list, its place in the runs."""
    flat = np.concatenate([np.zeros(0, np.uint32), *[x for x, _ in found]])
    ends = np.cumsum(np.concatenate([[0], *[n for _, n in found]])).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    return lists if order is None else lists.take(pa.array(order))


def looked_up(lists: pa.ListArray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a sequence of codes, one after the other, and how many each code has."""
    size = pc.list_value_length(lists).to_numpy()
    return lists.take(pa.array(codes)).flatten().to_numpy(), size[codes]


def joined_runs(words: list[str], glue: str, encode, starts_of, each) -> Runs:
    """The ids of words that are joined into longer texts to save calls.

    encode gives the ids of such texts, starts_of the places where a word's first id may
    be; where these aren't as many as the words, each() encodes the words one by one.
    """
    out: Runs = []
    groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
    for k in range(0, len(groups), 50):
        some = groups[k : k + 50]
        for group, ids in zip(some, encode([glue.join(g) for g in some])):
            ids = np.asarray(ids, np.uint32)
            starts = starts_of(ids)
            if len(starts) == len(group) and starts[0] == 0:
                out.append((ids, np.diff(np.append(starts, len(ids)))))
            else:
                out += runs(each(group))
    return out


class WordEncoder:
    """A tokenizers-library model that never joins what white space parts.

    shared holds the tokenizer file's text. What is built from it is kept there too, so
    that tasks of one worker, which get the same broadcast, build the tokenizer once.
    """

    def __init__(self, shared: dict, word_end: str = "</w>"):
        if "built" not in shared:
            few_threads()
            from tokenizers import Tokenizer, normalizers, pre_tokenizers

            model = Tokenizer.from_str(shared["text"])
            ends = np.zeros(model.get_vocab_size(), bool)
            for word, i in model.get_vocab().items():
                ends[i] = word.endswith(word_end)
            bare = Tokenizer.from_str(shared["text"])
            bare.normalizer, bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
            lower = model.normalizer is not None and model.normalizer.normalize_str("Az") == "az"
            same = lower and [x.ids for x in (model.encode("az by", add_special_tokens=False), bare.encode("az by", add_special_tokens=False))]
            shared["built"] = model, ends, bare if same and same[0] == same[1] else model
        self.tokenizer, self.ends, self.bare = shared["built"]

    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def each(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, by the library alone."""
        out = []
        for k in range(0, len(texts), 5000):
            out += [x.ids for x in self.tokenizer.encode_batch_fast(texts[k : k + 5000], add_special_tokens=False)]
        return out

    def _starts(self, ids: np.ndarray) -> np.ndarray:
        """Where words begin: at the first id, and behind each token that ends a word."""
        return np.flatnonzero(np.r_[True, self.ends[ids[:-1]]]) if len(ids) else np.zeros(0, int)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one after the other, and how many each text has.

        Equal to encoding each text by itself. Words that differ in ASCII case or in the
        marks behind their last letter or digit share the encoding of what they have in common,
        and words of a-z only, which the normaliser leaves as they are, skip it.
        Texts that may hold a special token's string are encoded as they are.
        """
        texts = whole_array(texts)
        odd = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        lists = pc.ascii_split_whitespace(plain)
        coded = lists.flatten().dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        word = coded.dictionary
        low = pc.ascii_lower(word)
        stem = pc.ascii_rtrim(low, characters=TAIL_MARKS)
        parted = pc.match_substring_regex(stem, r"[\p{L}\p{N}]$")
        stem = pc.if_else(parted, stem, word)
        cut = (pc.binary_length(low).to_numpy() - pc.binary_length(stem).to_numpy()) * parted.to_numpy(zero_copy_only=False)
        tails, tail = [""], np.zeros(len(word), np.int32)
        for n in np.unique(cut[cut > 0]):
            marks = pc.utf8_slice_codeunits(low.filter(pa.array(cut == n)), start=-int(n)).dictionary_encode()
            tail[cut == n] = marks.indices.to_numpy() + len(tails)
            tails += marks.dictionary.to_pylist()
        stems = stem.dictionary_encode()
        distinct, place, n, found = stems.dictionary, np.empty(len(stems.dictionary), np.int32), 0, []
        simple, letters = (pc.match_substring_regex(distinct, p).to_numpy(zero_copy_only=False) for p in (r"^[a-z]+$", r"^\p{L}+$"))
        for some, model in ((simple, self.bare), (letters & ~simple, self.tokenizer), (~letters, None)):
            names = distinct.filter(pa.array(some)).to_pylist()
            joined = lambda many, m=model: [x.ids for x in m.encode_batch_fast(many, add_special_tokens=False)]
            found += runs(self.each(names)) if model is None else joined_runs(names, " ", joined, self._starts, self.each)
            place[some] = n + np.arange(len(names))
            n += len(names)
        found += runs(self.each(tails))
        pair = np.stack([place[stems.indices.to_numpy()], tail + np.int32(n)], axis=1) if len(word) else np.zeros((0, 2), np.int32)
        table, codes = id_lists(found), coded.indices.to_numpy()
        del lists, coded, stems, word, low, stem  # as large as the texts
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        cuts = np.flatnonzero(np.diff(ends[1:] // LOOKED_UP)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ends) - 1]):  # a few texts at a time
            some, sizes = looked_up(table, pair[codes[ends[a] : ends[b]]].ravel())
            upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int32)])
            ids.append(some)
            counts.append(np.diff(upto[2 * (ends[a : b + 1] - ends[a])]).astype(np.int64))  # two parts a word
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        return self._with_odd(texts, odd, ids, counts) if odd.any() else (ids, counts)

    def _with_odd(self, texts: pa.Array, odd: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(odd):
            parts[k] = np.asarray(self.each([texts[k].as_py()])[0], np.uint32)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)



class ByteEncoder:
    """A tokenizers-library byte-level model: texts are cut before ASCII white space that follows another character.

    No piece of the model's pattern goes over such a place, nor over one between a letter
    or digit and a mark, so the parts' ids follow each other. Distinct parts are encoded
    once; a process keeps the first CACHED ones. Texts with a character that the cuts
    need, or a special token's string, are encoded as they are. shared: see WordEncoder.
    """

    CUT, CACHED = "\x00", 1_000_000
    #: A place where white space follows white space, in RE2's words; a part that begins with a space and is one piece.
    SPACES_MEET = r"[\s\v\x1c-\x1f\x{85}\pZ][ \t\n\f\r]"
    BEFORE_SPACE = r"([^\s\v\x1c-\x1f\x{85}\pZ])([ \t\n\f\r])"
    ONE_PIECE = r"^ (\pL+|\pN+)$"

    def __init__(self, shared: dict):
        if "bytes" not in shared:
            few_threads(1)
            from tokenizers import Tokenizer

            model = Tokenizer.from_str(shared["text"])
            special = [t.content for t in model.get_added_tokens_decoder().values()]
            cuttable = model.normalizer is None and "ByteLevel(add_prefix_space=False" in str(model.pre_tokenizer)
            begins = np.zeros(model.get_vocab_size(), bool)
            for word, i in model.get_vocab().items():
                begins[i] = word.startswith("\u0120")  # the form of a space
            shared["bytes"] = model, special, cuttable, begins, {"at": {}, "ids": np.zeros(0, np.uint32), "sizes": np.zeros(0, np.int64)}
        self.tokenizer, self.special, self.cuttable, self.begins, self.known = shared["bytes"]

    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def each(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, by the library alone."""
        out = []
        for k in range(0, len(texts), 5000):
            out += [x.ids for x in self.tokenizer.encode_batch_fast(texts[k : k + 5000], add_special_tokens=False)]
        return out

    def _found(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct parts' ids: a run of ids, the sizes of its lists, and for each part the place of its list."""
        names, at, n = parts.to_pylist(), self.known["at"], len(self.known["at"])
        place = np.fromiter((at.get(w, -1) for w in names), np.int64, len(names))
        new = place < 0
        plain = pc.match_substring_regex(parts, self.ONE_PIECE).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(new & plain), np.flatnonzero(new & ~plain)])
        place[order] = n + np.arange(len(order))
        fresh = [names[k] for k in order]
        m = int((new & plain).sum())
        encode = lambda many: [x.ids for x in self.tokenizer.encode_batch_fast(many, add_special_tokens=False)]
        got = joined_runs(fresh[:m], "", encode, lambda ids: np.flatnonzero(self.begins[ids]), self.each) + runs(self.each(fresh[m:]))
        ids, sizes = np.concatenate([self.known["ids"], *[x for x, _ in got]]), np.concatenate([self.known["sizes"], *[k for _, k in got]])
        room = max(0, min(self.CACHED - n, len(fresh)))
        if room:
            at.update(zip(fresh[:room], range(n, n + room)))
            self.known["sizes"] = sizes[: n + room].copy()
            self.known["ids"] = ids[: int(self.known["sizes"].sum())].copy()
        return ids, sizes, place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, one after the other, and how many each text has; equal to encoding each text by itself."""
        texts = whole_array(texts)
        odd = np.full(len(texts), not self.cuttable)
        for mark in (self.CUT, *self.special):
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        cut = plain
        for space in " \t\n\f\r":
            cut = pc.replace_substring(cut, space, self.CUT + space)
        meet = pc.match_substring_regex(plain, self.SPACES_MEET)
        if pc.any(meet).as_py():
            cut = pc.replace_with_mask(cut, meet, pc.replace_substring_regex(plain.filter(meet), self.BEFORE_SPACE, rf"\1{self.CUT}\2"))
        lists = pc.split_pattern(cut, self.CUT)
        coded = lists.flatten().dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        part, codes = coded.dictionary, coded.indices.to_numpy()
        del cut, lists, coded
        stem = pc.ascii_rtrim(part, characters=TAIL_MARKS)
        parted = pc.match_substring_regex(stem, r"[\pL\pN]$").to_numpy(zero_copy_only=False)
        stem = pc.if_else(pa.array(parted), stem, part)
        tail = pc.binary_slice(part.cast(pa.binary()), 0, 0).cast(pa.string())
        for n in np.unique(pc.binary_length(part).to_numpy() - pc.binary_length(stem).to_numpy()):
            if n:
                own = pc.equal(pc.subtract(pc.binary_length(part), pc.binary_length(stem)), int(n))
                tail = pc.replace_with_mask(tail, own, pc.utf8_slice_codeunits(part.filter(own), start=-int(n)))
        both = pa.concat_arrays([stem, tail]).dictionary_encode()
        table, sizes, place = self._found(both.dictionary)
        starts = np.cumsum(sizes) - sizes
        pair = place[both.indices.to_numpy()].reshape(2, -1).T
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        cuts = np.flatnonzero(np.diff(ends[1:] // LOOKED_UP)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ends) - 1]):  # a few texts at a time
            of = pair[codes[ends[a] : ends[b]]].ravel()
            upto = np.concatenate([[0], np.cumsum(sizes[of])])
            ids.append(table[np.repeat(starts[of] - upto[:-1], sizes[of]) + np.arange(upto[-1])])
            counts.append(np.diff(upto[2 * (ends[a : b + 1] - ends[a])]))  # two parts each
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        if odd.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(odd):
                parts[k] = np.asarray(self.each([texts[k].as_py()])[0], np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts
