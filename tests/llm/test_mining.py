"""Phrase mining, mixture-controlled packing and Merkle manifests: brute force, round trips, odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import collocations, merkle, packing
from eventloom.llm.vocab import ByteEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, place long, phrase string, grp string, digest string, queue string, n long, round int"
TEXTS = [None, "", " \t\n", "one", "one two three", "\x00 a", "a" * 3000, "x y " * 5000, "é" * 10 + " ü", "one", "O N E", "a 　b\n\n  c <|endoftext|> d", "don't. 'll  x"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, languages, sources and texts, empty and long texts, repeated rows, columns whose names operators use inside."""
    rows = [(k if k != 4 else None, t, (None, "", "en", "é")[k % 4], (None, "s", "")[k % 3], None if k % 5 == 0 else k, 1, 2, "p", "g", "d", "q", 3, 4) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[5:7] + rows[5:7], SCHEMA)


# phrases


def mined(rows, least, top):
    """Phrases by counting all of them."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n["und" if lang is None else lang] += len(words)
            f.update((lang if lang is not None else "und", tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    f = collections.Counter({p: c for p, c in f.items() if c >= least})
    out = collections.defaultdict(list)
    for (lang, words), a in f.items():
        longer = [b for (other, w), b in f.items() if other == lang and len(w) > len(words) > 1 and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if len(words) > 1 and not any(100 * b >= 80 * a for b in longer):
            score, cut = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
            out[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:cut]], f[lang, words[cut:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, some in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(some)[:top], 1))


def listed(df):
    return sorted(tuple(r)[:8] for r in df.collect())


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_phrases_equal_brute_force(spark, odd, block):
    rng = np.random.default_rng(3)
    rows = [(" ".join(rng.choice(["a", "B", "b.", "c", "d,\ne", "\tf"], rng.integers(1, 40))), ("en", None, "x")[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert listed(collocations.collocations(docs, least=4, top=15, shards=2, block_words=block)) == mined(rows, 4, 15)
    some = [(r["text"], r["lang"]) for r in odd.collect()]
    assert listed(collocations.collocations(odd, least=2, shards=2)) == mined(some, 2, 2000)
    assert collocations.collocations(odd.limit(0), shards=1).isEmpty() and collocations.collocations(odd, least=10**9, shards=1).isEmpty()


def test_shards_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6)
    one, many = (collocations.collocations(docs, least=10, shards=n) for n in (1, 3))
    assert listed(one) == listed(many) and one.count() > 50


def test_blocks_overlap_and_phrases_start_late():
    """A phrase is counted once, in the block that it begins in, from the step on at which its parts are known."""
    rng = np.random.default_rng(5)
    codes = rng.integers(-1, 4, 300).astype(np.int32)
    hashes = collocations.unit_hashes(np.array(list("abcd")), np.array(["en"] * 4))
    known = {k: np.full(1 << collocations.SLOT_BITS, 0 if k < 3 else 255, np.uint8) for k in (1, 2, 3)}
    got = collections.Counter()
    for a in range(0, 300, 50):
        for words, since, n in collocations.phrases_in(codes[a : a + 53], 50, hashes, 1, known, 4):
            got.update({tuple(int(w[i]) for w in words): int(n[i]) for i in range(len(n))})
            assert not since.any()
    want = collections.Counter(tuple(map(int, codes[i : i + k])) for k in (1, 2, 3) for i in range(300 - k + 1) if (codes[i : i + k] >= 0).all())
    assert got == want
    assert not list(collocations.phrases_in(codes, 300, hashes, 4, known, 4))  # all have seen their four shards


def test_a_shared_slot_that_is_known_early_loses_nothing(spark):
    """p q r shares a slot with x y z, which is known a step before p q is: p q r s is counted in both shards all the same."""
    tried = 5000

    def slot(words, *rest):
        hashes = [collocations.unit_hashes(np.array(w, object), np.array(["en"] * len(w), object)) for w in (words, *[[w] * tried for w in rest])]
        h = hashes[0].astype(np.uint64)
        for unit in hashes[1:]:
            h = collocations.longer(h, unit)
        return collocations.slots(h)

    p, x = ([f"{c}{k}" for k in range(tried)] for c in "px")
    _, i, j = np.intersect1d(slot(p, "q", "r"), slot(x, "y", "z"), return_indices=True)
    early = [f"{x[j[0]]} y z", "q r s"] * 3
    shards = [early + [f"{p[i[0]]} q r s"] * n for n in (4, 1)]  # the first partition's block is dealt to shard 1, the other's to shard 0
    rows = [(k, text, "en") for k, some in enumerate(shards) for text in some]
    docs = spark.createDataFrame(rows, "k int, text string, lang string").repartitionByRange(2, "k")
    got = listed(collocations.collocations(docs, least=3, shards=2))
    assert got == mined([r[1:] for r in rows], 3, 2000) and f"{p[i[0]]} q r s" in [r[2] for r in got]


def test_languages_that_differ_at_the_end_only(spark):
    rows = [("a b c", lang) for lang in ("e", "e\x00", "e ", "") for _ in range(3)] + [("a b", "e\x00")]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert listed(collocations.collocations(docs, least=2)) == mined(rows, 2, 2000)


def test_words_are_cut_at_spaces_and_marks_only():
    codes, words, langs = collocations.coded_words(pa.array(["A b c\x1cd. \x0be\x85 É", "", " a"]), pa.array(["x", "x", "y"]))
    shown = ["|" if c < 0 else f"{langs[c]}:{words[c]}" for c in codes]
    assert shown == ["x:a b", "x:c\x1cd", "|", "|", "x:e\x85", "x:É", "|", "|", "y:a", "|"]


# packing


def test_bytes_equal_the_reference_library():
    coder = ByteEncoder({"text": open(BYTES, encoding="utf-8").read()})
    texts = [t or "" for t in TEXTS] + ["a   b", "ab\r\ncd", "a\x1c b\x85 c\x0b d", "1a2 b3.c4", " x.'s", "dogs' y", "日本 é́, z!", "\U0001f600 ok  "]
    for _ in range(2):  # the second time with parts that are known
        ids, n = coder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == coder.each(texts)


def whole(pieces, texts, window):
    """Every document's pieces make its ids, and every sequence is gapless."""
    rows = pieces.collect()
    coder = ByteEncoder({"text": open(BYTES, encoding="utf-8").read()})
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"], bytes(r["ids"])))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
    for doc_id, text in texts.items():
        own = sorted(docs.pop(doc_id))
        want = coder.each([text or ""])[0] + [1]
        assert b"".join(x[3] for x in own) == np.array(want, "<u4").tobytes() and {x[2] for x in own} == {len(want)}
    assert not docs
    sizes = []
    for k in range(len(seqs)):
        upto = 0
        for offset, length in sorted(seqs[k]):
            assert offset == upto
            upto += length
        sizes.append(upto)
    assert all(n == window or n & (n - 1) == 0 for n in sizes) and sum(n == window for n in sizes) == sum(sizes) // window
    return rows


def test_packing_keeps_shares_and_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 > 0, "a").when(F.col("doc_id") % 5 > 0, "b")).repartition(5, "doc_id")
    pieces = packing.packed(docs, BYTES, 1)
    rows = whole(pieces, {r["doc_id"]: r["text"] for r in docs.collect()}, 2048)
    total = sum(r["length"] for r in rows)
    size = collections.Counter()
    for r in rows:
        size[r["source"]] += r["length"]
    got = collections.Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        got[r["source"]] += r["length"]
        done = sum(got.values())
        for s in size:  # at most a packet and a quantum away from the target at any place, over all windows and tasks
            assert abs(got[s] - done * size[s] / total) <= packing.PACKET + 2048
    assert all(0 <= r["deficit"] < packing.PACKET + 2048 * size[r["source"]] / total for r in rows)
    joined = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    assert sum(r["n_tokens"] for r in joined.values()) == total and all(len(r["ids"]) == 4 * r["n_tokens"] for r in joined.values())


def test_packing_with_weights(spark):
    docs = spark.createDataFrame([(i, "word " * 400, "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    rows = packing.packed(docs, BYTES, 1, weights={"a": 3}, window=256, packet=32).collect()
    n = collections.Counter()
    for r in rows:
        if r["sequence_id"] < 50:  # both queues have packets left
            n[r["source"]] += r["length"]
    assert n["a"] == pytest.approx(3 * n["b"], rel=0.02)
    with pytest.raises(ValueError):
        packing.packed(docs, BYTES, 1, weights={"a": 0})


def test_packing_of_odd_rows(spark, odd):
    rows = odd.dropDuplicates(["text"]).withColumn("doc_id", F.coalesce("doc_id", F.lit(4)))
    whole(packing.packed(rows, BYTES, 1, window=64, packet=16), {r["doc_id"]: r["text"] for r in rows.collect()}, 64)
    assert packing.packed(odd, BYTES, 1).filter("doc_id is null").count() > 0
    assert packing.packed(odd.limit(0), BYTES, 1).isEmpty()


def test_ends_of_sequences():
    assert packing.sequence_ends(2048 * 3, 2048) == [] and packing.sequence_ends(2048 + 13, 2048) == [2056, 2060, 2061] and packing.sequence_ends(0, 2048) == []


# manifests


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_of(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def proof_of(levels, place):
    out = []
    for nodes in levels[:-1]:
        run = nodes[place // 2 * 2 : place // 2 * 2 + 2]
        out.append(tuple(d for k, d in enumerate(run) if place // 2 * 2 + k < place)), out.append(tuple(d for k, d in enumerate(run) if place // 2 * 2 + k > place))
        place //= 2
    return out


def manifest(rows):
    """The whole manifest in memory."""
    groups = collections.defaultdict(list)
    for r in rows:
        leaf = lambda n: sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"]))))
        cut = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r["n_chars"]), r["doc_id"], leaf(r["n_chars"] + 1) if cut else leaf(r["n_chars"])))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree_of([x[2] for x in sorted(groups[g])]) for g in langs}
    top = tree_of([trees[g][-1][0] for g in langs])
    out = []
    for rank, g in enumerate(langs):
        for place, (_, _, leaf, doc_id, other) in enumerate(sorted(groups[g])):
            path, d = proof_of(trees[g], place) + proof_of(top, rank), other
            for left, right in zip(path[::2], path[1::2]):
                d = sha("".join((*left, d, *right)))
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], sha("".join(x for part in path for x in part)), d, d == top[-1][0]))
    return out


@pytest.mark.parametrize("n, langs", [(1, 1), (2, 1), (700, 3), (150, 140)])
def test_manifest_equals_one_in_memory(spark, n, langs):
    rows = [(None if i % 50 == 3 else i, f"t{i % 90}", None if i % langs == 1 else f"é{i % langs}", None if i % 4 else "s", None if i % 9 == 0 else i % 5) for i in range(n)]
    rows += rows[: n // 10]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [tuple(r)[:7] for r in merkle.checked(docs).collect()]
    assert sorted(got, key=str) == sorted(manifest(docs.collect()), key=str)


def test_manifest_of_odd_rows(spark, odd):
    got = [tuple(r)[:7] for r in merkle.checked(odd).collect()]
    assert sorted(got, key=str) == sorted(manifest(odd.collect()), key=str)
    assert merkle.checked(odd.limit(0)).isEmpty() and merkle.build(odd.limit(0)).root is None


def test_only_some_levels_are_kept_and_asked_proofs_are_right(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    made = merkle.build(docs)
    assert [level.count() for level in made.trees.kept] == [5000, 79, 2, 1]
    some = merkle.proofs(made, asked=F.col("doc_id").isin(7, 4097, 4999))
    rows = some.withColumn("to", merkle.folded(F.col("leaf"), F.col("siblings"), F.col("sides"))).collect()
    assert sorted(r["doc_id"] for r in rows) == [7, 4097, 4999] and {r["to"] for r in rows} == {made.root}
    assert [r["lang"] for r in made.subroots().collect()] == ["en"]
