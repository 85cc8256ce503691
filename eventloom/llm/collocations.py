"""Phrases that occur more often than their parts suggest, counted by dynamic itemset counting.

The words of all texts lie in shards, which are scanned in turn, over and over. A phrase is
counted from the step on at which the phrases without its last and without its first word
are known to be frequent, whatever the length of either, and for one full cycle of shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import lean, placed, small_side, unused_path, whole_text, written
from eventloom.llm.vocab import text_parts

#: Parameters: shards of a cycle, most words of a phrase, words of a block.
SHARDS, LONGEST = 2, 4
BLOCK_WORDS = 1 << 19
#: Bits of a slot's number: frequent phrases are known to tasks by slots, a byte each, so what is sent to them doesn't grow.
#: Phrases that share a slot are at worst counted in vain: counts are kept by the phrases themselves.
SLOT_BITS = 22
NEVER = 255
#: Bits of a slot's number where rare phrases are dropped before shards are added up; a bit each is sent to tasks.
FILTER_BITS = 25

#: The characters that end a piece, as a pattern, and the one that stands for them.
ENDS, END = r"[.,;:!?\n-\r]", "."

BLOCK = "shard int, langs array<string>, words string, unit_langs binary, hashes binary, codes binary, own int"
#: mark holds the step since which a phrase is counted, its words (3 bits) and its slot.
COUNT = "lang string, phrase string, mark long, n long"
SLOT, PHRASE = (1 << SLOT_BITS) - 1, (1 << (SLOT_BITS + 3)) - 1


def _hashed(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words.astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def unit_hashes(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """A hash of each word in its language."""
    return ((_hashed(words) * np.uint64(0x9E3779B97F4A7C15) + _hashed(langs)) >> np.uint64(32)).astype(np.uint32)


def longer(h: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The hashes of phrases with a word more."""
    x = (h.astype(np.uint64) ^ (h.astype(np.uint64) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + unit.astype(np.uint64)
    return x


def slots(h: np.ndarray) -> np.ndarray:
    return ((h.astype(np.uint64) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def coded_words(texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of whole texts as numbers, -1 between pieces and behind each text; each number's word and language."""
    cut = pc.replace_substring_regex(pc.ascii_lower(texts), ENDS, f" {END} ")
    lists = pc.ascii_split_whitespace(pc.binary_join_element_wise(cut, END, " "))
    sizes = pc.list_value_length(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    words, code = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy().astype(np.int64)
    lang = langs.dictionary_encode()
    names = lang.dictionary.to_numpy(zero_copy_only=False)
    key = np.repeat(lang.indices.to_numpy().astype(np.int64), sizes) * max(len(words), 1) + code
    unit, code = np.unique(key, return_inverse=True) if len(names) > 64 else _by_place(key, len(names) * max(len(words), 1))
    own = words[unit % max(len(words), 1)] if len(words) else words
    if len(code):
        code = np.where(own == END, -1, np.arange(len(own)))[code[(own != "")[code]]]
    return code, own, names[unit // max(len(words), 1)] if len(names) else names


def _by_place(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique() with the inverse for keys below a size."""
    there = np.zeros(size, bool)
    there[key] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[key]


def _blocks(docs: DataFrame, shards: int, block_words: int, text_col: str, lang_col: str) -> DataFrame:
    """The words of all texts in blocks, dealt over shards: up to block_words words that phrases begin with, and those that they may end with."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for part in text_parts(batches):
            codes, words, langs = coded_words(part.column("text"), part.column("lang"))
            for a in range(0, len(codes), block_words):
                block = codes[a : a + block_words + LONGEST - 1]
                unit, code = _by_place(block + 1, len(words) + 1)  # 0 stands for the end of a piece
                has_end = int(len(unit) > 0 and unit[0] == 0)
                unit, code = unit[has_end:] - 1, code - has_end
                if not len(unit):
                    continue
                lang = pa.array(langs[unit], pa.string()).dictionary_encode()
                turn += 1
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "shard": turn % shards,
                            "langs": lang.dictionary.to_pylist(),
                            "words": "\n".join(words[unit]),
                            "unit_langs": lang.indices.to_numpy().astype("<i4").tobytes(),
                            "hashes": unit_hashes(words[unit], langs[unit]).astype("<u4").tobytes(),
                            "codes": code.astype("<i4").tobytes(),
                            "own": min(block_words, len(block)),
                        }
                    ],
                    schema=schema,
                )

    schema = pa.schema([("shard", pa.int32()), ("langs", pa.list_(pa.string())), ("words", pa.string()), ("unit_langs", pa.binary()), ("hashes", pa.binary()), ("codes", pa.binary()), ("own", pa.int32())])
    return rows.mapInArrow(lean(run), BLOCK)


def phrases_in(codes: np.ndarray, own: int, hashes: np.ndarray, step: int, known: dict[int, np.ndarray], shards: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """What a block adds at a step: for each length, the words of the phrases that are counted, since which step, and how often.

    known[k] has for each slot the step from which a phrase of k words there is known to
    be frequent. A phrase is counted from the step at which all phrases inside it are
    known, and in `shards` steps. All, not only the two of one word less: a slot that one
    of those shares may be known long before its own parts are.
    """
    if step < shards:
        counts = np.bincount(codes[:own][codes[:own] >= 0], minlength=len(hashes))
        found = np.flatnonzero(counts)
        yield [found], np.zeros(len(found), np.int64), counts[found]
    size = len(hashes)
    unit = hashes[codes].astype(np.uint64)
    h, ages = unit, np.where(codes >= 0, known[1][slots(hashes)][codes], NEVER)
    for k in range(2, LONGEST + 1):
        age = np.maximum(ages[:-1], ages[1:])
        for since in range(max(0, step - shards + 1), step + 1):
            at = np.flatnonzero(age[:own] == since)
            if len(at):
                words, n = _distinct(codes, at, k, size)
                yield words, np.full(len(n), since, np.int64), n
        both = age <= step
        if k == LONGEST or not both.any():
            return
        h = longer(h[:-1], unit[k - 1 :])
        ages = np.where(both, np.maximum(known[k][slots(h)], age), NEVER)


def _distinct(codes: np.ndarray, at: np.ndarray, k: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct phrases of k words that begin at some places, as the numbers of their words, and how often each does."""
    key = codes[at].astype(np.int64) * size + codes[at + 1]
    if k > 2:
        key = key * size + codes[at + 2]  # blocks are so small that this fits
    if k > 3:
        front, key = np.unique(key, return_inverse=True)
        key = key * size + codes[at + 3]
    key, n = np.unique(key, return_counts=True)
    words = []
    if k > 3:
        key, last = np.divmod(key, size)
        key, words = front[key], [last]
    for _ in range(min(k, 3) - 1):
        key, last = np.divmod(key, size)
        words.insert(0, last)
    return [key, *words], n


def _phrase_hash(words: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    return reduce(longer, [hashes[w].astype(np.uint64) for w in words])


def _counted(blocks: DataFrame, step: int, known, shards: int) -> DataFrame:
    """The counts that a shard's blocks add at a step, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                words = pc.split_pattern(pa.array([row["words"].as_py()]), "\n").flatten()
                of = lambda c, kind: np.frombuffer(row[c].as_buffer(), kind)
                langs, lang, hashes = row["langs"].values, of("unit_langs", "<i4"), of("hashes", "<u4")
                for found, since, n in phrases_in(of("codes", "<i4"), row["own"].as_py(), hashes, step, known.value, shards):
                    for a in range(0, len(n), 100_000):
                        some = slice(a, a + 100_000)
                        parts = [words.take(pa.array(w[some])) for w in found]
                        phrase = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
                        mark = (since[some] << 3 | len(parts)) << SLOT_BITS | slots(_phrase_hash([w[some] for w in found], hashes))
                        yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[found[0][some]])), phrase, pa.array(mark), pa.array(n[some])], names=["lang", "phrase", "mark", "n"])

    return blocks.mapInArrow(lean(run), COUNT)


def _frequent(tables: list[DataFrame], least: int, shards: int) -> DataFrame:
    """The phrases of tables of counts that reach `least`: lang, phrase, mark, n.

    Where `shards` counts add up to `least`, one of them is a shards-th of it at least. So
    rows are dropped before the shuffle whose slot has no such count: most, as most phrases
    are rare. The slots are sent to all tasks as bits of at most 2 ** (FILTER_BITS - 6) numbers.
    """
    counts = reduce(DataFrame.unionByName, tables).withColumn("_slot", F.xxhash64("lang", "phrase").bitwiseAND((1 << FILTER_BITS) - 1))
    word, bit = F.shiftright("_slot", 6), F.col("_slot").bitwiseAND(63).cast("int")
    high = counts.filter(F.col("n") >= -(-least // shards)).groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    some = counts.withColumn("_word", word).join(F.broadcast(high), "_word").filter(F.getbit("_bits", bit) == 1)
    return some.groupBy("lang", "phrase", "mark").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def phrase_counts(docs: DataFrame, least: int = 30, shards: int = SHARDS, block_words: int = BLOCK_WORDS, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to LONGEST words that occur `least` times or more: lang, phrase, k, n; and all words' number by lang: lang, n.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and pieces
    into words at spaces and tabs. A null language is `und`, a null text has no words.

    One pass writes the words of all texts as numbers, in blocks that know their own
    words. Step t then reads shard t mod shards and writes what its blocks count: phrases
    of any length that are open, which a phrase is for `shards` steps. The counts of the
    last `shards` steps are all there are of open phrases; where they reach `least`, longer
    phrases may start at the next step. There are at most LONGEST * shards steps; they end
    when no phrase can be open. No phrase is lost: one that is frequent has frequent parts,
    and its parts are known to be so in the end.
    """
    if not 0 < shards * LONGEST < NEVER:
        raise ValueError("too many shards")
    spark = docs.sparkSession
    path = unused_path(spark, "phrase-blocks")
    _blocks(docs, shards, block_words, text_col, lang_col).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(BLOCK).parquet(path)
    known = {k: np.full(1 << SLOT_BITS, NEVER, np.uint8) for k in range(1, LONGEST)}
    tables, step, until = [], 0, shards
    while step < until:
        sent = spark.sparkContext.broadcast(known)
        counts = _counted(blocks.filter(F.col("shard") == step % shards), step, sent, shards).groupBy("lang", "phrase", "mark").agg(F.sum("n").alias("n"))
        tables.append(written(counts, "phrase-counts", compression="zstd"))
        slot = _frequent(tables[-shards:], least, shards).select(F.col("mark").bitwiseAND(PHRASE).alias("slot")).distinct().toArrow()["slot"].to_numpy()
        for k in known:
            own = slot[slot >> SLOT_BITS == k] & SLOT
            if (known[k][own] == NEVER).any():
                until = step + 1 + shards
            known[k][own] = np.minimum(known[k][own], step + 1)
        sent.unpersist()
        step += 1
    length = F.shiftright("mark", SLOT_BITS).bitwiseAND(7)
    totals = reduce(DataFrame.unionByName, tables[:shards]).filter(length == 1).groupBy("lang").agg(F.sum("n").alias("n"))
    return _frequent(tables, least, shards).select("lang", "phrase", length.cast("int").alias("k"), "n"), written(totals, "phrase-totals")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, scale: int = 2_000_000, share: tuple[int, int] = (80, 100), shards: int = SHARDS, block_words: int = BLOCK_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score, cut.

    a is how often a phrase occurs, l and r how often the two parts of its weakest cut do,
    score is scale * a / (l + r), rounded down, and cut the number of words before the
    cut (the lowest score counts, then the fewest words). n is the number of words of the
    language. Phrases that lie within a longer candidate with share (a fraction) or more of
    their occurrences are left out, whether the longer one stays or not. Rank goes by
    score, then a, both falling, then phrase. For words see phrase_counts(); without
    frequent phrases, or rows, the result is empty. Repeated rows count as often as they occur.
    """
    found, totals = phrase_counts(docs, least, shards, block_words, text_col, lang_col)
    found = written(found, "phrases")
    candidates = found.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a")).withColumn("_w", F.split("phrase", " "))
    part = lambda first, n: F.array_join(F.slice("_w", first, n), " ")
    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: part(i, n)))))
    covers = candidates.filter("k > 2").select("lang", inside.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    number = lambda c: F.col(c).cast("decimal(38,0)")
    kept = candidates.join(covers, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (share[1] * number("longer") < share[0] * number("a")))
    cuts = kept.select("lang", "phrase", "k", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("cut"), part(F.lit(1), i).alias("left"), part(i + 1, F.col("k") - i).alias("right")))).alias("c")).select("lang", "phrase", "a", "c.*")
    of = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    scored = scored.withColumn("score", F.expr(f"(cast({scale} as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.*")
    first = placed(best, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "phrase-ranks").filter(F.col("place") < top)
    out = first.withColumn("rank", F.col("place") + 1).join(small_side(totals), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("long").alias("cut"))
