"""N-gram Jaccard self-join: documents whose shingle sets overlap, linked into components.

Candidates must share a prefix token under several different global token orders; the
filters are intersected before any two sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from eventloom.llm.common import dropped, input_bytes, lean, small_batches, small_side, whole_text, written
from eventloom.llm.components import components

#: Query parameters: words in a shingle, least Jaccard similarity in percent.
SHINGLE_WORDS = 4
PERCENT = 85
#: Bounds on memory, not on results: tokens that are counted at once, fingerprints that a task merges at once, frequent tokens known to every task.
CHUNK_TOKENS = 2_000_000
MERGED_PRINTS = 4_000_000
FREQUENT_TOKENS = 1_000_000
#: Bytes of input for each range of fingerprints, and the most ranges, so that a chunk's part of a range is worth a row.
RANGE_BYTES = 4_000_000
MOST_RANGES = 1 << 16
#: Bytes of a token by which it is counted.
PRINT_BYTES = 5
#: Documents that a token's count must reach before it moves to the end of the orders.
FREQUENT_FROM = 8
#: Documents from which on a token's bucket isn't gathered in one task.
HOT_FROM = 64
#: Buckets up to this size are compared throughout at once; larger ones first with one member only.
SMALL_BUCKET = 8
#: Rounds in which large buckets are tried with one member only, as long as that finds links and they hold more open pairs a row than this.
STAR_ROUNDS, OPEN_PAIRS = 4, 4
#: Open rows of a token up to which all its pairs may be tried in the end; beyond, pairs must share a token of the second order at once.
WIDE_BUCKET = 1000
BATCH_ROWS = 1000


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit permutation of hashes, another one for each salt."""
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles.

    Words are runs without ASCII white space, A-Z in lower case. A text with fewer words
    than a shingle has the whole sequence as its one shingle; without words, none.
    """
    import xxhash

    texts = pa.array(texts.to_numpy(zero_copy_only=False), pa.string()) if texts.offset else texts  # some kernels forget the offset of a slice
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, of = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    real = pc.binary_length(words).to_numpy() > 0
    coded = words.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in coded.dictionary), np.uint64, len(coded.dictionary))
    words, of = hashes[coded.indices.to_numpy()[real]] if len(hashes) else np.zeros(0, np.uint64), of[real]
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    rolled = words[: len(words) - size + 1] if len(words) >= size else words[:0]
    for k in range(1, size):
        rolled = _mixed(rolled, k) + words[k : len(words) - size + 1 + k]
    rolled = _mixed(rolled, size)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
            continue
        short = np.full(min(b - a, 1), b - a, np.uint64)
        for w in words[a:b]:
            short = _mixed(short + w, 1000)
        out.append(short)
    return out


def _signature(tokens: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded length and text."""
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(k, BATCH_ROWS)
            if part.nbytes < 16_000_000:
                yield part
            else:
                yield from (part.slice(i, 1) for i in range(part.num_rows))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _packed(sorted_prints: np.ndarray) -> bytes:
    """Sorted fingerprints of one range as differences, byte by byte of all: most bytes are zero and pack well."""
    steps = np.diff(sorted_prints, prepend=sorted_prints[:1]).astype("<u8")
    return sorted_prints[:1].astype("<u8").tobytes() + steps.view(np.uint8).reshape(-1, 8).T[:PRINT_BYTES].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, -1, 8).reshape(PRINT_BYTES, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :PRINT_BYTES] = planes.T
    return np.cumsum(steps.view("<u8").ravel()).astype(np.uint64) + np.frombuffer(data, "<u8", 1)


def fingerprints(tokens: np.ndarray) -> np.ndarray:
    """The leading bits of tokens, by which they are counted: two tokens with the same ones share a count, and so a place in the orders."""
    return tokens >> np.uint64(64 - 8 * PRINT_BYTES)


SEEN = "key int, doc_id long, n long, sig binary, single binary, many array<long>, times array<long>"


def _signatures(ranges: int, size: int):
    """Per document its id, set size and signature; per chunk of documents and range of fingerprints the ones found once, and those found more often with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SEEN.split(", ")]
        numbers = pa.list_(pa.int64())
        held, seen, n_held = [], set(), 0

        def counted() -> pa.RecordBatch:
            prints, times = np.unique(fingerprints(np.concatenate(held)), return_counts=True)
            cuts = np.searchsorted(prints, np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 8 * PRINT_BYTES) // ranges))
            parts = [(p, t) for p, t in zip(np.split(prints, cuts), np.split(times, cuts))]
            keep = [k for k, (p, _) in enumerate(parts) if len(p)]
            none = pa.nulls(len(keep))
            single = [_packed(parts[k][0][parts[k][1] == 1]) if (parts[k][1] == 1).any() else None for k in keep]
            many = [parts[k][0][parts[k][1] > 1].astype(np.int64) for k in keep]
            often = [parts[k][1][parts[k][1] > 1] for k in keep]
            return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(single, pa.binary()), pa.array(many, numbers), pa.array(often, numbers)], names=names)

        for part in _parts(batches):
            sets = shingle_sets(part.column("text"), size)
            sigs = [_signature(s) for s in sets]
            none = pa.nulls(len(sets))
            keys = pa.array(np.arange(len(sets)) % ranges, pa.int32())  # anywhere, copies too
            yield pa.RecordBatch.from_arrays([keys, part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), none.cast(pa.binary()), none.cast(numbers), none.cast(numbers)], names=names)
            for s, g in zip(sets, sigs):
                if g not in seen:  # copies count once
                    seen.add(g)
                    held.append(s)
                    n_held += len(s)
            if n_held >= CHUNK_TOKENS:
                yield counted()
                held, seen, n_held = [], set(), 0
        if n_held:
            yield counted()

    return run


def _summed(prints: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints, sorted, with the sums of their counts."""
    found, place = np.unique(np.concatenate(prints), return_inverse=True)
    return found, np.bincount(place, np.concatenate(times), len(found)).astype(np.int64)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range: documents as they are, and the fingerprints of each range that are frequent, with their counts.

    Chunks are summed as they come, so a task holds a range's distinct fingerprints and
    MERGED_PRINTS more at most.
    """
    key, prints, times, waiting = None, [], [], 0

    def frequent() -> pa.RecordBatch:
        found, counts = _summed(prints, times)
        found, counts = found[counts >= FREQUENT_FROM], counts[counts >= FREQUENT_FROM]
        none = pa.nulls(len(found))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), _signed(found), pa.array(counts)], names=["doc_id", "n", "sig", "print", "count"])

    for batch in batches:
        docs = batch.filter(pc.is_valid(batch.column("sig")))
        none = pa.nulls(docs.num_rows).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([docs.column("doc_id"), docs.column("n"), docs.column("sig"), none, none], names=["doc_id", "n", "sig", "print", "count"])
        rest = batch.filter(pc.is_null(batch.column("sig")))
        for k, single, many, often in zip(*(rest.column(c).to_pylist() for c in ("key", "single", "many", "times"))):
            if k != key and prints:
                yield frequent()
                prints, times, waiting = [], [], 0
            key = k
            once = _unpacked(single) if single else np.zeros(0, np.uint64)
            prints += [once, np.array(many, np.int64).view(np.uint64)]
            times += [np.ones(len(once), np.int64), np.array(often, np.int64)]
            waiting += len(once) + len(many)
            if waiting > MERGED_PRINTS:
                found, counts = _summed(prints, times)
                prints, times, waiting = [found], [counts], 0
    if prints:
        yield frequent()


def frequent_tokens(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that most sets share, sorted, with their counts: at most FREQUENT_TOKENS, by a least count.

    Which ones are in the list changes the orders, and so the speed, but no result.
    """
    level = F.floor(8 * F.log2("count"))
    known, least = 0, None
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred levels
        known += row["count"]
        if known > FREQUENT_TOKENS:
            break
        least = row["level"]
    found = counts.filter(level >= (least if least is not None else 10**6)).toArrow()
    prints = np.asarray(found["print"].to_numpy()).astype(np.int64).view(np.uint64)
    order = np.argsort(prints)
    return prints[order], np.asarray(found["count"].to_numpy()).astype(np.int64)[order]


def _orders(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[list[np.ndarray], int]:
    """The prefix of a set under three global token orders: rare before frequent, and then by another permutation each.

    With the number of tokens of the first prefix that come before hot ones.
    """
    n = len(tokens)
    rank = np.zeros(n, np.uint64)
    if len(frequent[0]):
        prints = fingerprints(tokens)
        at = np.minimum(np.searchsorted(frequent[0], prints), len(frequent[0]) - 1)
        hit = frequent[0][at] == prints
        rank[hit] = (8 * np.log2(frequent[1][at[hit]])).astype(np.uint64)
    size = n - (percent * n + 99) // 100 + 1 if n else 0
    hot = np.uint64(8 * np.log2(HOT_FROM))
    out = []
    for salt in (11, 12, 13):
        key = (rank << np.uint64(55)) | (_mixed(tokens, salt) >> np.uint64(9))
        out.append(tokens[np.argsort(key)[:size]])
    return out, min(size, int((rank < hot).sum()))


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int, make, schema: str) -> DataFrame:
    """make(node, tokens) -> columns, for the documents that stand for the wanted classes (node, first_id, sig)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.join(small_side(wanted.select("node", "first_id", "sig")), F.col("doc_id") == F.col("first_id")).select("node", "sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sets, sigs, nodes = shingle_sets(part.column("text"), size), part.column("sig").to_pylist(), part.column("node").to_numpy()
            own = [(n, s) for n, s, g in zip(nodes, sets, sigs) if _signature(s) == g]  # an id may have other texts too
            if own:
                yield make(np.array([n for n, _ in own]), [s for _, s in own])

    return rows.mapInArrow(lean(run), schema)


def _near_enough(na, nb, pa_, pb_, percent: int):
    """Size and position filters: the first token that two similar sets share leaves room for all they must share."""
    need = -(-percent * (na + nb) // (100 + percent))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - pa_, nb - pb_) >= need)


def _near_rows(x: str, y: str, percent: int) -> Column:
    """The same for the columns n and pos of two tables by their aliases."""
    c = lambda side, name: F.col(f"{side}.{name}")
    sizes = 100 * F.least(c(x, "n"), c(y, "n")) >= percent * F.greatest(c(x, "n"), c(y, "n"))
    left = F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos"))
    return sizes & (left * (100 + percent) >= percent * (c(x, "n") + c(y, "n")))


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Rows sorted by their first column, as arrays with the starts and lengths of its groups, none of them cut."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in columns]
        rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows)]
        if not len(rows[0]):
            continue
        cut = np.searchsorted(rows[0], rows[0][-1])
        rest = [x[cut:] for x in rows]
        if cut:
            yield _starts([x[:cut] for x in rows])
    if rest is not None:
        yield _starts(rest)


def _starts(rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
    return rows, starts, np.diff(np.r_[starts, len(rows[0])])


def _pair_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _first_pairs(percent: int):
    """Within each token's bucket: all pairs if it is small, else each member with the one in the middle; large buckets are passed on.

    The middle of near copies has few rare tokens of its own, so a token that they share
    comes earlier in its order than in theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "a", "b", "n", "pos"]
        for (token, node, n, pos), starts, lengths in _groups(batches, ["token", "node", "n", "pos"]):
            found = []
            for size in range(2, SMALL_BUCKET + 1):
                at = starts[lengths == size]
                for i in range(size):
                    for j in range(i + 1, size):
                        x, y = at + i, at + j
                        ok = _near_enough(n[x], n[y], pos[x], pos[y], percent)
                        found.append((node[x[ok]], node[y[ok]]))
            big = lengths > SMALL_BUCKET
            if big.any():
                rows = np.concatenate([np.arange(s, s + k) for s, k in zip(starts[big], lengths[big])])
                least = np.repeat([s + int(np.lexsort((node[s : s + k], pos[s : s + k]))[0]) for s, k in zip(starts[big], lengths[big])], lengths[big])
                ok = _near_enough(n[rows], n[least], pos[rows], pos[least], percent) & (rows != least)
                found.append((node[rows[ok]], node[least[ok]]))
                none = pa.nulls(len(rows)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(token[rows]), pa.array(node[rows]), none, pa.array(n[rows]), pa.array(pos[rows])], names=names)
            a, b = _pair_batch(found)
            none = pa.nulls(len(a))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), pa.array(a), pa.array(b), none.cast(pa.int64()), none.cast(pa.int32())], names=names)

    return run


def _as_pairs(x: str, y: str) -> list[Column]:
    a, b = F.col(f"{x}.node"), F.col(f"{y}.node")
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _with_centre(rows: DataFrame, order: Column, percent: int) -> DataFrame:
    """The pairs of each token's rows with the one that comes first in the order: one minimum and one join a token."""
    centre = rows.groupBy("token").agg(F.min(F.struct(order.alias("o"), "node", "n", "pos")).alias("c")).select("token", "c.node", "c.n", "c.pos")
    met = rows.alias("x").join(centre.alias("c"), (F.col("x.token") == F.col("c.token")) & (F.col("x.node") != F.col("c.node")) & _near_rows("x", "c", percent))
    return met.select(*_as_pairs("x", "c")).distinct()


def _next_pairs(now: DataFrame, turn: int, last: bool, percent: int, second: DataFrame | None = None) -> DataFrame:
    """Pairs of rows of a token (token, node, n, pos, component) from different components.

    main is a token's component with the most rows, guests are the rows of its others.
    Unless it is the last turn, guests meet one member of main only. Then they meet every
    row of the token or, if it has more than WIDE_BUCKET of them, those with which they
    also share a token of the second order's prefix (second: node, token2) and whose set
    is of like size: both are part of the key then, so no pair is made of a frequent token
    alone. All are joins on keys, whose large partitions adaptive execution splits.
    """
    sizes = now.groupBy("token", "component").count()
    main = sizes.groupBy("token").agg(F.max(F.struct("count", "component")).alias("m"), F.count("*").alias("k"), F.sum("count").alias("rows")).filter("k > 1").select("token", F.col("m.component").alias("main"), "rows")
    marked = now.join(main, "token")
    guests = marked.filter("component <> main").alias("x")
    if last:
        def tried(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
            x, y = x.filter("component <> main").alias("x"), y.alias("y")
            met = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))) & _near_rows("x", "y", percent)
            for key in keys:
                met &= F.col(f"x.{key}") == F.col(f"y.{key}")
            return x.join(y, met).select(*_as_pairs("x", "y"))

        narrow = marked if second is None else marked.filter(F.col("rows") <= WIDE_BUCKET)
        found = tried(narrow, narrow, ["token"])
        if second is not None:
            # sizes whose ratio is percent or more are in the same step or in neighbours
            width = max(-1.000001 * log(percent / 100), 1e-6)
            wide = marked.filter(F.col("rows") > WIDE_BUCKET).join(second, "node").withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)))
            around = wide.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
            found = found.unionByName(tried(wide, around, ["token", "token2", "step"]))
        return found.distinct()
    first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "n", "pos")).alias("c")
    centre = marked.filter("component = main").groupBy("token").agg(first).select("token", "c.node", "c.n", "c.pos").alias("y")
    met = guests.join(centre, (F.col("x.token") == F.col("y.token")) & _near_rows("x", "y", percent))
    return met.select(*_as_pairs("x", "y")).distinct()


def _shares_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose prefixes also meet under the second and the third order."""
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for order in ("second", "third"):
            sides = []
            for end in ("a", "b"):
                column = batch.column(f"{end}_{order}")
                row = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), pc.binary_length(column).to_numpy() // 4)
                sides.append(np.frombuffer(b"".join(column.to_pylist()), np.uint32).astype(np.uint64) | row << np.uint64(32))
            met = np.intersect1d(*sides) >> np.uint64(32)
            keep &= np.bincount(met.astype(np.int64), minlength=batch.num_rows) > 0
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _similar(percent: int):
    """The pairs whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_both(pairs: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """pairs (a, b) with the columns of values (by node) of either end, as a_<name> and b_<name>."""
    for end in ("b", "a"):
        pairs = pairs.join(values.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in names]), end)
    return pairs


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (long).

    Two documents link when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id reachable by links. Texts without words have no
    shingles and link with nothing; null texts count as empty. Rows without an id get no
    component. Each row is judged by its own text: rows that share an id but no text are
    not linked by it, repeated rows are copies of each other, as many as there may be. An
    empty table gives an empty result; other columns are not read.

    1. Equal sets become one class by signature; only one document of a class goes on.
    2. Each class gives the prefix of its set under a first token order, rare tokens
       first. Similar sets share a prefix token, so they meet in a token's bucket; size
       and position filters follow. Small buckets give all their pairs, large ones each
       member with the one in the middle; the rows of hot tokens are joined with it
       instead of being gathered.
    3. Pairs must also share prefix tokens under two more orders; what is left is
       compared as whole sets, and links become components.
    4. In large buckets a member of the largest component is tried with all members of
       other components, again and again, until few pairs are open; those are all tried,
       in wide buckets those that share prefix tokens under the first and the second
       order at once. Then every pair that shares prefix tokens is linked, compared or
       connected.
    """
    return _row_components(docs, id_col, text_col, percent, size).drop("sig")


def _row_components(docs: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    """jaccard_components() with the signature of each row's set."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, input_bytes(rows) // RANGE_BYTES))
    ranges = 1 << max(8, ranges.bit_length())
    both = rows.mapInArrow(lean(_signatures(ranges, size)), SEEN).repartition("key").sortWithinPartitions("key")
    both = written(both.mapInArrow(lean(_merged), "doc_id long, n long, sig binary, print long, count long"), "join-signatures")
    sets = both.filter("sig is not null").select("doc_id", "n", "sig")
    by_id = sets.filter("n > 0").groupBy("sig", "doc_id").agg(F.count("*").alias("times"), F.first("n").alias("n"))  # spreads the rows of a large class
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "times"))).alias("f")
    classes = by_id.groupBy("sig").agg(first, F.first("n").alias("n")).select("sig", F.col("f.doc_id").alias("first_id"), F.col("f.times").alias("times"), "n")
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "join-classes")
    frequent = spark.sparkContext.broadcast(frequent_tokens(both.filter("print is not null").select("print", "count")))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            tokens = shingle_sets(part.column("text"), size)
            found = [_orders(t, frequent.value, percent) for t in tokens]
            orders = [o for o, _ in found]
            short = lambda k: pa.array([(o[k] >> np.uint64(32)).astype(np.uint32).tobytes() for o in orders], pa.binary())
            first = pa.ListArray.from_arrays(np.cumsum([0, *[len(o[0]) for o in orders]]).astype(np.int32), _signed(np.concatenate([o[0] for o in orders])))
            sigs = pa.array([_signature(t) for t in tokens], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sigs, pa.array([len(t) for t in tokens], pa.int64()), first, pa.array([k for _, k in found], pa.int32()), short(1), short(2)], names=["doc_id", "sig", "n", "first", "cold", "second", "third"])

    # joined afterwards: prefixes are a fraction of the texts, in case the classes are too many to broadcast
    prefixed = rows.mapInArrow(lean(prefixes), "doc_id long, sig binary, n long, first array<long>, cold int, second binary, third binary").filter("n > 0")
    own = classes.select("node", F.col("first_id").alias("doc_id"), "sig", (F.col("times") > 1).alias("again"))
    prefixed = written(prefixed.join(small_side(own), ["doc_id", "sig"]).drop("doc_id", "sig"), "join-prefixes")
    twice = prefixed.filter("again").dropDuplicates(["node"])  # a repeated row stands in the classes once
    if not twice.isEmpty():
        prefixed = written(prefixed.filter("not again").unionByName(twice), "join-prefixes")
    exploded = prefixed.select("node", "n", "cold", F.posexplode("first").alias("pos", "token"))
    buckets = exploded.filter("pos < cold").select("node", "n", "pos", "token").repartition("token").sortWithinPartitions("token", "node")
    met = written(buckets.mapInArrow(lean(_first_pairs(percent)), "token long, a long, b long, n long, pos int"), "join-met")

    def linked(pairs: DataFrame, tag: str) -> DataFrame:
        """Of candidate pairs, those that pass the other orders' filters and then the comparison."""
        left = written(_with_both(pairs, prefixed, ["second", "third"]).mapInArrow(lean(_shares_prefixes), "a long, b long"), f"{tag}-filtered")
        ends = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
        wanted = written(classes.join(ends, "node", "left_semi"), f"{tag}-wanted")
        to_sets = lambda nodes, tokens: pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([t.tobytes() for t in tokens], pa.binary())], names=["node", "set"])
        whole = written(_sets_of(docs, wanted, id_col, text_col, size, to_sets, "node long, set binary").dropDuplicates(["node"]), f"{tag}-sets")
        links = written(_with_both(left, whole, ["set"]).mapInArrow(lean(_similar(percent)), "a long, b long"), f"{tag}-links")
        dropped(left, wanted, whole)
        return links

    hot = exploded.filter("pos >= cold").select("token", "node", "n", "pos")
    open_rows = written(hot.unionByName(met.filter("b is null").select("token", F.col("a").alias("node"), "n", "pos")), "join-open")
    by_hot = _with_centre(hot, F.col("pos"), percent)
    pairs = written(met.filter("b is not null").select("a", "b").unionByName(by_hot).distinct(), "join-pairs")
    links = linked(pairs, "join-first")
    connected = written(components(links), "join-connected")
    found_any = True
    second = prefixed.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.octet_length("second"), F.lit(4)), lambda i: F.substring("second", i, F.lit(4)))).alias("token2"))
    for turn in range(STAR_ROUNDS + 1):
        now = written(open_rows.join(connected, "node", "left").withColumn("component", F.coalesce("component", "node")), "join-now")
        kept = now.groupBy("token", "component").count().groupBy("token").agg(F.sum("count").alias("all"), F.sum(F.col("count") * F.col("count")).alias("within"))
        rows_left, pairs_left, widest = kept.filter("all * all > within").agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("within")) / 2), F.lit(0.0)), F.max("all")).first()
        if not rows_left:
            break
        last = pairs_left <= OPEN_PAIRS * rows_left or turn == STAR_ROUNDS or not found_any
        more = written(_next_pairs(now, turn, last, percent, second if widest > WIDE_BUCKET else None).join(pairs, ["a", "b"], "left_anti"), "join-more")
        again = linked(more, "join-again")
        found_any = not again.isEmpty()
        pairs = pairs.unionByName(more)
        if found_any:
            links = links.unionByName(again)
            connected = written(components(links), "join-connected")
        dropped(now)
        if last:
            break

    of_node = classes.join(connected, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_node = written(of_node.select("sig", "first_id", "component"), "join-nodes")
    least = of_node.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_sig = small_side(written(of_node.join(least, "component").select("sig", "component_id"), "join-components"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sets.join(of_sig, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "sig")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, and those without an id, with all their columns.

    Where an id has several texts, each of its rows is judged by its own.
    """
    out = written(_row_components(docs, id_col, text_col, percent, size), "join-rows")
    lost = out.filter("doc_id <> component_id").select(F.col("doc_id").alias("_lost"), F.col("sig").alias("_sig")).distinct()
    ids = written(lost.select("_lost").distinct(), "join-lost")
    some_stay = written(out.filter("doc_id = component_id").join(ids, F.col("doc_id") == F.col("_lost"), "left_semi").select("doc_id").distinct(), "join-both")
    own = F.col(id_col).cast("long")
    kept = docs.join(small_side(ids), own == F.col("_lost"), "left_anti")
    if some_stay.isEmpty():
        return kept
    rows = docs.join(small_side(some_stay.select(F.col("doc_id").alias("_both"))), own == F.col("_both"), "left_semi")
    return kept.unionByName(_signed_rows(rows, text_col, size).join(lost, (own == F.col("_lost")) & (F.col("_signature") == F.col("_sig")), "left_anti").select(*docs.columns))


def _signed_rows(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """docs with the signature of each row's set as _signature."""
    rows = docs.withColumn("_whole", whole_text(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sigs = pa.array([_signature(s) for s in shingle_sets(part.column("_whole"), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], sigs], names=[*part.schema.names[:-1], "_signature"])

    return rows.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField("_signature", BinaryType())]))
