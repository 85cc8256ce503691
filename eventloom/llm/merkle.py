"""A Merkle manifest of a table: a tree of digests for each language, and one over their roots.

Only every STEP-th level of a tree is kept. Proofs make the levels between anew, one
aligned subtree at a time, and drop them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import lean, placed, small_side, written

#: Levels from one kept level to the next: a subtree has at most 2 ** STEP nodes at its foot.
STEP = 6
#: Subtrees whose proofs are handed over together.
TOGETHER = 32
#: What a leaf's digest covers.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: dict[str, Column] | None = None) -> Column:
    """The digest of a row's fields, each as its length in bytes and its value, or - if null; columns puts others in a field's place."""
    values = [(columns or {}).get(name, F.col(name)).cast("string") for name in FIELDS]
    return F.sha2(F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]), 256)


def levels_over(digests: list[str], levels: int) -> list[list[str]]:
    """The given nodes and so many levels over them: two neighbours, or a last one alone, make a node."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return out


def siblings_of(tree: list[list[str]], place: int) -> list[str]:
    """The other node of the run on each level from a place up, an empty text where there is none; the top has no level over it."""
    at = [(place >> k) ^ 1 for k in range(len(tree) - 1)]
    return [nodes[i] if i < len(nodes) else "" for nodes, i in zip(tree, at)]


@dataclass
class Forest:
    """Trees of digests, each of a group: kept[j] has the nodes of level j * STEP as (grp, place, digest, up, ...).

    up is the number of levels from there to the group's root; a group's last row has 0.
    """

    kept: list[DataFrame]

    def roots(self) -> DataFrame:
        """grp and root of each tree."""
        tops = [level.filter("up = 0").select("grp", F.col("digest").alias("root")) for level in self.kept]
        out = tops[0]
        for top in tops[1:]:
            out = out.unionByName(top)
        return out


def _subtrees(level: DataFrame, columns: list[str]) -> DataFrame:
    """A kept level by aligned subtree: grp, block, up, and its nodes in order. A group's root is a subtree of its own."""
    node = F.struct(*[F.col(c) for c in columns])
    return level.groupBy("grp", F.shiftright("place", STEP).alias("block"), "up").agg(F.array_sort(F.collect_list(node)).alias("nodes"))


def _parents(level: DataFrame) -> DataFrame:
    """The next kept level: the top of each aligned subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ups = batch.column("up").to_pylist()
            tops = [levels_over([n["digest"] for n in nodes], min(STEP, up))[-1][0] for up, nodes in zip(ups, batch.column("nodes").to_pylist())]
            left = pa.array([max(up - STEP, 0) for up in ups], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), pa.array(tops, pa.string()), left], names=["grp", "place", "digest", "up"])

    return _subtrees(level.filter("up > 0"), ["place", "digest"]).mapInArrow(lean(run), "grp string, place long, digest string, up int")


def _forest(leaves: DataFrame, levels: int) -> Forest:
    """Trees over leaves (grp, place, digest, up): every STEP-th level is written. levels is the highest tree's."""
    kept = [leaves]
    while levels > 0:
        kept.append(written(_parents(kept[-1]), "merkle-level"))
        levels -= STEP
    return Forest(kept)


def _height(n: Column) -> Column:
    """Levels over n leaves: how often n is halved, rounded up, until one is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def _placed(rows: DataFrame) -> DataFrame:
    """Number the rows of each group from 0 by doc_id (nulls first), then digest; up is the height of its tree. Equal rows have equal digests, and are dealt out by a number of their own."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("_tie")]
    out = placed(rows.withColumn("_tie", F.monotonically_increasing_id()), "grp", order, "merkle-ranges")
    return out.withColumn("up", _height(F.col("group_rows"))).drop("_tie", "group_rows")


@dataclass
class Manifest:
    """leaves: grp, place, digest, up, doc_id and what was carried. trees: of the groups. top: over their roots. root: of it, null without rows."""

    trees: Forest
    top: Forest
    root: str | None

    @property
    def leaves(self) -> DataFrame:
        return self.trees.kept[0]

    def subroots(self) -> DataFrame:
        """grp, lang, subroot, place (of the group in the tree over all)."""
        named = self.top.kept[0].select(F.col("doc_id").alias("grp"), F.col("digest").alias("subroot"), "place")
        return named.select("grp", F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias("lang"), "subroot", "place")


def build(docs: DataFrame, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table with doc_id, source, lang, n_chars, text: digests, no texts.

    Groups are languages, null first, then by UTF-8 bytes; leaves ascend by doc_id, null ids
    first, equal ids by digest, equal rows are leaves each. Two neighbours of a level make a
    node, a last one alone makes one too, until one node is left; a lone leaf is its tree's
    root. The roots make another tree alike, whose root is the manifest's. Any field may be
    null; columns besides the five are ignored, but for carry: columns to keep beside the
    leaves by name. Without rows there is no root.

    Texts are hashed where they are read; what is shuffled are ids and digests. Each kept
    level is a table in the shared folder and a 2 ** STEP-th of the one below.
    """
    named = {name: F.col(name) for name in FIELDS}
    group = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    rows = docs.select(group.alias("grp"), named["doc_id"].cast("long").alias("doc_id"), leaf_digest().alias("digest"), *[c.alias(name) for name, c in (carry or {}).items()])
    leaves = written(_placed(written(rows, "merkle-rows")), "merkle-leaves")
    trees = _forest(leaves, leaves.agg(F.max("up")).first()[0] or 0)
    roots = trees.roots().select(F.lit("").alias("grp"), F.col("grp").alias("doc_id"), F.col("root").alias("digest"))
    groups = written(_placed(written(roots, "merkle-roots")), "merkle-groups")
    top = _forest(groups, groups.agg(F.max("up")).first()[0] or 0)
    found = top.roots().first()
    return Manifest(trees, top, found["root"] if found else None)


def _proofs(forest: Forest, payload: list[str], asked: Column | None = None) -> DataFrame:
    """grp, the payload columns, place and siblings (from the foot up) of a forest's asked leaves, by default all of them.

    From the highest kept level down: each aligned subtree's missing nodes are made from
    its foot, its asked nodes get their siblings there and then those of the subtree's top.
    """
    above = forest.kept[-1].filter("up = 0").select("grp", "place", F.array().cast("array<string>").alias("siblings"))
    wanted = None if asked is None else forest.kept[0].filter(asked).select("grp", "place")
    for j in range(len(forest.kept) - 1, -1, -1):
        level = forest.kept[j]
        foot = j == 0
        inner = level.filter("up > 0")
        nodes = _subtrees(inner, ["place", "digest", *(payload if foot else [])])
        if wanted is not None:  # subtrees that hold an asked leaf
            blocks = wanted.select("grp", F.shiftright("place", (j + 1) * STEP).alias("block")).distinct()
            nodes = nodes.join(blocks, ["grp", "block"], "left_semi")
        lone = level.filter("up = 0").select("grp", *(payload if foot else []), "place", F.array().cast("array<string>").alias("siblings"))
        if j + 1 < len(forest.kept):
            tops = above.select("grp", F.col("place").alias("block"), F.col("siblings").alias("above"))
            made = _extended(nodes.join(tops, ["grp", "block"]), payload if foot else [])
            above = made.unionByName(lone)
        else:
            above = lone
        if not foot and j + 1 < len(forest.kept):
            above = written(above, "merkle-proofs")
    return above if wanted is None else above.join(wanted, ["grp", "place"], "left_semi")


def _extended(subtrees: DataFrame, payload: list[str]) -> DataFrame:
    """The siblings of each node of each subtree's foot: those inside the subtree, then those above it."""
    kinds = {f.name: f.dataType for f in subtrees.schema["nodes"].dataType.elementType.fields}
    kept = "".join(f"`{c}` {kinds[c].simpleString()}, " for c in payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                lists = part.column("nodes")
                sizes = lists.value_lengths().to_pylist()
                flat = lists.flatten()
                grp = part.column("grp").take(pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int64()))
                places, digests = flat.field("place").to_pylist(), flat.field("digest").to_pylist()
                found, at = [], 0
                for n, up, above in zip(sizes, part.column("up").to_pylist(), part.column("above").to_pylist()):
                    tree = levels_over(digests[at : at + n], min(STEP, up))
                    first = places[at]
                    found += [siblings_of(tree, p - first) + above for p in places[at : at + n]]
                    at += n
                own = [flat.field(c) for c in payload]
                yield pa.RecordBatch.from_arrays([grp, *own, flat.field("place"), pa.array(found, pa.list_(pa.string()))], names=["grp", *payload, "place", "siblings"])

    return subtrees.select("grp", "nodes", "up", "above").mapInArrow(lean(run), f"grp string, {kept}place long, siblings array<string>")


def proofs(manifest: Manifest, carry: list[str] | None = None, asked: Column | None = None) -> DataFrame:
    """Each asked leaf's proof: doc_id, leaf, subroot, what was carried, siblings and sides.

    asked is a condition on the leaves' columns (all leaves by default); only the subtrees
    that hold such a leaf are made anew. siblings has an entry for each level from the leaf
    to the manifest's root, an empty text where a node is alone in its run; sides says
    whether the sibling stands on the left.
    """
    payload = ["doc_id", "leaf", *(carry or [])]
    named = lambda forest: Forest([forest.kept[0].withColumn("leaf", F.col("digest")), *forest.kept[1:]])
    own = _proofs(named(manifest.trees), payload, asked)
    tops = _proofs(named(manifest.top), ["doc_id", "leaf"]).select(F.col("doc_id").alias("grp"), F.col("leaf").alias("subroot"), F.col("place").alias("_rank"), F.col("siblings").alias("_above"))
    out = own.join(small_side(written(tops, "merkle-tops")), "grp")
    bits = lambda place, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.getbit(place, k) == 1)).otherwise(F.array().cast("array<boolean>"))
    sides = F.concat(bits(F.col("place"), F.size("siblings")), bits(F.col("_rank"), F.size("_above")))
    return out.select("doc_id", "leaf", "subroot", *(carry or []), F.concat("siblings", "_above").alias("siblings"), sides.alias("sides"))


def folded(leaf: Column, siblings: Column, sides: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    steps = F.arrays_zip(siblings.alias("s"), sides.alias("left"))
    return F.aggregate(steps, leaf, lambda d, x: F.sha2(F.when(x["left"], F.concat(x["s"], d)).otherwise(F.concat(d, x["s"])), 256))


def checked(docs: DataFrame) -> DataFrame:
    """All rows' proofs, folded from rows of which one in seven was tampered with: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings.

    Where 7 divides the CRC-32 of the decimal doc_id, n_chars is one more than in the
    manifest; rows without an id or n_chars stay as they are.
    """
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    other = F.when(changed, leaf_digest({"n_chars": F.col("n_chars") + 1}))
    manifest = build(docs, {"tampered": other})
    root = F.lit(manifest.root).cast("string")
    out = proofs(manifest, ["tampered"]).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("siblings"), F.col("sides")))
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"), F.size(F.array_remove("siblings", "")).cast("long").alias("n_siblings"))
