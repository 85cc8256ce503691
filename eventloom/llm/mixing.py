"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import numbered, small_side, whole_text, words, written

#: Query parameters: the weights that sources take in turn, words to take over words there are, and the most epochs.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
#: Hexadecimal digits of the seeded digest that make a cell of the sampling order.
CELL_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Capped water-filling over one row per source (source, source_size, weight): adds target.

    Each round shares what the clamped sources leave by weight among the others and
    clamps those that would pass max_epochs times their size, until none does. A round
    is one aggregate over the sources; the driver sees three sums.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    budget = share * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        n, taken, weight = sizes.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == clamped or not weight:
            break
        clamped, rest, of = n, budget - taken, weight
        level = rest / of
    share_of = F.col("weight") * F.lit(budget - taken) / F.lit(float(weight)) if weight else cap
    return sizes.withColumn("target", F.when(full, cap).otherwise(share_of))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """How often each document is repeated in a mix of sources with capped target weights.

    Sources in code point order (null last) take the weights in turn and share
    `share` times all words; see source_targets() for the caps. A source whose target
    is t times its size gives floor(t) whole repetitions and, for the fraction,
    documents in the order of a seeded digest of their id until the fraction of its
    words is reached; the document at the border counts if that comes nearer.

    The order within a source is found without sorting it: words are summed in cells
    of equal digest prefixes, whole cells before the border are taken, and only the
    border cell's documents are ordered. So no source lands in one task.

    Returns one row per input row: doc_id, source, size, source_size (long), target,
    copies (long), taken = size * copies. Null texts have no words, ids may be null or
    repeat (equal rows are interchangeable), an empty table gives an empty result, and
    other columns are not read.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("-"))).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(whole_text(text_col)).alias("size"), digest.alias("digest"))
    rows = written(rows.withColumn("cell", F.substring("digest", 1, CELL_DIGITS)), "mix-rows")
    cells = written(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "mix-cells")

    sizes = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    sizes = numbered(sizes, [F.col("source").isNull(), F.col("source")], "place", "mix-sizes")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sizes = written(sizes.select("source", "source_size", turn.alias("weight")), "mix-sources")
    targets = source_targets(sizes, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = written(targets, "mix-targets")

    by_cell = Window.partitionBy("source").orderBy("cell")  # at most 16 ** CELL_DIGITS rows a source
    borders = cells.join(small_side(targets.select(F.col("source").alias("s"), "source_size", "target", "whole", "part")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    before = F.coalesce(F.sum("cell_size").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    borders = borders.withColumn("before", before).filter("part > before and part <= before + cell_size or part = 0 and before = 0")
    borders = borders.groupBy("source").agg(F.min_by(F.struct(F.col("cell").alias("border"), "before", "source_size", "target", "whole", "part"), "cell").alias("b")).select(F.col("source").alias("s"), "b.*")
    rows = rows.join(small_side(written(borders, "mix-borders")), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    in_cell = Window.partitionBy("source").orderBy("digest", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    border = rows.filter("cell = border").withColumn("upto", F.col("before") + F.sum("size").over(in_cell))
    extra = (F.col("upto") <= F.col("part")) | (F.col("upto") - F.col("part") < F.col("part") - (F.col("upto") - F.col("size")))
    border = border.withColumn("extra", extra & (F.col("part") > 0) & (F.col("upto") - F.col("size") < F.col("part"))).drop("upto")
    others = rows.filter("cell <> border").withColumn("extra", F.col("cell") < F.col("border"))
    copies = F.col("whole") + F.col("extra").cast("long")
    return others.unionByName(border).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of docs as often as mixed() takes it, with all its columns.

    Rows that share an id are each repeated as often as the one of them that is taken most;
    rows without an id share one.
    """
    n = mixed(docs, id_col, text_col, source_col, **how).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    rows = docs.join(small_side(written(n.filter("_copies > 0"), "mix-copies")), F.col(id_col).eqNullSafe(F.col("_id")))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)
