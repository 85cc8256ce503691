"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import small_side, whole_text, without_spaces, written

#: Characters of the normalised text that the prefix hash covers.
PREFIX_CHARS = 128


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("n_chars"), without_spaces(text).alias("norm")).select(
        "doc_id", "n_chars", "norm", F.length("norm").alias("norm_len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """Group texts that are equal once white space is deleted; say which row of each group stays.

    Rows are grouped by normalised length, the groups with company by a hash of their
    prefix, and only what still has company by SHA-256 of the whole normalised text.
    The first two steps move two numbers a row; the full hash is made on a second scan
    that leaves out rows already known to be alone (unless digest_all asks for every
    row's digest). No text is shuffled: the decision per group is a partial aggregate
    with max/min, so a group of copies of any size costs one row a task.

    Returns one row per input row: doc_id, keep_id, group_size (long), kept,
    text_sha256 (null for rows that were alone, unless digest_all). The row with the
    most characters stays, then the smallest doc_id; null ids come last. Null texts
    count as empty, all empty texts are one group, and of repeated rows (same id and
    text) exactly one is kept. An empty table gives an empty result; other columns of
    docs are not read, whatever their names.
    """
    seen = _sketched(docs, id_col, text_col)
    keys = written(seen.select("norm_len", "prefix"), "dedup-keys")
    lengths = written(keys.groupBy("norm_len").count().filter("count > 1").select("norm_len"), "dedup-lengths")  # as many as lengths occur
    suspects = keys.join(small_side(lengths), "norm_len", "left_semi").groupBy("norm_len", "prefix").count().filter("count > 1").select("norm_len", "prefix", F.lit(True).alias("suspect"))
    suspects = small_side(written(suspects, "dedup-suspects"))
    full = F.sha2(F.col("norm").cast("binary"), 256)
    if digest_all:  # the digest is made below the join, so that the join sees no text
        seen = seen.select("doc_id", "n_chars", "norm_len", "prefix", full.alias("text_sha256"))
        rows = seen.join(suspects, ["norm_len", "prefix"], "left")
    else:
        rows = seen.join(suspects, ["norm_len", "prefix"], "left").withColumn("text_sha256", F.when(F.col("suspect"), full))
    rows = written(rows.select("doc_id", "n_chars", "text_sha256", F.coalesce("suspect", F.lit(False)).alias("suspect"), F.monotonically_increasing_id().alias("row")), "dedup-rows")

    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "row")).alias("best")
    groups = rows.filter("suspect").groupBy("text_sha256").agg(F.count("*").alias("group_size"), best)
    groups = groups.select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    groups = small_side(written(groups, "dedup-groups"))
    of_groups = rows.filter("suspect").join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    alone = rows.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(of_groups)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns.

    Where an id occurs more than once, only its kept text stays, once.
    """
    decided = written(exact_dedup(docs, id_col, text_col), "dedup-decided")
    kept = written(decided.filter("kept").groupBy(F.col("doc_id").alias("_keep")).agg(F.count("*").alias("_n"), F.count("text_sha256").alias("_hashed")), "dedup-kept")
    again = decided.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again"))
    again = written(again, "dedup-again")
    once = docs.join(small_side(kept.select("_keep")), F.col(id_col).eqNullSafe(F.col("_keep")), "left_semi")
    repeated = once.join(small_side(again), F.col(id_col).eqNullSafe(F.col("_again")), "left_semi")
    single = once.join(small_side(again), F.col(id_col).eqNullSafe(F.col("_again")), "left_anti")
    return single.unionByName(_one_of_repeated(repeated, decided, id_col, text_col))


def _one_of_repeated(rows: DataFrame, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of rows whose id occurs again: one row for each (id, normalised text) that was kept."""
    norm = without_spaces(whole_text(text_col))
    rows = rows.withColumns({"_sha": F.sha2(norm.cast("binary"), 256), "_len": F.length(whole_text(text_col))})
    lost = decided.filter("not kept").select(F.col("doc_id").alias("_lost"), F.col("text_sha256").alias("_lost_sha"))
    held = decided.filter("kept").select(F.col("doc_id").alias("_held"), F.col("text_sha256").alias("_held_sha"))
    gone = lost.join(held, F.col("_lost").eqNullSafe(F.col("_held")) & (F.col("_lost_sha") == F.col("_held_sha")), "left_anti")
    rows = rows.join(gone, F.col(id_col).eqNullSafe(F.col("_lost")) & (F.col("_sha") == F.col("_lost_sha")), "left_anti")
    others = F.struct(*[c for c in rows.columns if c not in (id_col, "_sha")])
    order = F.struct("_len", F.sha2(F.to_json(others), 256))  # among equally long ones the same in each run
    first = rows.groupBy(id_col, "_sha").agg(F.max_by(others, order).alias("_row"))
    return first.select(*[F.col(c) if c == id_col else F.col(f"_row.{c}").alias(c) for c in rows.columns if c not in ("_sha", "_len")])
