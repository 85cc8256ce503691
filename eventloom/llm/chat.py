"""Preference formatting: one shared prompt and two masked completions for each pair of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import small_side, written

#: The marks of a rendered turn, and what replaces their opening in a text.
OPEN, CLOSE, ESCAPED = "<|im_start|>", "<|im_end|>\n", "<\u200b|im_"
#: Bounds on what is put together in one row: turns, and rows of them.
PIECE_TURNS = 256
PIECE_ROWS = 4096


def rendered(role: Column, text: Column) -> Column:
    """A turn as text. Marks inside a role or text are broken up and a role stays on its line, so that neither can open a turn of its own."""
    safe = lambda c: F.regexp_replace(c, r"<\|im_", ESCAPED)
    return F.concat(F.lit(OPEN), F.translate(safe(role), "\r\n", "  "), F.lit("\n"), safe(text), F.lit(CLOSE))


def _turns(side: DataFrame) -> DataFrame:
    empty = F.lit("")
    return side.filter("pair_id is not null and turn is not null").select("pair_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Format pairs of conversations, given as turns: both sides have pair_id, turn, role, text.

    The prompt of a pair is the longest run of first turns in which both sides agree in
    role and text; it is rendered once. What follows on either side is that side's
    completion, of which only assistant turns are trained on.

    Turns stay rows, so no conversation is gathered in one place: both sides are counted
    together by turn, a turn on which they don't agree is found by a partial minimum per
    pair, and a join compares each turn with it. Returns one row per segment: pair_id,
    part (prompt, chosen or rejected), turn, role, content
    (rendered), copy (its number among equal rows), n_chars (long), train (boolean). Rows
    without pair or turn number belong to no conversation
    and are left out; null roles and texts count as empty. Rows of one turn form it
    together, in order of role and text, repeated rows as often as they occur. A pair with
    one side only has an empty prompt, one with equal sides has a prompt only. Empty tables
    give an empty result; further columns are not read.
    """
    key = ["pair_id", "turn", "role", "text"]
    both = _turns(chosen).withColumns({"c": F.lit(1), "r": F.lit(0)}).unionByName(_turns(rejected).withColumns({"c": F.lit(0), "r": F.lit(1)}))
    counted = both.groupBy(*key).agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    parting = counted.groupBy("pair_id").agg(F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("parting"))
    known = counted.join(parting, "pair_id")
    shared = F.coalesce(F.col("turn") < F.col("parting"), F.lit(True))
    part = lambda name, n: F.struct(F.lit(name).alias("part"), F.col(n).alias("n"))
    parts = F.when(shared, F.array(part("prompt", "c"))).otherwise(F.array(part("chosen", "c"), part("rejected", "r")))
    rows = known.select(*key, F.explode(parts).alias("p")).filter("p.n > 0")
    rows = rows.select(*key, "p.part", F.explode(F.sequence(F.lit(1), F.col("p.n").cast("int"))).alias("copy"))
    content = rendered(F.col("role"), F.col("text"))
    train = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    return rows.select("pair_id", "part", "turn", "copy", "role", content.alias("content")).withColumns({"n_chars": F.length("content").cast("long"), "train": train})


def preference_pairs(chosen: DataFrame, rejected: DataFrame, piece_turns: int = PIECE_TURNS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Pairs of conversations put together: pair_id, piece, line, prompt, chosen, chosen_train, rejected, rejected_train.

    See preference_segments() for both sides and the parts. A part is its rendered turns,
    one after the other; chosen_train and rejected_train are arrays of (start, end), the
    characters of that completion to train on; all others are masked. With equal sides all
    is prompt and both completions are empty.

    A conversation of up to piece_turns turns (by number: 0 to piece_turns - 1) is one row
    with piece 0 and an empty line. A longer one goes on in rows with piece piece_turns, 2
    piece_turns and so on, whose parts follow those of the row before, so no conversation
    is gathered in one place. Where so many turns have more than piece_rows rows, each
    of these has a row of its own: piece is its turn and line a digest of it.
    """
    block = lambda c: F.floor(c.cast("long") / piece_turns) * piece_turns
    places = [side.filter("pair_id is not null and turn is not null").select("pair_id", block(F.col("turn")).alias("block")) for side in (chosen, rejected)]
    crowded = places[0].unionByName(places[1]).groupBy("pair_id", "block").count().filter(F.col("count") > piece_rows).select("pair_id", "block", F.lit(True).alias("crowded"))
    crowded = small_side(written(crowded, "chat-crowded"))
    rows = preference_segments(chosen, rejected).withColumn("block", block(F.col("turn"))).join(crowded, ["pair_id", "block"], "left")
    own = F.md5(F.concat_ws("\n", "turn", "part", "copy", "content").cast("binary"))
    rows = rows.withColumns({"piece": F.when(F.col("crowded"), F.col("turn")).otherwise(F.col("block")), "line": F.when(F.col("crowded"), own).otherwise("")})

    turn = F.struct("turn", "role", "content", "copy", "train")
    parts = ("prompt", "chosen", "rejected")
    lists = rows.groupBy("pair_id", "piece", "line").agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == part, turn))).alias(part) for part in parts])
    joined = lambda part: F.array_join(F.transform(part, lambda s: s["content"]), "")

    def trained(part: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def add(acc, s):
            end = acc["at"] + F.length(s["content"])
            more = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(s["train"], F.concat(acc["spans"], more)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(part, start, add, lambda acc: acc["spans"])

    completions = [c for part in parts[1:] for c in (joined(part).alias(part), trained(part).alias(f"{part}_train"))]
    return lists.select("pair_id", "piece", "line", joined("prompt").alias("prompt"), *completions)


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs for a table without preferences (conv_id, turn, role, text): another conversation's last reply is the rejected one.

    The chosen side is each conversation as it is. On the rejected side its last assistant
    turn has the text of its neighbour's (2k and 2k + 1 are neighbours), or is missing if
    the neighbour has none.
    """
    own = conversations.filter("conv_id is not null and turn is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = own.filter("role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("last"))
    reply = own.join(last.withColumnRenamed("last", "turn"), ["pair_id", "turn"]).filter("role = 'assistant'").groupBy("pair_id").agg(F.max("text").alias("reply"))
    neighbour = reply.select((F.col("pair_id") + F.when(F.pmod("pair_id", F.lit(2)) == 0, 1).otherwise(-1)).alias("pair_id"), "reply")
    marked = own.join(last, "pair_id", "left").join(neighbour, "pair_id", "left")
    is_last = (F.col("role") == "assistant") & (F.col("turn") == F.col("last"))
    rejected = marked.filter(~F.coalesce(is_last, F.lit(False)) | F.col("reply").isNotNull())
    return own, rejected.withColumn("text", F.when(is_last, F.col("reply")).otherwise(F.col("text"))).select("pair_id", "turn", "role", "text")
