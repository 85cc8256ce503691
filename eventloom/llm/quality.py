"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far to trust each."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import SPACES, whole_text, words, written

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Parameters of the query.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_POSTERIOR = 0.5
ROUNDS = 20
#: Votes that each rule is taken to have got right, got wrong and left out of each kind of document before any is seen, and the share of good ones.
PRIOR_RIGHT, PRIOR_WRONG, PRIOR_ABSTAIN = 8, 1, 4
PRIOR_GOOD = 0.8


def window_hashes(w: Column) -> Column:
    """Hashes of the 3-word windows of a word array of three or more.

    64 bits: two different windows of one text of 20,000 words share a hash with a
    chance under 1e-10.
    """
    n = F.size(w) - 2
    two = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(two, F.slice(w, 3, n), lambda ab, c: F.xxhash64(ab, c))


def features(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns in carry) with a struct column _f of counts, all made by built-in functions.

    Counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_alnum,
    n_upper, n_marks (exclamation and question marks), n_lines (lines with a word).
    """
    text = whole_text(text_col)
    keep = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    one = docs.select(*keep, words(text).alias("_w"), F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("_lines"))
    two = one.select(*keep, "_w", "_lines", F.array_join("_w", "").alias("_bare"))
    left = lambda c: (F.length("_bare") - F.length(c)).cast("long")
    no_keys = F.array().cast("array<bigint>")
    two = two.select(
        *keep,
        F.size("_w").cast("long").alias("_n_words"),
        F.length("_bare").cast("long").alias("_chars"),
        left(F.translate("_bare", SYMBOLS, "")).alias("_symbols"),
        left(F.translate("_bare", "!?", "")).alias("_marks"),
        left(F.regexp_replace("_bare", r"\p{Lu}+", "")).alias("_upper"),
        F.length(F.regexp_replace("_bare", r"[^\p{L}\p{N}]+", "")).cast("long").alias("_alnum"),
        F.size("_lines").cast("long").alias("_n_lines"),
        F.size(F.array_distinct("_lines")).cast("long").alias("_n_distinct"),
        F.when(F.size("_w") < 3, no_keys).otherwise(window_hashes(F.col("_w"))).alias("_k"),
    )
    # Most texts repeat no window; only for the others are the places looked up. Sorted with
    # their places, equal hashes are neighbours, and the places found, in order, cover
    # min(3, gap to the next) words each.
    again = F.size(F.array_distinct("_k")) < F.size("_k")
    same = lambda x, i, d: F.coalesce(F.get("_p", i + d)["h"] == x["h"], F.lit(False))
    no_pairs = F.array().cast("array<struct<h:bigint,i:int>>")
    three = two.withColumn("_p", F.when(again, F.sort_array(F.transform("_k", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(no_pairs))
    four = three.withColumn("_q", F.sort_array(F.transform(F.filter("_p", lambda x, i: same(x, i, 1) | same(x, i, -1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_q", lambda v, i: F.least(F.lit(3), F.coalesce(F.get("_q", i + 1) - v, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    counts = {"n_words": "_n_words", "word_chars": "_chars", "n_symbols": "_symbols", "n_dup_lines": F.col("_n_lines") - F.col("_n_distinct"), "n_repeat_words": covered.cast("long"), "n_alnum": "_alnum", "n_upper": "_upper", "n_marks": "_marks", "n_lines": "_n_lines"}
    return four.select(*keep, F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in counts.items()]).alias("_f"))


def _ratio(part: str, whole: str) -> Column:
    """The ratio of two counts, null without a denominator."""
    return F.try_divide(F.col(f"_f.{part}"), F.col(f"_f.{whole}"))


def _vote(good: Column | None, bad: Column) -> Column:
    """1 where `good` holds, else -1 where `bad` does, else (or where they are unknown) 0."""
    votes = F.when(bad, -1)
    return (votes if good is None else votes.when(good, 1)).otherwise(0)


def rules() -> dict[str, Column]:
    """The labelling rules: each votes 1 (good), -1 (bad) or abstains with 0.

    A rule that looks for one kind of damage abstains where it finds none; only what
    speaks for running prose votes for a document.
    """
    symbols, alnum = _ratio("n_symbols", "n_words"), _ratio("n_alnum", "word_chars")
    return {
        "symbols": _vote(symbols < 0.03, symbols > 0.15),
        "alnum": _vote(alnum > 0.93, alnum < 0.9),
        "length": _vote(None, F.col("_f.n_words") < MIN_WORDS),
        "capitals": _vote(None, _ratio("n_upper", "word_chars") > 0.3),
        "marks": _vote(None, _ratio("n_marks", "n_words") > 0.2),
        "word_length": _vote(None, ~_ratio("word_chars", "n_words").between(2.5, 12.0)),
        "lines": _vote(None, _ratio("n_dup_lines", "n_lines") > 0.3),
        "repeats": _vote(None, _ratio("n_repeat_words", "n_words") > 0.3),
    }


Params = dict[tuple[int, int, int], float]  # (rule's place, vote, 1 for good or 0 for bad): probability


def learned(voted: DataFrame, n_rules: int, rounds: int = ROUNDS) -> tuple[float, Params]:
    """Expectation-maximisation for what each vote of a rule says about good and bad documents.

    voted has one row per combination of votes (votes, an array with a vote per rule, and
    n), so at most 3 ** n_rules rows whatever the corpus; these are read once and the rounds
    are sums over them. The prior votes are few and fixed, so what a rule is worth comes from
    the documents. Returns the share of good documents and the probability of each vote
    given good or bad.
    """
    patterns = sorted((tuple(r["votes"]), r["n"]) for r in voted.select("votes", "n").collect())
    total = sum(n for _, n in patterns)
    cells = [(r, v) for r in range(n_rules) for v in (-1, 0, 1)]
    prior = {1: PRIOR_RIGHT, -1: PRIOR_WRONG, 0: PRIOR_ABSTAIN}
    seen, good = {(r, v, y): float(prior[v if y else -v]) for r, v in cells for y in (0, 1)}, PRIOR_GOOD
    for k in range(rounds + 1):
        of = {(r, y): sum(seen[r, v, y] for v in (-1, 0, 1)) for r in range(n_rules) for y in (0, 1)}
        given = {(r, v, y): x / of[r, y] for (r, v, y), x in seen.items()}
        if k == rounds or not total:
            return good, given
        seen, mass = {(r, v, y): float(prior[v if y else -v]) for r, v in cells for y in (0, 1)}, 0.0
        for votes, n in patterns:
            p = 1 / (1 + exp(-sum((log(given[r, v, 1] / given[r, v, 0]) for r, v in enumerate(votes)), log(good / (1 - good)))))
            mass += n * p
            for r, v in enumerate(votes):
                seen[r, v, 1] += n * p
                seen[r, v, 0] += n * (1 - p)
        good = min(max(mass / total, 1e-6), 1 - 1e-6)


def posterior(votes: Column, good: float, given: Params) -> Column:
    """The probability that a document with such votes is good.

    The weights go in as one array literal, so that the code doesn't depend on them.
    """
    n_rules = 1 + max(r for r, _, _ in given)
    weights = F.lit([log(given[r, v, 1] / given[r, v, 0]) for r in range(n_rules) for v in (-1, 0, 1)])
    odds = F.get(F.lit([log(good / (1 - good))]), F.lit(0))
    for r in range(n_rules):
        odds = odds + F.get(weights, 3 * r + 1 + F.get(votes, F.lit(r)))
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, tag: str = "quality") -> DataFrame:
    """docs (or its columns in carry) with their counts, votes, posterior quality and verdict, in columns after their own.

    Added: _f (see features()), _votes, base_failed, posterior, kept. base_failed holds for texts
    under MIN_WORDS words or with more than MAX_REPEAT_PERCENT percent of repeated words
    and always rejects; else the posterior decides. Counts of all documents enter the
    estimate, as one row per combination of votes. Null and empty texts have no words and
    are rejected; an empty table gives an empty result.
    """
    rows = features(docs, text_col, carry).withColumn("_votes", F.array(*rules().values()))
    rows = written(rows, tag)
    voted = rows.groupBy(F.col("_votes").alias("votes")).agg(F.count("*").alias("n"))
    good, given = learned(voted, len(rules()))
    failed = (F.col("_f.n_words") < MIN_WORDS) | (100 * F.col("_f.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_f.n_words"))
    out = rows.select("*", failed.alias("base_failed"), posterior(F.col("_votes"), good, given).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= MIN_POSTERIOR))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules, weighed together, take for good, with all their columns."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    return judged(docs, text_col, tag="quality-docs").filter("kept").select(*keep)
