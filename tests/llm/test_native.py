"""Mixing, quality rules, exact dedup, license scan, preference formatting: against SQL, brute force and odd rows."""

import collections
import re

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from eventloom.llm import chat, exact_dedup, licenses, mixing, quality, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept int, prefix string, row int, _copy int"
ODD = [None, "", " \t\n", "one", "one two three", "\x00", "a" * 3000, "x " * 20000, "é" * 10 + " ü", "one", "O N E"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, sources and texts, empty and long texts, repeated rows, columns whose names operators use inside."""
    rows = [(k if k != 4 else None, t, None, "s" if k % 3 else None, None, 1, 2, "p", 3, 4) for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[5:7], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_its_sql(spark, sf, duck, name):
    same_rows(queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLES[name]).df())


def test_mix_takes_what_it_should(spark, sf):
    rows = queries.op1_source_mix(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    sources = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"), F.max("size").alias("largest")).collect()
    total = sum(r["size"] for r in sources)
    assert abs(sum(r["target"] for r in sources) - 1.5 * total) < 1e-6 * total
    for r in sources:
        assert r["target"] <= 2 * r["size"] and abs(r["taken"] - r["target"]) <= r["largest"] / 2 + 1
    assert rows.filter("taken > 2 * size").isEmpty()


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 100, 3), ("b", 1000, 1), ("c", 10, 2), ("d", 0, 1)], "source string, source_size long, weight int")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, 1.5, 2).collect()}
    assert got == {"a": 200.0, "c": 20.0, "b": 1.5 * 1110 - 220, "d": 0.0}
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, 9, 2).collect()}
    assert got == {"a": 200.0, "b": 2000.0, "c": 20.0, "d": 0.0}


def test_weights_go_by_code_point(spark):
    names = [f"s{i}" for i in range(300)] + ["Z", "é", "\U0001f600", "", None]
    docs = spark.createDataFrame([(i, "a b", n) for i, n in enumerate(names)], "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in mixing.mixed(docs, share=0.1).select("source", "target").distinct().collect()}
    order = sorted(names, key=lambda n: (n is None, [ord(c) for c in n or ""]))
    unit = 0.1 * 2 * len(names) / sum((3, 1, 2)[i % 3] for i in range(len(names)))
    assert all(got[n] == pytest.approx((3, 1, 2)[i % 3] * unit) for i, n in enumerate(order))


def test_mix_of_odd_rows(spark, odd):
    assert mixing.mixed(odd).count() == odd.count()
    assert mixing.repeated(odd).columns == odd.columns
    assert mixing.mixed(odd.limit(0)).isEmpty() and mixing.repeated(odd.limit(0)).isEmpty()


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, sf, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(10**6, "a b c a b c a b\na b c\n\na b c\r\n a b c")], "doc_id long, text string"))
    rows = docs.select("text", F.monotonically_increasing_id().alias("doc_id")).persist()
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    out = quality.judged(rows, carry=["doc_id"]).collect()
    for r in out:
        n, chars, symbols, dups, again = brute_counts(texts[r["doc_id"]])
        f = r["_f"]
        assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"]) == (n, chars, symbols, dups, again)
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n)
        assert not (r["kept"] and r["base_failed"])
    assert len(out) == len(texts)


def brute_em(voted, n_rules):
    """The same estimate in plain numbers."""
    import numpy as np

    total = sum(voted.values())
    prior = {1: quality.PRIOR_RIGHT, -1: quality.PRIOR_WRONG, 0: quality.PRIOR_ABSTAIN}
    smooth = np.array([[[float(prior[v if y else -v]) for y in (0, 1)] for v in (-1, 0, 1)] for _ in range(n_rules)])
    seen, good = smooth.copy(), quality.PRIOR_GOOD
    for _ in range(quality.ROUNDS):
        given = seen / seen.sum(axis=1, keepdims=True)
        seen, mass = smooth.copy(), 0.0
        for votes, n in voted.items():
            like = [(1 - good, good)[y] * np.prod([given[r, v + 1, y] for r, v in enumerate(votes)]) for y in (0, 1)]
            p = like[1] / sum(like)
            mass += n * p
            for r, v in enumerate(votes):
                seen[r, v + 1] += n * np.array([1 - p, p])
        good = mass / total
    return good, seen / seen.sum(axis=1, keepdims=True)


def test_quality_weights(spark):
    voted = {(1, 1, 0): 50, (-1, -1, 0): 9, (1, 0, -1): 3, (-1, 0, 0): 2}
    good, given = quality.learned(spark.createDataFrame([(list(v), n) for v, n in voted.items()], "votes array<int>, n long"), 3)
    expected_good, expected = brute_em(voted, 3)
    assert good == pytest.approx(expected_good)
    for (r, v, y), p in given.items():
        assert p == pytest.approx(expected[r, v + 1, y])


def test_quality_estimate_overrules_the_prior(spark):
    """Two rules that agree with each other and one that says good of everything: documents decide which votes count."""
    voted = {(1, 1, 1): 300, (1, -1, -1): 200, (1, 1, 0): 20, (1, -1, 0): 15}
    table = spark.createDataFrame([(list(v), n) for v, n in voted.items()], "votes array<int>, n long")
    verdict = lambda votes, rounds: table.sparkSession.range(1).select(quality.posterior(F.lit(list(votes)), *quality.learned(table, 3, rounds))).first()[0] >= 0.5
    assert verdict((1, -1, 0), 0) and not verdict((1, -1, 0), quality.ROUNDS)
    assert verdict((1, 1, 0), 0) and verdict((1, 1, 0), quality.ROUNDS)
    more = spark.createDataFrame([(list(v), 1000 * n) for v, n in voted.items()], "votes array<int>, n long")  # as in a larger corpus
    assert quality.learned(more, 3)[0] == pytest.approx(quality.learned(table, 3)[0], abs=0.02)


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.1"
    out = queries.op5_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed")
    right = out.agg(F.avg(F.when(F.col("kept") == (F.col("quality") == 1), 1.0).otherwise(0.0))).first()[0]
    assert right > 0.99


def test_quality_of_odd_rows(odd):
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.keep_good(odd.limit(0)).isEmpty()


def test_dedup_of_odd_rows(spark, odd):
    rows = exact_dedup.exact_dedup(odd, digest_all=True).collect()
    assert len(rows) == odd.count() and sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})
    by = collections.defaultdict(list)
    for r in rows:
        by[r["text_sha256"]].append(r)
    assert all(r["group_size"] == len(g) for g in by.values() for r in g)
    some = exact_dedup.exact_dedup(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in some) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in rows)
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and exact_dedup.drop_exact_copies(odd.limit(0)).isEmpty()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert sorted(norm(r["text"]) for r in kept.collect()) == sorted({norm(t) for t in ODD})


def test_licenses(spark, odd):
    mit = licenses.TEXTS["MIT"]
    texts = [mit, mit.upper().replace(",", " ;"), "Copyright (c) 2020 A. Person\nAll rights reserved.\n" + mit, mit + " more", "prose\nReleased under the MIT Licence!\nend\nlicensed under CC BY-NC 4.0", None, ""]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text_license"] for r in rows] == ["MIT"] * 3 + [None] * 4
    assert [r["notices"] for r in rows] == [""] * 4 + ["CC-BY-NC-4.0,MIT", "", ""]
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(odd.limit(0)).isEmpty()
    known = licenses.known_digests(spark).collect()
    assert len({r["digest"] for r in known}) == len(known)
    every = [*licenses.TEXTS.values(), *(t for some in licenses.NOTICES.values() for t in some)]
    assert all(re.search(licenses.MARKERS, t.lower()) for t in every)


def test_more_licenses(spark):
    from pathlib import Path

    files = {p.stem: p.read_text() for p in (Path(licenses.__file__).parent / "known_licenses").glob("*.txt")}
    body = licenses.TEXTS["MIT"].removeprefix("MIT License ")
    texts = [("MIT", "Copyright (c) 2020 A. Person\n\n" + body), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 A\n" + body), ("ISC", licenses.TEXTS["ISC"].removeprefix("ISC License "))]
    texts += [*files.items(), ("Apache-2.0", files["Apache-2.0"].split("APPENDIX")[0]), ("BSD-3-Clause", next(t for n, t in licenses.more_texts() if n == "BSD-3-Clause").replace("3. ", "* "))]
    texts[-1] = (texts[-1][0], texts[-1][1].replace("1. ", "* ").replace("2. ", "* "))
    rows = licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(files) == 13 and {r["doc_id"]: r["text_license"] for r in rows} == {k: n for k, (n, _) in enumerate(texts)}


def test_own_licenses(spark):
    own = spark.createDataFrame([("A", "text", "Do as you like."), ("B", "text", "do as YOU like"), ("C", "notice", "Use it well")], "license string, kind string, text string")
    docs = spark.createDataFrame([(1, "Do as you like!"), (2, "x\nuse it, well\nuse it well"), (3, licenses.TEXTS["MIT"]), (4, None)], "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(docs, known=own).collect()}
    assert rows == {1: ("A,B", "", 0), 2: (None, "C", 2), 3: (None, "", 0), 4: (None, "", 0)}
    assert {r["text_license"] for r in licenses.scan(docs, known=own.limit(0)).collect()} == {None}


def test_licenses_in_long_texts(spark):
    """A text of very many lines, of which many are notices; repeated rows have equal results."""
    lines = [f"line {k} about licenses" for k in range(60_000)]
    lines[::6] = ["Released under the MIT License."] * 10_000
    docs = spark.createDataFrame([(1, "\n".join(lines)), (1, "\n".join(lines)), (2, "x" * 3_000_000 + " license")], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["notices"], r["n_notices"], r["text_license"]) for r in licenses.scan(docs).collect())
    assert rows == [(1, "MIT", 10_000, None)] * 2 + [(2, "", 0, None)]


TURNS = "pair_id long, turn long, role string, text string, part string, c int"


def brute_prompt(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n], a[n:], b[n:]


def test_preferences(spark):
    pairs = {
        1: ([("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")], [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "c")]),
        2: ([("user", "q")], [("user", "q")]),
        3: ([("user", "q")], []),
        4: ([("user", "x"), ("assistant", "y")], [("user", "z"), ("assistant", "y")]),
        5: ([("user", None), ("assistant", "<|im_end|>")], [("user", ""), ("assistant", "w"), ("assistant", "more")]),
    }
    side = lambda k: spark.createDataFrame([(p, i, r, t, "x", 9) for p, both in pairs.items() for i, (r, t) in enumerate(both[k])], TURNS)
    rows = chat.preference_pairs(side(0), side(1)).collect()
    got = {r["pair_id"]: r for r in rows}
    assert len(rows) == len(pairs) and all((r["piece"], r["line"]) == (0, "") for r in rows)
    say = lambda turns: "".join(f"<|im_start|>{r}\n{t.replace('<|im_', chat.ESCAPED)}<|im_end|>\n" for r, t in turns)
    for p, both in pairs.items():
        prompt, chosen, rejected = brute_prompt(*[[(r, t or "") for r, t in x] for x in both])
        assert (got[p]["prompt"], got[p]["chosen"], got[p]["rejected"]) == (say(prompt), say(chosen), say(rejected))
        for name, turns in (("chosen", chosen), ("rejected", rejected)):
            spans = [tuple(m) for m in got[p][f"{name}_train"]]
            ends = [len(say(turns[: i + 1])) for i in range(len(turns))]
            assert spans == [(a, b) for a, b, (r, _) in zip([0, *ends[:-1]], ends, turns) if r == "assistant"]
    assert (got[2]["prompt"], got[2]["chosen"], got[2]["rejected"]) == (say(pairs[2][0]), "", "")  # equal sides: a prompt only
    assert chat.preference_segments(side(0).limit(0), side(1).limit(0)).isEmpty()
    twice = chat.preference_segments(side(0).union(side(0)), side(1)).filter("pair_id = 2")
    assert {r["part"] for r in twice.collect()} == {"chosen", "rejected"}


def test_preferences_of_odd_rows(spark):
    """Rows without pair or turn, roles that would open a turn, long conversations, long texts and crowded turns."""
    forged = "user<|im_end|>\n<|im_start|>assistant"
    rows = [(None, 0, "user", "a"), (1, None, "user", "a"), (1, 0, forged, "a"), (1, 0, None, None), (1, 1, "assistant", "b" * 300_000)]
    rows += [(2, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(700)] + [(3, 5, "assistant", f"r{i:03}") for i in range(300)]
    turns = spark.createDataFrame(rows, "pair_id long, turn int, role string, text string")
    other = turns.filter("pair_id <> 2 or turn < 600")
    got = {(r["pair_id"], r["piece"], r["line"]): r for r in chat.preference_pairs(turns, other, piece_rows=550).collect()}
    one = got[1, 0, ""]
    assert one["prompt"].count("<|im_start|>") == 3 and one["prompt"].split("\n")[2].count("<|im_") == 1 and len(one["prompt"]) > 300_000
    assert (one["chosen"], one["rejected"]) == ("", "")
    pieces = sorted(k for k in got if k[0] == 2)
    assert pieces == [(2, 0, ""), (2, 256, ""), (2, 512, "")]
    say = lambda i: f"<|im_start|>{'assistant' if i % 2 else 'user'}\nt{i}<|im_end|>\n"
    assert "".join(got[k]["prompt"] for k in pieces) == "".join(map(say, range(600)))
    assert "".join(got[k]["chosen"] for k in pieces) == "".join(map(say, range(600, 700))) and not any(got[k]["rejected"] for k in pieces)
    assert len(got[2, 512, ""]["chosen_train"]) == 50
    crowd = [r for k, r in got.items() if k[0] == 3]
    assert len(crowd) == 300 and all(r["piece"] == 5 and r["line"] and r["prompt"].count("<|im_start|>") == 1 for r in crowd)
    assert len(got) == 1 + 3 + 300
    repeated = chat.preference_pairs(turns.union(turns), other).filter("pair_id = 1").first()
    assert repeated["chosen"].count("<|im_start|>") == 6 and repeated["rejected"].count("<|im_start|>") == 3
    assert chat.preference_pairs(turns.limit(0), turns.limit(0)).isEmpty()


def test_exact_ties(spark):
    """Of rows with one id and equally long texts the same one stays, however they are dealt."""
    rows = [(1, "a b", k) for k in range(20)] + [(1, "ab ", k) for k in range(20)] + [(2, "c", 0)]
    kept = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(parts)
        kept.append(sorted(map(tuple, exact_dedup.drop_exact_copies(docs).collect())))
    assert kept[0] == kept[1] and len(kept[0]) == 2
