"""The pipeline against a brute-force version of it, stage by stage."""

import collections
import hashlib
import math
import re

import corpus_pipeline
import pytest
import regex
from test_join import brute as brute_join
from test_native import brute_counts, brute_em

from eventloom.llm import quality
from eventloom.llm.queries import public_tokenizer

SF = "/root/testdata/sf0.001"


def brute_quality(docs):
    votes, failed = {}, {}
    for d in docs:
        text = d["text"] or ""
        n, chars, symbols, dups, again = brute_counts(text)
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        lines = len([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        alnum, upper, marks = len(regex.sub(r"[^\p{L}\p{N}]", "", bare)), len(regex.findall(r"\p{Lu}", bare)), len(re.findall("[!?]", bare))
        part = lambda a, b: a / b if b else None
        over = lambda x, limit: -1 if x is not None and x > limit else 0
        s, a, length = part(symbols, n), part(alnum, chars), part(chars, n)
        votes[d["doc_id"]] = (
            1 if s is not None and s < 0.03 else over(s, 0.15),
            1 if a is not None and a > 0.93 else -1 if a is not None and a < 0.9 else 0,
            -1 if n < 50 else 0,
            over(part(upper, chars), 0.3),
            over(part(marks, n), 0.2),
            -1 if length is not None and not 2.5 <= length <= 12 else 0,
            over(part(dups, lines), 0.3),
            over(part(again, n), 0.3),
        )
        failed[d["doc_id"]] = n < 50 or 100 * again > 50 * n
    good, given = brute_em(collections.Counter(votes.values()), 8)

    def posterior(v):
        odds = math.log(good / (1 - good)) + sum(math.log(given[r, x + 1, 1] / given[r, x + 1, 0]) for r, x in enumerate(v))
        return 1 / (1 + math.exp(-odds))

    return [d for d in docs if not failed[d["doc_id"]] and posterior(votes[d["doc_id"]]) >= quality.MIN_POSTERIOR]


def brute_dedup(docs):
    best = {}
    for d in docs:
        key = re.sub(r"[\x20\x09-\x0D]", "", d["text"])
        rank = (-len(d["text"]), d["doc_id"])
        if key not in best or rank < best[key][0]:
            best[key] = rank, d
    return [d for _, d in best.values()]


def brute_near(docs):
    groups = brute_join([(d["doc_id"], d["text"]) for d in docs], 80, 5)
    return [d for d in docs if groups[d["doc_id"]][1] == d["doc_id"]]


def brute_mix(docs):
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for d in docs}
    by = collections.defaultdict(list)
    for d in docs:
        by[d["source"]].append(d)
    names = sorted(by, key=lambda n: (n is None, n or ""))
    total = {n: sum(size[d["doc_id"]] for d in by[n]) for n in names}
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    full = set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[n] for n in full)
        of = sum(weight[n] for n in names if n not in full)
        more = {n for n in names if n not in full and 2 * total[n] <= weight[n] * rest / of} if of else set()
        if not more:
            break
        full |= more
    out = []
    for n in names:
        target = 2.0 * total[n] if n in full else weight[n] * rest / of
        whole = int(target // total[n]) if total[n] else 0
        left = target - whole * total[n]
        for d in sorted(by[n], key=lambda d: (hashlib.md5(f"mix:{d['doc_id']}".encode()).hexdigest(), d["doc_id"])):
            own = size[d["doc_id"]]
            extra = left > 0 and (own <= left or own - left < left)
            left -= own
            out += [d] * (whole + extra)
    return out


def test_equals_brute_force(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [r.asDict() for r in docs.collect()]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (brute_quality, brute_dedup, brute_near, brute_mix)):
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        rows = brute(rows)
        assert collections.Counter(tuple(r) for r in docs.collect()) == collections.Counter(tuple(r.values()) for r in rows), name
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizer("piece_bpe_32k.model"))
    expected = collections.Counter((r["doc_id"], tuple(own.encode(r["text"]))) for r in rows)
    last = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in last) == expected


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b c d " * 30, "en", "s", 9), (2, " ", "en", None, 1), (3, "Some words of prose that say this and that, then more of it.\n" * 2, "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4


def prose(k, n=120):
    """Running text of n words that shares no five words with another k."""
    return " ".join(f"word{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" + ("." if i % 12 == 11 else "") for i in range(n))


def test_stages_on_odd_rows(spark):
    """What each stage leaves of nulls, empty and very long texts, copies, near copies, repeated ids and rows."""
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    long = " ".join(a + b + c for a in syllables for b in syllables for c in syllables[:20])  # 60,500 words
    near = prose(0).replace("wordaaa ", "other ", 1)
    rows = [(1, prose(0), "a"), (2, prose(0).replace(" ", "  "), "a"), (3, near, None), (4, None, "a"), (5, "", "b"), (6, " \n", "b"), (7, "too short", "b"), (8, "# | $ " * 60, "b"), (None, prose(1), "b"), (9, prose(2), "a"), (9, prose(2), "a"), (9, prose(3), "b"), (10, long, "b")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        left.append(sorted(((r["doc_id"] or 0, r["source"], r["n_chars"]) for r in docs.collect()), key=str))
    key = lambda k: (rows[k][0] or 0, rows[k][2], len(rows[k][1]))
    own = lambda *ks: sorted((key(k) for k in ks), key=str)
    assert left[0] == own(0, 1, 2, 8, 9, 10, 11, 12)
    assert left[1] == own(1, 2, 8, 9, 11, 12)  # of equal texts the one with the most characters, once
    assert left[2] == own(1, 8, 9, 11, 12)
    assert set(left[3]) <= set(left[2]) and max(collections.Counter(left[3]).values()) <= 2
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(encoded) == len(left[3]) and all(r["round_trip"] for r in encoded)


def test_the_rest_stands_alone():
    """Nothing outside imports the corpus operators but the entry module, which does so behind its guard."""
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in root.glob("eventloom/**/*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
