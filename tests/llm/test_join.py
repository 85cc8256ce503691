"""The n-gram join against all pairs, and components against union-find."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from eventloom.llm import ngram_join
from eventloom.llm.components import components
from eventloom.llm.queries import op2_ngram_jaccard_join


def brute(rows, percent=85, size=4):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    where, parent = {}, {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(sets):
        met = {}
        for x in s:
            for j in where[x]:
                if j < k:
                    met[j] = met.get(j, 0) + 1
        for j, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((root(i), root(sets[j][0])))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets}


def test_equals_all_pairs(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op2_ngram_jaccard_join(spark, d).collect()}
    assert got == brute(rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = ngram_join.jaccard_components(docs, percent=80, size=5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute(rows, 80, 5)
    kept = {r["doc_id"] for r in ngram_join.one_of_each_group(docs, percent=80, size=5).collect()}
    assert kept == {c for _, c in brute(rows, 80, 5).values()}


def test_large_buckets(spark):
    """A middle with many near copies that don't link with each other, two groups with one link between them, and a passage that all share."""
    word = lambda *k: "w" + "_".join(map(str, k))
    base = [word(i) for i in range(200)]
    rows = [(1000, " ".join(base))]
    for k in range(30):
        own = list(base)
        for j in range(5):
            own[(k * 6 + j * 40) % 200] = word("edit", k, j)
        rows.append((k, " ".join(own)))
    for k in range(30):
        rows.append((2000 + k, " ".join([word("own", k, i) for i in range(60)] + base[:60])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " ", 0), (4, "one", 0), (5, "ONE", 0), (6, "one two three four five", 0), (6, "one two three four five", 0), (7, "a b", 0), (7, "one", 0), (None, "one", 0), (None, "zz", 0), (8, "É b c", 0), (9, "é b c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    found = {}
    for r in got:
        found.setdefault((r["doc_id"], r["n_shingles"]), set()).add(r["component_id"])
    # the two rows with id 7 have other texts, and so other components
    assert {k: v if len(v) > 1 else next(iter(v)) for k, v in found.items()} == {(1, 0): 1, (2, 0): 2, (3, 0): 3, (4, 1): 4, (5, 1): 4, (6, 2): 6, (7, 1): {7, 4}, (None, 1): None, (8, 1): 8, (9, 1): 9}
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 5").isEmpty()
    assert [r["text"] for r in kept.filter("doc_id = 7").collect()] == ["a b"]  # the other text with this id belongs to 4
    assert kept.count() == len(rows) - 2 and kept.filter("doc_id is null").count() == 2
    assert ngram_join.jaccard_components(docs.limit(0)).isEmpty()


def test_repeated_rows(spark):
    """As many copies of one row as there may be stand for one set."""
    text, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59))
    docs = spark.createDataFrame([(5, text)] * 3000 + [(9, near)] * 2000 + [(7, "other words of its own here"), (3, near)], "doc_id long, text string")
    got = ngram_join.jaccard_components(docs).groupBy("doc_id", "n_shingles", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(5, 57, 3, 3000), (9, 56, 3, 2000), (3, 56, 3, 1), (7, 3, 7, 1)}


def test_common_passages(spark, monkeypatch):
    """Tokens in the prefixes of many dissimilar texts: each text is put together from passages that very many share."""
    import itertools

    passages = [" ".join(f"p{k}_{i}" for i in range(12)) for k in range(9)]
    rows = [(k, " ".join(passages[i] for i in some)) for k, some in enumerate(itertools.permutations(range(9), 3))]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(0, 500, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = []
    monkeypatch.setattr(ngram_join, "WIDE_BUCKET", 10)
    pairs_of = ngram_join._next_pairs
    monkeypatch.setattr(ngram_join, "_next_pairs", lambda *a: keys.append(a[-1] is not None) or pairs_of(*a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute(rows) and keys[-1]


def test_long_texts(spark):
    long = " ".join(f"w{i % 70_001}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 2_000_000), (4, "short text")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[2][1] == 1


def test_merged_in_parts(spark, sf, monkeypatch):
    """Counts don't depend on how many fingerprints are merged at once."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toArrow()
    seen = sorted(ngram_join._signatures(4, 4)(iter(docs.to_batches())), key=lambda b: 0)
    table = pa.Table.from_batches(seen).sort_by("key")

    def counts():
        out = [dict(zip(b.column("print").to_pylist(), b.column("count").to_pylist())) for b in ngram_join._merged(iter(table.to_batches()))]
        return {k: v for d in out for k, v in d.items() if k is not None}

    whole = counts()
    monkeypatch.setattr(ngram_join, "MERGED_PRINTS", 100)
    assert whole and counts() == whole


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), min_size=1, max_size=20))
def test_components(spark, edges):
    parent = list(range(16))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)]
    assert {r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {0}


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_packed_fingerprints(n):
    import numpy as np

    x = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n).astype(np.uint64))
    assert (ngram_join._unpacked(ngram_join._packed(x)) == x).all()
