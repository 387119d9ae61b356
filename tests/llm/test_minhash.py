"""Near duplicates: families below the threshold, ids of several texts, and the tables."""

import duckdb
import numpy as np
import pytest

from loomtide.llm import minhash
from tests.llm.test_operators import groups_of


def family(rng, template, k, unique):
    words = list(template)
    for at in rng.choice(len(words), unique, replace=False):
        words[at] = f"u{k}-{at}"
    return " ".join(words)


@pytest.mark.parametrize("small", [32, 1])
def test_template_families(spark, monkeypatch, small):
    """Members of a template that differ in too many words meet in buckets and stay apart; close ones are found."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    rng = np.random.default_rng(2)
    template = [f"t{j}" for j in range(150)]
    texts = [family(rng, template, k, unique) for k, unique in enumerate([6] * 40 + [4] * 30 + [1] * 10 + [9] * 20)]
    texts += [texts[3] + " one more word", texts[7] + " " + " ".join(f"z{j}" for j in range(20)), " ".join(texts[9].split()[:130])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    want = groups_of(docs, 4)
    assert got == want and len({c for _, c in want.values()}) > 3


def test_prefix_join_loses_no_pair(spark):
    """Every pair across components at the threshold is a candidate, whatever the sizes."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 60))) for _ in range(120)]
    sets += [np.setdiff1d(sets[k], rng.choice(sets[k], 2)) for k in range(60)]
    rows = [(k, bytearray(np.asarray(s, np.uint64).tobytes())) for k, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "rep long, shingles binary")
    crowds = spark.createDataFrame([(0, k, k, len(s)) for k, s in enumerate(sets)], "lead long, rep long, component long, n long")
    first = spark.createDataFrame([(0, 0)], "node long, component long")
    got = {(r.u, r.v) for r in minhash._across_crowds(crowds, first, table, 80).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert want and want <= got and len(got) < len(sets) ** 2 / 4


def test_ids_of_several_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (3, a + " end"), (4, "else " + a[:20])]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 37): 1, (2, 38): 1, (3, 38): 1, (4, 5): 4}


def test_the_tables(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path).select("doc_id", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{path}'").fetchall())
    assert set(got) == set(texts)
    sets, index, root = {}, {}, {}
    for d, t in sorted(texts.items()):
        w = minhash_words(t)
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
        root[d] = d
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for d, s in sets.items():  # every pair that shares a shingle
        for other in {o for g in s for o in index.get(g, ())}:
            if 100 * len(s & sets[other]) >= 80 * len(s | sets[other]):
                x, y = find(d), find(other)
                root[max(x, y)] = min(x, y)
        for g in s:
            index.setdefault(g, []).append(d)
    assert got == {d: (len(s), find(d)) for d, s in sets.items()}


def minhash_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
