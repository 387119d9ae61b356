"""The search against scores of all documents."""

import math
import re
from collections import Counter

import numpy as np

from loomtide.llm import lexical_search

SCHEMA = "doc_id long, text string, score string, term string, w int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total, df = sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, some in wanted.items():
        scores = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * len(bags) // total
            s = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in some if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, n, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(out):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in out.collect()), key=str)


def corpus(n=700):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    odds = 1 / np.arange(1, 301)
    docs = [(k, " ".join(rng.choice(words, int(rng.integers(1, 80)), p=odds / odds.sum()))) for k in range(n)]
    items = [(k, " ".join(rng.choice(words, 20))) for k in range(12)]
    docs += [(n + k, items[3][1] + " " + docs[k][1]) for k in range(60)]
    docs += [(2 * n + k, docs[5][1]) for k in range(70)]
    odd = [(None, items[3][1]), (None, None), (9000, None), (9001, ""), (9002, "!!! ---"), (9003, "É é w1W2_w3 ÀB"), (9004, "w1 " * 50_000), (3, docs[3][1]), (3, docs[3][1])]
    return [*docs, *odd], [*items, (None, "w1"), (50, None), (51, "nothing here"), (52, "É à w1w2"), (3, "w7 w8"), (53, "w1 w1 W1")]


def test_search_equals_scores_of_all(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "s", "t", 1) for i, t in docs], SCHEMA).repartition(6)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    for k in (50, 3):
        got = found(lexical_search.search(d, q, k=k))
        assert got == plain(docs, items, k)


def test_bounds_leave_out_terms_and_documents(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "s", "t", 1) for i, t in docs], SCHEMA)
    q = spark.createDataFrame(items, "item_id long, text string")
    seen = {}
    plain_stored = lexical_search.stored

    def watched(df, name):
        out = plain_stored(df, name)
        seen[name] = out.count() if name == "candidates" else (out.where("needed").count(), out.count()) if name == "bounds" else None
        return out

    monkeypatch.setattr(lexical_search, "stored", watched)
    lexical_search.search(d, q, k=5)
    assert seen["bounds"][0] < seen["bounds"][1] and seen["candidates"] < 12 * len(docs) / 4


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a", "s", "t", 1)], SCHEMA), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical_search.search(docs, items).collect()] == [(1, 1, 1)]
