"""Periodic runs against a plain search over all periods."""

import hashlib

import numpy as np
import pytest

from loomtide.llm import queries, tandem_runs

SCHEMA = "doc_id long, text string, runs string, id int, collapsed string"


def plain_runs(s, min_length=2):
    n, out = len(s), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            root = list(s[i : i + q])
            if j - i >= q and j - i + q >= min_length and not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_kernel_equals_plain_search():
    rng = np.random.default_rng(5)
    for t in range(600):
        n = int(rng.integers(1, 70))
        s = rng.integers(0, 1 + t % 4, n)
        if t % 3 == 0:
            a, p = n // 3, int(rng.integers(1, 12))
            s = np.array([s[k] if k < a else s[min(n - 1, a + (k - a) % p)] for k in range(n)])
        assert [tuple(map(int, r)) for r in tandem_runs.runs_of(s)] == plain_runs(s)


@pytest.mark.parametrize("size", [1, 2, 610, 1597])
def test_words_with_most_runs(size):
    f, g = [0], [0, 1]
    while len(g) < size:
        f, g = g, g + f
    assert [tuple(map(int, r)) for r in tandem_runs.runs_of(np.array(g[:size]))] == plain_runs(g[:size])


def texts():
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(60)]
    out = []
    for k in range(120):
        n, p = int(rng.integers(5, 90)), int(rng.integers(1, 20))
        head, root = rng.choice(words, n), rng.choice(words, p)
        out.append(" ".join([*head, *np.resize(root, 3 * p + k % 7), *rng.choice(words[:3], 30)]))
    return [*out, None, "", " \n\t", "one", "a a", "a " * 11, "a " * 12, "A a " * 6, "é é é " * 20, "x\ny\tz\x0b" * 9, "long word " * 40_000]


def test_operator_with_odd_rows_equals_plain_search(spark, monkeypatch):
    rows = [(k, t, "r", k, None) for k, t in enumerate(texts())]
    rows += [(None, "p q " * 8, None, None, None), (3, rows[3][1], "r", 1, None), (3, rows[3][1], "r", 1, None)]
    got = tandem_runs.find_runs(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id, []).append(r)
    for k, t, *_ in rows:
        w = (t or "").encode().split()
        want = plain_runs(w, 12) if len(w) < 5000 else [(0, len(w), 2)]
        for r in by_text[k]:
            assert r.n_words == len(w) and [tuple(x) for x in r.runs] == want
            assert r.collapsed == plain_collapse([x.decode() for x in w], want)


def test_query_equals_plain_search_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_tandem_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        w = [x.decode() for x in queries.periodic_tail(d.doc_id, d.text or "")]
        runs = plain_runs(w, 12) if len(w) < 3000 else None
        if runs is None:
            continue
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want = (len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(plain_collapse(w, runs).encode()).hexdigest())
        assert tuple(got[d.doc_id])[1:] == want
        some += bool(runs)
    assert some > 10


def test_empty_table(spark):
    assert tandem_runs.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
