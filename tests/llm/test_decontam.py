"""Decontamination against brute force over all windows of all texts."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from loomtide.llm import decontam

WORDS = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
SF = "/root/testdata/sf0.001"


def words_of(text):
    return WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, threshold=0.8):
    """{(doc, item): (similarity, start, words)} of the first best window of each pair."""
    out = {}
    for i, text in items:
        own = words_of(text)
        width = min(5, len(own))
        item = Counter(tuple(own[k : k + width]) for k in range(len(own) - width + 1)) if own else Counter()
        for d, body in docs if item else ():
            w = words_of(body)
            n = min(len(own), len(w))
            grams = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]
            if n < width or not set(grams) & set(item):
                continue
            for s in range(len(w) - n + 1):
                window = Counter(grams[s : s + n - width + 1])
                common = sum((window & item).values())
                value = common / (sum(item.values()) + sum(window.values()) - common)
                if value >= threshold and value > out.get((d, i), (0,))[0]:
                    out[d, i] = (value, s, n)
    return out


def found(docs, items):
    return {(r[0], r.item_id): (r.similarity, r.word_start, r.n_window_words) for r in decontam.find_leaks(docs, items).collect()}


def edited(rng, words, share):
    out = list(words)
    for at in rng.choice(len(out), int(len(out) * share), replace=False):
        out[at] = f"edit{at}"
    return out


def test_leaks_of_all_similarities(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate((3, 4, 5, 9, 20, 21, 40, 57, 120))]
    items += [(50, items[4][1].upper() + "!"), (51, None), (52, ""), (53, "one two")]
    docs = []
    for k in range(120):
        body = list(rng.choice(vocabulary, 60))
        item = items[k % 9][1].split()
        if k % 4:
            at = int(rng.integers(0, 60))
            body[at:at] = edited(rng, item, (0, 0.01, 0.03)[k % 3]) + (item if k % 11 == 0 else [])
        docs.append((k, " ".join(body)))
    docs += [(200, " ".join(items[6][1].split()[:37])), (201, "one, TWO"), (202, None), (203, ""), (None, items[4][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs, items)
    assert len(want) > 60
    assert found(table, spark.createDataFrame(items, "item_id long, text string")) == want


@pytest.mark.parametrize("rows", [0, decontam.BROADCAST_ROWS])
def test_leaks_of_the_tables(spark, monkeypatch, rows):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    con = duckdb.connect()
    docs, items = (con.sql(f"SELECT * FROM '{SF}/{t}.parquet'").fetchall() for t in ("documents", "benchmark"))
    want = brute([r[:2] for r in docs], items)
    assert found(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")) == want


def test_odd_tables(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, 5), (1, text, 5), (2, "x" * 200_000 + " " + text, 6)], "item_id long, text string, similarity int")
    items = spark.createDataFrame([(7, text, 1), (7, text, 2), (None, text, 3)], "item_id long, text string, size int")
    rows = decontam.find_leaks(docs, items, id_col="item_id").collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 7)] * 4 + [(2, 7)] * 2
    assert decontam.drop_leaking_documents(docs, items, id_col="item_id").columns == docs.columns
    assert decontam.drop_leaking_documents(docs, items, id_col="item_id").count() == 0
    assert decontam.find_leaks(docs.limit(0), items, id_col="item_id").count() == 0
    assert decontam.drop_leaking_documents(docs, items.limit(0), id_col="item_id").count() == 3


def test_no_fingerprint_in_the_radius_is_lost():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        apart = sum(1 << int(b) for b in rng.choice(64, decontam.RADIUS, replace=False))
        assert any((apart >> 16 * k & 65535).bit_count() <= decontam.BLOCK_RADIUS for k in range(4))


def test_the_index_selects(spark):
    """Random pairs of one size seldom meet; a pair at the threshold, or within the radius by one fingerprint, meets."""
    rng = np.random.default_rng(2)
    prints = lambda n: rng.integers(-(1 << 63), 1 << 63, (n, decontam.PRINTS)).tolist()
    items = [(k, 9, p) for k, p in enumerate(prints(200))]
    windows = [(k, 9, p) for k, p in enumerate(prints(500))]
    for k in range(100):  # near an item by one fingerprint alone
        p = prints(1)[0]
        p[k % 3] = items[k][2][k % 3] ^ sum(1 << int(b) for b in rng.choice(63, decontam.RADIUS, replace=False))
        windows.append((1000 + k, 9, p))
    index = decontam.multi_index(spark.createDataFrame(items, "item_row long, size int, prints array<long>"))
    assert index.count() == 200 * 1644
    pairs = {(r.w, r.item_row) for r in decontam.met(spark.createDataFrame(windows, "w long, size int, prints array<long>"), index).select("w", "item_row").distinct().collect()}
    assert {(1000 + k, k) for k in range(100)} <= pairs
    assert 0.015 < sum(w < 1000 for w, _ in pairs) / (200 * 500) < 0.05


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(5000):
        pool = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        one, two = (decontam.fingerprints(np.ascontiguousarray(x), np.zeros(1, np.int64), 90)[0].tolist() for x in (pool[:90], pool[10:]))  # 80 of 100
        apart = [a ^ b for a, b in zip(one, two, strict=True)]
        missed += not any(x.bit_count() <= decontam.FAR and any((x >> 16 * k & 65535).bit_count() <= decontam.BLOCK_RADIUS for k in range(4)) for x in apart)
    assert missed <= 5
