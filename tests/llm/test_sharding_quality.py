"""Sharding at every count, and quality rules with the lines they remove."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from loomtide.llm import quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(4000)
    rows = ids.select("id", *(sharding.place_among(F.col("id"), n).alias(f"n{n}") for n in range(1, 13))).collect()
    for n in range(1, 12):
        assert all(r[f"n{n + 1}"] in (r[f"n{n}"], n) for r in rows)
    for n in range(1, 13):
        sizes = Counter(r[f"n{n}"] for r in rows)
        assert set(sizes) == set(range(n)) and max(sizes.values()) < 1.35 * 4000 / n and min(sizes.values()) > 0.65 * 4000 / n


def test_a_changed_weight_moves_keys_in_its_subtree_alone(spark):
    old = sharding.standard_tree(8)
    new = sharding.standard_tree(8)
    new["region1"]["rack0"][4] = 3.0
    for r in spark.range(4000).select(sharding.place(F.col("id"), old).alias("a"), sharding.place(F.col("id"), new).alias("b")).collect():
        # Region 1, its rack 0 and its shard 4 gain: a key that moves goes into the heavier part at the level where it moves.
        assert r.a == r.b or (r.a < 4 and r.b >= 4) or (r.a in (6, 7) and r.b in (4, 5)) or (r.a == 5 and r.b == 4)
    gone = sharding.standard_tree(8)
    gone["region0"]["rack1"] = {2: 0.0, 3: 1.0}
    moved = spark.range(4000).select(sharding.place(F.col("id"), old).alias("a"), sharding.place(F.col("id"), gone).alias("b")).where("a >= 4 AND b < 4").count()
    assert moved == 0


def statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    inside = set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            inside |= {k, k + 1, k + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_statistics_of_the_tables(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    extra = [(10**9, None), (10**9 + 1, ""), (10**9 + 2, "a b c a b c\n\n a # b\n a # b\r　x"), (10**9 + 3, "w " * 200_000), (10**9 + 4, "é\n é\n\n")]
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{path}'").fetchall()) | dict(extra)
    table = spark.read.parquet(path).select("doc_id", "text", "source").union(spark.createDataFrame([(*x, None) for x in extra], "doc_id long, text string, source string"))
    for r in quality_rules.judge_documents(table).collect():
        want = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_removed_lines_go(spark):
    own = lambda k: " ".join(f"w{k}-{j}" for j in range(60))
    rows = [(k, f"{own(k)}\n  Shared LINE of the host \n\nlast {k}", "h", "x", 1) for k in range(40)] + [(100 + k, f"{own(100 + k)}\nshared line of the host", "g", "x", 1) for k in range(3)]
    rows += [(200, "short", "h", "x", 1), (201, None, None, "x", 1), (None, own(300) + "\nshared line of the host", "h", "x", 1), (5, rows[5][1], "h", "x", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, cut_lines string, changed int")
    kept = quality_rules.keep_good_documents(table)
    assert kept.columns == table.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    want = Counter((k, f"{own(k)}\n\nlast {k}") for k in range(40)) + Counter((100 + k, rows[40 + k][1]) for k in range(3)) + Counter([(None, own(300)), (5, f"{own(5)}\n\nlast 5")])
    assert got == want
    assert quality_rules.keep_good_documents(table.limit(0)).count() == 0
