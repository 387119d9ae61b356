"""Exact copies against a plain grouping."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtide.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, digest string, kept int"


def plain(rows):
    norm = [re.sub(r"[ \x09-\x0d]+", " ", t or "") for _, t in rows]
    least, sizes = {}, Counter(norm)
    for (i, _), t in zip(rows, norm):
        if i is not None and (least.get(t) is None or i < least[t]):
            least[t] = i
    return sorted(((i, least.get(t), sizes[t], i == least.get(t), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm)), key=str)


def found(out):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()), key=str)


ROWS = [
    *((1000 - k, "the hot\ttext " if k % 2 else "the hot  text\n") for k in range(400)), *((2000 + k, f"text {k // 3}") for k in range(300)), *((3000 + k, None) for k in range(5)), (2999, ""),
    (1, "long " * 60_000), (2, "long\n" * 60_000), (7, "same"), (7, "same"), (None, "same"), (None, "alone"), (None, "alone"), (5, " x"), (6, "x"), (8, " x"), (9, "X"),
]


@pytest.mark.parametrize("support", [1 / 1024, 0.1, 0.9])
def test_groups_equal_plain_grouping(spark, support):
    docs = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in ROWS], SCHEMA).repartition(7)
    out = exact_dedup.exact_groups(docs, support=support)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert found(out) == plain(ROWS)


def test_misra_gries_names_every_frequent_digest(spark):
    rows = [(k, f"common {k % 3}" if k % 2 else f"rare {k}") for k in range(6000)]
    digests = exact_dedup.digests_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), "doc_id", "text")
    names = {r.digest.hex() for r in exact_dedup.frequent_candidates(digests, 0.05).select(F.col("digest")).collect()}
    assert {hashlib.sha256(f"common {k}".encode()).hexdigest() for k in range(3)} <= names and len(names) <= 20


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in ROWS], SCHEMA)
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn|ExistingRDD", plan)


def test_empty_table(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert exact_dedup.drop_exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dropping_keeps_columns_and_one_row_of_each_text(spark):
    docs = spark.createDataFrame([(i, t, f"k{i}", "b", 1) for i, t in ROWS], SCHEMA)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    want = {(keep, sha) for _, keep, _, _, sha in plain(ROWS)}
    got = [(r.doc_id, hashlib.sha256(re.sub(r"[ \x09-\x0d]+", " ", r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want
