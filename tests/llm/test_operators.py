"""Operators against brute force, and the same odd rows through each of them."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtide.llm import decontam, html_extract, line_dedup, minhash, quality_rules, rule_classifier, sharding, spm_dropout, suffix_dedup, warc

SCHEMA = "doc_id long, text string, source string, id string, th string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words, 80)) for _ in range(12)]
    out = []
    for k, t in enumerate(base):
        out += [t, t]
        for cut in (3, 8, 20):
            w = t.split()
            w[cut] = f"new{k}"
            out.append(" ".join(w))
    hub = base[0].split()
    for k in range(40):
        w = list(hub)
        for at in rng.choice(80, 1 + k % 5, replace=False):
            w[at] = f"x{k}-{at}"
        out.append(" ".join(w))
    return [*out, "", "\n\n", "   ", "one", "one two", "ONE two", "é" * 60, "é" * 60 + "b", "a" * 300, "long " * 20_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{k % 3}", "x", None) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (len(rows), None, None, None, None)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(None, "same line of text", None, None, None), (1, None, "s", None, None), (1, None, "s", None, None), (2, "same line of text", "s", "a", "b"), (2, "same line of text", "s", "a", "b"), (3, "Same line of text ", "s", "a", "b")], SCHEMA)


def pairs(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def groups_of(docs, width):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for d, t in pairs(docs).items():
        w = WORD.findall(t.translate(lower))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("small", [32, 2])
def test_near_duplicates(docs, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == groups_of(docs, 4)


@pytest.mark.parametrize("crowded", [8192, 3])
def test_suffix_dedup(docs, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED_GRAM", crowded)
    first = {}
    rows = sorted((d, t.encode()) for d, t in pairs(docs).items())
    for d, b in rows:
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for d, b in rows:
        covered = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                covered[i : i + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~covered[:-1]])
        spans = int((covered[:-1] & ~np.concatenate([[False], covered[:-2]])).sum()) if b else 0
        assert (got[d].n_removed, got[d].n_spans, got[d].kept_sha256, bytes(got[d].kept)) == (len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)


def test_sharding(docs):
    rows = sharding.shard_documents(docs).collect()
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows)


def test_leaks(spark, docs):
    base = texts()[0]
    items = spark.createDataFrame([(1, base), (2, base[:40].upper()), (3, "never seen words in any text"), (4, None), (5, ""), (6, "one two")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()}
    held = {d for d, t in pairs(docs).items() if base in t}
    assert {(d, 1) for d in held} <= found and {(d, 2) for d in held} <= found
    assert {i for _, i in found} == {1, 2, 6}
    assert decontam.find_leaks(docs, items.limit(0)).count() == 0


def test_round_trip(docs):
    encoded = spm_dropout.encode_documents(docs, dropout=0.3, seed=5)
    assert {r.doc_id: r.text for r in spm_dropout.decode_documents(encoded).collect()} == pairs(docs)
    other = {r.doc_id: r.ids for r in spm_dropout.encode_documents(docs, dropout=0.3, seed=6).collect()}
    assert any(other[r.doc_id] != r.ids for r in encoded.collect())
    odd = ["▁", " ▁ a", "\x00\n\t", "日本語テキスト", "a" * 200, "  "]
    coder = spm_dropout.Coder(spm_dropout.load_pieces(), 0.2, 1, 8)
    for t in odd:
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        ids, ends = coder.encode(points, np.array([0, len(points)]), np.array([3], np.uint64))
        assert coder.decode(ids, ends)[0].tobytes().decode() == t


def test_html():
    page = "<html><body><nav><a href=x>Home</a></nav><div class='ad'>Buy now</div><article><h1>Title</h1><p>One &amp; <b>two</b><br>three</p><div class=comments><p>me too</p></div></article><footer>&copy; x</footer><script>var t='</p>'</script>"
    assert html_extract.main_text(page) == "Title\n\nOne & two three"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p>") == ""
    plain = "<ul><li><a>x</a></li></ul><div>" + "word " * 40 + "</div><p>" + "more " * 30 + "</p><div class=footer>f</div>"
    assert html_extract.main_text(plain) == " ".join(["word"] * 40) + "\n\n" + " ".join(["more"] * 30)


def test_warc(spark, tmp_path):
    rows = [(3, "http://a", "x" * 200), (1, None, "x" * 200), (2, "u v", "short"), (4, "u", "short"), (5, "u", None), (5, "u", None)]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/a")
    read = warc.read_archive(spark, f"file://{tmp_path}/a")
    got = sorted((r.page, r.record_type, r.refers_to, r.payload_bytes, r.verified) for r in read.collect())
    assert got == [(1, "response", None, 200, True), (2, "response", None, 5, True), (3, "revisit", 1, 200, True), (4, "response", None, 5, True), (5, "response", None, 0, True), (5, "response", None, 0, True)]
    record = {r.page: bytes(r.record) for r in warc.record_bytes(read).collect()}
    assert record[1].startswith(b"WARC/1.1\r\n") and record[1].endswith(b"\r\n\r\n" + b"x" * 200 + b"\r\n\r\n") and b"Content-Length: 0\r\n" in record[3]


def test_odd_rows(spark, odd):
    lines = line_dedup.dedup_lines(odd).collect()
    assert sorted((str(r.doc_id), r.text) for r in lines) == [("1", ""), ("1", ""), ("2", "same line of text"), ("2", "same line of text"), ("3", ""), ("None", "same line of text")]
    assert [r.kept for r in minhash.near_duplicates(odd).where("doc_id = 3").collect()] == [False]
    assert minhash.drop_near_duplicates(odd).count() == 3
    assert quality_rules.judge_documents(odd).where("kept").count() == 0
    assert suffix_dedup.remove_repeats(odd).count() == sharding.shard_documents(odd).count() == 6
    model = rule_classifier.train(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in rule_classifier.score_documents(odd, model).collect()} == {0.5}
    empty = odd.limit(0)
    for f in (line_dedup.dedup_lines, minhash.near_duplicates, quality_rules.judge_documents, suffix_dedup.remove_repeats, sharding.shard_documents, spm_dropout.round_trips, rule_classifier.text_features):
        assert f(empty).count() == 0


def test_frequent_lines(spark):
    boiler = "the same notice on each page of this host"
    rows = [(k, " ".join(f"w{k}-{j}" for j in range(60)) + "\n" + boiler * (1 if k < 50 else 0), "h") for k in range(100)]
    rows += [(200, "\n".join(f"{boiler}" for _ in range(1)) + " ", "h")]
    got = {r.doc_id: (r.n_lost_words, r.kept) for r in quality_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == (9, True) and got[70] == (0, True) and got[200] == (9, False)


def test_classifier(spark):
    rng = np.random.default_rng(1)
    good = [(k, " ".join(f"w{x}" for x in rng.integers(0, 500, 60)), 1) for k in range(120)]
    bad = [(200 + k, " | ".join("SPAM!!" for _ in range(30)), 0) for k in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = rule_classifier.train(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    scored = rule_classifier.score_documents(table, model).join(table, "doc_id").where("held_out")
    assert scored.where(F.col("predicted") != F.col("quality")).count() == 0
