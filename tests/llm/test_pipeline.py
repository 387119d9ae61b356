"""The pipeline from end to end against plain Python, and op6, op9 and op10 on odd rows."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from loomtide.llm import rule_classifier, spm_dropout, warc
from tests.llm.test_decontam import brute
from tests.llm.test_sharding_quality import statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return line.strip(BLANKS).translate(LOWER)


def quality(docs):
    hosts, holders = Counter(d[3] for d in docs), defaultdict(set)
    for i, text, _, host in docs:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders[host, key_of(line)].add(i)
    sizes = {h: len({d[0] for d in docs if d[3] == h}) for h in hosts}
    gone = {k for k, v in holders.items() if len(v) > 3 and len(v) > 0.05 * sizes[k[0]]}
    out = []
    for i, text, lang, host in docs:
        n, _, _, _, repeated = statistics(text)
        lost = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if (host, key_of(x)) in gone)
        if n >= 50 and 100 * repeated <= 50 * n and n - lost >= 0.5 * n:
            out.append((i, "\n".join(x for x in text.split("\n") if (host, key_of(x)) not in gone), lang, host))
    return out


def lines(docs):
    holders = defaultdict(set)
    for i, text, _, _ in docs:
        for line in text.split("\n"):
            holders[key_of(line)].add(i)
    stays = lambda i, x: len(key_of(x)) < 10 or min(holders[key_of(x)]) == i
    return [(i, "\n".join(x for x in text.split("\n") if stays(i, x)), lang, host) for i, text, lang, host in docs]


def near(docs):
    sets = {}
    for i, text, _, _ in docs:
        w = WORD.findall(text.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return [d for d in docs if find(d[0]) == d[0]]


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(500)]
    text = lambda n: "\n".join(" ".join(rng.choice(words, 12)) for _ in range(n))
    items = [(k, " ".join(rng.choice(words, 25))) for k in range(4)]
    docs = []
    for k in range(90):
        body = text(8)
        if k % 6 == 0:
            body += "\nshared notice of this host and nobody else"
        if k % 9 == 0:
            body += "\n" + items[k % 4][1]
        if k % 10 == 3:
            body = docs[-2][1] + " end"
        if k % 13 == 0:
            body += "\na line that several documents of all hosts hold " + str(k % 2)
        docs.append((k, body, "en", f"h{k % 3}"))
    docs += [(200, None, None, "h0"), (201, "", "en", None), (202, "short text", "en", "h1"), (203, "la la la " * 40, "en", "h1"), (204, text(300), "de", None)]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    kept = near(lines(quality(docs)))
    leaks = {d for d, _ in brute([d[:2] for d in kept], items)}
    want = {d[0]: d[1] for d in kept if d[0] not in leaks}
    assert leaks and len(want) < len(docs) - 5
    assert {i: r.text for i, r in got.items()} == want
    assert {r.doc_id: r.text for r in spm_dropout.decode_documents(spark.createDataFrame([(i, r.ids) for i, r in got.items()], "doc_id long, ids array<int>")).collect()} == want
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, f"file://{tmp_path}")
        assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_dropout_against_the_library(spark):
    import sentencepiece

    model = "/opt/tokenizers/piece_bpe_32k.model"
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ["one two three", " two  blanks ", "Ünïcödé 日本語 text", "", None, "x" * 3000, "line\nbreaks\tand tabs", "repeat " * 200]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    got = [(r.doc_id, r.ids) for r in spm_dropout.encode_documents(docs, dropout=0.0).collect()]
    assert sorted(got) == sorted((k, sp.encode(t) if t else []) for k, t in [*enumerate(texts), (0, texts[0])])
    twice = [r.ids for r in spm_dropout.encode_documents(docs, dropout=0.5).where("doc_id = 0").collect()]
    assert twice[0] == twice[1]


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = rule_classifier.score_documents(docs, rule_classifier.train(docs, labels, max_rows=20_000), threshold=0.3)
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    wins = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert wins > 0.95 and np.mean([r.predicted == r.quality for r in rows]) > 0.9
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x " * 50_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in rule_classifier.score_documents(odd, rule_classifier.train(docs.limit(500), labels)).collect())


def test_archives_of_odd_pages(spark, tmp_path):
    schema = "page_id long, url string, html string, digest string"
    pages = spark.createDataFrame([(None, "u", "y" * 200, "d"), (5, "a\r\nb", "y" * 200, "d"), (5, "c", "y" * 200, None), (6, None, "z" * 2_000_000, "d")], schema)
    warc.write_archive(pages, f"file://{tmp_path}/a")
    rows = warc.read_archive(spark, f"file://{tmp_path}/a").collect()
    assert sorted((str(r.page), r.record_type, str(r.refers_to), r.verified) for r in rows) == [("5", "response", "None", True), ("5", "response", "None", True), ("6", "response", "None", True), ("None", "revisit", "5", True)]
    warc.write_archive(pages.limit(0), f"file://{tmp_path}/empty")
    assert warc.read_archive(spark, f"file://{tmp_path}/empty").count() == 0
    warc.write_warc_files(warc.read_archive(spark, f"file://{tmp_path}/a"), f"file://{tmp_path}/files")
    assert spark.read.text(f"file://{tmp_path}/files", lineSep="WARC/1.1\r\n").where("length(value) > 0").count() == 4
