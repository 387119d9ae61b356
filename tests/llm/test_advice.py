"""Cases in which operators once did less than their whole job."""

import numpy as np

from loomtide.llm import html_extract, quality_rules, spm_dropout


def test_line_blocks_decide_beside_articles():
    body = ["word " * 40, "more " * 30, "last words of the text"]
    divs = "".join(f"<div>{x}</div>" for x in body)
    want = "\n\n".join(" ".join(x.split()) for x in body)
    teasers = "<article><a href=1>Another story</a></article><article><a href=2>One more story</a></article>"
    comment = "<article class=\"comment\"><p>" + "me too " * 40 + "</p></article>"
    assert html_extract.main_text(f"<body>{divs}{teasers}{comment}</body>") == want
    assert html_extract.main_text(f"<body><main>{divs}</main>{comment}</body>") == want
    framed = "<article class=\"post has-comments\">" + divs.replace("<div>more", "<div><a href=3>Linked line</a></div><div>more") + "</article>"
    assert html_extract.main_text(f"<body>{framed}</body>") == want.replace("more", "Linked line\n\nmore", 1)
    assert html_extract.main_text("<main><p>x</p></main>" + "<div><a>l</a></div>" * 4 + f"<div>{body[0]}</div>") == body[0].strip()


def test_each_occurrence_draws(spark, monkeypatch):
    n = 20_000
    rows = [(1, " ".join(["a"] * n)), (2, " ".join(["extraordinary"] * 2_000)), *((10 + k, "a") for k in range(n))]
    got = {r.doc_id: r.ids for r in spm_dropout.encode_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(len(got[1]) / n - 1.1) < 0.01  # one merge a word, and a tenth of them are skipped
    assert abs(sum(len(got[10 + k]) for k in range(n)) / n - 1.1) < 0.01
    pieces = spm_dropout.load_pieces()
    words, word, size = set(), [], 0
    for i in got[2]:
        word.append(i)
        size += int(pieces.ends[i + 1] - pieces.ends[i])
        if size == len(" extraordinary"):
            words.add(tuple(word))
            word, size = [], 0
    assert len(words) > 8

    text = np.frombuffer("extraordinary words and words of an extraordinary kind ▁ 日本語 \x00 kind".encode("utf-32-le"), np.uint32)
    points, ends, keys = np.tile(text, 40), np.arange(41) * len(text), spm_dropout.mix(np.arange(40, dtype=np.uint64))
    together = spm_dropout.Coder(pieces, 0.1, 1).encode(points, ends, keys)
    monkeypatch.setattr(spm_dropout, "LONG_CHUNK", 1)  # every occurrence by the heap, with its own draws
    alone = spm_dropout.Coder(pieces, 0.1, 1).encode(points, ends, keys)
    assert np.array_equal(together[0], alone[0]) and np.array_equal(together[1], alone[1])


def test_frequent_lines_of_small_hosts(spark):
    def page(host, k, template):
        return "\n".join([*([" ".join(f"{host} template {j}" for j in range(30))] if template else []), " ".join(f"{host}{k}-{j}" for j in range(60))])

    rows = [(k, page("small", k, True), "small") for k in range(8)]
    rows += [(10 + k, page("rare", k, k < 3), "rare") for k in range(8)]  # in too few documents
    rows += [(100 + k, page("big", k, k < 20), "big") for k in range(200)]  # a tenth of the host
    rows += [(300 + k, page("wide", k, k < 8), "wide") for k in range(200)]  # under a twentieth
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_lost_words, r.base_failed, r.kept) for r in quality_rules.judge_documents(table).collect()}
    assert [got[k] for k in range(8)] == [(90, False, False)] * 8
    assert [got[10 + k] for k in range(8)] == [(0, False, True)] * 8
    assert [got[100 + k] for k in range(200)] == [(90, False, False)] * 20 + [(0, False, True)] * 180
    assert [got[300 + k] for k in range(200)] == [(0, False, True)] * 200
    assert {r.doc_id for r in quality_rules.keep_good_documents(table).collect()} == {k for k, v in got.items() if v[2]}
