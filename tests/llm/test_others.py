"""Search, pages, conversations, and the pipeline."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from odflux.llm import chat, html_text, topk


# --- Search

def test_search_against_all_scores(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.2, (700, 12)).tolist()
    rows = [(k, v) for k, v in enumerate(vectors)] + [(1000 + k, vectors[5]) for k in range(40)]
    bad = [(2001, None), (2002, [None] * 12), (2003, [float("nan")] * 12), (2004, [float("inf")] + [0.0] * 11), (None, vectors[0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    got = {}
    for r in topk.top_k(topk.quantized(table), F.col("id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, m = np.array([k for k, _ in rows]), np.floor(256 * np.array([v for _, v in rows])).astype(int)
    for k in ids[ids % 50 == 0]:
        scores = m @ m[list(ids).index(k)]
        best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != k)[:5]
        assert sorted(got[k]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert set(got) == set(ids[ids % 50 == 0].tolist())


def test_search_of_few_and_of_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(topk.quantized(table), F.col("id") % 50 == 0).collect()] == [(0, 1, 3, 131072)]
    assert topk.top_k(topk.quantized(table.limit(0)), F.col("id") % 50 == 0).count() == 0


# --- Pages

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies.</div>%s<aside>Related things</aside>
<section id="comments"><p>A reader says a lot of things here, really a lot of things.</p></section>
<form><label>Name</label><input></form><footer>&copy; Nobody</footer></body></html>"""
TEXT = "<h1>A  title &amp; more</h1><p>First <b>long</b> paragraph, with\nmany words in it.<br>And a line.<p>Short.<ul><li>x<li>y</ul>"
EXPECTED = "A title & more\n\nFirst long paragraph, with many words in it. And a line.\n\nShort.\n\nx\n\ny"


@pytest.mark.parametrize("body", [
    f"<article>{TEXT}</article>", f"<main><div>{TEXT}</div></main>", f"<div id=content>{TEXT}</div>",
    f"<article><header><span></span></header>{TEXT}<div class='share buttons'>Share this</div></article>",
])
def test_main_text(body):
    assert html_text.main_text(PAGE % body) == EXPECTED


def test_pages_that_are_hardly_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<<<"), (4, "u", "plain text"), (None, "u", "<p>a<p>b</div></b>"), (5, "u", "<nav>x</nav>"),
            (6, "u", "<p>" + "word " * 50000 + "</p>"), (5, "u", "<nav>x</nav>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(table).collect()}
    assert got[1] == got[2] == got[5] == ("", 0) and got[4] == ("plain text", 10) and got[None] == ("a\n\nb", 4)
    assert got[6][1] == 5 * 50000 - 1 and html_text.extract(table.limit(0)).count() == 0


# --- Conversations

def test_format_is_read_back(spark):
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", hard), (1, 0, "user", "<||im_end|> <| <||"), (2, 0, "assistant", None), (2, 1, "us\\er\nx", "t"),
            (None, 0, "user", "q"), (None, 1, "assistant", "<|"), (3, None, None, ""), (4, 0, "user", "a"), (4, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.segments(table)).collect()}
    assert len(got) == 5
    order = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        order.setdefault(c, []).append((role or "", text or ""))
    for c, turns in order.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert {c for c in got if got[c]["valid"]} == {1, None}
    assert chat.read_back(chat.segments(table.limit(0))).count() == 0


# --- Pipeline

def test_pipeline_keeps_columns_and_rows(spark, corpus, nothing):
    for table in (corpus, nothing):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


def test_near_duplicate_stage_keeps_one_of_a_group(spark, corpus):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, "en", "a", 1), (2, text, "en", "a", 1), (2, text, "en", "a", 1), (7, text.upper(), "en", "b", 1), (8, "other", None, None, 1),
            (None, "alone", "en", "a", 1), (2, "same id, other words", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or -1, r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted([(2, text), (2, "same id, other words"), (8, "other"), (-1, "alone")])
