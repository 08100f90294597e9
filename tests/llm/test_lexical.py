"""Ranked search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from odflux.llm import lexical
from odflux.llm.lexical import build, rank

DOCS = "doc_id long, text string, n string, item_id long, score string"
ITEMS = "item_id long, text string, `block` string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return TERM.findall((text or "").translate(lower))


def plain(docs, items, k=10):
    """[(item_id, rank, doc_id, score)], all pairs scored."""
    texts = [(d, Counter(cut(t))) for d, t in docs]
    texts = [(d, c) for d, c in texts if c]
    total, df = sum(sum(c.values()) for _, c in texts), Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in texts:
            m = 25 + (75 * sum(c.values()) * len(texts)) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in cut(text) if t in c
            )
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(13)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÀB", "x1", "日本"]

    def text(n):
        return rng.choice([" ", ", ", "-"]).join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(n))

    docs = [(i, text(rng.randint(1, 60))) for i in range(200)]
    docs += [(i, docs[7][1]) for i in range(200, 260)]  # one text, many times
    docs += [docs[3], docs[3], (3, "another text under the same id w5"), (None, docs[7][1]), (None, "w1 w2")]
    docs += [(300, None), (301, ""), (302, " ,.\n"), (303, "w9 " * 170), (304, "w9 " * 5000), (305, text(9000)), (306, "\x00w1\x7fw2")]
    items = [(i, text(rng.randint(1, 30))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "nowhere"), (33, docs[7][1]), (34, "W9 w9 w9 nowhere"), (1, "w1 w2 w3"), (None, "w4"), (35, text(400))]
    return docs, items


def frames(spark, docs, items):
    rows = [(*d, "clash", 5, "clash") for d in docs]
    return spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame([(*i, "clash") for i in items], ITEMS)


@pytest.mark.parametrize("pairs", [lexical.BLOCK_PAIRS, 600])
def test_ranking_equals_all_pairs(spark, monkeypatch, tables, pairs):
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", pairs)
    docs, items = frames(spark, *tables)
    got = [tuple(r) for r in rank(build(docs), items).collect()]
    order = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got, key=order) == sorted(plain(*tables), key=order)


def test_nothing_to_rank(spark, tables):
    docs, items = frames(spark, *tables)
    assert rank(build(docs.limit(0)), items).collect() == []
    assert rank(build(docs), items.limit(0)).collect() == []
    assert rank(build(docs), items.where("item_id in (30, 31, 32)")).collect() == []


@pytest.fixture(scope="module")
def large():
    """A block and an index batch of many documents, outside Spark."""
    rng = random.Random(5)
    texts = [" ".join(f"t{int(rng.paretovariate(0.6)) % 5000}" for _ in range(rng.randint(20, 400))) for _ in range(800)]
    index = next(lexical._index(iter([pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(texts)], names=["doc_id", "text"])])))
    found = [Counter(cut(t)) for t in texts]
    df = Counter(t for c in found for t in c)
    rows = [
        (k, t, n, math.floor(1000 * math.log(1602 / (2 * df[t] + 1))))
        for k in range(20) for t, n in Counter(cut(" ".join(texts[k].split()[:30]))).items()
    ]
    asked = pa.table(dict(zip(("item", "term", "times", "weight"), (list(c) for c in zip(*rows)))))
    return lexical.Block(asked), index, found


def _m(n):
    return 25 + (75 * n) // 200


def test_bounds_are_never_below_scores(large):
    block, index, found = large
    n = index.column("n").to_numpy()
    top = lexical.bounds(block, index, n, _m(n))
    exact = np.array([[lexical.exact(p, c, int(_m(k))) for p in block.pairs] for c, k in zip(found, n)])
    assert (top >= exact).all() and exact.max() > 0


def test_search_scores_few_pairs(large):
    block, index, found = large
    search = lexical.Search(block, np.zeros(len(block.items), np.int64), 5)
    search.feed(index, _m)
    assert search.scored < 0.2 * search.seen
    n = index.column("n").to_numpy()
    for i, best in enumerate(search.best):
        scores = [(-lexical.exact(block.pairs[i], c, int(_m(k))), False, d) for d, (c, k) in enumerate(zip(found, n))]
        assert best == sorted(s for s in scores if s[0] < 0)[:5]


def test_cells_round_counts_up():
    counts = np.array([1, 160, 161, 170, 255, 1000, 20000, 400000, 10**9])
    cells = lexical._cells(counts)
    assert (lexical._cell_counts()[cells] >= counts).all() and (np.diff(cells.astype(int)) >= 0).all()
