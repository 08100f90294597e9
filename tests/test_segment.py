import itertools
import math

import numpy as np
import pytest

from odflux.operators import segment, text

WORDS = [("ab", 30), ("abc", 4), ("c", 9), ("ca", 7), ("b", 5), ("bca", 6), ("a", 12), ("北京", 20), ("京大", 3), ("大学", 15), ("北京大学", 2)]


def solve(docs, words=WORDS):
    spark = docs.sparkSession
    known = spark.createDataFrame(words, "word string, cnt long")
    return {r["id"]: r["tokens"] for r in segment.segment(docs, "id", "t", known).collect()}


def brute(run, words=WORDS):
    """Cheapest of all splits."""
    total = sum(n for _, n in words)
    cost = {w: math.floor(1000 * math.log(total / n)) for w, n in words}
    unknown = math.floor(1000 * math.log(total)) + 1000
    ways = []
    for cuts in itertools.product([False, True], repeat=len(run) - 1):
        edges = [0] + [i + 1 for i, c in enumerate(cuts) if c] + [len(run)]
        parts = [run[a:b] for a, b in zip(edges, edges[1:])]
        if all(p in cost or len(p) == 1 for p in parts):
            ways.append((sum(cost.get(p, unknown) for p in parts), [-len(p) for p in parts], parts))
    return min(ways)[2]


def test_segments_are_the_cheapest_of_all_splits(spark):
    rng = np.random.default_rng(2)
    runs = ["".join(rng.choice(list("abcx"), n)) for n in rng.integers(1, 11, 60)] + ["北京大学", "我北京大学京大", "ABCa"]
    docs = spark.createDataFrame(list(enumerate(runs)), "id int, t string")
    assert solve(docs) == {i: brute(r.lower()) for i, r in enumerate(runs)}


def test_separators_nulls_and_unknown_words(spark):
    rows = [(1, "ab, cab!  abc"), (2, None), (3, ""), (4, " -- "), (5, "ab, cab!  abc"), (6, "zz")]
    got = solve(spark.createDataFrame(rows, "id int, t string"))
    assert got[1] == got[5] == brute("ab") + brute("cab") + brute("abc")
    assert got[2] == got[3] == got[4] == [] and got[6] == ["z", "z"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id int, t string")
    assert solve(none) == {}
    assert solve(spark.createDataFrame([(1, "ab c")], "id int, t string"), []) == {1: ["a", "b", "c"]}


def test_a_very_long_run(spark):
    docs = spark.createDataFrame([(1, "abcab" * 20_000)], "id int, t string")
    got = solve(docs)[1]
    assert "".join(got) == "abcab" * 20_000 and set(got) <= {w for w, _ in WORDS}


def test_word_statistics_of_segments(spark):
    docs = spark.createDataFrame([(1, "北京大学"), (2, "大学北京"), (3, None)], "id int, t string")
    known = spark.createDataFrame([("北京", 5), ("大学", 5)], "word string, cnt long")
    cut = segment.segment(docs, "id", "t", known)
    count = text.word_count(cut, "tokens", min_count=1, segmenter=segment.as_words)
    assert {(r["word"], r["cnt"]) for r in count.collect()} == {("北京", 2), ("大学", 2)}
    tf = text.tf_vector(cut, "id", "tokens", count, segmenter=segment.as_words)
    assert {(r["id"], r["word"]): r["tf"] for r in tf.collect()} == pytest.approx(
        {(i, w): 0.5 for i in (1, 2) for w in ("北京", "大学")}
    )
