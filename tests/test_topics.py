import numpy as np
import pytest
from pyspark.sql import functions as F

from odflux.operators import text, topics

SCHEMA = "doc long, word string, tf double"


def table(spark, rows, docs):
    """Documents and weights of {doc: {word: weight}}."""
    return (
        spark.createDataFrame([(d,) for d in docs], "doc long"),
        spark.createDataFrame([(d, w, v) for d, ws in rows.items() for w, v in ws.items()], SCHEMA),
    )


def matrix(rows, docs):
    words = sorted({w for ws in rows.values() for w in ws})
    m = np.zeros((len(docs), len(words)))
    for i, d in enumerate(docs):
        for w, v in rows.get(d, {}).items():
            m[i, words.index(w)] = v
    return m


def random_documents(n=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = {}
    for d in range(n):
        group = d % 3
        words = rng.choice([f"g{group}w{i}" for i in range(8)] + ["common"], 4, replace=False)
        share = rng.dirichlet(np.ones(4))
        rows[d] = dict(zip(words, share.tolist()))
    return rows, list(range(n)) + [1000, 1001]  # the last two have no word


def found(docs, weights, k, **options):
    return {r["doc"]: r["topic"] for r in topics.kmeans_topics(docs, weights, "doc", k, **options).collect()}


def test_documents_are_at_their_nearest_centre(spark):
    rows, names = random_documents()
    got = found(*table(spark, rows, names), 5, max_iter=60)
    assert sorted(got) == names and set(got.values()) <= set(range(5))
    m, label = matrix(rows, names), np.array([got[d] for d in names])
    kinds = sorted(set(got.values()))
    centres = np.array([m[label == c].mean(axis=0) for c in kinds])
    far = ((m[:, None, :] - centres[None]) ** 2).sum(axis=2)
    own = far[np.arange(len(names)), [kinds.index(c) for c in label]]
    assert np.all(own <= far.min(axis=1) + 1e-8)
    # Better than one topic for all.
    assert own.sum() < 0.8 * ((m - m.mean(axis=0)) ** 2).sum()


def test_topics_do_not_depend_on_partitions(spark):
    docs, weights = table(spark, *random_documents())
    assert found(docs, weights, 6) == found(docs.repartition(7), weights.repartition(5, "word"), 6)


def test_more_topics_than_a_block(spark):
    rows = {d: {f"w{d}": 1.0} for d in range(40)}
    got = found(*table(spark, rows, range(40)), 40)
    assert sorted(got.values()) == list(range(40))


def test_separate_vocabularies_are_separate_topics(spark):
    rows = {d: {f"{'ab'[d % 2]}{i}": 0.25 for i in range(4)} for d in range(20)}
    got = found(*table(spark, rows, range(20)), 2)
    assert {got[d] for d in range(0, 20, 2)} != {got[d] for d in range(1, 20, 2)}
    assert len(set(got.values())) == 2


def test_fewer_kinds_of_documents_than_topics(spark):
    rows = {d: {"x": 1.0} if d < 6 else {"y": 1.0} for d in range(9)}
    got = found(*table(spark, rows, list(range(9)) + [50]), 8)  # x, y and a document without words
    assert len({got[0], got[6], got[50]}) == 3 and len(set(got.values())) == 3


def test_no_documents_and_no_weights(spark):
    docs, weights = table(spark, {}, [])
    assert found(docs, weights, 3) == {}
    docs, weights = table(spark, {}, [4, 5])
    assert found(docs, weights, 3) == {4: 0, 5: 0}


def test_a_hundred_thousand_words(spark):
    docs = spark.range(500).select(F.col("id").alias("doc"))
    weights = docs.select("doc", F.explode(F.sequence(F.lit(0), F.lit(200))).alias("i")).select(
        "doc", F.when(F.col("i") == 200, F.concat(F.lit("side"), F.col("doc") % 2))
        .otherwise(F.concat_ws("-", F.lit("w"), "doc", "i")).alias("word"),
        F.when(F.col("i") == 200, 0.5).otherwise(0.0025).alias("tf"),
    )
    assert weights.select("word").distinct().count() == 100_002
    got = found(docs, weights, 2, seed=1, max_iter=10)
    assert len({got[d] for d in range(0, 500, 2)}) == len({got[d] for d in range(1, 500, 2)}) == 1
    soft = topics.soft_topics(docs, weights, "doc", k=2, dims=4, max_iter=5)
    assert soft.count() == 500


def test_matrix_of_found_topics_is_their_centres(spark):
    rows = [(k, " ".join(["red", "sun"] * (1 + k % 3) + ["sky"]) if k % 2 else "cold sea") for k in range(20)]
    posts = spark.createDataFrame(rows, "doc long, title string")
    vocabulary = text.word_count(posts, "title", min_count=0)
    weights = text.tf_vector(posts, "doc", "title", vocabulary)
    label = topics.kmeans_topics(posts, weights, "doc", 2)
    got = {r["word"]: (r["K0"], r["K1"]) for r in text.topic_word_matrix(weights, label, vocabulary, "doc", 2).collect()}
    cold = next(r["topic"] for r in label.collect() if r["doc"] == 0)
    assert got["cold"][cold] == got["sea"][cold] == pytest.approx(0.5) and got["cold"][1 - cold] == 0
    assert got["red"][1 - cold] > got["sky"][1 - cold] > 0


def test_projection_keeps_distances(spark):
    rows, names = random_documents(30, seed=5)
    docs, weights = table(spark, rows, names)
    dims = 400
    wide = topics.project(docs, weights, "doc", dims).collect()
    p = np.array([r["reduced"] for r in sorted(wide, key=lambda r: names.index(r["doc"]))])
    m = matrix(rows, names)
    assert p.shape == (32, dims) and not p[-1].any()
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    true = ((m[:, None] - m[None]) ** 2).sum(axis=2)
    big = true > 0.05
    assert np.abs(near[big] / true[big] - 1).max() < 0.5 and abs((near[big] / true[big]).mean() - 1) < 0.05


def test_memberships_sum_to_one(spark):
    rows, names = random_documents()
    docs, weights = table(spark, rows, names)
    out = topics.soft_topics(docs, weights, "doc", k=3, dims=4, max_iter=5).collect()
    p = np.array([r["probability"] for r in out])
    assert sorted(r["doc"] for r in out) == names and np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert out[0]["topic"] == int(p[0].argmax())


def test_texts_are_placed_by_their_bytes_and_counted_there(spark):
    posts = spark.range(300).select(F.col("id").alias("doc"), F.repeat(F.lit("red sun "), 50).alias("title"))
    assert text.text_parts(posts, "title", 4000) == 30 and text.text_parts(posts.limit(0), "title") == 8
    vocabulary = text.word_count(posts, "title", min_count=0)
    weights = text.tf_vector(text.place_texts(posts, "doc", "title", 30), "doc", "title", vocabulary)
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc" in plan and plan.count("REPARTITION_BY_NUM") == 1 and "REPARTITION_BY_COL" not in plan
    assert weights.where("tf = 0.5").count() == 600
    assert weights.select(F.spark_partition_id().alias("p")).distinct().count() > 20


def test_packed_products_are_those_of_the_weights(spark):
    rows = [(d, f"w{i}", (d * 7 + i * 13) % 11 + 1) for d in range(50) for i in range(40) if (d + i) % 3]
    x = spark.createDataFrame(rows, "doc long, word string, x long")
    centres = [(t, f"w{i}", t * i + (1 << 40)) for t in (0, 5, 33) for i in range(0, 40, 2)]
    packs = topics._Packs(x, "doc")
    assert packs.rows.count() < 50
    got = packs.dots(spark.createDataFrame(centres, "topic int, word string, w long")).collect()
    want = {}
    for d, word, v in rows:
        for t, other, w in centres:
            if word == other:
                want[d, t] = want.get((d, t), 0) + v * w
    assert {(r["doc"], r["block"] * 32 + j): r[f"_{j}"] for r in got for j in range(32) if r[f"_{j}"]} == want


def test_weights_stay_where_they_lie(spark):
    docs, weights = table(spark, *random_documents())
    x = weights.select("doc", "word", (F.col("tf") * 1000).cast("long").alias("x")).where("x > 0")
    packs = topics._Packs(x, "doc", docs)
    centres = packs.means(packs.drawn([0, 1, 2]), 3, None)
    plan = centres._jdf.queryExecution().executedPlan().toString()
    met = plan[plan.index("FlatMapCoGroupsInArrow"):]
    assert "odflux_packs" in met and met.split("odflux_packs")[0].count("Exchange") == 0
    assert {r["topic"] for r in packs.nearest(centres, 3).select("best.topic").collect()} <= {0, 1, 2}


def test_centres_are_whole_means_in_every_block(spark, monkeypatch):
    monkeypatch.setattr(topics, "WORDS", 4)  # several blocks of words
    monkeypatch.setattr(topics, "LEAST", 16)  # and parts
    monkeypatch.setattr(topics, "SUMS", 256)  # sums meet in several groups a block
    rows, names = random_documents()
    docs, weights = table(spark, rows, names)
    x = weights.select("doc", "word", F.floor(F.col("tf") * topics.STEPS).cast("long").alias("x")).where("x > 0")
    packs = topics._Packs(x, "doc", docs)
    assert packs.blocks > 3 and len(packs.labels) > 3
    first = packs.drawn([3, 1])
    label = {r["doc"]: r["topic"] for r in packs.nearest(first, 2).select("doc", "best.topic").collect()}
    whole = {(r["doc"], r["word"]): r["x"] for r in x.collect()}
    want = {}
    for t in (0, 1):
        members = [d for d in names if label[d] == t]
        for word in {w for d, w in whole}:
            want[t, word] = sum(whole.get((d, word), 0) for d in members) // len(members)
    places = packs.words.mapInArrow(topics._places, "h long, block int, place int")
    word = {(r["block"], r["place"]): r["word"] for r in x.select("word", packs._hash()).distinct().join(places, "h").collect()}
    got = {}
    for r in packs.means(first, 2, None).collect():
        for place, ws in enumerate(np.frombuffer(r["w"], np.int32).reshape(-1, 2).tolist()):
            got.update({(t, word[r["block"], r["start"] + place]): w for t, w in enumerate(ws)})
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_blocks_and_parts_do_not_change_topics(spark, monkeypatch):
    docs, weights = table(spark, *random_documents())
    whole = found(docs, weights, 5, max_iter=3)
    for name, value in (("WORDS", 4), ("LEAST", 16), ("SHORT", 3), ("CHUNK", 5), ("SUMS", 320)):
        monkeypatch.setattr(topics, name, value)
    assert found(docs, weights, 5, max_iter=3) == whole


def test_a_text_is_split_once(spark):
    posts = spark.createDataFrame([(i, "red sun " * 5) for i in range(30)] + [(30, " ")], "doc long, title string")
    vocabulary = text.word_count(posts, "title", min_count=0)
    kept = spark.createDataFrame([("red",)], "word string")
    weights = text.tf_vector(text.place_texts(posts, "doc", "title", 3), "doc", "title", kept)
    assert weights._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {(r["word"], r["cnt"]) for r in vocabulary.collect()} == {("red", 150), ("sun", 150)}
    assert [r["tf"] for r in weights.collect()] == [1.0] * 30


def test_found_topics_are_counted_and_leave_no_setting(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    rows = [(k, "red sun" if k % 2 else "cold sea", "here", "2020-01-05") for k in range(12)]
    posts = spark.createDataFrame(rows, "doc long, title string, city string, startdate string")
    weights = text.tf_vector(posts, "doc", "title", text.word_count(posts, "title", min_count=0))
    label = topics.kmeans_topics(posts, weights, "doc", 2)
    got = text.topic_counts(posts.join(label, "doc")).collect()
    assert sorted((r["name"], r["time"], r["cnt"]) for r in got) == [("here", "202001", 6)] * 2
    assert spark.conf.get(name, None) == before


def test_a_query_counts_its_vocabulary_once(spark, monkeypatch):
    from odflux.catalog import texts
    from odflux.catalog.inputs import Tables

    calls, count = [], text.word_count
    monkeypatch.setattr(text, "word_count", lambda *a, **k: calls.append(a) or count(*a, **k))
    posts = spark.createDataFrame([(i, "red sun") for i in range(200)], "doc_id long, title string")
    monkeypatch.setattr(Tables, "post", lambda self: posts)
    t = Tables(spark, "unused")
    assert {r["word"] for r in texts._vocabulary(t).collect()} == {"red", "sun"}
    assert texts._vocabulary(t).count() == 2 and len(calls) == 1
