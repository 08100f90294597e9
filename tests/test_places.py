import hashlib

import pytest

from odflux.operators import places

AREA = "word string, province string, city string, region string, level int, x double, y double, original_level int"


@pytest.fixture
def areas(spark):
    return spark.createDataFrame(
        [
            ("red", "P1", None, None, 0, 0.0, 0.0, 0),
            ("red widget", "P1", "C1", None, 1, 5.0, 5.0, 1),
            ("widget", "P2", "C2", None, 1, 9.0, 9.0, 1),
            ("ring", "P1", "C3", None, 1, 1.0, 1.0, 1),
            ("ring", "P3", "C4", None, 1, 2.0, 2.0, 1),
            ("crimson", "P1", None, None, 0, 0.0, 0.0, 0),
            ("rod", "P1", "C1", "R1", 2, 6.0, 6.0, 2),
            ("near", "P4", "C7", None, 1, 1.0, 0.0, 1),
            ("near", "P5", "C8", None, 1, 3.0, 0.0, 1),
        ],
        AREA,
    )


def match(spark, areas, text, x=0.0, y=0.0, province="none"):
    rows = spark.createDataFrame([(text, x, y, province)], "text string, x double, y double, province string")
    got = places.match_destination(rows, areas).collect()
    return (got[0]["to_province"], got[0]["to_city"], got[0]["to_region"]) if got else None


def test_every_contained_word_is_a_hit(spark):
    words = spark.createDataFrame([(w,) for w in ("red", "red widget", "widget", "dge", "wid")], "word string")
    text = spark.createDataFrame([("a red widget",), ("none",), (None,)], "text string")
    got = {r["word"] for r in places.dictionary_match(text, words).collect()}
    assert got == {"red", "red widget", "widget", "dge", "wid"}


def test_large_dictionary_agrees_with_brute_force(spark):
    words = sorted({f"{a}{b}{c}" for a in "abcdefg" for b in "abcdefgh" for c in ("", "a", "bc", "ß界", "hah")})
    texts = ["abcabcßhahaha界a", "a", "gg", "xyz" * 300 + "abß界" + "q" * 700 + "dhah", "ah" * 200, "😀ab😀bc"]
    got = places.dictionary_match(
        spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(w,) for w in words], "word string")
    )
    expected = {(t, w) for t in texts for w in words if w in t}
    assert {(r["text"], r["word"]) for r in got.collect()} == expected


def test_positions_across_block_borders(spark):
    text = "x" * 250 + "redredred" + "y" * 300 + "red"
    words = spark.createDataFrame([("red",), ("redred",)], "word string")
    got = places.dictionary_match(spark.createDataFrame([(text,)], "text string"), words, with_index=True)
    spans = {(r["word"], r["start"], r["end"]) for r in got.collect()}
    expected = {(w, i, i + len(w)) for w in ("red", "redred") for i in range(len(text)) if text.startswith(w, i)}
    assert spans == expected


def test_longest_match_drops_contained_words(spark, areas):
    assert match(spark, areas, "red widget") == ("P1", "C1", None)


def test_smaller_area_wins_and_takes_the_priority(spark, areas):
    # The province covers the city; the city gets priority 0 and beats the far ring.
    assert match(spark, areas, "red ring", province="P9") == ("P1", "C3", None)


def test_same_area_named_twice_is_kept(spark, areas):
    assert match(spark, areas, "red and crimson") == ("P1", None, None)


def test_one_in_province_candidate_wins(spark, areas):
    assert match(spark, areas, "ring", x=1.0, y=1.0, province="P3") == ("P3", "C4", None)


def test_nearest_of_equal_candidates(spark, areas):
    assert match(spark, areas, "near", x=0.0) == ("P4", "C7", None)
    assert match(spark, areas, "near", x=9.0) == ("P5", "C8", None)


def test_region_covered_by_its_city_word(spark, areas):
    assert match(spark, areas, "red widget rod") == ("P1", "C1", "R1")


def test_text_without_a_place_gives_no_row(spark, areas):
    assert match(spark, areas, "nothing here") is None


def test_query_process_drops_bad_rows_and_duplicates(spark, areas):
    log = spark.createDataFrame(
        [
            ("找工作 ring", "(1.0, 1.0)", "a,b", "u1", "20200102030405"),
            ("找工作 ring", "(1.0, 1.0)", "a,b", "u1", "20200102035959"),
            ("找工作 ring", "(1.0, 1.0)", None, "u2", "20201301030405"),
            ("找工作 ring", "1.0", None, "u3", "20200102030405"),
            ("weather ring", "(1.0, 1.0)", None, "u4", "20200102030405"),
            ("求职 ring", "(99999.0, 1.0)", None, "u5", "20200102030405"),
            ("招聘 ring", "(-1.0, 1.0)", None, "u6", "20200102030405"),
        ],
        "query string, location string, title string, userid string, stamp string",
    )
    grid = spark.createDataFrame([(0, "P1", "C3"), (-100000, "P3", "C4")], "grid_id long, province string, city string")
    got = places.query_process(log, grid, areas).collect()
    assert {(r["userid"], r["hour"], r["city_from"], r["city_to"], r["query"]) for r in got} == {
        ("u1", 3, "C3", "C3", "找工作 ring;;a b"), ("u6", 3, "C4", "C4", "招聘 ring;;"),
    }
    assert len(got) == 2


def test_normalize_names(spark):
    aliases = spark.createDataFrame([("大理", "大理白族自治州")], "alias string, official string")
    rows = spark.createDataFrame([("大理",), ("北京",), ("?",)], "city string")
    got = places.normalize_place(rows, aliases, "city", {"市": ["北京"]})
    assert sorted((r["city"] or "") for r in got.collect()) == ["", "北京市", "大理白族自治州"]
    provinces = places.normalize_province(spark.createDataFrame([("广西",), ("河北",), ("x",)], "p string"), "p")
    assert sorted((r["p"] or "") for r in provinces.collect()) == ["", "广西壮族自治区", "河北省"]


def test_one_character_words_meet_by_equality(spark):
    words = ["a", "abc", "q"] + [f"w{k}" for k in range(300)]
    texts = ["a" * 40, "xw7abc", "w299q", ""]
    got = places.dictionary_match(
        spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(w,) for w in words], "word string")
    )
    assert {(r["text"], r["word"]) for r in got.collect()} == {(t, w) for t in texts for w in words if w in t}


def test_rows_with_null_keys_keep_their_match(spark, areas):
    rows = [("ring", 0.0, 0.0, None), ("ring", 0.0, 0.0, "P3"), ("ring", None, None, "P1"), ("ring", 0.0, 0.0, None)]
    got = places.match_destination(spark.createDataFrame(rows, "text string, x double, y double, province string"), areas).collect()
    assert len(got) == 4
    assert {(r["x"], r["province"]): r["to_city"] for r in got} == {(0.0, None): "C3", (0.0, "P3"): "C4", (None, "P1"): "C3"}


def test_matches_by_id_carry_no_text_and_candidates_do_not_move(spark):
    texts = spark.createDataFrame([("aab en the en",), ("aab en the en",), ("e",), ("b" * 300 + "en",), (None,)], "text string")
    words = spark.createDataFrame([(w,) for w in ("en", "en ", "a", "aa", "the en", "n")], "word string")
    got = places.dictionary_match(texts, words, with_index=True, by_id=True)
    assert got.columns == ["text_id", "word", "start", "end"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    # A small dictionary goes to the candidates; those are neither merged nor dealt out by their text.
    above = plan[: plan.index("MapInArrow")]
    assert "BroadcastHashJoin" in above and "HashAggregate" not in above and "hashpartitioning" not in above
    want = sorted(
        (hashlib.md5(t.encode()).hexdigest(), w, i, i + len(w))
        for t in ("aab en the en", "b" * 300 + "en") for w in ("en", "en ", "a", "aa", "the en", "n")
        for i in range(len(t)) if t.startswith(w, i)
    )
    assert sorted(tuple(r) for r in got.collect()) == want
