"""Which place a text names: dictionary words, their areas, and the best area.

Texts repeat a lot, so words and areas are found once per distinct text; rows meet the
result by a join. Nothing lists pairs inside a text: contained words and covering areas
are both found by equi joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.functions import periods, scalars
from odflux.operators.filters import filter_any_keyword, safe_parse
from odflux.operators.joins import grid_lookup
from odflux.session import materialize
from odflux.sources.files import SENTINEL

LEVELS = ("province", "city", "region")
BLOCK = 256
SLOTS = 20  # bits of a candidate's slot
BASE = 0x9E3779B97F4A7C15  # odd, so it has powers and inverses modulo 2^64


def dictionary_match(
    texts: DataFrame, words: DataFrame, text: str = "text", with_index: bool = False, by_id: bool = False
) -> DataFrame:
    """All dictionary words contained in each distinct text, overlapping ones included.

    Every position of a text is one candidate per word length that the dictionary has. Of
    these, only those whose hash falls on that of a word go on, and they meet words by equality.
    Texts are cut into overlapping blocks first, and travel as a digest, so the work is linear in
    the text. The blocks are spread over all tasks: they are small in bytes but many in
    positions, also for one long text.

    A row per match carries its text; ``by_id`` gives the column ``text_id``, the text's MD5, in
    its place, for matches that are only counted or joined again.
    """
    distinct, hits = dictionary_hits(texts, words, text, with_index)
    if by_id:
        return hits
    return distinct.join(hits, "text_id").drop("text_id").withColumnRenamed("text", text)


def dictionary_hits(texts: DataFrame, words: DataFrame, text: str = "text", with_index: bool = False):
    """Tables (text_id, text) and (text_id, word[, start, end]) behind ``dictionary_match``: a hit
    does not carry its text.

    The dictionary is written first: its known size lets Spark send a small one to the candidates,
    which then never move. Each (text_id, start, length) is one candidate, so positions need no
    merging. Of the dictionary, the driver sees its word lengths and at most 2^SLOTS hashes; a
    larger one only lets more candidates through to the join.
    """
    words = materialize(words.select("word").where(F.length("word") > 0).distinct(), "dictionary")
    distinct = texts.select(F.col(text).alias("text")).where(F.length("text") > 0).distinct()
    # One number per different length, never more than the longest word has characters.
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect()) or [1]
    shortest, longest = lengths[0], lengths[-1]
    distinct = distinct.where(F.length("text") >= shortest).withColumn("text_id", F.md5("text"))
    size = F.length("text")
    blocks = distinct.select(
        "text_id", "text", F.explode(F.sequence(F.lit(0), size - 1, F.lit(BLOCK))).alias("at")
    ).select(
        "text_id", "at", F.least(F.lit(BLOCK), size - F.col("at")).alias("own"),
        F.substring("text", F.col("at") + 1, F.lit(BLOCK + longest - 1)).alias("block"),
    )
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = words.select(F.lit("").alias("text_id"), F.lit(0).alias("at"), F.lit(1).alias("own"), F.col("word").alias("block"))
    slots = whole.mapInArrow(_word_slots, "slot int").distinct().toArrow()["slot"].to_numpy()
    taken = np.zeros(1 << SLOTS, dtype=bool)
    taken[slots] = True
    grams = blocks.repartition(tasks, "text_id", "at").mapInArrow(
        lambda batches: _candidates(batches, lengths, taken), "text_id string, start int, word string"
    )
    hits = grams.join(words, "word")
    if with_index:
        return distinct, hits.select("text_id", "word", "start", (F.col("start") + F.length("word")).alias("end"))
    return distinct, hits.select("text_id", "word").distinct()


def _windows(blocks: list[str]):
    """Per character of the blocks laid end to end: its block, its place there, the characters from
    it to the block's end; and a function that gives the slots of all windows of a length."""
    size = np.array([len(b) for b in blocks], dtype=np.int64)
    chars = np.frombuffer("".join(blocks).encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    block = np.repeat(np.arange(len(blocks)), size)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
    # Sums of char * BASE^i, whose difference over a window times BASE^-i depends on its text alone.
    power = lambda base: np.cumprod(np.full(len(chars), base, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * power(BASE), dtype=np.uint64)])
    inverse = power(pow(BASE, -1, 1 << 64))

    def slots(n: int):
        end = np.minimum(np.arange(n, len(chars) + n), len(chars))
        return ((sums[end] - sums[:-1]) * inverse * np.uint64(BASE) >> np.uint64(64 - SLOTS)).astype(np.int64)

    return block, place, size[block] - place, slots


def _word_slots(batches):
    for batch in batches:
        words = batch["block"].to_pylist()
        _, place, left, slots = _windows(words)
        for n in np.unique(left[place == 0]):
            yield pa.record_batch({"slot": slots(int(n))[(place == 0) & (left == n)].astype(np.int32)})


def _candidates(batches, lengths, taken):
    """Windows of the blocks' own places whose slot a word has; those that run over a block's end,
    which is the end of its text, are none."""
    for batch in batches:
        texts = batch["block"].to_pylist()
        block, place, left, slots = _windows(texts)
        own = place < batch["own"].to_numpy()[block]
        at = batch["at"].to_numpy()
        for n in lengths:
            i = np.flatnonzero(own & (left >= n) & taken[slots(n)])
            b, p = block[i], place[i]
            word = [texts[j][k : k + n] for j, k in zip(b.tolist(), p.tolist())]
            yield pa.record_batch({
                "text_id": batch["text_id"].take(pa.array(b)), "start": (at[b] + p).astype(np.int32),
                "word": pa.array(word, pa.string()),
            })


def word_coverage(words: DataFrame) -> DataFrame:
    """Pairs (word, part): the part is another word contained in the word."""
    found = dictionary_match(words.select(F.col("word").alias("whole")), words, "whole")
    return found.where(F.col("whole") != F.col("word")).select(
        F.col("whole").alias("word"), F.col("word").alias("part")
    )


def keep_longest_matches(matches: DataFrame, words: DataFrame, keys=("text",)) -> DataFrame:
    """Drop a matched word that is contained in another matched word of the same text."""
    parts = matches.join(word_coverage(words), "word").select(*keys, F.col("part").alias("word")).distinct()
    return matches.join(parts, [*keys, "word"], "left_anti")


def drop_covering_areas(candidates: DataFrame, keys=("text",)) -> DataFrame:
    """Keep the smallest areas; each takes the best priority among itself and its covers.

    Equal areas of a text are merged first. An area is covered by exactly the areas that
    result from blanking some of its levels, so covers are looked up, at most seven per
    candidate, instead of comparing all candidates with each other.
    """
    keys = list(keys)
    filled = candidates.withColumns({c: F.coalesce(c, F.lit(SENTINEL)) for c in LEVELS})
    # Read three times below, and far smaller than the rows the texts come from.
    merged = filled.groupBy(*keys, *LEVELS).agg(
        F.min("level").alias("level"), F.min("original_level").alias("original_level"),
        F.min(F.struct("x", "y")).alias("point"),
    )
    merged = materialize(merged, "areas")
    blanks = F.array(
        *[
            F.struct(*[(F.lit(SENTINEL) if mask >> i & 1 else F.col(c)).alias(f"wide_{c}") for i, c in enumerate(LEVELS)])
            for mask in range(1, 8)
        ]
    )
    wider = merged.select(*keys, *LEVELS, F.explode(F.array_distinct(blanks)).alias("w")).select(*keys, *LEVELS, "w.*")
    same = F.col("wide_province").eqNullSafe(F.col("province"))
    for c in LEVELS[1:]:
        same = same & F.col(f"wide_{c}").eqNullSafe(F.col(c))
    wider = wider.where(~same)
    covers = merged.select(*keys, *[F.col(c).alias(f"wide_{c}") for c in LEVELS], F.col("level").alias("wide_level"))
    met = wider.join(covers, [*keys, *[f"wide_{c}" for c in LEVELS]])
    best = met.groupBy(*keys, *LEVELS).agg(F.min("wide_level").alias("wide_level"))
    dropped = met.select(*keys, *[F.col(f"wide_{c}").alias(c) for c in LEVELS]).distinct()
    kept = merged.join(dropped, [*keys, *LEVELS], "left_anti").join(best, [*keys, *LEVELS], "left")
    return kept.select(
        *keys, *[F.nullif(F.col(c), F.lit(SENTINEL)).alias(c) for c in LEVELS],
        F.least("level", "wide_level").alias("level"), "original_level",
        F.col("point.x").alias("x"), F.col("point.y").alias("y"),
    )


def text_candidates(texts: DataFrame, areas: DataFrame, text: str = "text") -> DataFrame:
    """Areas a text may mean: longest words, then smallest areas."""
    words = areas.select("word").distinct()
    found = materialize(dictionary_match(texts, words, text), "matches")
    matches = keep_longest_matches(found, words, (text,))
    return drop_covering_areas(matches.join(areas, "word"), (text,))


def match_destination(rows: DataFrame, areas: DataFrame, text: str = "text") -> DataFrame:
    """Best area for each row (text, x, y, province); rows without one are dropped.

    Candidates in the row's province go first, then the best priority, then the best
    original priority, then the nearest; names settle what is still tied.
    """
    # A row is asked for under a digest that tells null from text, so null keys keep their match.
    ask = F.sha1(F.to_json(F.struct(F.col(text).alias("t"), "x", "y", "province"), {"ignoreNullFields": "false"}))
    rows = materialize(rows.withColumn("_ask", ask), "rows")
    asked = materialize(rows.select("_ask", text, "x", "y", "province").distinct(), "asked")
    candidates = text_candidates(asked, areas, text).select(
        text, *[F.col(c).alias(f"to_{c}") for c in LEVELS], "level", "original_level",
        F.col("x").alias("to_x"), F.col("y").alias("to_y"),
    )
    outside = F.coalesce(F.col("to_province") != F.col("province"), F.lit(True))
    order = F.struct(
        outside.alias("outside"), "level", "original_level",
        scalars.squared_distance("to_x", "to_y", "x", "y").alias("d2"),
        "to_province", "to_city", "to_region",
    )
    chosen = (
        asked.join(candidates, text)
        .groupBy("_ask").agg(F.min(order).alias("best"))
        .select("_ask", "best.to_province", "best.to_city", "best.to_region")
    )
    return rows.join(chosen, "_ask").drop("_ask")


# Terms that mark a job-seeking query.
JOB_TERMS = ("招聘", "求职", "找工作")


def query_process(log: DataFrame, grid: DataFrame, areas: DataFrame, terms=JOB_TERMS, grid_length: int = 2000) -> DataFrame:
    """Search log to distinct trips (user, time parts, from, to, query)."""
    asked = safe_parse(filter_any_keyword(log, "query", terms))
    located = grid_lookup(asked, grid, grid_length).na.drop(subset=["province", "city"])
    located = located.withColumn("text", scalars.join_query_title("query", "title")).select(
        "userid", "event_time", "province", "city", "x", "y", "text"
    )
    # The few job searches are kept, so that the whole log is read once.
    located = materialize(located, "located")
    trips = periods.timestamp_parts(match_destination(located, areas), "event_time")
    return trips.select(
        "userid", "year", "month", "day", "hour",
        F.col("province").alias("province_from"), F.col("city").alias("city_from"),
        F.col("to_province").alias("province_to"), F.col("to_city").alias("city_to"),
        F.col("text").alias("query"),
    ).distinct()


def normalize_place(df: DataFrame, aliases: DataFrame, column: str, suffixes=None) -> DataFrame:
    """Short place names to official ones; unknown names become null.

    ``aliases`` (alias, official) is data. ``suffixes`` maps a suffix to the short names
    that take it, for names that follow a rule.
    """
    pairs = aliases.select(F.col("alias").alias(column), "official")
    named = df.join(pairs, column, "left")
    ruled = F.lit(None).cast("string")
    for suffix, names in (suffixes or {}).items():
        ruled = F.when(F.col(column).isin(list(names)), F.concat(F.col(column), F.lit(suffix))).otherwise(ruled)
    return named.withColumn(column, F.coalesce("official", ruled)).drop("official").select(*df.columns)


# Provinces by the suffix of their official names.
PROVINCE_SUFFIXES = {
    "省": ["青海", "甘肃", "云南", "湖北", "海南", "浙江", "吉林", "贵州", "江苏", "山东", "安徽", "台湾",
           "山西", "福建", "广东", "江西", "辽宁", "黑龙江", "河北", "河南", "湖南", "陕西", "四川"],
    "市": ["北京", "上海", "重庆", "天津"],
    "自治区": ["内蒙古", "西藏"],
    "回族自治区": ["宁夏"],
    "维吾尔自治区": ["新疆"],
    "壮族自治区": ["广西"],
    "特别行政区": ["香港", "澳门"],
}


def normalize_province(df: DataFrame, column: str) -> DataFrame:
    """Province names to official names by the suffix rule."""
    ruled = F.lit(None).cast("string")
    for suffix, names in PROVINCE_SUFFIXES.items():
        ruled = F.when(F.col(column).isin(names), F.concat(F.col(column), F.lit(suffix))).otherwise(ruled)
    return df.withColumn(column, ruled)
