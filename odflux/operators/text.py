"""Word counts, document frequencies, term vectors and counts of topics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflux.functions import periods, scalars
from odflux.operators.aggregates import attach
from odflux.operators.filters import sample_fraction
from odflux.session import stored_bytes

PART = 8 << 20  # bytes of text that a task counts
HELD = 16 << 20  # bytes of a stored vocabulary that every task may hold
SEPARATOR = r"[^\p{L}\p{N}]+"


def tokenize(text, segmenter=None) -> Column:
    """Words of a text: split at non-letters, or a plugged-in ``pandas_udf``."""
    text = F.col(text) if isinstance(text, str) else text
    if segmenter is not None:
        return segmenter(text)
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda w: F.length(w) > 0)


def text_parts(docs: DataFrame, text: str, size: int = PART) -> int:
    """Partitions of about ``size`` bytes of text each, no fewer than there are cores."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / size))


def place_texts(docs: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """Documents by key in as many partitions as their text asks for: a number given outright is
    not merged again, so what a task counts does not grow with the table."""
    return docs.repartition(parts or text_parts(docs, text), key)


def distinct_tokens(text, segmenter=None) -> Column:
    return F.array_distinct(tokenize(text, segmenter))


def word_stream(docs: DataFrame, text: str, keys=(), segmenter=None) -> DataFrame:
    return each_word(docs.where(F.col(text).isNotNull()).select(*keys, tokenize(text, segmenter).alias("tokens")), *keys)


def each_word(tokens: DataFrame, *columns) -> DataFrame:
    """A row per word. From a plain ``explode`` Spark infers that the array is not empty and splits
    every text a second time to see it, below the shuffle that places the texts."""
    return tokens.select(*columns, F.explode_outer("tokens").alias("word")).where(F.col("word").isNotNull())


def word_count(docs: DataFrame, text: str, min_length: int = 2, min_count: int = 1000, segmenter=None) -> DataFrame:
    """Vocabulary: long enough words, no numbers, with counts above a minimum."""
    words = word_stream(docs, text, segmenter=segmenter).where(
        (F.length("word") >= min_length) & ~scalars.is_digit("word")
    )
    return words.groupBy("word").agg(F.count("*").alias("cnt")).where(F.col("cnt") > min_count)


def inverse_document_frequency(
    docs: DataFrame, text: str, vocabulary: DataFrame, fraction: float | None = None, keys=None, segmenter=None
) -> DataFrame:
    """ln(N / documents with the word) over all, or a sample of, the documents."""
    docs = docs.where(F.col(text).isNotNull())
    if fraction is not None:
        docs = sample_fraction(docs, fraction, keys)
    found = (
        docs.select(F.explode(distinct_tokens(text, segmenter)).alias("word"))
        .groupBy("word").agg(F.count("*").alias("df"))
        .join(vocabulary.select("word"), "word", "left_semi")
    )
    size = docs.agg(F.count("*").alias("n"))
    return attach(found, size, ()).select("word", F.log(F.col("n") / F.col("df")).alias("idf"))


def tf_vector(
    docs: DataFrame, key: str, text: str, vocabulary: DataFrame, norm: bool = True,
    idf: DataFrame | None = None, segmenter=None,
) -> DataFrame:
    """Term weights in long form (key, word, tf).

    Counts over all tokens of the document; with ``norm`` scaled to sum 1 over the
    vocabulary. Weights are pure term frequencies unless ``idf`` (word, idf) is given.
    Of documents placed by key (``place_texts``) counting words and summing the words of a
    document need no shuffle, and a task holds the words of a few megabytes of text. Nor do the
    words move to a vocabulary of up to HELD bytes: it is broadcast, and a larger one left to Spark.
    """
    tokens = docs.where(F.col(text).isNotNull()).select(key, tokenize(text, segmenter).alias("tokens"))
    words = vocabulary.select("word")
    if stored_bytes(words) <= HELD:
        words = F.broadcast(words)
    counts = (
        each_word(tokens, key, F.size("tokens").alias("_all"))
        .groupBy(key, "word").agg(F.count("*").alias("n"), F.first("_all").alias("_all"))
        .join(words, "word", "left_semi")
    )
    document = Window.partitionBy(key)
    if norm and idf is None:
        # The document length cancels out.
        return counts.select(key, "word", (F.col("n") / F.sum("n").over(document)).alias("tf"))
    weights = counts.select(key, "word", (F.col("n") / F.col("_all")).alias("tf"))
    if idf is not None:
        weights = weights.join(idf, "word").select(key, "word", (F.col("tf") * F.col("idf")).alias("tf"))
    if not norm:
        return weights
    return weights.select(key, "word", F.try_divide(F.col("tf"), F.sum("tf").over(document)).alias("tf"))


def topic_counts(posts: DataFrame, city: str = "city", date: str = "startdate", topic: str = "topic") -> DataFrame:
    """Posts per city, month and topic; posts without city or date are dropped."""
    rows = posts.where(F.col(city).isNotNull() & F.col(date).isNotNull())
    month = periods.month_str(F.to_date(F.col(date).cast("string")))
    return rows.groupBy(F.col(city).alias("name"), month.alias("time"), F.col(topic).alias("topic")).agg(
        F.count("*").alias("cnt")
    )


def topic_word_matrix(weights: DataFrame, topics: DataFrame, vocabulary: DataFrame, key: str, k: int) -> DataFrame:
    """Word by topic weights, one column ``K<topic>`` per topic: the mean of its documents'
    weights, which is the cluster's centre. A row per vocabulary word, 0 where it has no weight.

    ``weights`` has (key, word, tf), ``topics`` (key, topic) with topics below ``k``. The table is
    a sum by word and topic, so no word list or centre passes the driver.
    """
    sizes = topics.groupBy("topic").agg(F.count("*").alias("_docs"))
    sums = weights.join(topics.select(key, "topic"), key).groupBy("word", "topic").agg(F.sum("tf").alias("_tf"))
    means = sums.join(sizes, "topic").select("word", "topic", (F.col("_tf") / F.col("_docs")).alias("mean"))
    wide = means.groupBy("word").pivot("topic", list(range(k))).agg(F.max("mean"))
    wide = wide.select("word", *[F.col(f"`{i}`").alias(f"K{i}") for i in range(k)])
    return vocabulary.select("word").join(wide, "word", "left").na.fill(0.0)
