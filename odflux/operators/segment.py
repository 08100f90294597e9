"""Words of texts that are written without blanks: the cheapest way through a dictionary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from odflux.operators.aggregates import attach
from odflux.operators.places import dictionary_hits
from odflux.operators.text import tokenize
from odflux.session import materialize

UNIT = 1000  # steps of a cost


def as_words(tokens):
    """``segmenter`` of the functions in ``text`` for a column that holds words already."""
    return tokens


def word_costs(words: DataFrame) -> DataFrame:
    """(word, cost, unknown): the whole-number negative log of each word's share of all counts, and
    the cost of a character that no word covers, that of a word counted once and one unit more.

    Equal words are summed; words without a count above 0 are left out.
    """
    known = words.where((F.col("cnt") > 0) & (F.length("word") > 0)).groupBy(F.lower("word").alias("word"))
    known = known.agg(F.sum("cnt").alias("cnt"))
    log = lambda x: F.floor(UNIT * F.log(x)).cast("long")
    total = known.agg(F.sum("cnt").alias("_all"))
    return attach(known, total, ()).select(
        "word", log(F.col("_all") / F.col("cnt")).alias("cost"), (log(F.col("_all")) + UNIT).alias("unknown")
    )


def _cheapest(run: str, steps, unknown: int) -> list[str]:
    """Words along the cheapest way through a run; steps are (start, end, cost). Of equal ways the
    one whose first different word is longer."""
    size, at = len(run), {}
    for step in steps:
        at.setdefault(step["start"], []).append((step["cost"], step["end"]))
    best, to = [0] * (size + 1), [0] * size
    for i in range(size - 1, -1, -1):
        # A character on its own is always a way on.
        best[i], back = min([(unknown + best[i + 1], -i - 1)] + [(c + best[e], -e) for c, e in at.get(i, ())])
        to[i] = -back
    words, i = [], 0
    while i < size:
        words.append(run[i:to[i]])
        i = to[i]
    return words


@F.pandas_udf(ArrayType(StringType()))
def _words(runs: pd.Series, steps: pd.Series, unknown: pd.Series) -> pd.Series:
    return pd.Series([_cheapest(r, () if s is None else s, u) for r, s, u in zip(runs, steps, unknown)], dtype=object)


def segment(docs: DataFrame, key: str, text: str, words: DataFrame, out: str = "tokens") -> DataFrame:
    """(key, ``out``): the words of each text in order, lower case, split at non-letters and then by
    the dictionary ``words`` (word, cnt).

    Between separators, the words with the smallest sum of ``word_costs`` win, which are the
    likeliest if words follow each other independently; characters outside the dictionary become
    words of their own. Keys are unique. Null texts and texts without letters give an empty array,
    an empty table no rows; an empty dictionary gives single characters.

    Every distinct run of letters is solved once, in time linear in its length, wherever it stands;
    only its matches and the words of one document come together in a row.
    """
    runs = docs.select(key, F.posexplode(tokenize(text)).alias("_at", "run"))
    runs = materialize(runs, "runs")
    costs = materialize(word_costs(words), "costs")
    _, hits = dictionary_hits(runs, costs, "run", with_index=True)
    hits = hits.join(costs.select("word", "cost"), "word")
    steps = hits.groupBy("text_id").agg(F.collect_list(F.struct("start", "end", "cost")).alias("steps"))
    distinct = runs.select("run").distinct().withColumn("text_id", F.md5("run"))
    unknown = costs.agg(F.coalesce(F.max("unknown"), F.lit(UNIT)).alias("unknown"))
    solved = attach(distinct.join(steps, "text_id", "left"), unknown, ())
    parts = materialize(solved.select("run", _words("run", "steps", "unknown").alias("_words")), "segments")
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_words")))
    found = runs.join(parts, "run").groupBy(key).agg(F.flatten(F.transform(ordered, lambda r: r["_words"])).alias("_all"))
    none = F.array().cast("array<string>")
    return docs.select(key).join(found, key, "left").select(key, F.coalesce("_all", none).alias(out))
