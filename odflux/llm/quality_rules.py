"""Quality rules: base limits, then robust multivariate outliers per language and source.

Five counts of each text give a vector of four transformed statistics. Each group of
language and source gets a centre and a covariance by the minimum covariance determinant:
from medians and median deviations, concentration steps take the rows that lie nearest and
estimate anew. Rows far from their group's centre, by the Mahalanobis distance of the
reweighted estimate, are rejected; the limit is the chi-square limit that reweights. A group's
covariance is never below what counting alone explains in its texts (``_noise``).

All of it is built from DataFrame functions: a text is read in one pass, what follows works
on a narrow table of counts, and groups are summed map-side, so one group may hold most rows.

Defined results: a null or empty text has no words and fails the base rule. Null languages
and sources form groups of their own. Groups of fewer than ``least`` passing rows take the
estimate of all rows; if there is none either, the base rule alone decides. Repeated rows
are judged alike. Other columns pass through; one named like ``out`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflux.llm.common import NON_WHITE, WHITE, WHITE_RUN, materialize, table
from odflux.llm.registry import query

SYMBOLS = "#*$%&|<>"
WINDOW = 5
Z = ("z0", "z1", "z2", "z3")
E = ("e0", "e1", "e2", "e3")


@dataclass(frozen=True)
class Rules:
    """Parameters. ``share``: of the rows that concentration steps keep. The three values that
    follow belong to it and to four statistics: the factor that makes the covariance of the
    nearest 75 % consistent for normal rows, and chi-square limits with four degrees of freedom
    (97.5 %)."""

    least_words: int = 10
    most_repeated: int = 20  # per cent of the words
    share: float = 0.75
    consistency: float = 1.49
    reweight: float = 11.143
    cutoff: float = 11.143
    steps: int = 5
    least: int = 30


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _twice(ordered: Column) -> Column:
    """Positions whose window equals a neighbour in the list sorted by (window, position)."""
    later = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0)))
    pairs = F.zip_with(ordered, later, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))


def _covered(positions: Column) -> Column:
    """Words in the union of the windows that start at these ascending positions."""
    return F.aggregate(
        positions,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def text_counts(docs: DataFrame, text: str = "text", out: str = "counts") -> DataFrame:
    """Adds a struct of counts: n_words, word_chars, n_symbols, n_lines (with a word),
    n_dup_lines, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    size, plain = F.octet_length(body), _without(body, WHITE)
    step = docs.withColumns({
        "_words": F.array_remove(F.split(body, WHITE_RUN), ""),
        "_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(NON_WHITE)),
        "_white": size - F.octet_length(plain),
        "_symbols": size - F.octet_length(_without(body, SYMBOLS)),
        "_chars": F.char_length(body),
    })
    step = step.withColumn("_hashes", F.transform(F.col("_words"), lambda w: F.xxhash64(w)))
    step = step.withColumn(
        "_windows",
        F.when(F.size("_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0))),
                lambda h, i: F.xxhash64(h, *[F.get(F.col("_hashes"), i + k) for k in range(1, WINDOW)]),
            )
        ),
    )
    # Each step below is a column of its own, so it is computed once per text.
    step = step.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    step = step.withColumn("_hits", F.when(F.col("_sorted").isNotNull(), _twice(F.col("_sorted"))))
    repeated = F.when(F.col("_hits").isNull(), F.lit(0)).otherwise(_covered(F.col("_hits")))
    counts = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        (F.col("_chars") - F.col("_white")).cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    )
    return step.withColumn(out, counts).drop(
        "_words", "_lines", "_white", "_symbols", "_chars", "_hashes", "_windows",
        "_sorted", "_hits",
    )


def base_failed(counts: Column, rules: Rules) -> Column:
    return (counts["n_words"] < rules.least_words) | (
        100 * counts["n_repeat_words"] > rules.most_repeated * counts["n_words"]
    )


def _statistics(counts: Column) -> list[Column]:
    """The vector: log of the mean word length (smoothed, so short texts vary no more), root of
    the symbols' share, shares of repeated lines and of words in repeated windows."""
    n = counts["n_words"].cast("double")
    return [
        F.log((counts["word_chars"] + 100.0) / (n + 20.0)),
        F.sqrt(counts["n_symbols"] / (counts["word_chars"] + 20.0)),
        counts["n_dup_lines"] / (counts["n_lines"] + 5.0),
        counts["n_repeat_words"] / (n + 20.0),
    ]


def _noise(counts: Column) -> list[Column]:
    """Variances of the statistics by counting alone: characters and symbols as Poisson counts
    (a ratio's logarithm varies by one over the count, a share's root by a quarter of one over
    the whole), one line more or less, one window of words more or less."""
    return [
        1.0 / (counts["word_chars"] + 100.0),
        0.25 / (counts["word_chars"] + 20.0),
        F.pow(1.0 / (counts["n_lines"] + 5.0), F.lit(2)),
        F.pow(WINDOW / (counts["n_words"] + 20.0), F.lit(2)),
    ]


def _cholesky(model: DataFrame) -> DataFrame:
    """Adds the lower triangle of the covariance's root, with the counting noise on its diagonal."""
    for i in range(len(Z)):
        for j in range(i + 1):
            rest = F.col(f"c{j}{i}")
            if i == j:
                rest = rest + F.col(f"e{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
            model = model.withColumn(f"l{i}{j}", value)
    return model


def _distance(z: list[Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution through the triangle."""
    y: list[Column] = []
    for i, value in enumerate(z):
        rest = value - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * y[k]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _estimate(rows: DataFrame, scale: float) -> DataFrame:
    """Centre and covariance of each group, by partial sums."""
    sums = [F.count(F.lit(1)).alias("n")] + [F.avg(z).alias(f"m{i}") for i, z in enumerate(Z)]
    sums += [F.avg(e).alias(e) for e in E]
    sums += [
        F.covar_pop(Z[i], Z[j]).alias(f"c{i}{j}") for i in range(len(Z)) for j in range(i, len(Z))
    ]
    model = rows.groupBy("pooled", "lang", "source").agg(*sums)
    return model.withColumns({
        f"c{i}{j}": F.col(f"c{i}{j}") * scale for i in range(len(Z)) for j in range(i, len(Z))
    })


def _with_model(rows: DataFrame, model: DataFrame) -> DataFrame:
    same = [rows[c].eqNullSafe(model[c]) for c in ("pooled", "lang", "source")]
    return rows.join(model, same[0] & same[1] & same[2]).drop(*[model[c] for c in ("pooled", "lang", "source")])


def fit(counted: DataFrame, counts: str = "counts", rules: Rules = Rules()) -> DataFrame:
    """One row per group: centre (m) and root of the covariance (l).

    ``counted`` holds lang, source and the counts. Rows that fail the base rule take no part.
    """
    c = F.col(counts)
    z = [x.alias(n) for x, n in zip(_statistics(c) + _noise(c), Z + E)]
    own = counted.where(~base_failed(c, rules)).select("lang", "source", *z)
    none = F.lit(None).cast("string")
    rows = own.select(F.lit(False).alias("pooled"), "lang", "source", *Z, *E).unionByName(
        own.select(F.lit(True).alias("pooled"), none.alias("lang"), none.alias("source"), *Z, *E)
    )
    rows = materialize(rows, "statistics")
    keys = ["pooled", "lang", "source"]

    # Start: medians, and median deviations as a diagonal covariance.
    centre = materialize(
        rows.groupBy(*keys).agg(*[F.percentile_approx(n, 0.5).alias(f"m{i}") for i, n in enumerate(Z)], *[F.avg(e).alias(e) for e in E]), "model"
    )
    spread = _with_model(rows.drop(*E), centre).groupBy(*keys).agg(*[
        F.percentile_approx(F.abs(F.col(n) - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i, n in enumerate(Z)
    ])
    start = centre.alias("a").join(
        spread.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    ).select(
        *[F.col(f"a.{k}") for k in keys], *[f"m{i}" for i in range(len(Z))], *E,
        *[
            (F.pow(1.4826 * F.col(f"d{i}"), F.lit(2)) if i == j else F.lit(0.0)).alias(f"c{i}{j}")
            for i in range(len(Z)) for j in range(i, len(Z))
        ],
    )
    model = materialize(_cholesky(start), "model")
    z = [F.col(n) for n in Z]
    for _ in range(rules.steps):
        placed = _with_model(rows, model.drop(*E)).select(*keys, *Z, *E, _distance(z).alias("d"))
        limit = materialize(placed.groupBy(*keys).agg(F.percentile_approx("d", rules.share).alias("limit")), "limit")
        near = _with_model(placed, limit).where(F.col("d") <= F.col("limit"))
        model = materialize(_cholesky(_estimate(near, rules.consistency)), "model")
    near = _with_model(rows, model.drop(*E)).where(_distance(z) <= rules.reweight).select(*keys, *Z, *E)
    model = _cholesky(_estimate(near, 1.0))
    values = [f"m{i}" for i in range(len(Z))] + [f"l{i}{j}" for i in range(len(Z)) for j in range(i + 1)]
    model = materialize(model.select(*keys, "n", *values), "model")
    # Small groups take the estimate of all rows, a table of one row.
    whole = model.where("pooled").select(*[F.col(v).alias(f"w_{v}") for v in values])
    sized = model.where(~F.col("pooled")).crossJoin(whole)
    known = sized.select("lang", "source", *[
        F.when(F.col("n") >= rules.least, F.col(v)).otherwise(F.col(f"w_{v}")).alias(v) for v in values
    ])
    return materialize(known, "model")


def judge(counted: DataFrame, model: DataFrame, counts: str = "counts", out: str = "quality", rules: Rules = Rules()) -> DataFrame:
    """Adds a struct (base_failed, distance, kept); a group without an estimate has no distance."""
    names = {n: f"_q_{n}" for n in model.columns}
    m = model.select(*[F.col(n).alias(v) for n, v in names.items()])
    joined = counted.join(
        m, counted["lang"].eqNullSafe(m["_q_lang"]) & counted["source"].eqNullSafe(m["_q_source"]), "left"
    )
    z = _statistics(F.col(counts))
    y: list[Column] = []
    for i, value in enumerate(z):
        rest = value - F.col(f"_q_m{i}")
        for k in range(i):
            rest = rest - F.col(f"_q_l{i}{k}") * y[k]
        y.append(rest / F.col(f"_q_l{i}{i}"))
    d = sum((v * v for v in y[1:]), y[0] * y[0])
    failed = base_failed(F.col(counts), rules)
    return joined.withColumn(
        out,
        F.struct(
            failed.alias("base_failed"), d.alias("distance"),
            (~failed & (d.isNull() | (d <= rules.cutoff))).alias("kept"),
        ),
    ).drop(*names.values())


@query("op7_quality_rules")
def op7(spark, sf_dir):
    counted = materialize(
        text_counts(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "counts"), "counts"
    )
    judged = judge(counted, fit(counted))
    return judged.select(
        "doc_id", *[f"counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "quality.base_failed", "quality.kept",
    )
