"""Quality rules: word statistics and robust multivariate outliers.

Four statistics that have a spread of their own in ordinary text (word length, punctuation, capital
letters, vocabulary; in logarithms and steadied for short texts) make a vector. Per language and
source, a minimum-covariance-determinant estimate is found by concentration steps: keep the half of
the rows that is nearest by Mahalanobis distance, estimate mean and covariance from it, repeat until
the determinant stops falling. There are two deterministic starts (all rows; medians and absolute
deviations) and some from a few random rows; after two steps the two with the smallest determinants
go on, and the better one wins. A source's estimate is drawn towards its language's, and that
towards the estimate of all rows, with a weight that falls smoothly as the rows grow. Rows beyond a
chi-squared cutoff are rejected. Everything is aggregates and expressions over the statistics; the
half is cut at a bin of a fine histogram of the distances, so no group is ever sorted.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.llm.common import SPACE, WORD, discard, fraction, materialise

SYMBOL = r"[#*$%&|<>]"
#: Marks that ordinary punctuation and symbols have in common; parts of numbers, addresses and
#: hyphenated or elided words are left out.
MARK = r"[^\p{L}\p{N}\s@:/+=()'’-]"
P = 4
#: A row of an ordinary source is beyond the cutoff with this probability.
TAIL = 1e-8
#: A determinant whose logarithm falls by no more than this has stopped falling.
LEAST_FALL = 1e-4
#: Added to every variance of an estimate, as a share of the group's variance over all of its rows:
#: keeps statistics that depend on each other from making a matrix singular.
RIDGE = 0.02
#: Rows at which a group's own estimate weighs as much as the one that it is drawn towards.
HALF_WEIGHT = 100
RANDOM_STARTS = 3
#: Groups up to which their estimates are sent to all tasks (some 200 bytes each).
MOST_SENT = 100_000


def _within(q: float, p: int) -> float:
    """P(chi-squared <= q) for an even number `p` of dimensions."""
    return 1 - math.exp(-q / 2) * sum((q / 2) ** k / math.factorial(k) for k in range(p // 2))


def _quantile(share: float, p: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        q = (low + high) / 2
        low, high = (q, high) if _within(q, p) < share else (low, q)
    return q


def cutoff(p: int = P, tail: float = TAIL) -> float:
    return _quantile(1 - tail, p)


def consistency(share: float, p: int = P) -> float:
    """What makes the covariance of the nearest `share` of the rows consistent for normal variables:
    share / P(chi2_(p+2) <= q), where P(chi2_p <= q) = share."""
    return share / _within(_quantile(share, p), p + 2) if share < 1 else 1.0


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words in 8-word windows whose hash occurs twice or more."""
    n = F.size(words)

    def covered(windows: Column) -> Column:
        def spread(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            starts = F.array_sort(F.transform(again, lambda x: x["at"]))
            return _let(starts, lambda a: F.aggregate(F.transform(a, lambda p, i: F.coalesce(F.least(F.get(a, i + 1) - p, F.lit(8)), F.lit(8))), F.lit(0), lambda t, x: t + x))

        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(pairs, spread))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice(hashes, i, 8)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n < 9, F.lit(0)).otherwise(_let(hashes, lambda h: _let(windows(h), covered)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the whole text (see the module `queries`), in one pass
    without a shuffle. A null text counts as empty."""
    text = F.coalesce("text", F.lit(""))

    def count(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeated(words).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(words)).cast("long").alias("distinct"))

    words = F.array_remove(F.split(F.regexp_replace(text, SPACE, " "), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counted = _let(words, count)
    dup = _let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("own")))
    return docs.select(
        "doc_id", "lang", "source", counted.alias("w"), dup.alias("l"),
        F.char_length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(MARK)).alias("marks"), F.regexp_count(text, F.lit(r"\p{Lu}")).alias("capitals"), F.char_length(F.regexp_replace(text, r"\P{L}+", "")).alias("letters"),
    ).select(
        "doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols",
        (F.col("l.all") - F.col("l.own")).cast("long").alias("n_dup_lines"), "w.n_repeat_words", "w.distinct", "marks", "capitals", "letters",
    )


def transformed() -> list[Column]:
    """Logarithms of word length, shares of marks and of capital letters, and vocabulary for the
    length, each steadied for short texts."""
    c = F.col
    return [
        F.log((c("word_chars") + 100) / (c("n_words") + 20)),
        F.log((c("marks") + 8) / (c("word_chars") + 200)),
        F.log((c("capitals") + 8) / (c("letters") + 200)),
        F.log(c("distinct") + 20) - 0.82 * F.log(c("n_words") + 20),
    ]


KEYS = ["g", "h"]
X, M = [f"x{i}" for i in range(P)], [f"m{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
S = [f"s{i}{j}" for i, j in PAIRS]


def _moments(factor: Column | float = 1.0) -> list[Column]:
    """The means m. and the covariances s.., times `factor`."""
    return [*(F.avg(x).alias(m) for x, m in zip(X, M, strict=True)), *((F.covar_pop(f"x{i}", f"x{j}") * factor).alias(f"s{i}{j}") for i, j in PAIRS)]


def _factored(df: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l.. of the covariance and its log determinant."""
    lower: dict[tuple[int, int], Column] = {}
    for j in range(P):
        for i in range(j, P):
            v = F.col(f"s{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l{j}{j}"))
            lower[i, j] = F.col(f"l{i}{j}")
    det = reduce(lambda a, b: a + b, (F.log(lower[i, i]) for i in range(P)))
    return df.withColumn("logdet", det)


def _distance(df: DataFrame) -> DataFrame:
    for i in range(P):
        v = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * F.col(f"z{k}")
        df = df.withColumn(f"z{i}", v / F.col(f"l{i}{i}"))
    return df.withColumn("d2", reduce(lambda a, b: a + b, (F.col(f"z{i}") ** 2 for i in range(P)))).drop(*(f"z{i}" for i in range(P)))


def _with(rows: DataFrame, small: DataFrame, n: int, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows joined with the figures of their groups, which are sent to all tasks if they are few."""
    return rows.join(F.broadcast(small) if n <= MOST_SENT else small, keys, how)


def _ridged(states: DataFrame, ridge: DataFrame, n: int) -> DataFrame:
    """`states` with the ridge in their variances, and their factors."""
    both = _with(states, ridge.select(*KEYS, *(f"r{i}" for i in range(P))), n, KEYS)
    raised = {f"s{i}{i}": F.col(f"s{i}{i}") + F.col(f"r{i}") for i in range(P)}
    return _factored(both.withColumns(raised).drop(*(f"r{i}" for i in range(P))))


def _concentrated(rows: DataFrame, states: DataFrame, ridge: DataFrame, n: int) -> DataFrame:
    """One concentration step: per group and start, the estimate from the half nearest to `states`."""
    keys = [*KEYS, "start"]
    fields = [*keys, *M, *(f"l{i}{j}" for i, j in PAIRS)]
    near = _distance(_with(rows, states.select(fields), n, KEYS)).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * 16)).select(*keys, *X, "bin")
    bins = materialise(near.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(*keys)  # of a group's bins, a few hundred at most
    reach = bins.withColumn("c", F.sum("n").over(w.orderBy("bin"))).withColumn("t", F.sum("n").over(w))
    reach = reach.where(F.col("c") >= F.least(F.floor((F.col("t") + P + 1) / 2), F.col("t")))
    reach = reach.groupBy(*keys).agg(F.min("bin").alias("last"), F.min_by(F.col("c") / F.col("t"), "bin").alias("share"))
    factor = F.element_at(F.array(*(F.lit(consistency(a / 100)) for a in range(1, 101))), F.greatest(F.round(100 * F.first("share")), F.lit(1)).cast("int"))
    kept = _with(near, materialise(reach), n, keys).where(F.col("bin") <= F.col("last"))
    return materialise(_ridged(kept.groupBy(*keys).agg(*_moments(factor)), ridge, n), bins)


def mcd(rows: DataFrame, steps: int = 50) -> DataFrame:
    """g, h, n, means m. and covariances s.. of rows with columns g, h, x0..x3."""
    middle = materialise(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(x, 0.5, 2000).alias(m) for x, m in zip(X, M, strict=True)), *(((F.var_pop(x)) * RIDGE).alias(f"r{i}") for i, x in enumerate(X))))
    n = middle.count()
    classic = rows.groupBy(*KEYS).agg(*_moments()).withColumn("start", F.lit(0))
    off = _with(rows, middle.select(*KEYS, *M), n, KEYS).groupBy(*KEYS).agg(*(F.first(m).alias(m) for m in M), *(F.percentile_approx(F.abs(F.col(x) - F.col(m)), 0.5, 2000).alias(f"a{i}") for i, (x, m) in enumerate(zip(X, M, strict=True))))
    robust = off.select(*KEYS, *M, *((F.pow(1.4826 * F.col(f"a{i}"), 2) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in PAIRS), F.lit(1).alias("start"))
    states = classic.unionByName(robust)
    # from some 2 (P + 1) rows each, drawn by a hash of their values
    drawn = _with(rows, middle.select(*KEYS, "n"), n, KEYS).withColumn("start", F.explode(F.sequence(F.lit(2), F.lit(1 + RANDOM_STARTS))))
    drawn = drawn.where(fraction(F.xxhash64("start", *X), "start") * F.col("n") < 2 * (P + 1))
    states = states.unionByName(drawn.groupBy(*KEYS, "start").agg(*_moments()))
    states = materialise(_ridged(states, middle, n))
    for _ in range(2):
        states = _concentrated(rows, states, middle, n)
    best = Window.partitionBy(*KEYS).orderBy("logdet", "start")
    moving = materialise(states.withColumn("place", F.row_number().over(best)).where("place <= 2").drop("place"))
    settled: list[DataFrame] = []
    for _ in range(steps):
        stepped = _concentrated(rows, moving, middle, n)
        both = stepped.join(moving.select(*KEYS, "start", F.col("logdet").alias("was")), [*KEYS, "start"])
        falls = F.col("logdet") < F.col("was") - LEAST_FALL
        # what has stopped keeps its last estimate
        settled.append(materialise(moving.join(both.where(~falls).select(*KEYS, "start"), [*KEYS, "start"], "left_semi")))
        moving = materialise(both.where(falls).drop("was"))
        if moving.isEmpty():
            break
    estimate = reduce(DataFrame.unionByName, settled, moving)
    first = F.struct(*M, *S)
    best = estimate.groupBy(*KEYS).agg(F.min_by(first, F.struct("logdet", "start")).alias("e"))
    return materialise(best.select(*KEYS, "e.*").join(middle.select(*KEYS, "n"), KEYS), *settled, moving)


def _drawn_towards(own: DataFrame, wider: DataFrame, keys: list[str]) -> DataFrame:
    """The estimates of `own`, each mixed with that of the wider group: n / (n + HALF_WEIGHT) of its
    own, and all of the wider one's if it has none."""
    there = wider.select(*keys, *(F.col(c).alias(f"w{c}") for c in (*M, *S)))
    both = own.join(there, keys, "left") if keys else own.crossJoin(F.broadcast(there))
    share = F.col("n") / (F.col("n") + HALF_WEIGHT)
    mixed = [F.when(F.col(f"w{c}").isNull(), F.col(c)).when(F.col(c).isNull(), F.col(f"w{c}")).otherwise(share * F.col(c) + (1 - share) * F.col(f"w{c}")).alias(c) for c in (*M, *S)]
    return both.select(*own.columns[:2], "n", *mixed)


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and distance (squared; null where the base rule fails).

    A row fails the base rule with under 20 words or with over 30 % of its words in repeated 8-word
    windows. The estimates use the rows that pass. A null language or source is a group of its own.
    A group without rows that pass uses its language's estimate, a language without any that of all.
    Repeated and tied rows each count; other columns are not read.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = statistics(docs).withColumn("base_failed", base)
    group = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = materialise(stats.select(*counts, group("lang")("g"), group("source")("h"), *(v.alias(x) for v, x in zip(transformed(), X, strict=True))))
    good = rows.where(~F.col("base_failed")).select(*KEYS, *X)
    # the language over all sources, and all rows: no group is called so
    levels = F.explode(F.array(F.struct("g", "h"), F.struct("g", F.lit("*").alias("h")), F.struct(F.lit("*").alias("g"), F.lit("*").alias("h"))))
    estimate = mcd(good.select(levels.alias("at"), *X).select("at.g", "at.h", *X))
    everything = estimate.where("g = '*'").select("n", *M, *S)
    languages = estimate.where("h = '*' and g <> '*'")
    groups = rows.select(*KEYS).distinct().join(estimate, KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0))).select(*KEYS, "n", *M, *S)
    languages = groups.select("g").distinct().join(languages.drop("h"), "g", "left").select("g", F.lit("*").alias("h"), F.coalesce("n", F.lit(0)).alias("n"), *M, *S)
    languages = languages if everything.isEmpty() else _drawn_towards(languages, everything, [])
    estimate = materialise(_factored(_drawn_towards(groups, languages, ["g"])))
    judged = _distance(_with(rows, estimate.drop("n", "logdet", *S), estimate.count(), KEYS, "left"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff(), F.lit(True))
    return judged.select(*counts, kept.alias("kept"), F.when(~F.col("base_failed"), F.col("d2")).alias("distance"))
