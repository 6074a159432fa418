"""Exact quantiles of groups of any size, by counting.

A quantile lies between two order statistics. Passes over the rows count, for every group, how many
values fall into equal parts of the interval that holds a statistic, and go on with the part that does,
until it holds few values, which are then sorted, or one value alone. What a task keeps are counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.sources.store import discard, written

#: Values of a group up to which they are sorted in one aggregate.
FEW = 1_000_000
#: Parts of an interval that a pass counts.
PARTS = 2048


def quantiles(rows: DataFrame, keys: list[str], column: str, shares: list[float], few: int = FEW) -> DataFrame:
    """The keys and `q`, an array of the column's exact quantiles, with linear interpolation between
    values; a row for each group with a value. Null and missing values do not count."""
    x = F.col(column).cast("double")
    values = rows.where(x.isNotNull()).select(*keys, x.alias("x"))
    if not keys:
        values = values.withColumn("one", F.lit(0))
    by = keys or ["one"]
    sizes = written(values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= few:
        out = values.groupBy(*by).agg(F.array(*(F.percentile("x", F.lit(s)) for s in shares)).alias("q"))
        return out if keys else out.drop("one")
    values = written(values)
    # the two order statistics of every quantile: rank from 0, and the interval that holds it, of whose
    # values `n` are inside and `before` are below
    place = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(e).alias("end"), (F.floor if e == 0 else F.ceil)(F.lit(s) * (F.col("n") - 1)).alias("rank")) for i, s in enumerate(shares) for e in (0, 1)))
    state = written(sizes.withColumn("t", F.explode(place)).select(*by, F.col("t.i").alias("i"), F.col("t.end").alias("end"), F.col("t.rank").alias("rank"), F.lit(0).cast("long").alias("before"), "n", "lo", "hi"))
    while state.where((F.col("n") > few) & (F.col("lo") < F.col("hi"))).limit(1).count():
        state = written(_narrowed(values, state, by, few), state)
    out = _chosen(values, state, by)
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1)
    ends = out.join(sizes.select(*by, F.col("n").alias("size")), by).groupBy(*by, "i", "size").agg(F.max(F.when(F.col("end") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("x"))).alias("b"))
    at = share * (F.col("size") - 1)
    value = F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))
    out = ends.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda p: p["v"]).alias("q"))
    out = written(out)
    discard(values, state, sizes)
    return out if keys else out.drop("one")


def _part(x: Column) -> Column:
    """The number of the part of [lo, hi] that x falls into. As it never falls as x grows, values of a
    part are neighbours in order whatever the rounding."""
    width = F.col("hi") / PARTS - F.col("lo") / PARTS
    part = F.least(F.floor(F.try_divide(x / PARTS - F.col("lo") / PARTS, width) * PARTS), F.lit(PARTS - 1))
    return F.when(width > 0, part).otherwise((x > F.col("lo")).cast("int")).cast("int")  # none in the last digits


def _narrowed(values: DataFrame, state: DataFrame, by: list[str], few: int) -> DataFrame:
    """The state with each open interval replaced by the range of the part that holds the statistic."""
    open_ = (F.col("n") > few) & (F.col("lo") < F.col("hi"))
    spans = state.where(open_).select(*by, "lo", "hi").distinct()
    inside = values.join(spans, by).where(F.col("x").between(F.col("lo"), F.col("hi")))
    counts = inside.groupBy(*by, "lo", "hi", _part(F.col("x")).alias("part")).agg(F.count(F.lit(1)).alias("m"), F.min("x").alias("low"), F.max("x").alias("high"))
    below = Window.partitionBy(*by, "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # of PARTS rows at most
    counts = counts.withColumn("below", F.coalesce(F.sum("m").over(below), F.lit(0)))
    rank = F.col("rank") - F.col("before")
    hit = state.where(open_).join(counts, [*by, "lo", "hi"]).where((rank >= F.col("below")) & (rank < F.col("below") + F.col("m")))
    hit = hit.select(*by, "i", "end", "rank", (F.col("before") + F.col("below")).alias("before"), F.col("m").alias("n"), F.col("low").alias("lo"), F.col("high").alias("hi"))
    return hit.unionByName(state.where(~open_))


def _chosen(values: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """by, i, end, x: the statistics themselves, out of intervals of few values or one."""
    done = state.where("lo = hi").select(*by, "i", "end", F.col("lo").alias("x"))
    spans = state.where("lo < hi").select(*by, "lo", "hi").distinct()
    held = values.join(spans, by).where(F.col("x").between(F.col("lo"), F.col("hi"))).groupBy(*by, "lo", "hi").agg(F.sort_array(F.collect_list("x")).alias("held"))
    got = state.where("lo < hi").join(held, [*by, "lo", "hi"])
    return done.unionByName(got.select(*by, "i", "end", F.element_at("held", (F.col("rank") - F.col("before") + 1).cast("int")).alias("x")))
