"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted c = target / source size times, 0 <= c <= 2. The whole part of
c is given to all; the fraction is rounded by pivotal steps: two documents exchange words until one
of them has a whole number of copies. Direction and probability are such that no document's
expected number of copies changes and the words of the pair stay the same, so a source misses its
target by less than one document. The steps run inside blocks of bounded size; what is left of each
block, one fractional document, goes on to the next level of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.llm.common import WORD, keyed, materialise

WEIGHTS = (5.0, 2.0, 1.0)  # dealt to the sources in turn


def sizes(docs: DataFrame, *others: str) -> DataFrame:
    size = F.coalesce(F.size(F.split(F.regexp_replace("text", WORD, "x"), "x")) - 1, F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), *others)


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: `share` of all words split by weight, none above `most` times
    its source; the excess goes to the others by weight until none is above."""
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # position by code point, null last: within ranges first, then over the ranges
    ranged = materialise(by.repartitionByRange(8, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    start = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("part")) if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + start
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialise(ranged.select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * most
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # every round caps one more source at least
        full = cap <= F.lit(level) * F.col("weight")
        n, taken, rest = ranked.agg(F.count_if(full), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (share * words - taken) / rest
    return ranked.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).cast("double").alias("target"))


def _step(a: Column, x: Column, seed: str, level: int) -> Column:
    """One pivotal step between the pending document of `a` and `x`: (id, size, p, key) each."""
    p, q, s, t = a["open"]["p"], x["p"], a["open"]["size"].cast("double"), x["size"].cast("double")
    # words that can go from the first to the second, and back
    there = F.least(p * s, (1 - q) * t)
    back = F.least((1 - p) * s, q * t)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}/{level}"), a["open"]["id"], x["id"]), 11).cast("double") * F.lit(2.0**-53)
    move = F.when(u * (there + back) < back, there).otherwise(-back)
    near = lambda v: F.when(v < 1e-9, 0.0).when(v > 1 - 1e-9, 1.0).otherwise(v)
    first, second = near(p - move / s), near(q + move / t)
    first_done = (first == 0.0) | (first == 1.0)
    as_unit = lambda e, v: F.struct(e["id"].alias("id"), e["size"].alias("size"), v.alias("p"), e["key"].alias("key"))
    done = F.when(first_done, as_unit(a["open"], first)).otherwise(as_unit(x, second))
    return F.struct(
        F.concat(a["done"], F.array(done)).alias("done"),
        F.when(first_done, as_unit(x, second)).otherwise(as_unit(a["open"], first)).alias("open"),
    )


def _round(units: DataFrame, blocks: int, level: int, seed: str) -> DataFrame:
    """units: source, id, size, p, key, with 0 < p < 1. One row per block: its units, in the order of the
    id, folded to decided ones and one open one, which may be decided as well."""
    kind = "struct<done:array<struct<id:bigint,size:bigint,p:double,key:bigint>>,open:struct<id:bigint,size:bigint,p:double,key:bigint>>"
    block = F.pmod(F.xxhash64(F.lit(f"{seed}/block{level}"), "id"), F.lit(blocks))
    grouped = units.withColumn("block", block).groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "size", "p", "key"))).alias("all"))
    first = F.struct(F.array().cast("array<struct<id:bigint,size:bigint,p:double,key:bigint>>").alias("done"), F.element_at("all", 1).alias("open")).cast(kind)
    rest = F.slice("all", 2, F.size("all"))
    return grouped.select("source", "block", F.aggregate(rest, first, lambda a, x: _step(a, x, seed, level).cast(kind)).alias("got"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: str = "mix", block_rows: int = 128, row_key: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (= copies * size) for every row of `docs`.

    A null text has size 0 and is taken 0 times; a null source is a source of its own, the last.
    Rows that repeat a doc_id, and rows without one, are documents of their own, each drawn by itself.
    The result depends on ids, sizes and `seed` alone, so reruns agree; for rows that share an id or
    have none, on their place too. Copies are 0, 1 or 2 for `most` = 2. `row_key` names a column of
    `docs` as `keyed` adds it, which then is returned as well.
    """
    if row_key:
        sized = materialise(sizes(docs, row_key).withColumnRenamed(row_key, "key"))
    else:
        sized, name = keyed(sizes(docs))
        sized = sized.withColumnRenamed(name, "key")
    # of an id's rows in a partition all but the first are told apart, so that no block can hold them all
    part = F.shiftright("key", 33)
    place = F.row_number().over(Window.partitionBy("doc_id", part).orderBy("key"))
    sized = materialise(sized.withColumn("place", place).withColumn("id", F.xxhash64("doc_id", "place", F.when(F.col("place") > 1, part))).drop("place"))
    goal = materialise(targets(sized, share, most, weights))
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    want = F.when(want > most - 1e-9, F.lit(most)).otherwise(want)
    rows = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).select("doc_id", "key", "id", sized["source"].alias("source"), "size", "source_size", "target", F.floor(want).alias("whole"), (want - F.floor(want)).alias("p"))
    open_ = (F.col("size") > 0) & (F.col("p") > 1e-9)
    n = sized.count()
    blocks = max(1, -(-n // block_rows))
    units = rows.where(open_).select("source", "id", "size", "p", "key")
    level, levels = 0, []
    while True:
        got = materialise(_round(units, blocks, level, seed))
        levels.append(got)
        if blocks == 1:
            break
        rest = F.col("got.open.p")
        units = got.where((rest > 0) & (rest < 1)).select("source", F.expr("got.open.id").alias("id"), F.expr("got.open.size").alias("size"), rest.alias("p"), F.expr("got.open.key").alias("key"))
        level, blocks = level + 1, max(1, blocks // block_rows)
    flip = F.when(F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}/last"), "got.open.id"), 11).cast("double") * F.lit(2.0**-53) < F.col("got.open.p"), 1.0).otherwise(0.0)
    last = levels[-1].select(F.expr("got.open.key").alias("key"), flip.alias("p"))
    parts = [last]
    for k, got in enumerate(levels):
        parts.append(got.select(F.explode("got.done").alias("u")).select("u.key", "u.p"))
        if k < len(levels) - 1:
            parts.append(got.where("got.open.p in (0, 1)").select("got.open.key", "got.open.p"))
    decided = parts[0]
    for p in parts[1:]:
        decided = decided.unionByName(p)
    out = rows.join(decided.select("key", F.col("p").alias("extra")), "key", "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0.0))).otherwise(0).cast("long")
    return out.select("doc_id", *([F.col("key").alias(row_key)] if row_key else []), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
