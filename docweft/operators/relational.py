"""Keyed and ordered operators: keep-first, keep-best, upsert, interval links, choosers, zips.

All order-dependent operators take an explicit order; nothing relies on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dealt


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have in any case, one for each of ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_first(df: DataFrame, keys: list[str], order: list[Column], scope: list[str] | None = None) -> DataFrame:
    """The first row of each key in the given order; rows whose only key is empty or null are dropped."""
    if len(keys) == 1 and df.schema[keys[0]].dataType.simpleString() == "string":
        df = df.filter(F.coalesce(F.col(keys[0]), F.lit("")) != "")
    w = Window.partitionBy(*(scope or []), *keys).orderBy(*order)
    (n,) = fresh(df, "n")
    return df.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).drop(n)


def keep_best(df: DataFrame, keys: list[str], score: Column, order: list[Column]) -> DataFrame:
    """The row of each key with the largest score, the earliest of equals."""
    return keep_first(df, keys, [score.desc(), *order])


def top_k(df: DataFrame, scope: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each scope; the planner limits before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).filter(F.col(rank) <= k)


def merge_coalesce(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join; non-empty values of the primary side win. Keys are unique on either side."""
    other = [c for c in primary.columns if c not in keys]

    def filled(c: str) -> Column:
        p = primary[c]
        p = F.when(F.trim(p) != "", p) if primary.schema[c].dataType.simpleString() == "string" else p
        return F.coalesce(p, fallback[c]).alias(c)

    on = [primary[k] == fallback[k] for k in keys]
    return primary.join(fallback, on, "full_outer").select(*[F.coalesce(primary[k], fallback[k]).alias(k) for k in keys], *[filled(c) for c in other])


def upsert_recent(stored: DataFrame, newer: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """Fresh rows replace stored ones of their key; the ``most`` newest rows stay."""
    (new,) = fresh(stored, "new")
    both = stored.withColumn(new, F.lit(0)).unionByName(newer.withColumn(new, F.lit(1)))
    latest = keep_first(both, [key], [F.col(new).desc(), F.col(at).desc()])
    return latest.drop(new).orderBy(F.col(at).desc(), F.col(key)).limit(most)


def interval_candidates(inner: DataFrame, outer: DataFrame, scope: list[str], inner_id: str, outer_id: str) -> DataFrame:
    """For each inner interval (start, end: whole numbers) of a scope the outer ones that contain it: how many, and the one if it is one.

    Nothing is paired. Starts lie in a tree of halves: an outer interval belongs to the block of its start on every
    level, and the outer intervals that start no later than an inner one are those of a few whole blocks, one a
    level at most. Inside a block a running count by falling end gives those that end no earlier. Blocks
    hold one row for each end, so a hot scope is spread over many blocks, none larger than the number of different ends. Null
    bounds and null scopes never match; a null end of an inner interval is its start.
    """
    named = {"lo": F.col("start").cast("bigint"), "hi": F.coalesce("end", "start").cast("bigint")}
    known = F.lit(True)
    for c in scope:
        known = known & F.col(c).isNotNull()
    asked = inner.select(*scope, F.col(inner_id).alias("__id"), *[c.alias(n) for n, c in named.items()])
    held = outer.filter(known & F.col("start").isNotNull() & F.col("end").isNotNull()).select(*scope, F.col(outer_id).alias("__id"), F.col("start").cast("bigint").alias("lo"), F.col("end").cast("bigint").alias("hi"))
    low, high, rows = held.agg(F.min("lo"), F.max("lo"), F.count(F.lit(1))).first()
    keys = [*scope, "level", "block"]
    if low is None:
        counted = asked.select(*scope, "lo", "hi", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(outer.schema[outer_id].dataType).alias("first")).limit(0)
    else:
        levels = (high - low + 1).bit_length()
        level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
        bit = F.expr("shiftright(at, level)")
        each = held.groupBy(*scope, "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first"))
        points = each.select(*scope, "hi", "n", "first", (F.col("lo") - low).alias("at"), level).select(*scope, "level", bit.alias("block"), "hi", "n", "first")
        # rows of all levels, in tasks whose size doesn't grow with the tables
        made = rows * (levels + 1)
        points = dealt(points, made, *keys, "hi").groupBy(*keys, "hi").agg(F.sum("n").alias("n"), F.min("first").alias("first")).withColumn("lo", F.lit(None).cast("bigint"))
        # starts in [low, lo], as blocks: the left one of a pair wherever the end of that range has a bit
        wanted = asked.filter(known & (F.col("lo") >= low)).select(*scope, "lo", "hi").distinct()
        wanted = wanted.select("*", (F.least(F.col("lo"), F.lit(high)) - low + 1).alias("at"), level).filter(bit.bitwiseAND(F.lit(1)) == 1)
        wanted = wanted.select(*keys[:-2], "level", (bit - 1).alias("block"), "hi", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(outer.schema[outer_id].dataType).alias("first"), "lo")
        falling = Window.partitionBy(*keys).orderBy(F.col("hi").desc(), F.col("lo").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = dealt(points.unionByName(wanted), made + asked.count() * (levels + 1) // 2, *keys).select(*keys, "lo", "hi", F.sum("n").over(falling).alias("n"), F.min("first").over(falling).alias("first")).filter("lo is not null")
        counted = running.groupBy(*scope, "lo", "hi").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    found = asked.join(counted, [*scope, "lo", "hi"], "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return found.select(*scope, F.col("__id").alias(inner_id), n.alias("n_candidates"), F.when(n == 1, F.col("first")).alias("linked_id"), (n > 1).alias("ambiguous"))


def zip_merge(base: Column, other: Column) -> Column:
    """Arrays by position: the other's value where it is not empty, else the base's; as long as the base."""
    return F.transform(base, lambda b, i: F.coalesce(F.when(F.trim(F.get(other, i)) != "", F.get(other, i)), b))


def union_keep_first(*arrays: Column) -> Column:
    """Concatenation without repeats in any case; the first spelling stays."""
    both = F.concat(*arrays)
    keys = F.transform(both, lambda x: F.lower(F.trim(x)))
    return F.filter(both, lambda x, i: (F.trim(x) != "") & (F.array_position(keys, F.lower(F.trim(x))) == i + 1))


def carry_forward(value: Column, scope: list[str], order: list[Column]) -> Column:
    """The last non-null value so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def context(value: Column, scope: list[str], order: list[Column], before: int = 2, after: int = 3, between: str = " || ") -> Column:
    """The values from ``before`` rows back to ``after`` rows on, joined."""
    return F.array_join(F.collect_list(value).over(Window.partitionBy(*scope).orderBy(*order).rowsBetween(-before, after)), between)
