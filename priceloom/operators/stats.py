"""Exact order statistics that never gather a group into one task."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slot(value: Column) -> Column:
    """Monotone coarse bucket of a price (about two per cent wide)."""
    return F.when(value > 0, F.floor(F.log(F.when(value > 0, value)) * 50)).otherwise(F.lit(-1_000_000))


def wanted_slots(slots: DataFrame, keys: list[str], picks) -> DataFrame:
    """The slots (keys, _slot, _in) that hold the wanted positions, with what lies before them."""
    group = Window.partitionBy(*keys)
    slots = slots.withColumns(
        {"n": F.sum("_in").over(group), "_end": F.sum("_in").over(group.orderBy("_slot"))}
    ).withColumn("_start", F.col("_end") - F.col("_in"))
    low, high = picks(F.col("n"))
    slots = slots.withColumns({"_low": low.cast("long"), "_high": high.cast("long")})
    return slots.filter(_holds("_low") | _holds("_high")).drop("_in", "_end")


def _holds(position: str) -> Column:
    return (F.col(position) > F.col("_start")) & (F.col(position) <= F.col("_end"))


def values_inside(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Values at the wanted positions; rows: (keys, _slot, n, _low, _high, _start, _v, _w) of the wanted slots."""
    inside = rows.groupBy(*keys, "_slot", "n", "_low", "_high", "_start", "_v").agg(F.sum("_w").alias("_w"))
    run = Window.partitionBy(*keys, "_slot").orderBy("_v")
    inside = inside.withColumn("_end", F.col("_start") + F.sum("_w").over(run))
    inside = inside.withColumn("_start", F.col("_end") - F.col("_w"))
    return inside.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max(F.when(_holds("_low"), F.col("_v"))).alias("low"),
        F.max(F.when(_holds("_high"), F.col("_v"))).alias("high"),
    )


def order_statistics(
    df: DataFrame,
    keys: list[str],
    value: str,
    picks: Callable[[Column], tuple[Column, Column]],
    weight: str | None = None,
) -> DataFrame:
    """Values at two 1-based positions of each sorted group: keys, n, low, high.

    ``picks(n)`` names the positions.  Step one counts rows per coarse bucket, combined
    map-side, so a group of any size is a few hundred rows; step two ranks only the
    values inside the one or two buckets that hold the wanted positions.
    """
    v = F.col(value)
    w = F.lit(1) if weight is None else F.col(weight)
    rows = df.filter(v.isNotNull()).select(*keys, v.alias("_v"), w.alias("_w"), _slot(v).alias("_slot"))
    slots = rows.groupBy(*keys, "_slot").agg(F.sum("_w").alias("_in"))
    return values_inside(rows.join(wanted_slots(slots, keys, picks), [*keys, "_slot"]), keys)


def pooled_statistics(members: DataFrame, shelves: DataFrame, own: DataFrame, key: str, value: str,
                      picks: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """order_statistics of keys whose values are those of several shelves and some of their own.

    members: (key, shelf); shelves: (shelf, value), shared by many keys; own: (key, value).
    A key meets its shelves' bucket counts, and then only the values of the one or two buckets that
    matter, so the values of a shelf are not repeated for every key that has it.
    """
    def slotted(df: DataFrame, name: str) -> DataFrame:
        v = F.col(value)
        return df.filter(v.isNotNull()).select(name, v.alias("_v"), _slot(v).alias("_slot")).groupBy(name, "_slot", "_v").agg(F.count(F.lit(1)).alias("_w"))

    shared, single = slotted(shelves, "shelf"), slotted(own, key)
    counts = shared.groupBy("shelf", "_slot").agg(F.sum("_w").alias("_in"))
    slots = members.join(counts, "shelf").select(key, "_slot", "_in").unionByName(single.select(key, "_slot", F.col("_w").alias("_in")))
    wanted = wanted_slots(slots.groupBy(key, "_slot").agg(F.sum("_in").alias("_in")), [key], picks)
    inside = wanted.join(members, key).join(shared, ["shelf", "_slot"]).drop("shelf").unionByName(wanted.join(single, [key, "_slot"]))
    return values_inside(inside, [key])


def middle(n: Column) -> tuple[Column, Column]:
    return F.floor((n + 1) / 2), F.floor(n / 2) + 1


def trimmed_middle(n: Column) -> tuple[Column, Column]:
    """Middle positions after the top quarter of five or more values is dropped."""
    kept = F.when(n >= 5, F.greatest(F.lit(3), F.floor(n * 0.75))).otherwise(n)
    return middle(kept)


def group_median(df: DataFrame, keys: list[str], value: str, out: str, weight: str | None = None,
                 picks=middle) -> DataFrame:
    stats = order_statistics(df, keys, value, picks, weight)
    return stats.select(*keys, "n", ((F.col("low") + F.col("high")) / 2).alias(out))


def robust_median(df: DataFrame, keys: list[str], price: str = "price", out: str = "robust_median") -> DataFrame:
    """Median after dropping the dearest quarter (groups of five or more)."""
    return group_median(df, keys, price, out, picks=trimmed_middle)


def small_robust_median(prices: Column) -> Column:
    """The same statistic on an array, for groups with a known small bound."""
    ordered = F.array_sort(prices)
    n = F.size(ordered)
    kept = F.when(n >= 5, F.greatest(F.lit(3), F.floor(n * 0.75).cast("int"))).otherwise(n)
    low = F.get(ordered, F.floor((kept - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(kept / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)
