"""Fill missing option specifications from like-named records."""
from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import SPACES, nfkc

# Measures that make two specifications comparable.
MEASURE = r"(?i)(\d+(?:\.\d+)?)\s*(mm|cm|m|ml|l|kg|g)(?![A-Za-z0-9])"
FACTORS = {"mm": ("len", 1.0), "cm": ("len", 10.0), "m": ("len", 1000.0), "ml": ("vol", 1.0), "l": ("vol", 1000.0),
           "g": ("mass", 1.0), "kg": ("mass", 1000.0)}
CLOSE = 0.8


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def spec_key(c: Column) -> Column:
    return F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), SPACES, "")


def plain_name(c: Column) -> Column:
    """Name without remarks in brackets."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[（(].*?[)）]", ""))


def spec_keyset(folded_text: Column) -> Column:
    """Numbers and scaled measures of a folded specification, as texts."""
    numbers = F.regexp_extract_all(folded_text, F.lit(r"(\d+(?:\.\d+)?)"), 1)
    dims = F.create_map(*[F.lit(x) for u, (d, _) in FACTORS.items() for x in (u, d)])
    scale = F.create_map(*[F.lit(x) for u, (_, s) in FACTORS.items() for x in (u, s)])
    pairs = F.arrays_zip(F.regexp_extract_all(folded_text, F.lit(MEASURE), 1).alias("v"),
                         F.regexp_extract_all(folded_text, F.lit(MEASURE), 2).alias("u"))
    scaled = F.transform(pairs, lambda p: F.concat(
        F.try_element_at(dims, F.lower(p["u"])), F.lit(":"),
        F.round(p["v"].try_cast("double") * F.try_element_at(scale, F.lower(p["u"])), 3).cast("string")))
    return F.array_distinct(F.concat(numbers, scaled))


def close_descriptions(descriptions: DataFrame, ratio: float = CLOSE) -> DataFrame:
    """Near-equal description keys of one name: name, a, b, and whether the ratio is reached read
    as (a, b) (``forward``) and as (b, a) (``backward``); the sequence ratio is not symmetric.

    ``descriptions``: name, key, first (place in the book; a is the earlier one).  A ratio of
    r needs a multiset overlap of at least r/(2-r) of the characters of either key.  So two
    keys meet on one of their rarest characters (prefix filter, exact) and only those pairs
    are verified with the true ratio.
    """
    c = F.col
    d = descriptions.select("name", "key", "first").withColumn("n", F.length("key")).filter("n > 0")
    chars = F.array_sort(F.filter(F.split("key", ""), lambda x: x != ""))
    numbered = F.transform(c("chars"), lambda x, i: F.concat(x, F.lit("#"), (i + 1 - F.array_position(c("chars"), x)).cast("string")))
    long = d.withColumn("chars", chars).select("name", "key", "first", "n", F.explode(numbered).alias("item"))
    freq = long.groupBy("name", "item").agg(F.count(F.lit(1)).alias("f"))
    rare = long.join(freq, ["name", "item"]).groupBy("name", "key", "first", "n").agg(
        F.array_sort(F.collect_list(F.struct("f", "item"))).alias("items"))
    keep = (c("n") - F.ceil(c("n") * F.lit(ratio / (2 - ratio) - 1e-9)) + 1).cast("int")
    probe = rare.select("name", "key", "first", "n", F.explode(F.slice("items", F.lit(1), keep)).alias("x")).select("name", "key", "first", "n", "x.item")
    earlier = F.struct("a.first", "a.key") < F.struct("b.first", "b.key")
    pairs = (
        probe.alias("a").join(probe.alias("b"), ["name", "item"])
        .filter(earlier & (2 * F.least("a.n", "b.n") >= ratio * (c("a.n") + c("b.n"))))
        .select("name", c("a.key").alias("a"), c("b.key").alias("b")).distinct()
    )
    return pairs.withColumns({"forward": _ratio("a", "b") >= ratio, "backward": _ratio("b", "a") >= ratio}).filter("forward OR backward")


def _linked_groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """name, key, cluster: the smallest key reachable by links (name, a, b).

    Each round takes the smallest label among the neighbours and then the label of that
    label, so a chain needs rounds by the logarithm of its length.
    """
    from ..session import discard, materialize

    both = links.select("name", "a", "b").unionByName(links.select("name", F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(nodes.select("name", "key", F.col("key").alias("cluster")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), ["name", "b"]).groupBy("name", F.col("a").alias("key")).agg(F.min("cluster").alias("low"))
        lower = labels.join(near, ["name", "key"], "left").select("name", "key", "cluster", F.least("cluster", F.coalesce("low", "cluster")).alias("low"))
        beyond = labels.select("name", F.col("key").alias("low"), F.col("cluster").alias("lowest"))
        step = lower.join(beyond, ["name", "low"]).select("name", "key", F.col("lowest").alias("cluster"), (F.col("lowest") < F.col("cluster")).alias("moved"))
        step = materialize(step, "labels")
        discard(labels)
        labels = step
        if labels.filter("moved").isEmpty():
            return labels.drop("moved")


def cluster_specs(descriptions: DataFrame, ratio: float = CLOSE, close: DataFrame | None = None) -> DataFrame:
    """Near-duplicate descriptions per name: name, key, cluster, representative (longest, then first in the book).

    ``descriptions``: one row per name and key (see ``spec_key``) with ``first``, its place in
    the book; without that column keys go in alphabetical order.  ``close`` takes pairs that
    ``close_descriptions`` already found.
    """
    from ..session import materialize

    if "first" not in descriptions.columns:
        descriptions = descriptions.select("name", "key", F.col("key").alias("first")).distinct()
    nodes = descriptions.select("name", "key", "first")
    if close is None:
        close = materialize(close_descriptions(nodes, ratio), "close")
    labels = _linked_groups(nodes, close.filter("forward")).join(nodes, ["name", "key"])
    longest = labels.groupBy("name", "cluster").agg(
        F.min_by("key", F.struct(-F.length("key"), "first", "key")).alias("representative"))
    return labels.join(longest, ["name", "cluster"]).select("name", "key", "cluster", "representative")


def backfill_specs(options: DataFrame, history: DataFrame) -> DataFrame:
    """Specification for options without one: record_name and inquiry_spec plus ``filled_spec``
    picked from records of the same plain name.

    One description: take it.  Else the only one (of four or more characters) contained
    in the inquiry text.  Else the representative whose numbers and measures cover the
    inquiry best, if at least half and ahead of the next.

    Works on distinct (name, inquiry text) pairs.  Contained descriptions meet the text on
    their first four characters, covering ones on a shared number or measure, and the members
    of a cluster come from the verified close pairs: no product of texts and descriptions.
    """
    from ..session import materialize

    c = F.col
    specs = history.filter((F.trim("spec") != "") & (F.trim("name") != "")).select(
        plain_name(c("name")).alias("name"), F.trim("spec").alias("raw"), spec_key(F.trim("spec")).alias("key"), "rowid")
    pool = materialize(specs.groupBy("name", "key").agg(F.min_by("raw", "rowid").alias("raw"), F.min("rowid").alias("first")), "descriptions")
    sizes = pool.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("only"))
    want = options.withColumns({"_name": plain_name(c("record_name")), "_asked": F.coalesce("inquiry_spec", F.lit(""))})
    asked = want.select(c("_name").alias("name"), c("_asked").alias("asked")).distinct()

    text = asked.withColumn("ik", spec_key(c("asked")))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("ik") - 3), lambda i: F.substring(c("ik"), i, F.lit(4))))
    heads = text.filter(F.length("ik") >= 4).select("name", "asked", "ik", F.explode(starts).alias("head"))
    long = pool.filter(F.length("key") >= 4).select("name", "key", "raw", F.substring("key", 1, 4).alias("head"))
    hits = heads.join(long, ["name", "head"]).filter(c("ik").contains(c("key"))).groupBy("name", "asked").agg(
        F.count(F.lit(1)).alias("hits"), F.min("raw").alias("hit"))

    close = materialize(close_descriptions(pool), "close")
    reps = cluster_specs(pool, close=close).select("name", "representative").distinct()
    members = (
        reps.select("name", "representative", c("representative").alias("key"))
        .unionByName(reps.join(close.filter("forward").select("name", c("b").alias("representative"), c("a").alias("key")), ["name", "representative"]))
        .unionByName(reps.join(close.filter("backward").select("name", c("a").alias("representative"), c("b").alias("key")), ["name", "representative"]))
    )
    reps = members.join(pool, ["name", "key"]).groupBy("name", "representative").agg(
        F.min_by("raw", F.struct(-F.length("raw"), "first", "key")).alias("raw"))

    def facts(df: DataFrame, column: str) -> DataFrame:
        held = df.withColumn("_t", nfkc(c(column))).withColumn("_keys", spec_keyset(c("_t"))).drop("_t")
        return held.withColumn("keys", F.size("_keys"))

    left = facts(asked, "asked").select("name", "asked", c("keys").alias("_n"), F.explode("_keys").alias("item"))
    right = facts(reps, "raw").select("name", "representative", "raw", c("keys").alias("_m"), F.explode("_keys").alias("item"))
    scored = left.join(right, ["name", "item"]).groupBy("name", "asked", "representative", "raw", "_n", "_m").agg(F.count(F.lit(1)).alias("inter"))
    scored = scored.withColumn("cover", c("inter") / F.least("_n", "_m"))
    # How often the best cover occurs is counted per cover first, then looked at from the top.
    levels = scored.groupBy("name", "asked", "cover").agg(F.count(F.lit(1)).alias("ties"), F.min("raw").alias("raw"))
    best = levels.groupBy("name", "asked").agg(F.max_by(F.struct("cover", "ties", "raw"), "cover").alias("best")).select(
        "name", "asked", F.when((c("best.cover") >= 0.5) & (c("best.ties") == 1), c("best.raw")).alias("covered"))
    filled = (
        asked.join(sizes, "name").join(hits, ["name", "asked"], "left").join(best, ["name", "asked"], "left")
        .select(c("name").alias("_name"), c("asked").alias("_asked"),
                F.when(c("n") == 1, c("only")).when(c("hits") == 1, c("hit")).otherwise(c("covered")).alias("filled_spec"))
    )
    return want.join(filled, ["_name", "_asked"], "left").drop("_name", "_asked")
