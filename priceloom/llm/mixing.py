"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents fall into a fixed number of blocks by a hash of their id.  The
blocks of a source in seeded order, once per pass over the source, are its stream; the
source's quota is the head of that stream that fills its target.  A binary tree splits the
vector of quotas among the output shards: at each node the left half of the places is
filled by a multivariate hypergeometric draw, so that every shard gets what a random deal
of all blocks would give it, while every quota is kept exactly and only numbers of blocks
move through the tree.  A shard then draws the next blocks of each source's stream, so no
block is drawn twice in a pass, and shuffles its rows by a seeded hash.

The last block of a source is cut at the target: its documents are taken in hash order,
the last one in part (``whole=False``) or wholly where at least half of it fits
(``whole=True``).  All draws hash (seed, node, source), so reruns agree.

Defined cases: NULL is a source of its own, after all others; NULL or blank texts have size
0, cost nothing and are drawn in the first pass only; equal targets, ids or rows need no
tie rule, since rows that share an id share a block; an empty table gives an empty mix.
Columns of the input whose names clash with result columns are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import hash_bits, table, word_count

#: Weights by order of the source, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has this many times the words of all sources; a source is repeated MOST times at most.
SHARE, MOST = 1.5, 2
#: Blocks per source.  More make the tree finer and the cut block smaller; the block table has
#: sources x BLOCKS rows, whatever the number of documents.
BLOCKS = 128
LEVELS = 4
SEED = 0
_UNIT = float(16 ** 12)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with ``place`` (from 0), ``target``.

    The level at which all sources share by weight and none is above its limit is the
    largest of the levels got by giving the k sources with the least limit per weight their
    limit and sharing the rest.
    """
    c = F.col
    order = Window.orderBy(c("source").asc_nulls_last())
    ranked = sources.withColumn("place", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), c("place") % len(weights)))
    ranked = ranked.withColumn("_cap", c("source_size") * float(most))
    # Among all sources: one row each, already summed.
    everything = Window.partitionBy()
    less = Window.orderBy(c("_cap") / c("_w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    ranked = ranked.withColumn("_level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(less), zero))
                               / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(less), zero)))
    level = F.max("_level").over(everything)
    return ranked.withColumn("target", F.least(c("_cap"), level * c("_w"))).drop("_w", "_cap", "_level")


def _hypergeometric(p: Column) -> Column:
    """How many of p.n places drawn from p.all go to a kind that has p.kind of them, by inversion with p.u.

    Weights are relative to the mode's; the walk covers twelve standard deviations.
    """
    n, kind, total, u = (p[x].cast("double") for x in ("n", "kind", "all", "u"))
    other = total - kind
    mode = F.floor((n + 1) * (kind + 1) / (total + 2)).cast("double")
    share = kind / F.greatest(total, F.lit(1.0))
    reach = F.ceil(12 * F.sqrt(F.greatest(n * share * (1 - share), F.lit(0.0)))).cast("int") + 25
    steps = F.sequence(F.lit(1), reach)

    def walk(weight):
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(steps, start, lambda a, i: F.get(F.transform(F.array(weight(a["w"], i.cast("double"))), lambda w: F.struct(
            w.alias("w"), (a["sum"] + w).alias("sum"))), 0), lambda a: a["sum"])

    def up(w, i):  # from mode+i-1 to mode+i
        k = mode + i - 1
        return w * (kind - k) * (n - k) / ((k + 1) * (other - n + k + 1))

    def down(w, i):
        k = mode - i + 1
        return w * k * (other - n + k) / ((kind - k + 1) * (n - k + 1))

    def pick(weight, sign, left, else_value):
        """The k at which the walk has used up ``left``."""
        start = F.struct(F.lit(1.0).alias("w"), left.alias("left"), F.lit(None).cast("double").alias("k"))
        return F.aggregate(steps, start, lambda a, i: F.get(F.transform(F.array(weight(a["w"], i.cast("double"))), lambda w: F.struct(
            w.alias("w"), (a["left"] - w).alias("left"),
            F.coalesce(a["k"], F.when(a["left"] < w, mode + sign * i)).alias("k"))), 0), lambda a: F.coalesce(a["k"], else_value))

    def settle(s: Column) -> Column:
        at = u * (1 + s["up"] + s["down"])
        return F.when(at < 1, mode).when(at < 1 + s["up"], pick(up, 1, at - 1, mode)).otherwise(pick(down, -1, at - 1 - s["up"], mode))

    return F.get(F.transform(F.array(F.struct(walk(up).alias("up"), walk(down).alias("down"))), settle), 0).cast("long")


def splitting_tree(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """quotas (place, quota: blocks) dealt to 2**levels shards: (place, shard, quota)."""
    c = F.col
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "quota"))).alias("_all")).select(
        F.lit(0).cast("long").alias("node"), F.transform("_all", lambda x: x["quota"]).alias("quota"))

    def total(array):
        return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)

    for level in range(levels):
        half = F.floor((total(c("quota")) + hash_bits(F.lit(seed), F.lit("odd"), F.lit(level), c("node")) % 2) / 2).cast("long")

        def deal(taken, j):
            place = F.struct(
                (c("_half") - total(taken)).alias("n"), F.get("quota", j).alias("kind"), total(F.slice(c("quota"), j + 1, F.size("quota"))).alias("all"),
                (hash_bits(F.lit(seed), F.lit("tree"), F.lit(level), c("node"), j) / _UNIT).alias("u"))
            return F.array_append(taken, F.get(F.transform(F.array(place), _hypergeometric), 0))

        node = node.filter(F.size("quota") > 0).withColumn("_half", half)
        node = node.withColumn("_left", F.aggregate(F.sequence(F.lit(0), F.size("quota") - 1), F.array().cast("array<bigint>"), deal))
        node = node.select(F.explode(F.array(
            F.struct((c("node") * 2).alias("node"), c("_left").alias("quota")),
            F.struct((c("node") * 2 + 1).alias("node"), F.zip_with("quota", "_left", lambda q, x: q - x).alias("quota")))).alias("x")).select("x.*")
    return node.select(c("node").cast("int").alias("shard"), F.posexplode("quota").alias("place", "quota"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, blocks: int = BLOCKS, levels: int = LEVELS,
        seed: int = SEED, whole: bool = False) -> DataFrame:
    """docs (doc_id, source, size and any others), one row each, with ``source_size``, ``target``, ``taken`` (words) and
    ``draws``: (copy, shard, words, position) for each pass in which the mix takes some of it.
    """
    c = F.col
    docs = docs.drop("source_size", "target", "taken", "draws")
    docs = docs.withColumn("_block", hash_bits(F.lit(seed), F.lit("block"), c("doc_id")) % blocks)
    # Sources x blocks rows: written, or every step below plans and reads all documents again, in each of its copies.
    sizes = materialize(docs.groupBy("source", "_block").agg(F.sum("size").alias("_size")), "block-sizes")
    goals = targets(sizes.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, most)
    # Each source's stream of blocks, pass by pass in seeded order.
    stream = sizes.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    stream = stream.withColumn("_order", hash_bits(F.lit(seed), F.lit("order"), c("_copy"), c("source"), c("_block")))
    line = Window.partitionBy("source").orderBy("_copy", "_order", "_block")
    stream = stream.withColumn("_end", F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stream = stream.join(goals, stream["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    goal = F.floor("target").cast("long")
    start = c("_end") - c("_size")
    stream = stream.filter(((c("_end") <= goal) & (c("_copy") == 0)) | (start < goal)).withColumns({
        "_rest": F.when(c("_end") > goal, goal - start), "_rank": F.row_number().over(line) - 1})
    # The tree deals the quotas; a shard's blocks are the next ones of each stream.
    dealt = splitting_tree(stream.groupBy("place").agg(F.count(F.lit(1)).alias("quota")), levels, seed)
    upto = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = dealt.withColumn("_upto", F.sum("quota").over(upto)).groupBy("place").agg(F.array_sort(F.collect_list("_upto")).alias("_ends"))
    stream = stream.join(ends, "place")
    stream = stream.withColumn("_shard", F.size(F.filter("_ends", lambda e: e <= c("_rank"))))
    drawn = stream.filter(c("_shard") < 2 ** levels).groupBy("source", "_block").agg(
        F.array_sort(F.collect_list(F.struct(c("_copy").alias("copy"), c("_shard").alias("shard"), c("_rest").alias("rest")))).alias("_draws"))
    kept = sizes.select("source", "_block").join(
        drawn.withColumnsRenamed({"source": "_s", "_block": "_b"}), c("source").eqNullSafe(c("_s")) & (c("_block") == c("_b")), "left").join(
        goals.withColumnRenamed("source", "_g"), c("source").eqNullSafe(c("_g"))).select(
        c("source").alias("_s"), c("_block").alias("_b"), "source_size", "target",
        F.coalesce("_draws", F.array().cast("array<struct<copy:int,shard:int,rest:bigint>>")).alias("_draws"))
    kept = materialize(kept, "block-draws")
    rows = docs.join(kept, c("source").eqNullSafe(c("_s")) & (c("_block") == c("_b"))).drop("_s", "_b")
    cut = F.exists("_draws", lambda d: d["rest"].isNotNull())
    inside = Window.partitionBy("source", "_block").orderBy(
        hash_bits(F.lit(seed), F.lit("inside"), c("doc_id")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.filter(cut).withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("long"))
    rows = rows.filter(~cut).withColumn("_before", F.lit(0).cast("long")).unionByName(edge)
    part = (lambda left: F.when((left > 0) & (2 * left >= c("size")), c("size")).otherwise(0)) if whole else (
        lambda left: F.least(F.greatest(left, F.lit(0)), c("size")))
    drew = F.transform("_draws", lambda d: F.struct(
        d["copy"].alias("copy"), d["shard"].alias("shard"),
        F.when(d["rest"].isNull(), c("size")).otherwise(part(d["rest"] - c("_before"))).cast("long").alias("words"),
        hash_bits(F.lit(seed), F.lit("local"), d["shard"], d["copy"], c("doc_id")).alias("position")))
    drew = F.filter(drew, lambda d: (d["words"] > 0) | ((c("size") == 0) & (d["copy"] == 0)))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return rows.withColumn("draws", drew).withColumn("taken", taken).drop("_block", "_before", "_draws")


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: one row per draw, shard by shard and each shard's rows in shuffled order.

    A shard is cut into ranges of positions, one partition each, so that the partitions are about as many as the session's
    shuffle partitions, however few shards there are.
    """
    out = mix(docs.withColumn("size", word_count(F.col("text"))), whole=True, **how)
    out = out.withColumn("_d", F.explode("draws")).withColumn("_shard", F.col("_d.shard"))
    shards = 2 ** how.get("levels", LEVELS)
    ranges = max(1, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    part = F.col("_shard") * ranges + F.floor(F.col("_d.position") / _UNIT * ranges)
    return out.repartitionById(shards * ranges, part.cast("int")).sortWithinPartitions("_shard", "_d.position").select(*docs.columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and in which shard and place of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(materialize(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken", "draws")
