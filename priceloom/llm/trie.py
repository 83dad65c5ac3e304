"""The prefix trie of conversations, by van Emde Boas recursion over its height.

A problem is a forest under one named prefix and the sequences below it, of height 2h.  Every
sequence longer than h is cut there; its cut prefix gets a name from the name of the forest's root and that
of the h turns between, and roots a lower forest of height h, while the parts above the cuts make up
an upper trie of height h.  All problems of one height are cut in one job, upper and lower ones
alike, so that a trie of height H takes log2(H) rounds.  Runs of h turns are named before, from pairs of runs
of h / 2.  Totals go the same way: in each round the whole of a lower forest is grafted to the prefix
that roots it, after which both halves are problems of their own.

Rows are never gathered by conversation or prefix: a turn is a row, names are digests of two names,
positions come from sorted ranges, all sums are combinable.  A node's key is (smallest member, depth).  The
one digest over a list of unbounded length (who ends at a node) is fed from sorted chunks of
4,096 ids at most, one chunk in memory at a time.

Defined cases: turns are ordered by ``turn`` (NULL first), equal ones by the digest of role and text; NULL
roles and texts are empty; repeated rows are turns of their own; rows without a conv_id belong to no
conversation; conversations without rebuilt turns are members of the root alone; extra columns are ignored; an
empty table gives an empty result.  Names are 128-bit digests.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, word_count

#: One string of a node's ends holds at most 2**CHUNK_BITS ids.
CHUNK_BITS = 12


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, at, sym, words): turns as digests with their places from 0; a conversation may span any number of tasks."""
    from ..session import materialize

    c = F.col
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", _digest(F.length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary")).alias("sym"),
        word_count(c("text")).alias("words"))
    order = [c("turn").asc_nulls_first(), c("sym").asc()]
    rows = materialize(rows.repartitionByRange(c("conv_id").asc(), *order).withColumn("part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "part").count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    rows = rows.withColumn("inside", inside).join(before.select("conv_id", "part", "before"), ["conv_id", "part"])
    return materialize(rows.select("conv_id", (c("inside") + c("before")).alias("at"), "sym", "words"), "turns")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n) and their turns (conv_id, at, sym, words) with an opening of crc32(id) % ``most`` turns taken from the
    conversation whose id is the next lower multiple of ``group``; numbered turns in.
    """
    from ..session import materialize

    c = F.col
    taken = (F.crc32(c("conv_id").cast("string").cast("binary")) % most).alias("taken")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"taken": taken, "source": c("conv_id") - c("conv_id") % group})
    convs = materialize(convs, "conversations")
    lengths = convs.select(c("conv_id").alias("source"), c("own").alias("there"))
    convs = convs.join(lengths, "source", "left").withColumn("head", F.least("taken", F.coalesce("there", F.lit(0))))
    heads = turns.filter(c("at") < most).withColumnRenamed("conv_id", "source").join(convs.select("conv_id", "source", "taken"), "source").filter("at < taken")
    tails = turns.join(convs.select("conv_id", "taken", "head"), "conv_id").filter("at >= taken").withColumn("at", c("at") - c("taken") + c("head"))
    fields = ["conv_id", "at", "sym", "words"]
    lengths = convs.select("conv_id", (c("head") + F.greatest(c("own") - c("taken"), F.lit(0))).alias("n"))
    return materialize(lengths, "lengths"), materialize(heads.select(fields).unionByName(tails.select(fields)), "rebuilt")


def prefix_names(convs: DataFrame, turns: DataFrame, height: int) -> DataFrame:
    """(conv_id, depth, name) of all prefixes; ``height`` is a power of two above every length."""
    from ..session import materialize

    c = F.col
    # Names of aligned runs of 1, 2, 4 ... turns: (conv_id, run, name) by their length.
    runs, h = {1: turns.select("conv_id", c("at").alias("run"), c("sym").alias("name"))}, 1
    while 2 * h < height:
        half = lambda k: F.max(F.when(c("run") % 2 == k, c("name")))
        pairs = runs[h].groupBy("conv_id", F.floor(c("run") / 2).alias("run")).agg(half(0).alias("one"), half(1).alias("two")).filter("two IS NOT NULL")
        h *= 2
        runs[h] = materialize(pairs.select("conv_id", "run", _digest(c("one"), c("two")).alias("name")), "runs")
    names = materialize(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.md5(F.lit(""))).alias("name")), "names")
    h = height // 2
    while h:
        above = runs[h].select("conv_id", (c("run") * h).alias("depth"), c("name").alias("way"))
        cut = names.join(above, ["conv_id", "depth"]).select("conv_id", (c("depth") + h).alias("depth"), _digest(c("name"), c("way")).alias("name"))
        names = names.unionByName(materialize(cut, "names"))
        h //= 2
    return names


def grafted(nodes: DataFrame, paths: DataFrame, height: int, values: list[str]) -> DataFrame:
    """nodes (conv_id, depth, values) with the sums of their subtrees.  paths: (member, depth, conv_id: the node's key)."""
    from ..session import materialize

    c = F.col
    held, h = materialize(nodes.select("conv_id", "depth", *values).filter("depth > 0"), "values"), height // 2
    while h:
        top = F.floor((c("depth") - 1) / (2 * h)) * (2 * h)
        lower = held.filter(c("depth") - top > h).groupBy(c("conv_id").alias("member"), (top + h).alias("depth")).agg(*[F.sum(v).alias(v) for v in values])
        grafts = lower.join(paths, ["member", "depth"]).select("conv_id", "depth", *values)
        # A prefix has its own row and a graft from each key below it.
        held = materialize(held.unionByName(grafts).groupBy("conv_id", "depth").agg(*[F.sum(v).alias(v) for v in values]), "values")
        h //= 2
    root = nodes.groupBy().agg(F.min("conv_id").alias("conv_id"), *[F.sum(v).alias(v) for v in values]).filter("conv_id IS NOT NULL")
    return held.unionByName(root.withColumn("depth", F.lit(0).cast("long")))


def list_digests(lists: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, digest): SHA-256 of each key's distinct values, ascending, in decimal, joined by commas."""
    c = F.col
    chunks = lists.groupBy(*keys, F.shiftright(value, CHUNK_BITS).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list(value)).cast("array<string>"), ",").alias("part"))
    kinds = ", ".join(f"{k} {t}" for k, t in lists.select(keys).dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def handed():
            columns = [pa.array([r[0][i] for r in done], f.type) for i, f in enumerate(schema)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in done], pa.string())], names=[*keys, "digest"])

        schema = None
        for batch in batches:
            schema = schema or [batch.schema.field(k) for k in keys]
            for *now, part in zip(*[batch.column(k).to_pylist() for k in [*keys, "part"]]):
                if now != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(part.encode())
            if done:
                yield handed()
                done = []
        if state:
            done.append((key, state.hexdigest()))
            yield handed()

    return chunks.repartition(*keys).sortWithinPartitions(*keys, "chunk").mapInArrow(scan, f"{kinds}, digest string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    from ..session import materialize

    c = F.col
    convs, turns = rebuilt(numbered(conversations.select("conv_id", "turn", "role", "text")))
    height = 1
    while height <= (convs.agg(F.max("n")).first()[0] or 0):
        height *= 2
    names = prefix_names(convs, turns, height)
    # Written before it is joined, so that the rows of a common prefix are no longer bound to one task.
    owners = materialize(names.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "owners")
    paths = materialize(names.select("name", c("conv_id").alias("member"), "depth").join(owners, "name").select("member", "depth", "conv_id", "n_convs"), "paths")
    nodes = paths.filter("member = conv_id").select("conv_id", "depth", "n_convs")
    parents = paths.select(c("member").alias("conv_id"), (c("depth") + 1).alias("depth"), c("conv_id").alias("parent_conv_id"))
    words = turns.select("conv_id", (c("at") + 1).alias("depth"), "words")
    nodes = nodes.join(parents, ["conv_id", "depth"], "left").join(words, ["conv_id", "depth"], "left")
    nodes = materialize(nodes.withColumn("saved", (c("n_convs") - 1) * F.coalesce("words", F.lit(0))).drop("words"), "nodes")
    children = nodes.filter("depth > 0").groupBy(c("parent_conv_id").alias("conv_id"), (c("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.withColumn("leaf", (c("n_children") == 0).cast("long")), "nodes")
    totals = grafted(nodes, paths.select("member", "depth", "conv_id"), height, ["leaf", "saved"]).select(
        "conv_id", "depth", c("leaf").alias("n_leaves"), c("saved").alias("saved_tokens"))
    ends = convs.select(c("conv_id").alias("member"), c("n").alias("depth")).join(paths, ["member", "depth"])
    ends = list_digests(ends.select("conv_id", "depth", "member"), ["conv_id", "depth"], "member")
    out = nodes.join(totals, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
    whole = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(*[c(x).cast("long").alias(x) for x in whole], F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


OP13_SQL = r"""WITH o AS (SELECT conv_id, {'r': coalesce(role,''), 't': coalesce(text,'')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role,''))||':'||coalesce(role,'')||coalesce(text,''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
 l AS (SELECT conv_id, list(x ORDER BY k) AS s FROM o GROUP BY 1),
 h AS (SELECT conv_id, s, conv_id - conv_id % 20 AS b, xor(list_reduce(list_transform(range(1, length(conv_id::VARCHAR)+1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT), lambda a, v: list_reduce(range(8), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)), xor(a, v)), 4294967295), 4294967295) % 4 AS h FROM l),
 c AS (SELECT h.conv_id, list_concat(coalesce(p.s, [])[1:h.h], h.s[h.h+1:]) AS s FROM h LEFT JOIN l p ON p.conv_id = h.b),
 f AS (SELECT conv_id, d, s[1:d] AS p, d = len(s) AS e FROM c, unnest(range(0, len(s)+1)) t(d)),
 n AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE e), '') AS ends FROM f GROUP BY 1, 2),
 k AS (SELECT d-1 AS d, p[1:d-1] AS p, count(*) AS n FROM n WHERE d > 0 GROUP BY 1, 2),
 v AS (SELECT n.*, coalesce(k.n, 0) AS kids, CASE WHEN n.d > 0 THEN (n.n-1) * len(regexp_extract_all(n.p[n.d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own FROM n LEFT JOIN k ON k.d=n.d AND k.p=n.p),
 u AS (SELECT a AS d, p[1:a] AS p, sum((kids=0)::BIGINT) AS leaves, sum(own) AS saved FROM v, unnest(range(0, d+1)) t(a) GROUP BY 1, 2)
SELECT v.conv_id, v.d AS depth, q.conv_id AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN u ON u.d=v.d AND u.p=v.p LEFT JOIN n q ON q.d=v.d-1 AND q.p=v.p[1:v.d-1] AND v.d > 0"""


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return trie(table(spark, sf_dir, "conversations"))
