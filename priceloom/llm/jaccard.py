"""N-gram Jaccard self-join with set-relation skipping, and the groups its links form.

A document's set is its distinct word shingles (hashed to 64 bits; equal sets are one set
from then on).  Two sets of Jaccard similarity t or more share a token among the first
n - ceil(t n) + 1 of each, in any order of tokens that both use; here rare tokens come
first, as told by a fixed-size counting sketch of all shingles.

- *Index-level skipping.*  Lists of a token are cut into blocks by set size: a set meets
  only its own and the next block, and there only sets whose positions leave room for
  enough common tokens.
- *Answer-level skipping.*  Sets that share min-hashes are compared with the smallest of
  them, their pivot.  A set with a verified pivot has the pivot's answers: sets that are
  connected already are never paired in any list, so a group of k near copies costs about k
  comparisons instead of k squared.  Of other pairs, those of pivots are compared first, and
  the distances to the pivots decide most pairs of their followers by the triangle
  inequality of the Jaccard distance, upwards and downwards.  Only the rest is compared.

No link is lost: prefixes, blocks and positions are exact filters, skipped pairs are
connected or decided by a bound, all others are compared in full.

Defined cases: NULL and blank texts have the empty set, which links with nothing, not even
another empty one; a text with fewer words than a shingle is one shingle; a NULL doc_id is a
component of its own (NULL); rows that share a doc_id are one document, which has all their
links; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SMALL_BATCHES, table, text_slices
from .links import components

SHINGLE = 5
#: Per cent.
THRESHOLD = 80
#: Min-hash signatures per set, and min-hashes in each.
SIGNATURES, PER_SIGNATURE = 4, 3
#: The sketch of token counts has 2**CELL_BITS cells in 2**CHUNK_BITS parts: 32 MB, whatever the corpus.
CELL_BITS, CHUNK_BITS = 25, 7
FLUSH = 5_000_000

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(0, 2 ** 63, 256, np.int64).astype(np.uint64)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2 ** 64))
_WEIGHT = np.random.default_rng(8).integers(0, 2 ** 62, SHINGLE, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PERMUTE = np.random.default_rng(9).integers(0, 2 ** 62, (2, SIGNATURES * PER_SIGNATURE), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A word's hash is a polynomial in its bytes, got from running sums over the whole buffer.
    """
    rows = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * rows
    blank = _BLANK[data]
    before = np.concatenate([[True], blank[:-1]])
    after = np.concatenate([blank[1:], [True]])
    inside = offsets[:-1][np.diff(offsets) > 0]
    before[inside] = True
    after[offsets[1:][np.diff(offsets) > 0] - 1] = True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(data), _BASE, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers)])
        back = np.cumprod(np.full(len(data), _BACK, np.uint64))
        words = _mixed((sums[ends] - sums[starts]) * back[starts])
        bounds = np.searchsorted(starts, offsets)
        many = max(len(words) - SHINGLE + 1, 0)
        grams = np.zeros(many, np.uint64)
        for k in range(SHINGLE):
            grams += words[k:k + many] * _WEIGHT[k]
        grams = _mixed(grams)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= SHINGLE:
                out.append(np.unique(grams[a:b - SHINGLE + 1]))
            elif b > a:
                out.append(_mixed((words[a:b] * _WEIGHT[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def signatures(tokens: np.ndarray) -> list[int]:
    with np.errstate(over="ignore"):
        low = _mixed(tokens[:, None] * _PERMUTE[0] + _PERMUTE[1]).min(axis=0).reshape(SIGNATURES, PER_SIGNATURE)
        mixed = _mixed((low * _WEIGHT[:PER_SIGNATURE]).sum(axis=1) + np.arange(SIGNATURES, dtype=np.uint64))
    return mixed.astype(np.int64).tolist()


def cells_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def overlap(n: int, percent: int = THRESHOLD) -> int:
    """Least number of tokens a set of n shares with a partner."""
    return -(-percent * n // 100)


def _texts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else [None] * len(batch)
        for first, last, data, offsets in text_slices(batch.column("text")):
            yield ids[first:last], shingle_sets(data, offsets)


def profiles(docs: DataFrame) -> DataFrame:
    """A row (doc_id, n, key, sig) per document."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _texts(batches):
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()),
                pa.array([signatures(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "key", "sig"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, n bigint, key binary, sig array<bigint>")


def sketches(docs: DataFrame) -> DataFrame:
    """(chunk, cells): parts of the sketch of token counts, summed over a task's texts.

    A pass of its own over the texts: its rows go straight to the sums and are never stored.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, sets in _texts(batches):
            for s in sets:
                held.append(cells_of(s).astype(np.int32))
                size += len(s)
            if size >= FLUSH:
                yield parts(held)
                held, size = [], 0
        if size:
            yield parts(held)

    def parts(held):
        cells = np.concatenate(held)
        cells.sort()
        width = 1 << CELL_BITS - CHUNK_BITS
        cuts = np.searchsorted(cells, np.arange((1 << CHUNK_BITS) + 1) * width)
        packed = []
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            part = np.minimum(np.bincount(cells[a:b] - k * width, minlength=width), 255).astype(np.uint8)
            packed.append(zlib.compress(part.tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "cells"])

    return docs.select("text").mapInArrow(scan, "chunk int, cells binary")


def rarity(parts: DataFrame, mean: float) -> bytes:
    """For each cell a level that rises with its count, one byte each.

    Other tokens in a cell add noise of about the root of the ``mean`` count, so levels are
    steps of half of that: roots of counts, centred on the mean's.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("cells")):
                cells = np.frombuffer(zlib.decompress(part.as_py()), np.uint8)
                if chunk in sums:
                    sums[chunk] += cells
                else:
                    sums[chunk] = cells.astype(np.int64)
        for chunk, cells in sums.items():
            level = np.clip(4 * (np.sqrt(cells) - np.sqrt(mean)) + 40, 0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["chunk", "cells"])

    rows = parts.repartition(1 << CHUNK_BITS, "chunk").mapInArrow(add, "chunk int, cells binary").collect()  # 128 rows of 256 KB at most
    known = {r["chunk"]: zlib.decompress(r["cells"]) for r in rows}
    return b"".join(known.get(k, bytes(1 << CELL_BITS - CHUNK_BITS)) for k in range(1 << CHUNK_BITS))


def postings(docs: DataFrame, sent, percent: int = THRESHOLD) -> DataFrame:
    """(token, key, n, place): the prefix of every set, rare tokens first.  A task writes a set once, however many copies it has.

    sent: the broadcast levels of ``rarity``.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(sent.value, np.uint8)
        seen: set[bytes] = set()
        for _, sets in _texts(batches):
            tokens, keys, sizes, places = [], [], [], []
            for s in sets:
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                take = len(s) - overlap(len(s), percent) + 1
                tokens.append(s[np.argsort(level[cells_of(s)], kind="stable")[:take]])
                keys.append(key)
                sizes.append(len(s))
                places.append(np.arange(take, dtype=np.int32))
            if keys:
                counts = [len(t) for t in tokens]
                index = pa.array(np.repeat(np.arange(len(keys)), counts), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(tokens).view(np.int64)), pa.array(keys, pa.binary()).take(index),
                    pa.array(np.repeat(np.array(sizes, np.int32), counts)), pa.array(np.concatenate(places))], names=["token", "key", "n", "place"])

    return docs.select("doc_id", "text").mapInArrow(scan, "token bigint, key binary, n int, place int")


def whole_sets(docs: DataFrame) -> DataFrame:
    """(key, tokens): the sets themselves, six bytes of each hash."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _texts(batches):
            yield pa.RecordBatch.from_arrays([
                pa.array([set_key(s) for s in sets], pa.binary()),
                pa.array([np.sort(s).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for s in sets], pa.binary())], names=["key", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(scan, "key binary, tokens binary")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b: nodes) with ``common`` and ``joint``: sizes of intersection and union.  sets: (node, tokens)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes(x):
            packed = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6)
            full = np.zeros((len(packed), 8), np.uint8)
            full[:, 2:] = packed
            return full.view(np.uint64).ravel()

        for batch in batches:
            common, joint = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = hashes(x), hashes(y)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common.append(int((both[1:] == both[:-1]).sum()))
                joint.append(len(both) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(joint, pa.int64())],
                                             names=["a", "b", "common", "joint"])

    one = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    two = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "x", "y").mapInArrow(scan, "a bigint, b bigint, common bigint, joint bigint")


def similarity_groups(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs (doc_id, text)."""
    from ..session import settings

    # All that goes through Python is written inside.
    with settings(docs.sparkSession, SMALL_BATCHES):
        return _groups(docs, percent)


def _groups(docs: DataFrame, percent: int) -> DataFrame:
    from ..session import discard, materialize

    c = F.col
    rows = materialize(profiles(docs), "profiles")
    total = rows.agg(F.sum("n")).first()[0] or 0
    levels = docs.sparkSession.sparkContext.broadcast(rarity(sketches(docs), total / (1 << CELL_BITS)))
    sets = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # A set's node is the smallest id that has it; if that id has other sets, they get numbers above all ids.
    place = F.row_number().over(Window.partitionBy("doc").orderBy("key"))
    sets = materialize(sets.withColumn("node", F.when(place == 1, c("doc")).otherwise(
        F.shiftrightunsigned(F.xxhash64("key"), 3) + F.lit(1 << 61))).withColumn("k", F.xxhash64("key")), "sets")
    # Tokens that at least two different sets have in their prefixes; every link has one.
    by_token = Window.partitionBy("token")
    # Lists go by a 64-bit name of the set, size and place in one number: they are the bulk of what is shuffled.
    lists = postings(docs.filter("doc_id IS NOT NULL"), levels, percent).select(
        "token", F.xxhash64("key").alias("k"), (F.shiftleft(c("n").cast("long"), 32) + c("place")).alias("at"))
    lists = lists.withColumns({"_low": F.min("k").over(by_token), "_high": F.max("k").over(by_token)})
    lists = materialize(lists.filter("_low != _high").select("token", "k", "at"), "lists")
    levels.destroy()  # 32 MB in the driver and every executor
    asked = sets.join(lists.select("k").distinct(), "k", "left_semi")

    def contents(pairs: DataFrame) -> DataFrame:
        """The sets of all nodes in pairs: their texts are read again, so that sets of others are never stored."""
        nodes = pairs.select(F.explode(F.array_distinct(F.array(*pairs.columns))).alias("node")).distinct()
        wanted = materialize(sets.select("node", "doc", "key").join(nodes, "node", "left_semi"), "wanted")
        texts = docs.select("doc_id", "text").join(wanted.select(c("doc").alias("doc_id")), "doc_id", "left_semi")
        # Rows that repeat give a set more than once.
        found = whole_sets(texts).groupBy("key").agg(F.first("tokens").alias("tokens"))
        return materialize(found.join(wanted, "key").select("node", "tokens"), "tokens")

    linked = (100 * c("common") >= percent * c("joint"))
    distance = 1 - c("common") / c("joint")
    # Pivots: the smallest set of each group of equal signatures.
    signed = asked.select("node", F.explode("sig").alias("s"))
    pivots = signed.groupBy("s").agg(F.min("node").alias("a"), F.max("node").alias("top")).filter("a != top").select("s", "a")
    star = signed.withColumnRenamed("node", "b").join(pivots, "s").filter("a != b").select("a", "b").distinct()
    star = materialize(star, "star_pairs")
    shown = contents(star)
    star = materialize(compared(star, shown).filter(linked).select("a", "b", distance.alias("far")), "star")
    discard(shown)
    follows = star.groupBy("b").agg(F.min(F.struct("far", "a")).alias("p")).select(c("b").alias("node"), c("p.a").alias("pivot"), c("p.far").alias("far"))
    homes = components(star)
    # Sets of the lists with what they are known to be connected to; lists within one home are done.
    known = materialize(asked.select("k", "node").join(homes, "node", "left").join(follows, "node", "left").select(
        "k", "node", F.coalesce("home", "node").alias("home"), F.coalesce("pivot", "node").alias("pivot"), F.coalesce("far", F.lit(0.0)).alias("far")), "known")
    open_lists = lists.join(known, "k").withColumns({
        "n": F.shiftright("at", 32).cast("int"), "place": c("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"),
        "_low": F.min("home").over(by_token), "_high": F.max("home").over(by_token)}).filter("_low != _high")
    block = F.floor(F.log(c("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9)
    open_lists = materialize(open_lists.select("token", "node", "home", "pivot", "far", "n", "place").withColumn("block", block.cast("int")), "open_lists")
    discard(lists)
    fields = ("node", "home", "pivot", "far", "n", "place")
    small = open_lists.select("token", F.explode(F.array(c("block"), c("block") + 1)).alias("block"), *[c(x).alias(f"a_{x}") for x in fields])
    large = open_lists.select("token", "block", *[c(x).alias(f"b_{x}") for x in fields])
    room = F.least(c("a_n") - c("a_place"), c("b_n") - c("b_place"))
    pairs = small.join(large, ["token", "block"]).filter(
        (c("a_home") != c("b_home")) & ((c("a_n") < c("b_n")) | ((c("a_n") == c("b_n")) & (c("a_node") < c("b_node"))))
        & (100 * c("a_n") >= percent * c("b_n")) & ((100 + percent) * room >= percent * (c("a_n") + c("b_n"))))
    pairs = materialize(pairs.select(c("a_node").alias("a"), c("b_node").alias("b"), "a_pivot", "b_pivot", (c("a_far") + c("b_far")).alias("slack")).distinct(), "pairs")
    discard(open_lists)
    # First the pivots' pairs, then what they leave open.
    whole = contents(pairs.select("a", "b", "a_pivot", "b_pivot"))
    p, q = F.least("a_pivot", "b_pivot"), F.greatest("a_pivot", "b_pivot")
    heads = materialize(compared(pairs.select(p.alias("a"), q.alias("b")).filter("a != b").distinct(), whole).select(
        c("a").alias("p"), c("b").alias("q"), "common", "joint"), "heads")
    limit = 1 - percent / 100
    judged = pairs.join(heads, (p == c("p")) & (q == c("q")), "left")
    judged = judged.withColumn("far", F.when(c("p").isNull(), F.lit(0.0)).otherwise(distance))
    # Rounding must not decide: bounds count only where they are clear.
    judged = judged.filter(c("far") - c("slack") <= limit + 1e-9).withColumns({
        "sure": (c("far") + c("slack") < limit - 1e-9) | (c("slack") == 0) & c("p").isNotNull(), "near": linked})
    judged = materialize(judged.select("a", "b", "slack", "sure", F.when(c("slack") == 0, c("near")).otherwise(F.lit(True)).alias("near")), "judged")
    rest = compared(judged.filter("NOT sure").select("a", "b"), whole).filter(linked)
    links = star.select("a", "b").unionByName(judged.filter("sure AND near").select("a", "b")).unionByName(rest.select("a", "b"))
    # A document that has several texts connects their sets; it is a node itself, whoever else has its texts.
    numbered = rows.filter("doc_id IS NOT NULL")
    several = materialize(numbered.groupBy("doc_id").agg(F.min(F.xxhash64("key")).alias("_low"), F.max(F.xxhash64("key")).alias("_high")).filter(
        "_low != _high").select("doc_id"), "several")
    bridges = numbered.filter("n > 0").join(several, "doc_id", "left_semi").select("doc_id", "key").join(sets.select("key", "node"), "key").select(
        c("node").alias("a"), c("doc_id").alias("b"))
    homes = components(links.unionByName(bridges))
    discard(whole)
    named = sets.select("key", "node").join(homes, "node", "left").select("key", F.coalesce("home", "node").alias("component"))
    found = rows.join(named, "key", "left")
    # A blank text of a document that has others too goes with them.
    blank = materialize(several.join(homes.withColumnRenamed("node", "doc_id"), "doc_id").select(c("doc_id").alias("_id"), "home"), "blank")
    found = found.join(blank, (c("n") == 0) & (c("doc_id") == c("_id")), "left")
    return found.select("doc_id", c("n").alias("n_shingles"), F.when(c("doc_id").isNotNull(), F.coalesce("component", "home", "doc_id")).alias("component_id"))


OP2_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM d, unnest(range(1, greatest(len(w)-4, 1)+1)) t(i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g=y.g AND x.doc_id<y.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n u ON u.doc_id=a JOIN n v ON v.doc_id=b WHERE 100*k >= 80*(u.n+v.n-k)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a=r.b),
 m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id=d.doc_id LEFT JOIN m ON m.a=d.doc_id"""


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.8 or more."""
    return similarity_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
