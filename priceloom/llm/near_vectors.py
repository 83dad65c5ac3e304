"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables, checked with the vectors themselves.

*Codes.*  From a bounded sample: the mean and principal directions of the normalised vectors, then rotations that
bring their projections as near as possible to corners of a cube (alternating signs and an orthogonal
Procrustes problem), each from its own random start.  The signs are a code; every distinct vector gets one.

*Tables.*  A code is cut into substrings of about log2(n / FILL) bits, a table for each; vectors that agree
in a substring meet in a bucket.  How many tables there are, and how many bits of a bucket's two codes may differ, is
measured on pairs that lie exactly at the threshold angle (sample vectors turned towards other ones), so
that at least ``RECALL`` of such pairs are found; closer pairs are found more often.

*Bounded buckets.*  Only (bucket, vector, 64 bits of code) is shuffled for the tables.  A bucket of more than
``BUCKET`` rows is cut into blocks that meet in pairs, so nothing is left out.  A vector with more than ``DENSE``
candidates in one tile is heavy: pairs with a light end are handed on as pairs (at most DENSE for a light vector
in a tile), pairs of heavy vectors never are.  Heavy vectors come to their buckets themselves; each tile of at
most 2 x TILE of them is one matrix product, counts its links in place and hands on a spanning forest.  A pair counts in the
first table that holds it.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing; so do vectors
of different lengths; equal vectors link (one is compared for all of them).  Rows that share a vec_id are rows of
their own, of one component.  A row without a vec_id counts and connects like others, its component is that of the ids
it is linked with, NULL if there are none; ``kept`` compares NULL-safe.  Extra columns are ignored; an empty table gives
an empty result.  Links found are exact (cosine in double precision); a pair can only be missed.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType
from pyspark.sql.window import Window

from .common import sorted_runs, table
from .links import components

THRESHOLD = 0.95
#: Distinct vectors that the rotations are learned from, and rounds of learning.
SAMPLE, ROUNDS = 2048, 40
#: Share of pairs at the threshold that the tables must bring together.
RECALL = 0.98
#: Vectors a bucket has on average, and most rows of a block of a bucket; rows of a block of heavy ones.
FILL, BUCKET, TILE = 128, 2048, 512
#: Candidates that a light vector has in one tile at most.
DENSE = 32
#: Principal directions that a rotation takes at most.
DIRECTIONS = 64


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce((x - x) == 0, F.lit(False)))  # a difference of NULL, NaN or infinity is not 0
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by powers of two before, so that squares stay in range."""
    scaled = rows * np.exp2(-np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1].astype(float))
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def padded(column, width: int) -> np.ndarray:
    """Rows of a list column as one matrix, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Codes:
    """Rotations learned from unit vectors ``x``, and the tables that pairs at ``threshold`` need among ``n`` vectors."""

    def __init__(self, x: np.ndarray, n: int, threshold: float, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.mean = x.mean(axis=0)
        spread, directions = np.linalg.eigh(np.cov(x - self.mean, rowvar=False).reshape(x.shape[1], -1))
        keep = max(1, min(DIRECTIONS, int((spread > spread[-1] * 1e-9).sum())))
        self.directions = directions[:, ::-1][:, :keep]
        low = (x - self.mean) @ self.directions
        self.bits = min(40, max(8, math.ceil(math.log2(max(n, 2) / FILL))))
        other = x[draw.permutation(len(x))]
        side = other - (other * x).sum(axis=1, keepdims=True) * x
        lengths = np.linalg.norm(side, axis=1)
        able = lengths > 1e-6
        turned = threshold * x[able] + math.sqrt(1 - threshold ** 2) * side[able] / lengths[able, None]
        moved = (turned - self.mean) @ self.directions
        columns, missed, self.tables = [], np.ones(len(moved), bool), 0
        differ = np.zeros(len(moved), int)
        # Tables are added until enough of the turned vectors meet their originals in one of them.
        while self.tables < 200 and (self.tables * self.bits < 64 or missed.mean() > 1 - RECALL if len(moved) else self.tables * self.bits < 64):
            while sum(c.shape[1] for c in columns) < (self.tables + 1) * self.bits:
                columns.append(self._rotation(low, draw))
            self.turn = np.hstack(columns)
            at = slice(self.tables * self.bits, (self.tables + 1) * self.bits)
            missed &= (((low[able] @ self.turn[:, at]) > 0) != ((moved @ self.turn[:, at]) > 0)).any(axis=1)
            self.tables += 1
        self.turn = self.directions @ self.turn[:, :self.tables * self.bits]
        differ = (((x[able] - self.mean) @ self.turn[:, :64] > 0) != ((turned - self.mean) @ self.turn[:, :64] > 0)).sum(axis=1)
        self.radius = int(np.quantile(differ, 0.999)) + 1 if len(differ) else 64

    @staticmethod
    def _rotation(low: np.ndarray, draw) -> np.ndarray:
        turn = np.linalg.qr(draw.standard_normal((low.shape[1], low.shape[1])))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(low.T @ np.where(low @ turn > 0, 1.0, -1.0))
            turn = u @ v
        return turn

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys by table, the first 64 bits) of unit vectors."""
        signs = (x - self.mean) @ self.turn > 0
        weight = 1 << np.arange(self.bits, dtype=np.int64)
        keys = np.stack([signs[:, t * self.bits:(t + 1) * self.bits] @ weight for t in range(self.tables)], axis=1)
        packed = np.packbits(signs[:, :64], axis=1, bitorder="little")
        full = np.zeros((len(x), 8), np.uint8)
        full[:, :packed.shape[1]] = packed
        return keys, full.view(np.int64).ravel()


def tiles(rows: DataFrame, block: int) -> DataFrame:
    """rows (bucket, node, ...) with ``tile`` and ``side``: blocks of a large bucket meet in pairs, also with themselves."""
    c = F.col
    large = rows.groupBy("bucket").count().filter(c("count") > block).select("bucket", F.ceil(c("count") / block).alias("blocks"))
    rows = rows.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), c("blocks") - 1)))
    # The upper bits of a bucket's number are its table; a tile is named by both of its blocks.
    tile = F.least("own", "with") * c("blocks") + F.greatest("own", "with")
    return rows.withColumns({"tile": tile, "side": (c("own") > c("with")).cast("int")}).drop("blocks", "own", "with")


def in_tiles(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "side")


def candidates(rows: DataFrame, codes: Codes, dense: int) -> DataFrame:
    """(a, b) whose codes are near, b NULL where a is heavy; rows: (bucket, tile, side, node, code)."""
    bits, radius = codes.bits, codes.radius

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, ["bucket", "tile"]):
            first = int(run.column("bucket")[0].as_py()) >> 40
            side, node, code = (run.column(x).to_numpy() for x in ("side", "node", "code"))
            code = code.view(np.uint64)
            lower = np.flatnonzero(side == 0)
            upper = np.flatnonzero(side == 1) if side[-1] else lower
            count, found = np.zeros(len(node), np.int64), []
            for at in range(0, len(lower), 256):
                part = lower[at:at + 256]
                xor = code[part][:, None] ^ code[upper][None, :]
                near = np.bitwise_count(xor) <= radius
                if upper is lower:
                    near &= np.arange(len(lower))[None, :] > np.arange(at, at + len(part))[:, None]
                count[part] += near.sum(axis=1)
                count[upper] += near.sum(axis=0)
                for t in range(min(first, 64 // bits)):  # met in an earlier table
                    near &= ((xor >> np.uint64(t * bits)) & np.uint64((1 << bits) - 1)) != 0
                found.append((at, near))
            heavy = count > dense
            one, two = [node[heavy]], [np.full(heavy.sum(), -1)]
            for at, near in found:
                i, j = np.nonzero(near & ~(heavy[lower[at:at + len(near)]][:, None] & heavy[upper][None, :]))
                one.append(node[lower[at + i]])
                two.append(node[upper[j]])
            one, two = np.concatenate(one), np.concatenate(two)
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two, mask=two < 0)], names=["a", "b"])

    return in_tiles(rows).mapInArrow(scan, "a bigint, b bigint")


def near_pairs(pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b) of pairs (a, b, x, y: vectors) at the threshold or above."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                x, y = unit(padded(part.column("x"), width)), unit(padded(part.column("y"), width))
                same = np.array([len(v) for v in part.column("x")]) == np.array([len(v) for v in part.column("y")])
                yield part.select(["a", "b"]).filter(pa.array(((x * y).sum(axis=1) >= threshold) & same))

    return pairs.select("a", "b", "x", "y").mapInArrow(scan, "a bigint, b bigint")


def heavy_links(rows: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b, n): n links of node a where b is NULL, else an edge of a spanning forest; rows: (bucket, tile, side, node, keys, copies, vector)."""
    def forest(linked: np.ndarray) -> list[tuple[int, int]]:
        """Edges (row, column) that connect what the whole matrix connects, by a search over rows and columns."""
        rows_left, edges = linked.any(axis=1), []
        columns_left = linked.any(axis=0)
        while rows_left.any():
            start = int(np.argmax(rows_left))
            rows_left[start] = False
            front = [start]
            while front:
                reached = []
                for i in front:
                    new = np.flatnonzero(linked[i] & columns_left)
                    columns_left[new] = False
                    edges += [(i, j) for j in new]
                    reached += new.tolist()
                front = []
                for j in reached:
                    new = np.flatnonzero(linked[:, j] & rows_left)
                    rows_left[new] = False
                    edges += [(i, j) for i in new]
                    front += new.tolist()
        return edges

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, ["bucket", "tile"]):
            first = int(run.column("bucket")[0].as_py()) >> 40
            side, node, copies = (run.column(x).to_numpy() for x in ("side", "node", "copies"))
            vectors, size = unit(padded(run.column("vector"), width)), np.array([len(v) for v in run.column("vector")])
            keys = padded(run.column("keys"), len(run.column("keys")[0])).astype(np.int64)
            lower = np.flatnonzero(side == 0)
            upper = np.flatnonzero(side == 1) if side[-1] else lower
            linked = (vectors[lower] @ vectors[upper].T >= threshold) & (size[lower][:, None] == size[upper][None, :])
            if upper is lower:
                linked &= np.arange(len(lower))[None, :] > np.arange(len(lower))[:, None]
            for t in range(first):
                linked &= keys[lower, t][:, None] != keys[upper, t][None, :]
            count = np.zeros(len(node), np.int64)
            count[lower] += linked @ copies[upper]
            count[upper] += copies[lower] @ linked
            edges = forest(linked)
            some = np.flatnonzero(count)
            if len(some):
                one = np.concatenate([node[some], node[lower[[i for i, _ in edges]]]])
                two = np.concatenate([np.full(len(some), -1), node[upper[[j for _, j in edges]]]])
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two, mask=two < 0), pa.array(np.concatenate([count[some], np.zeros(len(edges), np.int64)]))],
                                                 names=["a", "b", "n"])

    return in_tiles(rows).mapInArrow(scan, "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, dense: int = DENSE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding)."""
    from ..session import materialize

    c, spark = F.col, vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType
    vector = c("embedding") if isinstance(kind, (FloatType, DoubleType)) else c("embedding").cast("array<double>")
    rows = vectors.select("vec_id", vector.alias("vector")).withColumn("fine", usable(c("vector")))
    # A vector's name: two 64-bit hashes that go over it in different orders.
    names = {"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.reverse("vector"), F.size("vector"))}
    fine = rows.filter("fine").withColumns(names)
    sizes = materialize(fine.groupBy("h1", "h2").agg(F.max(F.size("vector")).alias("width")), "vector_names")
    n, width = sizes.agg(F.count("*"), F.max("width")).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), c("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    drawn = sizes.orderBy("h1", "h2").limit(SAMPLE).select("h1", "h2")
    drawn = fine.join(F.broadcast(drawn), ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("vector").alias("vector")).orderBy("h1", "h2")
    codes = Codes(unit(padded(pa.array([r.vector for r in drawn.collect()], pa.list_(pa.float64())), width)), n, threshold)  # SAMPLE rows at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                keys, code = codes(unit(padded(part.column("vector"), width)))
                made = [pa.ListArray.from_arrays(np.arange(0, keys.size + 1, codes.tables, dtype=np.int32), keys.ravel()), pa.array(code)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "keys", "code"])

    distinct = fine.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"))
    shape = ", ".join(f"{k} {t}" for k, t in distinct.dtypes)
    nodes = materialize(distinct.mapInArrow(encode, f"{shape}, keys array<bigint>, code bigint").withColumn("node", F.monotonically_increasing_id()), "coded")
    bucket = F.shiftleft(c("place").cast("long"), 40) + c("key")
    in_tables = lambda df, *more: df.select("node", *more, F.posexplode("keys").alias("place", "key")).select(bucket.alias("bucket"), "node", *more)
    met = materialize(candidates(tiles(in_tables(nodes, "code"), BUCKET), codes, dense), "candidates")
    heavy = materialize(met.filter("b IS NULL").select(c("a").alias("node")).distinct(), "heavy")
    pairs = met.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda end: heavy.select(c("node").alias(end), F.lit(True).alias(f"{end}_heavy"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter("a_heavy IS NULL OR b_heavy IS NULL").select("a", "b")
    one, two = nodes.select(c("node").alias("a"), c("vector").alias("x")), nodes.select(c("node").alias("b"), c("vector").alias("y"))
    links = materialize(near_pairs(pairs.join(one, "a").join(two, "b"), width, threshold), "links")
    crowd = nodes.join(heavy, "node", "left_semi").select("node", "keys", "copies", "vector")
    spots = tiles(in_tables(crowd), TILE)
    dealt = materialize(heavy_links(spots.join(crowd, "node"), width, threshold), "crowds")
    # Copies of a node count for its partners, and each other.
    ends = links.select(c("a").alias("node"), c("b").alias("partner")).unionByName(links.select(c("b").alias("node"), c("a").alias("partner")))
    counts = ends.join(nodes.select(c("node").alias("partner"), "copies"), "partner").select("node", c("copies").alias("n")).unionByName(
        dealt.filter("b IS NULL").select(c("a").alias("node"), "n")).groupBy("node").agg(F.sum("n").alias("n"))
    counted = nodes.join(counts, "node", "left").select("h1", "h2", "node", (F.coalesce("n", F.lit(0)) + c("copies") - 1).alias("n_links"))
    poor = rows.filter("NOT fine").select("vec_id", (-1 - F.monotonically_increasing_id()).alias("node"), F.lit(0).cast("long").alias("n_links"))
    placed = materialize(fine.select("vec_id", "h1", "h2").join(counted, ["h1", "h2"]).select("vec_id", "node", "n_links").unionByName(poor), "placed")
    # Rows that share an id belong together, whatever their vectors.
    shared = placed.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("node").alias("b"), F.max("node").alias("top")).filter("b != top").select("vec_id", "b")
    bridges = placed.join(shared, "vec_id").select(c("node").alias("a"), "b")
    edges = links.unionByName(dealt.filter("b IS NOT NULL").select("a", "b")).unionByName(bridges)
    homes = components(edges)
    placed = materialize(placed.join(homes, "node", "left").withColumn("home", F.coalesce("home", "node")), "homes")
    least = placed.groupBy("home").agg(F.min("vec_id").alias("component_id"))
    return placed.join(least, "home").select("vec_id", "n_links", "component_id", c("vec_id").eqNullSafe(c("component_id")).alias("kept"))


OP11_SQL = r"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 g AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
 m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY 1),
 n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.c, v.vec_id) AS component_id, v.vec_id = coalesce(m.c, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN m ON m.a = v.vec_id"""


def op11_near_vectors(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
