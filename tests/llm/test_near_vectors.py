"""Near-duplicate vectors against all cosines."""
import math

import numpy as np
from pyspark.sql import functions as F

from priceloom.llm import near_vectors
from priceloom.llm.links import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    """{row number: n_links}, {row number: component of ids}."""
    fine = [e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e) for _, e, _ in rows]
    home, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    def join(i, j):
        home[max(top(i), top(j))] = min(top(i), top(j))

    for width in {len(e) for ok, (_, e, _) in zip(fine, rows) if ok}:
        at = [k for k, ok in enumerate(fine) if ok and len(rows[k][1]) == width]
        x = np.array([np.float32(rows[k][1]) for k in at], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            links[at[i]] += 1
            links[at[j]] += 1
            join(at[i], at[j])
    seen = {}
    for k, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            join(seen.setdefault(vec_id, k), k)
    smallest = {}
    for k, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            smallest[top(k)] = min(smallest.get(top(k), vec_id), vec_id)
    return sorted(((v, n, smallest.get(top(k))) for k, ((v, _, _), n) in enumerate(zip(rows, links))), key=repr)


def found(spark, rows, **kw):
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit("x") for x in ("node", "keys", "copies", "h1")})
    out = near_vectors.near_vectors(vectors, **kw).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=repr)


def turned(draw, x, cosine):
    side = draw.standard_normal(len(x))
    side -= side @ x * x
    return cosine * x + math.sqrt(1 - cosine ** 2) * side / np.linalg.norm(side)


def sample(draw, n, width=48):
    x = draw.standard_normal((n, width)) + 0.3
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_odd_rows_copies_and_chains(spark):
    draw = np.random.default_rng(3)
    base = sample(draw, 40, 16)
    rows = [(k, x.tolist(), 0) for k, x in enumerate(base)]
    rows += [(100 + k, turned(draw, base[k % 10], 0.999).tolist(), 1) for k in range(60)]
    rows += [(200 + k, (base[3] * 2.0 ** (k % 3)).tolist(), 1) for k in range(70)]  # equal directions, some of them equal vectors
    chain = [base[20]]
    for _ in range(12):
        chain.append(turned(draw, chain[-1], 0.99))
    rows += [(300 + k, x.tolist(), 2) for k, x in enumerate(chain)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [float("nan")] + [1.0] * 15, 0), (404, [float("inf")] + [1.0] * 15, 0), (405, [None] + [1.0] * 15, 0),
             (406, base[0][:8].tolist(), 0), (407, (base[0] * 1e30).tolist(), 0), (408, base[5].tolist() + [0.0], 0), (400, base[1].tolist(), 0), (401, base[2].tolist(), 0),
             (7, base[8].tolist(), 0), (7, base[8].tolist(), 0), (None, base[9].tolist(), 0), (None, sample(draw, 1, 16)[0].tolist(), 0), (None, None, 0)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, dense=1) == brute(rows)


def test_crowds_in_many_tiles(spark):
    draw = np.random.default_rng(4)
    base = sample(draw, 300)
    rows = [(k, x.tolist(), 0) for k, x in enumerate(base)]
    rows += [(1000 + k, turned(draw, base[0], draw.uniform(0.96, 1.0)).tolist(), 0) for k in range(1300)]
    held = near_vectors.BUCKET, near_vectors.TILE
    near_vectors.BUCKET, near_vectors.TILE = 200, 100
    try:
        got = found(spark, rows)
    finally:
        near_vectors.BUCKET, near_vectors.TILE = held
    links = lambda r: sum(n for _, n, _ in r)
    expected = brute(rows)
    assert [r[::2] for r in got] == [r[::2] for r in expected]
    assert all(g[1] <= e[1] for g, e in zip(got, expected)) and links(got) >= 0.98 * links(expected)


def test_recall_at_the_threshold(spark):
    draw = np.random.default_rng(5)
    base = sample(draw, 4000)
    rows = [(2 * k, x.tolist(), 0) for k, x in enumerate(base)] + [(2 * k + 1, turned(draw, x, 0.951).tolist(), 0) for k, x in enumerate(base)]
    got, expected = found(spark, rows), brute(rows)
    both = sum(n for _, n, _ in got), sum(n for _, n, _ in expected)
    assert 0.95 * both[1] <= both[0] <= both[1] and both[1] >= 8000
    assert all(g[1] <= e[1] for g, e in zip(got, expected))


def test_empty_tables(spark):
    assert near_vectors.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    out = near_vectors.near_vectors(spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], SCHEMA)).collect()
    assert sorted(map(tuple, out)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1500)] + [(5000, 5000)]
    out = {r.node: r.home for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1500)}}
