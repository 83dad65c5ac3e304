"""Mixing, sharding, fingerprints and the Jaccard join against brute force, with odd rows."""
import collections
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from priceloom.llm import fingerprint, jaccard, mixing, sharding
from priceloom.llm.common import word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=()):
    made = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)
    return made.withColumns({name: F.lit("x") for name in extra})


def sample(seed=1, n=300):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(draw.choices(words, k=draw.choice([0, 1, 3, 7, 40, 90]))), draw.choice(["a", "b", "b", "b", "c", None])) for i in range(n)]
    rows[5] = (5, None, "a")
    rows[6] = (6, " \t\n ", "b")
    rows.append((7, "long " * 30_000, "c"))  # also repeats an id
    rows.append(rows[8])
    rows.append((None, "no id at all here", "b"))
    return rows


def level(sizes, weights, total, most):
    """Targets by repeated resharing."""
    target, open_ = {}, dict(sizes)
    while open_:
        share = (total - sum(target.values())) / sum(weights[s] for s in open_)
        full = [s for s in open_ if share * weights[s] >= most * sizes[s]]
        if not full:
            return target | {s: share * weights[s] for s in open_}
        for s in full:
            target[s] = most * open_.pop(s)
    return target


def test_targets_and_taken(spark):
    rows = sample()
    docs = docs_of(spark, rows, ["target", "draws"]).withColumn("size", word_count(F.col("text")))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    expected = level(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert r.taken == sum(d.words for d in r.draws) <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    whole = mixing.mixed_rows(docs_of(spark, rows))
    assert whole.columns == docs_of(spark, rows).columns
    assert {r.text for r in whole.select("text").distinct().collect()} <= {t for _, t, _ in rows}


TAKEN_SQL = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  ('0x'||substr(md5('0|block|'||coalesce(CAST(doc_id AS VARCHAR),'null')),1,12))::BIGINT % 128 AS block,
  ('0x'||substr(md5('0|inside|'||coalesce(CAST(doc_id AS VARCHAR),'null')),1,12))::BIGINT AS inside FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
 w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
 x AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM w),
 l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER less, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER less, 0)) AS level
  FROM x WINDOW less AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 g AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
 b AS (SELECT source, block, sum(size) AS bs FROM d GROUP BY 1, 2),
 c AS (SELECT *, ('0x'||substr(md5('0|order|'||copy||'|'||coalesce(source,'null')||'|'||block),1,12))::BIGINT AS ord FROM b, (VALUES (0),(1)) v(copy)),
 e AS (SELECT *, sum(bs) OVER (PARTITION BY source ORDER BY copy, ord, block ROWS UNBOUNDED PRECEDING) AS fin FROM c),
 k AS (SELECT e.source, block, CASE WHEN fin <= floor(target) THEN bs ELSE floor(target) - (fin - bs) END AS take FROM e JOIN g ON e.source IS NOT DISTINCT FROM g.source
  WHERE fin - bs < floor(target)),
 p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source, block ORDER BY inside, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p.doc_id, p.size, g.source_size, g.target, CAST(coalesce((SELECT sum(greatest(least(k.take - p.before, p.size), 0)) FROM k WHERE k.source IS NOT DISTINCT FROM p.source AND k.block = p.block), 0) AS BIGINT) AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source"""


def test_query_against_sql_and_its_draws(spark):
    """Sizes, targets and words taken by SQL; shards and places by counting."""
    import duckdb

    folder = "/root/testdata/sf0.01"
    rows = mixing.op1_mixing(spark, folder).collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    expected = db.sql(TAKEN_SQL).fetchall()
    key = lambda r: (r[0], *map(repr, r[1:3]), round(r[3], 6), r[4])
    assert sorted(key(tuple(r)[:5]) for r in rows) == sorted(map(key, expected))
    sources = dict(db.sql("SELECT doc_id, source FROM documents").fetchall())
    assert all(r.taken == sum(d.words for d in r.draws) and len({d.copy for d in r.draws}) == len(r.draws) for r in rows)
    shards = collections.defaultdict(set)  # a block of a pass goes to one shard
    for r in rows:
        for d in r.draws:
            block = int(hashlib.md5(f"0|block|{r.doc_id}".encode()).hexdigest()[:12], 16) % mixing.BLOCKS
            shards[sources[r.doc_id], d.copy, block].add(d.shard)
    assert all(len(s) == 1 for s in shards.values())
    # As many blocks of each source in each shard as the tree deals.
    blocks = collections.Counter((key[0], next(iter(s))) for key, s in shards.items())
    quotas = collections.Counter(key[0] for key in shards)
    names = sorted(quotas, key=lambda s: (s is None, s))
    dealt = mixing.splitting_tree(spark.createDataFrame([(k, quotas[s]) for k, s in enumerate(names)], "place int, quota long")).collect()
    assert {(names[r.place], r.shard): r.quota for r in dealt if r.quota} == dict(blocks)
    assert len({d.shard for r in rows for d in r.draws}) == 2 ** mixing.LEVELS


def test_mixed_rows_come_in_more_parts_than_shards(spark):
    rows = [(i, f"w{i} a b", "ab"[i % 2]) for i in range(600)]
    docs = docs_of(spark, rows)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = mixing.mixed_rows(docs).select("doc_id", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    sizes = collections.Counter(r.part for r in out)
    assert len(sizes) > 40 and max(sizes.values()) <= 45
    drawn = mixing.mix(docs.withColumn("size", word_count(F.col("text"))), whole=True).select("doc_id", F.explode("draws").alias("d")).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.part)] == [r.doc_id for r in sorted(drawn, key=lambda r: (r.d.shard, r.d.position))]


def test_mix_of_nothing(spark):
    empty = docs_of(spark, [(1, "x", "a")]).filter("doc_id > 1")
    assert mixing.mix(empty.withColumn("size", word_count(F.col("text")))).count() == 0
    assert mixing.mixed_rows(empty).count() == 0
    blank = docs_of(spark, [(1, None, "a"), (2, "", None)]).withColumn("size", word_count(F.col("text")))
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]


def test_splitting_tree_is_exact_and_fair(spark):
    quotas = {0: 1000, 1: 301, 2: 7, 3: 0}
    table = spark.createDataFrame(list(quotas.items()), "place int, quota long")
    seen = collections.defaultdict(list)
    for seed in range(12):
        rows = mixing.splitting_tree(table, 3, seed).collect()
        for place, quota in quotas.items():
            own = [r.quota for r in rows if r.place == place]
            assert len(own) == 8 and sum(own) == quota and min(own) >= 0
            seen[place] += own
        by_shard = collections.Counter()
        for r in rows:
            by_shard[r.shard] += r.quota
        assert max(by_shard.values()) - min(by_shard.values()) <= 3
    mean = sum(seen[0]) / len(seen[0])
    spread = sum((x - mean) ** 2 for x in seen[0]) / len(seen[0])
    total, share = sum(quotas.values()), 1 / 8
    variance = 1000 * share * (1 - share) * (total - 1000) / (total - 1)  # of a hypergeometric count
    assert mean == 125 and 0.5 * variance < spread < 1.8 * variance


def test_hypergeometric_follows_its_law(spark):
    draws = spark.range(20_000).select(mixing._hypergeometric(
        F.struct(F.lit(6).alias("n"), F.lit(5).alias("kind"), F.lit(15).alias("all"), ((F.col("id") + 0.5) / 20_000).alias("u"))).alias("k"))
    counts = {r.k: r["count"] / 20_000 for r in draws.groupBy("k").count().collect()}
    comb = lambda n, k: len(list(itertools.combinations(range(n), k)))
    for k in range(6):
        assert counts[k] == pytest.approx(comb(5, k) * comb(10, 6 - k) / comb(15, 6), abs=2e-4)


def test_shards_match_the_mixture(spark):
    rows = sample(2, 500)
    got = sharding.interleave(docs_of(spark, rows, ["slot"]), shards=24, bucket_rows=16).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    counts = [len(by[k]) for k in range(24)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    total = collections.Counter(r.source for r in got)
    for v in by.values():
        own = collections.Counter(r.source for r in v)
        assert all(abs(own[s] - n / 24) <= 2 for s, n in total.items())
    # The order is that of the fractional ranks, by brute force.
    line = [r.source for k in range(24) for r in sorted(by[k], key=lambda r: r.slot)]
    names = sorted(total, key=lambda s: (s is None, s))
    expected = [s for _, _, s in sorted(((2 * r + 1) / (2 * total[s]), names.index(s), s) for s in names for r in range(total[s]))]
    assert line == expected
    assert sharding.interleave(docs_of(spark, rows).filter("doc_id < -5")).count() == 0
    few = sharding.interleave(docs_of(spark, rows[:3])).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0]


def test_fingerprints_and_neighbours(spark):
    rows = [r for r in sample(3, 200)]
    docs = docs_of(spark, rows, ["sketch"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = fingerprint.with_next(docs, ["text"], run_rows=4, quantiles=10).collect()
    line = sorted(((r.doc_id, r.text) for r in got), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    following = {x: line[(k + 1) % len(line)][1] for k, x in enumerate(line)}
    assert len(got) == len(rows)
    repeated = collections.Counter(line)
    assert all(r.next_text == following[(r.doc_id, r.text)] for r in got if repeated[(r.doc_id, r.text)] == 1)
    one = fingerprint.with_next(docs.limit(1), ["text"]).collect()[0]
    assert one.next_text == one.text
    assert fingerprint.with_next(docs.filter("doc_id < 0"), ["text"]).count() == 0


def test_next_rows_of_ids_of_any_size(spark):
    draw = random.Random(8)
    ids = {draw.randint(-2**63, 2**63 - 1) for _ in range(400)} | {-2**63, 2**63 - 1, 0} | {2**60 + i for i in range(300)}
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(7)
    line = sorted(ids, reverse=True)
    following = {x: line[(k + 1) % len(line)] for k, x in enumerate(line)}
    got = fingerprint.with_next(docs, ["text"], run_rows=4, quantiles=10).collect()
    assert {r.doc_id: r.next_text for r in got} == {i: f"text {following[i]}" for i in ids} and len(got) == len(ids)
    held = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        got = fingerprint.with_next(docs, ["text"], run_rows=4, quantiles=10).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", held)
    assert {r.doc_id: r.next_text for r in got} == {i: f"text {following[i]}" for i in ids} and len(got) == len(ids)


def test_sketches_estimate_resemblance(spark):
    draw = random.Random(4)
    words = [f"v{i}" for i in range(5000)]
    base = draw.choices(words, k=4000)
    other = base[:3000] + draw.choices(words, k=1000)
    rows = [(1, " ".join(base), "a"), (2, " ".join(other), "a"), (3, " ".join(base), "a"), (4, " ".join(base[:400]), "a"), (5, "", "a"), (6, None, "a"), (7, "hi", "a")]
    prints = {r.doc_id: r for r in fingerprint.fingerprints(docs_of(spark, rows)).collect()}
    assert prints[1].fingerprint == prints[3].fingerprint and prints[5].fingerprint == prints[6].fingerprint == ""
    assert prints[7].fingerprint
    pairs = spark.createDataFrame([(prints[1].sketch, prints[2].sketch, prints[4].sketch)], "a array<bigint>, b array<bigint>, c array<bigint>")
    r = pairs.select(fingerprint.likeness(F.col("a"), F.col("b")).alias("j"), fingerprint.containment(F.col("c"), F.col("a")).alias("c"),
                     fingerprint.likeness(F.col("a"), F.array().cast("array<bigint>")).alias("z")).first()
    assert abs(r.j - 2996 / (3996 * 2 - 2996)) < 0.06 and r.c == 1.0 and r.z == 0.0
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    assert abs(len(prints[1].sketch) / len(grams(base)) - 1 / 8) < 0.03


def spark_hash(words):
    """Spark's 64-bit hash of several strings: each one's hash is the seed of the next."""
    import xxhash

    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed


def brute_sketch(text):
    w = (text or "").lower().split()
    grams = [w[i:i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [[" ".join(w)]] if w else []
    hashes = {spark_hash(g) for g in grams}
    return hashes if len(grams) <= fingerprint.WHOLE else {h for h in hashes if h >> 61 == 0}


def test_fingerprints_against_plain_sketches(spark):
    draw = random.Random(6)
    words = [f"k{i}" for i in range(300)]
    rows = [(i, " ".join(draw.choices(words, k=draw.choice([1, 4, 5, 20, 68, 69, 90, 900]))), "a") for i in range(80)] + [(80, "", "a"), (81, None, "a")]
    rows += [(90 + i, " ".join(rows[i][1].split()[2:]), "a") for i in range(20)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs_of(spark, rows)).collect()}
    plain = {i: brute_sketch(t) for i, t, _ in rows}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for i, hashes in plain.items():
        ordered = sorted(map(signed, hashes))
        assert got[i].sketch == ordered
        assert got[i].fingerprint == ",".join(f"{h & (2 ** 64 - 1):x}" for h in ordered)
    pairs = [(a, b) for a in plain for b in plain if (a * 7 + b) % 5 == 0 or b == a + 90]
    table = spark.createDataFrame([(a, b, got[a].sketch, got[b].sketch) for a, b in pairs], "i long, j long, a array<bigint>, b array<bigint>")
    found = table.select("i", "j", fingerprint.likeness(F.col("a"), F.col("b")).cast("double").alias("l"), fingerprint.containment(F.col("a"), F.col("b")).cast("double").alias("c"),
                         fingerprint.merged(F.col("a"), F.col("b")).alias("m")).collect()
    whole = lambda s: not s or any(h >> 61 for h in s)
    low = lambda s: {h for h in s if h >> 61 == 0}
    for r in found:
        a, b = plain[r.i], plain[r.j]
        x, y = (a, b) if whole(a) and whole(b) else (low(a), low(b))
        assert r.l == pytest.approx(len(x & y) / len(x | y) if x | y else float(len(a) == len(b)))
        assert r.c == (1.0 if not a else 0.0 if not b else pytest.approx(len(x & y) / len(x)) if x else None)
        assert r.m == sorted(low(a) | low(b))


def test_short_texts_inside_longer_ones(spark):
    draw = random.Random(8)
    words = [f"k{i}" for i in range(3000)]
    rows = []
    for _ in range(300):
        long = draw.choices(words, k=47)
        at = draw.randrange(40)
        rows.append((" ".join(long[at:at + 7]), " ".join(long), " ".join(draw.choices(words, k=7))))
    table = spark.createDataFrame(rows, "a string, b string, o string")
    a, b, o = (fingerprint.sketch(F.col(x)) for x in "abo")
    got = table.select(fingerprint.containment(a, b).alias("inside"), fingerprint.containment(o, b).alias("outside")).collect()
    assert all(r.inside == 1.0 and r.outside == 0.0 for r in got)


def brute_groups(rows):
    sets = {}
    for i, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    home = {i: i for i in sets}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            home[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(draw, n=40):
    """Groups of near copies of all degrees, chains of them, and passages that many texts share."""
    words = [f"t{i}" for i in range(3000)]
    passage = draw.choices(words, k=60)
    rows, number = [], 0
    for g in range(n):
        text = draw.choices(words, k=draw.choice([3, 8, 30, 120, 200]))
        for k in range(draw.choice([1, 1, 2, 12])):
            copy = list(text)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            if g % 4 == 0:
                copy = copy + passage
            if k % 3 == 2:
                text = copy  # drift: the next ones copy the copy
            rows.append((number, " ".join(copy).upper() if k % 5 == 4 else "\t".join(copy), "a"))
            number += 1
    return rows + [(number, None, "a"), (number + 1, " \n", "a"), (number + 2, "", "a"), (number + 3, "x " * 20_000, "a"), (number + 4, "x " * 20_001, "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_groups(spark, seed):
    rows = near_copies(random.Random(seed))
    got = jaccard.similarity_groups(docs_of(spark, rows).select("doc_id", "text")).collect()
    expected = brute_groups(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert len({c for _, c in expected.values()}) < len(rows) - 20


def test_jaccard_odd_rows(spark):
    rows = [(1, "a b c d e f", "a"), (1, "a b c d e f", "a"), (None, "a b c d e f", "a"), (4, "a b c d e f", "a"), (2, "z", "a"), (3, "z", "a"), (5, None, "a")]
    got = jaccard.similarity_groups(docs_of(spark, rows).select("doc_id", "text")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in got) == [
        (-1, -1), (1, 1), (1, 1), (2, 2), (3, 2), (4, 1), (5, 5)]
    assert jaccard.similarity_groups(docs_of(spark, rows).select("doc_id", "text").filter("doc_id > 99")).count() == 0


def test_jaccard_rows_of_one_document(spark):
    rows = [(3, "a b c d e f"), (7, "a b c d e f"), (7, "u v w x y z"), (2, "u v w x y z"), (7, " "), (8, ""), (8, None), (9, "one"), (9, ""), (5, "q r s t u")]
    got = jaccard.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (3, 2), (5, 5), (7, 2), (7, 2), (7, 2), (8, 8), (8, 8), (9, 9), (9, 9)]


def test_shingle_sets_agree_with_words():
    import numpy as np
    texts = ["A b C d e", "a B c d E", "a b c d", " a  b c\td ", "", "é ñ a b c d"]
    data = "".join(texts).encode()
    ends = np.cumsum([0] + [len(t.encode()) for t in texts])
    sets = jaccard.shingle_sets(np.frombuffer(data, np.uint8), ends)
    assert [len(s) for s in sets] == [1, 1, 1, 1, 0, 2]
    assert sets[0] == sets[1] and sets[2] == sets[3] and sets[0] != sets[2]
    assert hashlib.blake2b(sets[0].tobytes(), digest_size=16).digest() == jaccard.set_key(sets[1])


def test_mix_reads_rows_once_per_use(spark, tmp_path):
    """The block table is written: rows are planned for its sums before, and after it only where they are joined to their draws."""
    docs_of(spark, [(i, "a b c", "uvw"[i % 3]) for i in range(300)]).write.parquet(str(tmp_path / "rows"))
    docs = spark.read.parquet(str(tmp_path / "rows")).withColumn("size", word_count(F.col("text")))
    plan = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4, plan.count("Relation [")
