"""The queries and the pipeline on the sample tables; SQL counterparts and brute force."""
import collections
import glob
import hashlib
import os
import random
import re
import string

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from priceloom.llm import all_llm_queries, decontaminate, langid
from priceloom.llm.common import WORD

from test_tables import brute_groups, level
from test_texts import brute_base

SF = "/root/testdata/sf0.001"
QUERIES = all_llm_queries()


@pytest.fixture(scope="module")
def texts():
    return {i: t for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()}


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_against_sql(spark, name):
    query, sql = QUERIES[name]
    base = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        base.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    expected = base.sql(sql)
    got = query(spark, SF)
    assert sorted(got.columns) == sorted(expected.columns)
    order = expected.columns
    assert sorted(map(repr, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(repr, expected.fetchall()))


def test_pii_query(spark, texts):
    rows = QUERIES["op5_pii"][0](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{b}:{e}" for b, e, k in spans).encode()).hexdigest()
        counts = collections.Counter(k for _, _, k in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))
        assert {f"{k}:{b}:{e}" for b, e, k in spans} <= set(r.spans.split(","))


def test_fingerprint_query(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op10_fingerprint"][0](spark, SF).collect()}
    line = sorted(texts, reverse=True)
    for k, i in enumerate(line):
        text, cut = texts[i], len(texts[i]) // 3
        edited = text[:len(text) - cut] + texts[line[(k + 1) % len(line)]][:cut]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.9 * len(rows)


def test_sharding_query(spark, texts):
    rows = QUERIES["op3_sharding"][0](spark, SF).collect()
    import zlib
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    counts = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(counts.values()) - min(counts.values()) <= 1


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "src1", 0), (10_003, "12 34", "en", "src1", 5)], docs.schema)
    held = docs.unionByName(odd)
    counts = [held.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, SF)
        if k < 4:
            assert out.columns == docs.columns, name
        counts.append(out.count())
        held = out
        if k == 0:
            assert {r.doc_id for r in out.filter("doc_id > 10000").collect()} == set()
            assert counts[1] >= counts[0] - 5  # clean documents stay
        if k == 1:
            assert out.select("doc_id").distinct().count() == counts[2] < counts[1]
        if k == 2:
            assert counts[3] >= counts[2] - 3 and out.filter("n_chars != length(text)").count() == 0
        if k == 3:
            assert 1.2 * counts[3] < counts[4] < 1.8 * counts[3]
    by = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(by) == 24 and max(by) - min(by) <= 1


def test_language_stage_drops_noise_and_foreign_texts(spark):
    draw = random.Random(4)
    clean = spark.read.parquet(f"{SF}/documents.parquet")
    noise = [" ".join("".join(draw.choices(string.ascii_lowercase, k=draw.randint(3, 9))) for _ in range(60)) for _ in range(30)]
    cyrillic = [" ".join(draw.choices("в начале было слово и мир стал большим городом на реке под небом дом".split(), k=60)) for _ in range(30)]
    rows = [(20_000 + k, t, None, "src1", len(t)) for k, t in enumerate(noise + cyrillic)]
    docs = clean.unionByName(spark.createDataFrame(rows, clean.schema))
    for part in (docs, docs.filter("lang IS NULL OR lang IN ('de', 'en')")):
        kept = [r.doc_id for r in corpus_pipeline.identify_language(spark, part, SF).select("doc_id").collect()]
        assert sum(i < 20_000 for i in kept) >= part.count() - 60 - 3
        assert sum(20_000 <= i < 20_030 for i in kept) <= 3 and sum(i >= 20_030 for i in kept) <= 3


def test_one_row_of_each_document_stays(spark):
    rows = [(3, "a b c d e f"), (7, "a b c d e f"), (7, "u v w x y z"), (2, "u v w x y z"), (4, "g h i j k"), (4, "g h i j k"), (4, "l m n o p"),
            (None, "no id at all"), (None, "no id at all"), (None, "other words here"), (None, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(got, key=str) in [sorted([(2, "u v w x y z"), (4, t), (None, "no id at all"), (None, "other words here")], key=str) for t in ("g h i j k", "l m n o p")]


def brute_cut(text, grams):
    """The text without benchmark passages; None where more than half of its words are in them."""
    lower = text.translate({k: k + 32 for k in range(65, 91)})
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]
    words = [lower[a:b] for a, b in at]
    hit = {j for n in {len(g) for g in grams} for i in range(len(words) - n + 1) if tuple(words[i:i + n]) in grams for j in range(i, i + n)}
    if len(hit) > 0.5 * len(words):
        return None
    runs = [(i, min(j for j in range(i, len(words) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
    for first, end in reversed(runs):
        text = text[:at[first][0]] + text[at[end - 1][1]:]
    return text


def test_run_and_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(stage(spark, spark.createDataFrame(outs[-1], docs.schema), SF).collect())
    raw, known, single, clean, mixed, shards = outs
    # Language: rows as they were, and all whose label the network finds with a usual score.
    assert {tuple(r) for r in known} <= {tuple(r) for r in raw} and len(known) >= 0.98 * len(raw)
    # Near copies: exactly the smallest id of each group.
    groups = brute_groups([(r.doc_id, r.text, r.source) for r in known])
    assert sorted(map(repr, single)) == sorted(repr(r) for r in known if groups[r.doc_id][1] == r.doc_id)
    # Decontamination: exactly the cut texts.
    bench = [decontaminate.words_of(t) for _, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    grams = {tuple(w[i:i + 10]) for w in bench if w for i in range(max(len(w) - 9, 1))}
    cuts = {r.doc_id: brute_cut(r.text, grams) for r in single}
    assert {r.doc_id: r.text for r in clean} == {i: t for i, t in cuts.items() if t is not None} != {r.doc_id: r.text for r in single}
    # Mixture: rows of the stage before, up to twice, and the words of each source within half a text of the target.
    draws, before = collections.Counter(map(repr, mixed)), {repr(r) for r in clean}
    assert set(draws) <= before and max(draws.values()) == 2
    size = lambda r: len(re.findall(WORD, r.text))
    total, taken = collections.Counter(), collections.Counter()
    for rows, held in ((clean, total), (mixed, taken)):
        for r in rows:
            held[r.source] += size(r)
    order = sorted(total, key=lambda s: (s is None, s))
    goals = level(total, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(total.values()), 2)
    assert all(abs(taken[s] - goals[s]) <= max(map(size, clean)) for s in order)
    # Shards: each mixed row once, slots without gaps, equal shards.
    assert collections.Counter(repr(r[:len(docs.columns)]) for r in shards) == collections.Counter(repr(tuple(r)) for r in mixed)
    by = collections.defaultdict(list)
    for r in shards:
        by[r.shard].append(r.slot)
    assert len(by) == 24 and all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    # run() is the stages one after the other.
    assert sorted(repr(r) for r in corpus_pipeline.run(spark, SF).select(*shards[0].__fields__).collect()) == sorted(map(repr, shards))


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_held_out_is_by_crc():
    import zlib
    assert langid.held_out(F.lit(1)) is not None and zlib.crc32(b"1") % 3 in (0, 1, 2)
