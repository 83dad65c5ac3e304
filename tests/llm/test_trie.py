"""The prefix trie against dictionaries of whole prefixes."""
import collections
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from priceloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    own = {k: [x[3:] for x in sorted(v)] for k, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (abs(conv) % 20) * (1 if conv >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(conv)
        ends[whole].append(conv)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        gain = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += gain
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def found(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit("x") for x in ("name", "depth", "part")}).repartition(parts)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in trie.trie(docs).collect())


def test_trie_against_brute_force(spark):
    draw = random.Random(2)
    said = ["a b c", "d", "", None, "e  f\tg", "é x"]
    rows = [(c, t, draw.choice(["user", "assistant", None]), draw.choice(said)) for c in range(60) for t in range(draw.choice([1, 1, 2, 3, 5, 9]))]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(45) for t in range(4)]  # copies
    rows += [(200, t, "user", f"long {t % 3}") for t in range(70)] + [(201, t, "user", f"long {t % 3}") for t in range(64)]
    rows += [(300, None, "user", "no turn"), (300, 0, "user", "zero"), (300, 0, "user", "tie"), (300, 0, "user", "tie")]
    rows += [(-21, 0, "user", "x y"), (-20, 0, "user", "x y"), (None, 0, "user", "nobody"), (5_000_000_000, 1, "user", "far")]
    assert found(spark, rows) == brute(rows)


def test_conversation_over_many_ranges_and_chunks(spark):
    rows = [(40, t, "user", f"t{t % 7}") for t in range(600)] + [(c, 0, "user", "hello") for c in range(10_000, 19_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows, 9) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_table_and_lone_turns(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(c, 0, None, None) for c in range(3)]
    assert found(spark, rows) == brute(rows)
