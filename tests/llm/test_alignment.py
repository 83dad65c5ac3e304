"""Two tokenizers aligned, against one text after the other with the libraries' own calls."""
import collections
import hashlib
import random

import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from priceloom.llm import alignment

DECODE = {c: b for b, c in zip([*alignment.PRINTED, *[x for x in range(256) if x not in alignment.PRINTED]],
                               [*map(chr, alignment.PRINTED), *[chr(256 + k) for k in range(256 - len(alignment.PRINTED))]])}


def brute(rows):
    """{row number: measures}, pair counts over all rows."""
    one = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_LEVEL}")
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECES}")
    spans, counts = {}, collections.Counter()
    for k, (_, text) in enumerate(rows):
        if not text:
            continue
        raw = (" " + text).encode()
        found = one.encode(" " + text, add_special_tokens=False)
        first = [(i, bytes(DECODE[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
        second = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i in two.encode(text) for p in [two.id_to_piece(i)]]
        if b"".join(t for _, t in first) != raw or b"".join(t for _, t in second) != raw:
            continue
        ends = []
        for side in (first, second):
            at, out = 0, {}
            for i, t in side:
                at += len(t)
                out[at] = i
            ends.append(out)
        links = [(ends[0][x], ends[1][x]) for x in sorted(ends[0].keys() & ends[1].keys())]
        groups, low = [], 0
        for high in sorted(ends[0].keys() & ends[1].keys()):
            groups.append("|".join(",".join(str(i) for x, i in side.items() if low < x <= high) for side in ends))
            low = high
        spans[k] = (len(first), len(second), links, ";".join(groups))
        counts.update(links)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        if k not in spans:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, written = spans[k]
        out.append((doc_id, n_a, n_b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(written.encode()).hexdigest()))
    return out


def sample():
    draw = random.Random(4)
    words = ["Über", "straße", "the", "thing", "naïve", "日本語", "x9z", "<|endoftext|>", "</s>", "▁", "😀", "don't", "12345", "\n", "ﬁ", "a" * 60]
    rows = [(i, " ".join(draw.choices(words, k=draw.choice([1, 2, 9, 60])))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, " "), (83, "two  blanks \t and a tab"), (84, "\u0085 odd ​ blanks 　"), (85, "x" * 5000), (None, "no id"), (None, "no id"),
             (3, "an id twice"), (87, "word " * 3_000)]
    return rows + [(100 + k, "the same text in many rows") for k in range(40)]


def test_alignment_against_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit("x") for x in ("digest", "pairs", "n", "copies")})
    expected = sorted(brute(rows), key=repr)
    assert sum(r[1] == 0 for r in expected) >= 3
    found = alignment.alignment(docs)
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert [f.dataType.simpleString() for f in found.schema][:7] == ["bigint"] * 7
    shuffled = alignment.alignment(docs.repartition(5), pair_rows=0)
    assert sorted(map(tuple, shuffled.collect()), key=repr) == expected


def test_both_engines_of_the_byte_level_vocabulary_agree():
    with open(f"{alignment.FOLDER}/{alignment.BYTE_LEVEL}", "rb") as file:
        side = alignment.byte_level(file.read())
    texts = [t or "" for _, t in sample()]
    plain, held = side.encode(texts), alignment.LONG
    alignment.LONG = -1
    try:
        assert side.encode(texts) == plain
    finally:
        alignment.LONG = held


def test_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []
