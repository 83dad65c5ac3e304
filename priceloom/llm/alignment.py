"""Two tokenizers side by side: where both cut a text, and which of their tokens go together in the corpus.

Each distinct text is tokenised once: texts are shuffled whole, equal ones meet and become one row
with a multiplicity, and copies combine before the shuffle.  What comes out of a text (measures, and how
often each pair of ids is linked in it) is written once.  Pair counts are sums weighted by the
multiplicities; every text looks up its pairs again, and its measures go to the documents by the text's SHA-256.

The table of pairs is broadcast where it has at most ``PAIR_ROWS`` rows; beyond that the pairs of
all texts are shuffled to it.  Both ways give the same rows.

Defined cases: NULL and empty texts, texts that are not UTF-8 and texts whose joined tokens of either
side differ from space + text have no tokens (zeros, no digest); rows without an id get measures like all
others; rows that share an id or a text are rows of their own and count as often as they come; extra
columns are ignored; an empty table gives an empty result.  Texts are never cut: a very long one is one call.
"""
from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Where the vocabulary files are; the driver reads them and sends their content.
FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Rows of the pair table that may be broadcast (about 40 bytes each in an executor).
PAIR_ROWS = 1_000_000
#: Bytes of text after which a task hands on what it has.
SLICE = 1 << 20
#: Characters beyond which the slower of two engines of the same vocabulary takes a text: the faster one's patterns
#: use up its stack on a million blanks in a row.
LONG = 100_000
#: A pair of ids in one number.
SHIFT = 32

# How byte-level vocabularies write bytes, and what parts a text before its bytes are merged.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Side:
    """A vocabulary: ids of texts, and each id's bytes, their number, and its decimal digits before a separator."""

    def __init__(self, encode, tokens: list[bytes], end: str):
        if not all(tokens):
            raise ValueError("a token without bytes has no place in a text")
        self.encode, self.tokens = encode, tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.inner, self.last = (np.array([f"{i}{mark}" for i in range(len(tokens))], object) for mark in (",", end))


def byte_level(content: bytes) -> Side:
    """Byte-level BPE: an id is the rank of the merge that makes its token.  Special tokens' strings are plain text."""
    import tiktoken
    from tokenizers import Tokenizer

    model = json.loads(content)["model"]
    letters = {chr(b): b for b in PRINTED}
    letters.update((chr(256 + k), b) for k, b in enumerate(b for b in range(256) if b not in PRINTED))
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
    by_id = {i: token for token, i in ranks.items()}
    engine = tiktoken.Encoding("byte-level", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    @functools.cache
    def patient():
        slower = Tokenizer.from_str(content.decode())
        slower.encode_special_tokens = True
        return slower

    def encode(texts: list[str]) -> list[list[int]]:
        return [engine.encode_ordinary(" " + t) if len(t) <= LONG else patient().encode(" " + t, add_special_tokens=False).ids for t in texts]

    return Side(encode, [by_id.get(i, b"?") for i in range(max(by_id) + 1)], "|")


def pieces(content: bytes) -> Side:
    """Pieces with byte fall-back; the model itself puts the space before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
              for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
    return Side(lambda texts: model.encode(texts, num_threads=1), tokens, ";")


def align(raw: bytes, a: Side, b: Side, ids_a: list[int], ids_b: list[int]):
    """(first ids, second ids of the links in order, the groups in writing), or None where the tokens do not make up ``raw``."""
    if b"".join([a.tokens[i] for i in ids_a]) != raw or b"".join([b.tokens[i] for i in ids_b]) != raw:
        return None
    one, two = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    ends_a, ends_b = np.cumsum(a.sizes[one]), np.cumsum(b.sizes[two])
    # Ends rise, so an offset is the end of at most one token of a side.
    there = np.searchsorted(ends_b, ends_a)
    cut_a = np.flatnonzero(ends_b[there] == ends_a)
    cut_b = there[cut_a]
    before_b = np.concatenate([[0], cut_b + 1])
    place_a = np.arange(len(one)) + before_b[np.searchsorted(cut_a, np.arange(len(one)))]
    place_b = np.arange(len(two)) + cut_a[np.searchsorted(cut_b, np.arange(len(two)))] + 1
    written = np.empty(len(one) + len(two), object)
    written[place_a], written[place_b] = a.inner[one], b.inner[two]
    written[place_a[cut_a]], written[place_b[cut_b]] = a.last[one[cut_a]], b.last[two[cut_b]]
    return one[cut_a], two[cut_b], "".join(written.tolist())[:-1]


def aligned_texts(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(digest, copies, n_a, n_b, n_links, groups_sha256, pairs, times) per distinct text that has tokens."""
    def content(name: str) -> bytes:
        with open(f"{folder}/{name}", "rb") as file:
            return file.read()

    sent = docs.sparkSession.sparkContext.broadcast({"files": (content(BYTE_LEVEL), content(PIECES))})
    schema = pa.schema([("digest", pa.binary()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()),
                        ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        if "sides" not in held:  # built once in a worker, which keeps the broadcast between tasks
            held["sides"] = byte_level(held["files"][0]), pieces(held["files"][1])
        a, b = held["sides"]
        for batch in batches:
            held, size = [], 0
            for raw, copies in zip(batch.column("raw"), batch.column("copies").to_pylist()):
                held.append((raw.as_py(), copies))
                size += len(held[-1][0])
                if size >= SLICE:
                    yield measured(held, a, b)
                    held, size = [], 0
            if held:
                yield measured(held, a, b)

    def measured(held, a, b):
        texts, kept = [], []
        for raw, copies in held:
            try:
                texts.append(raw.decode())
                kept.append((raw, copies))
            except UnicodeDecodeError:
                continue
        rows = []
        for (raw, copies), ids_a, ids_b in zip(kept, a.encode(texts), b.encode(texts)):
            found = align(b" " + raw, a, b, ids_a, ids_b)
            if found:
                one, two, groups = found
                pairs, times = np.unique((one << SHIFT) + two, return_counts=True)
                rows.append((hashlib.sha256(raw).digest(), copies, len(ids_a), len(ids_b), len(one), hashlib.sha256(groups.encode()).hexdigest(),
                             pairs, times.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    distinct = docs.filter("text != ''").groupBy("text").agg(F.count("*").alias("copies"))
    return distinct.select(F.col("text").cast("binary").alias("raw"), "copies").mapInArrow(
        scan, "digest binary, copies bigint, n_a bigint, n_b bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold the pair; whether no pair of the same second id has more."""
    c = F.col
    seen = texts.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("e"))
    counts = seen.groupBy(c("e.pairs").alias("pair")).agg(F.sum(c("copies") * c("e.times")).alias("n"))
    second = c("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    counts = counts.withColumn("b", second)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (c("n") == c("most")).alias("best"))


def alignment(docs: DataFrame, folder: str = FOLDER, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of docs (doc_id, text)."""
    from ..session import materialize

    c = F.col
    docs = docs.select("doc_id", "text")
    texts = materialize(aligned_texts(docs, folder), "aligned")
    known = materialize(pair_counts(texts), "pairs")
    if known.count() <= pair_rows:
        known = F.broadcast(known)
    looked_up = texts.select("digest", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(
        "digest", c("e.pairs").alias("pair"), c("e.times").alias("times")).join(known, "pair")
    sums = looked_up.groupBy("digest").agg(F.sum(F.when(c("best"), c("times")).otherwise(0)).alias("n_best"), F.sum(c("n") * c("times")).alias("count_sum"))
    measures = texts.select("digest", "n_a", "n_b", "n_links", "groups_sha256").join(sums, "digest")
    rows = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")).join(measures, "digest", "left")
    number = lambda x: F.coalesce(c(x).cast("long"), F.lit(0).cast("long"))
    # A group ends with the one link of its cut.
    return rows.select("doc_id", number("n_a").alias("n_a"), number("n_b").alias("n_b"), number("n_links").alias("n_groups"), number("n_links").alias("n_links"),
                       number("n_best").alias("n_best"), number("count_sum").alias("count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """Each document's tokens of two vocabularies, aligned by byte offsets."""
    return alignment(table(spark, sf_dir, "documents"))
