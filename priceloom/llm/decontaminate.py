"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are indexed as one suffix automaton over words.  Training texts
are streamed through it: after each word the automaton knows the longest run of words,
ending here, that occurs in some item.  Where that run has the length of a window, all its
words are hit; an item shorter than a window must occur whole.

Items go into blocks of about ``block_words`` words, one automaton each (some 400 bytes a word in a worker), so that what a
task holds is bounded however long the benchmark or one of its items is; texts pass through one block after
the other.

Defined cases: NULL has no words and no hits; items without words have no windows; rows
that repeat an item_id count as one item; rows without an item_id count as one item, which has no name in the
list of items; extra columns pass through, clashing ones are
replaced; with an empty benchmark nothing is hit.
"""
from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

WINDOW = 10
BLOCK_WORDS = 250_000
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
HIT = "struct<n_words:bigint,spans:array<struct<first:int,last:int,begin:int,end:int>>,items:array<string>>"


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.translate(_LOWER)) if text else []


class Automaton:
    """Suffix automaton of several word sequences.

    State s stands for runs of ``link[s]``'s length + 1 to ``length[s]`` words; ``ended[s]`` are the short items that
    are suffixes of them.  ``anchor[s]`` is the ancestor that the window at the end of its runs belongs to, and
    ``items`` names the items for these states only.
    """

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[str, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        seen_at, seen_of, whole = array("i"), array("i"), {}

        def state(length, step, link):
            self.step.append(step)
            self.length.append(length)
            self.link.append(link)
            return len(self.step) - 1

        def split(p, word, q):
            """A state of its own for the runs of q that are one word longer than p's."""
            if self.length[q] == self.length[p] + 1:
                return q
            copy = state(self.length[p] + 1, dict(self.step[q]), self.link[q])
            self.link[q] = copy
            while p >= 0 and self.step[p].get(word) == q:
                self.step[p][word] = copy
                p = self.link[p]
            return copy

        for number, (_, words) in enumerate(items):
            last = 0
            for word in words:
                if word in self.step[last]:
                    last = split(last, word, self.step[last][word])
                else:
                    new, p = state(self.length[last] + 1, {}, 0), last
                    while p >= 0 and word not in self.step[p]:
                        self.step[p][word] = new
                        p = self.link[p]
                    if p >= 0:
                        self.link[new] = split(p, word, self.step[p][word])
                    last = new
                if self.length[last] >= window:
                    seen_at.append(last)
                    seen_of.append(number)
            if 0 < len(words) < window:
                whole.setdefault(last, set()).add(number)
        # A state's links lead to shorter ones: those with a window come after their ancestors here.
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        self.anchor = array("i", bytes(4 * len(self.step)))
        self.ended: dict[int, tuple[tuple[int, str | None], ...]] = {}
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.anchor[s] = s if self.length[up] < window else self.anchor[up]
            own = tuple((self.length[s], items[x][0]) for x in sorted(whole.get(s, ())))
            if own or up in self.ended:
                self.ended[s] = own + self.ended.get(up, ())
        self.items: dict[int, set[str | None]] = {}
        for s, x in zip(seen_at, seen_of):
            self.items.setdefault(self.anchor[s], set()).add(items[x][0])
        self.shortest = min([window, *(len(w) for _, w in items if w)])

    def hits(self, words: list[str]) -> tuple[list[list[int]], set[str | None]]:
        """Merged [first, last] runs of hit words, and the items with an occurring window."""
        spans: list[list[int]] = []
        found: set[str | None] = set()
        anchors: set[int] = set()
        step, link, length, ended, anchor, window, shortest = self.step, self.link, self.length, self.ended, self.anchor, self.window, self.shortest
        s = run = 0
        for i, word in enumerate(words):
            to = step[s].get(word)
            if to is None:
                while s and to is None:
                    s = link[s]
                    to = step[s].get(word)
                if to is None:
                    run = 0
                    continue
                run = length[s]
            s = to
            run += 1
            if run < shortest:
                continue
            reach = 0
            if run >= window:
                reach = run
                anchors.add(anchor[s])
            if s in ended:
                for size, item in ended[s]:
                    if size <= run:
                        found.add(item)
                        reach = max(reach, size)
            if reach:
                first = i - reach + 1
                while spans and spans[-1][0] >= first:
                    spans.pop()
                if spans and spans[-1][1] >= first - 1:
                    spans[-1][1] = i
                else:
                    spans.append([first, i])
        return spans, found.union(*(self.items[v] for v in anchors))


def _blocks(benchmark: DataFrame, block_words: int, window: int) -> list[DataFrame]:
    """The items (item_id, text), dealt to as many parts as keep a part near ``block_words`` words.

    An item of more words than that comes in pieces, which overlap by one word less than a window and are
    no shorter than one, so that they have the item's windows between them.
    """
    c = F.col
    upper = "".join(map(chr, _LOWER))
    words = F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(_WORDS.pattern), F.lit(0))
    items = benchmark.filter("text IS NOT NULL").select("item_id", words.alias("words")).filter(F.size("words") > 0)
    many = F.size("words")
    start = F.when(many > max(block_words, window), F.sequence(F.lit(0), many - window, F.lit(block_words))).otherwise(F.array(F.lit(0)))
    items = items.withColumn("at", F.explode(start)).withColumn("words", F.when(many > max(block_words, window), F.slice(
        "words", c("at") + 1, F.lit(block_words + window - 1))).otherwise(c("words")))
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    count = -(-total // block_words) or 1
    items = items.withColumn("text", F.array_join("words", " "))
    return [items.filter(F.pmod(F.xxhash64("item_id", "at"), F.lit(count)) == k).select("item_id", "text") for k in range(count)]


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with ``hit``: number of words, spans (first and last word; code points begin, end) and item ids."""
    docs = docs.drop("hit").withColumn("hit", F.lit(None).cast(HIT))
    for part in _blocks(benchmark, block_words, window):
        # A block is bounded, so it can go to the driver and to every executor.
        items = [(None if r[0] is None else str(r[0]), r[1]) for r in part.orderBy("item_id", "text").collect()]
        held = docs.sparkSession.sparkContext.broadcast({"items": items})

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            if "automaton" not in block:  # built once in a worker, which keeps the broadcast between tasks
                block["automaton"] = Automaton([(k, words_of(t)) for k, t in block["items"]], window)
            automaton = block["automaton"]
            for batch in batches:
                at, kind = batch.schema.get_field_index("hit"), batch.schema.field("hit").type
                out = []
                for text, seen in zip(batch.column(batch.schema.get_field_index("text")), batch.column(at).to_pylist()):
                    text = text.as_py() or ""
                    lower = text.translate(_LOWER)
                    words = _WORDS.findall(lower)
                    spans, found = automaton.hits(words)
                    if seen and seen["spans"]:
                        spans = merge(spans + [[x["first"], x["last"]] for x in seen["spans"]])
                    found |= set(seen["items"]) if seen else set()
                    places = placed(lower, spans) if spans else []
                    out.append({"n_words": len(words), "spans": places, "items": sorted(found, key=lambda x: (x is None, x or ""))})
                yield batch.set_column(at, batch.schema.field(at).with_type(kind), pa.array(out, kind))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def placed(text: str, spans: list[list[int]]) -> list[dict]:
    """Where word spans lie in the text."""
    at = [m.span() for m in _WORDS.finditer(text)]
    return [{"first": a, "last": b, "begin": at[a][0], "end": at[b][1]} for a, b in spans]


def removed(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = 0, max_coverage: float = 0.5,
            block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without what they share with the benchmark: spans of more than ``max_words`` hit words are cut out of the text,
    and documents with more than ``max_coverage`` of their words hit are dropped.  ``n_chars`` follows the text where there is one.
    """
    c = F.col
    found = find_hits(docs, benchmark, window, block_words)
    cut = F.filter("hit.spans", lambda s: s["last"] - s["first"] + 1 > max_words)
    n_hit = F.aggregate("hit.spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    found = found.filter(n_hit <= c("hit.n_words") * max_coverage).withColumn("_cut", cut)
    size = F.size("_cut")
    rest = F.transform(F.sequence(F.lit(0), size), lambda i: F.substring(
        c("text"), F.coalesce(F.get(c("_cut.end"), i - 1), F.lit(0)) + 1,
        F.coalesce(F.get(c("_cut.begin"), i), F.length("text")) - F.coalesce(F.get(c("_cut.end"), i - 1), F.lit(0))))
    text = F.when(size > 0, F.array_join(rest, "")).otherwise(c("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(size > 0, F.length("text").cast("long")).otherwise(c("n_chars")))
    return out.select(*docs.columns)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """How much of every document occurs in the benchmark."""
    found = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit.spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", F.col("hit.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP6_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+least(len(w), 10)-1], ' ') AS g FROM b, unnest(range(1, greatest(len(w)-9, 1)+1)) t(i) WHERE len(w) > 0),
 s AS (SELECT DISTINCT n FROM v),
 g AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM d, s, unnest(range(1, len(w)-n+2)) t(i)),
 m AS (SELECT g.doc_id, g.n, g.i, v.item_id FROM g JOIN v ON v.n=g.n AND v.g=g.g),
 h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) AS p FROM m) GROUP BY 1),
 k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id=d.doc_id LEFT JOIN k ON k.doc_id=d.doc_id"""
