"""Chat, personal data, decontamination, archives and the trained models, with odd rows."""
import base64
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from priceloom.llm import chat, decontaminate, langid, pii, toxicity, warc

DOCS = "doc_id long, text string"


# Chat

def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def read_back(segments):
    """Turns per conversation, from segments collected in order."""
    rows = sorted(segments.collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.turn_no, r.segment))
    out, length = {}, {}
    for conv, turn, size in chat.read_turns((r.conv_id, r.text, r.loss) for r in rows):
        if turn is None:
            length[conv] = size
        else:
            out.setdefault(conv, []).append(turn)
    return out, length, rows


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "<|", "\\n", "a\\\\<|b", "", None, "line\nline", "x" * 200_000, "<|im_end|>\n"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(nasty)]
    rows += [(2, 0, None, "odd\n"), (2, 0, "us\ner", "y"), (2, 0, "us\ner", "y"), (None, 3, "user", "z"), (3, None, "system", "s"), (3, 1, "user", "u")]
    out, length, raw = read_back(chat.format_turns(conversations(spark, rows).withColumn("extra", F.lit(1))))
    assert [(r, t) for r, t, _ in out[1]] == [(("user", "assistant")[k % 2], t or "") for k, t in enumerate(nasty)]
    assert [x for _, _, x in out[1]] == [(t or "") if k % 2 else "" for k, t in enumerate(nasty)]
    assert [(r, t) for r, t, _ in out[2]] == [("", "odd\n"), ("us\ner", "y"), ("us\ner", "y")]
    assert out[None] == [("user", "z", "")] and [r for r, _, _ in out[3]] == ["system", "user"]
    assert length[1] == sum(len(r.text) for r in raw if r.conv_id == 1)
    problems = {r.conv_id: r.problem for r in raw if r.segment == 2}
    assert problems[1] is None and problems[2].startswith("turn 0") and problems[3] is None


def test_chat_machine(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "assistant", "a")]
    _, _, raw = read_back(chat.format_turns(conversations(spark, rows)))
    last = {r.conv_id: r.problem for r in raw}
    assert last == {1: "turn 1: user after user", 2: "turn 0: assistant after start"}
    assert chat.format_turns(conversations(spark, rows).filter("conv_id > 9")).count() == 0


# Personal data

def brute_base(text):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for k, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(re.fullmatch("0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])", x) for x in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            out.append((m.start(), k, m.end(), kind))
    return [(b, e, kind) for b, _, e, kind in sorted(out)]


def test_base_spans_by_brute_force():
    draw = random.Random(5)
    pieces = ["@", ".", "-", " ", "+", "(", ")", "1", "22", "255", "4", "a", "b.c", "x@y.z", "+1 (523) 555-1055", "4994226020900891", "10.0.0.1", "é", "\n", "_", "%"]
    for _ in range(3000):
        text = "".join(draw.choices(pieces, k=draw.randrange(1, 25)))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("a" * 300 + "@b.cc") == [(0, 305, "email")]
    assert pii.base_spans("1" * 100_000) == []
    for text in ("9" * 5000 + ".1.1.1", "1.1.1." + "9" * 5000, "0" * 5000 + "7.1.1.00255", "1.256.1.1", "0.0.0.0", "000.0.0.000", "1.1.1.1.1.1.1.1.1"):
        assert pii.base_spans(text) == brute_base(text), text[:40]
    assert [k for _, _, k in pii.base_spans("0" * 5000 + "7.1.1.00255")] == ["ip"]


def test_pii_query_rows(spark):
    rows = [(1, None), (2, ""), (3, "mail x.y@site.org or 10.1.2.3"), (3, "mail x.y@site.org or 10.1.2.3"), (None, "+49 30 1234567"), (5, "call (555) 123-4567 now"),
            (6, "write to jane.doe (at) site (dot) org please"), (7, "plain words 12 and 34"), (8, "9" * 5000 + ".1.1.1"), (9, "0" * 5000 + "7.1.1.1 and 9[.]" + "9" * 5000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit("old"))
    got = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert got[1] == got[2] == got[7] == []
    assert [(s.kind, s.begin, s.end, s.exact) for s in got[3]] == [("email", 5, 17, True), ("ip", 21, 29, True)]
    assert [s.kind for s in got[None]] == ["phone"] and got[8] == [] and [(s.kind, s.exact) for s in got[9]] == [("ip", True)]
    assert pii.find_pii(docs.filter("doc_id > 99")).count() == 0


def test_em_finds_the_better_labelers():
    draw = np.random.default_rng(0)
    truth = draw.random(20_000) < 0.4
    rates = np.array([[0.95, 0.02], [0.9, 0.1], [0.6, 0.4]])
    votes = np.stack([draw.random(20_000) < np.where(truth, a, b) for a, b in rates], axis=1).astype(float)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, learned, soft = pii.reliabilities(patterns, counts.astype(float))
    assert abs(share - 0.4) < 0.05 and np.abs(learned - rates).max() < 0.08
    assert ((soft[inverse.ravel()] > 0.5) == truth).mean() > 0.95
    weights = pii.classifier(patterns, soft, counts.astype(float))
    assert weights[1] > weights[2] > weights[3] > 0


# Decontamination

def brute_hits(text, items, window=10):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, body in items:
        own = decontaminate.words_of(body)
        size = min(window, len(own))
        for j in range(len(own) - size + 1 if own else 0):
            for i in range(len(words) - size + 1):
                if words[i:i + size] == own[j:j + size]:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
    return len(words), hit, found


@pytest.mark.parametrize("block_words", [10 ** 6, 60])
def test_hits_by_brute_force(spark, block_words):
    draw = random.Random(6)
    word = lambda: draw.choice("ab" if draw.random() < 0.7 else "cdef")
    items = [(k, " ".join(word() for _ in range(draw.choice([0, 1, 4, 9, 10, 11, 25])))) for k in range(1, 25)]
    items = [(k, t) for k, t in items if len(set(t)) > 3 or not t] + [(90, "Zeta, yeta xeta"), (91, None), (92, "zeta yeta xeta"), (92, "zeta yeta xeta")]
    docs = []
    for k in range(60):
        text = [word() for _ in range(draw.randrange(0, 40))]
        if k % 3 == 0:
            at = draw.randrange(len(text) + 1)
            text[at:at] = draw.choice(items)[1].split() if draw.choice(items)[1] and k % 2 else ["ZETA", "yeta-xeta"]
        docs.append((k, " ".join(text)))
    docs += [(100, None), (101, ""), (102, "!!"), (103, "zeta yeta xeta " * 5000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_hits(spark.createDataFrame(docs, DOCS).withColumn("hit", F.lit(1)), bench, block_words=block_words).collect()
    assert len(got) == len(docs)
    for r in got[:-1]:
        n, hit, found = brute_hits(r.text, items)
        assert r.hit.n_words == n and set(r.hit["items"]) == found, r
        assert {i for s in r.hit.spans for i in range(s.first, s.last + 1)} == hit, r
        assert all(decontaminate.words_of(r.text[s.begin:s.end]) == decontaminate.words_of(r.text)[s.first:s.last + 1] for s in r.hit.spans)
    assert got[-1].hit.n_words == 15_000 and sum(s.last - s.first + 1 for s in got[-1].hit.spans) == 15_000


def test_items_without_id_and_long_items(spark):
    draw = random.Random(11)
    long = [f"w{draw.randrange(200)}" for _ in range(700)]
    items = [(None, "alpha beta gamma"), (None, "delta epsilon"), ("None", "zeta eta"), ("long", " ".join(long)), ("long", "x y")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = ["alpha beta gamma delta epsilon", "zeta eta", " ".join(long[95:140]), " ".join(long[40:49]), " ".join(long[:10] + ["no"] + long[-10:]), "x y " + " ".join(long)]
    for block_words in (10 ** 6, 300):
        got = decontaminate.find_hits(spark.createDataFrame(list(enumerate(texts)), DOCS), bench, block_words=block_words).orderBy("doc_id").collect()
        assert [(sum(s.last - s.first + 1 for s in r.hit.spans), r.hit["items"]) for r in got] == [
            (5, [None]), (2, ["None"]), (45, ["long"]), (0, []), (20, ["long"]), (702, ["long"])]


def test_repeated_words_take_no_longer(spark):
    automaton = decontaminate.Automaton([(str(k), ["a"] * 2000) for k in range(3)])
    spans, found = automaton.hits(["a"] * 300_000)
    assert spans == [[0, 299_999]] and found == {"0", "1", "2"}


def test_removal(spark):
    leak = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    clean = "nothing of that " * 20
    rows = [(1, clean), (2, clean + leak.upper() + " and " + clean), (3, leak), (4, None), (5, ""), (2, clean)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.length("text").cast("long")).withColumn("other", F.lit(1))
    got = sorted(decontaminate.removed(docs, bench).collect(), key=lambda r: (r.doc_id, r.text or ""))
    assert [(r.doc_id, r.text) for r in got] == [(1, clean), (2, clean), (2, clean + " and " + clean), (4, None), (5, "")]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    empty = decontaminate.removed(docs, bench.filter("item_id > 5"))
    assert empty.count() == len(rows) and empty.columns == docs.columns
    assert decontaminate.removed(docs.filter("doc_id > 50"), bench).count() == 0


# Archives

def test_archives_round_trip(spark):
    rows = [(3, "http://a/", "same"), (1, "http://b/\r\nX: y", "same"), (2, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 300_000), (6, "u", "é" * 300_000), (7, "u", "x\r\n\r\ny"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    got = warc.read_archives(warc.write_archives(pages, archive_bytes=700)).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[3].refers_to, by[2].refers_to, by[None].refers_to) == ("response", 1, 1, 1)
    assert by[5].record_type == "revisit" and by[5].refers_to == 4 and [r.record_type for r in got if r.page_id == 6] == ["response"] * 2
    assert bytes(by[7].payload) == b"x\r\n\r\ny" and bytes(by[6].payload) == ("é" * 300_000).encode()
    for page, _, html in rows:
        data = (html or "").encode()
        assert by[page].payload_bytes == len(data) and by[page].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, min_bytes=10 ** 7)).collect()} == {"response"}
    assert warc.read_archives(warc.write_archives(pages.filter("page_id > 99"))).count() == 0


def test_reader_checks_what_it_reads():
    one, two = warc.record(1, "u", b"body" * 1000), warc.record(2, "u", b"other")
    both = list(warc.read_records(iter([(one + two)[i:i + 7] for i in range(0, len(one + two), 7)])))
    assert len(both) == 2 and both[0][1].endswith(b"body")
    assert zlib.decompress(one, zlib.MAX_WBITS | 16).startswith(b"WARC/1.1\r\n") and gzip.GzipFile(fileobj=io.BytesIO(one)).read(8) == b"WARC/1.1"
    with pytest.raises(ValueError):
        list(warc.read_records(iter([one[:-9]])))
    with pytest.raises(ValueError):
        list(warc.read_records(iter([gzip.compress(gzip.decompress(one)[:-1])])))


# Language ID

def test_gradients_are_those_of_the_loss():
    net = langid.Network(3, 4)
    draw = np.random.default_rng(1)
    grid, labels = draw.integers(65, 123, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    _, slopes = net.gradients(grid, labels)
    for k, weights in net.p.items():
        at = (2, int(grid[3, 1])) if k[0] == "x" else tuple(n - 1 for n in weights.shape)
        weights[at] += 1e-4
        up = net.gradients(grid, labels)[0]
        weights[at] -= 2e-4
        down = net.gradients(grid, labels)[0]
        weights[at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(slopes[k][at], rel=2e-2, abs=5e-6)


def test_windows_cover_every_byte():
    texts = [b"", b"a" * 64, b"b" * 65, b"c" * 200]
    grid, owner = langid.windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    assert grid.shape == (64, 1 + 2 + 4) and owner.tolist() == [1, 2, 2, 3, 3, 3, 3]
    assert sorted(grid[grid > 0].tobytes()) == sorted(b"".join(texts))


def test_pooled_equals_positions():
    net = langid.Network(4)
    grid = np.random.default_rng(2).integers(0, 256, (64, 50)).astype(np.uint8)
    plain = (net.positions(grid) * langid.LETTERS[grid][:, None, :]).sum(axis=0)
    assert np.abs(plain - net.pooled(grid)).max() < 1e-3


def test_language_of_odd_texts(spark):
    draw = random.Random(7)
    kinds = {"xx": ["wort", "öde", "straße", "über"], "yy": ["mot", "été", "leçon", "où"]}
    rows = [(k, " ".join(draw.choices(kinds[lang], k=30)), lang) for k in range(60) for lang in [draw.choice(["xx", "yy"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, net = langid.train(docs.select("text", "lang"))
    assert names == ["xx", "yy"]
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 ?!"), (4, "straße über öde wort"), (5, "où leçon été mot " * 20_000), (4, "straße über öde wort")], DOCS)
    got = langid.predict(asked.withColumn("score", F.lit(5)), names, net).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "xx", "yy", "xx"]
    assert all(0 <= r.score <= 1 for r in got) and got[3].score == got[5].score > 0.7
    none = langid.predict(asked, *langid.train(docs.select("text", "lang").filter("lang = 'zz'"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.predict(asked.filter("doc_id > 9"), names, net).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, net = langid.train(langid.labelled(docs))
    seen = langid.predict(docs.filter(langid.held_out(F.col("doc_id"))), names, net)
    assert seen.filter("lang = lang_pred").count() >= 0.97 * seen.count()


def test_language_sample_is_of_distinct_texts(spark, monkeypatch):
    draw = random.Random(8)
    texts = [" ".join(draw.choices(["wort", "öde", "straße", "über"], k=30)) for _ in range(40)]
    docs = spark.createDataFrame([(t, lang) for t in texts for lang in ("xx", "yy")], "text string, lang string")
    first = docs.orderBy(F.xxhash64("text")).first()["text"]
    copies = spark.createDataFrame([(first, "xx")] * 50, docs.schema)
    grids = []
    monkeypatch.setattr(langid.Network, "fit", lambda self, grid, labels: grids.append((grid.T.tolist(), labels.tolist())))
    for known in (docs, docs.unionByName(copies)):
        assert langid.train(known, sample_docs=20)[0] == ["xx", "yy"]
    assert grids[0] == grids[1] and len(set(map(bytes, grids[0][0]))) > 20


def test_every_language_is_learned(spark):
    draw = random.Random(9)
    letters = [chr(0x4E00 + 40 * k + j) for k in range(70) for j in range(40)]
    rows = [(" ".join("".join(draw.choices(letters[40 * k:40 * k + 40], k=4)) for _ in range(12)), f"l{k:02}") for k in range(70) for _ in range(7 if k else 5)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    names, net = langid.train(docs)
    assert names == [f"l{k:02}" for k in range(70)]
    seen = langid.predict(docs, names, net)
    assert seen.filter("lang = lang_pred").count() >= 0.9 * len(rows)
    assert seen.filter("lang = 'l00' AND lang_pred = 'l00'").count() >= 3


def plain_language(weights, text):
    """(label, score) by loops over bytes, windows and directions."""
    data, sums = (text or "").encode(), np.zeros(len(weights["c"]))
    n = weights["uf"].shape[1]
    for at in range(0, len(data), langid.STEPS):
        window = data[at:at + langid.STEPS].ljust(langid.STEPS, b"\0")
        states = {}
        for d in "fb":
            h = np.zeros(n)
            for t in range(langid.STEPS) if d == "f" else reversed(range(langid.STEPS)):
                x, u = weights["x" + d][:, window[t]], weights["u" + d] @ h
                z, r = np.clip(0.2 * (x + u)[:2 * n] + 0.5, 0, 1).reshape(2, n)
                new = x[2 * n:] + r * u[2 * n:]
                h = (1 - z) * new / (1 + np.abs(new)) + z * h
                states[d, t] = h
        for t, byte in enumerate(window):
            if chr(byte).isalpha() and byte < 128 or byte >= 0xC3 or 0x80 <= byte < 0xC0:
                logits = weights["vf"] @ states["f", t] + weights["vb"] @ states["b", t] + weights["c"][:, 0]
                sums += np.exp(logits) / np.exp(logits).sum()
    if not any(ch.isalpha() for ch in text or ""):
        return "und", 0.0
    return int(sums.argmax()), sums.max() / sums.sum()


def test_language_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, net = langid.train(langid.labelled(docs))
    weights = {k: v.astype(float) for k, v in net.p.items()}
    asked = docs.filter("doc_id < 40").select("doc_id", "text").unionByName(spark.createDataFrame([(1000, None), (1001, ""), (1002, "12 ?"), (1003, "é"), (1004, "a" * 64), (1005, "b" * 65)], DOCS))
    for r in langid.predict(asked, names, net).collect():
        label, score = plain_language(weights, r.text)
        assert r.lang_pred == (label if label == "und" else names[label]) and r.score == pytest.approx(score, abs=1e-4)


# Toxicity

def plain_toxicity(slopes, bias, text):
    """Score by loops: the largest mean over the passages of what their subwords say."""
    plain = [32, *[b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in (text or "").encode()], 32]
    passages = [[] for _ in range(-(-len(plain) // toxicity.PASSAGE))]
    for n in toxicity.GRAMS:
        for at in range(len(plain) - n + 1):
            if 32 in plain[at + 1:at + n - 1]:
                continue
            h = n
            for b in plain[at:at + n]:
                h = (h ^ b) * 0x9E3779B97F4A7C15 % 2 ** 64
                h ^= h >> 29
            passages[at // toxicity.PASSAGE].append(slopes[(h >> 40) % toxicity.BUCKETS])
    odds = max(np.mean(p) if p else 0.0 for p in passages) + bias
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def test_toxicity_against_plain_loops(spark):
    bag = toxicity.Bag()
    rows = toxic_rows(120, 3)
    bag.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows]))
    asked = [(k, t) for k, t, _ in rows[:40]] + [(200, None), (201, ""), (202, "!"), (203, "é ß 日本"), (204, "ab"), (205, "x" * 95), (206, "y " * 300)]
    slopes, bias = bag.slopes(), float(bag.b[1] - bag.b[0])
    for r in toxicity.predict(spark.createDataFrame(asked, DOCS), bag).collect():
        assert r.score == pytest.approx(plain_toxicity(slopes, bias, r.text), abs=1e-9) and r.predicted == int(r.score >= 0.5)


def test_training_lowers_false_alarms(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    known = toxicity.labelled(docs, toxicity.sampled_labels(labels)).collect()
    asked = docs.join(labels.filter("toxic = 0"), "doc_id").filter(toxicity.held_out(F.col("doc_id"))).select("doc_id", "text")
    alarms = []
    for epochs in (0, toxicity.EPOCHS):
        bag = toxicity.Bag()
        bag.fit([r.text or "" for r in known], np.array([r.toxic for r in known]), epochs=epochs)
        alarms.append(toxicity.predict(asked, bag).agg(F.avg("predicted")).first()[0])
    assert alarms[1] < 0.05 < 0.3 < alarms[0]


def test_subwords_have_no_inner_border():
    data = "Ab, cdefg".encode()
    buckets, passage, ends = toxicity.subwords(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    again, _, _ = toxicity.subwords(np.frombuffer(b"aB cdefg", np.uint8), np.array([0, 8]))
    # " ab ": 2 of three and 1 of four bytes; " cdefg ": 5 of three, 4 of four and 3 of five.
    assert len(buckets) == 15 and sorted(buckets) == sorted(again) and ends.tolist() == [0, 1] and not passage.any()


def toxic_rows(n, seed):
    draw = random.Random(seed)
    stem = lambda: "".join(draw.choices("aeiourstln", k=draw.randrange(2, 8)))
    rows = []
    for k in range(n):
        words, bad = [stem() for _ in range(draw.choice([10, 50, 400]))], k % 4 == 0
        for _ in range(3 if bad else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["grumpf", "zokwat"]) + draw.choice(["", "ig", "er", "x"]))
        rows.append((k, " ".join(words), int(bad)))
    return rows


def test_toxicity_finds_unseen_forms(spark):
    bag = toxicity.Bag()
    rows = toxic_rows(400, 1)
    bag.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows]))
    fresh = [(k, t.replace("grumpf", "grumpph"), y) for k, t, y in toxic_rows(200, 2)]
    asked = spark.createDataFrame([(k, t) for k, t, _ in fresh] + [(900, None), (901, ""), (902, "!"), (903, "lost " * 30_000), (904, "lost " * 30_000 + "zokwat zokwater zokwatig")], DOCS)
    got = toxicity.predict(asked.withColumn("predicted", F.lit("x")), bag).collect()
    y = [y for _, _, y in fresh]
    assert np.mean([r.predicted == t for r, t in zip(got, y)]) > 0.95
    odd = {r.doc_id: r for r in got[len(fresh):]}
    assert all(0 <= r.score <= 1 for r in got) and odd[900].score == odd[901].score == odd[902].score and odd[903].predicted == 0 and odd[904].predicted == 1
    assert toxicity.predict(asked.filter("doc_id < 0"), bag).count() == 0


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    bag = toxicity.train(toxicity.labelled(docs, toxicity.sampled_labels(labels)))
    assert toxicity.predict(docs, bag).first().score == pytest.approx(0.5)


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op9_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    rate = {r.toxic: r.p for r in got}
    assert rate[0] < 0.03 and rate[1] > 0.7


def test_least_scores_of_all_texts(spark):
    """Every distinct recognised text counts, however many a language has; copies and other predictions do not."""
    own = spark.range(5001, 10_001).select(F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("en").alias("lang_pred"), (F.col("id") / 10_000).alias("score"))
    copies = own.filter("score < 0.5003").crossJoin(spark.range(50)).drop("id")
    wrong = spark.createDataFrame([("x", "en", "de", 0.1), ("y", "de", "en", 0.2)], own.schema)
    got = dict(langid.least_scores(own.unionByName(copies).unionByName(wrong), ["de", "en", "fr"]).collect())
    assert got == {"de": 1 / 3, "en": 0.5005, "fr": 1 / 3}
    assert dict(langid.least_scores(own.filter("lang = 'zz'"), []).collect()) == {}
