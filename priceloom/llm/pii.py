"""Personal data by weak supervision.

Labelers of three sorts vote on candidate spans: patterns (is it well formed, is the check
digit right), a gazetteer of words that announce a kind of datum, and the context around
the span.  Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is and how likely each pattern is personal data; with these as soft labels a
logistic classifier on span features is trained, and it alone decides about extra spans.

Votes and features are bits, so the whole corpus enters the training as a table of counts
per (kind, bits): its size is bounded by the number of bits, not by the data.

Base spans (exact patterns) are always kept.  Extra spans are looser writings of the same
kinds that the classifier accepts and that overlap no other span.

Defined cases: NULL is the empty text; offsets are code points, ends exclusive; runs of digits may
have any length (leading zeros do not count); rows that
repeat are treated alike; extra columns pass through, clashing ones are replaced; without
any candidate the classifier accepts nothing.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
#: Words that announce a kind of datum (fixed values).
GAZETTEER = {
    "email": ("email", "e-mail", "mail", "correo", "courriel", "contact", "contacto", "kontakt"),
    "ip": ("ip", "address", "host", "server", "adresse", "dirección", "servidor"),
    "card": ("card", "visa", "credit", "tarjeta", "carte", "karte", "kreditkarte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
}
#: What the classifier must give an extra span.
ACCEPT = 0.9
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# A match of digits always begins with its run of digits, so looking behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser writings: obfuscated mail, telephone numbers without a country, spaced or bracketed addresses, digit groups.
_LOOSE = {
    "email": re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{2,24}){1,4}"),
    "ip": re.compile(r"(?<![0-9.])(?:[0-9]{1,3} ?\[\.\] ?){3}[0-9]{1,3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9.-])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.-])(?:\(0?[0-9]{2,4}\) ?|00[1-9][0-9]?[ .-]|0?[1-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
_NEAR = 40
#: Bits of a candidate: exact pattern; check (Luhn, ranges, plausible domain); usual length; gazetteer word near;
#: separators as people write them; stands alone between blanks; digits around.
BITS = ("exact", "check", "length", "gazetteer", "shape", "alone", "crowded")
VOTES = (0, 1, 2, 3, 4, 5)  # the bits that vote; all are features of the classifier


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def octets(text: str) -> bool:
    """Whether all numbers are at most 255, however many digits and leading zeros they have."""
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in re.findall(r"[0-9]+", text)))


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The exact patterns: leftmost, not overlapping within a kind; a match that fails its check is dropped."""
    out, last = [], 0
    for m in _AT.finditer(text):
        local = _LOCAL.search(text[max(last, m.start() - 256):m.start()])
        if local and local.start() == 0 and m.start() - 256 > last:  # a very long local part
            local = _LOCAL.search(text[last:m.start()])
            begin = last + local.start()
        else:
            begin = m.start() - len(local[0]) if local else -1
        if begin >= 0:
            out.append((begin, m.end(), "email"))
            last = m.end()
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if octets(m[0])]
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() >= 12 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def loose_spans(text: str) -> list[tuple[int, int, str]]:
    lower = text.lower() if "at" in text else ""
    keep = []
    for kind, pattern in _LOOSE.items():
        if kind == "email" and not ("(at)" in lower or "[at]" in lower or "{at}" in lower) or kind == "ip" and "[.]" not in text:
            continue
        keep += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return keep


def bits_of(text: str, begin: int, end: int, kind: str, exact: bool) -> int:
    span, digits = text[begin:end], _digits(text[begin:end])
    near = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, begin - _NEAR):begin].lower())[-4:]
    check = {"email": lambda: bool(re.search(r"[.)\]}] ?[A-Za-z]{2,24}\Z", span)), "ip": lambda: octets(span),
             "card": lambda: luhn(digits), "phone": lambda: len(set(digits)) > 2}[kind]()
    usual = {"email": 6 <= len(span) <= 60, "ip": len(re.findall(r"[0-9]+", span)) == 4, "card": 13 <= len(digits) <= 16, "phone": 9 <= len(digits) <= 13}[kind]
    shape = {"email": " " not in span.strip(), "ip": "  " not in span, "card": not re.search(r"[-\x20]{2}", span), "phone": bool(re.search(r"[\x20().-]", span))}[kind]
    left, right = text[begin - 1:begin], text[end:end + 1]
    alone = (not left or left.isspace() or left in "(<\"':") and (not right or right.isspace() or right in ").,;>\"'!?")
    crowded = bool(re.search(r"[0-9]", text[max(0, begin - 3):begin] + text[end:end + 3]))
    flags = (exact, check, usual, any(w in GAZETTEER[kind] for w in near), shape, alone, crowded)
    return sum(1 << k for k, flag in enumerate(flags) if flag)


SPANS = "array<struct<begin:int,end:int,kind:string,bits:int,exact:boolean>>"


def candidates(docs: DataFrame) -> DataFrame:
    """docs without their text, with ``found``: the base spans and all candidates for extra ones."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, text_at = batch.schema.get_field_index("found"), batch.schema.get_field_index("text")
            kind = batch.schema.field(at).type
            out = []
            for text in batch.column(text_at):
                text = text.as_py() or ""
                base = base_spans(text)
                taken = sorted((b, e) for b, e, _ in base)
                extra = []
                for b, e, k in sorted(loose_spans(text)):
                    if not any(b < y and x < e for x, y in taken) and (not extra or extra[-1][1] <= b):
                        extra.append((b, e, k))
                out.append([{"begin": b, "end": e, "kind": k, "bits": bits_of(text, b, e, k, x), "exact": x}
                            for group, x in ((base, True), (extra, False)) for b, e, k in group])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, kind)).set_column(
                text_at, batch.schema.field(text_at), pa.nulls(batch.num_rows, batch.schema.field(text_at).type))

    held = docs.drop("found").withColumn("found", F.lit(None).cast(SPANS))
    return held.mapInArrow(scan, held.schema).drop("text")


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation for two classes and independent labelers.

    votes: one row of 0/1 per pattern; counts: how often it occurs.  Gives the share of
    personal data, each labeler's (vote rate on personal data, vote rate on the rest), and
    each pattern's probability.
    """
    p = np.clip(votes.mean(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        w = p * counts
        rest = (1 - p) * counts
        yes = (votes.T @ w + 1.5) / (w.sum() + 2)
        no = (votes.T @ rest + 0.5) / (rest.sum() + 2)
        share = (w.sum() + 1) / (counts.sum() + 2)
        odds = np.log(share / (1 - share)) + votes @ np.log(yes / no) + (1 - votes) @ np.log((1 - yes) / (1 - no))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return float(share), np.stack([yes, no], axis=1), p


def classifier(features: np.ndarray, soft: np.ndarray, counts: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression on soft labels (Newton's method, light ridge); the first is the intercept."""
    x = np.hstack([np.ones((len(features), 1)), features])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (soft - p)) - 0.1 * w
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def train(found: DataFrame) -> dict[str, list[float]]:
    """Classifier weights by kind, from the counts of all candidates of the corpus."""
    spans = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.bits").count().orderBy("kind", "bits").collect()
    out = {}
    for kind in KINDS:  # at most 2 ** len(BITS) rows each
        rows = [(r["bits"], r["count"]) for r in spans if r["kind"] == kind]
        if rows:
            features = np.array([[b >> k & 1 for k in range(len(BITS))] for b, _ in rows], float)
            counts = np.array([n for _, n in rows], float)
            _, _, soft = reliabilities(features[:, VOTES], counts)
            out[kind] = [float(x) for x in classifier(features, soft, counts)]
    return out


def find_pii(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """docs without their text, with ``spans``: (begin, end, kind, exact, score) by start, then kind as listed."""
    from ..session import materialize

    found = materialize(candidates(docs), "candidates")
    weights = train(found)

    def score(s):
        z = F.lit(-30.0)
        for kind, w in weights.items():
            terms = F.lit(w[0])
            for k in range(len(BITS)):
                terms = terms + F.lit(w[k + 1]) * F.shiftright(s["bits"], k).bitwiseAND(F.lit(1))
            z = F.when(s["kind"] == kind, terms).otherwise(z)
        return 1 / (1 + F.exp(-z))

    rank = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    scored = F.transform("found", lambda s: F.struct(
        s["begin"].alias("begin"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["exact"].alias("exact"), score(s).alias("score")))
    kept = F.array_sort(F.filter(scored, lambda s: s["exact"] | (s["score"] >= accept)))
    return found.withColumn("spans", kept).drop("found")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["exact"])
    return out.select(
        "doc_id", *[F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
