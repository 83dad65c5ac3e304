"""Language identification with a bidirectional gated recurrent network over bytes.

Text is read as UTF-8 bytes in windows of ``STEPS`` bytes.  One recurrent network reads a
window forwards, one backwards; at every position both states give the language of that
byte.  A document's probabilities are the mean over all positions that are letters, so the
whole text counts, not a prefix.  The network is trained here, in numpy, by
backpropagation through time on a bounded sample of the labelled documents of each
language, however many languages there are; copies of a text count once there.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0; without any
training row every text is ``und`` with score 0; equal texts get equal predictions; rows
that repeat are treated alike; extra columns pass through, clashing ones are replaced.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.stats import order_statistics
from .common import table, text_slices

STEPS = 64
HIDDEN = 8
#: Bound of the training sample: so many documents of each language, so many windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 6
#: The share of a language's recognised texts that may score less than its least score.
LOW = 0.001
EPOCHS, BATCH, RATE = 12, 512, 0.03
#: A small sample is gone through more often, up to so many steps.
LEAST_STEPS = 150
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that can be (part of) a letter.
LETTERS = np.array([chr(b).isalpha() and b < 128 or b >= 0xC3 for b in range(256)]) | np.array([0x80 <= b < 0xC0 for b in range(256)])


def windows(data: np.ndarray, offsets: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(steps x windows bytes, row of each window).  A row's windows begin at its first byte; the last one is filled with
    zero bytes, which are no letters.
    """
    sizes = np.diff(offsets)
    count = -(-sizes // steps)
    owner = np.repeat(np.arange(len(sizes)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[owner] + within * steps
    held = np.concatenate([data, np.zeros(steps, np.uint8)])
    grid = held[at[None, :] + np.arange(steps)[:, None]]
    grid[np.arange(steps)[:, None] >= (offsets[owner + 1] - at)[None, :]] = 0
    return grid, owner


class Network:
    """Embedded input gates, recurrent weights and position-wise outputs of both directions (float32).

    Gates are hard sigmoids, clip(x / 5 + 1/2), and candidate states soft signs, x / (1 + |x|): both cost a fraction of
    what exponentials do.
    """

    def __init__(self, labels: int, hidden: int = HIDDEN, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = draw.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.p["u" + d] = draw.normal(0, 0.3, (3 * hidden, hidden)).astype(np.float32)
            self.p["v" + d] = draw.normal(0, 0.3, (labels, hidden)).astype(np.float32)
        self.p["c"] = np.zeros((labels, 1), np.float32)

    @classmethod
    def of(cls, weights: dict[str, np.ndarray]) -> "Network":
        made = cls(len(weights["c"]))
        made.p, made.hidden = weights, weights["uf"].shape[1]
        return made

    def _run(self, grid: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each step (steps, hidden, windows), in reading order of the direction."""
        n, x, u = self.hidden, self.p["x" + d], self.p["u" + d]
        h = np.zeros((n, grid.shape[1]), np.float32)
        out = np.empty((len(grid), n, grid.shape[1]), np.float32)
        for t in range(len(grid)) if d == "f" else range(len(grid) - 1, -1, -1):
            a = x.take(grid[t], axis=1)
            b = u @ h
            gates = a[:2 * n]
            gates += b[:2 * n]
            gates *= 0.2
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            z, r = gates[:n], gates[n:]
            new = a[2 * n:]
            new += r * b[2 * n:]
            new /= 1 + np.abs(new)
            if keep is not None:
                keep.append((t, h, z, r, new, b[2 * n:]))
            h = new + z * (h - new)
            out[t] = h
        return out

    def positions(self, grid: np.ndarray, states=None) -> np.ndarray:
        """Probabilities (steps, labels, windows) of every position."""
        f, b = states or (self._run(grid, "f"), self._run(grid, "b"))
        logits = self.p["vf"] @ f + self.p["vb"] @ b + self.p["c"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def pooled(self, grid: np.ndarray) -> np.ndarray:
        """Sum of the positions' probabilities over the letters of each window (labels, windows); as ``positions``, without
        keeping any state.
        """
        n, width = self.hidden, grid.shape[1]
        mask, grid = LETTERS[grid].astype(np.float32), grid.astype(np.intp)
        logits = np.empty((len(grid), len(self.p["c"]), width), np.float32)
        total = np.zeros((len(self.p["c"]), width), np.float32)
        a, b, work = np.empty((3 * n, width), np.float32), np.empty((3 * n, width), np.float32), np.empty((n, width), np.float32)
        for d in "fb":
            x, u, v = self.p["x" + d].copy(), self.p["u" + d].copy(), self.p["v" + d]
            x[:2 * n] = x[:2 * n] * 0.2 + 0.5
            u[:2 * n] *= 0.2
            h = np.zeros((n, width), np.float32)
            for t in range(len(grid)) if d == "f" else range(len(grid) - 1, -1, -1):
                np.take(x, grid[t], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=b)
                gates, new = a[:2 * n], a[2 * n:]
                gates += b[:2 * n]
                np.maximum(gates, 0, out=gates)
                np.minimum(gates, 1, out=gates)
                np.multiply(gates[n:], b[2 * n:], out=work)
                new += work
                np.abs(new, out=work)
                work += 1
                new /= work
                h -= new
                h *= gates[:n]
                h += new
                if d == "f":
                    np.matmul(v, h, out=logits[t])
                    continue
                at = logits[t]
                at += v @ h
                at += self.p["c"]
                np.minimum(at, 60, out=at)
                np.exp(at, out=at)
                at *= mask[t] / at.sum(axis=0)
                total += at
        return total

    def gradients(self, grid: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients by backpropagation through time; each position of a window has the window's label."""
        keep = {"f": [], "b": []}
        states = {d: self._run(grid, d, keep[d]) for d in "fb"}
        prob = self.positions(grid, (states["f"], states["b"]))
        mask = LETTERS[grid].astype(np.float32)[:, None, :]
        total = max(float(mask.sum()), 1.0)
        target = np.zeros_like(prob)
        target[:, labels, np.arange(len(labels))] = 1
        loss = -float((np.log((prob * target).sum(axis=1) + 1e-9) * mask[:, 0]).sum()) / total
        err = (prob - target) * mask / total
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["c"] = err.sum(axis=(0, 2))[:, None]
        n = self.hidden
        for d in "fb":
            u = self.p["u" + d]
            g["v" + d] = np.einsum("tlw,thw->lh", err, states[d], optimize=True)
            back = np.zeros((n, grid.shape[1]), np.float32)
            parts, when = [], []
            for t, h, z, r, new, un in reversed(keep[d]):
                back = back + self.p["v" + d].T @ err[t]
                dnew = back * (1 - z) * (1 - np.abs(new)) ** 2
                dz = back * (h - new) * 0.2 * ((z > 0) & (z < 1))
                dr = dnew * un * 0.2 * ((r > 0) & (r < 1))
                da = np.concatenate([dz, dr, dnew])
                db = np.concatenate([dz, dr, dnew * r])
                g["u" + d] += db @ h.T
                back = back * z + u.T @ db
                parts.append(da)
                when.append(t)
            seen, flat = grid[when].ravel(), np.stack(parts).transpose(1, 0, 2).reshape(3 * n, -1)
            g["x" + d] = np.stack([np.bincount(seen, row, 256) for row in flat]).astype(np.float32)
        return loss, g

    def fit(self, grid: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 0) -> float:
        """Adam over shuffled batches, slowing down to a tenth."""
        draw = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        epochs = max(epochs, -(-LEAST_STEPS // max(1, -(-len(labels) // batch))))
        step, loss, last = 0, 0.0, max(1, epochs * -(-len(labels) // batch))
        for _ in range(epochs):
            order = draw.permutation(len(labels))
            for i in range(0, len(order), batch):
                own = order[i:i + batch]
                loss, g = self.gradients(grid[:, own], labels[own])
                step += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k, x in g.items():
                    x = x * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= rate * (1 - 0.9 * step / last) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
        return loss


def distinct_texts(labelled: DataFrame, most: int) -> tuple[list[str], DataFrame | None]:
    """(languages, their distinct texts with the smallest hashes: text, lang; ``most`` of each) of labelled (text, lang)."""
    c = F.col
    known = labelled.filter(c("lang").isNotNull() & (F.length("text") > 0)).select("text", "lang", F.xxhash64("text").alias("h"))
    counts = known.groupBy("lang", "h").count().groupBy("lang").count().collect()  # one row per language
    if not counts:
        return [], None
    # A first cut by what share of a language's evenly spread hashes holds several times the sample keeps texts out of the
    # shuffle and a language from filling a task.
    tops = [(r["lang"], min(2 ** 63 - 1, -2 ** 63 + 2 ** 64 * (4 * most + 100) // r["count"])) for r in counts]
    low = F.broadcast(known.sparkSession.createDataFrame(tops, "lang string, top long"))
    few = known.join(low, "lang").filter("h <= top").groupBy("lang", "h").agg(F.min("text").alias("text"))
    few = few.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(c("_rank") <= most)
    return sorted(r["lang"] for r in counts), few.select("text", "lang")


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> tuple[list[str], Network | None]:
    """(languages, network) from labelled (text, lang); the sample is bounded and the same on every run."""
    c = F.col
    names, picked = distinct_texts(labelled, sample_docs)
    if not names:
        return [], None
    size = STEPS * 2
    # From each text so many pieces at even distances; a piece holds a window.
    at = F.transform(F.sequence(F.lit(0), F.lit(sample_windows - 1)), lambda i: F.floor(
        i * F.greatest(F.length("text") - size, F.lit(0)) / max(1, sample_windows - 1)).cast("int"))
    rows = picked.select("lang", F.transform(F.array_distinct(at), lambda i: F.substring(c("text"), i + 1, F.lit(size))).alias("pieces")).collect()
    pieces = [(p.encode()[:STEPS], names.index(r["lang"])) for r in sorted(rows, key=lambda r: (r["lang"], r["pieces"])) for p in r["pieces"]]
    grid = np.stack([np.frombuffer(p.ljust(STEPS, b"\0"), np.uint8) for p, _ in pieces], axis=1)
    network = Network(len(names))
    network.fit(grid, np.array([k for _, k in pieces]))
    return names, network


def predict(docs: DataFrame, names: list[str], network: Network | None, at_once: int = 2048) -> DataFrame:
    """docs with ``lang_pred`` and ``score``, from the whole text."""
    held = docs.drop("lang_pred", "score").withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    sent = held.sparkSession.sparkContext.broadcast((names, network and network.p))

    at_once = max(1, min(at_once, 64 * at_once // max(1, len(names))))  # the room does not grow with the languages

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = sent.value
        network = weights and Network.of(weights)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            best, score = [UNKNOWN] * len(text), np.zeros(len(text))
            for first, last, data, offsets in text_slices(text, 1 << 18) if network is not None else ():
                grid, owner = windows(data, offsets)
                sums = np.zeros((len(names), last - first))
                for i in range(0, len(owner), at_once):
                    part = grid[:, i:i + at_once]
                    prob = network.pooled(part)
                    for k in range(len(names)):
                        sums[k] += np.bincount(owner[i:i + at_once], prob[k], last - first)
                total = sums.sum(axis=0)
                top = sums.argmax(axis=0)
                for row in range(last - first):
                    if total[row] > 0 and _LETTER.search(text[first + row].as_py()):
                        best[first + row] = names[top[row]]
                        score[first + row] = min(1.0, sums[top[row], row] / total[row])
            for name, values in (("lang_pred", pa.array(best, pa.string())), ("score", pa.array(score, pa.float64()))):
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, batch.schema.field(at), values)
            yield batch

    return held.mapInArrow(scan, held.schema)


def least_scores(seen: DataFrame, names: list[str], low: float = LOW) -> DataFrame:
    """(lang, least): a score below which only a share ``low`` of a language's own distinct texts that are recognised lies.

    ``seen``: (text or its ``_hash``, lang, lang_pred, score) of all learnable texts; none is left out.  Scores are counted per
    value and per coarse cell; only the cell that holds the position is sorted.  A language of which no text is
    recognised has the even guess.
    """
    c = F.col
    spark = seen.sparkSession
    if "_hash" not in seen.columns:
        seen = seen.withColumn("_hash", F.xxhash64("text"))
    own = seen.filter((c("lang") == c("lang_pred")) & c("score").isNotNull()).select("lang", "_hash", "score").distinct()
    counts = own.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    at = lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(low)))
    found = {r["lang"]: r["low"] for r in order_statistics(counts, ["lang"], "score", lambda n: (at(n), at(n)), "n").collect()}
    return spark.createDataFrame([(name, found.get(name, 1 / len(names))) for name in names], "lang string, least double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def labelled(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """What may be learned from; text and lang, or other ``columns`` of it."""
    return docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)) & F.col("lang").isNotNull()).select(*(columns or ("text", "lang")))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names, network = train(labelled(docs))
    out = predict(docs.select("doc_id", "text"), names, network)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
