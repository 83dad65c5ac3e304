"""Document fingerprints: a threshold-scaled sketch of word shingles.

Every shingle has a 64-bit hash, and a sketch keeps all hashes below a fixed fraction of
the hash range.  Because the threshold is the same for all texts, the sketch of a union is
the union of the sketches, and the shared part of two sketches estimates containment even
where one text is a hundred times the other.

A text of at most ``WHOLE`` shingles keeps all of them: its sketch is whole, which a hash above the threshold shows.
Two whole sketches are compared exactly.  Beside a sampled one, only hashes below the threshold count, of both;
so the law of unions holds for what is below the threshold in any sketch (``merged``).

Defined cases: NULL is the empty text; a text with fewer words than a shingle is one
shingle, a text without words has the empty sketch.  Two empty
sketches have likeness and containment 1, an empty and another one 0.  A short text none of whose hashes is below the threshold
cannot be looked for in a sampled sketch: containment is NULL, likeness 0 (at most WHOLE shared
shingles cannot be much of the longer text).  Rows that repeat are kept, each with
its own result; extra columns pass through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHINGLE = 5
#: One hash in 2**KEEP_BITS is kept.
KEEP_BITS = 3
#: Texts of at most so many shingles (repeated ones counted) keep all hashes; of more, 1 in 5,000 keeps none.
WHOLE = 64
#: About so many documents are ordered together when neighbours are looked up.
RUN_ROWS = 512
QUANTILES = 200


def sketch(text: Column, width: int = SHINGLE, keep_bits: int = KEEP_BITS) -> Column:
    """Sorted array of the kept hashes."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(array: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(array) - width),
                           lambda i: F.xxhash64(*[F.get(array, i + k) for k in range(width)]))
        few = F.array(F.xxhash64(F.array_join(array, " ")))
        return F.when(F.size(array) >= width, many).when(F.size(array) > 0, few).otherwise(F.array().cast("array<bigint>"))

    def cut(all_hashes: Column) -> Column:
        kept = F.when(F.size(all_hashes) <= WHOLE, all_hashes).otherwise(sampled(all_hashes, keep_bits))
        return F.array_sort(F.array_distinct(kept))

    # Through one-element arrays, so that words and hashes are computed once and not per use.
    return F.get(F.transform(F.transform(F.array(words), hashes), cut), 0)


def encoded(kept: Column) -> Column:
    """Sketch as text: comma-joined hexadecimal hashes."""
    return F.array_join(F.transform(kept, lambda h: F.lower(F.hex(h))), ",")


def sampled(hashes: Column, keep_bits: int = KEEP_BITS) -> Column:
    """The hashes below the threshold."""
    return F.filter(hashes, lambda h: F.shiftrightunsigned(h, 64 - keep_bits) == 0)


def _comparable(a: Column, b: Column, keep_bits: int, then) -> Column:
    """then(a, b) of what two sketches have in common terms: all hashes if both are whole, else those below the threshold."""
    whole = lambda x: (F.size(x) == 0) | F.exists(x, lambda h: F.shiftrightunsigned(h, 64 - keep_bits) != 0)
    exact = whole(a) & whole(b)
    pair = F.struct(F.when(exact, a).otherwise(sampled(a, keep_bits)).alias("a"), F.when(exact, b).otherwise(sampled(b, keep_bits)).alias("b"))
    return F.get(F.transform(F.array(pair), lambda p: then(p["a"], p["b"])), 0)


def likeness(a: Column, b: Column, keep_bits: int = KEEP_BITS) -> Column:
    """Estimated Jaccard resemblance of the shingle sets."""
    def share(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x, y))
        joint = F.size(x) + F.size(y) - shared
        return F.when(joint > 0, shared / joint).when(F.size(a) == F.size(b), 1.0).otherwise(0.0)

    return _comparable(a, b, keep_bits, share)


def containment(a: Column, b: Column, keep_bits: int = KEEP_BITS) -> Column:
    """Estimated share of the first text's shingles that the second holds; NULL where the sketches cannot tell."""
    return _comparable(a, b, keep_bits, lambda x, y: F.when(F.size(a) == 0, 1.0).when(F.size(b) == 0, 0.0).when(
        F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)))


def merged(a: Column, b: Column, keep_bits: int = KEEP_BITS) -> Column:
    """The part below the threshold of the sketch of both texts' shingles together."""
    return F.array_sort(F.array_union(sampled(a, keep_bits), sampled(b, keep_bits)))


def _knots(ids: DataFrame, run_rows: int, quantiles: int) -> DataFrame:
    """One row: quantiles of the ids, and how many cells lie between two of them.

    Written, since approximate quantiles may differ from one pass to the next, and all rows have to be cut alike.
    """
    from ..session import materialize

    return materialize(ids.agg(F.struct(
        F.array_distinct(F.percentile_approx("doc_id", [i / quantiles for i in range(quantiles + 1)], 10_000)).alias("at"),
        F.ceil(F.count(F.lit(1)) / (quantiles * run_rows)).cast("long").alias("cells")).alias("knots")), "knots")


def _in_runs(rows: DataFrame, knots: DataFrame) -> DataFrame:
    """rows with ``_place`` (between which quantiles of the ids) and ``_run`` (a cell of that place).

    Runs follow the order of the ids and hold about ``run_rows`` rows each, whatever the
    spread of the ids: an equal-depth histogram, cut into equal widths between its knots.
    Widths are doubles: differences of any two ids fit, and rounding keeps their order.  Ids below the first knot (a quantile
    of large ids may be rounded up) are one run.
    """
    c = F.col
    place = F.size(F.filter(c("_k.at"), lambda k: k <= c("doc_id")))
    low = F.get(c("_k.at"), F.greatest(place - 1, F.lit(0))).cast("double")
    high = F.coalesce(F.get(c("_k.at"), place).cast("double"), low)
    share = (c("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0))
    inside = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * c("_k.cells"))
    return rows.withColumn("_k", knots.scalar()).withColumns({
        "_place": F.coalesce(F.when(c("doc_id").isNotNull(), place), F.lit(-1)),
        "_run": F.coalesce(F.least(inside, c("_k.cells") - 1), F.lit(0)).cast("long")}).drop("_k")


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column] | None = None, run_rows: int = RUN_ROWS,
              quantiles: int = QUANTILES) -> DataFrame:
    """Adds ``derived`` columns, and ``next_<c>`` for each of them and of ``columns``: the value in the next row by descending
    doc_id (NULL ids last, equal ids by text); the last row's next one is the first.

    Rows are ordered within runs of ids; the next row of a run's last row is the head of the
    run below, looked up in a table that has one row per run.
    """
    from ..session import materialize

    c = F.col
    derived = derived or {}
    ids = docs.select("doc_id")
    knots = _knots(ids, run_rows, quantiles)
    held = _in_runs(docs.withColumns(derived), knots)
    # Written, so that its true size decides how it is joined: one row for hundreds of documents.
    tops = materialize(_in_runs(ids, knots).groupBy("_place", "_run").agg(F.max("doc_id").alias("_head")), "tops")
    # Which head follows a run: that of the next run of its place, else of the next place (at most quantiles + 2 of
    # them), and the highest of all after the lowest.
    places = tops.groupBy("_place").agg(F.max_by("_head", "_run").alias("_first"))
    down = Window.orderBy(c("_place").desc())
    around = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = F.lit(True)
    places = places.select("_place", F.when(F.lead(end).over(down), F.lead("_first").over(down)).otherwise(F.first("_first").over(around)).alias("_then"))
    within = Window.partitionBy("_place").orderBy(c("_run").desc())
    below = tops.withColumns({"_more": F.lead(end).over(within), "_lower": F.lead("_head").over(within)}).join(F.broadcast(places), "_place")
    below = below.select("_place", "_run", F.when(c("_more"), c("_lower")).otherwise(c("_then")).alias("_next_id"))
    heads = docs.join(tops.select(c("_head").alias("_id")), c("doc_id").eqNullSafe(c("_id"))).groupBy("_id").agg(
        F.min_by(F.struct(*columns), F.coalesce("text", F.lit(""))).alias("_h")).select("_id", "_h.*").withColumns(derived)
    columns = [*columns, *derived]
    heads = heads.select("_id", F.struct(*columns).alias("_after"))
    after = below.join(heads, c("_next_id").eqNullSafe(c("_id"))).select("_place", "_run", "_after")
    ordered = Window.partitionBy("_place", "_run").orderBy(c("doc_id").desc_nulls_last(), c("text").asc_nulls_first())
    led = held.withColumns({f"next_{x}": F.lead(x).over(ordered) for x in columns} | {"_more": F.lead(end).over(ordered)})
    led = led.join(after, ["_place", "_run"])
    return led.withColumns({f"next_{x}": F.when(c("_more"), c(f"next_{x}")).otherwise(c(f"_after.{x}")) for x in columns}).drop(
        "_place", "_run", "_more", "_after")


def fingerprints(docs: DataFrame, keep_bits: int = KEEP_BITS) -> DataFrame:
    """docs with ``sketch`` (array of hashes) and ``fingerprint`` (text)."""
    return docs.withColumn("sketch", sketch(F.col("text"), keep_bits=keep_bits)).withColumn("fingerprint", encoded(F.col("sketch")))


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Each document's sketch against that of its edited text and of the next document."""
    from .common import table

    c = F.col
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs, ["text"], {"sketch": sketch(c("text"))})
    cut = F.floor(F.length("text") / 3).cast("int")
    pairs = pairs.withColumn("edited", F.concat(
        F.substring(c("text"), F.lit(1), F.length("text") - cut), F.substring(c("next_text"), F.lit(1), cut)))
    pairs = pairs.withColumn("edited_sketch", sketch(c("edited")))
    return pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        encoded(c("sketch")).alias("fingerprint"), encoded(c("edited_sketch")).alias("edited_fingerprint"),
        likeness(c("sketch"), c("edited_sketch")).cast("double").alias("near_edited"),
        likeness(c("sketch"), c("next_sketch")).cast("double").alias("near_next"),
        containment(c("sketch"), c("edited_sketch")).cast("double").alias("kept_in_edited"))
