"""Row identity."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_key, first_set, is_ascii, normalize_text

IDENTITY_FIELDS = ["name", "spec", "unit", "manufacturer"]


def identity_parts(fields=IDENTITY_FIELDS) -> list[Column]:
    return [normalize_text(F.col(f)).alias(f"key_{f}") for f in fields]


def price_key(c: Column) -> Column:
    return F.round(F.coalesce(c.cast("double"), F.lit(0.0)), 4)


def digest(*parts: Column) -> Column:
    """128 bits that stand for some texts (NULL counts as empty); rows are sorted and shuffled by them, not by the texts.

    The lengths come first, so texts that only join to the same text differ.
    """
    texts = [F.coalesce(x.cast("string"), F.lit("")) for x in parts]
    return _digest_of(F.concat_ws("|", *[F.length(x).cast("string") for x in texts], *texts))


#: Stands between the texts of one joined key; no folding makes or drops it.
BETWEEN = "\x1f"


def joined_key(fields=IDENTITY_FIELDS) -> Column:
    """The text keys of some fields as one text.  ASCII texts are joined first and folded in one pass.

    A text that holds the separator itself is rare: then the lengths of all keys come first, which makes more
    separators than any other row has.
    """
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    parts = identity_parts(fields)
    held = reduce(or_, [x.contains(BETWEEN) for x in texts])
    text = F.concat_ws(BETWEEN, *texts)
    careful = F.when(held, F.concat_ws(BETWEEN, *[F.length(x).cast("string") for x in parts], *parts)).otherwise(F.concat_ws(BETWEEN, *parts))
    return F.when(is_ascii(text) & ~held, ascii_key(text)).otherwise(careful)


def _digest_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def identity_key(fields=IDENTITY_FIELDS) -> Column:
    return _digest_of(joined_key(fields))


def dedup_key() -> Column:
    """Identity and price; adding zero gives -0.0 the text of 0.0."""
    price = (price_key(F.col("price")) + F.lit(0.0)).cast("string")
    return _digest_of(F.concat(price, F.lit(BETWEEN), joined_key()))


def vendor_key(manufacturer: Column, brand: Column) -> Column:
    return normalize_text(first_set(manufacturer, brand))
