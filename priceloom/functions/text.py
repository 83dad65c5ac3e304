"""Text keys as Column expressions (kept JVM-side)."""
from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters dropped from a text key, next to white space.
KEY_PUNCTUATION = "·•，,。.;；:：()（）\\[\\]【】<>《》“”\"'‘’/\\\\_—–-"
KEY_CLASS = f"(?U)[\\s{KEY_PUNCTUATION}]+"
# What becomes of ASCII characters in a text key: letters in lower case, then the dropped ones, which have no counterpart.
ASCII_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r \"'(),-./:;<>[\\]_"
ASCII_TO = "abcdefghijklmnopqrstuvwxyz"
NOT_ASCII = "[^\\x00-\\x7F]"
# Fixed value: separators dropped from a price-book (catalog) name.
CATALOG_CLASS = "(?U)[\\s_\\-·．.]+"
SPACES = "(?U)[\\s　]+"


@lru_cache(maxsize=1)
def _compatibility_maps() -> tuple[str, str, list[tuple[str, str]], str]:
    """Character maps for compatibility folding, derived from the Unicode database.

    One-to-one foldings go through ``translate``; the few that expand to several
    characters (unit squares, roman numerals, fractions, ligatures) are replaced one by
    one, and only on rows that hold such a character.
    """
    source, target, wide = [], [], []
    for point in range(0x80, 0xFFFF):
        if 0xD800 <= point <= 0xF8FF:
            continue
        char = chr(point)
        folded = unicodedata.normalize("NFKC", char)
        if folded == char:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif point < 0x0400 or 0x2000 <= point <= 0x33FF or 0xFB00 <= point <= 0xFB06:
            wide.append((char, folded))
    klass = "[" + "".join(char for char, _ in wide) + "]"
    return "".join(source), "".join(target), wide, klass


def nfkc(c: Column) -> Column:
    """Unicode compatibility folding for single characters (no recomposition of marks)."""
    source, target, wide, klass = _compatibility_maps()
    pairs = F.split(F.lit("\u0000".join(f"{a}{b}" for a, b in wide)), "\u0000")
    none = F.array().cast("array<string>")
    widened = F.aggregate(
        F.when(c.rlike(klass), pairs).otherwise(none), c,
        lambda acc, p: F.replace(acc, F.substring(p, 1, 1), F.substring(p, 2, 20)),
    )
    return F.when(is_ascii(c), c).otherwise(F.translate(widened, source, target))


def folded(c: Column) -> Column:
    """Compatibility folding plus lower case; NULL becomes empty."""
    return F.lower(nfkc(F.coalesce(c.cast("string"), F.lit(""))))


def is_ascii(text: Column) -> Column:
    """As many bytes as characters."""
    return F.octet_length(text) == F.length(text)


def ascii_key(text: Column) -> Column:
    """Text key of a text in ASCII."""
    return F.translate(text, ASCII_FROM, ASCII_TO)


def normalize_text(c: Column) -> Column:
    """Text key.  Texts in ASCII need no folding: one pass over their characters gives the same key."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(is_ascii(text), ascii_key(text)).otherwise(F.regexp_replace(folded(c), KEY_CLASS, ""))


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "(?U)^[\\s　]+|[\\s　]+$", "")


def drop_float_suffix(c: Column) -> Column:
    """``30307216301.0`` -> ``30307216301``."""
    return F.regexp_replace(c, "^(\\d+)\\.0$", "$1")


def key_of_folded(text: Column) -> Column:
    """Text key of an already folded text."""
    return F.when(is_ascii(text), F.translate(text, ASCII_FROM[26:], "")).otherwise(F.regexp_replace(text, KEY_CLASS, ""))


def plain_code(c: Column) -> Column:
    """Folded code text without white space around it or a float suffix."""
    return F.lower(drop_float_suffix(strip_ws(nfkc(F.coalesce(c.cast("string"), F.lit(""))))))


def normalize_code(c: Column) -> Column:
    return key_of_folded(plain_code(c))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def standard_code(c: Column) -> Column:
    return drop_float_suffix(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), SPACES, ""))


def any_of(words) -> str:
    """Regular-expression alternation of literal words, order kept."""
    return "|".join("\\Q%s\\E" % word for word in words)


def core_of_key(key: Column, lex) -> Column:
    """Name core from an already normalized text key."""
    text = key
    if lex.subject_prefixes:
        text = F.regexp_replace(text, f"^(?=.{{4}})(?:{any_of(lex.subject_prefixes)})+", "")
    for wrong, right in lex.term_swaps:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    text = F.regexp_replace(text, "(?<=[一-鿿])[a-z]$", "")
    text = F.regexp_replace(text, "\\d{2}$|(?<=.)\\d$", "")
    return F.coalesce(F.nullif(text, F.lit("")), key)


def name_core(c: Column, lex) -> Column:
    return let(normalize_text(c), lambda key: core_of_key(key, lex))


def grade_of_key(key: Column, lex) -> Column:
    if not lex.grade_marks:
        return F.lit("")
    return F.regexp_extract(key, f"^({any_of(lex.grade_marks)})", 1)


def grade_marker(c: Column, lex) -> Column:
    return grade_of_key(normalize_text(c), lex)


def cell_text(c: Column) -> Column:
    return strip_ws(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), SPACES, " "))


def cell_name(c: Column) -> Column:
    """Cell text for a name column: wrapped lines join without a gap."""
    text = strip_ws(c)
    return F.when(text.rlike("[\\r\\n]"), F.regexp_replace(text, SPACES, "")).otherwise(
        F.regexp_replace(text, SPACES, " ")
    )


def header_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), SPACES, ""))


def number_value(c: Column) -> Column:
    cleaned = strip_ws(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[,，￥¥]", ""))
    return F.when(
        cleaned.rlike("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"), cleaned.try_cast("double")
    )


def catalog_key(c: Column) -> Column:
    return F.regexp_replace(folded(c), CATALOG_CLASS, "")


def bigrams(key: Column) -> Column:
    """Bigrams of a text key (a plain column), numbered so that set intersection counts multisets."""
    n = F.length(key)
    grams = F.array_sort(
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(key, i, F.lit(2)))
    )
    numbered = F.transform(
        grams, lambda g, i: F.concat(g, F.lit("#"), (i + 1 - F.array_position(grams, g)).cast("string"))
    )
    return F.when(n >= 2, numbered).otherwise(F.array().cast("array<string>"))


def format_g(c: Column) -> Column:
    """Shortest text of a number at six significant digits."""
    rounded = F.format_string("%.5e", c.cast("double")).cast("double").cast("string")
    return F.regexp_replace(rounded, "\\.0$", "")


def first_set(*cols: Column) -> Column:
    """First non-empty text, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


__all__ = [name for name in dir(sys.modules[__name__]) if not name.startswith("_")]
