"""Product families from codes and names."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, folded, let, plain_code


def code_major(c: Column, lex) -> Column:
    """Family of a five-digit code by its first two digits; empty for other codes."""
    return let(plain_code(c), lambda code: major_of_code(code, lex))


def major_of_code(code: Column, lex) -> Column:
    """The same for a code already cleaned by ``plain_code``."""
    if not lex.code_majors:
        return F.lit("")
    table = F.create_map(*[F.lit(x) for pair in lex.code_majors.items() for x in pair])
    return F.when(
        code.rlike("^\\d{5}$"), F.coalesce(F.try_element_at(table, F.substring(code, 1, 2)), F.lit(""))
    ).otherwise(F.lit(""))


def infer_category(c: Column, lex) -> Column:
    """Category of the first keyword rule found in the name."""
    return let(F.regexp_replace(folded(c), SPACES, ""), lambda text: category_of_text(text, lex))


def category_of_text(text: Column, lex) -> Column:
    """The same for a folded text without white space."""
    chain = None
    for keyword, category in lex.category_rules:
        hit = text.contains(keyword)
        chain = F.when(hit, F.lit(category)) if chain is None else chain.when(hit, F.lit(category))
    return F.lit("") if chain is None else chain.otherwise(F.lit(""))


def compatible(major_a: Column, major_b: Column, cat_a: Column, cat_b: Column) -> Column:
    def agree(a, b):
        return (a == "") | (b == "") | (a == b)

    return agree(major_a, major_b) & agree(cat_a, cat_b)


def incompatible_reason(major_a: Column, major_b: Column, cat_a: Column, cat_b: Column) -> Column:
    by_major = (major_a != "") & (major_b != "") & (major_a != major_b)
    by_cat = (cat_a != "") & (cat_b != "") & (cat_a != cat_b)
    return (
        F.when(by_major, F.concat(F.lit("类目不符(JY "), major_a, F.lit(" vs "), major_b, F.lit(")")))
        .when(by_cat, F.concat(F.lit("类目不符("), cat_a, F.lit(" vs "), cat_b, F.lit(")")))
        .otherwise(F.lit(""))
    )
