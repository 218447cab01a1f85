"""Tokens and words as native expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")


def normalized(text: Column) -> Column:
    """Camel case split, lower case, everything but letters and digits to single spaces."""
    return F.trim(F.regexp_replace(F.lower(split_camel(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    """The words of ``normalized``, in order, repeats kept."""
    return F.filter(F.split(normalized(text), " "), lambda w: w != "")


def singular(word: Column) -> Column:
    """An obvious English plural folded to its singular; short words and -ss stay."""
    n = F.length(word)
    return (
        F.when((n <= 3) | word.endswith("ss"), word)
        .when(word.endswith("ies"), F.concat(word.substr(F.lit(1), n - 3), F.lit("y")))
        .when(word.rlike("(s|x|z|ch|sh)es$"), word.substr(F.lit(1), n - 2))
        .when(word.endswith("s"), word.substr(F.lit(1), n - 1))
        .otherwise(word)
    )


def entropy(word: Column) -> Column:
    """Shannon entropy of the characters of a word, in bits a character; 0 for an empty one."""
    letters = F.regexp_extract_all(word, F.lit("([\\s\\S])"))
    size = F.size(letters)
    weighed = F.aggregate(
        F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)).cast("double")), F.lit(0.0), lambda acc, n: acc + n * F.log2(n)
    )
    return F.when(size > 0, F.log2(size.cast("double")) - weighed / size).otherwise(0.0)
